"""Filter audit, fill-in-middle and the ranking classifier."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfolk.llm import fill_middle, filter_audit, quality_ranking

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = {}
    for d, text, source in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": d is not None and d > least[text],
        }
        rows.setdefault(source or "", []).append((fails, d in good, d in toxic))
    out = {}
    for part, of in rows.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = of
            for k, f in enumerate(order, 1):
                here = [x for x in left if x[0][f]]
                gone = [x for x in of if x not in left]
                early = [x for x in of if any(x[0][g] for g in order[: k - 1])]
                assert len(early) == len(of) - len(left) and len(gone) <= len(early)
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(here)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in of)
                out[part, "".join(order), k] = [len(left), len(here), sum(x[0][f] for x in early), alone, sum(x[1] for x in here), sum(x[2] for x in here)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order, 1):
                out[part, "".join(order), k].append(shapley[f])
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def check_audit(spark, docs, labels):
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, source string, mask int, n int, k string")
    marks = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in filter_audit.audit(table, marks).collect()}
    assert got == brute_audit(docs, labels)


def test_audit_of_all_cases(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = ["", None, "short", long, long + " #", "A B C " * 30, long.upper(), "x " * 80, " ".join("ab" * 30), "é\x0b\x0c\r\n\t  b", long + " word"]
    docs = [(k, texts[k % len(texts)], ("s1", "s2", None, "")[k % 4]) for k in range(60)]
    docs += [(7, texts[3], "s1"), (7, texts[3], "s1"), (7, long, "other"), (None, texts[3], "s1"), (None, "", None), (None, None, "s1"), (-3, "x " * 80, "s2")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 60, 2)] + [(7, 1, None), (7, 0, 1), (None, 1, 1), (999, 1, 1), (8, None, None)]
    check_audit(spark, docs, labels)


def test_audit_of_one_text_and_of_nothing(spark):
    check_audit(spark, [(k, "same", "hot" if k % 3 else None) for k in range(500)], [(k, 1, 1) for k in range(0, 500, 7)])
    check_audit(spark, [], [(1, 1, 1)])
    check_audit(spark, [(1, "a", "s")], [])


def test_audit_shuffles_no_text(spark):
    docs = spark.createDataFrame([(1, "some text", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    plan = filter_audit.audit(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Nested" not in plan and "Cartesian" not in plan
    for line in plan.splitlines():
        assert "Exchange" not in line or "text#" not in line


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute_middle(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    hexes = hashlib.sha256(b"1:" + ("" if doc is None else str(doc)).encode()).hexdigest()
    h = [int(hexes[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**9), st.text(st.sampled_from("abZ <>PSM.\n\x00?é漢\U0001f600"), max_size=60))
def test_middle_is_brute_force(doc, text):
    got = fill_middle.transform(str(doc), text)
    assert got == brute_middle(doc, text)
    assert fill_middle.restored(got[4], got[1]) == text


@given(st.text(st.sampled_from("aZ1 é"), min_size=1, max_size=40))
def test_every_cut_is_the_start_of_a_unit(text):
    starts, ranks, sentinel = fill_middle.scan(text)
    units = UNIT.findall(text)
    assert not sentinel and int(ranks[-1]) == len(units)
    assert [fill_middle.cut(starts, ranks, k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


def test_middle_of_a_table(spark):
    texts = ["", None, "one", "<P>", "a<S>b", "<M", "Zwei Wörter. ", "x" * 100_000, "1 " * 50_000, "<" * 9 + "P>", "漢字 and é\r\n", "<P<S<M"]
    data = [(k, texts[k % len(texts)]) for k in range(300)] + [(5, "again"), (5, "again"), (None, "no id here"), (-8, "negative id")]
    docs = spark.createDataFrame([(*r, "form", 3) for r in data], "doc_id long, text string, form string, n int")
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in fill_middle.fill_in_middle(docs).collect()), key=str)
    want = []
    for doc, text in data:
        out = brute_middle(doc, text)
        want.append((doc, *out, hashlib.sha256(out[4].encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def brute_features(text):
    w = WORD.findall(text)
    n, c = len(w), len(text)
    lines = [x for x in text.split("\n") if x.strip(" ")]
    pairs = list(zip(w, w[1:]))
    share = lambda a, b: a / b if b else 0.0
    return {
        "log_words": np.log1p(n),
        "distinct_words": share(len(set(w)), n),
        "distinct_pairs": share(len(set(pairs)), len(pairs)),
        "upper": share(sum(x.isupper() for x in text), c),
        "symbols": share(len(re.findall(r"[^\w\s]|_", text)), c),
        "digits": share(sum(x.isnumeric() for x in text), c),
        "repeated_lines": share(len(lines) - len(set(lines)), len(lines)),
        "word_length": share(sum(map(len, w)), n),
        "bare_words": share(sum(not any(x.isalnum() for x in y) for y in w), n),
        "short_words": share(sum(len(x) <= 3 for x in w), n),
        "log_lines": np.log1p(len(lines)),
    }


def test_features_are_those_of_brute_force(spark):
    texts = ["", " \n\n ", "One two TWO two 12 #", "a\na\nb\n", "é É ß 漢 | | a_b", "the the the the", "word"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", quality_ranking.features(F.col("text")).alias("x")).collect()
    assert list(rows[0].x.asDict()) == quality_ranking.FEATURES
    for r in rows:
        assert r.x.asDict() == pytest.approx(brute_features(r.text)), r.text


def corpus(n):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        words = [f"wort{x}" for x in rng.integers(0, 500, rng.integers(20, 200))]
        good = k % 5 > 0
        text = " ".join(words) if good else " | ".join(words) if k % 2 else " ".join(words[:8] * 20)
        rows.append((k, text, good))
    return rows


def auc(score, label):
    good, bad = score[label], score[~label]
    return float(((good[:, None] > bad[None, :]) + 0.5 * (good[:, None] == bad[None, :])).mean())


def test_ranking_of_held_out_rows(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([(k, t, "s", 9.0) for k, t, _ in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, int(g), 0) for k, _, g in rows], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_ranking.classify(docs, labels).collect()}
    for k, r in out.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [k for k in out if out[k].held_out]
    truth = np.array([k % 5 > 0 for k in held])
    assert auc(np.array([out[k].score for k in held]), truth) > 0.99
    assert np.mean(np.array([out[k].predicted for k in held]) == truth) > 0.97
    # Labels of held-out rows are not read.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int"))
    again = {r.doc_id: r.score for r in quality_ranking.classify(docs, turned).collect()}
    assert all(out[k].score == pytest.approx(again[k], abs=1e-12) for k in out)


def test_ranking_edges(spark):
    data = [(1, "a b c"), (2, None), (None, "no id"), (3, "x " * 100_000), (3, "same id"), (3, "same id"), (4, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for marks in ([], [(1, 1), (3, 1)], [(1, 7), (None, 0)]):  # nothing, one label, no label in use
        out = quality_ranking.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()
        assert len(out) == len(data) and all(r.score == 0.5 and r.predicted == 0 for r in out)
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2]
    more = docs.unionByName(spark.createDataFrame([(k, f"id {k}") for k in ids], "doc_id long, text string"))
    marks = spark.createDataFrame([(k, k % 2) for k in ids] + [(ids[0], 1), (ids[0], 0), (ids[1], None)], "doc_id long, quality int")
    out = quality_ranking.classify(more, marks).collect()
    assert len(out) == len(data) + len(ids) and all(0 <= r.score <= 1 for r in out)
    assert quality_ranking.classify(docs.limit(0), marks).count() == 0


def test_preferences_and_fit():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (60, 3)), rng.normal(0, 1, (25, 3))
    d = quality_ranking.preferences(good, bad)
    assert len(d) == 60 * quality_ranking.PARTNERS
    every = {tuple(np.round(g - b, 9)) for g in good for b in bad}
    assert all(tuple(np.round(x, 9)) in every for x in d)
    assert np.allclose(quality_ranking.preferences(bad, good).sum(), -sum(sum(x) for x in d))
    w = quality_ranking.fit(d)

    def loss(v):
        return np.logaddexp(0, -d @ v).sum() + quality_ranking.RIDGE * len(d) * (v @ v) / 2

    assert all(loss(w) <= loss(w + 1e-3 * e) for e in np.vstack([np.eye(3), -np.eye(3)]))


def test_cutoff_is_the_quantile(spark):
    rng = np.random.default_rng(2)
    raw = np.concatenate([rng.normal(3, 2, 900), rng.normal(-2, 2, 100), [500.0, -500.0]])
    quality = [1] * 900 + [0] * 100 + [1, 0]
    rows = spark.createDataFrame([(q, float(x)) for q, x in zip(quality, raw)], "quality int, raw double")
    cutoff = quality_ranking.quantile_cutoff(rows)
    assert abs(int((raw < cutoff).sum()) - 101) <= 3
