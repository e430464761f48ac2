"""Channels of recall, neighbors by identity, and evidence with its places."""

import re

import pytest
from pyspark.sql import functions as F

from kinfolk.operators import recall, search, vectors


def test_copies_are_counted_before_they_meet(spark):
    docs = spark.createDataFrame([(k, "same" if k % 3 else f"t{k}", f"s{k % 4}", "EN" if k % 2 else "en") for k in range(200)] + [(900, None, "s1", "en"), (901, "same", None, "en"), (902, "same", "s1", None)], "doc_id long, text string, source string, lang string")
    got = {(r.q_id, r.source): r.c_id for r in recall.exact_fingerprint(docs, F.col("doc_id") % 50 == 0).collect()}
    rows = docs.collect()
    want = {}
    for q in rows:
        for c in rows:
            if q.doc_id % 50 == 0 and None not in (q.text, q.source, q.lang, c.text, c.source, c.lang) and q.text == c.text and q.source != c.source and q.lang.lower() == c.lang.lower():
                want[q.doc_id, c.source] = min(c.doc_id, want.get((q.doc_id, c.source), c.doc_id))
    assert got == want and want
    plan = recall.exact_fingerprint(docs, F.col("doc_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


def test_breadth_counts_sources(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a  b", "y"), (3, "a b // c", "z"), (4, "a b", "x"), (5, "other", "x"), (6, None, "x"), (7, "a b", None)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.breadth, r.is_common) for r in recall.breadth(docs).collect()}
    assert got[1] == got[2] == got[3] == got[7] == (3, True) and got[5] == (1, False) and set(got) == {1, 2, 3, 4, 5, 6, 7}


SIDE = "doc_id long, source string, file string, name array<string>, params int, behavior array<string>, control array<string>"


def test_identity_neighbors(spark):
    docs = [
        (1, "q", "m", ["read", "page"], 2, ["walk", "map", "flush"], ["if"]),
        (10, "s", "a", ["other"], 9, ["none"], []),  # the seed
        (11, "s", "a", ["read", "page"], 2, ["walk", "map"], ["if"]),
        (12, "s", "a", ["read", "page"], 9, ["else"], ["for"]),  # same name, nothing else
        (13, "s", "a", ["fetch", "page"], 2, ["walk", "map", "flush"], ["if"]),
        (14, "s", "a", ["read", "pages"], 2, [], ["if"]),  # another name, no behavior
        (15, "s", "b", ["read", "page"], 2, ["walk", "map"], ["if"]),  # another file
        (16, "s", "a", ["read", "page"], 2, ["walk", "map"], ["if"]),  # recalled already
        (17, "s", "a", None, None, None, None),
    ]
    table = spark.createDataFrame(docs, SIDE)
    pairs = lambda rows: spark.createDataFrame(rows, "q_id long, c_id long")
    found = recall.identity_neighbors(pairs([(1, 10), (1, 10), (1, 999)]), table, pairs([(1, 10), (1, 16)]), ["source", "file"])
    got = {r.c_id: round(r.identity, 4) for r in found.collect()}
    assert set(got) == {11, 13} and got[11] == round(0.45 + 0.2 + 0.25 * 2 / 3 + 0.1, 4) and got[13] == round(0.45 / 3 + 0.2 + 0.25 + 0.1, 4)
    with pytest.raises(ValueError):
        recall.identity_neighbors(pairs([(1, 10)]), table, pairs([]), ["source", "file"], most=6)
    assert recall.identity_neighbors(pairs([]), table, pairs([]), ["source", "file"]).count() == 0


def test_nearest_of_given_candidates(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [2.0, 2.0]), (5, None), (6, [-1.0, 0.0])], "id long, v array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (5, 1), (2, 1)], "q_id long, id long")
    got = [(r.q_id, r.id, round(r.score, 3), r["rank"]) for r in vectors.topk_of_pairs(pairs, rows, 3).orderBy("q_id", "rank").collect()]
    assert got == [(1, 2, 0.707, 1), (1, 4, 0.707, 2), (1, 3, 0.0, 3), (2, 1, 0.707, 1)]


def brute_findings(docs, signals, by_file):
    out, seen = {}, set()
    for d, text in docs:
        for k, (category, pattern, weight) in enumerate(signals):
            for m in re.finditer(pattern, text or ""):
                line = (text or "").count("\n", 0, m.start()) + 1
                if (d, line, category) in seen:
                    continue
                seen.add((d, line, category))
                excerpt = " ".join(text.split("\n")[line - 1].split())[:280]
                out.setdefault((d, category, None if category in by_file else line), []).append((line, k, excerpt, weight))
    return {(f"{d}:{min(x)[0]}:{c}", d, c, min(x)[0], min(x)[2], min(x)[3], tuple(sorted(y[0] for y in x)), len(x)) for (d, c, _), x in out.items()}


def test_findings_with_places(spark):
    signals = [("skip", r"exit\s+0", 0.5), ("name", r"test_[a-z]+", 0.7), ("name", r"if[^\n]*test", 0.9), ("skip", r"\|\|\s*true", 0.4), ("span", r"cache[\s\S]{0,20}?score", 0.45), ("dollar", r"\$x", 0.1)]
    texts = ["make || true\nexit 0; exit  0\n\n  if (test_a)  test_b\nx", "cache\n\nof\nscore cache score", "exit 0", "", None, "long " * 100 + "test_z", "a $x\n\x01b $x $x", "exit\n0"]
    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.finding, r.doc_id, r.category, r.line, r.excerpt, r.confidence, tuple(r.lines), r.hits) for r in search.findings(table, signals, by_file=("skip",)).collect()}
    assert got == brute_findings([(d, t and t.replace("\x01", "")) for d, t in docs], signals, ("skip",))
    assert search.findings(table.limit(0), signals).count() == 0
