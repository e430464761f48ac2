"""Links by shared lines and masked lines against the plain all-pairs comparison."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinfolk.functions import text as X
from kinfolk.operators import align, lines


def docs_of(spark):
    rng = random.Random(3)
    pool = [f"line number {k} of the pool" for k in range(60)]
    rows = []
    for k in range(240):
        own = rng.sample(pool[:12], rng.randint(0, 3)) + rng.sample(pool, rng.randint(1, 6)) + (["a very hot line"] if k % 3 else [])
        rows.append((k, "\n".join(own), f"s{k % 4}" if k % 17 else None, "en" if k % 5 else "fr"))
    five = "\n".join(f"shared by two, line {k}" for k in range(5))
    rows += [(900, five, "s1", "en"), (901, five, "s2", "en"), (902, "shared by two, line 0\nown line of 902", "s1", "en")]
    rows += [(1000 + k, "only this line", "s1", "en") for k in range(30)] + [(2000, None, "s1", "en"), (2001, "", None, None), (2002, "short", "s1", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), rows


def line_set(text):
    return frozenset(" ".join(x.split()) for x in (text or "").split("\n") if len(" ".join(x.split())) >= 8)


def test_links_are_those_of_all_pairs(spark):
    docs, rows = docs_of(spark)
    sets = {i: line_set(t) for i, t, *_ in rows}
    where = {i: (s, g) for i, _, s, g in rows}
    for least in (0.5, 0.3, 0.8):
        want = {}
        for q in sets:
            for c in sets:
                hits = len(sets[q] & sets[c])
                if q != c and hits and hits >= least * max(len(sets[q]), len(sets[c])):
                    want.setdefault((q, sets[c], where[c]), []).append((c, hits))
        got = {}
        for r in lines.line_links(docs, F.lit(True), least).collect():
            got[r.q_id, sets[r.c_id], (r.c_source, r.c_lang)] = (r.c_copies, r.hits)
            assert (r.q_source, r.q_lang) == where[r.q_id] and abs(r.line_sim - r.hits / max(r.q_lines, r.c_lines)) < 1e-12
        assert got == {k: (len(v), v[0][1]) for k, v in want.items()}
    asked = lines.line_links(docs, F.col("doc_id") % 50 == 0)
    assert {r.q_id for r in asked.collect()} <= {i for i in sets if i % 50 == 0}
    assert lines.line_links(docs.limit(0), F.lit(True)).count() == 0


def test_equal_documents_are_fully_alike(spark):
    docs, _ = docs_of(spark)
    near = {(r.q_id, r.c_id): r.line_sim for r in lines.line_links(docs, F.lit(True)).filter("q_id in (900, 901)").collect()}
    assert near[900, 901] == near[901, 900] == 1.0


def test_rare_line_hits(spark):
    docs, rows = docs_of(spark)
    sets = {i: line_set(t) for i, t, *_ in rows}
    where = {i: (s, g) for i, _, s, g in rows}
    breadth = {}
    for i, s in sets.items():
        for x in s:
            breadth.setdefault(x, set()).add(where[i][0])
    rare = {x for x, s in breadth.items() if 2 <= len(s - {None}) <= 3}
    want = {}
    for q in (i for i in sets if i % 10 == 0):
        for c in sets:
            hits = len(sets[q] & sets[c] & rare)
            if hits and None not in (where[q][0], where[c][0]) and where[q][0] != where[c][0]:
                want.setdefault((q, sets[c], where[c]), []).append(hits)
    got = {(r.q_id, sets[r.c_id], where[r.c_id]): (r.c_copies, r.hits) for r in lines.rare_line_hits(docs, F.col("doc_id") % 10 == 0, most=3).collect()}
    assert got == {k: (len(v), v[0]) for k, v in want.items()}


def test_renamed_copies_are_found_and_aligned(spark):
    body = ["def total(items):", "    result = 0", "    for item in items:", "        result += item.price", "    return result"]
    renamed = [x.replace("total", "amount").replace("items", "things").replace("item", "thing").replace("result", "out") for x in body]
    other = ["import socket", "server = socket.listen(80, backlog=5)", "while True: server.accept()"]
    data = [(1, "\n".join(body), "a", "py"), (2, "\n".join(renamed), "b", "py"), (3, "\n".join(other), "b", "py"), (4, "\n".join(renamed), "c", "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string")
    got = {(r.q_id, r.c_id): r for r in align.verified_pairs(docs, F.lit(True), ("def", "for", "in", "return")).collect()}
    assert set(got) == {(1, 2), (2, 1)} and got[1, 2].tier == "confirmed" and got[1, 2].renamed_lines == 5 and got[1, 2].exact_lines == 0
    e, r, s, spans = align.aligned(body, body[:2] + renamed[2:], [f"m{k}" for k in range(5)], [f"m{k}" for k in range(5)])
    assert (e, r, s) == (2, 3, 1.0) and [x["kind"] for x in spans] == ["exact", "renamed"]
    moved = spark.createDataFrame([(spans,)], f"s {align.SPANS}").select(align.remapped(F.col("s"), F.lit(10), F.lit(20)).alias("m")).first().m
    assert (moved[0].a_start, moved[0].a_end, moved[0].b_start) == (10, 11, 20)


def test_masked_lines_are_those_of_the_columns(spark):
    odd = ["x = 'a b' + \"c\" + 'open", "  été\tnaïve_1 0x1F 3.14.a  _a ' \" ", "\x1c é", "a\u00a0b 12", "if (a) return b; for c", "'' \"\" '\"' \"'\"", "日本 x1 😀 9z", "\x0b\x0c tab\x0bfeed"]
    docs = spark.createDataFrame([(k, x, "s", "en") for k, x in enumerate([*odd, "\n".join(odd), "short", None])], "doc_id long, text string, source string, lang string")
    for keep in ((), ("if", "for", "_a")):
        lines_ = X.line_array(F.col("text"))
        want = docs.select("doc_id", lines_.alias("l"), F.transform(lines_, lambda x: X.mask_line(x, keep)).alias("m")).collect()
        assert all([align.masked_line(a, frozenset(keep)) for a in r.l] == r.m for r in want)
        got = {r.doc_id: r for r in align.masked_lines(docs, keep).collect()}
        assert set(got) == {r.doc_id for r in want if any(len(a) >= 8 for a in r.l)}
        numbers = {r.doc_id: ([align._number(a) for a in r.l], [align._number(a) for a in r.m], {align._number(b) for a, b in zip(r.l, r.m) if len(a) >= 8}) for r in want}
        assert all((r.seq, r.masked, set(r.hs)) == numbers[k] for k, r in got.items())


def test_patterns_of_lines_are_aligned_once(spark, monkeypatch):
    rng = random.Random(7)
    one = lambda: [rng.randint(0, 5) for _ in range(rng.randint(0, 7))]
    rows = [(one(), one()) for _ in range(3000)] + [([1] * 40, [1] * 40)]
    sides = [pa.array(x, pa.list_(pa.int64())) for x in ([a for a, _ in rows], [b for _, b in rows], [[v // 2 for v in a] for a, _ in rows], [[v // 2 for v in b] for _, b in rows])]
    want = [align.aligned(*(np.array(x, np.int64) for x in (a, b, [v // 2 for v in a], [v // 2 for v in b])))[:3] for a, b in rows]
    calls, plain = [], align.aligned
    monkeypatch.setattr(align, "aligned", lambda *x: calls.append(1) or plain(*x))
    assert list(zip(*(x.tolist() for x in align.aligned_counts(sides, {})))) == want and len(calls) < len(rows)
    same = [pa.array([[k, -1] for k in range(2000)], pa.list_(pa.int64())), pa.array([[-2 - k, -1] for k in range(2000)], pa.list_(pa.int64()))] * 2
    calls.clear()
    exact, renamed, share = align.aligned_counts(same, {})
    assert len(calls) == 1 and set(exact) == {1} and set(share) == {0.5}


def test_aligned_pairs_are_not_shuffled(spark):
    docs, _ = docs_of(spark)
    text = align.verified_pairs(docs, F.lit(True))._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("q_block")]
    assert "MapInArrow" in above and "Exchange" not in above
