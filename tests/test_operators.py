"""Operators on small tables, against plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfolk.operators import align, contracts, fingerprints, history, recall, rollup, search, selection, vectors
from kinfolk.operators.components import connected_components


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100, 220)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(500, 500), (None, 3), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in parent if find(x) != x)
    assert pairs(connected_components(spark.createDataFrame(links, "a long, b long")), "node", "component") == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    from itertools import permutations

    gain = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    got = align.assign(gain)
    small, large = sorted((n, m))
    g = gain if n <= m else gain.T
    best = max(sum(g[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
    assert len(got) == small and len({i for i, _ in got}) == small == len({j for _, j in got})
    assert sum(gain[i, j] for i, j in got) == best


def test_alignment_counts_query_lines():
    assert align.aligned(["a", "b", "c"], ["a", "c"], ["a", "b", "c"], ["a", "c"])[:3] == (2, 0, 2 / 3)
    assert align.aligned(["x"], ["y"], ["ID"], ["ID"])[:3] == (0, 1, 1.0) and align.aligned([], [], [], []) == (0, 0, 0.0, [])


def test_segments(spark):
    df = spark.createDataFrame([(1, 2, [[1.0, 0.0], [0.0, 1.0]], [[0.0, 2.0], [0.0, 3.0]]), (1, 3, [], [[1.0]]), (1, 4, None, None)], "q_id long, c_id long, q_segments array<array<double>>, c_segments array<array<double>>")
    assert pairs(align.match_segments(df), "c_id", "hits", "q_total", "c_total") == [(2, 1, 2, 2), (3, 0, 0, 1), (4, 0, 0, 0)]


def test_internal_duplicates(spark):
    rows = [("f", "b", ["x", "y"]), ("f", "a", ["x", "y"]), ("f", "c", ["z"]), ("g", "d", ["x", "y"])]
    out = align.internal_duplicates(spark.createDataFrame(rows, "name string, file string, lines array<string>"))
    assert pairs(out, "file", "canonical") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


def test_union_keeps_the_first_score(spark):
    frame = lambda rows: spark.createDataFrame(rows, "q_id long, c_id long, score double")
    out = recall.recall_union([("vector", frame([(1, 2, 0.4)])), ("name", frame([(1, 2, 0.9), (1, 3, 0.0)]))])
    assert pairs(out, "c_id", "recall_source", "score", "vector_match", "name_match") == [(2, "vector", 0.4, True, True), (3, "name", 0.0, False, True)]


def test_or_join_has_no_nested_loop(spark):
    five, wide = "a\nb\nc\nd\nx y", "a\nb\nc\nd\nx  y"
    short = [(100, "x y", "e", "en"), (101, "x y", "f", "en"), (102, "\n\n# only\n// comments\n", "a", "en"), (150, "# other", "b", "en")]  # files of fewer than five lines take no part
    docs = spark.createDataFrame([(0, five, "a", "en"), (50, wide, "b", "en"), (51, five, "c", "en"), (52, None, "d", "en"), *short], "doc_id long, text string, source string, lang string")
    out = recall.file_identity(docs, F.col("doc_id") % 50 == 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs(out, "q_id", "n_candidates", "n_verified", "n_rejected") == [(0, 2, 1, 1), (50, 2, 0, 2)]


def test_guards_raise(spark):
    docs = spark.createDataFrame([(k, "same name", f"s{k}", "en") for k in range(9)], "doc_id long, text string, source string, lang string")
    with pytest.raises(Exception, match="too many"):
        recall.name_matches(docs, F.col("doc_id") == 0, F.col("text"), most=3).collect()
    with pytest.raises(contracts.ContractError):
        contracts.require_complete(docs.union(spark.createDataFrame([(99, "", "none", "en")], docs.schema)), docs, "source")


def test_fingerprint_neighbors_find_all(spark):
    rng = random.Random(3)
    base = rng.getrandbits(60)
    rows = [(0, base, 100, "en")]
    for k in range(1, 400):
        bits = rng.randrange(0, 22)
        rows.append((k, base ^ sum(1 << b for b in rng.sample(range(60), bits)), rng.choice((100, 60, 30)), rng.choice(("en", "fr"))))
    fps = spark.createDataFrame(rows, "doc_id long, fp long, n_tokens long, lang string")
    want = sorted((i, (f ^ base).bit_count()) for i, f, n, lang in rows if i and (f ^ base).bit_count() <= 15 and lang == "en" and n >= 45)
    assert pairs(fingerprints.neighbors(fps.filter("doc_id = 0"), fps), "doc_id", "distance") == want
    with pytest.raises(ValueError):
        fingerprints.neighbors(fps, fps, 16, 3)


def test_weighted_fingerprint_and_pool(spark):
    from hashlib import md5

    rows = [(d, f"t{k}", k % 5) for d in (1, 2) for k in range(40 + d)]
    out = fingerprints.weighted_fingerprints(spark.createDataFrame(rows, "doc_id long, token string, weight long")).collect()
    for r in out:
        mine = [(int(md5(t.encode()).hexdigest()[:15], 16), w) for d, t, w in rows if d == r.doc_id and w > 0]
        votes = [sum(w if h >> b & 1 else -w for h, w in mine) for b in range(60)]
        assert r.fp == sum(1 << b for b, v in enumerate(votes) if v > 0) and r.n_tokens == len(mine)
        assert list(r.weak_bits) == [min(range(k * 15, k * 15 + 15), key=lambda b: (abs(votes[b]), b)) for k in range(4)]
    fps = spark.createDataFrame([(0, 0, [0, 15, 30, 45]), (1, 1, [0, 15, 30, 45]), (2, sum(1 << (15 * k + 1) for k in range(4)), [0, 15, 30, 45]), (3, sum(1 << (15 * k) for k in range(4)), [0, 15, 30, 45])], "doc_id long, fp long, weak_bits array<int>")
    assert pairs(fingerprints.band_pool(fps.filter("doc_id = 0"), fps), "doc_id") == [(1,), (3,)]


def test_topk_filters_before_ranking(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8))
    rows = [(k, str(k % 3), v.tolist()) for k, v in enumerate(x)] + [(900, "0", None)]
    df = spark.createDataFrame(rows, "id long, grp string, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = pairs(vectors.topk(df.filter("id % 50 = 0"), df, 4, other_group=True), "q_id", "rank", "id")
    want = []
    for q in range(0, 300, 50):
        s = u @ u[q]
        want += [(q, r + 1, i) for r, i in enumerate(sorted((i for i in range(300) if i % 3 != q % 3), key=lambda i: (-s[i], i))[:4])]
    assert got == sorted(want)


def test_history(spark):
    rows = [(k, "a", 10.0) for k in range(9)] + [(9, "a", 60.0), (10, "a", None), (11, "b", 5000.0), (12, "b", None)]
    df = spark.createDataFrame(rows, "id long, grp string, size double")
    assert pairs(history.large_changes(df, "grp", floor=20), "grp", "n", "n_unknown", "threshold", "n_large") == [("a", 11, 1, 50.0, 1), ("b", 2, 1, 20.0, 1)]
    ts = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", 9.0), (2, "a", "2024-01-02 00:00:00", 9.0), (3, "a", "2024-01-03 00:00:01", 9.0), (4, "a", "2024-01-03 01:00:00", 1.0)], "id long, grp string, t string, size double").withColumn("ts", F.col("t").cast("timestamp"))
    assert pairs(history.close_pairs(ts, "grp", 24, 5), "id", "next_id", "gap_hours") == [(1, 2, 24.0)]
    stages = spark.createDataFrame([("a", 0, 0), ("a", 1, 4)], "grp string, stage int, start int")
    assert pairs(history.stage_ranges(stages, "grp", spark.createDataFrame([("a", 9)], "grp string, last int")), "start", "stop") == [(0, 3), (4, 9)]
    bad = spark.createDataFrame([("x", 0, 1), ("y", 0, 0), ("y", 1, 0)], "grp string, stage int, start int")
    assert pairs(contracts.range_violations(bad), "grp", "stage") == [("x", 0), ("y", 1)] and contracts.range_violations(stages).count() == 0


def test_rollups(spark):
    rows = spark.createDataFrame([(1, "m", "weak"), (1, "m", "confirmed"), (2, "m", "none")], "q_id long, module string, category string")
    spine = spark.createDataFrame([("m",), ("empty",)], "module string")
    out = {r.module: r for r in rollup.submodule_stats(rows, spine, ["confirmed", "weak", "none"]).collect()}
    assert (out["m"].total, out["m"].n_confirmed, out["m"].n_weak, out["m"].share_none) == (2, 1, 0, 50.0) and out["empty"].total == 0
    excl = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (3, "b")], "q_id long, reason string")
    assert pairs(rollup.exclusion_totals(excl, ["a", "b"], spark.createDataFrame([(3,)], "q_id long")), "reason", "functions") == [("a", 1), ("b", 1)]
    ev = rollup.evaluation(spark.createDataFrame([("T1", 1, True), ("T1", 1, False), ("N", 0, True)], "cls string, label int, hit boolean"))
    assert {r.cls: (r.recall, r.precision) for r in ev.collect()} == {"T1": (0.5, None), "all": (0.5, 0.5)}


def test_selection(spark):
    rows = spark.createDataFrame([(1, "x", 0.9, 5), (1, "x", 0.1, 6), (1, "y", 0.8, 7), (1, "z", 0.7, 8)], "q long, content string, score double, id long")
    assert pairs(selection.select_contents(rows, "q", "content", F.col("score"), "id"), "id", "state") == [(5, "selected"), (6, "selected"), (7, "selected"), (8, "deferred_secondary")]
    p = spark.createDataFrame([(1, 1, 0.9, 0.9, "review"), (1, 2, 0.5, 0.5, None), (1, 3, 0.5, 0.5, "confirmed")], "q_id long, c_id long, identity double, line_sim double, tier string")
    assert pairs(selection.suppress_dominated(p, ["q_id"]), "c_id", "dominated") == [(1, False), (2, True), (3, False)]
    v = selection.apply_verdicts(p.withColumn("content", F.lit("k")), spark.createDataFrame([(1, 1, "yes")], "q_id long, c_id long, verdict string"), spark.createDataFrame([("k", "no")], "content string, verdict string"))
    assert pairs(v, "c_id", "verdict") == [(1, "yes"), (2, "no"), (3, "no")]
    f = spark.createDataFrame([("a", "t1", "high", 0.5, "d"), ("a", "t1", "low", 0.9, "e"), ("a", "t2", "critical", 0.1, "f"), ("b", "t3", "low", 0.2, "g")], "source string, title string, severity string, confidence double, detail string")
    assert [(r.source, r.title, r.n) for r in selection.merge_findings(f, 3).collect()] == [("a", "t2", 1), ("b", "t3", 1), ("a", "t1", 2)]


def test_search_and_graph(spark):
    docs = spark.createDataFrame([(1, "The cat\nand THE dog the"), (2, None)], "doc_id long, text string")
    assert pairs(search.search_all(search.postings(docs), ["the", "dog"]), "doc_id", "line") == [(1, 2)]
    assert pairs(search.evidence(docs, {"dog": "dog", "none": "zebra"}), "category", "n", "first_line") == [("dog", 1, 2)]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "caller string, callee string")
    assert pairs(search.reachable(edges, spark.createDataFrame([("a",)], "node string"), 3), "node", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    log = spark.createDataFrame([("l", 1, "start"), ("l", 2, "x"), ("l", 3, "start"), ("l", 4, "y"), ("m", 1, "z")], "log string, n int, text string")
    assert pairs(search.latest_run(log, F.col("text") == "start"), "log", "n") == [("l", 3), ("l", 4), ("m", 1)]


def test_signature_ignores_order_only(spark):
    df = spark.range(100).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string")))
    a = contracts.signature(df, ["id", "t"]).first()
    assert a == contracts.signature(df.orderBy(F.desc("id")).repartition(5), ["id", "t"]).first()
    assert a != contracts.signature(df.filter("id > 0"), ["id", "t"]).first()
    with pytest.raises(contracts.ContractError):
        contracts.require_same_generation(df, df.limit(3), ["id"])
