"""Code functions and review operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from kinfolk.functions import code as C
from kinfolk.operators import review


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda column: one.select(column.alias("x")).first()[0]


def test_stubs_and_isa(value):
    cases = {"fn a() -> i32 { -38 }": True, "int a(void) { return ENOSYS; }": True, "fn a() { /* x */ }": True, "fn a() { b(); }": False, "no body": False, "fn a() { return x; }": False}
    assert {k: value(C.is_stub(F.lit(k))) for k in cases} == cases
    assert value(C.isa(F.lit("arch/riscv/a.S"), F.lit(""))) == "riscv" and value(C.isa(F.lit("a.S"), F.lit("csrr t0, x\nsret"))) == "riscv"
    assert value(C.isa(F.lit("arch/x86/a.S"), F.lit("csrr a\nsret"))) is None and value(C.isa(F.lit("riscv/x86_64"), F.lit(None).cast("string"))) is None


def test_assembly(value):
    text = F.lit('a:  # label\n  li t0, 0x1F // c\n.global x\n li a0,10\n li a1, 11\n .ascii "long string"\n\n')
    assert value(C.normalize_assembly(text)) == "a:\nli t0, INT_HEX\n.global x\nli a0,INT_S\nli a1, INT_M\n.ascii STR"
    assert value(C.assembly_features(text)) == ["op:li"]
    moves = F.lit("sd a, b\nld a, b\nsd c, d\nadd x, y")
    assert not value(C.boilerplate_assembly(moves, F.lit("other"))) and value(C.boilerplate_assembly(moves, F.lit("__switch_to")))


def test_ranges_and_windows(value):
    chunks = C.line_chunks(F.lit(23))
    assert [tuple(r) for r in value(chunks)] == [(1, 10), (11, 20), (21, 23)] and value(C.line_chunks(F.lit(0))) == []
    assert [tuple(r) for r in value(C.merge_short(chunks))] == [(1, 10), (11, 23)] and value(C.merge_short(C.line_chunks(F.lit(0)))) == []
    for n in (1, 4, 5, 9, 10, 11):
        ids, want, start = list(range(n)), [], 0
        while True:
            want.append(ids[start : start + 4])
            if start + 4 >= n:
                break
            start += 3
        assert value(C.token_windows(F.sequence(F.lit(0), F.lit(n - 1)), 4, 3)) == want


def test_anchors_and_status(value):
    holds = lambda a: value(C.holds_anchor(F.lit("x = deallocate_page(\n  p)\n  .run();"), F.lit(a)))
    assert holds("deallocate_page") and not holds("allocate") and holds("deallocate_page( p)") and holds("deallocate_page(p).run()") and not holds("free(p)")
    assert [value(C.last_status(F.lit(x))) for x in ("error\nfinished", "finished\nerror", "", "error", "success")] == ["passed", "failed", "unknown", "failed", "passed"]


def test_relation(value):
    rel = lambda e, i, s: value(review.identity_relation(F.lit(e), F.lit(i), F.lit(s)))
    assert [rel(True, 0.62, 0.0), rel(True, 0.1, 0.7), rel(True, 0.1, 0.1), rel(False, 0.72, 0.0), rel(False, 0.1, 0.7), rel(False, 0.7, 0.1)] == ["exact_counterpart", "same_name_code_clone", "same_name_only", "compatible_renamed", "code_clone_renamed", "family_neighbor"]


def test_admission_queue_and_outcome(spark):
    names = "q_id long, c_id long, content string, tier string, relation string, excluded boolean, q_lines int, c_lines int, matched int, line_sim double, segment_cover double, identity double, literals int, fingerprint boolean"
    row = lambda c, content, line, **k: tuple({"q": 1, "c": c, "content": content, "tier": "review", "relation": "exact_counterpart", "ex": False, "ql": 20, "cl": 30, "m": 12, "line": line, "seg": 0.0, "ident": 0.5, "lit": 0, "fp": False, **k}.values())
    df = spark.createDataFrame([row(1, "a", 0.8), row(2, "b", 0.79), row(3, "c", 0.2), row(4, "d", 0.8, ex=True), row(5, "e", 0.5, seg=0.6), row(6, "f", 0.8, ql=5)], names)
    adm = review.admission(df)
    got = {r.c_id: r.basis for r in adm.collect()}
    assert got == {1: "strong_bilateral_line_similarity", 2: "strong_bilateral_line_similarity", 3: None, 4: None, 5: "multi_signal_code_similarity", 6: None}
    queue = review.review_queue(adm)
    assert {r.c_id: r.state for r in queue.collect()} == {1: "selected", 2: "deferred_secondary", 5: "deferred_secondary"}
    out = review.finalize_deferred(queue, spark.createDataFrame([(1, 1, "confirmed")], "q_id long, c_id long, verdict string"))
    assert {r.c_id: r.outcome for r in out.collect()} == {1: "confirmed", 2: "supplemental_source", 5: "supplemental_source"}


def test_repository_facts(spark):
    files = spark.createDataFrame([("r", "a.rs", "rust", "alloc page frame\n\n x"), ("r", "b.c", "c", "task SCHED\ncontext switch page"), ("s", "c.c", "c", None)], "repo string, path string, lang string, text string")
    words = spark.createDataFrame([("mm", "page"), ("mm", "frame"), ("sched", "task"), ("sched", "sched"), ("sched", "context")], "subsystem string, keyword string")
    assert sorted((r.path, r.subsystem, r.hits, r.is_primary) for r in review.subsystems(files, words).collect()) == [("a.rs", "mm", 2, True), ("b.c", "sched", 3, True)]
    assert {(r.repo, r.lang): (r["loc"], r["rank"]) for r in review.languages(files).collect()} == {("r", "c"): (2, 1), ("r", "rust"): (2, 2), ("s", "c"): (0, 1)}
    assert {r.repo: r.kind for r in review.kernel_type(files.fillna("", ["text"]), ["page", "task"], ["context", "switch"]).collect()} == {"r": "microkernel", "s": "monolithic"}
    tie = review.disambiguate(spark.createDataFrame([("k", 1, 2.0), ("k", 2, 2.0), ("j", 3, 1.0), ("j", 4, 0.5)], "key string, id int, score double"), "key", "score")
    assert sorted((r.id, r.tied) for r in tie.collect()) == [(1, True), (2, True), (3, False)]
    top = review.top_candidates(spark.createDataFrame([(1, k, float(k % 3)) for k in range(7)], "q_id long, c_id long, score double"), "score", 3).first()
    assert [c.c_id for c in top.candidates] == [2, 5, 1]
