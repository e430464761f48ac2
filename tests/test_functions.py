"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from kinfolk.functions import paths, scores
from kinfolk.functions import text as X


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)

    def run(column):
        return one.select(column.alias("x")).first()[0]

    return run


def test_words_and_lines(value):
    assert value(X.words(F.lit(" a\tb\n\x0bc "))) == ["a", "b", "c"] and value(X.words(F.lit(None).cast("string"))) == [] and value(X.words(F.lit(" \n"))) == []
    assert value(X.line_array(F.lit("a  b\n\n c \r\n"))) == ["a b", "c"]
    assert value(X.norm_hash(F.lit("x // c\n\n  y"))) == value(X.norm_hash(F.lit("x\ny # other")))
    assert value(X.source_hash(F.lit("a b c"))) is None and value(X.source_hash(F.lit("a " * 12))) == value(X.source_hash(F.lit("a\n" * 12)))


def test_shingles(value):
    tokens = F.split(F.lit(" ".join(map(str, range(12)))), " ")
    assert value(F.size(X.shingles(tokens))) == 9 and value(X.shingles(tokens)[0]) == "0\x1f1\x1f2\x1f3"
    assert value(F.size(X.shingles(F.slice(tokens, 1, 11)))) == 0 and value(F.size(X.shingles(F.slice(tokens, 1, 0)))) == 0


def test_names_and_overlap(value):
    assert value(X.name_tokens(F.lit("readFile_into-HTTPBuf2x"))) == ["read", "file", "into", "httpbuf2x"]
    a, b, none = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), F.array().cast("array<string>")
    assert value(X.jaccard(a, b)) == pytest.approx(1 / 3) and value(X.jaccard(none, none)) == 0.5 and value(X.jaccard(a, none)) == 0


def test_masks_and_numbers(value):
    assert value(X.mask_line(F.lit('if (n0 == 10) call("x");'), ("if",))) == "if ( ID = = NUM ) ID ( STR ) ;"
    assert [value(X.number_class(F.lit(x))) for x in ("0", "10", "11", "0xFF", "1.5", "0b1")] == ["INT_S", "INT_S", "INT_M", "INT_HEX", "INT_M", "INT_M"]


@pytest.mark.parametrize("url", ["https://user:pw@Host.org:443/A/b.git?x=1#y", "git://host.org/a/b/", "host.org/a/b.git"])
def test_url_identity(value, url):
    assert value(X.url_identity(F.lit(url))) == "host.org/a/b"


def test_storage_key_and_html(value):
    key = value(X.storage_key(F.lit("host.org/a/b")))
    assert key.startswith("host-org-a-b-") and len(key) == len("host-org-a-b-") + 24
    assert value(X.visible_text(F.lit("<p>a &amp; b<script>x</script><!-- n --> <b>c</b>"))) == "a & b c"
    assert value(X.naming_style(F.lit("fn do_it() void run_x (int go("))) == "snake_case" and value(X.naming_style(F.lit("TaskList PageTable Map"))) == "CamelCase"
    assert value(X.naming_style(F.lit("fn a_b( Task"))) == "mixed" and value(X.naming_style(F.lit(""))) == "mixed"


def test_paths(value):
    cases = {"src/latest/contest.rs": False, "src/tests/a.rs": True, "a/my-test.c": True, "a/test_x.c": True, "Bench/a.c": True}
    cases |= {"a/testing/x.rs": True, "libc-test/x.c": True, "a\\benches\\b.c": True, "x/foo.test.rs": True, "x.test": False, "testament/benchpress.c": False, "": False, "a/./../tests.d/x": True}
    assert {p: value(paths.is_test_path(F.lit(p))) for p in cases} == cases
    folders = {"riscv64-linux-musl-cross/x.h": True, "chcore-busybox/x.c": True, "UnixBench/x.c": True, "a/deps/x.c": True, "os/src/fs.c": False, "my_ltp-full2/x": True, "a/integration-tests/x.c": True, "busybox": False}
    assert {p: value(paths.is_excluded(F.lit(p))) for p in folders} == folders
    assert [value(paths.root_key(F.lit(x))) for x in ("rCore-v3", "rcore_V3", "ｒＣore　V3", "os_kernel_lab", "")] == ["rcorev3", "rcorev3", "rcorev3", "oskernellab", ""]
    assert value(paths.is_excluded(F.lit("a/Target/x.rs"))) and not value(paths.is_excluded(F.lit("a/target")))
    assert [value(paths.language(F.lit(p))) for p in ("a.rs", "b/c.h", "d.S", "e.py", "f")] == ["rust", "c", "asm", None, None]
    assert value(paths.is_baseline(F.lit("0\\baseline_x"))) and not value(paths.is_baseline(F.lit("baseline_x/y")))
    assert value(paths.repo_year(F.lit("2024/team"))) == 2024 and value(paths.repo_year(F.lit("team"))) is None
    assert value(paths.has_segments(F.lit("a/os/src/b"), F.lit("os/src"))) and not value(paths.has_segments(F.lit("a/xos/src"), F.lit("os/src")))


def test_tiers(value):
    line = {0.96: "confirmed", 0.95: "review", 0.7: "review", 0.69: "weak", 0.5: "weak", 0.49: None}
    assert {x: value(scores.tier(F.lit(x))) for x in line} == line
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("string")
    assert value(scores.rescued_tier(none, yes, yes, yes)) == "review" and value(scores.rescued_tier(none, no, no, yes)) == "weak" and value(scores.rescued_tier(none, no, no, no)) is None
    assert value(scores.vector_gate(F.lit(None).cast("double"), yes)) and not value(scores.vector_gate(F.lit(0.7), no))


def test_scores(value):
    assert value(scores.identity_score(F.lit(True), F.lit(0.0), F.lit(1), F.lit(1.0), F.lit(0.0))) == pytest.approx(0.8)
    assert value(scores.identity_score(F.lit(False), F.lit(0.5), F.lit(None).cast("int"), F.lit(0.0), F.lit(0.0))) == pytest.approx(0.325)
    assert value(scores.hamming(F.lit(0x123456789ABCDEF0), F.lit(0x123456789ABCDEF0 ^ 0x7FFF))) == 15
    assert value(scores.segment_rescore(F.lit(0.5), F.lit(0.9), F.lit(0.5), F.lit(1.0))) == pytest.approx(0.65)
    assert [value(scores.retier(F.lit(a), F.lit(b), F.lit(c), F.lit(d))) for a, b, c, d in (("weak", 0.76, 0.0, 0.0), ("review", 0.1, 0.2, 0.1), ("review", 0.1, 0.3, 0.1))] == ["review", "dismissed", "review"]
    kind = lambda e, r, *k: value(scores.clone_kind(F.lit(e), F.lit(r), *k))
    assert [kind(100, 15), kind(1, 0), kind(1, 1), kind(0, 0)] == ["near_dup", "exact", "similar", "similar"]
    assert kind(0, 0, F.array(F.lit("exact"))) == "exact" and kind(0, 0, F.array(F.lit("exact"), F.lit("renamed"))) == "near_dup"
    assert value(scores.incremental(F.lit(0.7), F.lit(9), F.lit(0.6), F.lit(6))) and not value(scores.incremental(F.lit(0.69), F.lit(9), F.lit(0.6), F.lit(6)))
    assert value(scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx(0.6)
    assert value(scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(3.0)))) == 0
    assert value(scores.cluster_priority(F.lit(1.0), F.lit(1.0), F.lit(600), F.lit(40))) == pytest.approx(82)
