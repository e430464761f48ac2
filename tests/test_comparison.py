"""Comparison with a reference, comments, symbols, priorities, manifests, and exported tags and logs."""

import difflib
import json
import re

import pytest
from pyspark.sql import functions as F

from kinfolk.functions import code as C
from kinfolk.functions import text as X
from kinfolk.operators import comparison, verdicts
from kinfolk.sources import repositories, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def brute(a, b):
    if not a or not b:
        return 0.0
    x, y = set(a.split(" ")), set(b.split(" "))
    calls = [re.findall(r"\b(\w+)\s*\(", t) for t in (a, b)]
    return 0.4 * difflib.SequenceMatcher(None, a[:8000], b[:8000]).ratio() + 0.3 * len(x & y) / len(x | y) + 0.3 * difflib.SequenceMatcher(None, *calls).ratio()


def test_normal_code(spark):
    code = 'int a = 12; // gone\n/* and\nthis */ f("x \\" y", \'c\', 0, 1, 100, x10);'
    assert one(spark, C.normal_code(F.lit(code))) == "int a = NUM; f(\"STR\", 'STR', 0, 1, NUM, x10);"
    assert one(spark, C.normal_code(F.lit("  // all\n"))) == "" and one(spark, C.normal_code(F.lit(None).cast("string"))) is None
    assert len(one(spark, C.normal_code(F.lit('"' + "ab" * 50_000 + '"')))) == 5


def test_reference_comparison(spark):
    same = "int f(int a) { g(a); h(a); return 10; }"
    current = [("same", "a.c", same), ("same", "b.c", "x"), ("other", "a.c", "void z() { q(); }"), ("near", "a.c", same), ("empty", "a.c", "// nothing"), ("null", "a.c", None), ("mine", "a.c", "y"), ("main", "a.c", "y"), (None, "a.c", "y")]
    reference = [("same", same.replace("10", "99")), ("other", same), ("near", same.replace("h(a);", "k(a, a);")), ("empty", same), ("null", same), ("theirs", "x"), (None, "x")]
    out = comparison.reference_comparison(spark.createDataFrame(current, "name string, file string, code string"), spark.createDataFrame(reference, "name string, code string"))
    got = {r.name: (r.state, r.similarity, r.file) for r in out.collect()}
    near = brute("int f(int a) { g(a); h(a); return NUM; }", "int f(int a) { g(a); k(a, a); return NUM; }")
    other = brute("void z() { q(); }", "int f(int a) { g(a); h(a); return NUM; }")
    assert 0.5 < near <= 0.9 and other <= 0.5
    assert got["same"] == ("identical", 1.0, "a.c") and got["near"] == ("modified", pytest.approx(near), "a.c") and got["other"] == ("reimplemented", pytest.approx(other), "a.c")
    assert got["empty"] == got["null"] == ("reimplemented", 0.0, "a.c") and got["mine"] == ("new", None, "a.c") and got["theirs"] == ("reference_only", None, None)
    assert set(got) == {"same", "near", "other", "empty", "null", "mine", "theirs"}
    assert comparison.reference_comparison(out.select("name", "file", F.lit("").alias("code")).limit(0), spark.createDataFrame([], "name string, code string")).count() == 0


def test_name_states(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), ("main",), (None,)], "name string")
    b = spark.createDataFrame([("y",), ("z",), (None,)], "name string")
    assert sorted(map(tuple, comparison.name_states(a, b, comparison.TRIVIAL).collect())) == [("x", "new"), ("y", "both"), ("z", "reference_only")]


def test_strategies(spark):
    functions = spark.createDataFrame([("sys_Read", "b"), ("sys_read", "a"), ("syscall_open", "a"), ("do_fork", "a"), ("do_loop", "a"), ("read", "a"), ("sys_", "a"), (None, "a")], "name string, file string")
    named = comparison.syscall_names(functions, spark.createDataFrame([("do_fork",), ("do_fork",)], "name string"))
    table = spark.createDataFrame([("read", "constant", "SYS_READ", "z"), ("close", "constant", "SYS_CLOSE", "z"), ("close", "unheard", "A", "a")], "name string, strategy string, source string, file string")
    out = comparison.first_strategy(named.unionByName(table), "name", ["function_name", "dispatch_table", "constant"], "source", "file")
    assert sorted(map(tuple, out.collect())) == [("close", "constant", "SYS_CLOSE", "z"), ("fork", "function_name", "do_fork", "a"), ("open", "function_name", "syscall_open", "a"), ("read", "function_name", "sys_Read", "b")]


def test_top_within_and_complexity(spark):
    rows = spark.createDataFrame([("c", "b", 5), ("c", "a", 5), ("c", "d", 9), ("e", "a", None)], "sha string, path string, loc int")
    assert sorted(map(tuple, comparison.top_within(rows, "sha", [F.desc("loc"), F.col("path")], 2).select("sha", "path", "rank").collect())) == [("c", "a", 2), ("c", "d", 1), ("e", "a", 1)]
    code = 'fn f() {\n\n if a && b { } // if\n while c { "for" } match x { 1 => y, _ => z }\n}'
    functions = spark.createDataFrame([("m", code), ("m", "fn g() {}"), ("m", None), ("n", None)], "module string, code string")
    got = {r.module: r[1:] for r in comparison.complexity_summary(functions, "module").collect()}
    assert got["m"][:4] == (2, 1, 6, 3.5) and got["m"][4] == 5 and got["n"] == (0, 1, None, None, 0, 0)


def test_comments(spark):
    a = '''// TODO: walks the page table of a task
/* Copyright of nobody in particular */
/**
 * The allocator keeps free blocks
 * in lists by their size.
 */
let s = "// this is not a comment at all"; // short
/// NOTE: License texts of twenty and more letters'''
    b = "/* The allocator keeps free blocks in   lists by their size. */\n//TODO: walks the page table of a task\n//! a comment of the second text only"
    assert one(spark, C.comments(F.lit(a))) == ["TODO: walks the page table of a task", "The allocator keeps free blocks in lists by their size."]
    assert one(spark, C.comment_overlap(F.lit(a), F.lit(b))) == ["The allocator keeps free blocks in lists by their size.", "TODO: walks the page table of a task"]
    assert one(spark, C.comments(F.lit(None).cast("string"))) == []


def test_symbol_levels(spark):
    rows = [
        ("c", "open", "function", None, None, "map"), ("c", "open", "function", None, "fileScope", "index"), ("c", "_open", "function", None, None, "index"), ("c", "__open", "function", None, None, "map"),
        ("c", "MAX_1", "macro", None, None, "map"), ("c", "Max", "macro", None, None, "index"), ("c", "AB", "macro", None, None, "index"), ("c", "x", "variable", None, None, "index"), ("c", "main", "function", None, None, "discard"),
        ("rust", "run", "method", "impl", None, "map"), ("rust", "walk", "method", "implementation", None, "index"), ("rust", "_x", "function", None, None, "index"), ("rust", "sys_x", "function", "module", None, "map"),
        ("rust", "T", "trait", None, None, "map"), ("rust", "__x__", "struct", None, None, "discard"), ("go", "x", "function", None, None, "index"), (None, None, None, None, None, "index"),
    ]
    df = spark.createDataFrame(rows, "lang string, name string, kind string, scope string, extras string, want string")
    got = df.select("*", C.symbol_level(*(F.col(c) for c in ("lang", "name", "kind", "scope", "extras"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_terms_and_objects(spark):
    assert sorted(one(spark, X.identifier_terms(F.lit("readPage(page_table, X1)")))) == ["page", "page_table", "read", "read_page", "table", "x1"]
    assert one(spark, X.identifier_terms(F.lit(None).cast("string"))) == []
    texts = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{} {}",), ("",), (None,), ("{}",), ("{}], [{}",), ("{}, {}",), ('{}, "y": {}',)], "t string")
    assert [r.ok for r in texts.select(X.json_object(F.col("t")).isNotNull().alias("ok")).collect()] == [True, False, False, False, False, True, False, False, False]


def test_reportable_and_priority(spark):
    fields = "id int, tier string, line_sim double, fingerprint boolean, literals int, has_segments boolean, partial boolean, matched int, q int, c int"
    rows = [(1, "confirmed", None, None, None, None, None, 5, 14, 90), (2, "weak", 0.5, False, 0, False, False, 5, 15, 15), (3, "weak", 0.4, False, 0, False, False, 4, 4, 4), (4, None, None, None, 1, None, None, None, 0, 0)]
    df = spark.createDataFrame(rows, fields)
    assert [r.x for r in df.select(verdicts.reportable(F.lit(None).cast("boolean")).alias("x")).collect()] == [True, True, False, True]
    assert [r.x for r in df.select(verdicts.partial_match(F.col("matched"), F.col("q"), F.col("c")).alias("x")).collect()] == [True, False, False, False]
    found = spark.createDataFrame([(1, "low", "race", 0.9), (2, "high", "slow", 0.1), (3, "high", "race", 0.2), (4, "high", "race", 0.3), (5, "odd", "race", 1.0), (6, "high", "fixed", 0.1)], "id int, severity string, text string, confidence double")
    out = verdicts.by_priority(found, ["high", "low"], [(F.col("text") == "fixed", 0), (F.col("text") == "race", 2), (F.col("severity") == "high", 3)], 9)
    assert [r.id for r in out.collect()] == [6, 4, 3, 2, 1, 5]


def test_manifest_tags_and_tails(spark, tmp_path):
    at = str(tmp_path / "manifest")
    sinks.write_manifest(spark.createDataFrame([(3, 1)], "wanted int, missing int"), at)
    sinks.write_manifest(spark.createDataFrame([(4, 0)], "wanted int, missing int"), at)
    assert [tuple(r) for r in spark.read.json(at).select("wanted", "missing").collect()] == [(4, 0)]
    with pytest.raises(ValueError):
        sinks.write_manifest(spark.range(2), at)
    tags = tmp_path / "tags.json"
    tags.write_text("\n".join([json.dumps({"_type": "ptag", "name": "x"}), json.dumps({"_type": "tag", "name": "f", "path": "a.c", "line": 3, "kind": "function"}), "{broken"]))
    assert [(r.name, r.path, r.line, r.kind) for r in repositories.symbol_tags(spark, str(tags)).collect()] == [("f", "a.c", 3, "function")]
    (tmp_path / "run.log").write_text("first\nlast")
    assert [r.tail for r in repositories.log_tails(spark, str(tmp_path / "run.log"), 4).collect()] == ["last"]
