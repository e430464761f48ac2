"""Makefiles, HTML tables and libraries by path."""

import pytest
from pyspark.sql import functions as F

from kinfolk.operators import libraries, makefiles
from kinfolk.sources import html_tables


def outputs(spark, repos):
    files = spark.createDataFrame([(r, p, t) for r, of in repos.items() for p, t in of.items()], "repo string, path string, text string")
    return {(r.repo, r.output): (r.via, r.path, r.line) for r in makefiles.declared_outputs(files).collect()}


def test_logical_lines():
    assert makefiles.logical_lines("a \\\n b\\\n\nc") == [(1, "a   b "), (4, "c")]
    assert makefiles.logical_lines("x\\") == [(1, "x")] and makefiles.logical_lines("") == []


def test_statements():
    text = "A := 1 # one\nB?=2\nC+= $(A)\n==\nall: x\n\techo # no\n\n\tcp a b\nD = e\n\tstray: y\ninclude  a.mk b.mk\nt:: u\nv := w:\nx ::= y\n-include\tz.mk\ninclude"
    assert makefiles.statements(text) == [
        (1, "set", "A", "1"), (2, "set", "B", "2"), (3, "set", "C", "$(A)"), (5, "rule", "", "all"), (6, "recipe", "", "echo"), (8, "recipe", "", "cp a b"),
        (9, "set", "D", "e"), (10, "rule", "", "stray"), (11, "include", "", "a.mk b.mk"), (12, "rule", "", "t"), (13, "set", "v", "w:"), (14, "rule", "", "x"), (15, "include", "", "z.mk"),
    ]


def test_expansion_and_includes():
    assert makefiles.expanded("$(A)/${B}/$(C)/$(shell x)", {"A": "${B}", "B": "b"}) == "b/b/$(C)/$(shell x)"
    loop = makefiles.expanded("$(A)", {"A": "$(B)", "B": "$(A)x"})
    assert loop.count("x") == 3  # six rounds, then it stays
    for token, want in (("a.mk", "m/a.mk"), ("../a.mk", "a.mk"), ("../../a.mk", None), ("/etc/x", None), ("*.mk", None), ("$(X).mk", None), ("'q.mk'", "m/q.mk"), ("", None)):
        assert makefiles.included_path("m/x.mk", token) == want


def test_commands_that_make_an_output():
    for recipe, want in (("cp a kernel-rv", True), ("@cp $(X) out/kernel-rv.bin", True), ("cp a kernel-rvx", False), ("echo kernel-rv", False), ("kernel-rv cp", False), ("scp a kernel-rv", False), ("install -m 1 a kernel-rv", True), ("cp " + "a" * 90 + " kernel-rv", False)):
        assert makefiles.makes(recipe, "kernel-rv") is want, recipe


def test_required_outputs_of_repositories(spark):
    long_chain = {"Makefile": "include 0.mk\n"} | {f"{k}.mk": f"include {k + 1}.mk\n" for k in range(20)} | {"20.mk": "kernel-rv:\n"}
    repos = {
        "direct": {"Makefile": ".PHONY: all kernel-rv kernel-la\nall: kernel-rv kernel-la\nkernel-la:\n\tcargo build\n\tcp target/x kernel-la\nkernel-rv:\n\tcargo build\n"},
        "variables": {"Makefile": "KERNEL_RV := kernel-rv\nKERNEL_LA := kernel-la\nall: $(KERNEL_RV)\n$(KERNEL_RV):\n\t@echo rv\n$(KERNEL_LA):\n\t@echo la\n"},
        "included": {"Makefile": "include mk/targets.mk\nall: kernel-rv kernel-la\n", "mk/targets.mk": "kernel-rv:\n\t@echo\nkernel-la:\n"},
        "recipes": {"Makefile": "KERNEL_RV := kernel-rv\nall: env\n\t$(MAKE) b\nb:\n\t@cp arceos/*_qemu-virt.bin $(KERNEL_RV)\n"},
        "phony": {"Makefile": ".PHONY: kernel-rv kernel-la\nall: kernel-rv kernel-la\n"},
        "cycle": {"Makefile": "include a.mk\n", "a.mk": "include b.mk Makefile a.mk\n", "b.mk": "include a.mk ../out.mk /abs.mk gone.mk\nx:\n\tmv a kernel-la\n", "c.mk": "kernel-la:\n"},
        "order": {"Makefile": "include b.mk a.mk\nx:\n\tcp a kernel-rv\n", "a.mk": "N = kernel-la\ninclude c.mk\nkernel-rv:\n", "b.mk": "include c.mk\nkernel-rv kernel-la&:\n", "c.mk": "$(N):\n"},
        "late": {"Makefile": "include a.mk b.mk\n", "a.mk": "$(N):\n", "b.mk": "N = kernel-la\n"},
        "gnu": {"GNUmakefile": "kernel-la:\n", "Makefile": "kernel-rv:\n"},
        "none": {"src/Makefile": "kernel-rv:\n", "Makefile": None},
        "chain": long_chain,
    }
    assert outputs(spark, repos) == {
        ("direct", "kernel-rv"): ("target", "Makefile", 6), ("direct", "kernel-la"): ("target", "Makefile", 3),
        ("variables", "kernel-rv"): ("target", "Makefile", 4), ("variables", "kernel-la"): ("target", "Makefile", 6),
        ("included", "kernel-rv"): ("target", "mk/targets.mk", 1), ("included", "kernel-la"): ("target", "mk/targets.mk", 3),
        ("recipes", "kernel-rv"): ("recipe", "Makefile", 5),
        ("cycle", "kernel-la"): ("recipe", "b.mk", 3),
        ("order", "kernel-rv"): ("target", "b.mk", 2), ("order", "kernel-la"): ("target", "b.mk", 2),
        ("gnu", "kernel-la"): ("target", "GNUmakefile", 1),
        ("chain", "kernel-rv"): ("target", "20.mk", 1),
    }


def test_too_deep_includes_raise_and_aggregates(spark, monkeypatch):
    files = spark.createDataFrame([("r", "Makefile", "all submit&: x\ninclude 0.mk\n")] + [("r", f"{k}.mk", f"include {k + 1}.mk\n") for k in range(6)], "repo string, path string, text string")
    visited, read = makefiles.reading_order(files, makefiles.entry_files(files))
    assert visited.count() == 7 and makefiles.aggregate_targets(read).first().targets == ["all", "submit"]
    monkeypatch.setattr(makefiles, "MOST_LEVELS", 3)
    with pytest.raises(RuntimeError):
        makefiles.declared_outputs(files)


def texts(page, spans=True):
    return [[[c.text() for c in line] for line in (html_tables.grid(t) if spans else t.rows)] for t in html_tables.page_tables(page)]


def test_grids():
    page = "<table><tr><th>a</th><th colspan=2>b</th></tr><tr><td rowspan='3'>1</td><td>2<td>3</tr><tr><td>4</td><td rowspan=2>5</td></tr><tr><td>6</td></tr><tr><td>7</td></tr></table>"
    assert texts(page) == [[["a", "b", "b"], ["1", "2", "3"], ["1", "4", "5"], ["1", "6", "5"], ["7"]]]
    assert texts(page, spans=False) == [[["a", "b"], ["1", "2", "3"], ["4", "5"], ["6"], ["7"]]]
    assert texts("<table><tr><td rowspan=2>x</td></tr><tr></tr><tr><td>y</td></tr></table>") == [[["x"], ["x", "y"]]]


def test_nested_broken_and_odd_tables():
    page = "<TABLE><tr><td>out <table><tr><td>in</td></tr></table>side</td></tr></TABLE><table></table><table><tr></tr></table>"
    assert texts(page) == [[["in"]], [["out side"]]]
    assert texts("<table><tr><td>a<br>b&nbsp;&amp;&#65; <!-- <td>no --><script>'<td>'</script></td>") == [[["a b &A"]]]
    assert texts("<td>lost</td><tr>x") == [] and texts("") == [] and texts("a < b <table") == []
    cell = html_tables.page_tables("<table><tr><td><a href='/x'>y</a><a href=\"https://h/p.git/\">z</a> http://other</td></tr></table>")[0].rows[0][0]
    assert cell.url() == "https://h/p" and html_tables.Cell(parts=["see http://a.b/c) now"]).url() == "http://a.b/c" and html_tables.Cell(parts=["none"]).url() is None


def test_best_table(spark):
    head = "<table><tr><th>school</th><th>{}</th><th>school</th></tr><tr><td>first</td><td>{}</td><td>last</td></tr></table>"
    pages = [(1, head.format("x", "y") + head.format("repo", "https://g/r") + head.format("repo", "https://g/s")), (2, "<table><tr><td>school</td></tr></table>"), (3, None), (4, head.format("x", "y").replace("school", "other")), (5, head.format("repo", "http://q"))]
    rows = html_tables.table_rows(spark.createDataFrame(pages, "page int, html string"), "page")
    best = html_tables.best_table(rows, "page", {"school": 3, "repo": 5}).withColumn("school", html_tables.cell("school")).withColumn("url", html_tables.cell("repo", "url")).withColumn("none", html_tables.cell("gone"))
    assert {r.page: (r.table_no, r.score, r.school, r.url, r.none) for r in best.collect()} == {1: (1, 10, "last", "https://g/r", None), 5: (0, 10, "last", "http://q", None)}
    assert html_tables.table_rows(spark.createDataFrame([], "page int, html string"), "page").count() == 0


REGISTRY = [("lwext4", "lwext4", False), ("lwext4_rust", "lwext4", False), ("smoltcp", "smoltcp", False), ("fatfs", "fatfs", True), ("riscv", "riscv", True)]


def test_libraries_by_path(spark):
    cases = {
        "crates\\lwext4_rust\\c\\ext4.c": ("lwext4", "segment"),
        "vendor/Foo/src/x.rs": ("foo", "vendor"),
        "os/third_party/vendor/bar/x.c": ("vendor", "vendor"),
        "vendor": (None, None),
        "x/vendor": (None, None),
        "src/arch/riscv/trap.rs": (None, None),  # an architecture, not the library
        "crates/riscv/src/lib.rs": ("riscv", "segment"),
        "riscv/src/lib.rs": ("riscv", "segment"),
        "riscv/lib.rs": (None, None),
        "os/src/fatfs/mod.rs": (None, None),
        "deps/a/fatfs/mod.rs": ("fatfs", "segment"),
        "os/smoltcp_like/x.rs": (None, None),
        "src/arch/riscv/smoltcp/x.rs": ("smoltcp", "segment"),
        "./net//smoltcp/x.rs": ("smoltcp", "segment"),
        "": (None, None),
        None: (None, None),
    }
    registry = spark.createDataFrame(REGISTRY, "segment string, library string, needs_context boolean")
    files = spark.createDataFrame([("r", p, 1) for p in cases], "repo string, path string, library_x int")
    out = libraries.library_of(files, registry)
    assert out.count() == len(cases)
    for r in out.collect():
        assert (r.library, r.basis) == cases[r.path], r.path
    totals = libraries.library_totals(out).collect()
    assert {r.library: (r.n_files, r.n_repos) for r in totals}["smoltcp"] == (2, 1)


def test_roots_by_manifests_and_imports(spark):
    files = [
        ("a", "kernel/net/Cargo.toml", '[package]\nname = "smoltcp"\n'),
        ("a", "kernel/net/src/x.rs", "fn x() {}"),
        ("a", "fs/lw/Cargo.toml", '[package]\nname = "lwext4-rust"'),
        ("a", "fs/ext4_lw/mod.rs", "// adapter\n  pub use lwext4_rust::bindings;\n"),
        ("a", "fs/ext4_lw/deep/other.rs", "fn y() {}"),
        ("a", "Cargo.toml", '[package]\nname = "fatfs"'),  # the root itself is no folder of a library
        ("b", "fs/ext4_lw/mod.rs", "use lwext4_rust::x;"),  # no package in this repository
        ("c", "x/package.json", '{"name": "Smoltcp"}'),
        ("c", "y/package.json", "{broken"),
        ("c", "target/z/package.json", '{"name": "smoltcp"}'),
        ("c", "q/pyproject.toml", '[tool.poetry]\nname = "riscv"'),
        ("d", "p/Cargo.toml", '[package]\nname = "lwext4"'),
        ("d", "fs/ext4_lw/mod.rs", "// use lwext4_rust\nlet lwext4_rust = 1;\n#include \"lwext4_rust.h\"\n"),
        ("e", "p/Cargo.toml", '[package]\nname = "lwext4"'),
        ("e", "fs/ext4_lw/glue.c", "#include <lwext4_rust/ext4.h>\n"),
    ]
    registry = [("lwext4", ["lwext4", "lwext4_rust"], ["ext4_lw"], ["lwext4_rust"]), ("smoltcp", ["smoltcp"], [], ["smoltcp"]), ("fatfs", ["fatfs"], [], ["fatfs"]), ("riscv", ["riscv"], [], ["riscv"])]
    table = spark.createDataFrame(files, "repo string, path string, text string")
    roots = libraries.library_roots(table, spark.createDataFrame(registry, "library string, segments array<string>, integrations array<string>, imports array<string>"))
    assert {tuple(r) for r in roots.select("repo", "root", "library").collect()} == {
        ("a", "kernel/net", "smoltcp"), ("a", "fs/lw", "lwext4"), ("a", "fs/ext4_lw", "lwext4"), ("c", "x", "smoltcp"), ("c", "q", "riscv"),
        ("d", "p", "lwext4"), ("e", "p", "lwext4"), ("e", "fs/ext4_lw", "lwext4"),
    }
    nested = roots.unionByName(spark.createDataFrame([("a", "fs", "outer")], "repo string, root string, library string"))
    names = spark.createDataFrame(REGISTRY, "segment string, library string, needs_context boolean")
    got = {(r.repo, r.path): (r.library, r.basis) for r in libraries.library_of(table.drop("text"), names, nested).collect()}
    assert got["a", "kernel/net/src/x.rs"] == ("smoltcp", "root") and got["a", "fs/ext4_lw/deep/other.rs"] == ("lwext4", "root")
    assert got["b", "fs/ext4_lw/mod.rs"] == (None, None) and got["a", "Cargo.toml"] == (None, None)


def test_paths_are_looked_up_by_equality(spark):
    registry = spark.createDataFrame(REGISTRY, "segment string, library string, needs_context boolean")
    files = spark.createDataFrame([("r", "a/b")], "repo string, path string")
    plan = libraries.library_of(files, registry)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert libraries.library_of(files.filter(F.lit(False)), registry).count() == 0
