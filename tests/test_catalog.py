"""Citations, verdict rules, catalogs, provenance by path and test logs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfolk.operators import catalog, citations, verdicts


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_commits_by_prefix(spark):
    shas = ["abcdef0123456789", "abcdef0999999999", "1234567890abcdef0"]
    commits = spark.createDataFrame([(s,) for s in shas], "sha string")
    asked = ["abcdef0", "abcdef01", "ABCDEF01", "1234567890abFFFF", "123456", "zzzzzzz", "7777777", None, "1234567"]
    out = {r.cited: (r.sha, r.n) for r in citations.resolved_commits(spark.createDataFrame([(a,) for a in asked], "cited string"), commits).collect()}
    assert out == {"abcdef0": (None, 2), "abcdef01": (shas[0], 1), "ABCDEF01": (shas[0], 1), "1234567890abFFFF": (shas[2], 1), "123456": (None, 0), "zzzzzzz": (None, 0), "7777777": (None, 0), None: (None, 0), "1234567": (shas[2], 1)}


def test_citations_of_files_and_folders(spark):
    text = "See os/src/main.rs:12-40 and repo/os/src/mm/heap.c, not gone/away.rs. Folders os/src/ and no/where/ here."
    reports = spark.createDataFrame([("r", text), ("empty", None)], "report string, text string")
    files = spark.createDataFrame([("os/src/main.rs",), ("os/src/mm/heap.c",)], "path string")
    got = {(r.cited, r.kind): r.found for r in citations.checked_citations(reports, files).collect()}
    assert got == {("os/src/main.rs", "file"): True, ("repo/os/src/mm/heap.c", "file"): True, ("gone/away.rs", "file"): False, ("os/src/", "folder"): True, ("no/where/", "folder"): False}


def test_incomplete_reports_and_audit(spark):
    rows = [("a", "All is said."), ("b", "TODO"), ("c", "and so on ..."), ("d", " "), ("e", "fill {{name}}"), ("f", "todos are done."), ("g", "it goes … on"), ("h", "dots.... and <code>a...b</code>"), ("i", "<p>x</p><p>使用规则兜底</p>"), ("j", '<b style="text-overflow : Ellipsis">x</b>'), ("k", "<pre>使用规则兜底</pre>fine"), ("l", '{"overflow": "truncate"}'), ("m", "<i style='-webkit-line-clamp:2'>x</i>")]
    reports = spark.createDataFrame(rows, "report string, text string")
    assert pairs(reports.filter(citations.incomplete(F.col("text"))), "report") == [(x,) for x in "bcdegijlm"]
    wanted = spark.createDataFrame([(x,) for x in "abxa"], "report string")
    assert pairs(citations.audit(reports, wanted), "wanted", "present", "missing", "incomplete") == [(3, 2, 1, 1)]


def test_flaws_of_reports(spark):
    page = "<p>" + "a" * 40 + "... and &hellip; " + "b" * 40 + "</p><script>x...</script>"
    row = spark.createDataFrame([(page,)], "t string").select(citations.ellipses(F.col("t")).alias("e"), citations.flaws(F.col("t")).alias("f")).first()
    assert row.e == ["a" * 28 + "... and … " + "b" * 21, "a" * 20 + "... and … " + "b" * 27]
    assert [x.kind for x in row.f] == ["ellipsis", "ellipsis"]


def test_error_markers(spark):
    deep = "1"
    for k in range(30):
        deep = '{"_error": "at %d", "x": [%s, 2]}' % (k, deep)
    rows = [(1, '{"a": {"_error": "lost", "b": [1, {"_error": "", "c": {"_error": 7}}, [{"_error": "in list"}]]}, "_error": {"x": {"_error": "not looked at"}}}'), (2, "[]"), (3, None), (4, "{broken"), (5, '"_error"'), (6, '{"_error": false, "y": [{"_error": null}, {"_error": []}, {"_error": "0"}]}')]
    table = spark.createDataFrame([*rows, (7, deep)], "id long, j string")
    found = [(r.id, r.path, r.message) for r in citations.error_markers(table, "id", "j").collect()]
    assert sorted(x for x in found if x[0] < 7) == [(1, "report", '{"x":{"_error":"not looked at"}}'), (1, "report.a", "lost"), (1, "report.a.b[1].c", "7"), (1, "report.a.b[2][0]", "in list"), (6, "report.y[2]", "0")]
    assert sorted(int(m.split()[1]) for i, _, m in found if i == 7) == list(range(30)) and (7, "report" + ".x[0]" * 29, "at 0") in found
    with pytest.raises(ValueError):
        citations.error_markers(table, "id", "j", most_depth=5)


EVIDENCE = "q_id long, c_id long, tier string, relation string, agrees boolean, line_sim double, cover double, matched int, identity double, fingerprint boolean, literals int, segment_cover double, state string, review_score double"


@pytest.fixture(scope="module")
def queue(spark):
    c = "exact_counterpart"
    rows = [
        (1, 1, "review", c, True, 0.85, 0.75, 8, 0.0, False, 0, 0.0, "selected", 0.9),
        (1, 2, "weak", c, True, 0.84, 0.75, 8, 0.0, False, 0, 0.0, "deferred_secondary", 0.8),
        (1, 3, "weak", c, True, 0.66, 0.60, 12, 0.0, False, 0, 0.0, "deferred_secondary", 0.7),
        (1, 4, "weak", "other", True, 0.2, 0.2, 1, 0.0, True, 0, 0.0, "deferred_secondary", 0.7),
        (2, 5, "review", c, False, 0.99, 1.0, 99, 1.0, True, 0, 0.0, "selected", 0.9),
        (2, 6, "weak", c, True, 0.40, 0.2, 15, 0.8, False, 0, 0.0, "deferred_secondary", 0.9),
        (3, 7, "confirmed", c, True, 0.99, 1.0, 99, 1.0, True, 0, None, "selected", 0.9),
    ]
    return spark.createDataFrame(rows, EVIDENCE)


def test_rules_against_negative_reviews(queue):
    assert pairs(verdicts.contested(queue), "c_id", "overrides", "needs_human") == [(1, True, False), (2, False, False), (3, False, True), (4, False, False), (5, False, False), (6, False, True), (7, False, False)]


def test_secondary_fallback(spark, queue):
    cleared = spark.createDataFrame([(1, 1, "cleared"), (2, 5, "confirmed")], "q_id long, c_id long, verdict string")
    assert pairs(verdicts.secondary_fallback(queue, cleared), "q_id", "c_id") == [(1, 3)]


def test_fallbacks_and_rollups(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    no = F.lit(None).cast("double")
    assert value(verdicts.line_similarity(no, F.lit(0.4), hits=F.lit(1), q_lines=F.lit(2), c_lines=F.lit(4))) == 0.4
    assert value(verdicts.line_similarity(no, hits=F.lit(1), q_lines=F.lit(2), c_lines=F.lit(4))) == 0.25 and value(verdicts.line_similarity(no, hits=F.lit(1), q_lines=F.lit(0), c_lines=F.lit(0))) == 0.0
    assert value(verdicts.match_cover(F.lit(3), F.lit(2), F.lit(9))) == 1.0 and value(verdicts.effective_lines(F.lit(0), F.lit(0.5), F.lit(9))) in (4, 5)
    rows = spark.createDataFrame([(1, "s1", 0.9, 5, "m", "confirmed"), (1, "s2", 0.9, 3, "m", "review"), (2, "s1", 0.6, 2, "n", "review"), (1, "s1", 0.5, 1, "m", "weak")], "q_id long, c_source string, line_sim double, hits int, module string, cls string")
    assert pairs(verdicts.exclusive_counts(rows, "c_source", ["confirmed", "review", "weak"]), "c_source", "confirmed", "review", "weak") == [("s1", 1, 1, 0), ("s2", 0, 1, 0)]
    assert [tuple(r) for r in verdicts.best_source(rows, F.col("line_sim") > 0.8, "sources").collect()] == [(1, ["s1", "s2"], "s1", 0.9)]
    files = spark.createDataFrame([("f", "s3")], "path string, c_source string")
    out = verdicts.history_metrics(rows.filter("cls = 'confirmed'"), rows.filter("cls = 'review'"), files)
    assert pairs(out, "rank", "c_source", "functions", "lines", "reviewed", "equal_files") == [(1, "s1", 1, 5, 1, 0), (2, "s2", 0, 0, 1, 0), (3, "s3", 0, 0, 0, 1)]
    assert verdicts.most_similar(rows, F.col("cls") == "confirmed", F.col("cls") == "review").count() == 1
    assert verdicts.most_similar(rows, F.col("cls") == "none", F.col("cls") == "review").count() == 2
    assert [r.cls for r in verdicts.in_fixed_order(rows, "cls", ["weak", "review"], F.desc("line_sim")).collect()] == ["weak", "review", "review", "confirmed"]


def test_catalog(spark):
    rows = spark.createDataFrame([(k, "abc"[k % 3], k // 2) for k in range(9)], "id long, kind string, t int")
    assert [r.id for r in catalog.page(rows, [F.desc("id")], 2, 1).collect()] == [6, 5]
    assert [r.id for r in catalog.by_kind(rows, ["b", "a"], "t", 5).collect()] == [7, 4, 1, 6, 3]
    std = spark.createDataFrame([("read", "fs"), ("write", "fs"), ("fork", "proc")], "name string, category string")
    found = spark.createDataFrame([("read", True), ("write", False), ("extra", True)], "name string, implemented boolean")
    assert {r.name: r.state for r in catalog.standard_coverage(std, found).collect()} == {"read": "covered", "write": "constant_only", "fork": "missing", "extra": "extra"}
    calls = spark.createDataFrame([("f.c", "a", ["x", "y", "x"]), ("f.c", "b", None), ("g.c", "c", ["z"])], "file string, name string, calls array<string>")
    assert pairs(catalog.callers(calls, spark.createDataFrame([("x",), ("z",)], "symbol string")), "symbol", "file", "caller") == [("x", "f.c", "a"), ("z", "g.c", "c")]
    words = spark.createDataFrame([("mm", "memory"), ("fs", "files")], "word string, subsystem string")
    files = spark.createDataFrame([("os/mm/fs.c",), ("os/x.c",), ("os/fs/y.c",)], "path string")
    own = spark.createDataFrame([("os/x.c", "net")], "path string, subsystem string")
    assert pairs(catalog.file_subsystem(files, own, words), "path", "subsystem") == [("os/fs/y.c", "files"), ("os/mm/fs.c", "memory"), ("os/x.c", "net")]


def test_provenance_by_path(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    same = lambda a, b: value(catalog.same_tree(F.lit(a), F.lit(b), F.lit("vendor")))
    assert same("x/vendor/lwip/a.c", "y/z/Vendor/lwip/a.c") and same("x/vendor/lwip/a.c", "other/lwip/a.c")
    assert not same("x/vendor/lwip/a.c", "other/slwip/b.c") and not same("a.c", "b.c") and not same("x/vendored/a.c", "vendored/a.c")
    files = spark.createDataFrame([("r", "third/lwip/core/a.c"), ("r", "third/b.c"), ("r", "thirdly/b.c")], "repo string, path string")
    roots = spark.createDataFrame([("r", "third", "bundle"), ("r", "third/lwip/", "lwip"), ("q", "thirdly", "no")], "repo string, root string, library string")
    assert pairs(catalog.library_context(files, roots).fillna("-"), "path", "library") == [("third/b.c", "bundle"), ("third/lwip/core/a.c", "lwip"), ("thirdly/b.c", "-")]
    layout = spark.createDataFrame([("third", "lwip", "core")], "root string, container string, child string")
    assert pairs(catalog.layout_paths(files, layout), "path") == [("third/lwip/core/a.c",)]


def run_log(failure=False, count=1, complete=True, name="kernel.thread"):
    lines = ["[==========] [ utest ] started", f"utest unit name: ({name}_unit)"]
    lines += ["[ ASSERT ] [ unit ] at (thread.c); func: (create:65); msg: (false)"] if failure else []
    lines += [f"[ PASSED ] [ result ] testcase ({name})"] if count else []
    lines += [f"[==========] [ utest ] {count} tests from 10 testcase ran."]
    return "\n".join(lines + (["[==========] [ utest ] finished"] if complete else [])) + "\n"


def test_test_logs(spark):
    line = "[ PASSED ] [ result ] testcase (kernel.thread)\n"
    logs = {
        "good": (run_log(), "passed"),
        "kept_failure": (run_log(failure=True), "inconsistent"),
        "new_run": (run_log(failure=True) + run_log(), "passed"),
        "cut": (run_log() + run_log(complete=False), "unknown"),
        "zero": (run_log(count=0), "unknown"),
        "no_count": (run_log().replace("1 tests from 10 testcase ran.", ""), "unknown"),
        "impossible": (run_log().replace("from 10 testcase", "from 0 testcase"), "unknown"),
        "twice": (run_log().replace(line, line + line), "unknown"),
        "outside": ("[ ASSERT ] [ unit ] old diagnostic\n" + run_log() + "[ ASSERT ] [ unit ] later\n", "passed"),
        "colour": (run_log(failure=True).replace("[ ASSERT ]", "\x1b[31m[ ASSERT ]\x1b[0m"), "inconsistent"),
        "failed": (run_log(failure=True).replace("[ PASSED ]", "[ FAILED ]"), "failed"),
        "init": (run_log().replace("testcase (", "testcase init ("), "passed"),
        "only_start": (run_log() + "[==========] [ utest ] started", "unknown"),
        "broken_lines": (run_log().replace("\n", "\r\n"), "passed"),
    }
    rows = [(k, t) for k, (t, _) in logs.items()] + [("other", "boot\ndone"), ("null", None)]
    out = {r.log: r for r in catalog.test_runs(catalog.log_lines(spark.createDataFrame(rows, "log string, text string"))).collect()}
    assert {k: r.status for k, r in out.items()} == {k: s for k, (_, s) in logs.items()}
    assert out["kept_failure"].reported == "passed" and out["kept_failure"].first_failure == 3
    assert out["new_run"].earlier_runs == 1 and out["new_run"].failures == 0 and out["good"].units == ["kernel.thread_unit"]
    assert (out["good"].start_line, out["good"].end_line, out["good"].ran, out["good"].available) == (1, 5, 1, 10) and not out["cut"].complete
    kinds = spark.createDataFrame([("HTTP 429 rate limit",), ("connection reset by peer",), ("Traceback: x",), ("fine",), (None,)], "t string")
    assert [r[0] for r in kinds.select(catalog.failure_kind(F.col("t"))).collect()] == ["quota", "network", "other", None, None]


def test_targeted_recall(spark):
    q = spark.createDataFrame([(1, "read_page_table", "c", "mm", 10)], "q_id long, name string, lang string, module string, n_lines int")
    rows = [(10, "s1", "read_page_table", 90), (11, "s1", "page_walk", 10), (12, "s1", "walk", 10), (13, "s2", "read_page", 20), (14, "s9", "read_page_table", 10)]
    c = spark.createDataFrame([(i, s, n, "c", "mm", k) for i, s, n, k in rows] + [(15, "s1", "read_page_table", "rust", "mm", 1)], "c_id long, source string, name string, lang string, module string, n_lines int")
    chosen = spark.createDataFrame([("mm", "s1", 0), ("mm", "s2", 1)], "module string, source string, place int")
    assert pairs(catalog.targeted_recall(q, c, chosen), "c_id", "rank") == [(10, 1), (11, 2), (13, 1)]
    assert pairs(catalog.targeted_recall(q, c, chosen, keep=1), "c_id") == [(10,), (13,)]


def test_targeted_recall_over_blocks(spark, monkeypatch):
    """Names in many blocks give what all pairs give, and no pair of names is shuffled: only each query's best of a block."""
    rng = random.Random(5)
    some = [f"w{k}" for k in range(30)]
    named = lambda: "_".join(rng.sample(some, rng.randint(1, 4))) if rng.random() < 0.9 else rng.choice(["", "__", None])
    rows = [(k, f"s{rng.randint(0, 3)}", named(), rng.choice(["c", "rust"]), "mm", rng.choice([None, 1, 2, 3, 7])) for k in range(400)]
    c = spark.createDataFrame(rows, "c_id long, source string, name string, lang string, module string, n_lines int")
    q = c.filter("c_id % 7 = 0").select(F.col("c_id").alias("q_id"), "name", "lang", "module", "n_lines")
    chosen = spark.createDataFrame([("mm", "s1", 0), ("mm", "s2", 1), ("aa", "s3", 2)], "module string, source string, place int")
    parts = lambda n: set((n or "").split("_")) - {""}
    want = []
    for i, _, name, lang, _, n in (r for r in rows if r[0] % 7 == 0):
        for source, place in (("s1", 0), ("s2", 1)):
            met = []
            for j, s, other, its, _, m in rows:
                if s == source and its == lang and parts(name) & parts(other):
                    near = len(parts(name) & parts(other)) / len(parts(name) | parts(other))
                    if near >= 0.25:
                        met.append((name != other, -near, -(min(n, m) / max(n, m)) if n and m else 1, j))
            want += [(i, x[-1], source, place, k + 1) for k, x in enumerate(sorted(met)[:9])]
    for block in (4096, 16):
        monkeypatch.setattr(catalog, "NAMES_BLOCK", block)
        got = catalog.targeted_recall(q, c, chosen, keep=9)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    few = [pa.table([pa.array(range(9), pa.int64()), pa.array([1] * 9, pa.int64()), pa.array([1] * 9, pa.int32()), pa.array([[1, 2]] * 9, pa.list_(pa.int64()))], ["id", "name", "n_lines", "parts"]) for _ in range(2)]
    few[1] = few[1].append_column("source", pa.array(["s1"] * 9)).append_column("place", pa.array([0] * 9, pa.int32()))
    monkeypatch.setattr(catalog, "CELLS", 8)
    assert catalog.best_names(*few, 0.25, 2).select(["q_id", "c_id"]).to_pylist() == [{"q_id": i, "c_id": j} for i in range(9) for j in range(2)]
