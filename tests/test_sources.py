"""Sources, sinks and increments on files."""

import pytest
from pyspark.sql import functions as F

from kinfolk.sources import repositories as R
from kinfolk.sources import sinks
from kinfolk.streaming.increments import append_increments


def test_source_files(spark, tmp_path):
    for name, body in {"os/a.rs": "fn a() {}\n// c\n", "os/tests/b.rs": "x", "target/c.rs": "x", "d.py": "x", "e/f.c": "int x;", "e/g.h": "y\n" * 20}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    out = {r.path: r for r in R.source_files(spark, str(tmp_path), max_lines=10).collect()}
    assert {k.split("/", 1)[-1] if k.startswith("/") else k for k in out} >= {"os/a.rs"} and len(out) == 2
    assert {(r.lang, r.n_lines) for r in out.values()} == {("rust", 2), ("c", 1)}


def test_commits(spark, tmp_path):
    (tmp_path / "log.txt").write_text("@@@s1\x1f2024-01-01T00:00:00Z\x1fann\x1ffirst\n3\t1\ta.rs\n4\t0\tb.rs\n@@@s2\x1f2024-01-02T00:00:00+08:00\x1fbob\x1fbinary\n-\t-\tc.bin\n")
    rows = {r.sha: r for r in R.commits(spark, str(tmp_path)).collect()}
    assert rows["s1"].additions == 7 and rows["s1"].complete and [f.path for f in rows["s1"].files] == ["a.rs", "b.rs"]
    assert rows["s2"].additions is None and not rows["s2"].complete and rows["s2"].seq == 1


def test_tables_and_urls(spark, tmp_path):
    (tmp_path / "t.md").write_text("# x\n| name | url |\n|---|:-:|\n| a | http://h/a |\n| short |\n| b | h/b |\n")
    assert sorted(r.row["name"] for r in R.markdown_table(spark, str(tmp_path)).collect()) == ["a", "b"]
    rows = spark.createDataFrame([(1, "http://h/A.git"), (2, "https://h/a/"), (3, "h/b")], "row long, url string")
    assert sorted(r.row for r in R.unique_urls(rows).collect()) == [1, 3]
    repos = spark.createDataFrame([("2024/X", "h/a"), ("2024/x", "h/b"), ("2024/y", "h/c")], "repo_id string, url string")
    assert [r.repo_id for r in R.id_collisions(repos).collect()] == ["2024/x"]


def test_replacement_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, repo_id string")
    sinks.replace_repositories(one, path)
    for _ in range(2):
        sinks.replace_repositories(spark.createDataFrame([(3, "a")], "id long, repo_id string"), path)
    assert sorted((r.id, r.repo_id) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_upserts(spark):
    old = spark.createDataFrame([("u", 1, "new", 7), ("v", 1, "x", 8)], "url string, version int, status string, id int")
    new = spark.createDataFrame([("u", 2, "done", 9), ("w", 1, "y", 10)], "url string, version int, status string, id int")
    assert sorted((r.url, r.status) for r in sinks.upserted(old, new, ["url"], "version").collect()) == [("u", "done"), ("v", "x"), ("w", "y")]
    assert sorted((r.url, r.status, r.id) for r in sinks.merged(old, new, "url", ["id"]).collect()) == [("u", "done", 7), ("v", "x", 8), ("w", "y", 10)]


def test_increments_append_once(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    assert sinks.append_new(spark.createDataFrame([(1, "a"), (1, "b")], "id long, t string"), path) == 1
    for rows in ([(1, "z"), (2, "x")], [(2, "y"), (3, "x")]):
        spark.createDataFrame(rows, "id long, t string").write.mode("append").parquet(source)
        append_increments(spark.readStream.schema("id long, t string").parquet(source), path, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(path).select(F.col("id")).collect()) == [1, 2, 3]


def test_unknown_errors_pass(spark, tmp_path):
    with pytest.raises(Exception):
        sinks.append_new(spark.range(1), str(tmp_path / "x"), "no_such_column")
