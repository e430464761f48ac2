"""Feature labels, references by their signs, tables of works, and JSON in columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinfolk.functions import text as X
from kinfolk.operators import features
from kinfolk.sources import repositories


def test_feature_labels(spark):
    cases = [
        ("os\\src\\fs\\inode.rs", "read_at", 3, "fs", "inode", "Inode 与目录项"),
        ("os/src/fs/x.rs", "remove_entry", 3, "fs", "目录与文件创建", "目录与文件创建"),
        ("os/ipc/shm.rs", "remove_shmaddr", 3, "ipc", "ipc", "进程间通信"),
        ("os/x.rs", "create_buffer", 3, "mm", None, "mm · create_buffer"),
        ("os/x.rs", "create_buffer", 3, None, "目录与文件创建", "目录与文件创建"),
        ("os/ext4/read.rs", "f", 1, "fs", "ext4", "Ext4 文件系统"),
        ("os/mmap.rs", "f", 1, "fs", None, "fs · f"),
        (None, None, None, None, None, "other · 未命名函数"),
    ]
    rows = spark.createDataFrame([c[:4] for c in cases], "p string, n string, s int, m string")
    got = rows.select("*", features.feature(F.col("p"), F.col("n"), F.col("s"), F.col("m")).alias("f")).collect()
    for r, (p, n, s, m, key, label) in zip(got, cases):
        place = f"{(p or '').lower()}|{s or 0}|{(n or '').lower()}"
        own = f"{m or 'other'}:function:{hashlib.sha1(place.encode()).hexdigest()[:12]}"
        assert (r.f.key, r.f.label) == (key or own, label)


def test_reference_scores(spark):
    S = features.Sign
    signs = [S("rcore", "source", "TaskControlBlock"), S("rcore", "source", "MemorySet"), S("xv6", "source", "struct proc"), S("rcore", "commit", "rCore"), S("xv6", "commit", "xv6"), S("xv6", "function", "usertrap"), S("rcore", "function", "sys_fork")]
    files = [("a", "x.rs", "TaskControlBlock MemorySet sys_fork sys_fork"), ("a", "y.rs", "MemorySet sys_fork"), ("a", "z.c", "struct proc"), ("b", "x.c", "struct proc usertrap"), ("c", "x.c", "usertrap"), ("d", "x.c", "nothing"), ("e", "x", "TaskControlBlock struct proc"), ("f", "x", None)]
    commits = [("b", "start from XV6 of the course"), ("g", "from rcore tutorial"), ("d", None)]
    out = features.reference_scores(spark.createDataFrame(files, "repo string, path string, text string"), spark.createDataFrame(commits, "repo string, subject string"), signs)
    got = {r.repo: (r.reference, r.confidence, r.score) for r in out.collect()}
    assert got == {"a": ("rcore", "high", 10), "b": ("xv6", "high", 9), "c": ("xv6", "low", 1), "d": (None, "high", 0), "e": ("rcore", "low", 3), "f": (None, "high", 0), "g": ("rcore", "medium", 5)}
    evidence = {r.repo: r.evidence for r in out.collect()}
    assert evidence["a"] == ["TaskControlBlock x.rs", "MemorySet x.rs", "MemorySet y.rs", "sys_fork"] and evidence["d"] is None


def test_tables_of_works(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"Fork 地址",x\n1,"https://g.org/team/T-1.git/",y\n2,HTTPS://G.org/team/t-1,z\n\n3,none,"https://g.org/no"\n4,"https://g.org/a/T%202?x=1",\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('https://g.org/p/q\r\n"say ""hi"", you",https://g.org/second\r\nhttps://g.org/p/r.git\r\n', encoding="utf-8")
    rows = repositories.csv_rows(spark, str(tmp_path))
    assert {tuple(r["cells"]) for r in rows.filter("n = 2").collect()} == {("1", "https://g.org/team/T-1.git/", "y"), ('say "hi", you', "https://g.org/second")}
    got = {(r.file.rsplit("/", 1)[1], r.n, r.url, r.team_id) for r in repositories.works(rows).collect()}
    assert got == {("a.csv", 2, "https://g.org/team/T-1", "T-1"), ("a.csv", 6, "https://g.org/a/T%202?x=1", "T 2"), ("b.csv", 1, "https://g.org/p/q", "q"), ("b.csv", 3, "https://g.org/p/r", "r")}


def test_required_columns(spark):
    names = list(repositories.REQUIRED_COLUMNS.values())
    table = spark.createDataFrame([(" 2025 ", "a", None, "s", "t", " http://x "), ("2025", "a", "b", "s", "t", " "), ("2025", "a", "b", "s", "t", None)], names)
    assert [tuple(r) for r in repositories.required_columns(table).collect()] == [("2025", "a", "", "s", "t", "http://x")]
    with pytest.raises(ValueError, match="学校, 队伍名称"):
        repositories.required_columns(table.drop("学校", "队伍名称"))


def test_json_in_columns(spark):
    rows = spark.createDataFrame([('["a", 1, null]',), ("{}",), ("[broken",), (None,), ('{"a": {"b": 2.5, "c": "x"}}',)], "t string")
    assert [r.x for r in rows.select(X.json_list(F.col("t")).alias("x")).collect()] == [["a", "1", None], [], [], [], []]
    assert [r.x for r in rows.select(X.json_number(F.col("t"), "$.a.b", -1.0).alias("x")).collect()] == [-1.0, -1.0, -1.0, -1.0, 2.5]
    assert [r.x for r in rows.select(X.json_number(F.col("t"), "$.a.c", 7.0).alias("x")).collect()] == [7.0] * 5
