"""Tags of pairs, facts about repositories, and rewriting of labels."""

import pytest
from pyspark.sql import functions as F

from kinfolk.functions import labels
from kinfolk.operators import repo_facts, tagging

FORWARDER = "pub fn sys_sendto(\n    sockfd: usize,\n    buf: *const u8,\n) -> isize {\n    syscall(\n        SYSCALL_SENDTO,\n        [\n" + "            sockfd as isize,\n" * 6 + "        ],\n    )\n}"
COMPLEX = "pub fn sys_fchdir(fd: usize) -> isize {\n let file = match get(fd) {\n  Some(file) => file,\n  None => return -9,\n };\n for g in groups() {\n  if g.can(&file) { set(file.path()); return 0; }\n }\n -13\n}"
LONG = "pub fn sys_custom(arg: usize) -> isize {\n" + "\n".join(f"let value_{i} = transform({i});" for i in range(8)) + "\ncommit_state(arg);\n0\n}"
SIGNAL = "match self.timer_type { TimerType::REAL => Some(14), TimerType::VIRTUAL => Some(26), TimerType::PROF => Some(27), _ => None }"
MOUNT = "fn mount(dev: Device) -> Result<Fs> {\n if dev.magic() != 0xef53 { return Err(BadFs); }\n for block in dev.blocks() {\n  match block.state() {\n   Dirty => replay(block)?,\n   Clean => verify(block)?,\n  }\n }\n Ok(Fs::new(dev))\n}"
NUMBERS = "fn check_access(mode: usize) -> isize {\n const ERRORS: [isize; 4] = [1, 3, 6, 9];\n if mode & 13 == 0 { return -20; }\n for e in ERRORS { audit(e); }\n -13\n}"


@pytest.mark.parametrize(
    "path, name, code, want",
    [
        ("api/src/file/fs.rs", "metadata_to_kstat", "fn x(){}", "explicit_abi_conversion"),
        ("api/src/mm.rs", "sys_shmctl", "pub fn sys_shmctl(id: usize) -> isize { convert_shmctl(id as i32) }", "thin_abi_adapter"),
        ("api/src/syscall/fs.rs", "sys_fchdir", COMPLEX, None),
        ("user/src/syscall/socket.rs", "sys_sendto", FORWARDER, "thin_abi_adapter"),
        ("os/src/syscall/custom.rs", "sys_custom", LONG, None),
        ("os\\Ctypes\\fs.rs", "convert", "fn convert(){}", "non_product_or_compatibility_path"),
        ("x/build.rs", "main", None, "non_product_or_compatibility_path"),
        ("os/prebuild.rs/x", "main", "fn main(){}", None),
        ("os/src/fs/dir.rs", "read_dir", "fn read_dir(){}", None),
        ("os/src/lib.rs", "from", "fn from(){}", None),
        ("api/src/x.rs", "check_pending_timer_signal", SIGNAL, "standard_mapping_dominates"),
        ("core/src/fs.rs", "stat", "FsStat { fs_type: 0xef53, .. }", "standard_mapping_dominates"),
        ("core/src/file.rs", "set_len", "fn set_len(&self,len:u64){ data.resize(len as usize,0); }", None),
        ("core/src/fs.rs", "mount", MOUNT, None),
        ("os/src/syscall/fs.rs", "check_access", NUMBERS, None),
        ("api/src/syscall/fs.rs", "sys_splice", "fn sys_splice(_fd: usize, _len: usize) -> isize { -38 }", None),
        (None, None, None, None),
    ],
)
def test_basis_of_interfaces(spark, path, name, code, want):
    row = spark.createDataFrame([(path, name, code)], "p string, n string, c string")
    assert row.select(tagging.abi_basis(F.col("p"), F.col("n"), F.col("c")).alias("b")).first().b == want


def test_standard_constants(spark):
    cases = {"sig 2 3 4 6": True, "sig 2 3 4": False, "2 3 4 6": False, "alarm(14, 26, 27)": True, "magic == 0XEF53": True, "signal 2 3 4 66": False, "design 2 3 4 6": False, "sig a2 3_ 4 6 8": False}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", tagging.standard_constants(F.col("c")).alias("x")).collect()
    assert {r.c: r.x for r in rows} == cases


def test_roots_of_upstreams(spark):
    at = lambda p: spark.range(1).select(tagging.root_place(F.lit(p)).alias("r")).first().r
    assert at("2025/o/ArceOS/modules/x.rs")[1:] == ("arceos", "modules/x.rs") and at("a\\xv6_riscv\\src\\t.c")[1:] == ("xv6riscv", "src/t.c")
    assert at("core/src/arceos_like/x.rs") is None and at("") is None and at("x/arceos").rest == ""
    of = lambda r: spark.range(1).select(tagging.upstream_of(F.lit(r)).alias("k")).first().k
    assert [of(r) for r in ("0/baseline_arceos", "baseline_rcore_v3_more", "baseline_rcore_v1", "baseline_other", "arceosx", "os-kernel-lab", "")] == ["arceos", "rcorev3", "rcore", None, None, "oskernellab", None]


PAIR = "q_id long, q_path string, q_name string, q_code string, c_path string, c_name string, library string, false_positive string, kept_more boolean, relation string, same_name boolean, fingerprint boolean, matched int, line_sim double, literals int, seg_hits int, q_total int, c_total int"


def pair(q_id, q_path, c_path, q_name="f", c_name="g", q_code="fn f(){}", library=None, false_positive=None, kept_more=None, relation=None, same_name=None, fingerprint=None, matched=None, line_sim=None, literals=None, seg_hits=None, q_total=None, c_total=None):
    return (q_id, q_path, q_name, q_code, c_path, c_name, library, false_positive, kept_more, relation, same_name, fingerprint, matched, line_sim, literals, seg_hits, q_total, c_total)


def test_upstream_tags(spark):
    like = {"relation": "exact_counterpart", "matched": 8, "line_sim": 0.9}
    rows = [
        pair(1, "arceos/modules/axhal/x.rs", "2025/other/arceos/modules/axhal/x.rs"),
        pair(2, "arceos/modules/axhal/x.rs", "2025/other/arceos/modules/axhal/x.rs"),  # the same, without a reference
        pair(3, "arceos/modules/asynctask/src/task.rs", "2024/x/crates/taskctx/src/task.rs", **like),
        pair(4, "arceos/modules/common/x.rs", "2025/o/rcore/modules/common/x.rs"),
        pair(5, "arceos/api/y.rs", "AstrancE/api/y.rs"),  # the file elsewhere
        pair(6, "arceos/modules/axfs/src/disk.rs", "2025/t/arceos/modules/axfs-ng/src/disk.rs", **like),
        pair(7, "arceos/modules/axfs/src/disk.rs", "2025/t/unrelated/net.rs"),  # a place, but no code
        pair(8, "arceos/modules/axhal/x.rs", "o/arceos/modules/axhal/x.rs", library="lwext4"),
        pair(9, "arceos/modules/axhal/x.rs", "o/arceos/modules/axhal/x.rs", false_positive="cross_arch"),
        pair(10, "arceos/modules/axhal/x.rs", "o/arceos/modules/axhal/x.rs", kept_more=True),
        pair(11, "rcore/modules/axhal/x.rs", "o/rcore/modules/axhal/x.rs"),  # its reference is to another root
        pair(12, "api/src/file/fs.rs", "2025/o/api/src/file/fs.rs", "metadata_to_kstat", "metadata_to_kstat", **like),
        pair(13, "api/src/file/fs.rs", "thirdparty/smoltcp/poll.rs", "metadata_to_kstat", "poll"),
        pair(14, "arceos/ctypes/x.rs", "o/arceos/ctypes/x.rs", "f", "f"),
        pair(15, "core/x.rs", "core/x.rs"),
    ]
    references = spark.createDataFrame([(k, "0/baseline_arceos") for k in (1, 5, 6, 7, 8, 9, 10, 11)] + [(15, "0/baseline_arceos"), (1, "baseline_none")], "q_id long, repo string")
    layout = spark.createDataFrame([("ArceOS", "modules", "axfs"), ("arceos", "modules", "axhal"), ("virtio", "modules", "asynctask")], "root string, container string, child string")
    out = tagging.tag_upstream(spark.createDataFrame(rows, PAIR), references, layout).collect()
    got = {r.q_id: (r.upstream_hint, r.upstream, r.upstream_basis, r.abi_basis, r.source_valid) for r in out}
    proven, same, placed = "complete_upstream_source_tokens", "paired_relative_path_unverified", "framework_path_with_code_evidence_unverified"
    assert got[1] == ("arceos", "arceos", proven, None, True) and got[2] == ("arceos", None, same, None, False)
    assert got[3] == (None,) * 5 and got[4] == (None,) * 5 and got[5][:3] == ("arceos", "arceos", proven)
    assert got[6] == ("arceos", "arceos", proven, None, True) and got[7] == (None,) * 5
    assert got[8] == (None,) * 5 and got[9] == (None,) * 5
    assert got[10] == ("arceos", None, same, None, False) and got[11] == ("rcore", None, same, None, False)
    assert got[12] == (None, None, None, "explicit_abi_conversion", True) and got[13] == (None, None, None, "explicit_abi_conversion", False)
    assert got[14] == ("arceos", None, same, "non_product_or_compatibility_path", False) and got[15] == (None,) * 5
    no_proof = tagging.tag_upstream(spark.createDataFrame(rows[5:6], PAIR), references.limit(0), layout).first()
    assert (no_proof.upstream, no_proof.upstream_basis) == (None, placed)


def test_source_evidence(spark):
    one = {"relation": "code_clone_renamed"}
    cases = [({}, False), ({**one, "fingerprint": True}, True), ({**one, "matched": 5, "line_sim": 0.35}, True), ({**one, "matched": 4, "line_sim": 0.9}, False), ({**one, "matched": 3, "literals": 1}, True), ({**one, "seg_hits": 3, "q_total": 10, "c_total": 10}, True), ({**one, "seg_hits": 3, "q_total": 10, "c_total": 11}, False), ({"same_name": True, "matched": 5, "line_sim": 0.5}, True), ({"same_name": True, "fingerprint": True}, False), ({"relation": "other", "fingerprint": True}, False)]
    rows = spark.createDataFrame([pair(k, "a", "b", **c) for k, (c, _) in enumerate(cases)], PAIR)
    assert {r.q_id: r.e for r in rows.select("q_id", tagging.source_evidence(rows).alias("e")).collect()} == {k: w for k, (_, w) in enumerate(cases)}


def test_false_positives(spark):
    asm = 'unsafe fn a() {\n core::arch::asm!("csrw sstatus, {}", in(reg) x);\n}'
    loong = 'unsafe fn a() {\n core::arch::asm!("csrwr {}, 0x1", in(reg) x);\n}'
    cols = "k int, q_path string, q_name string, q_code string, q_lang string, c_path string, c_code string, c_lang string, exact_lines int, renamed_lines int, library string"
    rows = [
        (1, "src/riscv/a.rs", "a", asm, "rust", "src/loongarch/a.rs", loong, "rust", 0, 3, None),
        (2, "src/riscv/a.rs", "a", asm.replace("\n core", "\n for i in x {} core"), "rust", "src/loongarch/a.rs", loong, "rust", 0, 3, None),
        (3, "src/riscv/a.rs", "a", asm + "\nlet y = 1;" * 12, "rust", "src/loongarch/a.rs", loong, "rust", 4, 5, None),
        (4, "src/riscv/a.rs", "a", asm + "\nlet y = 1;" * 12, "rust", "src/loongarch/a.rs", loong, "rust", 1, 4, None),
        (5, "src/riscv/a.rs", "a", asm, "rust", "other/riscv/a.rs", asm, "rust", 0, 3, None),
        (6, "src/riscv/a.rs", "a", asm, "rust", "src/loongarch/a.rs", loong, "rust", 0, 3, "lwext4"),
        (7, "a.rs", "a", "fn a() {}", "rust", "a.c", "void a() {}", "c", 1, 0, None),
        (8, "switch.S", "__switch", "__switch:\n fsd fa0, 0(a0)\n fld fa1, 8(a1)\n sd ra, 0(a0)\n flw fa2, 0(a2)\n ret", "asm", "b.S", "x", "asm", 1, 0, None),
        (9, "s.S", "work", "work:\n add a0, a1, a2\n mul a0, a0, a1\n ret", "asm", "b.S", "x", "asm", None, None, None),
    ]
    got = {r.k: (r.false_positive, r.cross_arch_signal, r.cross_lang_signal, r.boilerplate_signal) for r in tagging.tag_false_positives(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: ("cross_arch", True, False, False), 2: (None, True, False, False), 3: (None, True, False, False), 4: ("cross_arch", True, False, False), 5: (None, False, False, False), 6: (None, False, False, False), 7: (None, False, True, False), 8: (None, False, False, True), 9: (None, False, False, False)}


def test_scan_of_a_source():
    rust = """pub fn sys_read(a: usize) -> isize { do_read(a) }
// SYS_COMMENT => 1,
fn syscall(id: usize) -> isize {
    match id {
        SYS_READ => sys_read(0),
        SYS_A | SYS_B => 1,
        /* SYS_GONE => 2, */
        x => match x { SYS_ON_LINE => 1,
            SYS_INNER => 2, _ => { let y = "SYS_TEXT => 1";
            SYS_BLOCK => 3 } },
    }
    SYS_AFTER => 4
}
pub const SYSCALL_DUP: usize = 3;
syscall_define!(pipe2, x);
#[syscall]
pub fn sys_brk() {}
"""
    found = repo_facts.scan(rust, "rust")
    assert [x[1:] for x in found if x[0] == "arm"] == [("SYS_READ", 5), ("SYS_INNER", 9)]
    assert [x[1:] for x in found if x[0] == "function"] == [("sys_read", 1), ("syscall", 3), ("sys_brk", 17)]
    assert ("constant", "SYSCALL_DUP", 14) in found and ("macro", "pipe2", 15) in found and ("macro", "sys_brk", 17) in found and ("called", "do_read", 1) in found
    c = "static int sys_open(int a);\nuint64_t sys_x(void)\n{\n  switch (f(a[1])) {\n    case SYS_open: break;\n  case SYS_OPEN:\n    if (x) { y(); }\n    switch (z) { case 1: ; }\n  case SYS_LAST: return 1;\n  }\n  case SYS_OUT: ;\n}\n foo(1);\n"
    found = repo_facts.scan(c, "c")
    assert [x[1:] for x in found if x[0] == "arm"] == [("SYS_OPEN", 6), ("SYS_LAST", 9)]
    assert [x[1:] for x in found if x[0] == "function"] == [("sys_open", 1), ("sys_x", 2)]
    assert repo_facts.scan("", "c") == [] and repo_facts.scan("}}} switch {", "c") == []


def test_facts_of_repositories(spark):
    files = [
        ("a", "kernel/syscall.c", "int sys_read(int f)\n{ do_write(1); }\nlong sys_weird(void) {}\n"),
        ("a", "kernel/io.c", "int do_write(int f) {}\nint do_other(int f) {}\n"),
        ("a", "vendor/x.c", "int sys_mmap(int f) {}"),
        ("a", "kernel/param.h", "// cpus\n#define NCPU 8 // all\n"),
        ("a", "kernel/entry.S", "nop\n  call hart_start\n"),
        ("a", "kernel/table.rs", "let x = SYS_DUP;\npub const SYS_CLOSE: usize = 4;\n"),
        ("b", "deep/syscall.c", "switch (n) {\ncase SYS_A: ;\ncase SYS_B: ;\ncase SYS_A: ;\n}"),
        ("b", "deep/other/syscall.c", "x"),
        ("b", "Makefile", "all:\nCPUS := 3\n"),
        ("c", "src/config.rs", "pub const NR_CPUS: usize = 2;"),
        ("c", "Makefile", "CPUS=5"),
        ("d", "readme.md", None),
    ]
    table = spark.createDataFrame(files, "repo string, path string, text string")
    found = repo_facts.scanned(table)
    assert {tuple(r) for r in repo_facts.implemented_calls(found).collect()} == {("a", "read")}
    assert {(r.repo, r.arms, tuple(r.places)) for r in repo_facts.dispatch_arms(found).collect()} == {("b", 2, ("deep/syscall.c:2",))}
    assert {tuple(r) for r in repo_facts.key_files(table).collect()} == {("a", "kernel/syscall.c", 61, 4), ("b", "deep/other/syscall.c", 1, 1)}
    cpus = {r.repo: (r.numcpu, r.wakeup, r.places) for r in repo_facts.processors(table).collect()}
    assert cpus == {"a": (8, True, ["kernel/param.h:2", "kernel/entry.S:2"]), "b": (3, False, ["Makefile:2"]), "c": (2, False, ["src/config.rs:1"])}
    calls = {(r.repo, r.name): (r.strategy, r.source, r.path) for r in repo_facts.syscall_sources(found).collect()}
    assert calls["a", "read"] == ("function_name", "sys_read", "kernel/syscall.c") and calls["a", "weird"][0] == "function_name"
    assert ("a", "other") not in calls and calls["a", "close"] == ("constant_only", "SYS_CLOSE", "kernel/table.rs") and ("a", "dup") not in calls
    assert repo_facts.scanned(table.limit(0)).count() == 0


def test_called_helpers_count_and_dispatch_files_do(spark):
    files = [("r", "t.c", "int my_syscall(int n)\n{ do_write(1); return NR_OPENAT; }\n"), ("r", "w.c", "int do_write(int f) {}\nint do_other(int f) {}\n")]
    found = repo_facts.scanned(spark.createDataFrame(files, "repo string, path string, text string"))
    calls = {r.name: (r.strategy, r.source, r.path) for r in repo_facts.syscall_sources(found).collect()}
    assert calls == {"write": ("function_name", "do_write", "w.c"), "openat": ("dispatch_table", "NR_OPENAT", "t.c")}


def test_labels(spark):
    rows = ["自研/原创（函数）", "<h2 id=x>原创代码</h2>", "原创 12.5% / 原创 7", "高度疑似借鉴 needReview", "疑似借鉴（函数）", "高度疑似借鉴（函数）", '{"name": "借鉴", "c": "#ef4444"}, {"name": "原创", "c": "#22c55e"}', "plain", "", None, "&nbsp;借鉴</div>"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
    got = [r.x for r in table.orderBy("k").select(labels.rewritten(F.col("t")).alias("x")).collect()]
    assert got == ["暂未检出相似（函数）", "<h2 id=x>暂未检出历史相似（不等于原创）</h2>", "暂未检出相似 12.5% / 暂未检出 7", "高置信同源代码 模型复核后仍存疑", "模型复核后仍存疑（函数）", "高置信同源代码（函数）", '{"name": "高置信同源代码", "c": "#ef4444"}, {"name": "暂未检出相似", "c": "#22c55e"}', "plain", "", None, "&nbsp;高置信同源代码</div>"]
    assert labels.unsettled(table, "t").count() == 0
    assert [r.k for r in labels.unsettled(table, "t", [("plain", "plain plain")]).collect()] == [7]
    left = {r.k: r.x for r in table.select("k", labels.residual(F.col("t")).alias("x")).collect() if r.x}
    assert left == {3: ["高度疑似借鉴", "高度疑似", "needReview"], 5: ["高度疑似借鉴", "高度疑似"], 10: ["&nbsp;借鉴</div>"]}


def test_stale_note(spark):
    pages = ["<html><BODY>x<body class='y'>z", '<body data-retrieval-contract-version="1">x', "no body", None, "<bodyx>"]
    table = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, p string").withColumn("n", labels.with_stale_note(F.col("p")))
    got = {r.k: r.n for r in table.collect()}
    assert got[0] == pages[0].replace("<BODY>", "<BODY>" + labels.STALE_NOTE) and [got[k] for k in range(1, 5)] == pages[1:]
    assert table.withColumn("again", labels.with_stale_note(F.col("n"))).filter("again <> n").count() == 0
