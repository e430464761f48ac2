"""What a function or a repository is about: feature labels by words of paths and names, and the reference a repository
goes back to, by scores over layers of signs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.runtime import stored

#: Words of paths and names in their order, and the features they stand for.
FEATURES = {
    "ext4": "Ext4 文件系统", "fat32": "FAT32 文件系统", "vfs": "文件系统",
    "inode": "Inode 与目录项", "page": "页与页缓存", "frame": "物理页帧",
    "path": "路径解析", "statfs": "文件系统统计", "signal": "信号机制",
    "ipc": "进程间通信", "pipe": "管道通信", "futex": "Futex 同步",
    "lock": "锁与同步", "syscall": "系统调用", "errno": "错误码与 ABI",
    "error": "错误处理", "trap": "异常与中断", "task": "任务管理",
    "process": "进程管理", "sched": "调度器", "timer": "时钟与定时器",
    "clock": "时钟与计时", "time": "时钟与计时",
    "virtio": "VirtIO 驱动", "uart": "串口驱动", "block": "块设备",
    "socket": "套接字", "tcp": "TCP 协议", "udp": "UDP 协议",
    "net": "网络栈", "backtrace": "堆栈回溯", "debug": "调试与诊断",
    "security": "安全与权限",
    "lookup": "目录查找", "search": "目录查找", "child": "目录查找",
    "dir": "目录操作", "readdir": "目录操作", "directory": "目录操作",
    "mkdir": "目录与文件创建", "create": "目录与文件创建", "maker": "目录与文件创建",
    "entry": "目录与文件创建", "new_file": "目录与文件创建", "mkfile": "目录与文件创建",
    "unlink": "目录删除", "rmdir": "目录删除", "remove": "目录删除", "delete": "目录删除",
    "rename": "目录重命名",
    "link": "硬链接", "hardlink": "硬链接", "symlink": "硬链接",
    "metadata": "文件元数据", "getattr": "文件元数据", "setattr": "文件元数据",
    "fstat": "文件元数据", "stat": "文件元数据",
    "truncate": "文件截断", "ftruncate": "文件截断",
    "pread": "文件读写", "pwrite": "文件读写", "read": "文件读写", "write": "文件读写",
    "fs": "文件系统", "mm": "内存管理",
}
#: Words whose feature is one for all of them, and that count in file systems and unknown modules only.
FILE_WORDS = (
    "lookup", "search", "child", "dir", "readdir", "directory", "mkdir", "create", "maker", "entry", "new_file", "mkfile",
    "unlink", "rmdir", "remove", "delete", "rename", "link", "hardlink", "symlink", "metadata", "getattr", "setattr",
    "fstat", "stat", "truncate", "ftruncate", "pread", "pwrite", "read", "write", "fs", "vfs",
)
FILE_MODULES = ("fs", "other")


def feature(path: Column, name: Column, start: Column, module: Column) -> Column:
    """key and label of a function's feature: the first of FEATURES among the words of its path and name. A function without
    one has a key of its own (its module and a hash of its place), so that unknown functions are never one group."""
    at = F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))
    low, of = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(module, F.lit("other"))
    words = F.split(F.concat_ws("/", at, low), "[^a-z0-9]+")
    kept = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(FEATURES[w] if w in FILE_WORDS else w).alias("key"), F.lit(label).alias("label"), F.lit(w in FILE_WORDS).alias("file")) for w, label in FEATURES.items()))
    found = F.get(F.filter(kept, lambda x: F.array_contains(words, x["w"]) & (~x["file"] | of.isin(*FILE_MODULES))), F.lit(0))
    place = F.concat_ws("|", at, F.coalesce(start, F.lit(0)).cast("string"), low)
    own = F.struct(F.concat(of, F.lit(":function:"), F.substring(F.sha1(place.cast("binary")), 1, 12)).alias("key"), F.concat(of, F.lit(" · "), F.when(low == "", F.lit("未命名函数")).otherwise(low)).alias("label"))
    return F.coalesce(F.when(found.isNotNull(), F.struct(found["key"].alias("key"), found["label"].alias("label"))), own)


@dataclass(frozen=True)
class Sign:
    """A word that speaks for a reference: in sources (each file counts), in the first commits, or anywhere (counts once)."""

    reference: str
    layer: str
    word: str


#: What a sign of each layer is worth, and the scores from which on a reference is certain or likely.
WORTH = {"source": 3, "commit": 5, "function": 1}
CERTAIN, LIKELY = 8, 4
EVIDENCE = 5


def reference_scores(files: DataFrame, first_commits: DataFrame, signs: list[Sign], repo: str = "repo") -> DataFrame:
    """repo, reference, confidence (high, medium or low), score, evidence (the first signs): the reference with the highest
    score, ties to the one named first in signs. A repository without any sign has no reference, with high confidence.

    files: repo, path, text; first_commits: repo, subject. A file is looked at once for all signs; what goes on is a row per
    sign and file that has it.
    """
    text, low = F.coalesce("text", F.lit("")), F.lower(F.coalesce("subject", F.lit("")))
    struct = lambda k, s: F.struct(F.lit(k).alias("k"), F.lit(s.layer).alias("layer"))
    of = lambda layers, holds: F.filter(F.array(*(F.when(holds(s), struct(k, s)) for k, s in enumerate(signs) if s.layer in layers)), lambda x: x.isNotNull())
    in_files = files.select(repo, "path", F.explode(of(("source", "function"), lambda s: F.contains(text, F.lit(s.word)))).alias("x")).select(repo, "x.k", "x.layer", F.when(F.col("x.layer") == "source", F.col("path")).otherwise("").alias("place"))
    in_commits = first_commits.select(repo, F.explode(of(("commit",), lambda s: F.contains(low, F.lit(s.word.lower())))).alias("x")).select(repo, "x.k", "x.layer", F.lit("").alias("place"))
    hits = stored(in_files.unionByName(in_commits).distinct(), "signs")
    first = {s.reference: k for k, s in reversed(list(enumerate(signs)))}
    of_sign = lambda make, kind: F.element_at(F.array(*(F.lit(make(s)) for s in signs)), F.col("k") + 1).cast(kind)
    worth = of_sign(lambda s: WORTH[s.layer], "int")
    rows = hits.select(repo, of_sign(lambda s: s.reference, "string").alias("reference"), of_sign(lambda s: first[s.reference], "int").alias("first"), worth.alias("worth"), "k", "place", F.concat_ws(" ", of_sign(lambda s: s.word, "string"), F.nullif("place", F.lit(""))).alias("said"))
    scores = rows.groupBy(repo, "reference", "first").agg(F.sum("worth").cast("int").alias("score"), F.slice(F.array_sort(F.collect_set(F.struct("k", "place", "said"))), 1, EVIDENCE).alias("e"))
    best = scores.groupBy(repo).agg(F.max_by(F.struct("reference", "score", "e"), F.struct("score", (-F.col("first")).alias("f"))).alias("b"))
    out = files.select(repo).union(first_commits.select(repo)).distinct().join(best, repo, "left")
    confidence = F.when(F.col("b").isNull() | (F.col("b.score") >= CERTAIN), "high").when(F.col("b.score") >= LIKELY, "medium").otherwise("low")
    return out.select(repo, "b.reference", confidence.alias("confidence"), F.coalesce("b.score", F.lit(0)).alias("score"), F.transform("b.e", lambda x: x["said"]).alias("evidence"))
