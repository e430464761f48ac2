"""Facts about repositories from their sources alone: system calls and their dispatch, key files, signs of several processors.

Sources are scanned a file at a time, token by token, so comments and strings tell nothing; what was found goes on as
narrow rows. An arm of a dispatch counts only right inside the braces of a match or switch. Facts say what the sources
show, not what runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions.lexer import lex
from kinfolk.operators.comparison import first_strategy
from kinfolk.operators.matching import bounded
from kinfolk.runtime import sized_join, stored

#: The standard set of system calls, folders whose sources do not count, key files, files that may say how
#: many processors there are, names of that constant, and names of what wakes further processors.
STANDARD = (
    "fork clone exec execve exit exit_group wait wait4 waitpid getpid getppid gettid kill sigaction sigprocmask sigreturn "
    "sched_yield nanosleep clock_gettime read write open openat close lseek stat fstat fstatat mkdir mkdirat unlink unlinkat "
    "rename renameat getcwd chdir getdents64 dup dup2 dup3 fcntl ioctl mmap munmap mprotect brk pipe pipe2 socket bind listen "
    "accept connect sendto recvfrom uname times gettimeofday getuid getgid"
).split()
SKIPPED = ("vendor", "third_party", "target", ".git", "node_modules")
KEY_FILES = (
    "kernel/syscall.c", "kernel/syscall.rs", "src/syscall.rs",
    "kernel/main.c", "kernel/main.rs", "src/main.rs",
    "kernel/proc.c", "kernel/task.rs", "src/task/mod.rs",
    "kernel/vm.c", "kernel/mm.c", "src/mm/mod.rs",
    "kernel/trap.c", "src/trap/mod.rs",
)
PROCESSOR_FILES = ("kernel/param.h", "include/param.h", "src/config.rs", "Makefile", "Kbuild", "Kconfig")
PROCESSOR_NAMES = ("NCPU", "CPUS", "NR_CPUS", "NUMCPU")
WAKERS = ("startothers", "hart_start", "secondary_start", "smp_init", "start_secondary", "cpu_up", "hart_wakeup")
#: Strategies of finding system calls in order of trust.
STRATEGIES = ["function_name", "dispatch_table", "macro", "constant_only"]
PLACES, WAKER_PLACES = 6, 3

_TYPE = re.compile(r"(?:int|long|isize_t|ssize_t|size_t|void|uintptr_t|usize|char|bool|u?int\d+(?:_t)?)")
_CALL, _ARM = re.compile(r"(?:SYSCALL|SYS|NR)_[A-Z0-9_]+", re.I), re.compile(r"SYS_[A-Z0-9_]+")
_MACROS = ("syscall_define", "define_syscall")
_LEADING = {"rust": ("pub",), "c": ("static", "unsigned")}


def lines_of(tokens: list[tuple[str, str, int]], text: str) -> list[int]:
    """The line of each token."""
    out, line, at = [], 1, 0
    for _, _, place in tokens:
        line += text.count("\n", at, place)
        at = place
        out.append(line)
    return out


def defined(tokens: list[str], lang: str) -> str | None:
    """The function that a line begins to declare."""
    rest = list(tokens)
    for word in _LEADING.get(lang, ()):
        if rest[:1] == [word]:
            rest = rest[1:]
    if len(rest) < 3 or rest[2] != "(":
        return None
    return rest[1] if (rest[0] == "fn" if lang == "rust" else _TYPE.fullmatch(rest[0])) else None


def scan(text: str, lang: str) -> list[tuple[str, str, int]]:
    """What a source shows, as kind, name and line: function (declared), arm (of a dispatch), mention (of a system call's
    constant), macro (that makes one), constant (defined) and called."""
    tokens = lex(text)
    lines = lines_of(tokens, text)
    words = [t for _, t, _ in tokens]
    out: list[tuple[str, str, int]] = []
    braces: list[bool] = []
    dispatch, depth, marked = None, 0, False
    for k, word in enumerate(words):
        first = k == 0 or lines[k - 1] != lines[k]
        if first:
            end = k
            while end < len(words) and lines[end] == lines[k] and end < k + 6:
                end += 1
            if name := defined(words[k:end], lang):
                out.append(("function", name, lines[k]))
        if tokens[k][0] == "name":
            after, before = words[k + 1 : k + 2], words[k - 1] if k else ""
            if word in ("match", "switch"):
                dispatch = depth
            if _CALL.fullmatch(word):
                out.append(("mention", word, lines[k]))
                inside = bool(braces) and braces[-1] and _ARM.fullmatch(word)
                if inside and (first and after == ["=>"] or before == "case" and words[k - 2 : k - 1] != ["="] and after == [":"] and (k < 2 or lines[k - 2] != lines[k])):
                    out.append(("arm", word, lines[k]))
                if before in ("const", "static") and after in ([":"], ["="]):
                    out.append(("constant", word, lines[k]))
            if after == ["("]:
                out.append(("called", word, lines[k]))
            if word in _MACROS and words[k + 1 : k + 3] == ["!", "("] and tokens[k + 3 : k + 4] and tokens[k + 3][0] == "name":
                out.append(("macro", words[k + 3], lines[k]))
            if marked and before == "fn":
                out.append(("macro", word, lines[k]))
                marked = False
        marked = marked or words[k - 3 : k + 1] == ["#", "[", "syscall", "]"]
        if word in "([" and len(word) == 1:
            depth += 1
        elif word in ")]" and len(word) == 1:
            depth -= 1
        elif word == "{":
            braces.append(dispatch is not None and dispatch == depth)
            dispatch = None
        elif word == "}" and braces:
            braces.pop()
        elif word == ";":
            dispatch = None
    return out


_FOUND = pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int32())])


def language_of(path: Column) -> Column:
    return F.when(path.endswith(".rs"), "rust").when(path.rlike(r"\.[ch]$"), "c")


def own_sources(files: DataFrame) -> DataFrame:
    """Files outside the folders that do not count: repo, path, text."""
    return files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


def scanned(files: DataFrame) -> DataFrame:
    """repo, path, kind, name, line of what C and Rust sources show (see scan); a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            found = [[dict(zip(("kind", "name", "line"), x)) for x in scan(t or "", lang)] for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("repo"), b.column("path"), pa.array(found, pa.list_(_FOUND))], ["repo", "path", "found"])

    rows = own_sources(files).withColumn("lang", language_of(F.col("path"))).filter("lang is not null").select("repo", "path", "lang", "text")
    out = rows.mapInArrow(run, "repo string, path string, found array<struct<kind:string,name:string,line:int>>")
    return stored(out.select("repo", "path", F.explode("found").alias("f")).select("repo", "path", "f.*"), "scanned")


def call_name(name: Column, heads: str = "syscall|sys") -> Column:
    """The system call that a function is named after (with heads of constants, a constant); null for other names."""
    return F.nullif(F.lower(F.regexp_extract(name, rf"^(?:{heads})_(\w+)$", 1)), F.lit(""))


CONSTANT_HEADS = "(?i:syscall|sys|nr)"


def implemented_calls(found: DataFrame) -> DataFrame:
    """repo, name: standard system calls that functions are named after."""
    rows = found.filter("kind = 'function'").select("repo", call_name(F.col("name")).alias("name"))
    return rows.filter(F.col("name").isin(*STANDARD)).distinct()


def first_places(rows: DataFrame, most: int) -> DataFrame:
    """repo, places: path:line of the first row of each file, for the first files by path."""
    by = rows.groupBy("repo", "path").agg(F.min("line").alias("line"))
    kept = by.withColumn("_r", F.row_number().over(W.partitionBy("repo").orderBy("path"))).filter(F.col("_r") <= most)
    return kept.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat("path", F.lit(":"), F.col("line").cast("string")).alias("at")))), lambda x: x["at"]).alias("places"))


def dispatch_arms(found: DataFrame) -> DataFrame:
    """repo, arms (distinct constants), places (of the first arms of six files)."""
    rows = found.filter("kind = 'arm'")
    return rows.groupBy("repo").agg(F.count_distinct("name").alias("arms")).join(first_places(rows, PLACES), "repo")


def key_files(files: DataFrame) -> DataFrame:
    """repo, path, bytes, lines of the key files there are; without one about system calls, the first file syscall.c too."""
    text = F.coalesce("text", F.lit(""))
    size = lambda df: df.select("repo", "path", F.octet_length(text).alias("bytes"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    named = stored(size(files.filter(F.col("path").isin(*KEY_FILES))), "key_files")
    about = named.filter(F.contains("path", F.lit("syscall"))).select("repo").distinct()
    other = size(own_sources(files).filter(F.element_at(F.split("path", "/"), -1) == "syscall.c")).groupBy("repo").agg(F.min(F.struct("path", "bytes", "lines")).alias("f"))
    return named.unionByName(other.join(about, "repo", "left_anti").select("repo", "f.*")).dropDuplicates(["repo", "path"])


def _line_at(text: Column, place: Column) -> Column:
    before = F.substring(text, F.lit(1), place - 1)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def processors(files: DataFrame) -> DataFrame:
    """repo, numcpu (of the first file that says it), wakeup (whether some source names a waker), places (where)."""
    names = "|".join(PROCESSOR_NAMES)
    forms = [rf"(?m)^[ \t]*#?[ \t]*define[ \t]+(?:{names})[ \t]+(\d+)", rf"\bconst[ \t]+(?:{names})[ \t]*:[ \t]*\w+[ \t]*=[ \t]*(\d+)"]
    value, place = F.lit(None).cast("string"), F.lit(0)
    for form in reversed(forms):
        hit = F.regexp_instr("text", F.lit(form))
        value = F.when(hit > 0, F.regexp_extract("text", form, 1)).otherwise(value)
        place = F.when(hit > 0, hit).otherwise(place)
    variable = r"(?m)^[ \t]*CPUS[ \t]*[:?]?=[ \t]*(\d+)"
    last = (F.col("path") == "Makefile") & (F.regexp_instr("text", F.lit(variable)) > 0)
    rank = F.array_position(F.array(*map(F.lit, PROCESSOR_FILES)), F.col("path"))
    asked = files.filter(F.col("path").isin(*PROCESSOR_FILES))
    said = asked.select("repo", "path", value.try_cast("long").alias("n"), _line_at(F.col("text"), place).alias("line"), rank.alias("r")).filter("n is not null")
    said = said.unionByName(asked.filter(last).select("repo", "path", F.regexp_extract("text", variable, 1).try_cast("long").alias("n"), _line_at(F.col("text"), F.regexp_instr("text", F.lit(variable))).alias("line"), F.lit(len(PROCESSOR_FILES) + 1).cast("long").alias("r")))
    count = said.groupBy("repo").agg(F.min_by(F.struct("n", "path", "line"), "r").alias("c"))
    waker = rf"\b(?:{'|'.join(WAKERS)})\b"
    woken = own_sources(files).filter(F.col("path").rlike(r"\.(?:c|rs|h|S)$")).select("repo", "path", F.regexp_instr("text", F.lit(waker)).alias("at"), "text").filter("at > 0")
    woken = first_places(woken.select("repo", "path", _line_at(F.col("text"), F.col("at")).alias("line")), WAKER_PLACES)
    met = count.join(woken, "repo", "full_outer")
    own = F.when(F.col("c").isNotNull(), F.array(F.concat("c.path", F.lit(":"), F.col("c.line").cast("string")))).otherwise(F.array().cast("array<string>"))
    return met.select("repo", F.col("c.n").alias("numcpu"), F.col("places").isNotNull().alias("wakeup"), F.slice(F.concat(own, F.coalesce("places", F.array().cast("array<string>"))), 1, WAKER_PLACES).alias("places"))


def syscall_sources(found: DataFrame) -> DataFrame:
    """repo, name, strategy, source, path, line: each system call once, by the strategy that is most to be trusted: a
    function of its name (do_ names only if some function about system calls calls them in their repository), a constant
    in a file of dispatchers, a macro, a constant that is only defined."""
    functions = found.filter("kind = 'function'").select("repo", "path", F.col("name").alias("source"), "line")
    handlers = functions.filter(F.lower("source").rlike("syscall|sys_call|trap_handler")).select("repo", "path").distinct()
    handlers = stored(handlers, "dispatchers")
    direct = functions.select("repo", call_name(F.col("source")).alias("name"), F.lit("function_name").alias("strategy"), "source", "path", "line")
    called = sized_join(found.filter("kind = 'called'"), handlers, ["repo", "path"], "left_semi").select("repo", F.col("name").alias("source")).distinct()
    do = functions.filter(F.startswith("source", F.lit("do_"))).join(called, ["repo", "source"], "left_semi")
    do = do.select("repo", F.lower(F.substring("source", 4, 1 << 20)).alias("name"), F.lit("function_name").alias("strategy"), "source", "path", "line")
    of = lambda rows, strategy: rows.select("repo", F.coalesce(call_name(F.col("name"), CONSTANT_HEADS), F.lower("name")).alias("name"), F.lit(strategy).alias("strategy"), F.col("name").alias("source"), "path", "line")
    table = of(sized_join(found.filter("kind = 'mention'"), handlers, ["repo", "path"], "left_semi"), "dispatch_table")
    every = direct.unionByName(do).unionByName(table).unionByName(of(found.filter("kind = 'macro'"), "macro")).unionByName(of(found.filter("kind = 'constant'"), "constant_only"))
    every = every.filter("name is not null").withColumn("_k", F.struct("repo", "name"))
    return first_strategy(every, "_k", STRATEGIES, "path", "line", "source").select("_k.*", "strategy", "source", "path", "line")
