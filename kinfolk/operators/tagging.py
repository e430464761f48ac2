"""Tags of pairs that similarity alone does not explain: upstream code, code that an interface fixes, masked assembly.

Rules are rows of kind and pattern; all rules of a kind become one condition, and the conditions stand in a ladder of which
the first that holds is the basis. A place or a name is a hint; what takes a pair out is proof in the code: the whole
token sequence of an explicit upstream, a body that only hands its arguments on, constants that make up the whole of a
short mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions.code import boilerplate_assembly, cross_architecture, isa
from kinfolk.functions.paths import cross_language, has_segments
from kinfolk.functions.text import let
from kinfolk.runtime import sized_join, stored

#: Magic numbers of file systems, numbers of signals, those of timers, and how words about them begin.
MAGIC = ("0xef53", "0x2011bab0", "0xf2f52010", "0x9fa0", "0x01021994", "0x58465342", "0x6969", "0x4d44", "0x73717368")
SIGNALS = ("1", "2", "3", "4", "6", "8", "9", "11", "13", "14", "15", "17", "18", "19", "20", "26", "27", "28", "29", "30")
TIMERS = ("14", "26", "27")
SIGNAL_WORDS = ("sig", "timer", "alarm", "itimer")
#: Relations of two functions that are the same one, and the roots of known upstreams.
SAME_FUNCTION = ("exact_counterpart", "same_name_code_clone", "compatible_renamed", "code_clone_renamed")
ROOTS = ("arceos", "rcore", "rcore-v3", "xv6-riscv", "ucore", "os_kernel_lab")
#: Rules of interface code. kind is path (folders and files that are no product code), name (conversions by
#: name), context (folders where adapters are) or adapter (names adapters have).
RULES = [
    ("path", "build.rs"), ("path", "/scripts/"), ("path", "/tools/"), ("path", "/deptool/"), ("path", "/bwbench_client/"),
    ("path", "/examples/"), ("path", "/tests/"), ("path", "/benches/"),
    ("path", "ctypes/"), ("path", "/shim/"), ("path", "/musl/"), ("path", "/libc/"), ("path", "/glibc/"), ("path", "/axlibc/c/"), ("path", "/vdso/"),
    ("name", "_to_kstat$"), ("name", "from_kstat$"), ("name", "_to_stat$"), ("name", "from_stat$"), ("name", "^dummy_stat_"),
    ("name", "^metadata_to_"), ("name", "_to_errno$"), ("name", "errno_to_"), ("name", "_syscall$"),
    ("context", "api/src/file/"), ("context", "api/src/syscall/"),
    ("adapter", "^sys_"), ("adapter", "robust"), ("adapter", "futex"),
]


def code_lines(code: Column) -> Column:
    """The stripped lines of a text that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(code, F.lit("")), r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r"))), lambda x: x != "")


def has_word(text: Column, *words: str) -> Column:
    return text.rlike(rf"\b(?:{'|'.join(words)})\b")


def signal_numbers(code: Column) -> Column:
    """Whether code speaks of signals and holds the three timers or four of the signals."""
    text = F.coalesce(code, F.lit(""))
    about = F.exists(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^(?:" + "|".join(SIGNAL_WORDS) + ")"))
    held = lambda n, of: F.size(F.array_intersect(n, F.array(*map(F.lit, of))))
    return about & let(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2})\b"), 1), lambda n: (held(n, TIMERS) == len(TIMERS)) | (held(n, SIGNALS) >= 4))


def standard_constants(code: Column) -> Column:
    """Whether code holds a file system's magic number, or the numbers of signals where it speaks of them."""
    low = F.lower(F.coalesce(code, F.lit("")))
    return F.exists(F.array(*map(F.lit, MAGIC)), lambda m: F.contains(low, m)) | signal_numbers(code)


def mechanical_adapter(code: Column) -> Column:
    """Whether a body only checks, converts and hands on its arguments: at most 32 lines, no loop and no branch but one if,
    at most four statements, and a call, a conversion or a structure built."""

    def judge(lines: Column) -> Column:
        low = F.lower(F.array_join(lines, "\n"))
        opened, closed = F.locate("{", low), F.length(low) - F.locate("}", F.reverse(low)) + 1
        whole = (opened > 0) & (F.locate("}", low) > 0) & (opened < closed)
        body = F.when(whole, F.substring(low, opened + 1, closed - opened - 1)).otherwise("")
        called = F.filter(F.regexp_extract_all(body, F.lit(r"\b([a-z_]\w*)\s*\("), 1), lambda x: ~x.isin("if", "while", "for", "match"))
        converts = body.rlike(r"\bas\s+[a-z_]") | body.rlike(r"\b(?:into|from|try_from)\s*\(")
        builds = body.rlike(r"(?:=|return|=>|\()\s*[a-z_]\w*\s*\{")
        simple = ~has_word(low, "for", "while", "loop", "match", "switch", "case", "await", "yield") & (F.regexp_count(low, F.lit(r"\bif\b")) <= 1)
        few = F.length(body) - F.length(F.replace(body, F.lit(";"), F.lit(""))) <= 4
        return (F.size(lines) > 0) & (F.size(lines) <= 32) & simple & few & ((F.size(called) > 0) | converts | builds)

    return let(code_lines(code), judge)


def constants_dominate(code: Column) -> Column:
    """Whether standard constants are what a short mapping is about, not something a longer body happens to hold."""
    fields = F.regexp_count(F.coalesce(code, F.lit("")), F.lit(r"(?m)^\s*[A-Za-z_]\w*\s*:\s*"))

    def judge(lines: Column) -> Column:
        low = F.lower(F.array_join(lines, "\n"))
        mapping = has_word(low, "match", "switch") | (F.size(lines) <= 20)
        single = (F.size(lines) <= 8) | (fields >= 5) & (F.size(lines) <= 35)
        short = (F.size(lines) > 0) & (F.size(lines) <= 45) & ~has_word(low, "for", "while", "loop")
        return short & F.when(signal_numbers(code), mapping).otherwise(single)

    return standard_constants(code) & let(code_lines(code), judge)


def _norm_path(path: Column) -> Column:
    return F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/"))


def _any(rules: list[tuple[str, str]], kind: str, holds) -> Column:
    out = F.lit(False)
    for of, pattern in rules:
        if of == kind:
            out = out | holds(pattern)
    return out


def abi_basis(path: Column, name: Column, code: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Why an interface fixes what a function is like, the first of: the path, the name, constants, a thin adapter; else null."""
    at, low = _norm_path(path), F.lower(F.coalesce(name, F.lit("")))
    on_path = lambda p: has_segments(at, F.lit("/".join(x for x in p.replace("\\", "/").lower().split("/") if x)))
    hinted = _any(rules, "context", on_path) | _any(rules, "adapter", low.rlike)
    return (
        F.when(_any(rules, "path", on_path), "non_product_or_compatibility_path")
        .when(_any(rules, "name", low.rlike), "explicit_abi_conversion")
        .when(constants_dominate(code), "standard_mapping_dominates")
        .when(hinted & mechanical_adapter(code), "thin_abi_adapter")
    )


def source_evidence(p: DataFrame) -> Column:
    """Whether a pair's candidate may be shown as a source: both are one function, and their code says so.

    Columns: relation, same_name, fingerprint, matched, line_sim, literals, seg_hits, q_total, c_total; null is none.
    """
    number = lambda c: F.coalesce(p[c].cast("double"), F.lit(0.0))
    flag = lambda c: F.coalesce(p[c], F.lit(False))
    one = F.coalesce(p["relation"].isin(*SAME_FUNCTION), F.lit(False)) | flag("same_name") & (number("matched") >= 5) & (number("line_sim") >= 0.5)
    cover = F.least(number("seg_hits") / F.greatest(number("q_total"), F.lit(1.0)), number("seg_hits") / F.greatest(number("c_total"), F.lit(1.0)))
    segments = (number("seg_hits") > 0) & (number("q_total") > 0) & (number("c_total") > 0) & (cover >= 0.3)
    return one & (flag("fingerprint") | (number("matched") >= 5) & (number("line_sim") >= 0.35) | (number("matched") >= 3) & (number("literals") > 0) | segments)


def _tokens(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), r"[\W_]+"), lambda x: x != "")


def key_of(name: Column) -> Column:
    """A root's name by its letters and digits (ASCII; see paths.root_key for all others)."""
    return F.array_join(_tokens(name), "")


def _key(root: str) -> str:
    return "".join(c for c in root.lower() if c.isalnum())


def root_place(path: Column, roots: tuple[str, ...] = ROOTS) -> Column:
    """The first part of a path that names an upstream's root: at (from 1), key, and rest, the path below it; null without."""
    parts = F.split(_norm_path(path), "/")
    keys = F.array(*(F.lit(_key(r)) for r in roots))
    found = let(parts, lambda p: F.transform(F.filter(F.transform(p, lambda x, i: F.struct((i + 1).alias("at"), key_of(x).alias("key"))), lambda s: F.array_contains(keys, s["key"])), lambda s: F.struct(s["at"].alias("at"), s["key"].alias("key"), F.array_join(F.slice(p, s["at"] + 1, F.size(p)), "/").alias("rest"))))
    return F.get(found, F.lit(0))


def upstream_of(repo: Column, roots: tuple[str, ...] = ROOTS) -> Column:
    """The key of the root that a baseline repository's name begins with, the longest; null without."""
    tokens = _tokens(F.element_at(F.split(F.replace(F.coalesce(repo, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1))
    bare = F.when(F.get(tokens, F.lit(0)) == "baseline", F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    out = F.lit(None).cast("string")
    words = {r: [w for w in "".join(c if c.isalnum() else " " for c in r.lower()).split()] for r in roots}
    for root in sorted(roots, key=lambda r: len(words[r])):
        begins = F.slice(bare, F.lit(1), F.lit(len(words[root]))) == F.array(*map(F.lit, words[root]))
        out = F.when(begins, F.lit(_key(root))).otherwise(out)
    return out


def tag_upstream(pairs: DataFrame, references: DataFrame, layout: DataFrame, roots: tuple[str, ...] = ROOTS, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pairs with upstream_hint, upstream, upstream_basis, abi_basis and source_valid.

    pairs: q_id, q_path, q_name, q_code, c_path, c_name, library, false_positive, kept_more (more than every baseline shows)
    and the columns of source_evidence. references: q_id, repo, the explicit upstreams that have the whole token sequence of
    a query. layout: root, container, child: folders that an upstream itself has. Pairs of libraries and false positives
    get no tag. A hint is a root of which both sides have the same file, or whose own folders the query lies in while the
    pair's code is alike; it becomes upstream only by a reference to the same root.
    """
    label = F.create_map(*(x for r in roots for x in (F.lit(_key(r)), F.lit(r.lower().strip()))))
    rows = pairs.withColumn("_q", root_place(F.col("q_path"), roots)).withColumn("_c", root_place(F.col("c_path"), roots))
    c_path, rest = _norm_path(F.col("c_path")), F.col("_q.rest")
    below = F.coalesce(rest != "", F.lit(False))
    same_root = F.coalesce(F.col("_c.key") == F.col("_q.key"), F.lit(False))
    tail = (F.col("_c").isNull() | same_root) & (c_path.endswith(F.concat(F.lit("/"), rest)) | (c_path == rest))
    paired = below & F.coalesce(same_root & (F.col("_c.rest") == rest) | tail, F.lit(False))
    # folders of an upstream: neighbours on the query's path below the root, looked up by equality
    steps = F.split("_q.rest", "/")
    inside = rows.filter(below).select("q_id", F.col("_q.key").alias("key"), F.explode(F.zip_with(F.slice(steps, F.lit(1), F.size(steps) - 1), F.slice(steps, F.lit(2), F.size(steps) - 1), lambda a, b: F.struct(a.alias("container"), b.alias("child")))).alias("x")).select("q_id", "key", "x.*")
    known = stored(layout.select(key_of(F.col("root")).alias("key"), F.lower("container").alias("container"), F.lower("child").alias("child")).distinct(), "layout")
    framework = stored(sized_join(inside, known, ["key", "container", "child"], "left_semi").select("q_id").distinct().withColumn("_framework", F.lit(True)), "framework")
    proofs = stored(references.select("q_id", upstream_of(F.col("repo"), roots).alias("_proof")).filter("_proof is not null").groupBy("q_id").agg(F.collect_set("_proof").alias("_proofs")), "proofs")  # at most one a root
    rows = sized_join(sized_join(rows, framework, "q_id", "left"), proofs, "q_id", "left")
    own = F.filter(F.split(_norm_path(F.col("q_path")), "/"), lambda x: x.isin(*(r.lower() for r in roots)))
    evidence = source_evidence(rows)
    tagged = F.col("library").isNull() & F.col("false_positive").isNull()
    hint = F.when(paired, label[F.col("_q.key")]).when(F.coalesce("_framework", F.lit(False)) & evidence, F.coalesce(F.get(own, F.lit(0)), F.lit("upstream")))
    rows = rows.withColumn("upstream_hint", F.when(tagged, hint)).withColumn("_paired", paired).withColumn("_evidence", evidence)
    proven = F.col("upstream_hint").isNotNull() & F.coalesce(F.array_contains("_proofs", key_of(F.col("upstream_hint"))), F.lit(False)) & ~F.coalesce("kept_more", F.lit(False))
    basis = F.when(proven, "complete_upstream_source_tokens").when(F.col("upstream_hint").isNotNull(), F.when(F.col("_paired"), "paired_relative_path_unverified").otherwise("framework_path_with_code_evidence_unverified"))
    rows = rows.withColumn("upstream", F.when(proven, F.col("upstream_hint"))).withColumn("upstream_basis", basis)
    rows = rows.withColumn("abi_basis", F.when(tagged & F.col("upstream").isNull(), abi_basis(F.col("q_path"), F.col("q_name"), F.col("q_code"), rules)))
    named = (F.coalesce("q_name", F.lit("")) != "") & F.coalesce(F.col("q_name") == F.col("c_name"), F.lit(False))
    valid = F.when(F.col("upstream").isNotNull(), True).when(F.col("abi_basis").isNotNull(), named & F.col("_evidence")).when(F.col("upstream_hint").isNotNull(), False)
    return rows.withColumn("source_valid", valid).drop("_q", "_c", "_framework", "_proofs", "_paired", "_evidence")


def masked_assembly(q_code: Column, c_code: Column, exact: Column, renamed: Column) -> Column:
    """Whether two functions of different architectures are alike only because masking hides their instructions: both wrap
    assembly, have no loop and no branch table, and are short, or matched at least three times as often masked as exactly."""
    wraps = lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("asm!"))
    controls = lambda c: has_word(F.coalesce(c, F.lit("")), "for", "while", "loop", "match", "switch")
    e, r = F.coalesce(exact, F.lit(0)), F.coalesce(renamed, F.lit(0))
    by_mask = (r >= 3) & (r >= 3 * F.greatest(e, F.lit(1)))
    short = (F.size(code_lines(q_code)) <= 10) & (F.size(code_lines(c_code)) <= 10)
    return wraps(q_code) & wraps(c_code) & ~controls(q_code) & ~controls(c_code) & (by_mask | short)


def tag_false_positives(pairs: DataFrame) -> DataFrame:
    """pairs with the signals boilerplate_signal, cross_arch_signal, cross_lang_signal, and false_positive, the reason a
    pair is taken out (only cross_arch can be one: signals alone prove nothing). Pairs of a library get none.

    pairs: q_path, q_name, q_code, q_lang, c_path, c_code, c_lang, exact_lines, renamed_lines, library.
    """
    own = F.col("library").isNull()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    assembly = (low("q_lang") == "asm") | low("q_path").rlike(r"\.(?:s|asm)$")
    speaks = lambda p: F.when((low(f"{p}_lang") == "asm") | F.contains(F.col(f"{p}_code"), F.lit("asm!")) | low(f"{p}_path").rlike(r"\.(?:s|asm)$"), F.col(f"{p}_code"))
    across = cross_architecture(isa(F.col("q_path"), speaks("q")), isa(F.col("c_path"), speaks("c")))
    spoken = low("q_lang").isin("rust", "c") & low("c_lang").isin("rust", "c") & cross_language(F.col("q_lang"), F.col("c_lang"))
    signal = lambda c: own & F.coalesce(c, F.lit(False))
    out = pairs.withColumn("boilerplate_signal", signal(assembly & boilerplate_assembly(F.col("q_code"), F.col("q_name")))).withColumn("cross_arch_signal", signal(across)).withColumn("cross_lang_signal", signal(spoken))
    masked = F.col("cross_arch_signal") & masked_assembly(F.col("q_code"), F.col("c_code"), F.col("exact_lines"), F.col("renamed_lines"))
    return out.withColumn("false_positive", F.when(masked, "cross_arch"))
