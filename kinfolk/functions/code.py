"""Functions over source code as Column expressions: stubs, instruction sets, assembly, ranges of lines and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfolk.functions.text import let

#: Names of instruction sets on paths, and instructions that only one of them has, by their manuals.
ISA_PATHS = {"riscv": ("riscv", "rv64"), "loongarch": ("loongarch", "la64"), "x86": ("x86_64", "x86", "i386"), "aarch64": ("aarch64", "arm64")}
ISA_ONLY = {
    "riscv": ("csrr", "csrw", "csrrw", "sfence.vma", "mret", "sret", "auipc", "ecall"),
    "loongarch": ("csrrd", "csrwr", "csrxchg", "ertn", "invtlb", "pcaddu12i", "tlbwr"),
    "x86": ("iretq", "lgdt", "lidt", "cpuid", "wrmsr", "rdmsr", "invlpg", "swapgs"),
    "aarch64": ("eret", "tlbi", "adrp", "dsb", "isb", "msr", "mrs"),
}
#: Mnemonics that only move data between registers, memory and control registers: whole words, and beginnings of families.
MOVE_WORDS = ("li", "la", "mv", "str", "ldr", "stp", "ldp", "push", "pop", "pushq", "popq", "csrr", "csrw", "csrrd", "csrwr", "csrxchg", "csrrw", "mrs", "msr", "move")
MOVE_FAMILIES = ("mov", "ld.", "st.", "ldur", "stur")
RISCV_WIDTHS = tuple(f"{op}{width}" for op in "ls" for width in "bhwdx") + tuple(f"f{op}{width}" for op in "ls" for width in "wd")


def mnemonic(line: Column) -> Column:
    return F.lower(F.regexp_extract(line, r"^([^ \t,]*)", 1))


def is_move(line: Column) -> Column:
    word = mnemonic(line)
    family = F.lit(False)
    for head in MOVE_FAMILIES:
        family = family | word.startswith(head)
    return word.isin(*MOVE_WORDS, *RISCV_WIDTHS) | family


def is_stub(code: Column) -> Column:
    """Whether a body is empty or only gives back a constant: what stands between the outer braces is at most one token
    besides return, a sign and semicolons, and that is a number, a truth value, a null or a name in capitals."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(code, F.lit("")), r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    last = F.length(bare) - F.locate("}", F.reverse(bare)) + 1
    body = F.substring(bare, F.locate("{", bare) + 1, F.greatest(last - F.locate("{", bare) - 1, F.lit(0)))
    said = F.filter(F.regexp_extract_all(body, F.lit(r"([A-Za-z0-9_.]+|\S)"), 1), lambda x: ~x.isin("return", ";", "+", "-"))
    one = F.coalesce(F.get(said, F.lit(0)), F.lit(""))
    constant = one.rlike("^[0-9]") | (F.upper(one) == one) & one.rlike("^[A-Z]") | F.lower(one).isin("true", "false", "null", "nullptr", "none")
    return (F.locate("{", bare) > 0) & (F.locate("}", bare) > 0) & ((F.size(said) == 0) | ((F.size(said) == 1) & constant))


def isa(path: Column, code: Column) -> Column:
    """The instruction set that path and code agree on, or the only one that either tells; null where they differ.

    Code speaks if one set has signals or the strongest has twice those of the next.
    """
    p = F.lower(F.coalesce(path, F.lit("")))
    by_path = F.filter(F.array(*(F.when(p.rlike("|".join(w)), k) for k, w in ISA_PATHS.items())), lambda x: x.isNotNull())
    only = F.when(F.size(by_path) == 1, by_path[0])
    counts = F.array(*(F.struct(F.size(F.filter(F.split(F.lower(F.coalesce(code, F.lit(""))), r"[\s,;()]+"), lambda x: x.isin(*w))).alias("n"), F.lit(k).alias("isa")) for k, w in ISA_ONLY.items()))
    ranked = let(F.sort_array(counts, asc=False), lambda c: F.when((c[0]["n"] > 0) & (c[0]["n"] >= 2 * c[1]["n"]), c[0]["isa"]))
    return F.when(only.isNull(), ranked).when(ranked.isNull() | (only == ranked), only)


def cross_architecture(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(False))


def assembly_lines(text: Column) -> Column:
    """Lines without comments, blanks dropped."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.btrim(F.regexp_replace(x, r"(//|#|;).*$", ""), F.lit(" \t")))
    return F.filter(bare, lambda x: x != "")


def instructions(text: Column) -> Column:
    """Assembly lines other than labels and directives."""
    return F.filter(assembly_lines(text), lambda x: ~x.endswith(":") & ~x.startswith("."))


def normalize_assembly(text: Column) -> Column:
    """Assembly with STR for strings and number classes for numbers; registers and mnemonics stay."""

    def line(x: Column) -> Column:
        y = F.regexp_replace(x, r'"[^"]*"', "STR")
        y = F.regexp_replace(y, "0[xX][0-9a-fA-F]+", "INT_HEX")
        y = F.regexp_replace(F.regexp_replace(y, r"\b0*([0-9]|10)\b", "INT_S"), r"\b[0-9]+\b", "INT_M")
        return F.regexp_replace(y, r"\s+", " ")

    return F.array_join(F.transform(assembly_lines(text), line), "\n")


def assembly_features(text: Column) -> Column:
    """Sorted distinct mnemonics."""
    return F.array_sort(F.array_distinct(F.transform(instructions(text), lambda x: F.concat(F.lit("op:"), F.lower(F.regexp_extract(x, r"^([^ \t,]*)", 1))))))


def boilerplate_assembly(text: Column, name: Column, most: float = 0.8, named: float = 0.5, least: int = 3) -> Column:
    """Whether moves make up most instructions, or half of those of a routine named for switching or traps."""

    def judge(lines: Column) -> Column:
        share = F.size(F.filter(lines, is_move)) / F.greatest(F.size(lines), F.lit(1))
        bare = F.lower(F.replace(F.coalesce(name, F.lit("")), F.lit("_"), F.lit("")))
        hit = bare.rlike("^(switch|trap|swtch|save|restore|contextswitch|taskswitch|alltraps)")
        return (F.size(lines) >= least) & ((share >= most) | (hit & (share >= named)))

    return let(instructions(text), judge)


def holds_anchor(code: Column, anchor: Column) -> Column:
    """Whether an anchor is in the code: a name as a whole word; anything else as it is, with white space folded, or without."""
    fold = lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))
    tight = lambda x: F.regexp_replace(x, r"\s+", "")
    name = anchor.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    word = F.exists(F.split(code, r"[^A-Za-z0-9_]+"), lambda x: x == anchor)
    loose = F.contains(code, anchor) | ((F.length(fold(anchor)) >= 2) & F.contains(fold(code), fold(anchor))) | ((F.length(tight(anchor)) >= 2) & F.contains(tight(code), tight(anchor)))
    return F.when(name, word).otherwise(loose)


def line_chunks(n: Column, size: int = 10) -> Column:
    """Ranges (start, stop), from 1, of size lines over n lines."""
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))
    return F.when(n < 1, F.array().cast("array<struct<start:int,stop:int>>")).otherwise(F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), F.least(n, s + size - 1).cast("int").alias("stop"))))


def merge_short(ranges: Column, least: int = 4) -> Column:
    """Ranges in order, short ones joined with the range before them (a short first one with the next)."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        short = (r["stop"] - r["start"] + 1 < least) | (last["stop"] - last["start"] + 1 < least)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))))
        return F.when((F.size(out) > 0) & short, joined).otherwise(F.concat(out, F.array(F.struct(r["start"].alias("start"), r["stop"].alias("stop")))))

    first = F.slice(F.array_sort(F.array_distinct(ranges)), 1, 1)
    return F.when(F.size(ranges) == 0, empty).otherwise(F.aggregate(F.slice(F.array_sort(F.array_distinct(ranges)), 2, F.size(ranges)), first, add))


def token_windows(tokens: Column, size: int = 512, stride: int = 384) -> Column:
    """Windows of size tokens every stride; one window where all fit; the last one ends with the tokens."""

    def cut(t: Column) -> Column:
        last = F.greatest(F.ceil((F.size(t) - size) / stride), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(t, k * stride + 1, size))

    return let(tokens, cut)


def last_status(text: Column, error: str = r"(?i)\berror\b", success: str = r"(?i)\b(finished|success)\b") -> Column:
    """failed or passed by the marker that comes last in a log; unknown without any."""
    after = lambda p: F.length(F.element_at(F.split(text, p), -1))
    has = lambda p: text.rlike(p)
    return F.when(has(error) & (~has(success) | (after(error) < after(success))), "failed").when(has(success), "passed").otherwise("unknown")


#: Tokens of code: comment, string, character, white space, word or number, any other sign.
CODE_TOKEN = r"""(?s)(//[^\n]*|/\*.*?(?:\*/|\z)|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|\s+|\w+|.)"""


def normal_code(code: Column) -> Column:
    """Code without comments, on one line: strings are "STR" and 'STR', whole numbers but 0 and 1 are NUM.

    One pass over its tokens, so what looks like a comment inside a string is part of the string.
    """

    def shown(x: Column) -> Column:
        first = F.substring(x, 1, 1)
        closed = (F.length(x) > 1) & x.endswith(first)
        text = F.when((first == '"') & closed, '"STR"').when((first == "'") & closed, "'STR'")
        return F.when(x.startswith("//") | x.startswith("/*"), "").when(first.rlike(r"\s"), " ").when(text.isNotNull(), text).when(x.rlike("^[0-9]+$") & ~x.isin("0", "1"), "NUM").otherwise(x)

    tokens = F.regexp_extract_all(code, F.lit(CODE_TOKEN), 1)
    return F.btrim(F.regexp_replace(F.array_join(F.transform(tokens, shown), ""), " +", " "))


#: Marks before a comment's own words, and beginnings of licence notes.
COMMENT_MARK = r"(?i)^(?:TODO|FIXME|NOTE|XXX|BUG|HACK|TEMP|WIP|Reference|Source|See|Link)\s*:\s*"
LICENCE = r"(?i)^(?:SPDX-|Copyright\b|Licensed\b|License\b|All rights reserved)"


def comments(code: Column, least: int = 20) -> Column:
    """The distinct comments of a text that say something: no licence notes, at least 20 characters after a mark like TODO.

    Strings are matched first, so that what looks like a comment inside one is none. The words of a comment over several
    lines are joined by single spaces, without slashes and stars at the ends of lines.
    """
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(r'(?s)("(?:[^"\\]|\\.)*+"|/\*.*?\*/|//[^\n]*)'), 1)
    said = lambda x: F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?m)^\s*(?://[/!]?|/\*+!?|\*+(?!/))", ""), r"(?m)\*/\s*$", ""), r"\s+", " "))
    clean = F.transform(F.filter(found, lambda x: x.startswith("/")), said)
    return F.array_distinct(F.filter(clean, lambda x: (F.length(F.btrim(F.regexp_replace(x, COMMENT_MARK, ""))) >= least) & ~F.regexp_replace(x, COMMENT_MARK, "").rlike(LICENCE)))


def comment_overlap(a: Column, b: Column) -> Column:
    """The comments that two texts share word for word, the longest first, then by code point."""
    shared = F.array_intersect(comments(a), comments(b))
    return F.transform(F.sort_array(F.transform(shared, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])


#: Symbols that tell nothing about a repository, and methods that do although they stand in an implementation.
NOISE = ("memset", "memcpy", "memmove", "strlen", "strcmp", "strncpy", "printf", "printk", "kprintf", "panic", "main")
ENTRY_METHODS = ("new", "run", "init", "exec", "spawn")


def symbol_level(lang: Column, name: Column, kind: Column, scope_kind: Column, extras: Column) -> Column:
    """map, index or discard: whether a symbol belongs in a short map of its repository, in the full index, or in neither.

    Tables of conditions by language; what no condition takes is for the index.
    """
    n, k = F.coalesce(name, F.lit("")), F.coalesce(kind, F.lit(""))
    private = n.startswith("_")
    in_map = {
        "c": k.isin("struct", "typedef", "prototype")
        | (k == "macro") & (F.upper(n) == n) & n.rlike("[A-Z]") & (F.length(n) > 2)
        | (k == "function") & ~F.coalesce(F.contains(extras, F.lit("fileScope")), F.lit(False)) & (~private | n.startswith("__")),
        "rust": k.isin("struct", "enum", "trait", "macro")
        | k.isin("function", "method") & F.when(F.coalesce(scope_kind, F.lit("")).isin("implementation", "impl"), n.isin(*ENTRY_METHODS)).otherwise(~private),
    }
    short = F.lit(False)
    for of, condition in in_map.items():
        short = short | (lang == of) & condition
    return F.when(n.isin(*NOISE) | n.startswith("__") & n.endswith("__"), "discard").when(F.coalesce(short, F.lit(False)), "map").otherwise("index")
