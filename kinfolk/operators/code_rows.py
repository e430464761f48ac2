"""Source code as rows: functions of files, their normal forms and fingerprints, and their segments, in Arrow batches.

Each row is one bounded unit of work; nothing is gathered, so files are dealt to tasks as Spark reads them.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfolk.functions import lexer
from kinfolk.functions import text as X
from kinfolk.functions.code import normalize_assembly
from kinfolk.operators.matching import bounded
from kinfolk.operators.recall import exact_fingerprint

LEAST_LINES = 10


def _rows(df: DataFrame, columns: list[str], make: Callable[..., dict], schema: pa.Schema, ddl: str, column: str) -> DataFrame:
    """df with a column of make(*columns) for each row, as a struct or a list of structs."""

    def run(batches):
        for b in bounded(batches):
            made = [make(*x) for x in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made, schema)], [*names, column])

    names = df.columns
    ddl_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{ddl_of}, {column} {ddl}")


def functions(files: DataFrame, least_lines: int = LEAST_LINES) -> DataFrame:
    """A row per function of files (path, lang, text and others): name, kind, start_line, end_line, code for text.

    Functions of fewer lines stay out, macros excepted.
    """
    item = pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("code", pa.string())])

    def make(text: str | None, lang: str | None) -> list[dict]:
        lines = (text or "").split("\n")
        found = lexer.functions(text or "", lang or "")
        return [{"name": n, "kind": k, "start_line": a, "end_line": b, "code": "\n".join(lines[a - 1 : b])} for n, k, a, b in found if k == "macro" or b - a + 1 >= least_lines]

    out = _rows(files, ["text", "lang"], make, pa.list_(item), "array<struct<name:string,kind:string,start_line:int,end_line:int,code:string>>", "_f")
    return out.select(*(c for c in files.columns if c != "text"), F.explode("_f").alias("_f")).select(*(c for c in files.columns if c != "text"), "_f.*")


def described(rows: DataFrame, keep: tuple[str, ...] = (), libraries: tuple[str, ...] = ()) -> DataFrame:
    """rows (lang, code and others) with normal (text without names), normal_hash, strings, features, fingerprint, params,
    behavior and control. Assembly keeps its names and has no strings; other languages have no fingerprint."""
    fields = [("normal", pa.string()), ("strings", pa.list_(pa.string())), ("features", pa.list_(pa.string())), ("fingerprint", pa.string()), ("params", pa.int32()), ("behavior", pa.list_(pa.string())), ("control", pa.list_(pa.string()))]
    kept, libs = frozenset(keep), frozenset(libraries)

    def make(code: str | None, lang: str | None) -> dict:
        code, lang = code or "", lang or ""
        normal, strings = lexer.normalized(code, lang, kept)
        acts, control = lexer.behavior(code, lang)
        return {"normal": normal, "strings": strings, "features": lexer.features(code, lang, libs), "fingerprint": lexer.fingerprint(code, lang), "params": lexer.parameters(code), "behavior": acts, "control": control}

    ddl = "struct<normal:string,strings:array<string>,features:array<string>,fingerprint:string,params:int,behavior:array<string>,control:array<string>>"
    out = _rows(rows, ["code", "lang"], make, pa.struct(fields), ddl, "_d").select(*rows.columns, "_d.*")
    asm = F.col("lang") == "asm"
    empty = F.array().cast("array<string>")
    out = out.withColumn("normal", F.when(asm, normalize_assembly(F.col("code"))).otherwise(F.col("normal"))).withColumn("strings", F.when(asm, empty).otherwise(F.col("strings")))
    return out.withColumn("normal_hash", F.sha2("normal", 256))


def segments(rows: DataFrame) -> DataFrame:
    """A row per segment of functions (lang, code, start_line and others): seg_start and seg_end (lines of the file), segment
    (its code) for code."""
    item = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    out = _rows(rows, ["code", "lang"], lambda code, lang: [{"a": a, "b": b} for a, b in lexer.segments(code or "", lang or "")], pa.list_(item), "array<struct<a:int,b:int>>", "_s")
    out = out.withColumn("_s", F.explode("_s"))
    lines = F.slice(F.split("code", "\n"), F.col("_s.a"), F.col("_s.b") - F.col("_s.a") + 1)
    place = lambda c: (F.col("start_line") + F.col(c) - 1).cast("int")
    return out.select(*(c for c in rows.columns if c != "code"), place("_s.a").alias("seg_start"), place("_s.b").alias("seg_end"), F.array_join(lines, "\n").alias("segment"))


def repository(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of a repository: functions with their normal forms, and files with lines, functions and hashes."""
    found = described(functions(files))
    n = found.groupBy("path").agg(F.count("*").alias("func_count"))
    t = F.col("text")
    hashed = files.select("path", "lang", (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("line_count"), X.norm_hash(t).alias("norm_hash"), X.raw_hash(t).alias("raw_hash"), t.alias("code"))
    hashed = described(hashed).select("path", "lang", "line_count", "norm_hash", "raw_hash", F.col("fingerprint").alias("source_hash"))
    return found, hashed.join(n, "path", "left").withColumn("func_count", F.coalesce("func_count", F.lit(0)))


def normal_matches(rows: DataFrame, is_query: Column) -> DataFrame:
    """Functions of other sources and one language with equal normal forms, the smallest of each source: q_id, source, c_id.

    rows: doc_id, source, lang, normal (see described).
    """
    return exact_fingerprint(rows.select("doc_id", "source", "lang", F.col("normal").alias("text")), is_query)
