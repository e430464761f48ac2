"""Comparison with a reference: sets of names, similarity of bodies, strategies in order of trust, complexity of functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinfolk.functions.code import normal_code
from kinfolk.operators.matching import ratio
from kinfolk.runtime import stored

#: Names that are no news when only one side has them; weights of the three similarities; limits of the states.
TRIVIAL = ("main", "memset", "memcpy", "memmove", "strlen", "panic", "abort", "assert", "new", "drop")
CHARACTERS, TOKENS, CALLS = 0.4, 0.3, 0.3
IDENTICAL, MODIFIED = 0.90, 0.50
MOST_CHARACTERS = 8000


def name_states(current: DataFrame, reference: DataFrame, trivial: tuple[str, ...] = ()) -> DataFrame:
    """name and state of every name of either side: both, new (current only, none of the trivial) or reference_only.

    Names meet once each, as grouped rows. Null names take no part.
    """
    side = lambda df, flag: df.filter("name is not null").groupBy("name").agg(F.lit(True).alias(flag))
    met = side(current, "_c").join(side(reference, "_r"), "name", "full_outer")
    state = F.when(F.col("_r").isNull(), "new").when(F.col("_c").isNull(), "reference_only").otherwise("both")
    return met.select("name", state.alias("state")).filter((F.col("state") != "new") | ~F.col("name").isin(*trivial))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


@F.pandas_udf(DoubleType())
def _ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """How alike two sequences (texts, or arrays of hashes) are by their matching blocks; null for null."""
    for a, b in batches:
        numbers = lambda x: _code_points(x) if isinstance(x, str) else np.asarray(x, dtype=np.int64)
        yield pd.Series([None if x is None or y is None else ratio(numbers(x), numbers(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def body_similarity(pairs: DataFrame, a: str, b: str, name: str = "similarity", most: int | None = MOST_CHARACTERS) -> DataFrame:
    """pairs with the similarity of two bodies of code: matched characters 0.4, sets of tokens 0.3, calls in order 0.3.

    Bodies are compared in their normal form (see normal_code); 0 if nothing is left of one or it is null. Characters can
    be matched in as many places as there are pairs of equal ones, so the measure is defined over the first most of a
    body; most=None takes all of it. Tokens and calls are always of all of it.
    """
    sides = {"_x": F.coalesce(normal_code(F.col(a)), F.lit("")), "_y": F.coalesce(normal_code(F.col(b)), F.lit(""))}
    met = pairs.withColumns(sides).withColumns({f"{c}w": F.array_distinct(F.split(c, " ")) for c in sides})
    cut = (lambda c: F.col(c)) if most is None else (lambda c: F.substring(c, 1, most))
    calls = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\b(\w+)\s*\("), 1), lambda x: F.xxhash64(x))
    parts = [(CHARACTERS, _ratio(cut("_x"), cut("_y"))), (TOKENS, F.size(F.array_intersect("_xw", "_yw")) / F.size(F.array_union("_xw", "_yw"))), (CALLS, _ratio(calls("_x"), calls("_y")))]
    score = sum((weight * part for weight, part in parts[1:]), parts[0][0] * parts[0][1])
    return met.withColumn(name, F.when((F.col("_x") == "") | (F.col("_y") == ""), 0.0).otherwise(score)).drop("_x", "_y", "_xw", "_yw")


def reference_comparison(current: DataFrame, reference: DataFrame) -> DataFrame:
    """name, state, similarity, file: functions of both sides by how alike they are (identical, modified, reimplemented),
    those of the current side that are new and not trivial, and those of the reference only.

    current: name, file, code; reference: name, code. Of functions with one name the first by file (by code) counts.
    """
    ours = current.filter("name is not null").groupBy("name").agg(F.min(F.struct("file", "code")).alias("o")).select("name", "o.file", F.col("o.code").alias("_ours"), F.lit(True).alias("_c"))
    theirs = reference.filter("name is not null").groupBy("name").agg(F.min("code").alias("_theirs"), F.lit(True).alias("_r"))
    met = stored(ours.join(theirs, "name", "full_outer"), "met")
    alone = F.when(F.col("_c").isNull(), "reference_only").otherwise("new")
    one = met.filter("_c is null or _r is null").filter(F.col("_c").isNull() | ~F.col("name").isin(*TRIVIAL)).select("name", alone.alias("state"), F.lit(None).cast("double").alias("similarity"), "file")
    both = body_similarity(met.filter("_c and _r"), "_ours", "_theirs")
    state = F.when(F.col("similarity") > IDENTICAL, "identical").when(F.col("similarity") > MODIFIED, "modified").otherwise("reimplemented")
    return both.select("name", state.alias("state"), "similarity", "file").unionByName(one)


def first_strategy(hits: DataFrame, key: str, order: list[str], *then: str) -> DataFrame:
    """One row a key, of the strategy that comes first in the order (others after all of these), then the least by the other columns."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("strategy")), F.lit(0))
    rank = F.when(place == 0, len(order) + 1).otherwise(place)
    return hits.groupBy(key).agg(F.min(F.struct(rank.alias("_r"), "strategy", *then)).alias("b")).select(key, "b.strategy", *(f"b.{c}" for c in then))


def syscall_names(functions: DataFrame, called: DataFrame) -> DataFrame:
    """name, strategy, source, file of the system calls that functions are named after: sys_x, syscall_x, and do_x if a
    handler calls it. functions: name, file; called: name."""
    canon = F.lower(F.regexp_extract("name", r"^(?:sys|syscall|do)_(.+)$", 1))
    named = functions.select(canon.alias("call"), F.col("name").alias("source"), "file").filter("call <> ''")
    do = F.col("source").startswith("do_")
    kept = named.filter(~do).unionByName(named.filter(do).join(called.select(F.col("name").alias("source")).distinct(), "source", "left_semi").select(*named.columns))
    return kept.select(F.col("call").alias("name"), F.lit("function_name").alias("strategy"), "source", "file")


def top_within(rows: DataFrame, key: list[str] | str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each key in an order, with their rank from 1; a key's rows beyond them leave each task early."""
    rank = F.row_number().over(W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most)


def complexity(code: Column) -> Column:
    """One more than the branches of a function's code: conditions, loops, cases and short-circuit operators."""
    branches = F.regexp_count(normal_code(code), F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?|=>"))
    return F.when(code.isNotNull(), branches + 1)


def complexity_summary(functions: DataFrame, group: str) -> DataFrame:
    """Per group: functions with code, functions without, largest and mean complexity, their non-blank lines and tokens."""
    lines = F.size(F.filter(F.split("code", "\n"), lambda x: F.btrim(x) != ""))
    tokens = F.size(F.regexp_extract_all(normal_code(F.col("code")), F.lit(r"(\w+|[^\s\w])"), 1))
    rows = functions.select(group, complexity(F.col("code")).alias("ccn"), F.when(F.col("code").isNotNull(), lines).alias("lines"), F.when(F.col("code").isNotNull(), tokens).alias("tokens"))
    return rows.groupBy(group).agg(F.count("ccn").alias("analyzed"), F.count_if(F.col("ccn").isNull()).alias("unavailable"), F.max("ccn").alias("max_complexity"), F.round(F.avg("ccn"), 2).alias("mean_complexity"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
