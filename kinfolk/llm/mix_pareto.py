"""Mixing sources to target weights by Pareto order sampling with unequal inclusion odds.

Every document of a source is due a number of copies in proportion to size to the power POWER, at most MOST_COPIES, such
that the words due add up to the source's target. The whole part of that number is certain. The fraction left is the
document's inclusion probability p: longer documents are likelier, and the longest, which would make a total uncertain,
are certain. Each document gets the ranking value (u / (1 - u)) / (p / (1 - p)) with its own random u, and the documents
of a source are taken in that order up to a fixed size.

The sample's size is fixed in words: the order is cut where the words of the fractions due are reached. What a long
document at the cut leaves open is filled in the same order by documents that fit, twice, and then by a closing document:
of those left the one that fits best, if any brings the total nearer.

No source is sorted: ranking values fall into a fixed number of cells, sums by cell give the cell where an order is cut,
and only that cell's documents are ordered. What a source is due follows from counts by source and size (as many rows as
there are distinct sizes). The outcome is a table with one row per source (the scale of the copies due, the cuts, the
closing document), so applying it to texts is one join with that table and needs no second look at other documents.

Defined results: a null text has size 0 and a null source is a source of its own, last in order; documents of size 0 take
nothing; u depends on the seed, doc_id (null or not), source and text, so reruns agree and rows that agree in all three
are taken or left together; an empty table gives an empty result; extra columns are kept by apply_plan and ignored by
plan_mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.llm.quality_hosts import words_of
from kinfolk.runtime import sized_join, stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Copies due grow with size to this power.
POWER = 0.5
CELLS = 4096
#: Cuts of the order: the sample's own, then those of documents that fit in what is left.
CUTS = 3
SEED = 20


def size_of(text: Column) -> Column:
    return F.size(words_of(F.coalesce(text, F.lit("")))).cast("long")


def row_key(doc: Column, source: Column, text: Column) -> Column:
    """What tells rows apart: equal rows share it."""
    return F.xxhash64(doc, doc.isNull(), F.coalesce(source, F.lit("")), source.isNull(), text)


def uniform(rk: Column, seed: int) -> Column:
    """A number in (0, 1) of its own for each row key."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), rk), 12).cast("double") + 0.5) / float(1 << 52)


def ranking(u: Column, p: Column) -> Column:
    """The Pareto ranking value q = (u / (1 - u)) / (p / (1 - p)) as q / (1 + q), which keeps the order and never divides by zero."""
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows of source and size.

    Shares by weight with a ceiling of most times the size, the excess shared again, come to one level per unit of
    weight: sources whose ceiling lies under it stay there, all others get weight times level. The only ordering is over
    one row per source.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # one row per source from here on
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (order % len(weights) + 1).cast("int"))
    rows = per.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * float(most)).withColumn("fills", F.col("ceiling") / F.col("weight"))
    before = W.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rows = rows.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    place = F.row_number().over(W.orderBy("fills", F.col("source").asc_nulls_last()))
    held = F.when(F.col("fills") >= F.col("level"), F.struct(place.alias("place"), "level"))
    rows = rows.withColumn("held", held).withColumn("water", F.min("held").over(whole)["level"])
    target = F.least(F.col("ceiling"), F.coalesce(F.col("weight") * F.col("water"), F.col("ceiling")))
    return rows.select("source", "source_size", target.alias("target"))


def due(size: Column, scale: Column, power: float, most: int) -> Column:
    """Copies due to a document of a size; a hair below a whole number counts as that number."""
    n = F.least(F.lit(float(most)), scale * F.pow(size.cast("double"), F.lit(power)))
    return F.when(size <= 0, 0.0).when(F.ceil(n) - n < 1e-9, F.ceil(n).cast("double")).otherwise(n)


def scales(counts: DataFrame, goal: DataFrame, power: float, most: int) -> DataFrame:
    """key and scale of the copies due, such that the words due are the target: sizes whose copies reach most are set to it,
    the others share the rest. counts: key, size, n (rows of the size); goal: key, target."""
    a = F.pow(F.col("size").cast("double"), F.lit(power))
    rows = sized_join(counts.filter("size > 0"), goal.select("key", "target"), "key", "inner")
    rows = rows.withColumn("a", a).withColumn("words", F.col("n") * F.col("size")).withColumn("load", F.col("n") * F.col("size") * a)
    by = W.partitionBy("key").orderBy("size")  # one row per distinct size
    larger = W.partitionBy("key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("load", F.sum("load").over(by)).withColumn("full", F.coalesce(F.sum("words").over(larger), F.lit(0)))
    # if this size is the largest one that is not at the ceiling
    rows = rows.withColumn("scale", F.greatest(F.lit(0.0), F.col("target") - float(most) * F.col("full")) / F.col("load"))
    held = F.max(F.when(F.col("scale") * F.col("a") <= most, F.struct("size", "scale")))
    # no such size: all are at the ceiling
    return rows.groupBy("key").agg(F.coalesce(held["scale"], F.lit(float(most))).alias("scale"))


def cut(rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """key, cut_rank, reached: where each source's order passes its gap. rows: key, size, rank, cell, gap, low; gaps: key.

    Documents larger than the gap or ranked at or before low are not in the order.
    """
    open_ = rows.filter((F.col("rank") > F.col("low")) & (F.col("size") <= F.col("gap")))  # those that fit
    cells = open_.groupBy("key", "cell").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    upto = F.sum("words").over(W.partitionBy("key").orderBy("cell"))  # at most CELLS rows a source
    cells = stored(cells.withColumn("upto", upto), "cells")
    edge = stored(cells.filter("upto - words <= gap and upto > gap").select("key", "cell", (F.col("upto") - F.col("words")).alias("before")), "edge")
    inside = sized_join(open_.drop("before"), edge, ["key", "cell"], "inner")
    # equal rows have one value and are summed together
    reached = F.col("before") + F.sum("size").over(W.partitionBy("key").orderBy("rank"))
    last = inside.withColumn("reached", reached).filter("reached <= gap").groupBy("key").agg(F.max(F.struct("rank", "reached")).alias("last"))
    whole = cells.groupBy("key").agg(F.max("upto").alias("all"))
    found = gaps.select("key").join(whole, "key", "left").join(edge, "key", "left").join(last, "key", "left")
    # without an edge every document of the order is taken
    at = F.when(F.col("cell").isNull(), 2.0).otherwise(F.coalesce("last.rank", F.col("cell") / float(CELLS) * (1 - 2.0**-52)))
    return found.select("key", at.alias("cut_rank"), F.coalesce("last.reached", "before", "all", F.lit(0)).alias("reached"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED, power: float = POWER) -> DataFrame:
    """One row per source: source, key, source_size, target, scale, cuts (cap and rank: documents of at most cap words up to
    that value are taken), extra (row key of the closing document).

    docs: rk, source, size (narrow, stored).
    """
    goal = stored(targets(docs.select("source", "size"), weights, share, most).withColumn("key", source_key(F.col("source"))), "goal")
    keyed = docs.withColumn("key", source_key(F.col("source")))
    counts = stored(keyed.groupBy("key", "size").agg(F.count("*").alias("n")), "counts")
    goal = stored(goal.join(scales(counts, goal, power, most), "key", "left").withColumn("scale", F.coalesce("scale", F.lit(0.0))), "goal")
    n = due(F.col("size"), F.col("scale"), power, most)
    sure = sized_join(counts, goal, "key", "inner").groupBy("key").agg(F.sum(F.floor(n) * F.col("size") * F.col("n")).alias("sure"))
    p = n - F.floor(n)
    rows = sized_join(keyed.filter("size > 0").select("key", "rk", "size"), goal.select("key", "scale"), "key", "inner").withColumn("p", p).filter("p > 0")
    rank = ranking(uniform(F.col("rk"), seed), F.col("p"))
    rows = stored(rows.select("key", "rk", "size", rank.alias("rank"), F.floor(rank * CELLS).cast("int").alias("cell")), "ranked")
    gaps = stored(goal.join(sure, "key").select("key", (F.col("target") - F.col("sure")).alias("gap"), F.lit(-1.0).alias("low"), F.array().cast("array<struct<cap:double,rank:double>>").alias("cuts")), "gaps")
    for k in range(CUTS):
        found = cut(sized_join(rows, gaps.drop("cuts"), "key", "inner"), gaps)
        cap = F.col("gap").cast("double")
        more = F.concat("cuts", F.array(F.struct(cap.alias("cap"), F.col("cut_rank").alias("rank"))))
        gaps = stored(gaps.join(found, "key").select("key", (F.col("gap") - F.col("reached")).alias("gap"), F.col("cut_rank").alias("low"), more.alias("cuts")), "gaps")
    behind = sized_join(rows, gaps, "key", "inner").filter(~within(F.col("size"), F.col("rank"), F.col("cuts"))).groupBy("key", "rk", "rank", "gap").agg(F.sum("size").alias("size"))
    behind = behind.withColumn("off", F.abs(F.col("size") - F.col("gap"))).filter(F.col("off") < F.col("gap"))
    extra = behind.groupBy("key").agg(F.min(F.struct("off", "rank", "rk")).alias("e")).select("key", F.col("e.rk").alias("extra"))
    return goal.join(gaps.select("key", "cuts"), "key", "left").join(extra, "key", "left").select("source", "key", "source_size", "target", "scale", "cuts", "extra")


def within(size: Column, rank: Column, cuts: Column) -> Column:
    """Whether one of the cuts takes a document."""
    return F.coalesce(F.exists(cuts, lambda c: (size <= c["cap"]) & (rank <= c["rank"])), F.lit(False))


def source_key(source: Column) -> Column:
    """A key that is never null: null sources join with each other."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def apply_plan(docs: DataFrame, plan: DataFrame, rk: Column, size: Column, seed: int = SEED, power: float = POWER, most: int = MOST_COPIES) -> DataFrame:
    """docs (source and any others) with a struct _mix: source_size, target and n_copies of each document. rk and size: the
    row key and the size, as in plan_mix, over the columns of docs."""
    plan = stored(plan.select("key", "source_size", "target", "scale", "cuts", "extra"), "plan")
    renamed = plan.select(F.col("key").alias("_key"), F.struct(*(c for c in plan.columns if c != "key")).alias("_plan"))
    rows = docs.withColumn("_key", source_key(F.col("source"))).withColumn("_rk", rk).withColumn("_size", size)
    rows = sized_join(rows, renamed, "_key", "left")
    plan_of = F.col("_plan")
    n = due(F.col("_size"), plan_of["scale"], power, most)
    p = n - F.floor(n)
    rank = ranking(uniform(F.col("_rk"), seed), p)
    chosen = (p > 0) & (within(F.col("_size"), rank, plan_of["cuts"]) | F.coalesce(F.col("_rk") == plan_of["extra"], F.lit(False)))
    copies = F.coalesce(F.floor(n) + F.when(chosen, 1).otherwise(0), F.lit(0)).cast("int")
    return rows.select(*docs.columns, F.struct(plan_of["source_size"].alias("source_size"), plan_of["target"].alias("target"), copies.alias("n_copies")).alias("_mix"))


def sized(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, rk of every document, stored."""
    i, s = F.col(doc).cast("long"), F.col(source).cast("string")
    return stored(docs.select(i.alias("doc_id"), s.alias("source"), size_of(F.col(text)).alias("size"), row_key(i, s, F.col(text)).alias("rk")), "sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED, power: float = POWER) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every document."""
    rows = sized(docs)
    out = apply_plan(rows, plan_mix(rows, weights, share, most, seed, power), F.col("rk"), F.col("size"), seed, power, most)
    return out.select("doc_id", "source", "size", "_mix.source_size", "_mix.target", (F.col("_mix.n_copies") * F.col("size")).cast("long").alias("taken"))
