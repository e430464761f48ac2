"""Rollups: exclusive categories over a fixed spine, source metrics and ranking, exclusions, clusters, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.functions.scores import classifier_score, cluster_priority, priority_level
from kinfolk.runtime import sized_join, stored


def submodule_stats(rows: DataFrame, spine: DataFrame, categories: list[str]) -> DataFrame:
    """A row per module of the spine: functions by their highest category (the first of categories is highest), with shares.

    rows: q_id, module, category.
    """
    order = F.create_map(*(F.lit(x) for pair in ((c, k) for k, c in enumerate(categories)) for x in pair))
    best = rows.groupBy("q_id", "module").agg(F.min(order[F.col("category")]).alias("k"))
    counts = best.groupBy("module").agg(F.count("*").alias("total"), *(F.count_if(F.col("k") == k).alias(f"n_{c}") for k, c in enumerate(categories)))
    out = spine.join(counts, "module", "left")
    return out.select("module", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", *(f"n_{x}" for x in categories))), *(F.coalesce(F.round(100 * F.col(f"n_{x}") / F.col("total"), 3), F.lit(0.0)).alias(f"share_{x}") for x in categories))


def source_metrics(pairs: DataFrame) -> DataFrame:
    """Per candidate source: functions, similar lines, modules and shared functions, over the best pair of each query there.

    pairs: q_id, c_source, module, hits, line_sim.
    """
    # equal numbers become one before the maximum of a struct, which Spark finds by sorting
    kinds = pairs.groupBy("q_id", "c_source", "module", "line_sim").agg(F.max("hits").alias("hits"))
    best = stored(kinds.groupBy("q_id", "c_source").agg(F.max(F.struct("line_sim", "hits", "module")).alias("b")), "best_of_sources")
    shared = best.groupBy("q_id").agg((F.count("*") > 1).alias("shared"))
    rows = best.join(shared, "q_id")
    return rows.groupBy("c_source").agg(F.count("*").alias("functions"), F.sum("b.hits").alias("lines"), F.count_distinct("b.module").alias("modules"), F.count_if("shared").alias("shared_functions"))


def rank_sources(metrics: DataFrame) -> DataFrame:
    """metrics with rank: most functions, then lines, modules, fewest shared, then name."""
    order = W.orderBy(F.desc("functions"), F.desc("lines"), F.desc("modules"), "shared_functions", "c_source")  # one row per source
    return metrics.withColumn("rank", F.row_number().over(order))


def exclusion_totals(rows: DataFrame, reasons: list[str], included: DataFrame) -> DataFrame:
    """reason and functions: each excluded function counts once, for its first reason in order; functions with any included
    pair do not count. rows: q_id, reason."""
    order = F.create_map(*(F.lit(x) for pair in ((r, k) for k, r in enumerate(reasons)) for x in pair))
    # a row per function on both sides before they meet
    first = stored(rows.groupBy("q_id").agg(F.min(order[F.col("reason")]).alias("k")), "first_reasons").join(stored(included.select("q_id").distinct(), "included"), "q_id", "left_anti")
    first = first.select(F.get(F.array(*map(F.lit, reasons)), F.col("k")).alias("reason"))
    return first.groupBy("reason").agg(F.count("*").alias("functions"))


def overview(classes: DataFrame) -> DataFrame:
    """One row: total and the number of functions of each class, and whether they add up."""
    out = classes.agg(*(F.count_if(F.col("cls") == c).alias(c) for c in ("similar", "excluded", "none")), F.count_distinct("q_id").alias("total"))
    return out.withColumn("reconciled", F.col("similar") + F.col("excluded") + F.col("none") == F.col("total"))


def clusters(pairs: DataFrame) -> DataFrame:
    """Per source and module: functions, lines, mean similarity, priority and level."""
    out = pairs.groupBy("c_source", "module").agg(F.count_distinct("q_id").alias("functions"), F.sum("hits").alias("lines"), F.avg("line_sim").alias("mean_sim"), F.count_distinct("q_source").alias("sources"))
    score = cluster_priority(F.col("mean_sim"), F.lit(0.5), F.col("lines"), F.col("sources"))
    return out.withColumn("priority", score).withColumn("level", priority_level(F.col("priority"), 78, 62))


def classify(docs: DataFrame, rules: DataFrame, path: Column, symbols: Column, calls: Column, fallback: str = "other") -> DataFrame:
    """doc_id and module: the rule set with the highest score, ties to the earlier one; fallback where none scores.

    rules: module, ordinal, keyword; broadcast only behind a check of their size. symbols, calls: arrays of words.
    """
    parts = docs.select("doc_id", path.alias("path"), F.array_distinct(symbols).alias("symbols"), F.array_distinct(calls).alias("calls"))
    where = [parts.select("doc_id", F.lit("path").alias("place"), F.explode(F.array_distinct(F.split(F.lower("path"), "[^a-z0-9]+"))).alias("keyword"))]
    where += [parts.select("doc_id", F.lit(p).alias("place"), F.explode(p).alias("keyword")) for p in ("symbols", "calls")]
    hits = sized_join(where[0].union(where[1]).union(where[2]), stored(rules, "rules"), "keyword", "inner")
    n = hits.groupBy("doc_id", "module", "ordinal").agg(*(F.count_if(F.col("place") == p).alias(p) for p in ("path", "symbols", "calls")))
    scored = n.withColumn("points", classifier_score(F.col("path"), F.col("symbols"), F.col("calls")))
    best = scored.groupBy("doc_id").agg(F.max(F.struct("points", (-F.col("ordinal")).alias("neg"), "module")).alias("b"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("b.module", F.lit(fallback)).alias("module"), F.coalesce("b.points", F.lit(0)).alias("points"))


def evaluation(samples: DataFrame) -> DataFrame:
    """Per class: samples, recall; over all: precision and recall. samples: cls, label (0/1), hit (boolean)."""
    by = samples.filter("label = 1").groupBy("cls").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("recall"))
    tp, fp, pos = (F.count_if(c).cast("double") for c in (F.col("hit") & (F.col("label") == 1), F.col("hit") & (F.col("label") == 0), F.col("label") == 1))
    total = samples.agg(tp.alias("tp"), fp.alias("fp"), pos.alias("p"))
    rows = total.select(F.lit("all").alias("cls"), F.col("p").cast("long").alias("n"), F.try_divide("tp", "p").alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
    return by.withColumn("precision", F.lit(None).cast("double")).unionByName(rows)
