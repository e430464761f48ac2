"""Group-wise selection: representatives, top contents of a target, suppression and propagation over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def select_contents(rows: DataFrame, target: str, content: str, rank: Column, order: str, keep: int = 2) -> DataFrame:
    """rows with content_rank and state: the members of the keep best contents of a target are selected, the rest deferred.

    A content counts by its best member.
    """
    best = rows.groupBy(target, content).agg(F.max(rank).alias("_best"), F.min(order).alias("_first"))
    ranked = best.withColumn("content_rank", F.row_number().over(W.partitionBy(target).orderBy(F.desc("_best"), "_first")))
    out = rows.join(ranked.select(target, content, "content_rank"), [target, content])
    return out.withColumn("state", F.when(F.col("content_rank") <= keep, "selected").otherwise("deferred_secondary"))


def content_ranks(rows: DataFrame, target: str, content: str, rank: list[str], order: str) -> DataFrame:
    """target, content_ranks: what select_contents ranks, as a map from content to its rank, to be met by rows that are made
    again. Rows of equal evidence become one first, so what is gathered are the contents of a target, not its rows."""
    kinds = rows.groupBy(target, content, *rank).agg(F.min(order).alias("_first"))
    best = kinds.groupBy(target, content).agg(F.max(F.struct(*rank)).alias("_best"), F.min("_first").alias("_first"))
    ranked = best.withColumn("_r", F.row_number().over(W.partitionBy(target).orderBy(F.desc("_best"), "_first")))
    return ranked.filter(F.col(content).isNotNull()).groupBy(target).agg(F.map_from_entries(F.collect_list(F.struct(content, "_r"))).alias("content_ranks"))


def by_content_ranks(rows: DataFrame, content: str, keep: int = 2) -> DataFrame:
    """rows with content_rank and state as of select_contents, from their target's content_ranks."""
    out = rows.withColumn("content_rank", F.col("content_ranks")[F.col(content)]).filter("content_rank is not null").drop("content_ranks")
    return out.withColumn("state", F.when(F.col("content_rank") <= keep, "selected").otherwise("deferred_secondary"))


def dominated(best: Column, strong: float = 0.72, gap: float = 0.18, line_most: float = 0.7) -> Column:
    """Whether a pair is weaker than the best of its domain, see suppress_dominated."""
    weak = (best >= strong) & (best - F.col("identity") >= gap) & (F.col("line_sim") < line_most)
    return weak & ~F.coalesce(F.col("tier") == "confirmed", F.lit(False))


def suppress_dominated(pairs: DataFrame, domain: list[str], strong: float = 0.72, gap: float = 0.18, line_most: float = 0.7) -> DataFrame:
    """pairs with dominated: weaker pairs of a domain whose best has at least strong, if they trail it by gap and their
    line similarity is under line_most. Confirmed pairs never are."""
    return pairs.withColumn("dominated", dominated(F.max("identity").over(W.partitionBy(*domain)), strong, gap, line_most))


def propagate(pairs: DataFrame, flag: str, by: str = "q_id") -> DataFrame:
    """pairs with flag spread from any pair of a query to all of its pairs."""
    marked = pairs.groupBy(by).agg(F.bool_or(flag).alias("_any"))
    return pairs.drop(flag).join(marked, by).withColumnRenamed("_any", flag)


def widespread(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Per query: distinct sources of confirmed or very near pairs, and whether they are at least least."""
    strong = (F.col("tier") == "confirmed") | (F.col("score") >= 0.9)
    out = pairs.groupBy("q_id").agg(F.count_distinct(F.when(F.coalesce(strong, F.lit(False)), F.col("c_source"))).alias("n_sources"))
    return out.withColumn("widespread", F.col("n_sources") >= least)


def balanced(rows: DataFrame, module: str, order: list[Column], per_module: int, total: int) -> DataFrame:
    """At most per_module rows of a module and total in all, best first."""
    capped = rows.withColumn("_m", F.row_number().over(W.partitionBy(module).orderBy(*order))).filter(F.col("_m") <= per_module)
    return capped.orderBy(*order).limit(total).drop("_m")


def promote_known(pairs: DataFrame) -> DataFrame:
    """pairs with promoted: pairs of a query and target content that is already confirmed in another pair."""
    known = F.bool_or(F.col("tier") == "confirmed").over(W.partitionBy("q_id", "content"))
    return pairs.withColumn("promoted", F.coalesce(known & (F.col("tier") != "confirmed"), F.lit(False)))


def confirmed_contents(pairs: DataFrame) -> DataFrame:
    """q_id, known: the contents that a pair of the query confirms, each as a struct (a content may be null)."""
    return pairs.filter("tier = 'confirmed'").select("q_id", "content").distinct().groupBy("q_id").agg(F.collect_list(F.struct("content")).alias("known"))


def promoted(known: Column) -> Column:
    """Whether a pair's content is among the confirmed ones of its query, see promote_known."""
    return F.coalesce(F.array_contains(known, F.struct("content")) & (F.col("tier") != "confirmed"), F.lit(False))


def apply_verdicts(pairs: DataFrame, by_pair: DataFrame, by_content: DataFrame) -> DataFrame:
    """pairs with verdict: that of the exact pair, else that of the pair's content."""
    p = by_pair.select("q_id", "c_id", F.col("verdict").alias("_pair"))
    c = by_content.select("content", F.col("verdict").alias("_content"))
    return pairs.join(p, ["q_id", "c_id"], "left").join(c, "content", "left").withColumn("verdict", F.coalesce("_pair", "_content")).drop("_pair", "_content")


def merge_findings(rows: DataFrame, limit: int) -> DataFrame:
    """Findings merged by source and title with their number; each source's best first, then the rest, up to limit."""
    rank = F.create_map(*(F.lit(x) for x in ("critical", 0, "high", 1, "medium", 2, "low", 3)))[F.col("severity")]
    best = F.min(F.struct(F.coalesce(rank, F.lit(9)).alias("rank"), (-F.col("confidence")).alias("neg"), "detail"))
    merged = rows.groupBy("source", "title").agg(best.alias("b"), F.count("*").alias("n"))
    merged = merged.select("source", "title", "n", F.col("b.rank").alias("severity_rank"), (-F.col("b.neg")).alias("confidence"), F.col("b.detail").alias("detail"))
    turn = F.row_number().over(W.partitionBy("source").orderBy("severity_rank", F.desc("confidence"), "title"))
    return merged.withColumn("later", F.when(turn > 1, 1).otherwise(0)).orderBy("later", "severity_rank", F.desc("confidence"), "title", "source").limit(limit).drop("later")
