"""Change history: large changes by median, close pairs, stages with their ranges and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def large_changes(commits: DataFrame, group: str, factor: float = 5, floor: float = 1000, least: int = 8) -> DataFrame:
    """Per group: commits, those of unknown size, the threshold greatest(floor, ceil(factor x median)) and the large ones.

    Unknown sizes (null) count, but only sizes above 0 enter the median; a group of fewer than least such sizes has the
    floor alone.
    """
    changed = F.when(F.col("size") > 0, F.col("size"))
    known = commits.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col("size").isNull()).alias("n_unknown"), F.median(changed).alias("median"), F.count(changed).alias("k"))
    bound = F.when(F.col("k") >= least, F.greatest(F.lit(float(floor)), F.ceil(F.col("median") * factor).cast("double"))).otherwise(F.lit(float(floor)))
    known = known.withColumn("threshold", bound)
    large = commits.join(known, group).filter(F.col("size") >= F.col("threshold")).groupBy(group).agg(F.count("*").alias("n_large"))
    return known.join(large, group, "left").select(group, "n", "n_unknown", "threshold", F.coalesce("n_large", F.lit(0)).alias("n_large"))


def close_pairs(commits: DataFrame, group: str, hours: float = 24, least: float = 0) -> DataFrame:
    """Commits of at least the size next to each other among those of their group, at most hours apart and not back in time.

    Smaller commits between two do not part them.
    """
    order = W.partitionBy(group).orderBy("ts", "id")
    rows = commits.filter(F.col("size") >= least).withColumn("next_id", F.lead("id").over(order)).withColumn("next_ts", F.lead("ts").over(order))
    gap = (F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    return rows.withColumn("gap_hours", gap).filter((F.col("gap_hours") >= 0) & (F.col("gap_hours") <= hours)).select(group, "id", "next_id", F.round("gap_hours", 1).alias("gap_hours"))


def stage_ranges(stages: DataFrame, group: str, last: DataFrame) -> DataFrame:
    """group, stage, start, stop: a stage ends before the next one starts, the final one at the group's last commit."""
    nxt = F.lead("start").over(W.partitionBy(group).orderBy("start"))
    return stages.withColumn("next", nxt).join(last, group).select(group, "stage", "start", F.coalesce(F.col("next") - 1, F.col("last")).alias("stop"))


def stage_totals(commits: DataFrame, ranges: DataFrame, group: str) -> DataFrame:
    """Per stage: commits, size, first and last day."""
    met = commits.join(ranges, group).filter((F.col("seq") >= F.col("start")) & (F.col("seq") <= F.col("stop")))
    return met.groupBy(group, "stage", "start", "stop").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


def stage_files(commits: DataFrame, ranges: DataFrame, group: str) -> DataFrame:
    """group, stage, path, additions, deletions, commits, rank: every file of a stage, the most changed first, then by path.
    Unknown sizes count as none. commits: group, seq, files (path, additions, deletions); ranges: group, stage, start, stop."""
    met = commits.join(ranges, group).filter((F.col("seq") >= F.col("start")) & (F.col("seq") <= F.col("stop")))
    rows = met.select(group, "stage", F.explode("files").alias("f"))
    size = lambda c: F.sum(F.coalesce(f"f.{c}", F.lit(0))).cast("long").alias(c)
    by = rows.groupBy(group, "stage", F.col("f.path").alias("path")).agg(size("additions"), size("deletions"), F.count("*").alias("commits"))
    order = W.partitionBy(group, "stage").orderBy(F.desc(F.col("additions") + F.col("deletions")), "path")
    return by.withColumn("rank", F.row_number().over(order))
