"""Contracts: coverage audits, generation signatures and guards that fail rather than truncate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A result may not exist: its inputs are incomplete or do not match."""


def coverage(configured: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """key, n, covered for every configured key."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return configured.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).withColumn("covered", F.col("n") > 0)


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with a few of the rows that violate a contract."""
    rows = violations.limit(5).collect()
    if rows:
        raise ContractError(f"{what}: {[r.asDict() for r in rows]}")


def require_complete(configured: DataFrame, rows: DataFrame, key: str) -> None:
    require_empty(coverage(configured, rows, key).filter(~F.col("covered")), f"no rows for some {key}")


def signature(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row, n and signature: equal for equal sets of rows in any order, without sorting them in one place.

    Each row's sha256 is cut in four parts of 60 bits; their sums over all rows are hashed.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    sums = rows.agg(F.count("*").alias("n"), *parts)
    return sums.select("n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in range(4))), 256).alias("signature"))


def require_same_generation(a: DataFrame, b: DataFrame, columns: list[str]) -> None:
    if signature(a, columns).first() != signature(b, columns).first():
        raise ContractError("the index was built from other rows")


def retrieval_violations(channels: DataFrame, required: list[str]) -> DataFrame:
    """Channels that are missing, incomplete or cut short. channels: channel, complete, truncated."""
    spark = channels.sparkSession
    wanted = spark.createDataFrame([(c,) for c in required], "channel string")
    met = wanted.join(channels, "channel", "left")
    return met.filter(~F.coalesce("complete", F.lit(False)) | F.coalesce("truncated", F.lit(True)))


def unreviewed(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Review and weak pairs in the queue that have no accepted verdict."""
    queued = pairs.filter(F.col("tier").isin("review", "weak") & F.col("state").isin("selected", "selected_secondary", "deferred_secondary"))
    return queued.join(verdicts.filter("accepted").select("q_id", "c_id"), ["q_id", "c_id"], "left_anti")


def range_violations(stages: DataFrame) -> DataFrame:
    """Stages that do not start at commit 0 or do not strictly follow each other. stages: grp, stage, start."""
    from pyspark.sql import Window as W

    before = F.lag("start").over(W.partitionBy("grp").orderBy("stage"))
    return stages.withColumn("before", before).filter((F.col("before").isNull() & (F.col("start") != 0)) | (F.col("start") <= F.col("before")))


def development_violations(group: str, candidates: DataFrame, reviews: DataFrame, stages: DataFrame, last: DataFrame) -> DataFrame:
    """group, rule, n: how often the rules of a development report are broken. Every candidate is reviewed, once; those that
    must be told are kept; stages start at commit 0 and strictly follow each other; a stage's key commit is in its range.

    candidates: group, event_id, must; reviews: group, event_id; stages: group, stage, start, key; last: group, last.
    """
    from pyspark.sql import Window as W

    n = candidates.join(reviews.groupBy(group, "event_id").agg(F.count("*").alias("n")), [group, "event_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = W.partitionBy(group).orderBy("stage")
    ranges = stages.withColumn("before", F.lag("start").over(order)).withColumn("stop", F.lead("start").over(order) - 1).join(last, group).withColumn("stop", F.coalesce("stop", "last"))
    of = lambda rows, rule: rows.select(group, F.lit(rule).alias("rule"))
    broken = [
        of(n.filter("n = 0"), "not_reviewed"),
        of(n.filter("n > 1"), "reviewed_again"),
        of(n.filter("must and n = 0"), "must_be_told"),
        of(ranges.filter("before is null and start <> 0"), "first_stage"),
        of(ranges.filter("before is not null and start <= before"), "stage_order"),
        of(ranges.filter("key < start or key > stop"), "key_outside"),
    ]
    rows = broken[0]
    for more in broken[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(group, "rule").agg(F.count("*").alias("n"))
