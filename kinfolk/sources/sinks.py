"""Sinks: replacement by repository, appends that skip known ids, and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replace_repositories(df: DataFrame, path: str, key: str = "repo_id") -> None:
    """Write df so that the repositories in it replace their old rows and all others stay; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def append_new(df: DataFrame, path: str, key: str = "id") -> int:
    """Append the rows whose key the table does not hold yet; how many."""
    spark = df.sparkSession
    first = W.partitionBy(key).orderBy(*[c for c in df.columns if c != key] or [key])
    fresh = df.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    try:
        known = spark.read.parquet(path).select(key)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    if known is not None:
        fresh = fresh.join(known, key, "left_anti")
    counted = Observation()
    fresh.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return int(counted.get["n"])  # as they were written: the table is not counted


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both by key, the latest version of each (new before old where versions tie)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    latest = W.partitionBy(*key).orderBy(F.desc_nulls_last(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n", "_new")


def merged(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Rows of both by key: the columns in keep stay as they were, all others take the new value if there is one."""
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in new.columns if c != key))
    both = old.join(n, key, "full_outer")
    pick = lambda c: F.coalesce(c, f"_{c}") if c in keep else F.coalesce(f"_{c}", c)
    return both.select(key, *(pick(c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != key))


def write_manifest(summary: DataFrame, path: str) -> None:
    """Write the one row of a summary as JSON, in place of what was there."""
    if (n := summary.limit(2).count()) != 1:
        raise ValueError(f"a manifest is one row, not {'none' if not n else 'more'}")
    summary.coalesce(1).write.mode("overwrite").json(path)
