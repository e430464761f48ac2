"""Stored tables, their scopes and size checks."""

import os

import pytest
from pyspark.sql import functions as F

from kinfolk import runtime
from kinfolk.operators import components


def files(spark):
    top = runtime.shared_dir(spark).removeprefix("file://") + "/kinfolk"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_scratch_deletes_what_does_not_outlive_it(spark):
    before = files(spark)
    with runtime.scratch(spark):
        runtime.stored(spark.range(5), "gone")
        kept = runtime.stored(spark.range(7), "kept", outlives=True)
        with pytest.raises(ZeroDivisionError), runtime.scratch(spark):
            runtime.stored(spark.range(3), "failed")
            raise ZeroDivisionError
    assert [x.split("-")[0] for x in files(spark) - before] == ["kept"] and kept.count() == 7


def test_broadcast_needs_few_rows_and_few_bytes(spark):
    rows = runtime.stored(spark.range(50).withColumn("x", F.sha2(F.col("id").cast("string"), 256)), "rows")
    assert runtime.small_enough(rows) and not runtime.small_enough(rows, limit=49) and not runtime.small_enough(rows, most_bytes=100)


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError):
        components.connected_components(chain)


def test_a_cluster_without_a_shared_folder_is_an_error():
    context = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})
    session = type("Session", (), {"conf": type("Conf", (), {"get": staticmethod(lambda *a: None)}), "sparkContext": context})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(session)
