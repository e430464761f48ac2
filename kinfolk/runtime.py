"""Session helpers shared by every operator: shared storage, lineage cuts and size-checked joins."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count of its written rows and the bytes of its files are at most these.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20

_FALLBACK: dict[str, str] = {}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the tasks of a session whose workers would not find it: neither their PYTHONPATH nor the
    working folder has it. Once per application."""
    root = str(Path(__file__).resolve().parent.parent)
    app = spark.sparkContext.applicationId
    paths = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    if app in _SHIPPED or root in paths:
        return
    _SHIPPED.add(app)
    target = Path(tempfile.mkdtemp(prefix="spark-kinfolk-"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(target / "kinfolk"), "zip", root, "kinfolk"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session leaves it unset and everything runs in one process (tests, benches) a temporary folder is made;
    on a cluster it would be another folder on every machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="spark-kinfolk-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, new on every call."""
    return f"{shared_dir(spark)}/kinfolk/{label}-{uuid.uuid4().hex}"


#: The scratch scopes around the caller, outermost first: each thread and task has its own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what stored() wrote inside, but for the tables that outlive it."""
    mine: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), mine))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read the files again. The table goes with the scratch()
    around it; outlives: with the one around that, if any. Without one it stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    around = _SCOPES.get()[:-1] if outlives else _SCOPES.get()
    if around:
        around[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table is small enough to broadcast: by the optimizer's bytes of its files, then by its rows, which
    are counted only up to the limit."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= most_bytes and df.limit(limit + 1).count() <= limit


def sized_join(big: DataFrame, small: DataFrame, on: list[str] | str, how: str) -> DataFrame:
    """Join a stored side: broadcast if its counted size allows, else a shuffle join that AQE can split where keys are hot."""
    return big.join(F.broadcast(small) if small_enough(small) else small, on, how)
