"""Incremental runs as streams: a new batch of rows is fingerprinted or appended once, whatever is retried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinfolk.sources.sinks import append_new


def append_increments(rows: DataFrame, path: str, checkpoint: str, key: str = "id") -> StreamingQuery:
    """Append each micro-batch's rows with unknown keys to a Parquet table; a batch that runs twice adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        append_new(batch, path, key)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
