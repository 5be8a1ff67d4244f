"""Streaming ingest: new vectors are assigned to partitions, encoded and added to a stored index."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vexel.plans import search


def ingest(stream: DataFrame, path: str, checkpoint: str, id_col: str = "vec_id", vec_col: str = "embedding", **fields) -> StreamingQuery:
    """Adds each micro-batch to the index at `path` as a batch of its number, so a repeated micro-batch replaces itself; runs until the input is read."""

    def write(batch: DataFrame, number: int) -> None:
        search.add(batch.sparkSession, path, batch, f"stream-{number}", id_col, vec_col, **fields)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partition_counts(stream: DataFrame, time_col: str, key: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows of each key in each time window, with late rows accepted up to `late`."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).count()
