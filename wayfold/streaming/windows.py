"""Streams: windowed counts, resumed ingestion with dead letters, recomputing around an incident."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(df: DataFrame, ts: str, width: str, keys: list[str], late: str | None = "30 minutes", id_column: str = "event_id") -> DataFrame:
    """Rows of each window and key; the same plan for a table and, with a watermark, a stream."""
    if late is not None:
        df = df.withWatermark(ts, late)
    counted = df.groupBy(*keys, F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("first_id"))
    return counted.select(*keys, F.col("window.start").alias("bucket"), "n", "first_id")


def read_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """New Parquet files of a folder; the query's checkpoint is the set of files that are done."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def split_failures(valid: Column, good: str, bad: str):
    """A ``foreachBatch`` function: valid rows to one folder and the others, with their batch, to a second.

    Each batch has a folder of its own, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(valid, F.lit(False))
        batch.persist()
        batch.filter(ok).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter(~ok).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return write


def decision_versions(events: DataFrame, key: str, ts: str, idle: str = "1 hour") -> DataFrame:
    """For each key a version that grows with each batch of events that touches it.

    State is one pair of numbers a key, and goes when the watermark passes
    ``idle`` after its last event.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        version, seen = state.get if state.exists else (0, 0)
        latest = 0
        for f in frames:
            seen += len(f)
            latest = max(latest, int(f["_ms"].max()))
        state.update((version + 1, seen))
        state.setTimeoutTimestamp(max(latest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [str(k[0])], "version": [version + 1], "n_seen": [seen]})

    marked = events.withWatermark(ts, idle).withColumn("_ms", F.unix_millis(F.col(ts).cast("timestamp")))
    return marked.groupBy(key).applyInPandasWithState(
        update, f"{key} string, version long, n_seen long", "version long, n_seen long", "update", GroupStateTimeout.EventTimeTimeout
    )
