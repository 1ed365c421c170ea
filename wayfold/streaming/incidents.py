"""Recomputing around incidents, as a stream.

Decisions and incidents arrive as rows of one stream, keyed by scenario.  A key's
state holds each decision with its slots, links and version.  An incident
touches the decisions that are not over by its slot and use one of its links: each
gets the next version and is given out; all others are locked.  A timer clears a
key's state once the watermark is past its last event by the idle time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of the stream; ``slot`` and ``hold`` are a decision's, an incident has the slot after which it holds.
EVENTS = "scenario long, ts timestamp, kind string, id long, slot int, hold int, links array<long>"
TOUCHED = "scenario long, incident long, id long, version long, ts timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Recompute(StatefulProcessor):
    """State: decisions as text of [id, slot, hold, links, version], the time until which they are held, and when the key's timer stands.

    It is one value, read and written once for a key's rows of a batch: each call
    of the state store costs more than what a key decides.  A timer that finds the
    key with later rows is set anew.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "decisions string, until long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # the order of events within a batch; a decision of the same time comes before an incident
        batch = sorted(rows, key=lambda r: (r["at"], r["kind"] == "incident", r["id"]))
        decisions, until, timer = self.held.get() or ("[]", None, None)
        held = {d[0]: d for d in json.loads(decisions)}
        out = []
        for r in batch:
            if r["kind"] == "decision":
                held[r["id"]] = [r["id"], r["slot"], r["hold"], sorted(r["links"] or ()), 0]
                continue
            links = set(r["links"] or ())
            for d in held.values():
                if d[1] + d[2] > r["slot"] and not links.isdisjoint(d[3]):
                    d[4] += 1
                    out.append(Row(scenario=key[0], incident=r["id"], id=d[0], version=d[4], ts=r["ts"]))
        last = batch[-1]["at"] // 1000 + self.idle_ms
        until = last if until is None else max(until, last)
        if timer is None:
            timer = until
            self.handle.registerTimer(timer)
        self.held.update((json.dumps(list(held.values())), until, timer))
        return iter(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        decisions, until, _ = self.held.get() or ("[]", None, None)
        if until is None or until <= timerValues.getCurrentWatermarkInMs():
            self.held.clear()
        else:
            self.handle.registerTimer(until)
            self.held.update((decisions, until, until))
        return iter(())

    def close(self) -> None:
        pass


def recomputed(events: DataFrame, idle: str = "36500 days") -> DataFrame:
    """(scenario, incident, id, version, ts) for each decision that an incident touches, as it is touched.

    ``events`` has the columns of ``EVENTS``.  Rows of a batch are taken in the order of
    ts; what comes in a later batch is later.  A decision that comes again starts
    anew.  Rows later than ``idle`` after a key's other rows may find its state gone.
    """
    late = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", idle)
    processor = Recompute(int(pd.Timedelta(idle).total_seconds() * 1000))
    return late.groupBy("scenario").transformWithState(
        statefulProcessor=processor, outputStructType=TOUCHED, outputMode="Update", timeMode="EventTime"
    )


def run_to_end(spark: SparkSession, source: str, out: str, checkpoint: str, idle: str = "36500 days") -> DataFrame:
    """All files that are new since the last call with this checkpoint, as one batch, through :func:`recomputed` into a folder; what is there so far."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(EVENTS).parquet(source)
        # keys are independent, so rows are only ever added
        job = recomputed(stream, idle).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        job.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(TOUCHED).parquet(out)


def as_events(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with the columns of ``EVENTS`` but ``kind``."""
    return rows.withColumn("kind", F.lit(kind)).select("scenario", F.col("ts").cast("timestamp").alias("ts"), "kind", "id", F.col("slot").cast("int").alias("slot"), F.col("hold").cast("int").alias("hold"), F.col("links").cast("array<long>").alias("links"))
