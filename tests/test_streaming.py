"""Streams against their batch twins."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wayfold.streaming import incidents, windows

DDL = "event_id long, ts timestamp, event_type string, value double"


def test_windowed_counts_of_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=3 * i), "ab"[i % 2], float(i)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], DDL).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    folder = str(tmp_path / "in" / "*")
    stream = windows.windowed_counts(windows.read_stream(spark, folder, DDL, 1), "ts", "10 minutes", ["event_type"], late="5 minutes")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = windows.windowed_counts(spark.createDataFrame(rows, DDL), "ts", "10 minutes", ["event_type"], late=None)
    assert sorted(map(tuple, spark.sql("SELECT * FROM counts").collect())) == sorted(map(tuple, want.collect()))


def test_dead_letters_and_resume(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1), "a", None if i % 3 == 0 else float(i)) for i in range(9)]
    source = str(tmp_path / "in")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")

    def run():
        q = (
            windows.read_stream(spark, source, DDL)
            .writeStream.foreachBatch(windows.split_failures(F.col("value").isNotNull(), good, bad))
            .option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()

    spark.createDataFrame(rows[:6], DDL).coalesce(1).write.parquet(source)
    run()
    spark.createDataFrame(rows[6:], DDL).coalesce(1).write.mode("append").parquet(source)
    run()  # only the new file is read
    assert spark.read.parquet(good).count() == 6 and spark.read.parquet(bad).count() == 3


def test_versions_grow_with_each_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, datetime(2024, 1, 1), "a", 1.0), (2, datetime(2024, 1, 1), "b", 1.0), (3, datetime(2024, 1, 1, 0, 5), "a", 1.0)]
    spark.createDataFrame(rows[:2], DDL).coalesce(1).write.parquet(source)
    stream = windows.decision_versions(windows.read_stream(spark, source, DDL), "event_type", "ts")
    q = stream.writeStream.outputMode("update").format("memory").queryName("versions").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    spark.createDataFrame(rows[2:], DDL).coalesce(1).write.mode("append").parquet(source)
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT event_type, version, n_seen FROM versions").collect())) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]


def replayed(rows):
    """(scenario, incident, id, version) by a plain loop over one key's rows after the other."""
    out, held = [], {}
    for s, ts, kind, i, slot, hold, links in sorted(rows, key=lambda r: (r[0], r[1], r[2] == "incident", r[3])):
        if kind == "decision":
            held[s, i] = [slot, hold, set(links), 0]
            continue
        for (k, d), x in held.items():
            if k == s and x[0] + x[1] > slot and x[2] & set(links):
                x[3] += 1
                out.append((s, i, d, x[3]))
    return sorted(out)


def test_incidents_touch_open_decisions_on_their_links(spark, tmp_path):
    r = random.Random(2)
    t0 = datetime(2024, 1, 1)
    rows = [
        (i % 5, t0 + timedelta(minutes=i // 2), "incident" if r.random() < 0.2 else "decision", i, r.randrange(4), r.randrange(1, 3), [r.randrange(4), r.randrange(4)])
        for i in range(120)
    ]
    where = [f"file://{tmp_path}/{n}" for n in ("in", "out", "cp")]
    for part in (rows[:50], rows[50:51], rows[51:]):  # taken up again from the checkpoint
        spark.createDataFrame(part, incidents.EVENTS).repartition(3).write.mode("append").parquet(where[0])
        found = incidents.run_to_end(spark, *where)
    assert sorted((x.scenario, x.incident, x.id, x.version) for x in found.collect()) == replayed(rows)


def test_state_of_idle_scenarios_goes(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    where = [f"file://{tmp_path}/{n}" for n in ("in", "out", "cp")]
    steps = [
        [(1, t0, "decision", 10, 0, 5, [7])],
        [(2, t0 + timedelta(hours=9), "decision", 20, 0, 5, [7])],  # the watermark passes the first one's timer
        [(2, t0 + timedelta(hours=10), "incident", 21, 1, 0, [7])],
        [(1, t0 + timedelta(hours=11), "incident", 11, 1, 0, [7]), (2, t0 + timedelta(hours=11), "incident", 22, 1, 0, [7, 8])],
    ]
    for part in steps:
        spark.createDataFrame(part, incidents.EVENTS).coalesce(1).write.mode("append").parquet(where[0])
        found = incidents.run_to_end(spark, *where, idle="2 hours")
    assert sorted((x.scenario, x.incident, x.id, x.version) for x in found.collect()) == [(2, 21, 20, 1), (2, 22, 20, 2)]
