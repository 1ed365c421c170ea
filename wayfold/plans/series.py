"""Queries: time series, profiles of the day, capacities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from wayfold.operators import timeseries
from wayfold.plans.base import fx, query
from wayfold.sources.tables import table
from wayfold.workspace import Workspace


@query("""
WITH h AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS h, CAST(count(*) AS BIGINT) AS n FROM events WHERE isodow(ts) < 6 GROUP BY ALL)
SELECT event_type, h AS peak_hour, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, h) AS rn FROM h) WHERE rn = 1""")
def weekday_peak_hour(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.peak_hour(table(spark, sf, "events").filter(timeseries.is_weekday(F.col("ts"))), ["event_type"], "ts")


@query(f"""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL)
SELECT user_id, CAST(count(*) AS BIGINT) AS days, {fx("CAST(sum(n) AS DOUBLE) / count(*)", 2)} AS daily,
       {fx("CAST(sum(n) FILTER (WHERE isodow(day) < 6) AS DOUBLE) / nullif(count(*) FILTER (WHERE isodow(day) < 6), 0)", 2)} AS weekday
FROM d GROUP BY user_id""")
def daily_means(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.daily_means(table(spark, sf, "events"), ["user_id"], "ts")


@query(f"""
WITH h AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL)
SELECT event_type, hour, {fx("n / median(n) OVER (PARTITION BY event_type)")} AS ratio FROM h""")
def hourly_profile_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Through a wide table of hours and back, as such profiles are published."""
    hours = list(range(24))
    wide = table(spark, sf, "events").withColumn("h", F.hour("ts")).groupBy("event_type").pivot("h", hours).count()
    wide = wide.select("event_type", *(F.col(str(h)).alias(f"{h}시") for h in hours))
    tall = timeseries.hours_to_rows(wide, ["event_type"], "시").filter("value IS NOT NULL")
    return timeseries.ratio_to_median(tall, ["event_type"], "hour", "value")


_SLOT = "CAST(floor((hour(ts) * 60 + minute(ts)) / 10) AS INTEGER)"


@query(f"""
WITH r AS (SELECT user_id, quantile_cont(value, 0.95) AS ref FROM events GROUP BY 1),
m AS (SELECT user_id, {_SLOT} AS slot, CAST(sum(CAST(floor(value * 1e4 + 5e-1) AS BIGINT)) AS DOUBLE) / count(*) / 1e4 AS v FROM events WHERE hour(ts) = 20 GROUP BY ALL),
c AS (SELECT m.user_id, slot, 1 + m.user_id % 4 AS lanes, CASE WHEN ref > 0 THEN least(1.0, v / ref) END AS f FROM m JOIN r ON m.user_id = r.user_id)
SELECT user_id, slot, CAST(lanes AS INTEGER) AS lanes, {fx("f", 3)} AS factor, CAST(round_even(CAST({fx("lanes * f", 6)} AS DECIMAL(18, 6)), 0) AS INTEGER) AS capacity FROM c""")
def capacity_ratio(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    lanes = (1 + F.col("user_id") % 4).cast("int")
    return timeseries.capacity(events, "user_id", "ts", "value", lanes, F.hour("ts") == 20)


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS stem FROM conversations""")
def stem_inheritance(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    stem = F.last(F.when(F.col("role") == "user", F.length("text")), ignorenulls=True).over(w)
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", stem.cast("long").alias("stem"))


@query("""
WITH b AS (SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS bucket, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id FROM events GROUP BY ALL)
SELECT event_type, bucket, n, first_id FROM b""")
def event_session_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The batch twin of the streaming count by ten-minute window."""
    from wayfold.streaming.windows import windowed_counts

    return windowed_counts(table(spark, sf, "events"), "ts", "10 minutes", ["event_type"], late=None)


@query(f"""
WITH s AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR AS gap FROM events),
g AS (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM s)
SELECT user_id, CAST(n AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n_events, min(ts) AS started, max(ts) AS ended FROM g GROUP BY user_id, n""")
def sessions(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.sessions(table(spark, sf, "events"), "user_id", "ts", "event_id", 6 * 3600)


@query("""
WITH e AS (SELECT o_custkey AS scenario, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey AS id, o_orderkey % 10 IN (0, 5) AS incident, CAST(o_orderkey % 4 AS INTEGER) AS slot, CAST(1 + o_custkey % 2 AS INTEGER) AS hold,
           [o_orderkey % 3, o_orderkey // 3 % 5] AS links FROM orders),
t AS (SELECT i.scenario, i.id AS incident, d.id, i.ts FROM e i JOIN e d ON i.scenario = d.scenario AND i.incident AND NOT d.incident AND d.ts <= i.ts AND d.slot + d.hold > i.slot AND list_has_any(i.links, d.links))
SELECT scenario, incident, id, row_number() OVER (PARTITION BY scenario, id ORDER BY ts, incident) AS version FROM t""")
def incident_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions that incidents touch, with their versions, by a stream that is taken up again after each of three spans of time."""
    from wayfold.streaming import incidents

    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        c.alias("scenario"), F.col("o_orderdate").alias("ts"), o.alias("id"), (o % 4).alias("slot"), (1 + c % 2).alias("hold"), F.array(o % 3, F.floor(o / 3) % 5).alias("links")
    )
    both = incidents.as_events(rows.filter("id % 10 NOT IN (0, 5)"), "decision").unionByName(incidents.as_events(rows.filter("id % 10 IN (0, 5)"), "incident"))
    work = Workspace(spark, "incidents")
    spans = [(None, "1994-01-01"), ("1994-01-01", "1996-06-01"), ("1996-06-01", None)]
    for start, end in spans:
        part = both.filter(f"ts >= '{start}'") if start else both
        part = part.filter(f"ts < '{end}'") if end else part
        part.write.mode("append").parquet(work.folder("in"))
        found = incidents.run_to_end(spark, work.folder("in"), work.folder("out"), work.folder("checkpoint"))
    return found.select("scenario", "incident", "id", "version")
