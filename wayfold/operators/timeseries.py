"""Time series: weekdays, daily means, hours, reference speeds, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.numbers import fixed


def date_of(text: Column) -> Column:
    """A date from ``yyyyMMdd`` or ISO text."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("date")


def is_weekday(day: Column) -> Column:
    """Monday to Friday."""
    return F.weekday(day) < 5


def minute_of_day(hhmm: Column) -> Column:
    return F.substring(hhmm, 1, 2).try_cast("int") * 60 + F.substring(hhmm, 3, 2).try_cast("int")


def peak_hour(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The hour with most rows, the first one on ties."""
    hours = df.groupBy(*keys, F.hour(ts).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return hours.groupBy(*keys).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("peak_hour"), F.max("n").alias("n"))


def daily_means(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows a day over the days on record, and over the weekdays on record."""
    days = df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    week = is_weekday(F.col("day"))
    weekdays = F.count(F.when(week, 1))
    return days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        fixed(F.sum("n").cast("double") / F.count(F.lit(1)), 2).alias("daily"),
        fixed(F.sum(F.when(week, F.col("n"))).cast("double") / F.when(weekdays > 0, weekdays), 2).alias("weekday"),
    )


def hours_to_rows(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """A wide table of hour columns, found by their suffix, as rows (hour, value)."""
    columns = [c for c in df.columns if c not in keys and c.endswith(suffix)]
    tall = df.unpivot(keys, columns, "_hour", "value")
    return tall.select(*keys, F.regexp_extract("_hour", r"(\d+)", 1).cast("int").alias("hour"), F.col("value").cast("double").alias("value"))


def ratio_to_median(df: DataFrame, keys: list[str], hour: str, value: str) -> DataFrame:
    """Each hour's mean over the median of the hours' means."""
    means = df.groupBy(*keys, hour).agg(F.avg(value).alias("_m"))
    middle = means.groupBy(*keys).agg(F.median("_m").alias("_mid"))
    return means.join(middle, keys).select(*keys, hour, fixed(F.col("_m") / F.when(F.col("_mid") > 0, F.col("_mid"))).alias("ratio"))


def capacity(df: DataFrame, key: str, ts: str, speed: str, lanes: Column, during: Column) -> DataFrame:
    """Lanes scaled by the speed of each ten-minute slot over the key's 95th percentile of all day, at most whole.

    Halves round to even.
    """
    reference = df.groupBy(key).agg(F.percentile(speed, F.lit(0.95)).alias("_ref"))
    slot = F.floor((F.hour(ts) * 60 + F.minute(ts)) / 10).cast("int").alias("slot")
    # sums of whole ten-thousandths don't depend on the order of rows
    whole = F.sum(F.floor(F.col(speed) * F.lit(1e4) + F.lit(0.5)).cast("long")).cast("double")
    means = df.filter(during).groupBy(key, slot).agg((whole / F.count(F.lit(1)) / F.lit(1e4)).alias("_v"))
    factor = F.when(F.col("_ref") > 0, F.least(F.lit(1.0), F.col("_v") / F.col("_ref")))
    scaled = fixed(lanes * F.col("_f"), 6).cast("decimal(18, 6)")
    return (
        means.join(reference, key)
        .withColumn("_f", factor)
        .select(key, "slot", lanes.alias("lanes"), fixed(F.col("_f"), 3).alias("factor"), F.bround(scaled, 0).cast("int").alias("capacity"))
    )


def sessions(df: DataFrame, key: str, ts: str, order: str, gap_seconds: int) -> DataFrame:
    """Runs of rows without a gap of more than ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(ts, order)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((seconds - F.lag(seconds).over(w)) > gap_seconds * 1_000_000, F.lit(False)).cast("int")
    numbered = df.select(key, ts, order, new.alias("_new")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n_events"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
