"""Duplicate rows by key: which one stays, and what was dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_dedup(df: DataFrame, keys: list[str], order: list[Column], last: bool = False) -> DataFrame:
    """One row a key, the first (or last) by ``order``.

    Rows without a whole key are kept all.  They skip the window, so that the
    keyless rows never meet in one task.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    by = [c.desc() for c in order] if last else order
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    one = df.filter(whole).withColumn("_place", place).filter("_place = 1").drop("_place")
    return one.unionByName(df.filter(~whole))


def conflicts(df: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """One row: rows, keys, dropped duplicates, and those that differ in ``value`` from the row that stays."""
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("first"))).alias("f")
    # groups instead of a window: partial aggregation, and no sort of the rows
    per_value = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), first)
    per_key = per_value.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("f").alias("f"), F.collect_list(F.struct(F.col(value).alias("v"), "n")).alias("values")
    )
    differing = F.aggregate(
        F.filter("values", lambda x: ~x["v"].eqNullSafe(F.col("f.first"))), F.lit(0).cast("long"), lambda acc, x: acc + x["n"]
    )
    return per_key.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.col("n") - 1).alias("n_dropped"),
        F.sum(differing).alias("n_conflicts"),
    )


def multipart_collapse(df: DataFrame, keys: list[str], part: str, order: str) -> DataFrame:
    """Rows of one key as one row with the list of their parts, in order."""
    packed = F.array_sort(F.collect_list(F.struct(order, part)))
    return df.groupBy(*keys).agg(F.transform(packed, lambda x: x[part]).alias(part))
