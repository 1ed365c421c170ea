"""Verdicts on rows, taken back to the rows they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surviving(docs: DataFrame, key: Column, verdict: DataFrame, once_without_id: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay.

    ``verdict`` is a written table (doc_id, key, stays) with a row for each row
    of ``docs``; ``key`` gives a row's key.  Rows with one (doc_id, key) share one
    verdict, and one of them stays; of rows without a doc_id only if
    ``once_without_id``, else all.
    """
    by = F.col("doc_id").eqNullSafe(F.col("_v_id")) & (F.col("_v_key") == F.col("_v_own"))
    rows = docs.withColumn("_v_own", key)
    named = verdict.select(F.col("doc_id").alias("_v_id"), F.col("key").alias("_v_key"), "stays")
    left = rows.join(named.filter("NOT stays").drop("stays").distinct(), by, "left_anti")
    counted = named.filter("stays").groupBy("_v_id", "_v_key").agg(F.count(F.lit(1)).alias("n"))
    repeated = counted.filter(F.lit(once_without_id) | F.col("_v_id").isNotNull()).filter("n > 1").drop("n")
    if not repeated.isEmpty():
        once = left.join(repeated, by, "left_semi").dropDuplicates(["doc_id", "_v_own"])
        left = left.join(repeated, by, "left_anti").unionByName(once)
    return left.select(*docs.columns)
