"""Writers and renderers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str], single: bool = False, mark: bool = False) -> None:
    """CSV with a header and ordered columns; ``mark`` begins the header with a byte-order mark."""
    out = df.select(*columns)
    if mark:
        out = out.withColumnRenamed(columns[0], "﻿" + columns[0])
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def report(df: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def markdown_row(*columns: Column) -> Column:
    """Cells between bars; a null cell is empty."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def geojson_feature(points: Column, properties: Column) -> Column:
    """A LineString feature."""
    line = F.transform(points, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), line.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))


def masked(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("***"))


def leaks(df: DataFrame, columns: list[str], secret: str) -> DataFrame:
    """How many rows still hold a secret in any column."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.col(c), F.lit(secret)), F.lit(False))
    return df.agg(F.coalesce(F.sum(F.when(hit, 1).otherwise(0)), F.lit(0)).cast("long").alias("n_leaks"))


def with_total(df: DataFrame, label: str, total: str, sums: list[str]) -> DataFrame:
    """The rows and a last one with their sums."""
    last = df.agg(*(F.sum(c).alias(c) for c in sums)).withColumn(label, F.lit(total))
    return df.select(label, *sums).unionByName(last.select(label, *sums))
