"""Readers of tables and of raw exports.

Schemas are always given, never inferred; a field that a row lacks is null.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


CELLS = "cell STRING, n INT, rows ARRAY<STRUCT<rn: STRING, road_bt: DOUBLE, sig_cd: STRING, rds_man_no: BIGINT>>"


def read_cells(spark: SparkSession, path: str, schema: str = CELLS, items: str = "rows") -> DataFrame:
    """JSON lines of cells, plain or gzipped, one row for each item of a cell."""
    return spark.read.schema(schema).json(path).selectExpr("cell", f"inline({items})")


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole file that is one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_document(text: Column, value_ddl: str) -> Column:
    """A JSON object from ids to values as a map, to be exploded."""
    return F.from_json(text, f"MAP<STRING, {value_ddl}>")


def read_text_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV or TSV with a header, all fields as text; a byte-order mark is skipped.

    Spark reads UTF-8 and Latin-1 itself and splits such files.  Legacy
    encodings go through :func:`read_legacy_csv`.
    """
    if encoding.upper() not in ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16"):
        return read_legacy_csv(spark, path, schema, sep, encoding)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding).csv(path)


def _frames(content: bytes, columns: list[str], sep: str, encoding: str, header: bool, chunk: int) -> Iterator[pd.DataFrame]:
    with io.TextIOWrapper(io.BytesIO(content), encoding=encoding, errors="replace") as f:
        names = None if header else columns
        for part in pd.read_csv(f, sep=sep, dtype=str, keep_default_na=False, chunksize=chunk, names=names, header=0 if header else None):
            part.columns = [c.lstrip("﻿") for c in part.columns]
            part = part.reindex(columns=columns)
            yield part.where(part != "", None)


def read_legacy_csv(
    spark: SparkSession, path: str, schema: str, sep: str = ",", encoding: str = "cp949", header: bool = True, chunk: int = 100_000
) -> DataFrame:
    """CSV in an encoding that Spark does not know, decoded file by file; bad bytes are replaced."""
    columns = spark.createDataFrame([], schema).columns

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from _frames(bytes(content), columns, sep, encoding, header, chunk)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, ", ".join(f"`{c}` string" for c in columns))


def read_headless_csv(spark: SparkSession, path: str, schema: str, column: str, wanted: DataFrame) -> DataFrame:
    """CSV without a header, only rows whose ``column`` is in ``wanted``."""
    return spark.read.schema(schema).csv(path).join(wanted.select(column).distinct(), column, "left_semi")


def in_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows whose point lies in (x0, y0, x1, y1); plain comparisons, which reach the scan."""
    x0, y0, x1, y1 = box
    return df.filter((F.col(x) >= x0) & (F.col(x) <= x1) & (F.col(y) >= y0) & (F.col(y) <= y1))


def box_meets(df: DataFrame, box: tuple[float, float, float, float], names: tuple[str, str, str, str] = ("x_min", "y_min", "x_max", "y_max")) -> DataFrame:
    """Rows whose bounds meet a box."""
    x0, y0, x1, y1 = box
    a, b, c, d = (F.col(n) for n in names)
    return df.filter((c >= x0) & (a <= x1) & (d >= y0) & (b <= y1))


def with_prefix(df: DataFrame, column: str, prefixes: list[str]) -> DataFrame:
    """Rows whose text starts with one of the prefixes; each test reaches the scan."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col(column).startswith(p)
    return df.filter(hit)


def wkt_points(wkt: Column) -> Column:
    """The vertices of a line's text form, in order."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?[\d.]+(?:[eE][-+]?\d+)?\s+-?[\d.]+(?:[eE][-+]?\d+)?)"), 1)
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.split(p, r"\s+")[0].try_cast("double").alias("x"), F.split(p, r"\s+")[1].try_cast("double").alias("y")
        ),
    )


GEOJSON = "type STRING, coordinates STRING"


def geojson_line(text: Column) -> Column:
    """The vertices of a GeoJSON LineString."""
    points = F.from_json(F.get_json_object(text, "$.coordinates"), "ARRAY<ARRAY<DOUBLE>>")
    return F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed scan still has to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def layer_catalogue(xml: DataFrame, column: str, tag: str = "Layer", fields: tuple[str, ...] = ("Name", "Title", "Abstract")) -> DataFrame:
    """One row for each layer of capabilities documents, distinct by name without case."""
    layers = F.explode(F.regexp_extract_all(column, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), 1))
    body = xml.select(layers.alias("layer"))
    out = body.select(*(F.nullif(F.trim(F.regexp_extract("layer", rf"(?s)<{f}>(.*?)</{f}>", 1)), F.lit("")).alias(f.lower()) for f in fields))
    key = fields[0].lower()
    least = F.min(F.struct(*(f.lower() for f in fields)))
    return out.filter(F.col(key).isNotNull()).groupBy(F.lower(key).alias("_k")).agg(least.alias("_l")).select("_l.*")


def document_text(xml: Column, paragraph: str = "p", run: str = "t") -> Column:
    """Text of a zipped document's XML: runs joined, paragraphs on lines, entities resolved."""
    paragraphs = F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{paragraph}\b[^>]*>(.*?)</(?:\w+:)?{paragraph}>"), 1)
    runs = F.transform(
        paragraphs,
        lambda p: F.array_join(F.regexp_extract_all(p, F.lit(rf"(?s)<(?:\w+:)?{run}\b[^>]*>(.*?)</(?:\w+:)?{run}>"), 1), ""),
    )
    return unescape(F.array_join(runs, "\n"))


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def adaptive_cells(points: DataFrame, x: str, y: str, size: float, cap: int, depth: int = 12) -> DataFrame:
    """Split a grid of ``size`` in four where a cell holds more than ``cap`` points.

    Returns (level, cx, cy, n).  Each level is one aggregation of the points that
    are still in full cells; ``depth`` bounds a heap of equal points.
    """
    found, left = None, points.select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    for level in range(depth + 1):
        edge = F.lit(size / 2**level)
        placed = left.withColumn("cx", F.floor(F.col("_x") / edge)).withColumn("cy", F.floor(F.col("_y") / edge))
        counted = placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
        done = counted if level == depth else counted.filter(F.col("n") <= cap)
        done = done.select(F.lit(level).alias("level"), "cx", "cy", "n")
        found = done if found is None else found.unionByName(done)
        if level < depth:
            left = placed.join(counted.filter(F.col("n") > cap).select("cx", "cy"), ["cx", "cy"], "left_semi").select("_x", "_y")
    return found
