"""Masks and their outlines: smallest rectangles, runs of cells, unions of polygons, clipped lines."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

RECTANGLE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("A", "L", "S", "R")])


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def smallest_rectangle(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Long and short side of the smallest rectangle around points; one side lies on the hull."""
    ring = hull(points)
    if len(ring) < 2:
        return 0.0, 0.0
    best = None
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        n = math.hypot(x1 - x0, y1 - y0)
        ux, uy = (x1 - x0) / n, (y1 - y0) / n
        along = [x * ux + y * uy for x, y in ring]
        across = [y * ux - x * uy for x, y in ring]
        sides = (max(along) - min(along), max(across) - min(across))
        if best is None or sides[0] * sides[1] < best[0] * best[1]:
            best = sides
    return max(best), min(best)


def area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


@pandas_udf(RECTANGLE)
def rectangle_of(outline: pd.Series) -> pd.DataFrame:
    """Area, long side, short side and fill of an outline; null without three vertices."""
    rows = []
    for ring in outline:
        pts = [(p["x"], p["y"]) for p in ring] if ring is not None else []
        if len(pts) < 3:
            rows.append((None,) * 4)
            continue
        long, short = smallest_rectangle(pts)
        a = area(pts)
        rows.append((a, long, short, a / (long * short) if long * short else None))
    return pd.DataFrame(rows, columns=["A", "L", "S", "R"])


def runs(cells: DataFrame, keys: list[str], line: str, place: str) -> DataFrame:
    """Longest unbroken run of cells of each line; ``cells`` are the set cells."""
    w = Window.partitionBy(*keys, line).orderBy(place)
    numbered = cells.select(*keys, line, place).distinct().withColumn("_g", F.col(place) - F.row_number().over(w))
    return numbered.groupBy(*keys, line, "_g").agg(F.count(F.lit(1)).alias("run")).groupBy(*keys, line).agg(F.max("run").alias("run"))


def run_width(cells: DataFrame, keys: list[str], line: str, place: str, n_lines: int, cover: float = 0.5, spread: float = 0.5) -> DataFrame:
    """Mean longest run of a mask's lines, null if too few lines have one or they differ too much."""
    r = runs(cells, keys, line, place).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("run").alias("_m"), F.stddev_pop("run").alias("_s")
    )
    ok = (F.col("n") >= cover * n_lines) & (F.col("_s") / F.col("_m") <= spread)
    return r.select(*keys, "n", F.when(ok, F.col("_m")).alias("width"))


def union_boundary(polygons: DataFrame, key: str, ring: str) -> DataFrame:
    """Edges on the boundary of the union of polygons that share whole edges: those that occur once."""
    n = F.size(ring)
    edges = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.array_sort(F.array(F.col(ring)[i], F.col(ring)[F.pmod(i + 1, n)])),
    )
    one = polygons.select(key, F.explode(edges).alias("e")).groupBy(key, "e").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return one.select(key, F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))


def clip_convex(a: Column, b: Column, ring: Column) -> Column:
    """The part (from, to) in [0, 1] of a segment that lies in a convex ring given counter-clockwise; null if none does."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(ring[i].alias("p"), ring[F.pmod(i + 1, n)].alias("q")))
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def cut(acc: Column, e: Column) -> Column:
        ex, ey = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        # inside is to the left of an edge: at + t * step >= 0
        at = ex * (a["y"] - e["p"]["y"]) - ey * (a["x"] - e["p"]["x"])
        step = ex * dy - ey * dx
        t = -at / F.when(step != 0, step)
        return F.struct(
            F.when(step > 0, F.greatest(acc["lo"], t)).when((step == 0) & (at < 0), F.lit(2.0)).otherwise(acc["lo"]).alias("lo"),
            F.when(step < 0, F.least(acc["hi"], t)).otherwise(acc["hi"]).alias("hi"),
        )

    return F.aggregate(edges, start, cut, lambda acc: F.when(acc["lo"] < acc["hi"], F.struct(acc["lo"].alias("from"), acc["hi"].alias("to"))))


def sharpness_gain(df: DataFrame, keys: list[str], level: str, value: str, low: int, high: int) -> DataFrame:
    """Variance at one level over that at another."""
    v = df.groupBy(*keys).agg(
        F.var_pop(F.when(F.col(level) == high, F.col(value))).alias("_h"), F.var_pop(F.when(F.col(level) == low, F.col(value))).alias("_l")
    )
    return v.select(*keys, (F.col("_h") / F.when(F.col("_l") > 0, F.col("_l"))).alias("gain"))
