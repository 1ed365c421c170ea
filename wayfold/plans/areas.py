"""Queries: areas with holes and islands, lines cut by them, room along a line, outlines of unions.

The driver's tables have no areas; each row gets one from its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.numbers import fixed
from wayfold.operators import polygons
from wayfold.operators.spatial import spread
from wayfold.plans.base import fx, query
from wayfold.sources.tables import table


def _point(x: Column | float, y: Column | float) -> Column:
    x, y = (v if isinstance(v, Column) else F.lit(float(v)) for v in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _box(x0: Column | float, y0: Column | float, x1: Column | float, y1: Column | float) -> Column:
    return F.array(_point(x0, y0), _point(x1, y0), _point(x1, y1), _point(x0, y1))


_NO_RINGS = "array<array<struct<x: double, y: double>>>"

_BOXES = """b AS (SELECT n_regionkey AS region, c_custkey * 7919 % 400 AS x, c_custkey * 10473 % 400 AS y, 4 + c_custkey % 9 AS w, 3 + c_custkey % 7 AS h, c_custkey % 4 = 0 AS holed
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""
WITH {_BOXES}, c AS (SELECT region, x + i AS x, y + j AS y FROM b, range(12) r(i), range(9) s(j) WHERE i < w AND j < h AND NOT (holed AND i BETWEEN 1 AND w - 2 AND j BETWEEN 1 AND h - 2)),
d AS (SELECT DISTINCT * FROM c), n AS (SELECT region, x + dx AS x, y + dy AS y FROM d, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)),
o AS (SELECT n.region, count(*) AS perimeter FROM n LEFT JOIN d ON d.region = n.region AND d.x = n.x AND d.y = n.y WHERE d.x IS NULL GROUP BY 1)
SELECT o.region, CAST(perimeter AS DOUBLE) AS perimeter, CAST(area AS DOUBLE) AS area FROM o JOIN (SELECT region, count(*) AS area FROM d GROUP BY 1) a ON a.region = o.region""")
def union_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Perimeter and area of the union of each region's boxes, one a customer, every fourth with a hole."""
    k = F.col("c_custkey")
    x, y, w, h = k * 7919 % 400, k * 10473 % 400, 4 + k % 9, 3 + k % 7
    hole = F.when(k % 4 == 0, F.array(_box(x + 1, y + 1, x + w - 1, y + h - 1))).otherwise(F.array().cast(_NO_RINGS))
    rings = F.concat(F.array(_box(x, y, x + w, y + h)), hole)
    regions = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    rows = table(spark, sf, "customer").join(regions, "c_nationkey").select("region", "c_custkey", rings.alias("rings"))
    measures = polygons.outline_measures(polygons.union_outline(rows, "region", "c_custkey", "rings", 8.0), "region")
    return measures.select("region", fixed(F.col("perimeter")).alias("perimeter"), fixed(F.col("area")).alias("area"))


@query("""
WITH n AS (SELECT n_nationkey, CAST(n_nationkey % 5 * 200 AS DOUBLE) + 5e-1 AS x, CAST(n_nationkey // 5 * 200 AS DOUBLE) + 5e-1 AS y FROM nation),
p AS (SELECT c_custkey, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS px, CAST(c_custkey * 10473 % 1000 AS DOUBLE) AS py FROM customer),
h AS (SELECT c_custkey, n_nationkey FROM p JOIN n ON px > x AND px < x + 180 AND py > y AND py < y + 180 AND NOT (px > x + 60 AND px < x + 120 AND py > y + 60 AND py < y + 120 AND NOT (px > x + 80 AND px < x + 90 AND py > y + 80 AND py < y + 90)))
SELECT p.c_custkey, n_nationkey FROM p LEFT JOIN h ON h.c_custkey = p.c_custkey""")
def area_of_point(spark: SparkSession, sf: str) -> DataFrame:
    """The area that holds each customer's point: squares with a hole and an island in it."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    x, y = n % 5 * 200 + 0.5, F.floor(n / 5) * 200 + 0.5
    rings = F.array(_box(x, y, x + 180, y + 180), _box(x + 60, y + 60, x + 120, y + 120), _box(x + 80, y + 80, x + 90, y + 90))
    areas = table(spark, sf, "nation").select("n_nationkey", rings.alias("rings"))
    points = table(spark, sf, "customer").select("c_custkey", (k * 7919 % 1000).cast("double").alias("px"), (k * 10473 % 1000).cast("double").alias("py"))
    return polygons.assign_to_areas(points, areas, "px", "py", "rings", 100.0).select("c_custkey", "n_nationkey")


@query(f"""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 120 AS DOUBLE) AS px, p_partkey % 2 = 0 AS through FROM part),
v AS (SELECT p_partkey, px, s + a AS a, s + b AS b FROM p JOIN (VALUES (true, 0, 10), (true, 20, 40), (true, 50, 60), (false, 0, 40), (false, 50, 60)) v(t, a, b) ON t = through),
d AS (SELECT *, greatest(a - px, px - b, 0e0) AS d FROM v)
SELECT p_partkey, CAST(count(*) AS INTEGER) AS n, {fx('sum(b - a)')} AS inside, {fx('min(d)')} AS d, {fx('arg_min(a + 5, (d, a))')} AS "from", {fx('arg_min(b + 5, (d, a))')} AS "to" FROM d GROUP BY p_partkey""")
def clipped_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """The stretches of a line in an area with a hole and a second part, and the one nearest to the part's point."""
    s, k = F.col("p_size"), F.col("p_partkey")
    rings = F.array(_box(s, 0.0, s + 40, 20.0), _box(s + 10, 5.0, s + 20, 15.0), _box(s + 50, 0.0, s + 60, 20.0))
    y = F.when(k % 2 == 0, 10.5).otherwise(2.5)
    line = F.array(_point(-5.0, y), _point(30.0, y), _point(130.0, y))
    rows = table(spark, sf, "part").select("p_partkey", line.alias("line"), rings.alias("rings"), (k % 120).cast("double").alias("px"), y.alias("py"))
    rows = spread(rows, "p_partkey")  # a small file is one task
    rows = rows.withColumn("all", polygons.inside_stretches(F.col("line"), F.col("rings")))
    rows = rows.withColumn("best", polygons.nearest_stretch(F.col("line"), F.col("rings"), F.col("px"), F.col("py")))
    inside = F.aggregate("all", F.lit(0.0), lambda acc, p: acc + p["to"] - p["from"])
    best = [fixed(F.col("best")[c]).alias(c) for c in ("d", "from", "to")]
    return rows.select("p_partkey", F.size("all").alias("n"), fixed(inside).alias("inside"), *best)


_TWO = "floor({} * 100 + 5e-1) / 100"


@query(f"""
WITH p AS (SELECT p_partkey, p_size + 10 AS long, CASE p_partkey % 10 WHEN 0 THEN 'no area' WHEN 1 THEN 'not inside' ELSE CASE WHEN p_size + 10 < 14 THEN 'too short' ELSE 'ok' END END AS status FROM part),
s AS (SELECT p_partkey, CAST(long AS DOUBLE) AS long, CAST(unnest(range(2, long - 1)) AS DOUBLE) AS x FROM p WHERE status = 'ok'),
e AS (SELECT p_partkey, least(3e0, 5e0, x, long - x, CASE WHEN long > 12 THEN sqrt(greatest(10 - x, 0e0, x - 12) * greatest(10 - x, 0e0, x - 12) + 9) ELSE 5e0 END) AS e FROM s),
g AS (SELECT p_partkey, count(*) AS n, list_sort(list(2 * e)) AS w, list_sort(list(2 * least(e, 1e0))) AS v, list_sort(list(1e0 - e)) AS g FROM e GROUP BY 1)
SELECT p.p_partkey, status, CAST(n AS INTEGER) AS n_samples, """
+ ", ".join(
    f"{_TWO.format(f'{c}[{at}]')} AS {name}_{label}"
    for name, c in (("width", "w"), ("deducted", "v"), ("gap", "g"))
    for label, at in (("least", "1"), ("p10", "greatest(1, n // 10)"), ("median", "n // 2 + 1"))
)
+ " FROM p LEFT JOIN g ON g.p_partkey = p.p_partkey")
def medial_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Room along a line through an area with a hole, with and without a wall beside it, and why there is none."""
    long, k = F.col("p_size") + 10, F.col("p_partkey")
    area = F.array(_box(0.0, 0.0, long, 8.0), _box(10.0, 6.0, 12.0, 7.0))
    beside = F.array(_box(0.0, 20.0, long, 28.0))
    rings = F.when(k % 10 == 0, F.array().cast(_NO_RINGS)).when(k % 10 == 1, beside).otherwise(area)
    line, wall = F.array(_point(-5.0, 3.0), _point(100.0, 3.0)), F.array(_point(0.0, 4.0), _point(100.0, 4.0))
    rows = spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")  # dealt before the shapes are made
    rows = rows.select("p_partkey", line.alias("line"), rings.alias("rings"), F.array(wall).alias("walls"), F.lit(7.0).alias("x"), F.lit(3.0).alias("y"))
    out = polygons.medial_width(rows, "line", "rings", "x", "y", "walls")
    return out.drop("line", "rings", "walls", "x", "y")
