"""Queries: distances, nearest facilities, polygons, matches.

The driver's tables have no coordinates; points are made from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.numbers import count_of
from wayfold.operators import spatial
from wayfold.plans.base import n_if, query
from wayfold.sources.tables import table, tables


def _xy(key: str) -> tuple[Column, Column]:
    k = F.col(key)
    return ((k * 7919) % 1000).cast("double"), ((k * 10473) % 1000).cast("double")


def _xy_sql(key: str, a: str) -> str:
    return f"CAST(({key} * 7919) % 1000 AS DOUBLE) AS {a}x, CAST(({key} * 10473) % 1000 AS DOUBLE) AS \"{a}y\""


def _points(df: DataFrame, key: str, a: str, *more: str) -> DataFrame:
    x, y = _xy(key)
    return df.select(key, x.alias(f"{a}x"), y.alias(f"{a}y"), *more)


_C = f"c AS (SELECT c_custkey, c_nationkey, c_mktsegment, {_xy_sql('c_custkey', 'a')} FROM customer)"
_S = f"s AS (SELECT s_suppkey, s_nationkey, {_xy_sql('s_suppkey', 'b')} FROM supplier)"
_P = f"p AS (SELECT p_partkey, p_name, p_brand, {_xy_sql('p_partkey', 'a')} FROM part)"
_D = 'sqrt((ax - bx) * (ax - bx) + (ay - "by") * (ay - "by"))'


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    return _points(table(spark, sf, "customer"), "c_custkey", "a", "c_nationkey", "c_mktsegment")


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return _points(table(spark, sf, "supplier"), "s_suppkey", "b", "s_nationkey")


@query(f"""
WITH {_C}, {_S}, r AS (SELECT c_custkey, s_suppkey, {_D} AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY {_D}, s_suppkey) AS rn FROM c, s)
SELECT c_custkey, s_suppkey, d FROM r WHERE rn = 1""")
def nearest_facility(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest(_customers(spark, sf), _suppliers(spark, sf), "c_custkey", "s_suppkey", 100.0).select("c_custkey", "s_suppkey", "d")


@query(f"""
WITH {_C}, {_S}, r AS (SELECT c_custkey, s_suppkey, {_D} AS d, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY {_D}, s_suppkey) AS INTEGER) AS place FROM c, s)
SELECT c_custkey, s_suppkey, d, place FROM r WHERE place <= 3""")
def nearest_three(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest(_customers(spark, sf), _suppliers(spark, sf), "c_custkey", "s_suppkey", 100.0, k=3)


@query(f"WITH {_P}, {_S} SELECT p_partkey, s_suppkey, {_D} AS d FROM p, s WHERE {_D} <= 30")
def dwithin_pairs(spark: SparkSession, sf: str) -> DataFrame:
    parts = _points(table(spark, sf, "part"), "p_partkey", "a")
    return spatial.within(parts, _suppliers(spark, sf), 30.0).select("p_partkey", "s_suppkey", "d")


@query(f"""
WITH {_C}, {_S}, r AS (SELECT c_custkey, s_suppkey, {_D} AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY {_D}, s_suppkey) AS rn, count(*) FILTER (WHERE {_D} <= 60) OVER (PARTITION BY c_custkey) AS n FROM c, s)
SELECT c_custkey, s_suppkey, d, CASE WHEN d <= 60 THEN 'in' ELSE 'N' END AS tag FROM r WHERE d <= 60 OR (n = 0 AND rn = 1)""")
def radius_else_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.within_or_nearest(_customers(spark, sf), _suppliers(spark, sf), "c_custkey", "s_suppkey", 60.0)


@query(f"""
WITH {_C}, {_S}, r AS (SELECT c_custkey, s_suppkey, {_D} AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY {_D}, s_suppkey) AS rn FROM c, s WHERE s_nationkey IN (1, 2, 3))
SELECT c_custkey, s_suppkey, d FROM r WHERE rn = 1""")
def constrained_nearest(spark: SparkSession, sf: str) -> DataFrame:
    some = _suppliers(spark, sf).filter(F.col("s_nationkey").isin(1, 2, 3))
    return spatial.nearest(_customers(spark, sf), some, "c_custkey", "s_suppkey", 200.0).select("c_custkey", "s_suppkey", "d")


@query(f"""
WITH {_C}, {_S}, r AS (SELECT c_custkey, s_nationkey, {_D} AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY {_D}, s_suppkey) AS rn FROM c, s)
SELECT c_custkey, d <= 40 AND s_nationkey < 12 AS alley FROM r WHERE rn = 1""")
def competing_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the nearest facility is within reach and itself of the wanted kind."""
    suppliers = _suppliers(spark, sf)
    near = spatial.nearest(_customers(spark, sf), suppliers, "c_custkey", "s_suppkey", 100.0)
    kinds = near.join(suppliers.select("s_suppkey", "s_nationkey").hint("merge"), "s_suppkey")
    return kinds.select("c_custkey", ((F.col("d") <= 40) & (F.col("s_nationkey") < 12)).alias("alley"))


@query(f"""
WITH {_P}, {_S}, f AS (SELECT p_partkey, p_brand, EXISTS (SELECT 1 FROM s WHERE {_D} <= 25) AS near FROM p)
SELECT p_brand, CAST(count(*) AS BIGINT) AS n, {n_if("near")} AS n_near FROM f GROUP BY p_brand""")
def spatial_flag_join(spark: SparkSession, sf: str) -> DataFrame:
    parts = _points(table(spark, sf, "part"), "p_partkey", "a", "p_brand")
    flagged = spatial.near_flag(parts, _suppliers(spark, sf), "p_partkey", 25.0, "near")
    return flagged.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), count_of(F.col("near")).alias("n_near"))


@query(f"""
WITH a AS (SELECT c_custkey AS l, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS name, {_xy_sql('c_custkey', 'a')} FROM customer),
f AS (SELECT p_partkey % 25 AS name, {_xy_sql('p_partkey', 'b')} FROM part),
b AS (SELECT s_suppkey AS r, CASE WHEN s_nationkey = 7 THEN -1 ELSE s_nationkey END AS name, {_xy_sql('s_suppkey', 'b')} FROM supplier),
s AS (SELECT DISTINCT l FROM a JOIN f ON a.name = f.name WHERE {_D} <= 100),
m AS (SELECT l, r, {_D} AS d, sqrt((ax - bx + 40) * (ax - bx + 40) + (ay - "by") * (ay - "by")) AS dm,
             row_number() OVER (PARTITION BY l ORDER BY {_D}, r) AS rn FROM a JOIN b ON a.name = b.name),
j AS (SELECT a.l, r, d, CASE WHEN a.name IS NULL THEN 'U4' WHEN s.l IS NULL THEN 'U3' WHEN d IS NULL THEN 'U1' WHEN d > 150 THEN 'U2' WHEN d <= 90 AND dm <= 150 THEN 'high' ELSE 'mid' END AS status
      FROM a LEFT JOIN s ON a.l = s.l LEFT JOIN m ON a.l = m.l AND rn = 1)
SELECT l, CASE WHEN status IN ('high', 'mid') THEN r END AS r, CASE WHEN status IN ('U2', 'high', 'mid') THEN d END AS d, status FROM j""")
def match_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Customers matched to suppliers as links, if a part of the same name is near; middles lie 40 further west."""
    x, y = _xy("c_custkey")
    name, other = F.col("c_nationkey").cast("long"), F.col("s_nationkey").cast("long")
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("l"), F.when(name != 3, name).alias("name"), x.alias("ax"), y.alias("ay"))
    x, y = _xy("p_partkey")
    f = table(spark, sf, "part").select((F.col("p_partkey") % 25).alias("name"), x.alias("bx"), y.alias("by"))
    x, y = _xy("s_suppkey")
    b = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("r"), F.when(other == 7, -1).otherwise(other).alias("name"), x.alias("bx"), y.alias("by"), (x - 40).alias("mx"), y.alias("my")
    )
    return spatial.match_cascade(a, f, b, "l", "r", "name", 90.0, 150.0, 100.0)


@query(f"""
WITH {_C}, v AS (SELECT *, CAST(c_custkey % 5 AS DOUBLE) - 2 AS vx, CAST(c_custkey % 3 AS DOUBLE) - 1 AS vy FROM c),
m AS (SELECT a.c_custkey AS i, b.c_custkey AS j, sqrt((a.ax - b.ax) * (a.ax - b.ax) + (a.ay - b.ay) * (a.ay - b.ay)) AS d FROM v a JOIN v b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey
      WHERE a.vx * b.vx + a.vy * b.vy < 0)
SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM m WHERE d <= 120) WHERE rn = 1""")
def opposite_pair(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest partner of the same name that runs the other way."""
    k = F.col("c_custkey")
    v = _customers(spark, sf).withColumn("vx", (k % 5).cast("double") - 2).withColumn("vy", (k % 3).cast("double") - 1).drop("c_mktsegment")
    a = v.withColumnRenamed("c_custkey", "i")
    b = v.select(F.col("c_custkey").alias("j"), "c_nationkey", F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("vx").alias("wx"), F.col("vy").alias("wy"))
    pairs = spatial.within(a, b, 120.0, keys=["c_nationkey"]).filter((F.col("i") < F.col("j")) & (F.col("vx") * F.col("wx") + F.col("vy") * F.col("wy") < 0))
    best = F.min(F.struct("d", "j")).alias("b")
    return pairs.groupBy("i").agg(best).select("i", F.col("b.j").alias("j"), F.col("b.d").alias("d"))


_RINGS = {"triangle": [(100, 100), (700, 150), (300, 800)], "square": [(600, 600), (950, 600), (950, 950), (600, 950)]}


def _ring_sql(ring: list[tuple[int, int]]) -> str:
    terms = []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            terms.append(f"CAST((({y1} > ay) <> ({y2} > ay)) AND ax < CAST({x2 - x1} AS DOUBLE) * (ay - {y1}) / {y2 - y1} + {x1} AS INTEGER)")
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query(f"""
WITH {_C}, a AS (SELECT c_custkey, {", ".join(f"{_ring_sql(r)} AS {n}" for n, r in _RINGS.items())} FROM c)
SELECT c_custkey, z.zone FROM a LEFT JOIN (VALUES ('triangle'), ('square')) z(zone) ON (z.zone = 'triangle' AND triangle) OR (z.zone = 'square' AND square)""")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    rings = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("zone"), spatial.points(*r).alias("ring")) for n, r in _RINGS.items()))).alias("z")).select("z.*")
    return spatial.assign_to_polygons(_customers(spark, sf), rings, "ax", "ay", "ring", 250.0).select("c_custkey", "zone")


@query(f"WITH {_C} SELECT c_custkey FROM c WHERE sqrt((ax - 500) * (ax - 500) + (ay - 500) * (ay - 500)) <= 200 AND left(c_mktsegment, 2) IN ('BU', 'AU')")
def radius_window(spark: SparkSession, sf: str) -> DataFrame:
    c = _customers(spark, sf).filter((F.col("ax") >= 300) & (F.col("ax") <= 700))
    near = spatial.distance(F.col("ax"), F.col("ay"), F.lit(500.0), F.lit(500.0)) <= 200
    return c.filter(near & F.substring("c_mktsegment", 1, 2).isin("BU", "AU")).select("c_custkey")


@query(f"""
WITH {_S}, m AS (SELECT sqrt((a.bx - b.bx) * (a.bx - b.bx) + (a."by" - b."by") * (a."by" - b."by")) AS d FROM s a JOIN s b ON a.s_suppkey < b.s_suppkey)
SELECT min(d) AS least, CAST(count(*) AS BIGINT) AS n_pairs FROM m WHERE d <= 80""")
def closest_pair(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.closest_pair(_suppliers(spark, sf), "s_suppkey", "bx", "by", 80.0)


@query("""
WITH m AS (SELECT n_nationkey, CAST(count(s_suppkey) AS BIGINT) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY 1)
SELECT n_nationkey, n, n = 0 AS empty FROM m""")
def empty_categories(spark: SparkSession, sf: str) -> DataFrame:
    nation, supplier = tables(spark, sf, "nation", "supplier")
    n = supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return nation.select("n_nationkey").join(n, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0).cast("long")).alias("n")).withColumn("empty", F.col("n") == 0)


@query(f"""
WITH {_P}, l0 AS (SELECT ax, ay, floor(ax / 500) AS cx, floor(ay / 500) AS cy FROM p),
c0 AS (SELECT cx, cy, count(*) AS n FROM l0 GROUP BY ALL),
l1 AS (SELECT ax, ay, floor(ax / 250) AS cx, floor(ay / 250) AS cy FROM l0 JOIN c0 USING (cx, cy) WHERE n > 100),
c1 AS (SELECT cx, cy, count(*) AS n FROM l1 GROUP BY ALL),
l2 AS (SELECT floor(ax / 125) AS cx, floor(ay / 125) AS cy FROM l1 JOIN c1 USING (cx, cy) WHERE n > 100)
SELECT 0 AS level, CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, CAST(n AS BIGINT) AS n FROM c0 WHERE n <= 100
UNION ALL SELECT 1, CAST(cx AS BIGINT), CAST(cy AS BIGINT), CAST(n AS BIGINT) FROM c1 WHERE n <= 100
UNION ALL SELECT 2, CAST(cx AS BIGINT), CAST(cy AS BIGINT), CAST(count(*) AS BIGINT) FROM l2 GROUP BY ALL""")
def adaptive_cells(spark: SparkSession, sf: str) -> DataFrame:
    from wayfold.sources.tables import adaptive_cells as split

    return split(_points(table(spark, sf, "part"), "p_partkey", "a"), "ax", "ay", 500.0, 100, depth=2)
