"""Queries: lines and points joined to lines by distance, samples inside polygons.

The driver's tables have no lines; each row gets one of two segments from its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.numbers import fixed
from wayfold.operators import line_joins, spatial
from wayfold.plans.base import fx, query
from wayfold.plans.places import _RINGS, _ring_sql
from wayfold.sources.tables import table


def _corners(key: str) -> list[tuple[str, str]]:
    x, y = f"CAST(({key} * 7919) % 1000 AS DOUBLE)", f"CAST(({key} * 10473) % 1000 AS DOUBLE)"
    return [(x, y), (f"{x} + {key} % 7 * 9 - 27", f"{y} + {key} % 5 * 9 - 18"), (f"{x} + {key} % 11 * 9 - 45", f"{y} + {key} % 13 * 9 - 54")]


def _line(key: str) -> Column:
    return F.array(*(F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y")) for x, y in _corners(key)))


def _segments_sql(key: str, of: str, more: str, s: str) -> str:
    """A row for each segment, from {s}ax, {s}ay to {s}bx, {s}by."""
    c = _corners(key)
    return " UNION ALL ".join(
        f"SELECT {key}, {more}, {i} AS {s}n, {p[0]} AS {s}ax, {p[1]} AS {s}ay, {q[0]} AS {s}bx, {q[1]} AS {s}by FROM {of}" for i, (p, q) in enumerate(zip(c, c[1:]))
    )


def _point_sql(x: str, y: str, s: str) -> str:
    """Distance of a point to the segment."""
    dx, dy = f"({s}bx - {s}ax)", f"({s}by - {s}ay)"
    square = f"({dx} * {dx} + {dy} * {dy})"
    t = f"CASE WHEN {square} > 0 THEN greatest(0e0, least(1e0, (({x} - {s}ax) * {dx} + ({y} - {s}ay) * {dy}) / {square})) ELSE 0e0 END"
    px, py = f"({x} - ({s}ax + ({t}) * {dx}))", f"({y} - ({s}ay + ({t}) * {dy}))"
    return f"sqrt({px} * {px} + {py} * {py})"


def _turn_sql(p: str, q: str, r: str) -> str:
    return f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"


def _pair_sql(s: str, t: str) -> str:
    """Distance of two segments."""
    sa, sb, ta, tb = f"{s}a", f"{s}b", f"{t}a", f"{t}b"
    cross = f"{_turn_sql(sa, sb, ta)} * {_turn_sql(sa, sb, tb)} < 0 AND {_turn_sql(ta, tb, sa)} * {_turn_sql(ta, tb, sb)} < 0"
    ends = ", ".join(_point_sql(f"{e}x", f"{e}y", o) for e, o in ((sa, t), (sb, t), (ta, s), (tb, s)))
    return f"CASE WHEN {cross} THEN 0e0 ELSE least({ends}) END"


_PARTS = "p AS (" + _segments_sql("p_partkey", "part", "p_brand", "p") + ")"
_SUPPLIERS = "s AS (" + _segments_sql("s_suppkey", "supplier", "s_acctbal", "s") + ")"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_brand", _line("p_partkey").alias("line"))


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", _line("s_suppkey").alias("other"))


@query(f"""
WITH {_SUPPLIERS}, c AS (SELECT c_custkey, CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS ax, CAST((c_custkey * 10473) % 1000 AS DOUBLE) AS ay FROM customer),
d AS (SELECT c_custkey, s_suppkey, min({_point_sql('ax', 'ay', 's')}) AS d FROM c, s GROUP BY ALL)
SELECT c_custkey, s_suppkey, {fx('d')} AS d FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS rn FROM d) WHERE rn = 1""")
def nearest_line_of_point(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest supplier's line of each customer's point."""
    x, y = _corners("c_custkey")[0]
    c = table(spark, sf, "customer").select("c_custkey", F.array(F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))).alias("line"))
    best = line_joins.nearest_lines(c, _suppliers(spark, sf), "c_custkey", "s_suppkey", 100.0)
    return best.select("c_custkey", "s_suppkey", fixed(F.col("d")).alias("d"))


@query(f"""
WITH {_PARTS}, {_SUPPLIERS}, d AS (SELECT p_partkey, s_suppkey, min({_pair_sql('p', 's')}) AS d FROM p, s GROUP BY ALL)
SELECT p_partkey, s_suppkey, {fx('d')} AS d FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, s_suppkey) AS rn FROM d) WHERE rn = 1""")
def nearest_line_of_line(spark: SparkSession, sf: str) -> DataFrame:
    best = line_joins.nearest_lines(_parts(spark, sf), _suppliers(spark, sf), "p_partkey", "s_suppkey", 100.0)
    return best.select("p_partkey", "s_suppkey", fixed(F.col("d")).alias("d"))


@query(f"""
WITH {_PARTS}, {_SUPPLIERS}, h AS (SELECT p_partkey, bool_or(s_acctbal < 0) AS near_debt, bool_or(s_acctbal >= 0) AS near_credit FROM p, s WHERE {_pair_sql('p', 's')} <= 30 GROUP BY 1)
SELECT part.p_partkey, coalesce(near_debt, false) AS near_debt, coalesce(near_credit, false) AS near_credit FROM part LEFT JOIN h ON part.p_partkey = h.p_partkey""")
def line_buffer_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a part's line meets the buffer of a supplier's line, by kind."""
    flags = {"near_debt": F.col("s_acctbal") < 0, "near_credit": F.col("s_acctbal") >= 0}
    got = line_joins.line_flags(_parts(spark, sf), _suppliers(spark, sf), "p_partkey", "s_suppkey", 30.0, flags)
    return got.select("p_partkey", *flags)


_AT = ", ".join(f"({f}e0)" for f in line_joins.FRACTIONS)
_RUN = "(CAST(c_custkey % 11 * 9 - 45 AS DOUBLE)) AS vx, (CAST(c_custkey % 13 * 9 - 54 AS DOUBLE)) AS vy"
_LENGTH = "sqrt((pbx - pax) * (pbx - pax) + (pby - pay) * (pby - pay))"


@query(f"""
WITH p AS ({_segments_sql('c_custkey', 'customer', 'c_nationkey, ' + _RUN, 'p')}), s AS (SELECT c_custkey AS other, c_nationkey, vx AS wx, vy AS wy, pax AS sax, pay AS say, pbx AS sbx, pby AS sby FROM p),
near AS (SELECT DISTINCT c_custkey, other FROM p JOIN s ON p.c_nationkey = s.c_nationkey AND c_custkey <> other AND vx * wx + vy * wy < 0 WHERE {_pair_sql('p', 's')} <= 60),
n AS (SELECT *, {_LENGTH} AS n FROM p), l AS (SELECT c_custkey, max(n) FILTER (WHERE pn = 0) AS first, sum(n) AS whole FROM n GROUP BY 1),
f AS (SELECT n.c_custkey, t, greatest(0e0, least(1e0, (t * whole - CASE WHEN pn = 1 THEN first ELSE 0e0 END) / CASE WHEN n > 0 THEN n END)) AS share, pax, pay, pbx, pby
      FROM n JOIN l ON n.c_custkey = l.c_custkey, (VALUES {_AT}) v(t) WHERE (pn = 1) = (t * whole > first)),
pt AS (SELECT c_custkey, t, pax + coalesce(share, 0e0) * (pbx - pax) AS x, pay + coalesce(share, 0e0) * (pby - pay) AS y FROM f),
d AS (SELECT pt.c_custkey, near.other, t, min({_point_sql('x', 'y', 's')}) AS d FROM near JOIN pt ON near.c_custkey = pt.c_custkey JOIN s ON s.other = near.other GROUP BY ALL),
m AS (SELECT c_custkey, other, {fx('median(d)')} AS d FROM d GROUP BY ALL)
SELECT c_custkey, min(d) AS d FROM m GROUP BY 1""")
def opposite_lines(spark: SparkSession, sf: str) -> DataFrame:
    """How far the nearest line of the same name is that runs the other way: median of five places."""
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey", _line("c_custkey").alias("line"))
    got = line_joins.opposite_lines(df, "c_custkey", "line", "c_nationkey", 60.0)
    return got.select("c_custkey", fixed(F.col("d")).alias("d"))


def _sample_sql(name: str, ring: list[tuple[int, int]]) -> str:
    x0, y0 = min(x for x, _ in ring), min(y for _, y in ring)
    wide, high = max(x for x, _ in ring) - x0, max(y for _, y in ring) - y0
    return f"""SELECT '{name}' AS ring, i, ax, ay FROM (SELECT i, {x0} + ((i + 1) * 7919 + 19 * 104729) % 10007 / 10007e0 * {wide} AS ax,
      {y0} + ((i + 1) * (i + 1) * 31 + (i + 1) * 611953 + 126) % 10009 / 10009e0 * {high} AS ay FROM range(400) r(i)) WHERE {_ring_sql(ring)} ORDER BY i LIMIT 40"""


@query("SELECT ring, CAST(i AS INTEGER) AS i, " + fx("ax") + " AS x, " + fx("ay") + ' AS y FROM (' + " UNION ALL ".join(f"SELECT * FROM ({_sample_sql(n, r)})" for n, r in _RINGS.items()) + ")")
def polygon_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Forty points inside each polygon, from up to 400 tries (the feature's own limit)."""
    rings = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("ring"), spatial.points(*r).alias("at")) for n, r in _RINGS.items()))).alias("p"))
    got = rings.select("p.ring", F.explode(spatial.sample_in_ring(F.col("p.at"), F.lit(18))).alias("s"))
    return got.select("ring", "s.i", fixed(F.col("s.x")).alias("x"), fixed(F.col("s.y")).alias("y"))
