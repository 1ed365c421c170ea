"""Queries: projections, rules on texts, parts of a key in one row, bans, candidates, shares and spans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import bands, coords, names, numbers, text
from wayfold.functions.numbers import fixed
from wayfold.operators import dedup, graph, masks, polyline, slots, sweep, timeseries
from wayfold.operators.spatial import spread
from wayfold.plans.base import fx, query
from wayfold.sources import tables
from wayfold.sources.tables import table
from wayfold.workspace import Workspace

_LON, _LAT = "(124.5 + (c_custkey * 7919 % 6000) / 1000e0)", "(33.5 + (c_custkey * 10473 % 5000) / 1000e0)"


def _belt_sql() -> tuple[str, str]:
    """East and north in the central belt: the series of the transverse Mercator projection."""
    radius, forward, _ = coords._series()
    e, grid = repr(coords._E), coords.BELT
    q = f"(atanh(sin(phi)) - {e} * atanh({e} * sin(phi)))"
    xi, eta = f"atan2(sinh({q}), cos(lam))", f"atanh(sin(lam) / cosh({q}))"
    north = " + ".join([xi, *(f"{a!r} * sin({2 * (j + 1)} * {xi}) * cosh({2 * (j + 1)} * {eta})" for j, a in enumerate(forward))])
    east = " + ".join([eta, *(f"{a!r} * cos({2 * (j + 1)} * {xi}) * sinh({2 * (j + 1)} * {eta})" for j, a in enumerate(forward))])
    start = grid["north"] - coords._meridian(math.radians(grid["lat0"]))
    return f"({east}) * {radius!r} + {grid['east']!r}", f"({north}) * {radius!r} + ({start!r})"


_DEGREE = math.pi * coords.SPHERE / 180


@query(f"""
WITH p AS (SELECT c_custkey, {_LON} AS lon, {_LAT} AS lat FROM customer), r AS (SELECT *, radians(lat) AS phi, radians(lon - 127) AS lam FROM p)
SELECT c_custkey, {fx(f"radians(lon) * {coords.SPHERE!r}", 2)} AS mx, {fx(f"ln(tan(radians(lat) / 2 + pi() / 4)) * {coords.SPHERE!r}", 2)} AS my,
       {fx(_belt_sql()[0], 2)} AS east, {fx(_belt_sql()[1], 2)} AS north, {fx('lon', 6)} AS lon, {fx('lat', 6)} AS lat,
       {fx(f"(lon - 127) * {_DEGREE * math.cos(math.radians(36.0))!r}", 2)} AS lx, {fx(f"(lat - 36) * {_DEGREE!r}", 2)} AS ly FROM r""")
def projections(spark: SparkSession, sf: str) -> DataFrame:
    """Web Mercator, belt and local metres of points, and the points that the belt's metres stand for."""
    p = table(spark, sf, "customer").select("c_custkey", F.expr(_LON).cast("double").alias("lon"), F.expr(_LAT).cast("double").alias("lat"))
    lon, lat = F.col("lon"), F.col("lat")
    (mx, my), (east, north), (lx, ly) = coords.to_mercator(lon, lat), coords.to_belt(lon, lat), coords.local_metres(lon, lat, 127.0, 36.0)
    p = p.select("c_custkey", mx.alias("mx"), my.alias("my"), east.alias("east"), north.alias("north"), lx.alias("lx"), ly.alias("ly"))
    back = coords.from_belt(F.col("east"), F.col("north"))
    metres = [fixed(F.col(c), 2).alias(c) for c in ("mx", "my", "east", "north", "lx", "ly")]
    return p.select("c_custkey", *metres, *(fixed(c, 6).alias(n) for c, n in zip(back, ("lon", "lat"))))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN CAST(p_size AS DOUBLE) END AS value, CASE WHEN p_partkey % 2 = 0 THEN '한밭로' || p_size || '번길' ELSE '대흥로' END AS road,
       CAST(p_size % 24 * 60 + p_size AS INTEGER) AS minute, p_size || '.5~' || (p_size + 1) || '|1,250' AS measured, CAST(p_size AS VARCHAR) AS cited,
       CAST(p_size AS VARCHAR) IN ('7', '12') AS held, CASE WHEN p_size >= 1 THEN p_size || ',' || '007' END AS thousands,
       floor((2 + length(CAST(p_size AS VARCHAR)) * 55e-2) * 100 + 5e-1) / 100 AS wide, CAST(CASE WHEN p_size < 10 THEN 2 ELSE 3 END AS INTEGER) AS n_lines, 'key ' || p_size || ' [other not set]' AS filled
FROM part""")
def text_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Sentinels, roads of addresses, minutes, measures, citations, numbers apart, widths, wraps and placeholders."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey")
    raw = F.element_at(F.array(F.lit(""), F.lit(" - "), F.lit("null"), F.concat(F.lit(" "), s, F.lit(" ")), F.concat(s, F.lit("m"))), (k % 5 + 1).cast("int"))
    address = F.when(k % 2 == 0, F.concat(F.lit("한밭로 "), s, F.lit("번길 3"))).otherwise("대흥로 12")
    hhmm = F.concat(F.lpad((F.col("p_size") % 24).cast("string"), 2, "0"), F.lpad(s, 2, "0"))
    claim = F.concat(F.lit("폭 "), s, F.lit(".5~"), (F.col("p_size") + 1).cast("string"), F.lit(" m, 1,250명 ["), s, F.lit("]"))
    return table(spark, sf, "part").select(
        "p_partkey",
        numbers.number_or_sentinel(raw).alias("value"),
        names.road_of_address(address).alias("road"),
        timeseries.minute_of_day(hhmm).alias("minute"),
        F.array_join(text.numbers_with_unit(claim, ["m", "명"]), "|").alias("measured"),
        F.array_join(text.citations(claim), "|").alias("cited"),
        text.holds_number(F.lit("7 m, 12 m, 345 m, 0.25 m"), s).alias("held"),
        text.thousands(F.col("p_size") * 1000 + 7).alias("thousands"),
        fixed(text.display_width(F.concat(F.lit("한밭"), s)), 2).alias("wide"),
        text.wrapped_lines(F.concat(F.lit("abcd "), s, F.lit(" efghij")), 6).alias("n_lines"),
        text.filled_in(text.filled_in(F.concat(F.lit("key "), s, F.lit(" {other}")), "p_size", "x"), "other", None).alias("filled"),
    )


@query("""SELECT l_orderkey, string_agg(l_partkey || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_partkey || ':' || CAST(l_quantity AS BIGINT)) AS parts FROM lineitem GROUP BY l_orderkey""")
def multiparts(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order as parts of one row, in order."""
    part = F.concat_ws(":", F.col("l_partkey"), F.col("l_quantity").cast("long"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", part.alias("part"))
    return dedup.multipart_collapse(rows, ["l_orderkey"], "part", "l_linenumber").select("l_orderkey", F.array_join("part", ",").alias("parts"))


@query(f"""
WITH v AS (SELECT p_brand, var_pop(CASE WHEN p_size % 2 = 1 THEN p_size * (p_partkey % 7) END) AS h, var_pop(CASE WHEN p_size % 2 = 0 THEN p_size * (p_partkey % 7) END) AS l FROM part GROUP BY 1)
SELECT p_brand, {fx('h / CASE WHEN l > 0 THEN l END')} AS gain FROM v""")
def sharpness_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 2).alias("level"), (F.col("p_size") * (F.col("p_partkey") % 7)).alias("v"))
    return masks.sharpness_gain(rows, ["p_brand"], "level", "v", 0, 1).select("p_brand", fixed(F.col("gain")).alias("gain"))


@query("""
WITH m AS (SELECT l_orderkey AS a, l_partkey AS b, l_linenumber, (l_suppkey * 37 + l_linenumber * 11) % 181 AS theta FROM lineitem)
SELECT a AS st_link, b AS ed_link FROM m WHERE theta >= 90 AND NOT EXISTS (SELECT 1 FROM m r WHERE r.l_linenumber = 1 AND r.a = m.a AND r.b = m.b)""")
def released_bans(spark: SparkSession, sf: str) -> DataFrame:
    """Banned pairs of an order and its part by their angle, without those on a route: an order's first part."""
    line = table(spark, sf, "lineitem")
    theta = (F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11) % 181
    moves = line.select(F.col("l_orderkey").alias("a_link_id"), F.col("l_partkey").alias("b_link_id"), theta.alias("theta"))
    route = line.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("via"), F.col("l_partkey").alias("link_id"))
    return graph.release(graph.turn_bans(moves), route)


@query("""
SELECT p_partkey AS link_id, p_size % 4 AS lanes, CAST(p_partkey % 3 AS INTEGER) AS hop, CASE WHEN p_partkey % 4 <> 0 THEN p_size * 25e-1 END AS d FROM part WHERE p_size % 4 >= 2 AND p_size > 10""")
def staging_places(spark: SparkSession, sf: str) -> DataFrame:
    """Links with two lanes or more in reach, with the distance to water where it is known."""
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "link_id")
    links = part.select("link_id", (F.col("p_size") % 4).alias("lanes"))
    reach = part.filter("p_size > 10").select("link_id", (F.col("link_id") % 3).cast("int").alias("hop"))
    water = part.filter("link_id % 4 <> 0").select("link_id", (F.col("p_size") * 2.5).alias("d"))
    return slots.staging_candidates(links, reach, water).select("link_id", "lanes", "hop", "d")


@query(f"""
SELECT p_partkey, {fx("CAST((SELECT count(*) FROM range(21) r(i) WHERE i / 20e0 * (p_size + 10) > 4751e-3 AND i / 20e0 * (p_size + 10) < 20311e-3) AS DOUBLE) / 21")} AS share FROM part""")
def covered_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of 21 places along a line that lie in a ring."""

    def p(x: Column | float, y: float) -> Column:
        return F.struct((x if isinstance(x, Column) else F.lit(x)).cast("double").alias("x"), F.lit(y).alias("y"))

    ring = F.array(p(4.751, -1.0), p(20.311, -1.0), p(20.311, 1.0), p(4.751, 1.0))
    rows = table(spark, sf, "part").select("p_partkey", F.array(p(0.0, 0.0), p(F.col("p_size") + 10, 0.0)).alias("line"), ring.alias("ring"))
    rows = spread(rows, "p_partkey")  # a small file is one task
    return rows.select("p_partkey", fixed(polyline.coverage(rows, "line", "ring")).alias("share"))


@query(f"""
WITH p AS (SELECT c_nationkey AS k, (-4e0 * (c_custkey * 7919 % 1000) + 3e0 * (c_custkey * 10473 % 1000)) / 5 AS across FROM customer)
SELECT k, {fx('max(across) - min(across)', 2)} AS span FROM p GROUP BY k""")
def lateral_spans(spark: SparkSession, sf: str) -> DataFrame:
    """How far a nation's points spread across a direction; the extremes of a task's points stand for them before they meet."""
    k = F.col("c_custkey")
    at = F.struct((k * 7919 % 1000).cast("double").alias("x"), (k * 10473 % 1000).cast("double").alias("y"))
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), at.alias("p"))
    side = -4 * F.col("p.x") + 3 * F.col("p.y")
    ends = rows.groupBy("k").agg(F.array(F.min_by("p", side), F.max_by("p", side)).alias("ends"))
    return ends.select("k", fixed(polyline.lateral_span(F.col("ends"), F.lit(3.0), F.lit(4.0)), 2).alias("span"))


@query("SELECT o_orderkey AS link_id, o_custkey % 1000 AS cost FROM orders ORDER BY o_custkey % 1000 DESC, o_orderkey LIMIT 1")
def farthest_link(spark: SparkSession, sf: str) -> DataFrame:
    """The row with the largest cost, the smallest id on ties (one row is the feature)."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("link_id"), (F.col("o_custkey") % 1000).alias("cost"))
    return graph.farthest(rows, "cost", "link_id")


@query(f"""
SELECT l_returnflag, CASE WHEN abs(r - 3) <= abs(r) * (5e-1 / q + 5e-1 / s) THEN true ELSE false END AS at_limit, CAST(count(*) AS BIGINT) AS n
FROM (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS q, CAST(1 + l_suppkey % 15 AS DOUBLE) AS s, CAST(l_quantity AS DOUBLE) / (1 + l_suppkey % 15) AS r FROM lineitem) GROUP BY ALL""")
def ratios_at_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Ratios of rounded numbers that may be on either side of 3."""
    a, b = F.col("l_quantity").cast("double"), (1 + F.col("l_suppkey") % 15).cast("double")
    near = F.abs(a / b - 3) <= sweep.ratio_tolerance(a, b, 0.5)
    return table(spark, sf, "lineitem").select("l_returnflag", near.alias("at_limit")).groupBy("l_returnflag", "at_limit").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT p_brand, CASE WHEN p_size % 9 = 0 THEN 'not comparable' WHEN p_size >= p_partkey % 40 - 1 AND p_size <= p_partkey % 40 + 11 THEN 'consistent' ELSE 'different' END AS verdict, CAST(count(*) AS BIGINT) AS n
FROM part GROUP BY ALL""")
def range_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a value agrees with a range within one, by brand."""
    low = F.col("p_partkey") % 40
    verdict = bands.agreement(F.when(F.col("p_size") % 9 != 0, F.col("p_size")), low, low + 10)
    return table(spark, sf, "part").select("p_brand", verdict.alias("verdict")).groupBy("p_brand", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'c' || n_regionkey AS cell, CAST(count(*) AS INTEGER) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys, sum(CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey * 5e-1 END) AS width FROM nation GROUP BY n_regionkey""")
def cells_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of rows as gzipped JSON lines, written by tasks and flattened again; a field that a row lacks is null."""
    work = Workspace(spark, "cells")
    k = F.col("n_nationkey")
    row = F.struct(k.cast("string").alias("rn"), F.when(k % 3 != 0, k * 0.5).alias("road_bt"), F.col("n_name").alias("sig_cd"), k.cast("long").alias("rds_man_no"))
    packed = table(spark, sf, "nation").groupBy(F.concat(F.lit("c"), "n_regionkey").alias("cell")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.collect_list(row).alias("rows"))
    packed.write.option("compression", "gzip").json(work.folder("j"))
    rows = tables.read_cells(spark, work.folder("j"))
    return rows.groupBy("cell").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("rds_man_no").alias("keys"), F.sum("road_bt").alias("width"))
