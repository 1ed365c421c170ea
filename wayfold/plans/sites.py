"""Queries: coverage, fallbacks, cells and classes, outlines, tiles, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import coords
from wayfold.functions.numbers import count_of, fixed, rate
from wayfold.operators import masks, polyline, setrates, slots, spatial
from wayfold.plans.base import fx, n_if, query, ratio
from wayfold.sources.tables import pending, table, tables
from wayfold.workspace import Workspace


@query(f"""
WITH p AS (SELECT layer, c_nationkey, CASE WHEN (c_custkey + layer) % 5 = 0 THEN NULL WHEN (c_custkey * layer) % 3 = 0 THEN 0 ELSE 1 END AS found FROM customer, range(1, 4) l(layer))
SELECT CAST(layer AS INTEGER) AS layer, {n_if("found = 1")} AS n_found, {n_if("found = 0")} AS n_zero, {n_if("found IS NULL")} AS n_failed, {ratio("count(*) FILTER (WHERE found = 1)", "count(found)")} AS coverage
FROM p GROUP BY layer""")
def coverage_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Layers by sites: found, asked and none, and failed, which is in no denominator."""
    layer, key = F.col("layer"), F.col("c_custkey")
    probed = table(spark, sf, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("layer"))
    found = F.when((key + layer) % 5 == 0, None).when((key * layer) % 3 == 0, 0).otherwise(1)
    return probed.withColumn("found", found).groupBy("layer").agg(
        count_of(F.col("found") == 1).alias("n_found"),
        count_of(F.col("found") == 0).alias("n_zero"),
        count_of(F.col("found").isNull()).alias("n_failed"),
        rate(count_of(F.col("found") == 1), F.count("found")).alias("coverage"),
    )


@query("""
WITH e AS (SELECT o_custkey, s.s_suppkey AS exact FROM orders LEFT JOIN supplier s ON s.s_suppkey = o_custkey)
SELECT o_custkey, coalesce(exact, a.s_suppkey) AS matched, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN a.s_suppkey IS NOT NULL THEN 'alias' ELSE 'none' END AS how, CAST(count(*) AS BIGINT) AS n
FROM e LEFT JOIN supplier a ON exact IS NULL AND a.s_suppkey = o_custkey % 200 GROUP BY ALL""")
def fallback_key_join(spark: SparkSession, sf: str) -> DataFrame:
    """By id, else by a short id; and which of them matched."""
    orders, supplier = tables(spark, sf, "orders", "supplier")
    o = orders.select("o_custkey", (F.col("o_custkey") % 200).alias("short"))
    exact = supplier.select(F.col("s_suppkey").alias("o_custkey"), F.col("s_suppkey").alias("exact"))
    alias = supplier.select(F.col("s_suppkey").alias("short"), F.col("s_suppkey").alias("alias"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").otherwise("none")
    joined = o.join(exact, "o_custkey", "left").join(alias, "short", "left")
    return joined.groupBy("o_custkey", F.coalesce("exact", "alias").alias("matched"), how.alias("how")).agg(F.count(F.lit(1)).alias("n"))


_NEAR = """a AS (SELECT c_custkey AS l, c_nationkey AS name, CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 10473) % 1000 AS DOUBLE) AS y FROM customer)"""


def _places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("l"), F.col("c_nationkey").alias("name"), ((k * 7919) % 1000).cast("double").alias("ax"), ((k * 10473) % 1000).cast("double").alias("ay")
    )


@query(f"""
WITH {_NEAR}, p AS (SELECT a.l, b.l AS r FROM a JOIN a b ON a.name = b.name AND a.l <> b.l AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 100)
SELECT a.l, CAST(count(r) AS BIGINT) AS n, coalesce(string_agg(CAST(r AS VARCHAR), ',' ORDER BY r), '') AS near FROM a LEFT JOIN p ON a.l = p.l GROUP BY a.l""")
def same_name_near(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the same name within 100 metres, and which."""
    a = _places(spark, sf)
    b = a.select(F.col("l").alias("r"), "name", F.col("ax").alias("bx"), F.col("ay").alias("by"))
    # rows of one place and name have one list, each without itself
    at = ["name", "ax", "ay"]
    hits = spatial.within(a.select(at).distinct(), b, 100.0, keys=["name"]).groupBy(at).agg(F.array_sort(F.collect_list("r")).alias("r"))
    own = spatial.spread(a, *at).join(spatial.spread(hits, *at).hint("merge"), at, "left").select("l", F.array_remove("r", F.col("l")).alias("r"))
    return own.select("l", F.coalesce(F.size("r").cast("long"), F.lit(0).cast("long")).alias("n"), F.coalesce(F.array_join("r", ","), F.lit("")).alias("near"))


@query("""
WITH p AS (SELECT p_brand, p_partkey, p_size % 3 <> 0 AS before, p_size % 3 <> 0 OR p_size % 4 = 1 AS after FROM part),
s AS (SELECT p_brand, bool_or(before) AS b, bool_or(after) AS a, count(*) FILTER (WHERE before) AS nb, count(*) FILTER (WHERE after) AS na FROM p GROUP BY 1)
SELECT CAST(sum(nb) AS BIGINT) AS pieces_before, CAST(sum(na) AS BIGINT) AS pieces_after, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS sites_before, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS sites_after FROM s""")
def coverage_before_after(spark: SparkSession, sf: str) -> DataFrame:
    """How many pieces and sites can be judged before and after a further source."""
    before = F.col("p_size") % 3 != 0
    after = before | (F.col("p_size") % 4 == 1)
    per = table(spark, sf, "part").groupBy("p_brand").agg(count_of(before).alias("nb"), count_of(after).alias("na"))
    return per.agg(
        F.sum("nb").alias("pieces_before"),
        F.sum("na").alias("pieces_after"),
        count_of(F.col("nb") > 0).alias("sites_before"),
        count_of(F.col("na") > 0).alias("sites_after"),
    )


@query(f"""
WITH c AS (SELECT DISTINCT l_suppkey % 20 AS k, l_partkey % 30 AS col, l_orderkey % 40 AS pos FROM lineitem WHERE l_quantity >= 25),
g AS (SELECT k, col, pos - row_number() OVER (PARTITION BY k, col ORDER BY pos) AS g FROM c),
r AS (SELECT k, col, max(n) AS run FROM (SELECT k, col, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL)
SELECT k, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 15 AND sqrt(avg(CAST(run AS DOUBLE) * run) - avg(run) * avg(run)) / avg(run) <= 0.7 THEN {fx("avg(run)", 3)} END AS width FROM r GROUP BY k""")
def run_length_width(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "lineitem").filter("l_quantity >= 25").select(
        (F.col("l_suppkey") % 20).alias("k"), (F.col("l_partkey") % 30).alias("col"), (F.col("l_orderkey") % 40).alias("pos")
    )
    r = masks.run_width(cells, ["k"], "col", "pos", 30, cover=0.5, spread=0.7)
    return r.select("k", "n", fixed(F.col("width"), 3).alias("width"))


_CLASSES = [("large", 2.5), ("small", 2.2), ("passenger", 1.9)]


@query(f"""
WITH w AS (SELECT CASE WHEN p_size % 9 <> 0 THEN CAST(p_size AS DOUBLE) / 10 END AS w FROM part), c(class, width) AS (VALUES {", ".join(f"('{n}', CAST({x} AS DOUBLE))" for n, x in _CLASSES)})
SELECT class, {n_if("w >= width")} AS n_reachable, {n_if("w < width")} AS n_blocked, {n_if("w IS NULL")} AS n_unknown FROM w, c GROUP BY class""")
def constraint_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Segments that a class of vehicles reaches; a missing width is neither reachable nor blocked."""
    size, w = F.col("p_size"), F.col("w")
    parts = table(spark, sf, "part").select(F.when(size % 9 != 0, size.cast("double") / 10).alias("w"))
    classes = F.array(*(F.struct(F.lit(n).alias("class"), F.lit(x).alias("width")) for n, x in _CLASSES))
    rows = parts.select("w", F.explode(classes).alias("c")).select("w", "c.*")
    return rows.groupBy("class").agg(
        count_of(w >= F.col("width")).alias("n_reachable"), count_of(w < F.col("width")).alias("n_blocked"), count_of(w.isNull()).alias("n_unknown")
    )


@query("""
WITH c AS (SELECT o_orderkey % 50 AS link_id, o_orderkey % 6 AS slot, CAST(count(*) AS BIGINT) AS demand, CAST(count(*) FILTER (WHERE o_custkey % 9 = 0) AS BIGINT) AS evac, 20 + (o_orderkey % 50) % 7 AS lanes FROM orders GROUP BY ALL)
SELECT link_id, slot, demand > lanes AS before, demand - evac > CASE WHEN evac > 0 THEN 0 ELSE lanes END AS after, CASE WHEN evac > 0 THEN 0 ELSE lanes END AS capacity FROM c""")
def cell_states(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    cells = orders.groupBy((F.col("o_orderkey") % 50).alias("link_id"), (F.col("o_orderkey") % 6).alias("slot")).agg(
        F.count(F.lit(1)).alias("demand"), count_of(F.col("o_custkey") % 9 == 0).alias("evac")
    )
    cells = cells.withColumn("lanes", 20 + F.col("link_id") % 7)
    before, after = slots.cell_state(F.col("demand"), F.col("evac"), F.col("lanes"))
    closed = cells.filter("evac > 0").select("link_id", "slot")
    return slots.capacity(cells, closed).select("link_id", "slot", before.alias("before"), after.alias("after"), F.col("capacity").cast("long").alias("capacity"))


@query("""
WITH c AS (SELECT l_partkey % 60 AS link_id, CAST(count(*) AS BIGINT) AS demand, 8 + (l_partkey % 60) % 30 AS lanes FROM lineitem WHERE l_quantity > 49 GROUP BY ALL),
o AS (SELECT link_id, demand, true AS overload FROM c WHERE demand > lanes ORDER BY demand DESC, link_id LIMIT 4),
t AS (SELECT link_id, demand, false AS overload FROM c WHERE NOT EXISTS (SELECT 1 FROM c WHERE demand > lanes) ORDER BY demand DESC, link_id LIMIT 4)
SELECT * FROM o UNION ALL SELECT * FROM t""")
def top_overloaded(spark: SparkSession, sf: str) -> DataFrame:
    """The four worst links; if none is overloaded, the four busiest."""
    cells = table(spark, sf, "lineitem").filter("l_quantity > 49").groupBy((F.col("l_partkey") % 60).alias("link_id")).agg(F.count(F.lit(1)).alias("demand"))
    cells = cells.withColumn("overload", F.col("demand") > 8 + F.col("link_id") % 30)
    worst = cells.filter("overload").orderBy(F.desc("demand"), "link_id").limit(4)
    busy = cells.orderBy(F.desc("demand"), "link_id").limit(4).join(worst.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
    return worst.unionByName(busy)


@query(f"""
WITH t AS (SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE p_size <= 10) AS BIGINT) AS k FROM part GROUP BY 1), b AS (SELECT *, n - k AS m FROM t)
SELECT p_brand, {fx("CAST(m AS DOUBLE) / n")} AS rate, {fx("1 - " + "(" + "(CAST(k AS DOUBLE) / n + 1.959964e0 * 1.959964e0 / (2 * n)) / (1 + 1.959964e0 * 1.959964e0 / n) + 1.959964e0 * sqrt((CAST(k AS DOUBLE) / n) * (1 - CAST(k AS DOUBLE) / n) / n + 1.959964e0 * 1.959964e0 / (4 * CAST(n AS DOUBLE) * n)) / (1 + 1.959964e0 * 1.959964e0 / n)" + ")")} AS low,
       {fx("1 - " + "(" + "(CAST(k AS DOUBLE) / n + 1.959964e0 * 1.959964e0 / (2 * n)) / (1 + 1.959964e0 * 1.959964e0 / n) - 1.959964e0 * sqrt((CAST(k AS DOUBLE) / n) * (1 - CAST(k AS DOUBLE) / n) / n + 1.959964e0 * 1.959964e0 / (4 * CAST(n AS DOUBLE) * n)) / (1 + 1.959964e0 * 1.959964e0 / n)" + ")")} AS high FROM b""")
def complement_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The rate that is left, with its interval turned round."""
    t = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), count_of(F.col("p_size") <= 10).alias("k"))
    low, high = setrates.complement(*setrates.wilson(F.col("k"), F.col("n")))
    return t.select("p_brand", fixed((F.col("n") - F.col("k")).cast("double") / F.col("n")).alias("rate"), fixed(low).alias("low"), fixed(high).alias("high"))


@query(f"""
WITH {_NEAR}, r AS (SELECT name, l, CASE WHEN l % 4 <> 0 THEN 'OPEN' ELSE 'BLOCKED' END AS band, sqrt((x - 500) * (x - 500) + (y - 500) * (y - 500)) AS d FROM a),
b AS (SELECT name, arg_min(l, (d, l)) FILTER (WHERE band <> 'BLOCKED') AS open_l, arg_min(l, (d, l)) AS any_l FROM r GROUP BY name)
SELECT name, coalesce(open_l, any_l) AS l, CASE WHEN open_l IS NOT NULL THEN 'nearest open' ELSE 'none open' END AS status FROM b""")
def deployment_point(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest piece that is not blocked; else the nearest one, and the status says so."""
    d = spatial.distance(F.col("ax"), F.col("ay"), F.lit(500.0), F.lit(500.0))
    rows = _places(spark, sf).withColumn("o", F.struct(d.alias("d"), "l"))
    b = rows.groupBy("name").agg(F.min(F.when(F.col("l") % 4 != 0, F.col("o"))).alias("open"), F.min("o").alias("any"))
    return b.select("name", F.coalesce("open.l", "any.l").alias("l"), F.when(F.col("open").isNotNull(), "nearest open").otherwise("none open").alias("status"))


@query("""
WITH c AS (SELECT p_partkey AS cell, p_size % 2 = 0 AS evac, p_size % 3 = 0 AS full_, p_size % 5 = 0 AS slow FROM part)
SELECT CASE WHEN evac THEN 'evacuated' WHEN full_ THEN 'no lane free' WHEN slow THEN 'observed capacity' ELSE 'none' END AS cause, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY 1""")
def failure_causes(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    cause = F.when(size % 2 == 0, "evacuated").when(size % 3 == 0, "no lane free").when(size % 5 == 0, "observed capacity").otherwise("none")
    return table(spark, sf, "part").groupBy(cause.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT p_partkey, p_size / CAST(10 AS DOUBLE) AS r FROM part)
SELECT p_partkey, CAST(least(5, greatest(1, round_even(CAST(2 * r AS DECIMAL(18, 6)), 0))) AS INTEGER) AS slots FROM p""")
def evacuation_length(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", slots.evacuation_slots(F.col("p_size") / F.lit(10.0)).alias("slots"))


@query("""
WITH c AS (SELECT link, slot, (link * 7 + slot * 3) % 40 > 0 AS free FROM range(30) l(link), range(6) s(slot)),
r AS (SELECT DISTINCT o_custkey AS actor, o_orderkey % 30 AS link FROM orders),
t AS (SELECT actor, start, bool_and(free) AS ok FROM r, range(5) x(start) JOIN c ON c.link = r.link AND c.slot BETWEEN start AND start + 1 GROUP BY actor, start)
SELECT actor, CAST(min(start) FILTER (WHERE ok) AS INTEGER) AS slot FROM t GROUP BY actor""")
def first_free_slot(spark: SparkSession, sf: str) -> DataFrame:
    """The first slot in which every link of an actor's route is free for two slots."""
    cells = spark.range(30).select(F.col("id").alias("link_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("slot"))
    cells = cells.withColumn("free", ((F.col("link_id") * 7 + F.col("slot") * 3) % 40 > 0).cast("int"))
    ways = table(spark, sf, "orders").select(F.col("o_custkey").alias("actor"), (F.col("o_orderkey") % 30).alias("link_id")).distinct()
    return slots.first_free(cells, ways, 2, 5)


@query("""
WITH s AS (SELECT x, y FROM range(6) a(x), range(5) b(y) WHERE (x * 5 + y * 3) % 7 <> 0),
e AS (SELECT least(x, x2) AS x1, least(y, y2) AS y1, greatest(x, x2) AS x2, greatest(y, y2) AS y2 FROM (
  SELECT x, y, x + 1 AS x2, y AS y2 FROM s UNION ALL SELECT x + 1, y, x + 1, y + 1 FROM s UNION ALL SELECT x + 1, y + 1, x, y + 1 FROM s UNION ALL SELECT x, y + 1, x, y FROM s))
SELECT CAST(count(*) AS BIGINT) AS n_edges, CAST(sum(x1 + 10 * y1) AS BIGINT) AS checksum FROM (SELECT x1, y1 FROM e GROUP BY x1, y1, x2, y2 HAVING count(*) = 1)""")
def union_boundary(spark: SparkSession, sf: str) -> DataFrame:
    """The outline of a union of squares: edges that no two share."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")

    def p(a, b):
        return F.struct(a.alias("x"), b.alias("y"))

    squares = spark.range(6).select(F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("y")).filter("(x * 5 + y * 3) % 7 <> 0")
    rings = squares.select(F.lit(1).alias("k"), F.array(p(x, y), p(x + 1, y), p(x + 1, y + 1), p(x, y + 1)).alias("ring"))
    edges = masks.union_boundary(rings, "k", "ring")
    return edges.agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("a.x") + 10 * F.col("a.y")).cast("long").alias("checksum"))


@query(f"""
SELECT p_partkey, CASE WHEN p_size < 45 THEN {fx("(least(CAST(40 AS DOUBLE), CAST(50 AS DOUBLE)) - greatest(CAST(p_size AS DOUBLE) - 5, CAST(0 AS DOUBLE))) / 50")} END AS share FROM part""")
def clipped_share(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a line of 50 metres lies in a rectangle that begins at the part's size less five and ends at 40."""
    s = F.col("p_size").cast("double") - 5

    def p(a, b):
        return F.struct(a.alias("x"), b.alias("y"))

    ring = F.array(p(s, F.lit(-1.0)), p(F.lit(40.0), F.lit(-1.0)), p(F.lit(40.0), F.lit(1.0)), p(s, F.lit(1.0)))
    part = masks.clip_convex(p(F.lit(0.0), F.lit(0.0)), p(F.lit(50.0), F.lit(0.0)), ring)
    return table(spark, sf, "part").select("p_partkey", fixed(F.when(F.col("p_size") < 45, part["to"] - part["from"])).alias("share"))


@query()
def mask_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest rectangles around the customers of each nation; compared with brute force in the tests."""
    outline = F.array_sort(F.collect_list(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))))
    rows = _places(spark, sf).groupBy("name").agg(outline.alias("o"))
    return rows.select("name", masks.rectangle_of("o").alias("r")).select("name", "r.*")


@query("""
WITH l AS (SELECT c_nationkey AS k, floor(c_acctbal / 500) AS z FROM customer WHERE c_acctbal > 0), d AS (SELECT DISTINCT k, z FROM l),
g AS (SELECT k, z, lead(z) OVER (PARTITION BY k ORDER BY z) - z AS gap FROM d)
SELECT k, CAST(count(*) AS BIGINT) AS levels, CAST(min(gap) AS BIGINT) AS gap, CAST(max(z) - min(z) AS BIGINT) AS climb FROM g GROUP BY k HAVING count(*) >= 2""")
def contour_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct contour levels that a line crosses, their least gap and the climb; at least two."""
    d = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 500).alias("z")).distinct()
    gap = F.lead("z").over(Window.partitionBy("k").orderBy("z")) - F.col("z")
    return d.withColumn("gap", gap).groupBy("k").agg(F.count(F.lit(1)).alias("levels"), F.min("gap").alias("gap"), (F.max("z") - F.min("z")).alias("climb")).filter("levels >= 2")


@query(f"""
WITH e AS (SELECT l, x, y FROM (SELECT l, x, y FROM (SELECT c_custkey AS l, CAST((c_custkey * 7919) % 100 AS DOUBLE) AS x, CAST((c_custkey * 10473) % 100 AS DOUBLE) AS y FROM customer)
  UNION ALL SELECT c_custkey, CAST((c_custkey * 31) % 100 AS DOUBLE), CAST((c_custkey * 57) % 100 AS DOUBLE) FROM customer)),
d AS (SELECT a.l, CAST(count(DISTINCT b.l) AS BIGINT) AS n FROM e a JOIN e b ON a.l <> b.l AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 2 GROUP BY 1)
SELECT c_custkey AS l, coalesce(n, 0) AS degree FROM customer LEFT JOIN d ON c_custkey = l""")
def end_degree(spark: SparkSession, sf: str) -> DataFrame:
    """How many other lines end within two metres of either end."""
    k = F.col("c_custkey")

    def p(a, b):
        return F.struct(((k * a) % 100).cast("double").alias("x"), ((k * b) % 100).cast("double").alias("y"))

    lines = table(spark, sf, "customer").select(k.alias("l"), F.array(p(7919, 10473), p(31, 57)).alias("line"))
    return polyline.end_degree(lines, "l", "line", 2.0)


@query(f"""
SELECT c_custkey, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS tx, {fx("40075016.685578488e0 * cos(radians(lat)) / 262144", 3)} AS metres, lon BETWEEN 124 AND 132 AND lat BETWEEN 33 AND 39 AS valid
FROM (SELECT c_custkey, 120 + CAST(c_custkey % 1000 AS DOUBLE) / 64 AS lon, 32 + CAST(c_custkey % 512 AS DOUBLE) / 64 AS lat FROM customer)""")
def tiles_and_resolution(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    lon, lat = 120 + (k % 1000).cast("double") / 64, 32 + (k % 512).cast("double") / 64
    return table(spark, sf, "customer").select(
        "c_custkey",
        coords.tile(lon, lat, 10)[0].alias("tx"),
        fixed(coords.ground_resolution(lat, 10), 3).alias("metres"),
        coords.valid(lon, lat).alias("valid"),
    )


@query("""
WITH d AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')
SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT k FROM d)""")
def resumed_scan(spark: SparkSession, sf: str) -> DataFrame:
    """What a resumed scan still has to read."""
    orders, lines = tables(spark, sf, "orders", "lineitem")
    done = lines.filter(F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select(F.col("l_orderkey").alias("k"))
    return pending(orders.select(F.col("o_orderkey").alias("k")), done, "k")


@query("""
WITH k AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 5 <> 0 THEN p_size END AS s, CASE WHEN p_type LIKE 'ECO%' THEN 0 WHEN p_type LIKE 'STA%' THEN 1 ELSE 2 END AS o FROM part)
SELECT p_partkey, p_brand, s, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY o, s ASC NULLS LAST, p_brand, p_partkey) AS place FROM k) WHERE place <= 20""")
def ordered_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 rows in a fixed order of kinds, sizes with nulls last, and keys."""
    kind = F.when(F.col("p_type").startswith("ECO"), 0).when(F.col("p_type").startswith("STA"), 1).otherwise(2)
    s = F.when(F.col("p_size") % 5 != 0, F.col("p_size"))
    rows = table(spark, sf, "part").select("p_partkey", "p_brand", s.alias("s"), kind.alias("o"))
    top = rows.orderBy("o", F.asc_nulls_last("s"), "p_brand", "p_partkey").limit(20)
    place = F.row_number().over(Window.orderBy("o", F.asc_nulls_last("s"), "p_brand", "p_partkey"))
    return top.select("p_partkey", "p_brand", "s", place.alias("place"))


@query(f"""
WITH d AS (SELECT o_custkey % 40 AS k, CAST(sum(CAST(floor(o_totalprice * 1e2 + 5e-1) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1),
s AS (SELECT k, CASE WHEN k % 7 = 0 THEN v + 1 ELSE v END AS v FROM d WHERE k % 11 <> 0)
SELECT coalesce(d.k, s.k) AS k, d.v AS detail, s.v AS summary FROM d FULL JOIN s ON d.k = s.k WHERE d.v IS DISTINCT FROM s.v""")
def cross_file_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics whose detail and summary differ, or that only one of them has."""
    cents = F.floor(F.col("o_totalprice") * F.lit(100.0) + F.lit(0.5)).cast("long")
    d = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.sum(cents).alias("detail"))
    s = d.filter("k % 11 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.col("detail") + 1).otherwise(F.col("detail")).alias("summary"))
    return d.join(s, "k", "full").filter(~F.col("detail").eqNullSafe(F.col("summary")))


@query(f"""
WITH {_NEAR}, p AS (SELECT s_suppkey, CAST((s_suppkey * 7919) % 1000 AS DOUBLE) AS sx, CAST((s_suppkey * 10473) % 1000 AS DOUBLE) AS sy, s_acctbal < 0 AS err FROM supplier)
SELECT a.name, CAST(count(s_suppkey) AS BIGINT) AS n, {n_if("err")} AS n_errors, array_to_string(list_sort(list(DISTINCT s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL))[1:2], ',') AS examples
FROM a LEFT JOIN p ON sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) <= 50 GROUP BY a.name""")
def facility_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Facilities within reach of the places of a name, how many of them are in error, and two examples."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k, ((k * 7919) % 1000).cast("double").alias("bx"), ((k * 10473) % 1000).cast("double").alias("by"), (F.col("s_acctbal") < 0).alias("err"))
    places = _places(spark, sf)
    # places of customers and of facilities, with their numbers and the two smallest keys; only places meet
    ours = places.groupBy("name", "ax", "ay").agg(F.count(F.lit(1)).alias("times"))
    theirs = s.withColumn("place", F.row_number().over(Window.partitionBy("bx", "by").orderBy("s_suppkey"))).groupBy("bx", "by").agg(
        F.count(F.lit(1)).alias("there"), count_of(F.col("err")).alias("wrong"), F.collect_list(F.when(F.col("place") <= 2, F.col("s_suppkey"))).alias("two")
    )
    hits = Workspace(spark, "facility-counts").table(spatial.within(ours, theirs, 50.0).select("name", "times", "there", "wrong", "two"), "hits")
    per = hits.groupBy("name").agg(F.sum(F.col("times") * F.col("there")).alias("n"), F.sum(F.col("times") * F.col("wrong")).alias("n_errors"))
    keys = hits.select("name", F.explode("two").alias("s_suppkey")).distinct()
    least = keys.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("s_suppkey"))).filter("place <= 2")
    least = least.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("s_suppkey")), ",").alias("examples"))
    zero = F.lit(0).cast("long")
    per = places.select("name").distinct().join(per, "name", "left").join(least, "name", "left")
    return per.select("name", F.coalesce("n", zero).alias("n"), F.coalesce("n_errors", zero).alias("n_errors"), "examples")
