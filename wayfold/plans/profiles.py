"""Queries: de-duplication, profiles, margins, bins, percentiles, sets of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import bands
from wayfold.functions.numbers import cents, count_of, fixed, rate
from wayfold.operators import dedup, profile
from wayfold.operators.spatial import spread
from wayfold.plans.base import fx, n_if, query, ratio
from wayfold.sources.tables import table, tables

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_SQL = ", ".join(LINE_ORDER)
LINE_DESC = ", ".join(f"{c} DESC" for c in LINE_ORDER)
ALL_LINE = ", ".join(LINE_KEY + LINE_ORDER)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*LINE_KEY, *LINE_ORDER)


@query(f"""
SELECT {ALL_LINE} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_SQL}) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keyed_dedup(_lines(spark, sf), LINE_KEY, [F.col(c) for c in LINE_ORDER])


@query(f"""
SELECT {ALL_LINE} FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_DESC}) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.keyed_dedup(_lines(spark, sf), LINE_KEY, [F.col(c) for c in LINE_ORDER], last=True)


@query(f"""
WITH k AS (SELECT CASE WHEN l_tax <> 0 THEN l_orderkey END AS l_orderkey, l_linenumber, {LINE_SQL} FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_SQL}) AS rn FROM k)
SELECT {ALL_LINE} FROM r WHERE rn = 1 OR l_orderkey IS NULL""")
def dedup_null_key_kept(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf).withColumn("l_orderkey", F.when(F.col("l_tax") != 0, F.col("l_orderkey")))
    return dedup.keyed_dedup(lines, LINE_KEY, [F.col(c) for c in LINE_ORDER])


@query("SELECT DISTINCT role, length(text) AS n_chars, turn FROM conversations")
def dedup_whole_row(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("role", F.length("text").cast("long").alias("n_chars"), "turn").distinct()


@query(f"""
WITH r AS (
  SELECT l_quantity, first_value(l_quantity) OVER w AS kept, row_number() OVER w AS rn FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_SQL}))
SELECT CAST(count(*) AS BIGINT) AS n_rows, {n_if("rn = 1")} AS n_keys, {n_if("rn > 1")} AS n_dropped,
       {n_if("l_quantity IS DISTINCT FROM kept")} AS n_conflicts FROM r""")
def dedup_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.conflicts(_lines(spark, sf), LINE_KEY, [F.col(c) for c in LINE_ORDER], "l_quantity")


@query(f"""
WITH d AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_SQL}) AS rn FROM lineitem) WHERE rn = 1)
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS flag,
       CAST(count(*) AS BIGINT) AS n, {n_if("l_discount IS NULL")} AS n_missing, {n_if("l_discount = 0")} AS n_zero,
       {n_if("l_discount = 0.05")} AS n_exact, {ratio("count(*) FILTER (WHERE l_discount = 0.05)", "count(*)")} AS exact_rate,
       {fx("quantile_cont(l_discount, 0.1)")} AS p10, {fx("quantile_cont(l_discount, 0.5)")} AS p50,
       {fx("quantile_cont(l_discount, 0.9)")} AS p90
FROM d GROUP BY GROUPING SETS ((l_returnflag), ())""")
def width_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: first row of each key, then one profile per group and over all."""
    kept = dedup.keyed_dedup(_lines(spark, sf), LINE_KEY, [F.col(c) for c in LINE_ORDER])
    return profile.valued_profile(kept, "l_discount", F.col("l_returnflag"), "flag", 0.05)


@query(f"""
SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'ALL' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(floor(o_totalprice * 1e2 + 5e-1) AS BIGINT)) AS BIGINT) AS price_cents,
       {n_if("o_totalprice >= 200000")} AS n_large, {ratio("count(*) FILTER (WHERE o_totalprice >= 200000)", "count(*)")} AS large_rate
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def crosstab_margins(spark: SparkSession, sf: str) -> DataFrame:
    large = F.col("o_totalprice") >= 200000
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.sum(cents(F.col("o_totalprice"))).alias("price_cents"),
        count_of(large).alias("n_large"),
        rate(count_of(large), F.count(F.lit(1))).alias("large_rate"),
    ]
    return profile.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", measures, "ALL", "TOTAL")


_BIN_NAMES = ["missing", "zero", "to_2", "under_3", "three", "to_4", "to_6", "to_8", "under_12", "under_20", "under_40", "from_40"]
_BIN_SQL = (
    "CASE WHEN w IS NULL THEN 'missing' WHEN w = 0 THEN 'zero' WHEN w <= 2 THEN 'to_2' WHEN w < 3 THEN 'under_3' WHEN w = 3 THEN 'three'"
    " WHEN w <= 4 THEN 'to_4' WHEN w <= 6 THEN 'to_6' WHEN w <= 8 THEN 'to_8' WHEN w < 12 THEN 'under_12' WHEN w < 20 THEN 'under_20'"
    " WHEN w < 40 THEN 'under_40' ELSE 'from_40' END"
)


@query(f"""
WITH b AS (SELECT p_brand, {_BIN_SQL} AS b FROM (SELECT p_brand, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size - 1 AS DOUBLE) END AS w FROM part))
SELECT p_brand, {", ".join(f"{n_if(f"b = '{n}'")} AS {n}" for n in _BIN_NAMES)} FROM b GROUP BY p_brand""")
def bin_pivot(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    width = F.when(F.col("p_size") % 7 != 0, (F.col("p_size") - 1).cast("double"))
    return profile.bin_pivot(part, ["p_brand"], bands.width_bin(width), bands.BIN_LABELS, _BIN_NAMES)


_PERCENTILES = f"""
SELECT l_returnflag, {", ".join(f"{fx(f'quantile_cont(l_quantity, {p})')} AS {n}" for p, n in ((0.025, "p2_5"), (0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.975, "p97_5")))}
FROM lineitem GROUP BY l_returnflag"""


@query(_PERCENTILES)
def percentiles_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return profile.percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", [0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975])


@query(_PERCENTILES)
def percentiles_by_group_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same from counts of distinct values."""
    points = [0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975]
    return profile.percentiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", points, hot=True)


_ORDER_STATS = """
WITH g AS (SELECT o_custkey % 97 AS grp, list_sort(list(o_totalprice)) AS s FROM orders GROUP BY 1)
SELECT grp, CAST(len(s) AS BIGINT) AS n, s[1] AS least, s[1 + greatest(0, CAST(floor(len(s) * 1e-1) AS BIGINT) - 1)] AS p10,
       s[1 + len(s) // 2] AS upper_median FROM g"""


@query(_ORDER_STATS)
def upper_median_p10(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("grp"), "o_totalprice")
    return profile.order_statistics(orders, ["grp"], "o_totalprice")


@query(_ORDER_STATS)
def upper_median_p10_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same without gathering a group."""
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("grp"), "o_totalprice")
    return profile.order_statistics(orders, ["grp"], "o_totalprice", hot=True)


@query("""
WITH c AS (SELECT p_brand, p_size, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS INTEGER) AS place FROM c) WHERE place <= 6""")
def topk_modes(spark: SparkSession, sf: str) -> DataFrame:
    return profile.modes(table(spark, sf, "part"), ["p_brand"], "p_size", 6)


_EDGES = [0.0, 30.0, 60.0, 90.0, 120.0, 150.0, 180.0]


@query(f"""
WITH e(bin, low, high) AS (VALUES {", ".join(f"({i}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))})
SELECT CAST(bin AS INTEGER) AS bin, low, high, CAST(count(v.value) AS BIGINT) AS n
FROM e LEFT JOIN events v ON v.value >= low AND (v.value < high OR (bin = {len(_EDGES) - 2} AND v.value <= high))
GROUP BY bin, low, high""")
def edge_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return profile.edge_histogram(table(spark, sf, "events"), F.col("value"), _EDGES)


@query(f"""
WITH c AS (SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS part FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, part, {ratio("part", "sum(part) OVER (PARTITION BY l_returnflag)", 6)} AS share FROM c""")
def composition_share(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shares(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"""
WITH c AS (SELECT o_orderstatus, o_orderpriority, CAST(sum(CAST(floor(o_totalprice * 1e2 + 5e-1) AS BIGINT)) AS BIGINT) AS part FROM orders GROUP BY ALL)
SELECT o_orderstatus, o_orderpriority, part, {ratio("part", "sum(part) OVER (PARTITION BY o_orderstatus)", 6)} AS share FROM c""")
def weighted_share(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shares(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", cents(F.col("o_totalprice")))


@query("""
WITH b AS (SELECT l_orderkey, CASE WHEN l_tax = 0 THEN NULL WHEN l_quantity <= 10 THEN 1 WHEN l_quantity <= 25 THEN 2 ELSE 3 END AS r FROM lineitem),
g AS (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, min(r) AS r FROM b GROUP BY l_orderkey)
SELECT l_orderkey, n, CASE r WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'CONDITIONAL_C' WHEN 3 THEN 'CANDIDATE_PASS' ELSE 'UNKNOWN_FAIL_CLOSED' END AS worst FROM g""")
def worst_band_rollup(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    rank = F.when(F.col("l_tax") == 0, None).when(q <= 10, 1).when(q <= 25, 2).otherwise(3)
    names = {1: "BLOCKED", 2: "CONDITIONAL_C", 3: "CANDIDATE_PASS"}
    return profile.worst_of(table(spark, sf, "lineitem"), ["l_orderkey"], rank, names, bands.UNKNOWN)


@query(f"""
WITH t AS (
  SELECT event_type, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN event_type WHEN 3 THEN '0'
         ELSE ' ' || CAST(user_id AS VARCHAR) END AS raw FROM events)
SELECT event_type, CAST(count(*) AS BIGINT) AS n, {n_if("raw IS NULL OR trim(raw) = ''")} AS n_missing,
       {n_if("raw IS NOT NULL AND trim(raw) <> '' AND try_cast(trim(raw) AS DOUBLE) IS NULL")} AS n_text,
       {n_if("try_cast(trim(raw) AS DOUBLE) = 0")} AS n_zero, {n_if("try_cast(trim(raw) AS DOUBLE) <> 0")} AS n_number
FROM t GROUP BY event_type""")
def missing_split(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("event_id") % 5
    raw = (
        F.when(m == 0, None)
        .when(m == 1, "")
        .when(m == 2, F.col("event_type"))
        .when(m == 3, "0")
        .otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string")))
    )
    return profile.named_and_missing(table(spark, sf, "events").withColumn("raw", raw), ["event_type"], "raw")


@query(f"""
SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'TOTAL' ELSE l_returnflag END AS l_returnflag, CAST(count(*) AS BIGINT) AS n_raw,
       {n_if("l_quantity BETWEEN 10 AND 30")} AS spec, {n_if("l_discount <= 0.04")} AS corridor,
       {n_if("l_quantity BETWEEN 10 AND 30 AND l_discount <= 0.04")} AS n_all,
       {ratio("count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 30) - count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 30 AND l_discount <= 0.04)", "count(*) FILTER (WHERE l_quantity BETWEEN 10 AND 30)")} AS excluded
FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def funnel_total(spark: SparkSession, sf: str) -> DataFrame:
    stages = {"spec": F.col("l_quantity").between(10, 30), "corridor": F.col("l_discount") <= 0.04}
    return profile.funnel(table(spark, sf, "lineitem"), "l_returnflag", stages, "TOTAL")


@query("""
WITH s AS (SELECT s_nationkey AS nationkey, CAST(count(*) AS BIGINT) AS n_suppliers FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1),
c AS (SELECT c_nationkey AS nationkey, CAST(count(*) AS BIGINT) AS n_customers FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1)
SELECT coalesce(s.nationkey, c.nationkey) AS nationkey, n_suppliers, n_customers FROM s FULL JOIN c ON s.nationkey = c.nationkey""")
def full_outer_compare(spark: SparkSession, sf: str) -> DataFrame:
    supplier, customer = tables(spark, sf, "supplier", "customer")
    s = supplier.filter("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    c = customer.filter("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    return s.join(c, "nationkey", "full")


@query("""
WITH a AS (SELECT DISTINCT o_custkey % 1000 AS k FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT o_custkey % 1000 AS k FROM orders WHERE o_totalprice > 300000)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b)
UNION ALL SELECT 'minus', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'one', k FROM ((SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL (SELECT k FROM b EXCEPT SELECT k FROM a))""")
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Membership of both sides in one aggregation; each operation is a filter on it."""
    key = (F.col("o_custkey") % 1000).alias("k")
    sides = (
        table(spark, sf, "orders")
        .groupBy(key)
        .agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_totalprice") > 300000).alias("b"))
    )
    ops = F.array_compact(
        F.array(
            F.when(F.col("a") | F.col("b"), "union"),
            F.when(F.col("a") & ~F.col("b"), "minus"),
            F.when(F.col("a") & F.col("b"), "both"),
            F.when(F.col("a") != F.col("b"), "one"),
        )
    )
    return sides.select(F.explode(ops).alias("op"), "k")


@query("""
SELECT 'orders' AS side, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def symmetric_keys(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = tables(spark, sf, "orders", "lineitem")
    rows = orders.select(F.col("o_orderkey").alias("k"), F.lit(True).alias("o")).unionByName(lines.select(F.col("l_orderkey").alias("k"), F.lit(False).alias("o")))
    # one grouping of both sides; keys compress so well that merged partitions would be large in memory
    sides = spread(rows, "k").groupBy("k").agg(F.bool_or("o").alias("o"), F.bool_or(~F.col("o")).alias("l"))
    apart = F.col("k").isNull()  # a null key has no partner
    only = F.array(F.when(F.col("o") & (~F.col("l") | apart), "orders"), F.when(F.col("l") & (~F.col("o") | apart), "lineitem"))
    return sides.select(F.explode(F.array_compact(only)).alias("side"), "k")


@query(f"""
SELECT o_orderpriority, {n_if("o_totalprice > 0")} AS n_valued, {n_if("o_totalprice >= 100000 AND o_totalprice < 150000")} AS n_inside,
       {ratio("count(*) FILTER (WHERE o_totalprice >= 100000 AND o_totalprice < 150000)", "count(*) FILTER (WHERE o_totalprice > 0)")} AS inside_rate
FROM orders GROUP BY o_orderpriority""")
def conditional_rates(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    return profile.conditional_rate(table(spark, sf, "orders"), ["o_orderpriority"], p > 0, (p >= 100000) & (p < 150000), "inside")


@query("""
WITH v AS (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 90 GROUP BY ALL)
SELECT user_id, count(DISTINCT event_type) = 1 AS unanimous, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS assigned,
       string_agg(event_type, ',' ORDER BY event_type) AS candidates, CAST(sum(n) AS BIGINT) AS n_votes
FROM v GROUP BY user_id""")
def vote_assignment(spark: SparkSession, sf: str) -> DataFrame:
    votes = table(spark, sf, "events").filter("value > 90").groupBy("user_id").agg(
        F.array_sort(F.collect_set("event_type")).alias("c"), F.count(F.lit(1)).alias("n_votes")
    )
    one = F.size("c") == 1
    return votes.select("user_id", one.alias("unanimous"), F.when(one, F.col("c")[0]).alias("assigned"), F.array_join("c", ",").alias("candidates"), "n_votes")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r, range(20) AS j(k)
WHERE (n <= 20 AND k = 0) OR (n > 20 AND i = CAST(floor(CAST(k AS DOUBLE) * (n - 1) / 19) AS BIGINT))""")
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Up to 20 rows a group, evenly spaced by position."""
    w = Window.partitionBy("user_id")
    placed = table(spark, sf, "events").select(
        "user_id",
        "event_id",
        (F.row_number().over(w.orderBy("event_id")) - 1).alias("i"),
        F.count(F.lit(1)).over(w).alias("n"),
    )
    wanted = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.floor(k.cast("double") * (F.col("n") - 1) / 19))
    return placed.filter((F.col("n") <= 20) | F.array_contains(wanted, F.col("i").cast("long"))).select("user_id", "event_id")


@query("""
SELECT p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(p) AS BIGINT) AS filled, min(p) AS least, max(p) AS most,
       list_sort(list(p) FILTER (WHERE p IS NOT NULL))[1 + CAST(count(p) AS BIGINT) // 2] AS upper_median
FROM (SELECT p_brand, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS p FROM part) GROUP BY p_brand""")
def fill_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("p")
    return table(spark, sf, "part").select("p_brand", p).groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("p").alias("filled"),
        F.min("p").alias("least"),
        F.max("p").alias("most"),
        profile.upper_median(F.collect_list("p")).alias("upper_median"),
    )


@query("""
SELECT (SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) FROM lineitem) AS all_parts,
       (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag)) AS sum_of_groups""")
def distinct_across_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct keys over all groups and summed within groups, from one set of pairs."""
    pairs = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey").distinct()
    return pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("all_parts"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("sum_of_groups")
    )


@query(f"""
SELECT nationkey, CAST(count(*) AS BIGINT) AS n, {fx("sum(CAST(floor(acctbal * 1e2 + 5e-1) AS BIGINT)) / 1e2", 2)} AS balance, bool_or(acctbal < 0) AS any_debt, min(acctbal) AS least, max(acctbal) AS most
FROM (SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer) GROUP BY nationkey""")
def grouped_flags(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("b"))
    return c.groupBy("nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        fixed(F.sum(cents(F.col("b"))) / F.lit(100.0), 2).alias("balance"),
        F.bool_or(F.col("b") < 0).alias("any_debt"),
        F.min("b").alias("least"),
        F.max("b").alias("most"),
    )
