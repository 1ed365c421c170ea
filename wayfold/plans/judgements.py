"""Queries: names and tiers, bands, inclusion rates, statistics of rates, site tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import bands, names
from wayfold.functions.numbers import cents, count_of, fixed
from wayfold.operators import setrates, sweep
from wayfold.plans.base import fx, n_if, query
from wayfold.sources.tables import table, tables


@query("""
SELECT p_partkey,
  CASE WHEN ends_with(p_name, 'e') THEN 'avenue' WHEN ends_with(p_name, 'd') THEN 'street' WHEN ends_with(p_name, 't') THEN 'lane' ELSE 'other' END AS tier4,
  CASE WHEN regexp_matches(p_name || CAST(p_size AS VARCHAR) || '번길', '[0-9]+번안?길$') AND p_size % 2 = 0 THEN '번길'
       WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 3 = 0 THEN '대로' WHEN p_size % 7 = 0 THEN '로' WHEN p_size % 11 = 0 THEN '길' ELSE '기타' END AS tier5,
  CASE WHEN p_size % 2 = 0 THEN '번길' WHEN p_size % 5 = 0 THEN '기타' WHEN p_size % 3 = 0 THEN '대로' WHEN p_size % 7 = 0 THEN '로'
       WHEN p_size % 11 = 0 THEN '길' ELSE '기타' END AS tier5_by_suffix
FROM part""")
def tier_classify(spark: SparkSession, sf: str) -> DataFrame:
    part, size = table(spark, sf, "part"), F.col("p_size")
    suffix = (
        F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit("번길")))
        .when(size % 5 == 0, "")
        .when(size % 3 == 0, "대로")
        .when(size % 7 == 0, "로")
        .when(size % 11 == 0, "길")
        .otherwise("x")
    )
    road = F.when(suffix == "", "").otherwise(F.concat("p_name", suffix))
    return part.select(
        "p_partkey",
        names.tier4(F.col("p_name"), "e", "d", "t", "other")
        .alias("raw"),
        names.tier5(road).alias("tier5"),
        names.tier5_by_suffix(road).alias("tier5_by_suffix"),
    ).select(
        "p_partkey",
        F.when(F.col("raw") == "e", "avenue").when(F.col("raw") == "d", "street").when(F.col("raw") == "t", "lane").otherwise("other").alias("tier4"),
        "tier5",
        "tier5_by_suffix",
    )


@query(r"""
WITH l AS (SELECT doc_id, coalesce(text, '') AS name FROM documents),
n AS (SELECT doc_id, regexp_replace(name, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g') AS compact,
             regexp_replace(regexp_replace(nfc_normalize(name), '\([^)]*\)', '', 'g'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g') AS normal FROM l)
SELECT *, normal IN ('', '-') AS unnamed FROM n""")
def name_normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.col("text").alias("name"))
    return rows.select(
        "doc_id", names.compact(F.col("name")).alias("compact"), names.normal_name(F.col("name")).alias("normal")
    ).withColumn("unnamed", names.is_unnamed(F.col("normal")))


@query("""
SELECT c_custkey, CASE WHEN instr(c_mktsegment, 'BUILD') > 0 THEN 'construction' WHEN instr(c_mktsegment, 'MACH') > 0 THEN 'industry'
       WHEN c_mktsegment <> '' THEN c_mktsegment ELSE 'unknown' END AS segment,
       CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE CAST(c_nationkey AS VARCHAR) END AS nation
FROM customer""")
def label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    labels = [("BUILD", "construction"), ("MACH", "industry")]
    return table(spark, sf, "customer").select(
        "c_custkey",
        names.first_containing(F.col("c_mktsegment"), labels, "unknown").alias("segment"),
        names.coded(F.col("c_nationkey").cast("string"), {"0": "zero", "1": "one"}).alias("nation"),
    )


@query("""
WITH w AS (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN CAST(p_size AS DOUBLE) / 8 END AS w FROM part)
SELECT p_partkey,
  CASE WHEN w IS NULL THEN 'UNKNOWN_FAIL_CLOSED' WHEN w <= 2.5 THEN 'BLOCKED' WHEN w <= 3.5 THEN 'CONDITIONAL_C' ELSE 'CANDIDATE_PASS' END AS band,
  CASE WHEN w IS NULL THEN 'UNKNOWN_FAIL_CLOSED' WHEN w + 0.48e0 < 3.5 THEN 'BLOCKED_C' ELSE 'CONDITIONAL_C' END AS band_error,
  CASE WHEN w IS NULL THEN 'no width' WHEN w <= 0 THEN 'width not positive' END AS reason,
  CASE WHEN w IS NULL THEN 'not comparable' WHEN w >= 1 AND w <= 5 THEN 'consistent' ELSE 'different' END AS agreement,
  coalesce(w > 2.5, false) AS one, coalesce(w > 3.7, false) AS two, coalesce(w >= 5.7, false) AS three_loose,
  concat_ws(' · ', CASE WHEN w IS NULL THEN 'no width' END, CASE WHEN p_partkey % 2 = 0 THEN 'even' END) AS notes
FROM w""")
def band_and_reason(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    w = F.col("w")
    rows = table(spark, sf, "part").select("p_partkey", F.when(size % 9 != 0, size.cast("double") / 8).alias("w"))
    one, two, _ = bands.slot_flags(w)
    return rows.select(
        "p_partkey",
        bands.band(w).alias("band"),
        bands.band_with_error(w).alias("band_error"),
        bands.band_and_reason(w)["reason"].alias("reason"),
        bands.agreement(w, F.lit(2.0), F.lit(4.0)).alias("agreement"),
        one.alias("one"),
        two.alias("two"),
        bands.slot_flags(w, strict=False)[2].alias("three_loose"),
        bands.reasons(F.when(w.isNull(), "no width"), F.when(F.col("p_partkey") % 2 == 0, "even")).alias("notes"),
    )


@query("""
WITH w AS (SELECT p_partkey, CASE WHEN p_size % 9 <> 0 THEN CAST(p_size AS DOUBLE) / 10 END AS w FROM part),
e AS (SELECT *, CASE WHEN w >= 2.5 THEN 2.5e0 WHEN w >= 2.2 THEN 2.2e0 WHEN w >= 1.9 THEN 1.9e0 END AS e FROM w)
SELECT p_partkey, e AS class_width,
  CASE WHEN w IS NULL THEN 'UNKNOWN_FAIL_CLOSED' WHEN e IS NULL THEN 'impassable' WHEN w >= e + 1.2e0 THEN 'space' ELSE 'time' END AS mode,
  CASE WHEN w IS NULL THEN NULL WHEN e IS NULL OR w < e + 2.0e0 THEN 'Y' ELSE 'N' END AS closed
FROM e""")
def separation_mode(spark: SparkSession, sf: str) -> DataFrame:
    size, w = F.col("p_size"), F.col("w")
    rows = table(spark, sf, "part").select("p_partkey", F.when(size % 9 != 0, size.cast("double") / 10).alias("w"))
    kept = rows.withColumn("s", bands.separation(w))
    return kept.select("p_partkey", bands.class_width(w).alias("class_width"), F.col("s.mode").alias("mode"), F.col("s.closed").alias("closed"))


@query("""
WITH l AS (SELECT l_orderkey, min(l_quantity) AS q FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey,
  CASE WHEN o_totalprice <= 100000 THEN 1 WHEN o_totalprice <= 200000 THEN 2 ELSE 3 END AS a,
  CASE WHEN q IS NULL THEN 0 WHEN q <= 5 THEN 1 WHEN q <= 15 THEN 2 ELSE 3 END AS b
  FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT CASE WHEN b = 0 THEN 'not comparable' WHEN b > a THEN 'raised' WHEN b < a THEN 'lowered' ELSE 'same' END AS change, CAST(count(*) AS BIGINT) AS n
FROM b GROUP BY 1""")
def rank_change(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = tables(spark, sf, "orders", "lineitem")
    q = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_quantity").alias("q"))
    price = F.col("o_totalprice")
    before = F.when(price <= 100000, "BLOCKED").when(price <= 200000, "CONDITIONAL_C").otherwise("CANDIDATE_PASS")
    after = F.when(F.col("q").isNull(), bands.UNKNOWN).when(F.col("q") <= 5, "BLOCKED").when(F.col("q") <= 15, "CONDITIONAL_C").otherwise("CANDIDATE_PASS")
    return orders.join(q, "o_orderkey", "left").groupBy(bands.rank_change(before, after).alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.01 THEN l_quantity / 10 END AS a,
                  CASE WHEN l_discount > 0.01 THEN l_quantity / 10 - l_discount END AS b, l_returnflag = 'R' AS missed FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT missed THEN least(a, b) END AS width,
  CASE WHEN missed THEN 'missed detection' WHEN a = least(a, b) THEN 'width 1' WHEN b = least(a, b) THEN 'width 2' ELSE 'none' END AS basis
FROM w""")
def final_width_min(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity") / 10
    a, b = F.when(F.col("l_tax") > 0.01, q), F.when(F.col("l_discount") > 0.01, q - F.col("l_discount"))
    w = bands.final_width(F.col("l_returnflag") == "R", a, b)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("w"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("w.width").alias("width"), F.col("w.basis").alias("basis"))


_Z = "1.959964e0"


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    p, z = f"(CAST({k} AS DOUBLE) / {n})", f"CAST({_Z} AS DOUBLE)"
    d = f"(1 + {z} * {z} / {n})"
    c = f"({p} + {z} * {z} / (2 * {n})) / {d}"
    h = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * CAST({n} AS DOUBLE) * {n})) / {d}"
    return f"({c} - {h})", f"({c} + {h})"


_LOW, _HIGH = wilson_sql("k", "n")


@query(f"""
WITH pop AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size <= 40),
ref AS (SELECT DISTINCT p_brand, p_name FROM part WHERE p_size > 40),
j AS (SELECT pop.p_brand, CAST(count(*) AS BIGINT) AS n, CAST(count(ref.p_name) AS BIGINT) AS k
      FROM pop LEFT JOIN ref ON pop.p_brand = ref.p_brand AND pop.p_name = ref.p_name GROUP BY 1),
a AS (SELECT p_brand, n, k FROM j UNION ALL SELECT 'ALL', CAST(sum(n) AS BIGINT), CAST(sum(k) AS BIGINT) FROM j)
SELECT p_brand, n, k, {fx("CAST(k AS DOUBLE) / n")} AS rate, {fx(_LOW)} AS low, {fx(_HIGH)} AS high FROM a""")
def name_inclusion(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    population = part.filter("p_size <= 40").select("p_brand", "p_name").distinct()
    reference = part.filter("p_size > 40").select("p_brand", "p_name").distinct()
    return setrates.inclusion(population, reference, ["p_brand"], "p_name", "ALL")


@query(f"""
WITH pop AS (SELECT DISTINCT c_nationkey AS d, c_custkey % 400 AS name, c_mktsegment = 'BUILDING' AS treated FROM customer),
ref AS (SELECT DISTINCT s_nationkey AS d, s_suppkey % 400 AS name FROM supplier),
i AS (SELECT treated, EXISTS (SELECT 1 FROM ref WHERE ref.d = pop.d AND ref.name = pop.name) AS own,
             EXISTS (SELECT 1 FROM ref WHERE ref.name = pop.name) AS anywhere FROM pop)
SELECT treated, CAST(count(*) AS BIGINT) AS n, {n_if("NOT own")} AS n_missing, {n_if("NOT own AND anywhere")} AS n_found_elsewhere FROM i GROUP BY treated""")
def treatment_control(spark: SparkSession, sf: str) -> DataFrame:
    customer, supplier = tables(spark, sf, "customer", "supplier")
    population = customer.select(
        F.col("c_nationkey").alias("d"), (F.col("c_custkey") % 400).alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("treated")
    ).distinct()
    reference = supplier.select(F.col("s_nationkey").alias("d"), (F.col("s_suppkey") % 400).alias("name")).distinct()
    return setrates.treatment_and_control(population, reference, "d", "name", "treated")


@query(f"""
WITH t AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS BIGINT) AS a, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS BIGINT) AS b,
                  CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS BIGINT) AS c, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS BIGINT) AS d FROM labels),
x AS (SELECT *, unnest(range(0, a + b + 1)) AS i FROM t),
p AS (SELECT a, b, c, d, i, lgamma(a+b+1) + lgamma(c+d+1) + lgamma(a+c+1) + lgamma(b+d+1) - lgamma(a+b+c+d+1)
        - lgamma(i+1) - lgamma(a+b-i+1) - lgamma(a+c-i+1) - lgamma(d-a+i+1) AS l FROM x WHERE a + c - i >= 0 AND d - a + i >= 0),
s AS (SELECT a, b, c, d, least(1.0, sum(exp(l)) FILTER (WHERE i >= a)) AS up, least(1.0, sum(exp(l)) FILTER (WHERE i <= a)) AS down FROM p GROUP BY ALL)
SELECT a, b, c, d, {fx("up", 6)} AS p_upper, {fx("down", 6)} AS p_lower,
       CASE WHEN up < 0.05 THEN 'higher' WHEN down < 0.05 THEN 'lower' ELSE 'no difference' END AS verdict FROM s""")
def fisher_tail(spark: SparkSession, sf: str) -> DataFrame:
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    cells = table(spark, sf, "labels").agg(
        count_of(q & t).alias("a"),
        count_of(q & ~t).alias("b"),
        count_of(~q & t).alias("c"),
        count_of(~q & ~t).alias("d"),
    )
    return setrates.fisher(cells)


@query("""
WITH t AS (SELECT DISTINCT p_name FROM part WHERE p_size <= 10),
u AS (SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN p_name || 's' ELSE substr(p_name, 2) END AS name FROM part WHERE p_size > 10)
SELECT p_name, EXISTS (SELECT 1 FROM u WHERE levenshtein(u.name, t.p_name) <= 1) AS near FROM t""")
def fuzzy_exists(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    missing = part.filter("p_size <= 10").select("p_name").distinct()
    other = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("s"))).otherwise(F.substring("p_name", 2, 1_000_000))
    return setrates.near_name(missing, "p_name", part.filter("p_size > 10").select(other.alias("name")).distinct(), "name")


_SWEEP_SQL = ", ".join(
    f"('{name}', CAST({q0} AS DOUBLE), CAST({q1} AS DOUBLE), CAST({d1} AS DOUBLE))"
    for name, q0, q1, d1 in sweep.stand_in_settings()
)


@query(f"""
WITH s(setting, q0, q1, d1) AS (VALUES {_SWEEP_SQL}),
f AS (SELECT setting, l_orderkey, l_linenumber, l_returnflag, l_quantity BETWEEN q0 AND q1 AND l_discount <= d1 AS now, l_quantity BETWEEN 10 AND 30 AND l_discount <= 0.05 AS base FROM lineitem, s)
SELECT setting, {n_if("now")} AS n_spec, {n_if("now <> base")} AS n_changed, {fx("100 * CAST(count(*) FILTER (WHERE now = base) AS DOUBLE) / count(*)", 4)} AS invariance
FROM f GROUP BY setting""")
def spec_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.stand_in(table(spark, sf, "lineitem"))


@query("""
WITH b(side, v, tol) AS (VALUES ('low', CAST(10 AS DOUBLE), CAST(0.5 AS DOUBLE)), ('high', CAST(30 AS DOUBLE), CAST(0.5 AS DOUBLE)))
SELECT side, l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem, b WHERE abs(l_quantity - v) <= tol GROUP BY ALL""")
def boundary_rows(spark: SparkSession, sf: str) -> DataFrame:
    limits = {"low": (10.0, 0.5), "high": (30.0, 0.5)}
    return sweep.near_limits(table(spark, sf, "lineitem"), "l_quantity", limits).groupBy("side", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH r AS (SELECT c_nationkey AS k, CAST(count(*) AS BIGINT) AS n_customers, bool_or(c_acctbal > 9000) AS any_rich, bool_and(c_acctbal < 9990) AS no_peak FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS k, min(s_acctbal) AS least FROM supplier GROUP BY 1)
SELECT n_nationkey, r_name, coalesce(n_customers, 0) AS n_customers, s.least,
       CASE WHEN any_rich THEN 'present' WHEN no_peak THEN 'absent' ELSE 'undecided' END AS verdict,
       CASE WHEN s.k IS NULL THEN 'no supplier' END AS reason
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN r ON n_nationkey = r.k LEFT JOIN s ON n_nationkey = s.k""")
def site_table(spark: SparkSession, sf: str) -> DataFrame:
    """One wide row a site from several sources; a missing source is a reason, not a dropped row."""
    nation, region, customer, supplier = tables(spark, sf, "nation", "region", "customer", "supplier")
    balance = F.col("c_acctbal")
    c = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("n_customers"), F.bool_or(balance > 9000).alias("any_rich"), F.bool_and(balance < 9990).alias("no_peak")
    )
    s = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_acctbal").alias("least"))
    wide = nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left")
    return wide.select(
        "n_nationkey",
        "r_name",
        F.coalesce("n_customers", F.lit(0).cast("long")).alias("n_customers"),
        "least",
        F.when(F.col("any_rich"), "present").when(F.col("no_peak"), "absent").otherwise("undecided").alias("verdict"),
        F.when(F.col("least").isNull(), "no supplier").alias("reason"),
    )


@query("""
WITH o AS (SELECT o_orderpriority AS scenario, 'orders' AS metric, CAST(count(*) AS BIGINT) AS v FROM orders GROUP BY 1
  UNION ALL SELECT o_orderpriority, 'customers', CAST(count(DISTINCT o_custkey) AS BIGINT) FROM orders GROUP BY 1)
SELECT metric, max(v) FILTER (WHERE scenario = '1-URGENT') AS urgent, max(v) FILTER (WHERE scenario = '2-HIGH') AS high, max(v) FILTER (WHERE scenario = '5-LOW') AS low
FROM o GROUP BY metric""")
def scenario_ledger(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers")
    )
    tall = counted.unpivot("scenario", ["orders", "customers"], "metric", "v")
    wide = tall.groupBy("metric").pivot("scenario", ["1-URGENT", "2-HIGH", "5-LOW"]).max("v")
    return wide.select("metric", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))


@query("""
WITH b(budget) AS (VALUES (10), (20), (30), (60)),
p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 1.5 AS len, p_size % 4 = 0 AS blocked FROM part)
SELECT CAST(budget AS INTEGER) AS budget, CAST(count(*) FILTER (WHERE blocked) AS BIGINT) AS n_blocked,
       CAST(count(*) FILTER (WHERE blocked AND len > budget) AS BIGINT) AS n_over FROM p, b GROUP BY budget""")
def passage_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """How many blocked pieces take longer than a budget at one metre a second."""
    pieces = table(spark, sf, "part").select((F.col("p_size").cast("double") * 1.5).alias("len"), (F.col("p_size") % 4 == 0).alias("blocked"))
    budgets = [10, 20, 30, 60]
    return (
        pieces.select("len", "blocked", F.explode(F.array(*map(F.lit, budgets))).alias("budget"))
        .groupBy("budget")
        .agg(count_of(F.col("blocked")).alias("n_blocked"), count_of(F.col("blocked") & (F.col("len") > F.col("budget"))).alias("n_over"))
    )


@query("""
SELECT o_orderkey, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority)) AS input_hash,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS version FROM orders""")
def decision_hash(spark: SparkSession, sf: str) -> DataFrame:
    """A stable hash of what a decision was made from, and its version within its subject."""
    body = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority")
    version = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", F.sha2(body, 256).alias("input_hash"), version.alias("version"))


@query(f"""
SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, {fx("sqrt((r * r - 16) + 36) - sqrt(r * r - 16) + 2", 3)} AS needed
FROM (SELECT DISTINCT l_linenumber, CAST(l_linenumber + 5 AS DOUBLE) AS r FROM lineitem)""")
def swept_width(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_linenumber") + 5).cast("double").alias("r")).distinct()
    needed = bands.swept_width(F.lit(2.0), F.lit(4.0), F.lit(2.0), F.col("r"))
    return rows.select("l_linenumber", fixed(needed, 3).alias("needed"))
