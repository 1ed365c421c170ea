"""Queries: measures along a ranking under resampling and dealing, pairs removed in order, vehicle rules on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.numbers import fixed
from wayfold.operators import graph, learn, ranking, sweep
from wayfold.plans.base import fx, n_if, query
from wayfold.sources.tables import table, tables

REPLICATES = 1000


def _average_precisions(score: str) -> str:
    """(r, ap) of each replicate: weighted sums by threshold, classes weighted back to their sizes."""
    return f"""SELECT r, sum(dp / p_all * tp / (tp + fp)) AS ap FROM (
      SELECT r, dp, p_all, sum(dp) OVER w / p_all * n_pos AS tp, sum(dn) OVER w / CASE WHEN n_all > 0 THEN n_all END * n_neg AS fp FROM (
        SELECT r, s, CAST(sum(m * y) AS DOUBLE) AS dp, CAST(sum(m * (1 - y)) AS DOUBLE) AS dn, CAST(sum(sum(m * y)) OVER (PARTITION BY r) AS DOUBLE) AS p_all,
               CAST(sum(sum(m * (1 - y))) OVER (PARTITION BY r) AS DOUBLE) AS n_all FROM (SELECT r, y, m, {score} AS s FROM d) GROUP BY r, s
      ), (SELECT CAST(sum(y) AS DOUBLE) AS n_pos, CAST(sum(1 - y) AS DOUBLE) AS n_neg FROM l)
      WINDOW w AS (PARTITION BY r ORDER BY s DESC RANGE UNBOUNDED PRECEDING)
    ) WHERE p_all > 0 AND tp + fp > 0 GROUP BY r"""


@query(f"""
WITH l AS (SELECT l.doc_id, CAST(quality AS BIGINT) AS y, n_chars // 50 AS a, (l.doc_id * 7919 % 1000 + n_chars // 10) AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
d AS (SELECT r, y, a, b, {ranking.draws_sql('doc_id', 'r')} AS m FROM l, range({REPLICATES}) x(r)),
x AS ({_average_precisions('a')}), z AS ({_average_precisions('b')}), f AS (SELECT x.ap - z.ap AS f FROM x JOIN z ON x.r = z.r)
SELECT CAST({REPLICATES} AS BIGINT) AS replicates, {fx('quantile_cont(f, 0.025)')} AS low, {fx('quantile_cont(f, 0.5)')} AS middle, {fx('quantile_cont(f, 0.975)')} AS high,
       {fx('avg(CAST(f > 0 AS DOUBLE))')} AS share_above FROM f""")
def precision_difference_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the difference in average precision of two scores, over 1,000 resamples stratified by class."""
    labels, documents = tables(spark, sf, "labels", "documents")
    a, b = F.floor(F.col("n_chars") / 50), F.col("doc_id") * 7919 % 1000 + F.floor(F.col("n_chars") / 10)
    rows = labels.join(documents.select("doc_id", "n_chars"), "doc_id").select("doc_id", "quality", a.alias("a"), b.alias("b"))
    return ranking.precision_difference(rows, "doc_id", "quality", "a", "b", REPLICATES)


_SLOPES = f"SELECT {fx('regr_slope(y, a)', 8)} AS ka, {fx('regr_slope(y, b)', 8)} AS kb FROM l"
_FACTORS = "[" + ", ".join(map(str, learn.DEALING)) + "]"
_MEASURES = f"""{fx('sum(dp * tp / (tp + fp)) / sum(dp)')} AS ap, {fx('sum(dn * (tp - dp / 2)) / (sum(dp) * sum(dn))')} AS auc"""


def _measured(rows: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    more = f"{keys}, " if keys else ""
    return f"""SELECT {more}{_MEASURES} FROM (
      SELECT {more}dp, dn, sum(dp) OVER w AS tp, sum(dn) OVER w AS fp FROM (
        SELECT {more}s, CAST(sum(y) AS DOUBLE) AS dp, CAST(sum(1 - y) AS DOUBLE) AS dn FROM ({rows}) GROUP BY {more}s
      ) WINDOW w AS ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING)
    ) {f'GROUP BY {keys}' if keys else ''}"""


@query(f"""
WITH l AS (SELECT l.doc_id, CAST(quality AS BIGINT) AS y, CAST(n_chars AS DOUBLE) AS a, CAST(l.doc_id * 7919 % 1000 AS DOUBLE) AS b,
                  row_number() OVER (ORDER BY l.doc_id) - 1 AS i, count(*) OVER () AS n FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
k AS ({_SLOPES}), q AS (SELECT l.*, r, {_FACTORS}[r % 10 + 1] AS f FROM l, range(10) x(r)),
g AS (SELECT *, CAST(CASE WHEN n % f <> 0 THEN (CAST(i AS HUGEINT) * f + (r + 1) * 7919) % n ELSE (i + r + 1) % n END AS BIGINT) AS j FROM q),
w AS (SELECT g.r, g.y, g.a, g.b, v.a AS va, v.b AS vb FROM g JOIN l v ON v.i = g.j),
c AS (SELECT 'a' AS "column", r, y, va * ka + b * kb AS s FROM w, k UNION ALL SELECT 'b', r, y, a * ka + vb * kb FROM w, k),
m AS ({_measured('SELECT * FROM c', '"column", r')}), o AS ({_measured('SELECT y, a * ka + b * kb AS s FROM l, k', '')})
SELECT "column", {fx('avg(o.ap - m.ap)')} AS loss_average_precision, {fx('avg(o.auc - m.auc)')} AS loss_roc_auc FROM m, o GROUP BY 1""")
def permutation_losses(spark: SparkSession, sf: str) -> DataFrame:
    """What a fitted additive model loses when a feature's values are dealt anew, ten times."""
    labels, documents = tables(spark, sf, "labels", "documents")
    rows = labels.join(documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", "quality", F.col("n_chars").cast("double").alias("a"), (F.col("doc_id") * 7919 % 1000).cast("double").alias("b")
    )
    slopes = rows.agg(*(fixed(F.regr_slope(F.col("quality").cast("double"), F.col(c)), 8).alias(f"_k{c}") for c in "ab"))

    def score(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(slopes)).withColumn("score", F.col("a") * F.col("_ka") + F.col("b") * F.col("_kb")).drop("_ka", "_kb")

    return learn.permutation_importance(rows, ["a", "b"], "doc_id", score, "quality")


_AT = "c_custkey AS id, c_nationkey AS n, CAST((c_custkey * 7919) % 1000 AS DOUBLE) AS x, CAST((c_custkey * 10473) % 1000 AS DOUBLE) AS y, c_custkey % 11 * 9 - 45 AS vx, c_custkey % 13 * 9 - 54 AS vy"


@query(f"""
WITH RECURSIVE c AS (SELECT {_AT} FROM customer),
p AS (SELECT a.n, a.id AS i, b.id AS j FROM c a JOIN c b ON a.n = b.n AND a.id < b.id AND a.vx * b.vx + a.vy * b.vy < 0 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 100),
nb AS (SELECT n, j AS id, list(i) AS before FROM p GROUP BY ALL),
ids AS (SELECT u.n, u.id, coalesce(before, []) AS before, row_number() OVER (PARTITION BY u.n ORDER BY u.id) AS k FROM (SELECT n, i AS id FROM p UNION SELECT n, j FROM p) u LEFT JOIN nb ON nb.n = u.n AND nb.id = u.id),
w AS (SELECT DISTINCT n, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM ids
      UNION ALL SELECT w.n, ids.k, CASE WHEN list_has_any(w.kept, ids.before) THEN w.kept ELSE list_append(w.kept, ids.id) END FROM w JOIN ids ON ids.n = w.n AND ids.k = w.k + 1),
f AS (SELECT n, arg_max(kept, k) AS kept FROM w GROUP BY n)
SELECT ids.n, ids.id FROM ids JOIN f ON ids.n = f.n WHERE NOT list_contains(kept, ids.id)""")
def opposite_pairs_removed(spark: SparkSession, sf: str) -> DataFrame:
    """Points that fall to an earlier one near them of the same nation that runs the other way."""
    c = table(spark, sf, "customer").selectExpr(*(f"{p.strip()}" for p in _AT.split(", ")))
    removed = graph.greedy_removal_near(c, "id", "x", "y", ["n"], ["vx", "vy"], 100.0, "a_vx * b_vx + a_vy * b_vy < 0")
    return removed.select("n", "id")


_MEASURED = {"A": "l_quantity * 0.5", "L": "2.5 + (l_partkey % 56) / 10", "S": "1.2 + (l_suppkey % 20) / 10", "R": "0.5 + l_discount * 4"}


def _outline_sql() -> str:
    def row(name: str, o: sweep.VehicleOutline) -> str:
        limits = (o.least_area, o.most_area, o.least_length, o.most_length, o.least_width, o.most_width, o.least_ratio, o.most_ratio, o.least_fill)
        return f"('{name}', {', '.join(f'CAST({x!r} AS DOUBLE)' for x in limits)})"

    return ", ".join(row(n, o) for n, o in ({"base": sweep.VehicleOutline()} | sweep.outline_settings()).items())


_MET = "coalesce(A BETWEEN {0}a0 AND {0}a1 AND L BETWEEN {0}l0 AND {0}l1 AND S BETWEEN {0}s0 AND {0}s1 AND L / nullif(S, 0) BETWEEN {0}q0 AND {0}q1 AND R >= {0}r0, false)"


@query(f"""
WITH s(setting, a0, a1, l0, l1, s0, s1, q0, q1, r0) AS (VALUES {_outline_sql()}), base AS (SELECT * FROM s WHERE setting = 'base'),
m AS (SELECT {', '.join(f'CAST({x} AS DOUBLE) AS {c}' for c, x in _MEASURED.items())}, l_returnflag = 'R' AS flag FROM lineitem),
f AS (SELECT s.setting, flag, flag <> ({_MET.format('base.')} <> {_MET.format('s.')}) AS now FROM m, s, base)
SELECT setting, {n_if('now')} AS n_spec, {n_if('now <> flag')} AS n_changed, {fx('100 * CAST(count(*) FILTER (WHERE now = flag) AS DOUBLE) / count(*)', 4)} AS invariance FROM f GROUP BY setting""")
def vehicle_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """A stored flag under the vehicle rule with each measure's limits moved: it changes only where the rule's verdict does."""
    measures: list[Column] = [F.expr(x).cast("double").alias(c) for c, x in _MEASURED.items()]
    rows = table(spark, sf, "lineitem").select(*measures, (F.col("l_returnflag") == "R").alias("flag"))
    return sweep.vehicle_sweep(rows, "flag")
