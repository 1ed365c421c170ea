"""Queries: neighbourhoods, routes, slots, classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.numbers import count_of, fixed
from wayfold.operators import graph, learn, slots
from wayfold.plans.base import fx, n_if, query
from wayfold.sources.tables import table, tables
from wayfold.workspace import Workspace

_NATIONS = "e AS (SELECT DISTINCT s_nationkey AS a, (s_nationkey * 3 + s_suppkey % 2) % 25 AS b FROM supplier)"


def _nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").cast("long").alias("a"), ((F.col("s_nationkey") * 3 + F.col("s_suppkey") % 2) % 25).cast("long").alias("b")).distinct()


@query(f"""
WITH RECURSIVE {_NATIONS}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT CAST(5 AS BIGINT) AS id, 0 AS hop UNION SELECT u.b, hop + 1 FROM r JOIN u ON u.a = r.id WHERE hop < 3)
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY id""")
def khop_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return graph.k_hop(_nation_edges(spark, sf), spark.range(5, 6), 3).select("id", F.col("hop").cast("int").alias("hop"))


_GRID = "l AS (SELECT CAST(f AS BIGINT) AS f, CAST(f + d AS BIGINT) AS t, CAST(1 + (f * 7 + d * 3) % 5 AS BIGINT) AS cost FROM range(60) x(f), (VALUES (1), (2), (7)) y(d) WHERE f + d < 60)"


def _grid_links(spark: SparkSession) -> DataFrame:
    d = F.explode(F.array(F.lit(1), F.lit(2), F.lit(7)))
    links = spark.range(60).select(F.col("id").alias("f_node"), d.alias("d")).withColumn("t_node", F.col("f_node") + F.col("d")).filter("t_node < 60")
    return links.select((F.col("f_node") * 100 + F.col("t_node")).alias("link_id"), "f_node", "t_node", (1 + (F.col("f_node") * 7 + F.col("d") * 3) % 5).alias("cost"))


@query(f"""
WITH RECURSIVE {_GRID}, k AS (SELECT f * 100 + t AS id, f, t, cost FROM l WHERE f * 100 + t <> 203),
r AS (SELECT id, t, cost FROM k WHERE f = 0
      UNION SELECT k.id, k.t, r.cost + k.cost FROM r JOIN k ON r.t = k.f WHERE NOT (r.id = 1 AND k.id = 102) AND r.cost < 60)
SELECT id AS link_id, CAST(min(cost) AS BIGINT) AS cost FROM r GROUP BY id HAVING min(cost) <= 40""")
def shortest_route(spark: SparkSession, sf: str) -> DataFrame:
    """Costs of all links from node 0, with one blocked link and one banned turn."""
    banned = spark.createDataFrame([(1, 102)], "st_link long, ed_link long")
    blocked = spark.createDataFrame([(203,)], "link_id long")
    reached = graph.routes(_grid_links(spark), spark.createDataFrame([(0,)], "node long"), banned, blocked)
    return reached.select("link_id", "cost").filter("cost <= 40")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey % 300 AS f, l_partkey % 300 AS t FROM lineitem WHERE l_quantity > 40), n AS (SELECT x AS node FROM range(300) r(x) WHERE (x * 7919) % 300 < 80),
m AS (SELECT f, t, f IN (SELECT node FROM n) AS a, t IN (SELECT node FROM n) AS b FROM l)
SELECT 'inside' AS part, CAST(count(*) AS BIGINT) AS n FROM m WHERE a AND b
UNION ALL SELECT 'border', CAST(count(DISTINCT CASE WHEN a THEN f ELSE t END) AS BIGINT) FROM m WHERE a <> b""")
def subgraph_boundary(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "lineitem").filter("l_quantity > 40").select((F.col("l_orderkey") % 300).alias("f_node"), (F.col("l_partkey") % 300).alias("t_node")).distinct()
    nodes = spark.range(300).filter("(id * 7919) % 300 < 80").select(F.col("id").alias("node"))
    inside, border = graph.sub_graph(links, nodes)
    one = F.count(F.lit(1)).alias("n")
    return inside.agg(one).select(F.lit("inside").alias("part"), "n").unionByName(border.agg(one).select(F.lit("border").alias("part"), "n"))


@query(f"""
WITH r AS (SELECT o_orderkey AS id, CAST(o_orderkey % 4 AS INTEGER) AS slot, CAST(1 + o_custkey % 2 AS INTEGER) AS hold, unnest([o_custkey % 50, (o_custkey * 3) % 50]) AS link FROM orders),
c AS (SELECT id, link, unnest(range(slot, slot + hold)) AS slot FROM r),
d AS (SELECT link AS link_id, slot, CAST(count(DISTINCT id) AS BIGINT) AS demand FROM c GROUP BY ALL)
SELECT link_id, CAST(slot AS INTEGER) AS slot, demand, demand > 50 * (5 + link_id % 20) AS overload FROM d""")
def slot_demand_overload(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey")
    requests = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 4).cast("int").alias("slot"),
        (1 + c % 2).cast("int").alias("hold"),
        F.array(c % 50, (c * 3) % 50).alias("route"),
    )
    lanes = spark.range(50).select(F.col("id").alias("link_id"), (50 * (5 + F.col("id") % 20)).alias("lanes"))
    return slots.demand(requests, lanes).select("link_id", "slot", "demand", "overload")


def _scenarios(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    requests = table(spark, sf, "orders").select(
        (c % 40).alias("scenario"),
        o.alias("id"),
        F.when(o % 17 == 0, "evac").when(o % 4 == 0, "emergency").otherwise("general").alias("kind"),
        (o % 4).cast("int").alias("slot"),
        (1 + c % 2).cast("int").alias("hold"),
        F.when(o % 29 != 0, F.array(o % 11, (o * 3) % 11)).alias("route"),
        F.array((o * 5) % 11, (o * 7) % 11).alias("alternative"),
    )
    lanes = spark.range(40).select(F.col("id").alias("scenario"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("link_id"))
    return requests, lanes.withColumn("lanes", F.col("link_id") % 5 + 3)


@query()
def slot_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of made-up scenarios; the rules are traced by hand in the tests."""
    requests, lanes = _scenarios(spark, sf)
    return slots.resolve(requests, lanes).select("scenario", "id", "kind", "status", "slot", "delay", "done")


@query()
def delay_ledger(spark: SparkSession, sf: str) -> DataFrame:
    requests, lanes = _scenarios(spark, sf)
    return slots.ledger(slots.resolve(requests, lanes))


@query("""
WITH l AS (SELECT CAST(f * 100 + f + d AS BIGINT) AS link_id, f, f + d AS t FROM range(60) x(f), (VALUES (1), (2), (7)) y(d) WHERE f + d < 60),
n AS (SELECT link_id, f AS node FROM l UNION SELECT link_id, t FROM l),
h1 AS (SELECT DISTINCT b.link_id FROM n a JOIN n b ON a.node = b.node WHERE a.link_id = 1012),
h2 AS (SELECT DISTINCT b.link_id FROM h1 JOIN n a ON a.link_id = h1.link_id JOIN n b ON a.node = b.node)
SELECT h2.link_id, CASE WHEN h2.link_id = 1012 THEN 0 WHEN h1.link_id IS NOT NULL THEN 1 ELSE 2 END AS hop FROM h2 LEFT JOIN h1 ON h1.link_id = h2.link_id""")
def recompute_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Links within two steps of the one that an incident closes."""
    seed = spark.createDataFrame([(1012,)], "link_id long")
    return graph.link_neighbourhood(_grid_links(spark), seed, 2)


@query(f"""
WITH b AS (SELECT doc_id, toxic, unnest(range(0, 200)) AS r FROM labels),
h AS (SELECT r, toxic, ((doc_id % 1000 + 1) * 7919 + (r + 1) * 104729 + (doc_id % 1000 + 1) * (r + 1) * 31) % 1000 AS h FROM b),
m AS (SELECT r, toxic, CASE WHEN h < 368 THEN 0 WHEN h < 736 THEN 1 WHEN h < 920 THEN 2 WHEN h < 981 THEN 3 ELSE 4 END AS m FROM h),
p AS (SELECT r, CAST(sum(m * toxic) AS DOUBLE) / CAST(sum(m) AS DOUBLE) AS rate FROM m GROUP BY r)
SELECT {fx("quantile_cont(rate, 0.025)")} AS low, {fx("quantile_cont(rate, 0.5)")} AS middle, {fx("quantile_cont(rate, 0.975)")} AS high FROM p""")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return learn.bootstrap_rate(table(spark, sf, "labels"), "doc_id", "toxic", 200)


@query(f"""
WITH s AS (SELECT l.doc_id, quality AS y, CAST(n_chars // 50 AS DOUBLE) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
g AS (SELECT s, CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg FROM s GROUP BY s),
c AS (SELECT *, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT CAST(sum(pos) AS BIGINT) AS n_positive, CAST(sum(neg) AS BIGINT) AS n_negative, {fx("sum(pos * tp / (tp + fp)) / sum(pos)")} AS average_precision,
       {fx("sum(neg * (tp - CAST(pos AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))")} AS roc_auc FROM c""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    labels, documents = tables(spark, sf, "labels", "documents")
    s = labels.join(documents.select("doc_id", F.floor(F.col("n_chars") / 50).cast("double").alias("s")), "doc_id")
    return learn.ranking_measures(s, "quality", "s")


@query(f"""
WITH s AS (SELECT l.doc_id, quality AS y, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id ORDER BY n_chars DESC, l.doc_id LIMIT 42)
SELECT CAST(count(*) AS BIGINT) AS k, CAST(sum(y) AS BIGINT) AS hits, {fx("CAST(sum(y) AS DOUBLE) / count(*)")} AS precision FROM s""")
def precision_at_k(spark: SparkSession, sf: str) -> DataFrame:
    labels, documents = tables(spark, sf, "labels", "documents")
    s = labels.join(documents.select("doc_id", "n_chars"), "doc_id")
    return learn.precision_at(s, "quality", "n_chars", "doc_id", 42)


@query(f"""
WITH f AS (SELECT l_partkey, CAST(count(*) AS BIGINT) AS n, min(l_quantity) AS least, max(l_quantity) AS most, max(CASE WHEN l_discount > 0.09 THEN l_tax END) AS tax FROM lineitem GROUP BY 1),
m AS (SELECT median(tax) AS t FROM f)
SELECT l_partkey, n, least, most, {fx("coalesce(tax, t)")} AS tax, CAST(p_size % 3 = 0 AS INTEGER) AS size_0, CAST(p_size % 3 = 1 AS INTEGER) AS size_1 FROM f JOIN part ON l_partkey = p_partkey, m""")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    lines, part = tables(spark, sf, "lineitem", "part")
    f = lines.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("l_quantity").alias("least"),
        F.max("l_quantity").alias("most"),
        F.max(F.when(F.col("l_discount") > 0.09, F.col("l_tax"))).alias("tax"),
    )
    hot = learn.one_hot(F.col("p_size") % 3, [0, 1], "size")
    rows = learn.filled(f, ["tax"]).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_partkey", "n", "least", "most", fixed(F.col("tax")).alias("tax"), *hot)


_TEXT_FEATURES = ["n", "n_lines", "stops", "marks"]


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels, documents = tables(spark, sf, "labels", "documents")
    text = F.coalesce("text", F.lit(""))
    return labels.join(documents, "doc_id").select(
        "doc_id",
        "lang",
        "quality",
        F.length(text).alias("n"),
        F.size(F.split(text, "\n")).alias("n_lines"),
        (F.regexp_count(text, F.lit("[.]")) / (F.length(text) + 1)).alias("stops"),
        (F.regexp_count(text, F.lit("[^\\w\\s]")) / (F.length(text) + 1)).alias("marks"),
    )


@query()
def logo_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold scores of labelled documents, by language."""
    return learn.leave_one_group_out(_labelled(spark, sf), _TEXT_FEATURES, "quality", "lang", "doc_id")


@query()
def logo_forest(spark: SparkSession, sf: str) -> DataFrame:
    """The same by forests of 500 trees a language, each tree balanced on its own sample; trees are compared with ones grown by hand in the tests."""
    rows = Workspace(spark, "logo-forest").table(_labelled(spark, sf), "rows")  # each level reads it
    return learn.leave_one_group_out(rows, _TEXT_FEATURES, "quality", "lang", "doc_id", kind="forest")


@query(f"""
WITH l AS (SELECT o_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n_orders, {n_if("returned > 0")} AS n_returned FROM l""")
def event_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders, lines = tables(spark, sf, "orders", "lineitem")
    returned = lines.groupBy("l_orderkey").agg(count_of(F.col("l_returnflag") == "R").alias("returned"))
    joined = orders.select(F.col("o_orderkey").alias("l_orderkey")).join(returned, "l_orderkey")
    return joined.agg(F.count(F.lit(1)).alias("n_orders"), count_of(F.col("returned") > 0).alias("n_returned"))
