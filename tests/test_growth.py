"""Steps whose work must not grow with the square of the tables, against their plain forms."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from wayfold.operators import forest, graph, polyline, ranking, slots, spatial
from wayfold.streaming import incidents

LINKS = "link_id long, f_node long, t_node long, name string, first_dx double, first_dy double, last_dx double, last_dy double"


def test_census_counts_what_the_list_of_moves_holds(spark):
    r = random.Random(3)

    def end():
        return (None, None) if r.random() < 0.05 else (float(r.randrange(-3, 4)), float(r.randrange(-3, 4)))

    rows = [(i, r.choice([*range(5), None]), r.choice([*range(5), None]), r.choice("abc") if r.random() < 0.9 else None, *end(), *end()) for i in range(400)]
    links = spark.createDataFrame(rows, LINKS).repartition(3)
    theta = F.col("theta")
    listed = polyline.turn_moves(links).groupBy(F.col("a_t_node").alias("node")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("theta").alias("turned"),
        *(F.count(F.when(theta < x, 1)).alias(f"u{x}") for x in (30, 60)),
        F.count(F.when(theta.isNotNull() & ~F.col("sharp"), 1)).alias("u90"),
        *(F.count(F.when(theta < x, 1)).alias(f"u{x}") for x in (120, 150)),
    )
    assert sorted(map(tuple, polyline.turn_census(links).filter("n > 0").collect())) == sorted(map(tuple, listed.collect()))


def test_census_of_a_node_with_very_many_links(spark):
    n = 100_000  # ten thousand million moves
    ones = [F.lit(x).alias(c) for c, x in (("first_dx", 1.0), ("first_dy", 0.0), ("last_dx", 0.0), ("last_dy", 1.0))]
    come = spark.range(n).select("id", (F.col("id") + 10).alias("f_node"), F.lit(0).cast("long").alias("t_node"), F.concat(F.lit("a"), "id").alias("name"), *ones)
    leave = spark.range(n).select("id", F.lit(0).cast("long").alias("f_node"), (-F.col("id") - 10).alias("t_node"), F.concat(F.lit("b"), "id").alias("name"), *ones)
    got = polyline.turn_census(come.unionByName(leave)).filter("node = 0").first()
    assert (got.n, got.turned, got.under_90, got.under_120) == (n * n, n * n, 0, n * n)


def test_removal_near_is_that_of_the_pairs(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(2), float(r.randrange(4)), float(r.randrange(4)), r.randrange(-2, 3), r.choice([-1, 0, 1, 2, None])) for i in range(300)]
    rows += [(300, 0, float("nan"), 0.0, 1, 1), (301, 0, None, 0.0, -1, -1), (302, None, 0.0, 0.0, 1, 1)]
    points = spark.createDataFrame(r.sample(rows, len(rows)), "id long, g long, x double, y double, u long, v long").repartition(3)
    a = points.selectExpr("g", "id AS i", "x AS ax", "y AS ay", "u AS au", "v AS av")
    b = points.selectExpr("g", "id AS j", "x AS bx", "y AS by", "u AS bu", "v AS bv")
    pairs = spatial.within(a, b, 1.5, keys=["g"]).filter("i < j AND au * bu + av * bv < 0")
    want = sorted((x.g, x.id) for x in graph.greedy_removal(pairs, ["g"]).collect())
    got = graph.greedy_removal_near(points, "id", "x", "y", ["g"], ["u", "v"], 1.5, "a_u * b_u + a_v * b_v < 0")
    assert sorted((x.g, x.id) for x in got.collect()) == want
    assert graph.greedy_removal_near(points.limit(0), "id", "x", "y", ["g"], ["u", "v"], 1.5, "a_u * b_u < 0").count() == 0


def test_removal_near_lists_no_pairs(spark):
    # 400 million pairs of rivals at one place
    points = spark.range(40_000).select("id", F.lit(0).alias("g"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (1 - F.col("id") % 2 * 2).alias("u"))
    got = graph.greedy_removal_near(points, "id", "x", "y", ["g"], ["u"], 1.0, "a_u * b_u < 0")
    assert got.count() == 20_000 and got.filter("id % 2 = 0").count() == 0


class _Store:
    """A handle whose one value counts how often it is asked for and written."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, ms):
        self.timers.append(ms)


def test_a_batch_of_a_key_asks_its_state_once(spark):
    store, job = _Store(), incidents.Recompute(1000)
    job.init(store)
    rows = [Row(at=i * 1000, ts=None, kind="incident" if i % 10 == 9 else "decision", id=i, slot=0, hold=2, links=[i % 3]) for i in range(100)]
    for part in (rows[:50], rows[50:]):
        out = list(job.handleInputRows((1,), iter(part), None))
    assert store.calls == ["get", "update"] * 2 and store.timers == [1049]
    assert len(out) == sum(1 for i in range(59, 100, 10) for d in range(i) if d % 10 != 9 and d % 3 == i % 3)


def test_a_scenario_passes_in_order_and_is_not_gathered(spark):
    r = random.Random(5)
    rows = [(i % 3, i, r.choice([*slots.KINDS, None]), r.randrange(4), 1 + r.randrange(2), r.choice([None, [], [r.randrange(4), r.randrange(4)]]), [r.randrange(4)]) for i in range(300)]
    requests = spark.createDataFrame(rows, "scenario long, id long, kind string, slot int, hold int, route array<long>, alternative array<long>").repartition(5)
    lanes = spark.createDataFrame([(s, k, 1 + k) for s in (0, 1, 7) for k in range(4)], "scenario long, link_id long, lanes long")
    names = ["id", "kind", "slot", "hold", "route", "alternative"]
    want = [(s, *d.values()) for s in (0, 1) for d in slots.resolve_one([dict(zip(names, x[1:])) for x in rows if x[0] == s], {k: 1 + k for k in range(4)})]
    resolved = slots.resolve(requests, lanes)
    assert sorted(map(repr, map(tuple, resolved.collect()))) == sorted(map(repr, want))
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


def test_decisions_need_no_list_of_requests():
    endless = ({"id": i, "kind": "general", "slot": 0, "hold": 1, "route": [0], "alternative": None} for i in itertools.count())
    assert [d["status"] for d in itertools.islice(slots.decisions(endless, {0: 2}), 8)] == ["confirmed"] * 2 + ["delayed"] * 4 + ["advice"] * 2


def test_radius_of_resampled_lines_is_that_of_the_points(spark):
    r = random.Random(6)
    lines = [[{"x": 10.0 * i, "y": float(r.randrange(300))} for i in range(r.randrange(1, 12))] for _ in range(40)]
    lines += [[], None, [{"x": 0.0, "y": 0.0}] * 3, [{"x": 0.0, "y": 0.0}, {"x": None, "y": 0.0}, {"x": 50.0, "y": 0.0}], [{"x": 0.0, "y": 0.0}, {"x": 20.0, "y": 0.0}]]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line array<struct<x: double, y: double>>").repartition(2)
    line = F.col("line")
    plain = F.when(polyline.length(line) >= 20, F.transform(F.array(polyline.resample(line, 10.0)), polyline.least_radius_of)[0])  # points made once
    for row in df.select("i", polyline.least_radius(line).alias("got"), plain.alias("want")).collect():
        assert (row.got is None) == (row.want is None) and (row.got is None or row.got == row.want or math.isclose(row.got, row.want, rel_tol=1e-9)), row


def test_radius_of_a_line_of_many_vertices(spark):
    # twenty thousand points of two thousand segments
    line = F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: F.struct((i * 100).cast("double").alias("x"), (i % 2 * 40).cast("double").alias("y")))
    got = spark.range(40).select(line.alias("line")).select(polyline.least_radius(F.col("line")).alias("r"))
    assert got.filter("r > 4 AND r < 20").count() == 40


def test_a_forest_follows_only_rows_that_count(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], int(a + b > 1), float(a), float(b)) for i, (a, b) in enumerate(rng.random((300, 2)))]
    df = spark.createDataFrame(rows, "k long, g string, y int, a double, b double")
    model = forest.fit(df, ["a", "b"], "y", "k", "g", trees=5, depth=3)
    bins, trees = model.bins(np.array([x[3:] for x in rows])), slice(2, 9)
    whole = model.nodes(bins, trees)
    m = ranking.draws(np.arange(300), 7, 2)
    row, tree = np.nonzero(m)
    row, tree, n, node = model.members(bins, trees, row, tree, m[row, tree], 3)
    at_last = (whole >= 7) & (m > 0)
    assert sorted(zip(row, tree)) == sorted(zip(*np.nonzero(at_last))) and len(row)
    assert (node == whole[row, tree]).all() and (n == m[row, tree]).all()
    # the last level has leaves only, each with its classes
    assert (model.feature[:, 7:] == -1).all() and not np.isnan(model.value).any()
