"""Operators against brute force and hand-traced cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions.numbers import fixed
from wayfold.operators import dedup, graph, learn, polyline, profile, setrates, slots, spatial, sweep, timeseries


def line(*xy):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy))


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("k", "n", "want"), [(41, 42, (0.8768, 0.9958)), (2312, 2922, (0.7761, 0.8056)), (33336, 152944, (0.2159, 0.22)), (36, 36, (0.9036, 1.0))])
def test_published_wilson_intervals(spark, k, n, want):
    got = one(spark, *map(fixed, setrates.wilson(F.lit(k), F.lit(n))))
    assert all(abs(a - b) < 1e-4 for a, b in zip(got, want))


def test_wilson_of_nothing(spark):
    assert one(spark, *setrates.wilson(F.lit(0), F.lit(0))) == (None, None)


def test_published_fisher_tails(spark):
    got = setrates.fisher(spark.createDataFrame([(41, 1, 2312, 610)], "a long, b long, c long, d long")).first()
    assert abs(got.p_upper - 0.00069) < 2e-6 and abs(got.p_lower - 0.999943) < 2e-6 and got.verdict == "higher"


def test_log_factorials(spark):
    for n in (0, 1, 5, 39, 40, 41, 200, 100_000):
        assert math.isclose(one(spark, setrates.log_factorial(F.lit(n)))[0], math.lgamma(n + 1), rel_tol=1e-12, abs_tol=1e-12)


def test_keyless_rows_stay(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, None, "c"), (1, None, "c"), (None, 2, "d")], "k long, i long, v string")
    assert sorted(r.v for r in dedup.keyed_dedup(df, ["k", "i"], [F.col("v")]).collect()) == ["a", "c", "c", "d"]
    assert sorted(r.v for r in dedup.keyed_dedup(df, ["k", "i"], [F.col("v")], last=True).collect()) == ["b", "c", "c", "d"]


def test_nearest_in_empty_regions(spark):
    r = random.Random(2)
    a = [(i, r.uniform(0, 50), r.uniform(0, 50)) for i in range(40)] + [(99, 5000.0, -3000.0), (98, None, 1.0)]
    b = [(i, r.uniform(0, 50), r.uniform(0, 50)) for i in range(15)]
    left, right = spark.createDataFrame(a, "l long, ax double, ay double"), spark.createDataFrame(b, "r long, bx double, by double")
    got = sorted((x.l, x.r, x.place) for x in spatial.nearest(left, right, "l", "r", 3.0, k=2).collect())
    want = []
    for i, x, y in a:
        if x is not None:
            best = sorted((math.dist((x, y), (u, v)), j) for j, u, v in b)[:2]
            want += [(i, j, p + 1) for p, (_, j) in enumerate(best)]
    assert got == sorted(want)
    assert spatial.nearest(left, right.filter("false"), "l", "r", 3.0).count() == 0


def test_fewer_partners_than_wanted(spark):
    left, right = spark.createDataFrame([(1, 0.0, 0.0)], "l long, ax double, ay double"), spark.createDataFrame([(2, 9.0, 0.0)], "r long, bx double, by double")
    assert [(x.r, x.d) for x in spatial.nearest(left, right, "l", "r", 1.0, k=3).collect()] == [(2, 9.0)]


def test_lines(spark):
    l = line((0, 0), (10, 0), (10, 10))
    at = [polyline.at_distance(l, F.lit(d)) for d in (0.0, 5.0, 10.0, 15.0, 99.0)]
    got = one(spark, polyline.length(l), *at, polyline.nearest_on_line(F.lit(3.0), F.lit(4.0), l)["d"], polyline.length(line((1, 1))))
    assert got[0] == 20.0 and [tuple(p) for p in got[1:6]] == [(0, 0), (5, 0), (10, 0), (10, 5), (10, 10)] and got[6:] == (4.0, 0.0)


def brute_radius(pts, step=10.0):
    seg = [math.dist(a, b) for a, b in zip(pts, pts[1:])]
    total = sum(seg)
    if total < 20:
        return None

    def at(d):
        for (a, b), n in zip(zip(pts, pts[1:]), seg):
            if d <= n and n > 0:
                return a[0] + d / n * (b[0] - a[0]), a[1] + d / n * (b[1] - a[1])
            d -= n
        return pts[-1]

    n = math.floor(total / step)
    s = [at(i * step) for i in range(n + 1)]
    if total - n * step > 1e-9:
        s.append(pts[-1])
    out = math.inf
    for a, b, c in zip(s, s[1:], s[2:]):
        cross = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
        if cross > 1e-9:
            out = min(out, math.dist(a, b) * math.dist(b, c) * math.dist(a, c) / (2 * cross))
    return out


def test_least_radius(spark):
    r = random.Random(4)
    shapes = [[(0, 0), (5, 5)], [(0, 0), (100, 0)], [(0, 0), (30, 0), (30, 40)]] + [[(r.uniform(0, 60), r.uniform(0, 60)) for _ in range(6)] for _ in range(8)]
    df = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in s]) for i, s in enumerate(shapes)], "i int, line array<struct<x: double, y: double>>")
    for row in df.select("i", polyline.least_radius(F.col("line")).alias("r")).collect():
        want = brute_radius(shapes[row.i])
        assert (row.r is None) == (want is None)
        if want is not None:
            assert row.r == want or math.isclose(row.r, want, rel_tol=1e-6)


def test_angles(spark):
    f = [F.lit(float(x)) for x in (1, 0, 0, 1, -1, 0)]
    got = one(spark, polyline.angle(f[0], f[1], f[2], f[3]), polyline.angle(f[0], f[1], f[4], f[5]), polyline.angle(f[1], f[1], f[0], f[1]), polyline.angle(f[1], f[1], f[0], f[1], 0.0))
    assert got == (90.0, 180.0, None, 0.0)


def test_turns(spark):
    rows = [(1, 0, 1, "a", 1.0, 0.0, 1.0, 0.0), (2, 1, 2, "b", 0.0, 1.0, 0.0, 1.0), (3, 1, 0, "c", -1.0, 0.0, -1.0, 0.0), (4, 1, 5, "a", -1.0, 0.1, 1.0, 0.0), (5, 1, 6, None, 1.0, 0.0, 1.0, 0.0)]
    links = spark.createDataFrame(rows, "link_id long, f_node long, t_node long, name string, first_dx double, first_dy double, last_dx double, last_dy double")
    bans = spark.createDataFrame([(1, 2)], "st_link long, ed_link long")
    got = {(r.a_link_id, r.b_link_id): (r.sharp, r.listed) for r in polyline.turn_moves(links, bans).collect()}
    # 3 goes straight back (as 1 does after 3), 4 turns round on the same name
    assert got == {(1, 2): (True, True), (1, 5): (False, False)}


def test_medial_with_obstacle(spark):
    df = spark.range(1).select(line((0, 2), (20, 2)).alias("l"), line((0, 0), (20, 0), (20, 4), (0, 4)).alias("r"), F.array(line((9, 3), (11, 3))).alias("o"))
    rows = {r.chainage: (r.width, r.deducted) for r in polyline.medial_samples(df, "l", "r", "o").collect()}
    assert len(rows) == 17 and rows[10.0] == (4.0, 2.0) and rows[2.0] == (4.0, 4.0)
    inside = spark.range(1).select(line((0, 2), (20, 2)).alias("l"), line((-1, 0), (9.5, 0), (9.5, 4), (-1, 4)).alias("r"))
    assert inside.select(polyline.coverage(inside, "l", "r")).first()[0] == pytest.approx(10 / 21)


def test_transect(spark):
    def wall(y, x0=-1.0, x1=1.0):
        return F.struct(F.struct(F.lit(x0).alias("x"), F.lit(y).alias("y")).alias("a"), F.struct(F.lit(x1).alias("x"), F.lit(y).alias("y")).alias("b"))

    z, e = F.lit(0.0), F.lit(1.0)
    both, single, far = F.array(wall(3.0), wall(-2.0), wall(5.0)), F.array(wall(3.0)), F.array(wall(3.0), wall(-16.0))
    assert one(spark, *(polyline.transect_gap(z, z, e, z, w) for w in (both, single, far))) == (5.0, None, None)
    assert one(spark, polyline.lateral_span(line((0, -1), (5, 3), (9, 0)), e, z)) == (4.0,)


def test_order_statistics_agree(spark):
    r = random.Random(6)
    rows = [(k, float(r.randrange(9))) for k in range(5) for _ in range(r.randrange(1, 40))]
    df = spark.createDataFrame(rows, "k int, v double")
    a, b = (sorted(map(tuple, profile.order_statistics(df, ["k"], "v", hot=h).collect())) for h in (False, True))
    assert a == b
    for k, n, least, p10, median in a:
        s = sorted(v for kk, v in rows if kk == k)
        assert (n, least, p10, median) == (len(s), s[0], s[max(0, int(0.1 * len(s)) - 1)], s[len(s) // 2])


def test_running_sums(spark):
    r = random.Random(1)
    vals = sorted({r.randrange(1000) for _ in range(300)})
    df = spark.createDataFrame([(v, 1 + v % 3) for v in vals], "s long, p long")
    got = {x.s: x.cum_p for x in learn.running(df, "s", ["p"], parts=7).collect()}
    assert got == {v: sum(1 + u % 3 for u in vals if u >= v) for v in vals}


def test_perfect_ranking(spark):
    df = spark.createDataFrame([(i, int(i > 6), float(i)) for i in range(10)], "k long, y int, s double")
    assert tuple(learn.ranking_measures(df, "y", "s").first()) == (3, 7, 1.0, 1.0)
    assert tuple(learn.ranking_measures(df.withColumn("s", F.lit(1.0)), "y", "s").first()) == (3, 7, 0.3, 0.5)


def test_permutation_importance(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2), float(i)) for i in range(60)], "k long, y int, a double, b double")
    got = {r.column: r.loss_roc_auc for r in learn.permutation_importance(df, ["a", "b"], "k", lambda d: d.withColumn("score", F.col("a") + F.col("b") * 0), "y", repeats=2).collect()}
    assert got["a"] > 0.2 and got["b"] == 0


def test_forest_by_group(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], int(i % 5 < 2), float(i % 5)) for i in range(80)], "k long, g string, y int, x double")
    got = learn.leave_one_group_out(df, ["x"], "y", "g", "k", kind="forest", trees=20)
    assert got.count() == 80 and learn.ranking_measures(got, "label", "score").first().roc_auc == 1.0


def test_greedy_removal_depends_on_order(spark):
    df = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4), (7, 1, 2)], "n long, i long, j long")
    assert sorted(map(tuple, graph.greedy_removal(df, ["n"]).select("n", "id").collect())) == [(0, 2), (0, 4), (7, 2)]


def request(i, kind, slot, hold, route, alternative=None):
    return {"id": i, "kind": kind, "slot": slot, "hold": hold, "route": route, "alternative": alternative}


def test_resolution_traced_by_hand():
    lanes = {1: 1, 2: 2, 3: 1}
    got = {
        d["id"]: (d["status"], d["delay"])
        for d in slots.resolve_one(
            [
                request(5, "general", 0, 1, [2]),
                request(1, "emergency", 0, 2, [1]),
                request(2, "emergency", 0, 1, [1], [3]),
                request(3, "emergency", 0, 1, [1], [3]),
                request(9, "evac", 0, 3, [2]),
                request(6, "general", 1, 1, [2]),
                request(7, "general", 0, 1, None),
                request(8, "emergency", 5, 2, [1]),
            ],
            lanes,
        )
    }
    # 9 takes link 2 in slots 0-2; 2 goes round by 3; 3 waits for link 1; 5 would have to wait beyond two slots; 6 waits two
    assert got == {9: ("confirmed", 0), 1: ("confirmed", 0), 2: ("rerouted", 0), 3: ("delayed", 2), 8: ("unresolved", 0), 5: ("advice", 0), 6: ("delayed", 2), 7: ("unresolved", 0)}


def test_staging_traced_by_hand():
    free = {(link, s): n for link, n in ((1, 2), (2, 3), (3, 9)) for s in range(3)} | {(1, 0): 1}
    # link 1 has no spare lane in slot 0; link 2 takes two; then 1 takes one from slot 1
    assert slots.stage_vehicles([(1, 2), (2, 3)], free, 2) == [(0, 2), (0, 2), (1, 1)]
    assert slots.stage_vehicles([(1, 2), (2, 3)], free, 2, keep=(2,)) == [(1, 1)]


def test_general_requests_under_observed_capacity():
    got = slots.place_general(
        [request(2, "general", 0, 1, [1]), request(1, "general", 0, 1, [1]), request(3, "general", 0, 1, [1]), request(4, "general", 0, 1, [1])],
        {1: 1},
        {(1, 1): 0},
        {},
    )
    # slot 1 is shut by observation: 1 at once, 2 two late, the others not
    assert [(d["id"], d["status"], d["delay"]) for d in got] == [(1, "confirmed", 0), (2, "delayed", 2), (3, "unresolved", 0), (4, "unresolved", 0)]


def test_staging_candidates_in_order(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (4, 2)], "link_id long, lanes int")
    reach = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "link_id long, hop int")
    water = spark.createDataFrame([(1, 5.0), (3, 5.0)], "link_id long, d double")
    assert [r.link_id for r in slots.staging_candidates(links, reach, water).collect()] == [3, 1, 4]


def test_affected_decisions(spark):
    rows = [(1, 1, True, 0, 2, [5]), (1, 2, True, 2, 1, [5]), (1, 3, True, 3, 1, [6]), (1, 4, False, 3, 1, [5])]
    done = spark.createDataFrame(rows, "scenario long, id long, done boolean, slot int, hold int, route array<long>")
    got = {r.id: r.again for r in slots.affected(done, spark.createDataFrame([(5,)], "link_id long"), 2).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_capacity_states_and_first_free(spark):
    assert one(spark, *slots.cell_state(F.lit(3), F.lit(0), F.lit(2)), *slots.cell_state(F.lit(2), F.lit(1), F.lit(2))) == (True, True, False, True)
    got = [one(spark, slots.evacuation_slots(F.lit(x)))[0] for x in (0.0, 0.25, 0.75, 1.25, 9.0)]
    assert got == [1, 1, 2, 2, 5]
    cells = spark.createDataFrame([(1, s, int(s != 1)) for s in range(6)] + [(2, s, 1) for s in range(6)], "link_id long, slot int, free int")
    ways = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3)], "actor string, link_id long")
    assert {r.actor: r.slot for r in slots.first_free(cells, ways, 2, 5).collect()} == {"a": 2, "b": 0, "c": None}


def test_routes_with_bans(spark):
    links = spark.createDataFrame([(1, 0, 1, 1), (2, 1, 2, 1), (3, 0, 3, 5), (4, 3, 2, 1), (5, 2, 9, 1)], "link_id long, f_node long, t_node long, cost long")
    start = spark.createDataFrame([(0,)], "node long")
    free = graph.routes(links, start)
    assert graph.path_to(free, 5) == [1, 2, 5]
    bans = spark.createDataFrame([(1, 2)], "st_link long, ed_link long")
    banned = graph.routes(links, start, bans)
    assert graph.path_to(banned, 5) == [3, 4, 5] and banned.filter("link_id = 2").isEmpty()
    assert graph.farthest(banned, "cost", "link_id").first().link_id == 5
    assert graph.release(bans, free).isEmpty()


def test_names_within_one_edit(spark):
    a, b = spark.createDataFrame([("abc",), ("xyz",), ("",)], "n string"), spark.createDataFrame([("abd",), ("abcd",), ("q",)], "m string")
    assert {r.n: r.near for r in setrates.near_name(a, "n", b, "m").collect()} == {"abc": True, "xyz": False, "": True}


def test_sweep_rules(spark):
    df = spark.createDataFrame([(10.0, 5.0, 2.0, 0.7), (2.9, 5.0, 2.0, 0.7), (10.0, 5.0, 0.0, 0.7), (10.0, 5.0, 2.0, None)], "A double, L double, S double, R double")
    assert [r[0] for r in df.coalesce(1).select(sweep.VehicleOutline().met()).collect()] == [True, False, False, False]
    settings = sweep.outline_settings()
    assert len(settings) == 10 and settings["fill x0.9"] == sweep.VehicleOutline(least_fill=0.9 * 0.62)
    wide = settings["width x1.1"]
    assert (wide.least_width, wide.most_width, wide.most_length) == (1.1 * 1.4, 1.1 * 2.8, 7.5)
    rows = spark.createDataFrame([(2.9, 5.0, 2.0, 0.7, False), (10.0, 5.0, 2.0, 0.7, False)], "A double, L double, S double, R double, flag boolean")
    swept = {r.setting: (r.n_spec, r.n_changed) for r in sweep.vehicle_sweep(rows, "flag").collect()}
    assert swept["base"] == (0, 0) and swept["area x0.9"] == (1, 1) and swept["fill x1.1"] == (0, 0)
    assert one(spark, sweep.flipped(F.lit(True), F.lit(True), F.lit(False)), sweep.flipped(F.lit(False), F.lit(True), F.lit(True))) == (False, False)


def test_dates(spark):
    got = one(spark, timeseries.date_of(F.lit("20240105")).cast("string"), timeseries.date_of(F.lit("2024-01-06")).cast("string"), timeseries.is_weekday(timeseries.date_of(F.lit("20240105"))), timeseries.is_weekday(timeseries.date_of(F.lit("2024-01-06"))), timeseries.minute_of_day(F.lit("2015")))
    assert got == ("2024-01-05", "2024-01-06", True, False, 1215)


def test_line_joins_of_odd_lines(spark):
    from wayfold.operators import line_joins

    shape = "array<struct<x: double, y: double>>"
    left = spark.createDataFrame([(1, [(0.0, 0.0), (500.0, 500.0)]), (2, [(900.0, 0.0)]), (3, None), (4, []), (5, [(None, 1.0), (2.0, 2.0)])], f"l long, line {shape}")
    right = spark.createDataFrame([(1, [(0.0, 500.0), (500.0, 0.0)]), (2, [(900.0, 7.0), (900.0, 7.0)]), (3, None)], f"r long, other {shape}")
    got = {tuple(r) for r in line_joins.lines_within(left, right, "l", "r", 10.0).collect()}
    assert got == {(1, 1, 0.0), (2, 2, 7.0)}  # the crossing lines have no end near the other
    got = {(r.l, r.r): r.place for r in line_joins.nearest_lines(left, right, "l", "r", 10.0, k=2).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 2): 1, (2, 1): 2}
    flags = line_joins.line_flags(left, right, "l", "r", 10.0, {"one": F.col("r") == 1}).collect()
    assert {r.l: r.one for r in flags} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert line_joins.lines_within(left.filter("l > 2"), right, "l", "r", 10.0).count() == 0
    with pytest.raises(ValueError):
        line_joins.lines_within(left, right, "l", "r", 0.0)


def test_samples_lie_in_their_ring(spark):
    from wayfold.operators import spatial

    df = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)]), (2, []), (3, None)], "k long, ring array<struct<x: double, y: double>>")
    got = {r.k: r.s for r in df.select("k", spatial.sample_in_ring(F.col("ring"), F.col("k")).alias("s")).collect()}
    assert len(got[1]) == 40 and all(p.x + p.y <= 10 for p in got[1]) and got[2] == [] and not got[3]
