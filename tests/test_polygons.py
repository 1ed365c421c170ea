"""Areas with holes, clipped lines, medial widths and outlines of unions, against small cases and cells by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import polygons

POINT = "struct<x: double, y: double>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def pts(ring):
    return [{"x": float(x), "y": float(y)} for x, y in ring]


AREA = [box(0, 0, 40, 20), box(10, 5, 20, 15), box(50, 0, 60, 20)]  # a hole, and a second part


def test_parity_of_rings(spark):
    cases = {(5, 5): True, (15, 10): False, (55, 1): True, (45, 10): False, (25, 10): True}
    df = spark.createDataFrame([(float(x), float(y), [pts(r) for r in AREA]) for x, y in [*cases, (0, 10), (10, 10)]], f"x double, y double, a array<array<{POINT}>>").coalesce(1)
    x, y, a = F.col("x"), F.col("y"), F.col("a")
    got = df.select(polygons.inside(x, y, a), polygons.contains(x, y, a), polygons.covers(x, y, a)).collect()
    for want, row in zip(cases.values(), got):
        assert tuple(row) == (want,) * 3
    assert [tuple(r)[1:] for r in got[len(cases) :]] == [(False, True)] * 2  # on the outer edge and on the hole's


def stretches(spark, line, area):
    df = spark.createDataFrame([(pts(line), [pts(r) for r in area])], f"l array<{POINT}>, a array<array<{POINT}>>")
    return [(round(s["from"], 9), round(s["to"], 9)) for s in df.select(polygons.inside_stretches(F.col("l"), F.col("a"))).first()[0]]


def test_stretches_of_a_line(spark):
    assert stretches(spark, [(-5, 10), (70, 10)], AREA) == [(5, 15), (25, 45), (55, 65)]
    assert stretches(spark, [(70, 10), (-5, 10)], AREA) == [(10, 20), (30, 50), (60, 70)]
    assert stretches(spark, [(5, 2), (5, 18), (5, 30)], AREA) == [(0, 18)]  # joined at its vertex
    assert stretches(spark, [(-5, 30), (70, 30)], AREA) == [] and stretches(spark, [(1, 1), (1, 1)], AREA) == []
    # through vertices, and a shape that is not convex
    assert stretches(spark, [(-1, 0), (11, 0)], [[(0, 0), (5, 5), (10, 0), (5, -5)]]) == [(1, 11)]
    assert stretches(spark, [(0, 4), (12, 4)], [[(0, 0), (12, 0), (12, 6), (9, 6), (6, 2), (3, 6), (0, 6)]]) == [(0, 4.5), (7.5, 12)]
    assert stretches(spark, [(0, 4), (12, 4)], []) == []


def test_nearest_stretch_and_its_vertices(spark):
    line = [(-5, 10), (30, 10), (30, -10)]
    df = spark.createDataFrame([(pts(line), [pts(r) for r in AREA], 26.0, 11.0)], f"l array<{POINT}>, a array<array<{POINT}>>, x double, y double")
    part = polygons.nearest_stretch(F.col("l"), F.col("a"), F.col("x"), F.col("y"))
    got = df.select(part.alias("p")).select("p", "p.*").first()
    assert (got.d, got["from"], got["to"]) == (1.0, 25.0, 45.0)
    own = df.select(polygons.stretch_of(F.col("l"), part)).first()[0]
    assert [(p.x, p.y) for p in own] == [(20.0, 10.0), (30.0, 10.0), (30.0, 0.0)]


def test_medial_width_and_its_failures(spark):
    line, wall = [(-5, 3), (100, 3)], [(0, 4), (100, 4)]
    areas = [[box(0, 0, 60, 8), box(30, 6, 32, 7)], [], None, [box(0, 20, 60, 30)], [box(0, 0, 13, 8)], [box(0, 0, 14.5, 8)]]
    rows = [(i, pts(line), None if a is None else [pts(r) for r in a], 10.0, 3.0, [pts(wall)]) for i, a in enumerate(areas)]
    df = spark.createDataFrame(rows, f"i int, l array<{POINT}>, a array<array<{POINT}>>, x double, y double, o array<array<{POINT}>>")
    got = {r.i: r for r in polygons.medial_width(df, "l", "a", "x", "y", "o").collect()}
    assert [got[i].status for i in range(6)] == ["ok", "no area", "no area", "not inside", "too short", "ok"]
    r = got[0]
    widths = sorted(2 * min(3, 5, x, 60 - x, math.hypot(max(30 - x, 0, x - 32), 3)) for x in range(2, 59))
    assert r.n_samples == len(widths) == 57
    assert (r.width_least, r.width_p10, r.width_median) == tuple(round(w, 2) for w in (widths[0], widths[4], widths[28]))
    assert (r.deducted_least, r.deducted_median, r.gap_least) == (2.0, 2.0, -2.0)
    assert got[5].n_samples == 11 and got[4].width_least is None


def cells_of(areas):
    """Unit cells that any area covers."""
    out = set()
    for rings in areas:
        for x in range(-5, 60):
            for y in range(-5, 60):
                if sum(min(p[0] for p in r) <= x < max(p[0] for p in r) and min(p[1] for p in r) <= y < max(p[1] for p in r) for r in rings) % 2:
                    out.add((x, y))
    return out


@pytest.mark.parametrize("cell", [3.0, 40.0])
def test_outlines_of_boxes(spark, cell):
    r = random.Random(7)
    rows, want = [], {}
    for k in range(4):
        areas = []
        for _ in range(3 + 4 * k):
            x, y, w, h = r.randrange(30), r.randrange(30), r.randrange(4, 16), r.randrange(4, 16)
            areas.append([box(x, y, x + w, y + h)] + ([box(x + 1, y + 1, x + w - 2, y + 2)] if r.random() < 0.5 else []))
        areas += areas[:1]  # a copy
        rows += [(k, 100 * k + i, [pts(ring if r.random() < 0.5 else ring[::-1]) for ring in a]) for i, a in enumerate(areas)]
        own = cells_of(areas)
        want[k] = (sum((x + dx, y + dy) not in own for x, y in own for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0))), len(own))
    df = spark.createDataFrame(rows, f"k int, id int, a array<array<{POINT}>>").repartition(3)
    got = polygons.outline_measures(polygons.union_outline(df, "k", "id", "a", cell), "k").collect()
    assert {x.k: (round(x.perimeter, 6), round(x.area, 6)) for x in got} == want


def test_outline_of_slanted_shapes(spark):
    star = [[(0, 0), (10, 0), (5, 9)], [(0, 6), (10, 6), (5, -3)]]
    df = spark.createDataFrame([(1, i, [pts(r)]) for i, r in enumerate(star)] + [(2, 9, [pts(star[0])]), (3, 10, []), (4, 11, None)], f"k int, id int, a array<array<{POINT}>>")
    outline = polygons.union_outline(df, "k", "id", "a", 2.5)
    got = {x.k: x for x in polygons.outline_measures(outline, "k").collect()}
    assert set(got) == {1, 2} and got[1].n_edges == 12
    assert abs(got[2].area - 45) < 1e-6 and got[2].n_edges == 3
    # by sampling: the share of a fine grid that either triangle covers
    inside = lambda x, y, t: len({(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(t, t[1:] + t[:1])}) == 1
    n = 200
    hit = sum(any(inside(10 * (i + 0.5) / n, -3 + 12 * (j + 0.5) / n, t) for t in star) for i in range(n) for j in range(n))
    assert abs(got[1].area - 120 * hit / n / n) < 0.3
    # each end is shared by an even number of edges
    ends = outline.filter("k = 1").selectExpr("explode(array(struct(ax AS x, ay AS y), struct(bx AS x, by AS y))) AS p").groupBy("p").count()
    assert {r["count"] % 2 for r in ends.collect()} == {0}


def test_points_in_areas(spark):
    areas = spark.createDataFrame([("a", [pts(r) for r in AREA]), ("b", [pts(box(5, 5, 25, 12))])], f"name string, rings array<array<{POINT}>>")
    at = spark.createDataFrame([(1, 15.0, 10.0), (2, 55.0, 1.0), (3, 45.0, 10.0), (4, 22.0, 6.0), (5, float("inf"), 1.0), (6, None, 1.0)], "i int, x double, y double")
    got = polygons.assign_to_areas(at, areas, "x", "y", "rings", 7.0).collect()
    assert sorted((r.i, r.name or "") for r in got) == [(1, "b"), (2, "a"), (3, ""), (4, "a"), (4, "b"), (5, ""), (6, "")]


def test_an_area_meets_only_pieces_from_its_beginning_on(spark, monkeypatch):
    """Boxes of one column, far apart and some of them twice: an edge is not measured against the pieces of all others."""
    from wayfold.workspace import Workspace

    kept, was = {}, Workspace.table

    def table(self, df, name, *a, **more):
        kept[name] = was(self, df, name, *a, **more)
        return kept[name]

    monkeypatch.setattr(Workspace, "table", table)
    box = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    rows = [(i, 1, [[(x, y + 100.0 * (i // 2)) for x, y in ring] for ring in box]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, k int, a array<array<struct<x: double, y: double>>>")
    got = polygons.outline_measures(polygons.union_outline(df, "k", "id", "a", 4.0), "k").collect()
    assert [tuple(r) for r in got] == [(1, 40, 160.0, 160.0)]
    assert kept["edges"].count() == 40 and {"lowx", "lowy"} <= set(kept["edges"].columns)
