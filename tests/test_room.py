"""Room along lines in arrays: as by Spark's functions of lists, and in time."""

import random
import time

from pyspark.sql import functions as F

from wayfold.operators import polygons, room

LINE = "array<struct<x: double, y: double>>"


def shapes():
    r, rows = random.Random(5), []

    def place(i):
        return (r.uniform(0, 40), r.uniform(0, 40)) if i % 2 else (float(r.randint(0, 40)), float(r.randint(0, 40)))

    for i in range(150):
        line = [place(i) for _ in range(r.choice([0, 1, 2, 2, 3, 5, 9]))]
        rings = [[place(i) for _ in range(r.choice([0, 1, 2, 3, 4, 7]))] for _ in range(r.choice([0, 1, 1, 2, 3]))]
        walls = [[place(i) for _ in range(r.choice([0, 1, 2, 3]))] for _ in range(r.choice([0, 1, 2]))]
        rows.append([i, line + line[-1:], rings, *place(i), walls])
    path, square, wall = [(-5.0, 3.0), (20.0, 3.0), (90.0, 3.5)], [(0.0, 0.0), (50.0, 0.0), (50.0, 8.0), (0.0, 8.0)], [(0.0, 4.0), (90.0, 4.0)]
    hole = [(20.0, 5.0), (22.0, 5.0), (22.0, 6.0)]
    for line, rings, x, walls in [
        (path, [square, hole], 7.0, [wall]),
        (path[::-1], [square[::-1]], 7.0, []),
        (None, [square], 7.0, [wall]),
        (path, None, 7.0, [wall]),
        (path, [square, None], 7.0, [wall]),
        (path, [square, [(None, 1.0), (2.0, 2.0)]], 7.0, [wall]),
        (path, [square], None, [wall]),
        (path, [square], float("nan"), [wall]),
        (path, [square], 7.0, None),
        (path, [square], 7.0, [wall, [(float("inf"), 1.0), (2.0, 2.0)]]),
        (path, [square], 7.0, [[None, (1.0, 1.0)]]),
    ]:
        rows.append([len(rows), line, rings, x, 3.0, walls])
    return rows


def test_arrays_round_as_functions_of_lists(spark, monkeypatch):
    df = spark.createDataFrame(shapes(), f"i int, l {LINE}, a array<{LINE}>, x double, y double, o array<{LINE}>").repartition(2)
    monkeypatch.setattr(room, "SAMPLES", 64)

    def rows():
        return {r.i: repr(tuple(r)[-11:]) for r in polygons.medial_width(df, "l", "a", "x", "y", "o").collect()}

    got = rows()
    assert sum("'ok'" in r for r in got.values()) > 10
    fields = ", ".join(f"{f}{k}: double" for f in room.FIELDS for k in range(3))
    monkeypatch.setattr(polygons, "_rooms", lambda *_: F.lit(None).cast(f"struct<status: string, n: int, {fields}>"))
    assert rows() == got


def test_medial_widths_in_time(spark):
    """20,000 rows, which Spark's functions of lists took more than half a minute for; shapes are made after rows are dealt."""
    from wayfold.plans import QUERIES

    start = time.time()
    got = QUERIES["medial_widths"](spark, "/root/testdata/sf0.1")
    got.write.format("noop").mode("overwrite").save()
    assert time.time() - start < 30
    dealt = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x]
    below = got._jdf.queryExecution().optimizedPlan().toString().split(dealt[0])[1]
    assert len(dealt) == 1 and "array" not in below
