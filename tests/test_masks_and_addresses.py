"""Outlines, clipping, address lists and shapefiles."""

import math
import random
import struct

from pyspark.sql import functions as F

from wayfold.functions import address
from wayfold.operators import masks
from wayfold.sources.shapefile import read_shapefile


def test_smallest_rectangles_by_turning():
    r = random.Random(1)
    for _ in range(20):
        pts = [(r.uniform(0, 10), r.uniform(0, 4)) for _ in range(12)]
        long, short = masks.smallest_rectangle(pts)
        best = math.inf
        for k in range(0, 1800):
            a = math.radians(k / 10)
            u = [x * math.cos(a) + y * math.sin(a) for x, y in pts]
            v = [y * math.cos(a) - x * math.sin(a) for x, y in pts]
            best = min(best, (max(u) - min(u)) * (max(v) - min(v)))
        assert long * short <= best + 1e-9 and best <= long * short * 1.02


def test_rectangle_column(spark):
    ddl = "k int, o array<struct<x: double, y: double>>"
    rows = [(1, [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]), (2, [{"x": 0.0, "y": 0.0}]), (3, None)]
    got = {r.k: r.r for r in spark.createDataFrame(rows, ddl).select("k", masks.rectangle_of("o").alias("r")).collect()}
    assert tuple(got[1]) == (8.0, 4.0, 2.0, 1.0)
    assert all(got[k] is None or got[k].A is None for k in (2, 3))


def test_runs(spark):
    cells = spark.createDataFrame([(1, 0, p) for p in (1, 2, 3, 5, 6)] + [(1, 1, p) for p in (4, 5)], "k int, col int, pos int")
    assert sorted((r.col, r.run) for r in masks.runs(cells, ["k"], "col", "pos").collect()) == [(0, 3), (1, 2)]
    assert masks.run_width(cells, ["k"], "col", "pos", 2).first().width == 2.5
    assert masks.run_width(cells, ["k"], "col", "pos", 5).first().width is None


def test_clipping(spark):
    def p(x, y):
        return F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))

    ring = F.array(p(0, 0), p(4, 0), p(4, 4), p(0, 4))
    cases = [((-2, 2), (6, 2)), ((1, 1), (2, 2)), ((5, 5), (9, 9)), ((-1, 5), (5, 5)), ((-4, -4), (4, 4))]
    got = spark.range(1).select(*(masks.clip_convex(p(*a), p(*b), ring).alias(f"c{i}") for i, (a, b) in enumerate(cases))).first()
    assert [None if g is None else tuple(g) for g in got] == [(0.25, 0.75), (0.0, 1.0), None, None, (0.5, 1.0)]


def test_sharpness(spark):
    df = spark.createDataFrame([(1, 18, 0.0), (1, 18, 2.0), (1, 19, 0.0), (1, 19, 4.0)], "k int, z int, v double")
    assert masks.sharpness_gain(df, ["k"], "z", "v", 18, 19).first().gain == 4.0


def test_address_lists(spark):
    rows = [(1, "서구 둔산로 12번길~34번길 일원"), (2, "한밭로 5번길(구도로), 대흥로/7번길"), (3, None), (4, "3번길")]
    df = spark.createDataFrame(rows, "k long, a string")
    got = {}
    for r in address.pieces(df, "k", "a").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.piece)
    assert got == {1: ["둔산로12번길", "둔산로34번길"], 2: ["한밭로5번길", "대흥로", "대흥로7번길"], 4: ["3번길"]}
    one = spark.range(1).select(
        address.kind(F.lit("용두동 12-3")), address.kind(F.lit("용두로")), address.accepted(F.lit("한밭로"), F.lit("대전 중구 한밭로 12")), address.accepted(F.lit("한밭로"), F.lit("대전 중구 대흥로 1")), address.elapsed_verdict(F.lit(39.2)), address.elapsed_verdict(F.lit(301.0))
    ).first()
    assert tuple(one) == ("parcel", "road", True, False, "usable", "too slow")


def shp(records):
    out = b"\0" * 100
    for i, body in enumerate(records, 1):
        out += struct.pack(">2i", i, len(body) // 2) + body
    return out


def dbf(fields, rows, encoding):
    size = 1 + sum(w for _, w in fields)
    head = 33 + 32 * len(fields)
    out = bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(rows), head, size) + b"\0" * 20
    for name, w in fields:
        out += name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15
    out += b"\r"
    for r in rows:
        out += b" " + b"".join(v.encode(encoding).ljust(w) for v, (_, w) in zip(r, fields))
    return out


def test_shapefile(spark, tmp_path):
    line = struct.pack("<i", 3) + b"\0" * 32 + struct.pack("<2i", 1, 2) + struct.pack("<i", 0) + struct.pack("<4d", 1, 2, 3, 4)
    point = struct.pack("<i", 1) + struct.pack("<2d", 5, 6)
    (tmp_path / "roads.shp").write_bytes(shp([line, struct.pack("<i", 0)]))
    (tmp_path / "roads.dbf").write_bytes(dbf([("ID", 4), ("NAME", 12), ("X", 2)], [("1", "한밭로", "q"), ("2", "", "q")], "cp949"))
    (tmp_path / "nodes.shp").write_bytes(shp([point]))
    (tmp_path / "nodes.dbf").write_bytes(dbf([("ID", 4)], [("9",)], "cp949"))
    got = read_shapefile(spark, str(tmp_path), ["ID", "NAME"]).collect()
    parts = {(r.layer, r.record): (r.ID, r.NAME, None if r.parts is None else [[tuple(p) for p in q] for q in r.parts]) for r in got}
    assert parts == {("roads", 0): ("1", "한밭로", [[(1, 2), (3, 4)]]), ("roads", 1): ("2", None, None), ("nodes", 0): ("9", None, [[(5, 6)]])}
    assert read_shapefile(spark, str(tmp_path), ["ID"], geometry=False).columns == ["layer", "record", "ID"]
