"""Scalars on hand-made rows, at their limits."""

import math

import pytest
from pyspark.sql import functions as F

from wayfold.functions import bands, coords, names, numbers, text


def values(spark, ddl, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).coalesce(1).select(*columns).collect()]


def test_numbers(spark):
    got = values(spark, "t string", [("3.5",), (" 0 ",), ("",), ("-",), ("null",), ("x",), (None,)], numbers.number(F.col("t")), numbers.number_or_sentinel(F.col("t")))
    assert got == [(3.5, 3.5), (0.0, 0.0)] + [(None, None)] * 5


def test_station_ids(spark):
    assert values(spark, "t string", [("123",), ("7",), ("역 2045",)], numbers.station_id(F.col("t"))) == [("1123",), ("1007",), ("2045",)]


def test_names(spark):
    c = F.col("n")
    rows = [("중앙대로",), ("한밭로",), ("1길",), ("12번길",), ("3번안길",), ("-",), ("",), (None,)]
    got = values(spark, "n string", rows, names.tier4(c), names.tier5(c), names.tier5_by_suffix(c), names.is_unnamed(c))
    assert got == [
        ("대로", "대로", "대로", False),
        ("로", "로", "로", False),
        ("길", "길", "길", False),
        ("길", "번길", "번길", False),
        ("길", "번길", "길", False),
        ("기타", "기타", "기타", True),
        ("기타", None, "기타", True),
        ("기타", None, "기타", True),
    ]


def test_normal_names(spark):
    got = values(spark, "n string", [("가나 (옛 길) 로",), ("é a",), (None,)], names.normal_name(F.col("n")))
    assert got == [("가나로",), ("éa",), ("",)]


def test_roads_of_addresses(spark):
    got = values(spark, "a string", [("서구 둔산로 12번길 3",), ("둔산로",), ("산 1-2",)], names.road_of_address(F.col("a")))
    assert got == [("둔산로12번길",), ("둔산로",), (None,)]


def test_texts_within_one_edit_share_a_cut(spark):
    rows = [("abc", "abd"), ("abc", "ab"), ("abc", "abcd"), ("abc", "acb"), ("", "x"), ("a", "b")]
    shared = F.arrays_overlap(names.with_one_deleted(F.col("a")), names.with_one_deleted(F.col("b")))
    got = values(spark, "a string, b string", rows, names.within_one_edit(F.col("a"), F.col("b")), shared)
    assert [g[0] for g in got] == [True, True, True, False, True, True]
    assert all(s for near, s in got if near)


def test_bands(spark):
    w = F.col("w")
    rows = [(None,), (2.5,), (2.51,), (3.5,), (3.51,), (3.02,), (3.03,), (0.0,)]
    got = values(spark, "w double", rows, bands.band(w), bands.band_with_error(w), bands.band_and_reason(w)["band"])
    u = bands.UNKNOWN
    assert got == [
        (u, u, "WIDTH_UNKNOWN"),
        ("BLOCKED", "BLOCKED_C", "BLOCKED"),
        ("CONDITIONAL_C", "BLOCKED_C", "CONDITIONAL_C"),
        ("CONDITIONAL_C", "CONDITIONAL_C", "CONDITIONAL_C"),
        ("CANDIDATE_PASS", "CONDITIONAL_C", "CANDIDATE_PASS"),
        ("CONDITIONAL_C", "CONDITIONAL_C" if 3.02 + 0.48 >= 3.5 else "BLOCKED_C", "CONDITIONAL_C"),
        ("CONDITIONAL_C", "CONDITIONAL_C", "CONDITIONAL_C"),
        ("BLOCKED", "BLOCKED_C", "WIDTH_UNKNOWN"),
    ]


def test_separation(spark):
    s = bands.separation(F.col("w"))
    got = values(spark, "w double", [(None,), (1.8,), (1.9,), (3.4,), (3.7,), (4.5,)], s["mode"], s["closed"], bands.class_width(F.col("w")))
    assert got == [(bands.UNKNOWN, None, None), ("impassable", "Y", None), ("time", "Y", 1.9), ("time", "Y", 2.5), ("space", "Y", 2.5), ("space", "N", 2.5)]


def test_slots_and_agreement(spark):
    w = F.col("w")
    got = values(spark, "w double", [(2.5,), (3.7,), (None,)], *[f.alias(f"s{i}") for i, f in enumerate(bands.slot_flags(w))], bands.slot_flags(w, strict=False)[0])
    assert got == [(False, False, False, True), (True, False, False, True), (False, False, False, False)]
    got = values(spark, "v double, lo double, hi double", [(1.0, 2.0, 3.0), (0.9, 2.0, 3.0), (None, 2.0, 3.0)], bands.agreement(F.col("v"), F.col("lo"), F.col("hi")))
    assert got == [("consistent",), ("different",), ("not comparable",)]


def test_grades_and_final_width(spark):
    got = values(spark, "a int, n int", [(8, 10), (5, 10), (1, 8), (0, 0)], bands.evidence_grade(F.col("a"), F.col("n")))
    assert got == [("C",), ("D",), ("E",), (None,)]
    f = bands.final_width(F.col("m"), F.col("a"), F.col("b"))
    got = values(spark, "m boolean, a double, b double", [(False, 3.0, 2.0), (False, None, 2.0), (True, 3.0, 2.0), (False, None, None), (False, 2.0, 2.0)], f["width"], f["basis"])
    assert got == [(2.0, "width 2"), (2.0, "width 2"), (None, "missed detection"), (None, "none"), (2.0, "width 1")]


def test_width_bins(spark):
    got = values(spark, "w double", [(x,) for x in (None, 0.0, 2.0, 2.9, 3.0, 4.0, 6.0, 8.0, 8.5, 12.0, 20.0, 40.0)], bands.width_bin(F.col("w")))
    assert [g[0] for g in got] == ["missing", "=0", "<=2", "2-3", "=3", "3-4", "4-6", "6-8", "8-12", "12-20", "20-40", ">=40"]


@pytest.mark.parametrize(("width", "base", "front", "radius", "want"), [(2.5, 6.5, 2.5, 12.0, 5.931), (2.0, 3.7, 1.0, 7.0, 3.634), (1.7, 2.7, 0.8, 6.0, 2.742)])
def test_published_swept_widths(spark, width, base, front, radius, want):
    got = values(spark, "b double, l double, f double, r double", [(width, base, front, radius)], F.round(bands.swept_width(*map(F.col, "blfr")), 3))
    assert got == [(want,)]


@pytest.mark.parametrize(("zoom", "want"), [(18, 0.481), (19, 0.2405), (20, 0.1202)])
def test_published_pixel_spacing(spark, zoom, want):
    got = values(spark, "lat double", [(36.3456,)], F.round(coords.ground_resolution(F.col("lat"), zoom), 4 if zoom > 18 else 3))
    assert math.isclose(got[0][0], want, abs_tol=1.1e-4)


def test_coordinates_round_trip(spark):
    lon, lat = F.col("lon"), F.col("lat")
    rows = [(127.0, 38.0), (127.3845, 36.3504), (126.5312, 33.4996), (130.9, 37.5)]
    df = spark.createDataFrame(rows, "lon double, lat double").coalesce(1)
    for there, back in ((coords.to_mercator, coords.from_mercator), (coords.to_belt, coords.from_belt)):
        x, y = there(lon, lat)
        got = df.withColumn("x", x).withColumn("y", y)
        u, v = back(F.col("x"), F.col("y"))
        for (a, b), r in zip(rows, got.select(u.alias("u"), v.alias("v")).collect()):
            assert math.isclose(a, r.u, abs_tol=1e-9) and math.isclose(b, r.v, abs_tol=1e-9)
    e, n = coords.to_belt(lon, lat)
    first = df.select(e.alias("e"), n.alias("n")).collect()
    assert math.isclose(first[0].e, 200_000, abs_tol=1e-6) and math.isclose(first[0].n, 600_000, abs_tol=1e-6)
    # a degree of latitude near 37 degrees is 110.98 km, one of longitude 111.32 km times its cosine
    assert 180_000 < 600_000 - first[1].n < 185_000 and 34_000 < first[1].e - 200_000 < 35_000


def test_validity_and_tiles(spark):
    got = values(spark, "lon double, lat double", [(127.0, 36.0), (123.9, 36.0), (None, 36.0)], coords.valid(F.col("lon"), F.col("lat")))
    assert got == [(True,), (False,), (False,)]
    x, y = coords.tile(F.col("lon"), F.col("lat"), 1)
    assert values(spark, "lon double, lat double", [(0.1, 0.1), (-0.1, -0.1)], x, y) == [(1, 0), (0, 1)]


def test_text(spark):
    t = F.col("t")
    got = values(spark, "t string", [("폭 3.5~4.0 m, 1,250명 [2] 7", )], text.numbers_in(t), text.numbers_with_unit(t, ["m", "명"]), text.citations(t))
    assert got == [(["3.5", "4.0", "1,250", "2", "7"], ["3.5~4.0", "1,250"], ["2"])]
    got = values(spark, "t string, n string", [("값 3.5 m", "3.5"), ("값 13.5", "3.5"), ("값 3.51", "3.5")], text.holds_number(t, F.col("n")))
    assert got == [(True,), (False,), (False,)]
    got = values(spark, "t string", [("aaa bb cccc d",), ("abcdefghij",), ("",)], text.wrapped_lines(t, 6))
    assert got == [(2,), (2,), (0,)]
    got = values(spark, "t string", [("<p>a</p><p>b</p>",)], text.without_tags(t), text.tag_count(t, "p"), F.round(text.display_width(F.lit("가a")), 2))
    assert got == [("ab", 2, 1.55)]
    got = values(spark, "t string", [("x {k} y",)], text.filled_in(t, "k", None), text.filled_in(t, "k", "1"), text.context(F.lit("0123456789"), F.lit(5), F.lit(2), 2))
    assert got == [("x [k not set] y", "x 1 y", "234567")]
    assert values(spark, "t string", [("a",)], text.column_widths(F.array(F.lit(1.0), F.lit(20.0), F.lit(5.0)), 100.0))[0][0][0] == 12.0
