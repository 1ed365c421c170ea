"""The layer source: deleted records, missing shapes and files, ranges, and what it answers itself."""

import pytest
from pyspark.sql import functions as F

from wayfold.sources import shapefile, tables
from wayfold.sources.shapefile import read_layers, write_layers

WIDTHS = {"ID": 4, "NAME": 12}


def line(k):
    return None if k % 5 == 4 else [[(float(k), 0.0), (k + 1.0, 2.0)], [(k + 0.5, -1.0), (k + 0.5, 9.0), (float(k), 3.0)]]


def as_rows(parts):
    return None if parts is None else [[{"x": x, "y": y} for x, y in p] for p in parts]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [{"ID": str(k), "NAME": None if k == 3 else f"{'대흥로' if k % 2 else '한밭로'}{k}", "parts": as_rows(line(k)), "gone": k % 4 == 1} for k in range(23)]
    df = spark.createDataFrame(rows, "ID string, NAME string, parts array<array<struct<x: double, y: double>>>, gone boolean").coalesce(1)
    assert write_layers(df, f"file://{tmp_path}/s", WIDTHS, deleted="gone") == 1
    return f"file://{tmp_path}/s"


def found(df):
    return {int(r.ID): r for r in df.collect()}


KEPT = [k for k in range(23) if k % 4 != 1]


@pytest.mark.parametrize("records", [1, 5, 1000])
def test_deleted_records_shift_nothing(spark, folder, records):
    got = found(read_layers(spark, folder, ["ID", "NAME", "NONE"], records=records))
    assert sorted(got) == KEPT
    for k, r in got.items():
        assert r.record == k and r.NAME == (None if k == 3 else f"{'대흥로' if k % 2 else '한밭로'}{k}") and r.NONE is None
        parts = None if r.parts is None else [[(p.x, p.y) for p in part] for part in r.parts]
        assert parts == line(k) and (r.x_min, r.y_max) == ((None, None) if k % 5 == 4 else (float(k), 9.0))


def test_a_layer_is_read_in_ranges(spark, folder):
    assert read_layers(spark, folder, ["ID"], records=5).rdd.getNumPartitions() == 5
    assert read_layers(spark, folder, ["ID"], geometry=False, with_bounds=False, records=12).rdd.getNumPartitions() == 2


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_the_source_answers(spark, folder):
    rows = read_layers(spark, folder, ["ID", "NAME"], records=7)
    window = tables.box_meets(rows, (6.0, 0.0, 12.0, 1.0)).filter(F.col("NAME").startswith("한밭"))
    assert sorted(found(window)) == [k for k in KEPT if k % 2 == 0 and k % 5 != 4 and 6 <= k + 1 and k <= 12]
    assert "Filter (" not in plan(window)  # nothing is left for Spark to test
    assert sorted(found(rows.filter("ID IN ('2', '7')"))) == [2, 7] and sorted(found(rows.filter("NAME = '대흥로7'"))) == [7]
    assert sorted(found(rows.filter("NAME IS NULL"))) == [3]
    assert "Filter (" in plan(rows.filter("length(NAME) > 4"))
    either = read_layers(spark, folder, ["ID", "NAME"], prefixes={"NAME": ["한밭로1", "대흥로2"]})
    assert sorted(found(either)) == [k for k in KEPT if k in (10, 12, 14, 16, 18)]


def test_geometry_without_index_or_file(spark, folder):
    path = folder.removeprefix("file://")
    import os

    os.remove(f"{path}/layer-00000-00000.shx")
    got = found(read_layers(spark, folder, ["ID"], records=5))
    assert sorted(got) == KEPT and got[6].x_min == 6.0 and [len(p) for p in got[22].parts] == [2, 3]
    os.remove(f"{path}/layer-00000-00000.shp")
    assert all(r.parts is None for r in found(read_layers(spark, folder, ["ID"])).values())


def test_long_partitions_make_several_layers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shapefile, "LAYER_RECORDS", 10)
    df = spark.range(25).select(F.col("id").cast("string").alias("ID"), F.lit(None).cast("array<array<struct<x: double, y: double>>>").alias("parts")).coalesce(1)
    assert write_layers(df, f"file://{tmp_path}/s", {"ID": 6}) == 3
    got = read_layers(spark, f"file://{tmp_path}/s", ["ID"])
    assert sorted(int(r.ID) for r in got.collect()) == list(range(25)) and got.select("layer").distinct().count() == 3


def test_empty_folder_and_empty_layer(spark, tmp_path):
    (tmp_path / "s").mkdir()
    assert read_layers(spark, f"file://{tmp_path}/s", ["ID"]).count() == 0
    for end, data in shapefile.layer_files([], {"ID": 4}, shapefile.LINE, "cp949").items():
        (tmp_path / "s" / f"a.{end}").write_bytes(data)
    assert read_layers(spark, f"file://{tmp_path}/s", ["ID"]).count() == 0
