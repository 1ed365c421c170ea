"""Readers and writers on small files."""

import gzip
import io
import json
import zipfile

from pyspark.sql import functions as F

from wayfold.sources.archives import read_zipped_csv, write_zipped_csv
from wayfold.sources import sinks, tables


def test_cells_plain_and_gzipped(spark, tmp_path):
    rows = [{"cell": "c1", "n": 2, "rows": [{"rn": "a", "road_bt": 3.0, "sig_cd": "1", "rds_man_no": 7}, {"rn": "b"}]}, {"cell": "c2", "n": 0, "rows": []}]
    body = "\n".join(json.dumps(r) for r in rows).encode()
    (tmp_path / "a.jsonl").write_bytes(body)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(body))
    for name in ("a.jsonl", "b.jsonl.gz"):
        got = tables.read_cells(spark, str(tmp_path / name)).collect()
        assert [(r.cell, r.rn, r.road_bt, r.rds_man_no) for r in got] == [("c1", "a", 3.0, 7), ("c1", "b", None, None)]


def test_documents_and_keyed_maps(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"sites": [{"id": 1}, {"id": 2}], "note": "x"}, indent=2))
    got = tables.read_json_document(spark, str(tmp_path / "d.json"), "sites ARRAY<STRUCT<id: INT>>, note STRING")
    assert got.select(F.explode("sites.id")).count() == 2
    m = spark.range(1).select(F.explode(tables.keyed_document(F.lit('{"1": {"w": 2.5}, "2": null}'), "STRUCT<w: DOUBLE>")))
    assert {r.key: (r.value.w if r.value else None) for r in m.collect()} == {"1": 2.5, "2": None}


def test_csv_with_mark_tabs_and_legacy_encodings(spark, tmp_path):
    (tmp_path / "u.csv").write_bytes("﻿이름,값\n가,1\n나,\n".encode())
    (tmp_path / "t.tsv").write_bytes("a\tb\n1\t2\n".encode())
    (tmp_path / "k.csv").write_bytes("이름,값\n가,1\n나,\n".encode("cp949") + b"\xff,9\n")
    assert [tuple(r) for r in tables.read_text_csv(spark, str(tmp_path / "u.csv"), "`이름` string, `값` string").collect()] == [("가", "1"), ("나", None)]
    assert [tuple(r) for r in tables.read_text_csv(spark, str(tmp_path / "t.tsv"), "a string, b string", sep="\t").collect()] == [("1", "2")]
    got = tables.read_text_csv(spark, str(tmp_path / "k.csv"), "`이름` string, `값` string", encoding="cp949").collect()
    assert [tuple(r) for r in got[:2]] == [("가", "1"), ("나", None)] and got[2][1] == "9"


def zipped(name, body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, body)
    return out.getvalue()


def test_zipped_csv_sniffs_its_encoding(spark, tmp_path):
    (tmp_path / "1.zip").write_bytes(zipped("a.csv", "﻿x,y\n가,1\n".encode()))
    (tmp_path / "2.zip").write_bytes(zipped("b.csv", "x,y\n나,2\n".encode("cp949")))
    got = read_zipped_csv(spark, str(tmp_path / "*.zip"), "x string, y string").collect()
    assert sorted(map(tuple, got)) == [("가", "1"), ("나", "2")]
    (tmp_path / "3.zip").write_bytes(zipped("c.csv", b"p,1\nq,2\n"))
    got = read_zipped_csv(spark, str(tmp_path / "3.zip"), "x string, y string", header=False).collect()
    assert sorted(map(tuple, got)) == [("p", "1"), ("q", "2")]


def test_headless_csv_and_filters(spark, tmp_path):
    (tmp_path / "h.csv").write_text("20240101,1,5.0\n20240101,2,6.0\n20240101,3,\n")
    wanted = spark.createDataFrame([("1",), ("3",)], "link string")
    got = tables.read_headless_csv(spark, str(tmp_path / "h.csv"), "day string, link string, speed double", "link", wanted)
    assert sorted((r.link, r.speed) for r in got.collect()) == [("1", 5.0), ("3", None)]
    df = spark.createDataFrame([(1.0, 1.0, "182a"), (5.0, 5.0, "183b"), (None, 1.0, None)], "x double, y double, id string")
    assert tables.in_box(df, "x", "y", (0, 0, 2, 2)).count() == 1
    assert tables.with_prefix(df, "id", ["182", "184"]).count() == 1
    b = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (5.0, 5.0, 6.0, 6.0)], "x_min double, y_min double, x_max double, y_max double")
    assert tables.box_meets(b, (0.5, 0.5, 2, 2)).count() == 1


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"), F.col("id").cast("string").alias("k")).write.parquet(str(tmp_path / "p"))
    df = tables.with_prefix(tables.in_box(spark.read.parquet(str(tmp_path / "p")), "x", "y", (1, 1, 2, 2)), "k", ["1"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(x,1.0)" in plan and "StringStartsWith(k,1)" in plan


def test_geometry_texts(spark):
    one = spark.range(1).select(
        tables.wkt_points(F.lit("LINESTRING (1 2, 3.5 -4, 5e1 6)")).alias("w"), tables.geojson_line(F.lit('{"type": "LineString", "coordinates": [[1, 2], [3, 4.5]]}')).alias("g")
    ).first()
    assert [tuple(p) for p in one.w] == [(1, 2), (3.5, -4), (50, 6)] and [tuple(p) for p in one.g] == [(1, 2), (3, 4.5)]


def test_catalogues_and_documents(spark):
    xml = "<C><Layer q='1'><Name>A</Name><Title>t</Title></Layer><Layer><Name>a</Name><Title>z</Title></Layer><Layer><Name>B</Name></Layer></C>"
    got = tables.layer_catalogue(spark.createDataFrame([(xml,)], "x string"), "x")
    assert sorted((r.name, r.title, r.abstract) for r in got.collect()) == [("A", "t", None), ("B", None, None)]
    body = "<w:p><w:r><w:t>a &amp; </w:t></w:r><w:r><w:t xml:space='x'>b</w:t></w:r></w:p><w:p><w:t>&lt;c&gt;</w:t></w:p>"
    assert spark.range(1).select(tables.document_text(F.lit(body))).first()[0] == "a & b\n<c>"


def test_resume_and_cells(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "cell string"), spark.createDataFrame([("x",), ("x",)], "cell string")
    assert [r.cell for r in tables.pending(a, b, "cell").collect()] == ["y"]
    pts = spark.createDataFrame([(0.1 * i, 0.0) for i in range(8)] + [(9.0, 9.0)] * 3, "x double, y double")
    got = sorted(map(tuple, tables.adaptive_cells(pts, "x", "y", 8.0, 3, depth=5).collect()))
    assert sum(r[3] for r in got) == 11 and all(r[3] <= 3 for r in got if r[0] < 5)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("가", 1), ("나", None)], "n string, v int")
    sinks.write_csv(df, str(tmp_path / "c"), ["v", "n"], single=True, mark=True)
    part = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert part.startswith("﻿v,n".encode()) and part.decode().splitlines()[1:] == ["1,가", ",나"]
    sinks.write_json_lines(df, str(tmp_path / "j"))
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    assert sorted(r.json for r in sinks.report(df).collect()) == ['{"n":"가","v":1}', '{"n":"나","v":null}']
    line = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))
    f = json.loads(spark.range(1).select(sinks.geojson_feature(line, F.struct(F.lit("q").alias("name")))).first()[0])
    assert f == {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1.0, 2.0]]}, "properties": {"name": "q"}}
    assert sinks.leaks(df.select(sinks.masked(F.col("n"), "가").alias("n")), ["n"], "가").first()[0] == 0
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert tables.file_digests(spark, str(tmp_path / "f.bin")).first().sha256.startswith("ba7816bf")


def test_members_are_read_one_by_one(spark, tmp_path):
    folder = f"file://{tmp_path}/z"
    df = spark.createDataFrame([(str(i), None if i == 3 else f'a "q", {i}\n길') for i in range(25)], "k string, v string").coalesce(1)
    assert write_zipped_csv(df, folder, rows_a_member=10) == 1
    got = read_zipped_csv(spark, folder, "v string, k string, other string", members="all")
    assert got.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, got.collect()), key=lambda r: int(r[1])) == [(None if i == 3 else f'a "q", {i}\n길', str(i), None) for i in range(25)]
    assert read_zipped_csv(spark, folder, "k string").count() == 10  # the first member
    assert write_zipped_csv(df.limit(0), f"{folder}-none") == 0 and read_zipped_csv(spark, f"{folder}-none", "k string").count() == 0
