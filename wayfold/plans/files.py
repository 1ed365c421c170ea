"""Queries: tables written in a source's format and read back by it.

Small tables become files in the workspace, so that each reader meets real
bytes; the SQL says what the rows were.
"""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import address, bands, coords, names, numbers
from wayfold.plans.base import query
from wayfold.sources import sinks, tables
from wayfold.sources.archives import read_zipped_csv, write_zipped_csv
from wayfold.sources.shapefile import read_layers, read_shapefile, write_layers
from wayfold.sources.tables import table
from wayfold.workspace import Workspace


def _put(work: Workspace, name: str, data: bytes) -> str:
    """A file of the workspace, through the file system that the session knows it by."""
    context = work.spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(work.folder(name))
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return work.folder(name)


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _regions(spark: SparkSession, sf: str) -> list[tuple[int, str]]:
    """The five regions, as a file's writer needs them."""
    return sorted((r.r_regionkey, r.r_name) for r in table(spark, sf, "region").collect())


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(CASE WHEN n_regionkey <> 2 THEN n_regionkey END AS VARCHAR) AS n_regionkey FROM nation")
def csv_with_mark(spark: SparkSession, sf: str) -> DataFrame:
    """CSV with a byte-order mark and empty fields, written and read."""
    work, columns = Workspace(spark, "csv"), ["n_nationkey", "n_name", "n_regionkey"]
    rows = _nations(spark, sf).withColumn("n_regionkey", F.when(F.col("n_regionkey") != 2, F.col("n_regionkey")))
    sinks.write_csv(rows, work.folder("c"), columns, single=True, mark=True)
    return tables.read_text_csv(spark, work.folder("c"), ", ".join(f"{c} string" for c in columns))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name FROM nation")
def tsv_rows(spark: SparkSession, sf: str) -> DataFrame:
    work = Workspace(spark, "tsv")
    rows = _nations(spark, sf).select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    body = "k\tn_name\n" + "\n".join(sorted(r.value for r in rows.collect())) + "\n"
    return tables.read_text_csv(spark, _put(work, "t.tsv", body.encode()), "k string, n_name string", sep="\t")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name || '로' AS name FROM region UNION ALL SELECT 'bad', chr(65533)")
def csv_legacy(spark: SparkSession, sf: str) -> DataFrame:
    """CSV in cp949, with one byte that is none of its characters."""
    body = "k,name\n" + "".join(f"{k},{name}로\n" for k, name in _regions(spark, sf))
    path = _put(Workspace(spark, "cp949"), "k.csv", body.encode("cp949") + b"bad,\xff\n")
    return tables.read_text_csv(spark, path, "k string, name string", encoding="cp949")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS k, r_name || '길' AS name FROM region UNION ALL SELECT CAST(r_regionkey + 100 AS VARCHAR), r_name || '대로' FROM region")
def csv_zipped(spark: SparkSession, sf: str) -> DataFrame:
    """CSV in ZIP files, one in UTF-8 with a mark and one in cp949."""
    work, regions = Workspace(spark, "zip"), _regions(spark, sf)
    for name, encoding, shift, tail in (("z/1.zip", "utf-8-sig", 0, "길"), ("z/2.zip", "cp949", 100, "대로")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("a.csv", ("k,name\n" + "".join(f"{k + shift},{r}{tail}\n" for k, r in regions)).encode(encoding))
        _put(work, name, data.getvalue())
    return read_zipped_csv(spark, work.folder("z/*.zip"), "k string, name string")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS link, o_totalprice FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def csv_headless(spark: SparkSession, sf: str) -> DataFrame:
    """CSV without a header, only rows of wanted links."""
    work = Workspace(spark, "headless")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").write.csv(work.folder("h"))
    wanted = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("link"))
    found = tables.read_headless_csv(spark, work.folder("h"), "o_orderkey long, link string, o_totalprice double", "link", wanted)
    return found.select("o_orderkey", "link", "o_totalprice")


def _shapefile(rows: list[tuple[int, str]]) -> tuple[bytes, bytes]:
    """Lines from (key, 1) over (key, 2) to (key + 1, 3), with their keys and names."""
    shp = b"\0" * 100
    for i, (k, _) in enumerate(rows, 1):
        body = struct.pack("<i", 3) + b"\0" * 32 + struct.pack("<2i", 1, 3) + struct.pack("<i", 0) + struct.pack("<6d", k, 1, k, 2, k + 1, 3)
        shp += struct.pack(">2i", i, len(body) // 2) + body
    fields, width = (("ID", 6), ("NAME", 30)), 37
    head = 33 + 32 * len(fields)
    dbf = bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(rows), head, width) + b"\0" * 20
    for name, w in fields:
        dbf += name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w]) + b"\0" * 15
    dbf += b"\r" + b"".join(b" " + str(k).encode().ljust(6) + f"{n}길".encode("cp949").ljust(30) for k, n in rows)
    return shp, dbf


@query("""SELECT 'roads' AS layer, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS record, CAST(r_regionkey AS VARCHAR) AS "ID", r_name || '길' AS "NAME",
 CAST(3 AS INTEGER) AS n_points, CAST(r_regionkey + 1 AS DOUBLE) AS last_x, CAST(3 AS DOUBLE) AS last_y FROM region""")
def shapefile_rows(spark: SparkSession, sf: str) -> DataFrame:
    work = Workspace(spark, "shapefile")
    for kind, data in zip(("shp", "dbf"), _shapefile(_regions(spark, sf))):
        _put(work, f"s/roads.{kind}", data)
    rows = read_shapefile(spark, work.folder("s"), ["ID", "NAME"])
    line = F.col("parts")[0]
    return rows.select("layer", "record", "ID", "NAME", F.size(line).alias("n_points"), F.element_at(line, -1)["x"].alias("last_x"), F.element_at(line, -1)["y"].alias("last_y"))


@query("""SELECT 'roads' AS layer, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS record, r_name || '길' AS "NAME" FROM region""")
def shapefile_without_geometry(spark: SparkSession, sf: str) -> DataFrame:
    work = Workspace(spark, "dbf")
    _put(work, "s/roads.dbf", _shapefile(_regions(spark, sf))[1])
    return read_shapefile(spark, work.folder("s"), ["NAME"], geometry=False)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), NULL, NULL FROM nation WHERE n_regionkey = 4")
def json_keyed_document(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON document over many lines, whose rows are keyed by id; some are null."""
    import json

    rows = {str(r.n_nationkey): None if r.n_regionkey == 4 else {"name": r.n_name, "region": r.n_regionkey} for r in _nations(spark, sf).collect()}
    text = json.dumps({"note": "x", "rows": json.dumps(rows)}, indent=2)
    path = _put(Workspace(spark, "json"), "d.json", text.encode())
    document = tables.read_json_document(spark, path, "note STRING, rows STRING")
    found = document.select(F.explode(tables.keyed_document(F.col("rows"), "STRUCT<name: STRING, region: BIGINT>")))
    return found.select("key", "value.name", "value.region")


@query("""SELECT c_custkey, CAST(3 AS INTEGER) AS n, CAST(c_custkey % 100 AS DOUBLE) + 0.5 AS x0, CAST(-(c_custkey % 7) AS DOUBLE) AS y1, CAST(c_custkey AS DOUBLE) * 10 AS x2, CAST(c_nationkey AS DOUBLE) AS gx FROM customer""")
def geometry_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as WKT and GeoJSON, parsed."""
    k, c = F.col("c_custkey"), table(spark, sf, "customer")
    wkt = F.concat(F.lit("LINESTRING ("), (k % 100).cast("string"), F.lit(".5 1, 2 "), (-(k % 7)).cast("string"), F.lit(", "), k.cast("string"), F.lit("e1 3)"))
    geo = F.concat(F.lit('{"type": "LineString", "coordinates": [['), F.col("c_nationkey").cast("string"), F.lit(", 1], [2, 3.5]]}"))
    rows = c.select("c_custkey", tables.wkt_points(wkt).alias("w"), tables.geojson_line(geo).alias("g"))
    return rows.select("c_custkey", F.size("w").alias("n"), F.col("w")[0]["x"].alias("x0"), F.col("w")[1]["y"].alias("y1"), F.col("w")[2]["x"].alias("x2"), F.col("g")[0]["x"].alias("gx"))


@query("SELECT n_name AS name, 'T' || n_regionkey AS title, CAST(NULL AS VARCHAR) AS abstract FROM nation")
def layer_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of capabilities documents, one a region, each layer twice and once in small letters."""
    layer = F.concat(F.lit("<Layer q='1'><Name>"), F.col("n_name"), F.lit("</Name><Title>T"), F.col("n_regionkey").cast("string"), F.lit("</Title></Layer>"))
    lower = F.replace(layer, F.concat(F.lit("<Name>"), F.col("n_name")), F.concat(F.lit("<Name>"), F.lower("n_name")))
    xml = _nations(spark, sf).groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(layer, lower, layer))), "").alias("x"))
    return tables.layer_catalogue(xml, "x")


@query("SELECT n_nationkey, n_name || ' & ' || n_regionkey || chr(10) || '<' || n_nationkey || '>' AS text FROM nation")
def document_xml(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs and runs of a document's XML."""
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    xml = F.concat(
        F.lit("<w:p><w:r><w:t>"), F.col("n_name"), F.lit(" &amp; </w:t></w:r><w:r><w:t xml:space='preserve'>"), r, F.lit("</w:t></w:r></w:p><w:p><w:t>&lt;"), k, F.lit("&gt;</w:t></w:p>")
    )
    return _nations(spark, sf).select("n_nationkey", tables.document_text(xml).alias("text"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || CASE WHEN n_regionkey = 1 THEN 'null' ELSE CAST(n_regionkey AS VARCHAR) END || '}' AS json, CAST(2 AS BIGINT) AS n FROM nation""")
def json_lines_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of rows, appended twice as JSON lines and counted."""
    work = Workspace(spark, "lines")
    rows = sinks.report(_nations(spark, sf).withColumn("n_regionkey", F.when(F.col("n_regionkey") != 1, F.col("n_regionkey"))))
    for _ in range(2):
        sinks.write_json_lines(rows, work.folder("j"))
    return spark.read.schema("json string").json(work.folder("j")).groupBy("json").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || s_suppkey || '.0,0.5],[2.0,' || s_nationkey || '.0]]},"properties":{"name":"' || s_name || '"}}' AS feature FROM supplier""")
def geojson_features(spark: SparkSession, sf: str) -> DataFrame:
    def p(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    line = F.array(p(F.col("s_suppkey"), F.lit(0.5)), p(F.lit(2), F.col("s_nationkey")))
    return table(spark, sf, "supplier").select(sinks.geojson_feature(line, F.struct(F.col("s_name").alias("name"))).alias("feature"))


@query("SELECT CAST(length(t) AS BIGINT) AS length, sha256(t) AS sha256 FROM (SELECT string_agg(r_regionkey || ':' || r_name, ';' ORDER BY r_regionkey) AS t FROM region)")
def digest_of_file(spark: SparkSession, sf: str) -> DataFrame:
    data = ";".join(f"{k}:{name}" for k, name in _regions(spark, sf)).encode()
    return tables.file_digests(spark, _put(Workspace(spark, "digest"), "f.bin", data)).select("length", "sha256")


@query("""
WITH n AS (SELECT n_nationkey AS k, CAST(n_nationkey + 1 AS VARCHAR) AS n FROM nation)
SELECT k AS n_nationkey, 0 AS pos, '한밭로' || n || '번길' AS piece, 'road' AS kind FROM n UNION ALL SELECT k, 1, '한밭로' || n || '5번길', 'road' FROM n
UNION ALL SELECT k, 2, '둔산로', 'road' FROM n UNION ALL SELECT k, 3, '용두동 ' || n || '-3', 'parcel' FROM n""")
def address_list(spark: SparkSession, sf: str) -> DataFrame:
    """Roads and parcels of listed addresses, stems inherited, area words and parentheses gone."""
    n = (F.col("n_nationkey") + 1).cast("string")
    listed = F.concat(F.lit("중구 한밭로 "), n, F.lit("번길~"), n, F.lit("5번길, 둔산로 일원 (구 도로)/용두동 "), n, F.lit("-3"))
    rows = address.pieces(_nations(spark, sf).select("n_nationkey", listed.alias("a")), "n_nationkey", "a")
    return rows.withColumn("kind", address.kind(F.col("piece")))


@query("""
SELECT p_partkey, p_size % 3 = 0 AS accepted, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_brand || p_size END AS key,
       CASE WHEN p_size < 10 THEN '100' || p_size ELSE '10' || p_size END AS station, 'x' || CASE WHEN p_size * 8 <= 300 THEN 'usable' ELSE 'too slow' END AS elapsed,
       CASE WHEN p_size >= 40 THEN 'C' WHEN p_size >= 25 THEN 'D' ELSE 'E' END AS grade, CASE WHEN p_size >= 24 AND p_size % 4 >= 2 THEN 20 WHEN p_size >= 24 THEN 19 ELSE 18 END AS zoom,
       CASE WHEN p_size >= 10 THEN 'enough' WHEN p_size >= 6 THEN 'borderline' ELSE 'too few' END AS pixels FROM part""")
def small_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance, keys in parentheses, station ids, grades and gates over all parts."""
    size = F.col("p_size")
    answer = F.concat(F.lit("대전 중구 "), F.when(size % 3 == 0, "한밭로").otherwise("대흥로"), F.lit(" 12"))
    keyed = F.when(size % 2 == 0, F.concat(F.lit("lane ("), F.col("p_brand"), F.lit(")"))).otherwise(F.concat(F.col("p_brand"), F.lit(" "), size.cast("string")))
    return table(spark, sf, "part").select(
        "p_partkey",
        address.accepted(F.lit("한밭로"), answer).alias("accepted"),
        names.key_in_parentheses(keyed).alias("key"),
        numbers.station_id(F.concat(F.lit("st-"), size.cast("string"))).alias("station"),
        F.concat(F.lit("x"), address.elapsed_verdict(size * 8.0)).alias("elapsed"),
        bands.evidence_grade(size, F.lit(50)).alias("grade"),
        coords.zoom_verdict(size / F.lit(20.0), (size % 4) / F.lit(1.5)).alias("zoom"),
        coords.pixel_gate(size).alias("pixels"),
    )


def _layers(spark: SparkSession, sf: str, label: str) -> str:
    """The customers as lines of two or three vertices, written by the tasks; each seventh is deleted, each eleventh has no shape."""
    k = F.col("c_custkey")

    def p(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    first = F.array(p(k * 7919 % 1000, k * 10473 % 1000), p(k * 7919 % 1000 + k % 7 * 9 - 27, k * 10473 % 1000 + k % 5 * 9))
    more = F.array(p(k % 100, k % 90), p(k % 100 + 5, k % 90 - 5), p(k % 100 + 9, k % 90))
    parts = F.when(k % 11 != 0, F.when(k % 3 == 0, F.array(first, more)).otherwise(F.array(first)))
    rows = table(spark, sf, "customer").repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey")
    rows = rows.select(k.cast("string").alias("ID"), F.concat(F.col("c_mktsegment"), F.lit("길")).alias("NAME"), parts.alias("parts"), (k % 7 == 0).alias("gone"))
    folder = Workspace(spark, label).folder("s")
    write_layers(rows, folder, {"ID": 12, "NAME": 30}, deleted="gone")
    return folder


_LAYER_SQL = """c AS (SELECT c_custkey AS k, c_mktsegment || '길' AS name, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 10473 % 1000 AS DOUBLE) AS y,
  CAST(c_custkey % 7 * 9 - 27 AS DOUBLE) AS dx, CAST(c_custkey % 5 * 9 AS DOUBLE) AS dy, c_custkey % 3 = 0 AS two, CAST(c_custkey % 100 AS DOUBLE) AS mx, CAST(c_custkey % 90 AS DOUBLE) AS my FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT *, CASE WHEN two THEN least(x, x + dx, mx) ELSE least(x, x + dx) END AS x_min, CASE WHEN two THEN greatest(x, x + dx, mx + 9) ELSE greatest(x, x + dx) END AS x_max,
  CASE WHEN two THEN least(y, my - 5) ELSE y END AS y_min, CASE WHEN two THEN greatest(y + dy, my) ELSE y + dy END AS y_max FROM c WHERE k % 11 <> 0)"""


@query(f"""WITH {_LAYER_SQL}
SELECT CAST(k AS VARCHAR) AS "ID", name AS "NAME", CAST(CASE WHEN two THEN 2 ELSE 1 END AS INTEGER) AS n_parts, CAST(CASE WHEN two THEN 5 ELSE 2 END AS INTEGER) AS n_points, x + dx AS x1, x_min, y_max
FROM b WHERE x_max >= 200 AND x_min <= 600 AND y_max >= 100 AND y_min <= 700 AND name LIKE 'B%'""")
def layer_window(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a layer that meet a box and whose name begins so; both tests are answered by the source."""
    rows = tables.box_meets(read_layers(spark, _layers(spark, sf, "layer-window"), ["ID", "NAME"], records=400), (200.0, 100.0, 600.0, 700.0))
    points = F.flatten("parts")
    return rows.filter(F.col("NAME").startswith("B")).select(
        "ID", "NAME", F.size("parts").alias("n_parts"), F.size(points).alias("n_points"), points[1]["x"].alias("x1"), "x_min", "y_max"
    )


@query(f"""WITH {_LAYER_SQL} SELECT name AS "NAME", CAST(count(*) AS BIGINT) AS n FROM c WHERE name LIKE 'B%' OR name LIKE 'MA%' GROUP BY name""")
def layer_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of a layer with any of several beginnings, counted; no geometry file is read."""
    rows = read_layers(spark, _layers(spark, sf, "layer-prefixes"), ["NAME"], geometry=False, with_bounds=False, records=400, prefixes={"NAME": ["B", "MA"]})
    return rows.groupBy("NAME").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || ', 길' END AS name, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def archive_members(spark: SparkSession, sf: str) -> DataFrame:
    """The customers as CSV in archives of several members, written by the tasks, a task to read each member."""
    folder = Workspace(spark, "archives").folder("z")
    k = F.col("c_custkey")
    name = F.when(k % 5 != 0, F.concat(F.col("c_mktsegment"), F.lit(", 길")))
    rows = table(spark, sf, "customer").repartitionByRange(3, "c_custkey").select(k.cast("string").alias("k"), F.col("c_nationkey").cast("string").alias("nation"), name.alias("name"))
    write_zipped_csv(rows, folder, rows_a_member=200)
    return read_zipped_csv(spark, folder, "k string, name string, nation string", members="all")
