"""Shapefiles as a Spark data source.

A layer is three files: attributes in records of one size, geometries in records
of any size, and an index with the place of each geometry.  Both indexes lead
straight to a record, so a layer is read in ranges of records, one task each.
Comparisons of bounds and tests of attributes are answered by the reader: a
record that fails one on its attributes has no geometry read, and one that fails
on its bounds has none decoded.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Records of a task, of a batch that it gives back, and of a layer that a task writes.
RECORDS, BATCH, LAYER_RECORDS = 100_000, 4096, 100_000
BOUNDS = ("x_min", "y_min", "x_max", "y_max")
POINT, LINE, POLYGON = 1, 3, 5

_PARTS = "array<array<struct<x: double, y: double>>>"
_ARROW_PARTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:") and "://" not in uri else uri)


# ---------------------------------------------------------------- records
def bounds(body: bytes) -> tuple[float, float, float, float] | None:
    """Bounds of a geometry record, from its head alone; None for a null shape."""
    kind = int.from_bytes(body[:4], "little")
    if kind == POINT:
        return struct.unpack("<2d", body[4:20]) * 2
    return struct.unpack("<4d", body[4:36]) if kind in (LINE, POLYGON) else None


def decoded(body: bytes) -> list[list[dict[str, float]]] | None:
    """Parts of a geometry record: points, lines or rings; None for a null shape."""
    kind = int.from_bytes(body[:4], "little")
    if kind == POINT:
        x, y = struct.unpack("<2d", body[4:20])
        return [[{"x": x, "y": y}]]
    if kind not in (LINE, POLYGON):
        return None
    n_parts, n = struct.unpack("<2i", body[36:44])
    starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n]
    flat = struct.unpack(f"<{2 * n}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n])
    points = [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2])]
    return [points[a:b] for a, b in zip(starts, starts[1:])]


def encoded(parts: list[list[tuple[float, float]]] | None, kind: int) -> bytes:
    """A geometry record of lines or rings."""
    points = [p for part in parts or [] for p in part]
    if not points:
        return struct.pack("<i", 0)
    x, y = zip(*points)
    starts, at = [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
    head = struct.pack("<i4d2i", kind, min(x), min(y), max(x), max(y), len(parts), len(points))
    return head + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * len(points)}d", *(c for p in points for c in p))


@dataclass
class Fields:
    """What the head of an attribute file says."""

    n: int
    head: int
    size: int
    places: dict[str, tuple[int, int]]

    @classmethod
    def read(cls, f) -> Fields:
        n, head, size = struct.unpack("<IHH", f.read_at(8, 4))
        raw, places, at, place = f.read_at(head, 0), {}, 32, 1
        while raw[at] != 0x0D:
            places[raw[at : at + 11].split(b"\0")[0].decode("ascii", "replace")] = (place, raw[at + 16])
            place += raw[at + 16]
            at += 32
        return cls(n, head, size, places)


# ---------------------------------------------------------------- reader
@dataclass
class RecordRange(ds.InputPartition):
    layer: str
    first: int
    last: int


Test = tuple[str, str, object]
_COMPARED = {ds.GreaterThanOrEqual: ">=", ds.GreaterThan: ">", ds.LessThanOrEqual: "<=", ds.LessThan: "<"}
_PASSES: dict[str, Callable[[object, object], bool]] = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "=": lambda a, b: a == b,
    "in": lambda a, b: a in b,
    "starts": lambda a, b: a.startswith(b),
    "known": lambda a, b: True,
}


class LayerReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.encoding = options["path"], options.get("encoding", "cp949")
        self.names = [f.name for f in schema.fields]
        self.columns = [f.name for f in schema.fields if isinstance(f.dataType, StringType) and f.name != "layer"]
        self.geometry = "parts" in self.names
        self.records = int(options.get("records", RECORDS))
        self.tests: list[Test] = [(c, "starts", tuple(p)) for c, p in json.loads(options.get("prefixes", "{}")).items()]

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _COMPARED and name in BOUNDS and isinstance(f.value, (int, float)):
                self.tests.append((name, _COMPARED[type(f)], float(f.value)))
            elif isinstance(f, ds.EqualTo) and name in self.columns:
                self.tests.append((name, "=", f.value))
            elif isinstance(f, ds.In) and name in self.columns:
                self.tests.append((name, "in", tuple(f.value)))
            elif isinstance(f, ds.StringStartsWith) and name in self.columns:
                self.tests.append((name, "starts", f.value))
            elif isinstance(f, ds.IsNotNull) and name in (*self.columns, *BOUNDS):
                self.tests.append((name, "known", None))
            else:
                yield f

    def partitions(self) -> list[RecordRange]:
        fs, folder = _store(self.path)
        found = {f.base_name for f in fs.get_file_info(pafs.FileSelector(folder))}
        out = []
        for layer in sorted(n[:-4] for n in found if n.endswith(".dbf")):
            with fs.open_input_file(f"{folder}/{layer}.dbf") as f:
                n = Fields.read(f).n
            # without an index the places of geometries are only known by walking the whole file
            step = self.records if not self.geometry or f"{layer}.shx" in found else max(1, n)
            out += [RecordRange(layer, at, min(n, at + step)) for at in range(0, n, step)]
        return out or [RecordRange("", 0, 0)]

    def _passes(self, values: dict[str, object], names: Iterable[str]) -> bool:
        return all(values.get(c) is not None and _PASSES[op](values[c], b) for c, op, b in self.tests if c in names)

    def _attributes(self, f, at: RecordRange) -> Iterator[tuple[int, dict[str, object]]]:
        """Number and asked fields of the records that are not deleted; empty fields are None."""
        head = Fields.read(f)
        asked = {c: head.places[c] for c in self.columns if c in head.places}
        raw = f.read_at(head.size * (at.last - at.first), head.head + head.size * at.first)
        for i in range(at.last - at.first):
            row = raw[i * head.size : (i + 1) * head.size]
            if row[:1] != b"*":
                yield at.first + i, {c: row[a : a + w].decode(self.encoding, "replace").strip() or None for c, (a, w) in asked.items()}

    def _geometries(self, fs: pafs.FileSystem, base: str, at: RecordRange) -> Callable[[int], bytes]:
        """A reader of the geometry record of each number in the range."""
        names = {f.base_name for f in fs.get_file_info(pafs.FileSelector(base.rpartition("/")[0]))}
        stem = base.rpartition("/")[2]
        if f"{stem}.shp" not in names:
            return lambda i: b"\0" * 4
        f = fs.open_input_file(f"{base}.shp")
        if f"{stem}.shx" in names:
            with fs.open_input_file(f"{base}.shx") as x:
                raw = x.read_at(8 * (at.last - at.first), 100 + 8 * at.first)
            words = struct.unpack(f">{len(raw) // 4}i", raw)
            places = {at.first + i: (2 * words[2 * i] + 8, 2 * words[2 * i + 1]) for i in range(len(words) // 2)}
        else:
            places, place, end, i = {}, 100, f.size(), 0
            while place + 8 <= end:
                size = 2 * struct.unpack(">i", f.read_at(4, place + 4))[0]
                places[i] = (place + 8, size)
                place, i = place + 8 + size, i + 1
        block: dict[str, object] = {"at": 0, "data": b""}

        def read(i: int) -> bytes:
            if i not in places:
                return b"\0" * 4
            start, size = places[i]
            off = start - block["at"]
            if off < 0 or off + size > len(block["data"]):
                block["at"], block["data"] = start, f.read_at(max(size, 1 << 20), start)
                off = 0
            return block["data"][off : off + size]

        return read

    def read(self, at: RecordRange) -> Iterator[pa.RecordBatch]:
        if at.last == at.first:
            return
        fs, folder = _store(self.path)
        base = f"{folder}/{at.layer}"
        bounded = self.geometry or any(b in self.names for b in BOUNDS)
        geometry = self._geometries(fs, base, at) if bounded else None
        rows: list[dict[str, object]] = []
        with fs.open_input_file(f"{base}.dbf") as f:
            for number, row in self._attributes(f, at):
                if not self._passes(row, self.columns):
                    continue
                if geometry:
                    body = geometry(number)
                    row |= dict(zip(BOUNDS, bounds(body) or (None,) * 4))
                    if not self._passes(row, BOUNDS):
                        continue
                    if self.geometry:
                        row["parts"] = decoded(body)
                rows.append(row | {"layer": at.layer, "record": number})
                if len(rows) == BATCH:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict[str, object]]) -> pa.RecordBatch:
        kinds = {"record": pa.int64(), "parts": _ARROW_PARTS} | dict.fromkeys(BOUNDS, pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names], self.names)


class LayerSource(ds.DataSource):
    """``spark.read.format("layers")`` with a schema of layer, record, attributes, bounds and parts, as far as wanted."""

    @classmethod
    def name(cls) -> str:
        return "layers"

    def schema(self) -> StructType:
        return StructType([StructField("layer", StringType()), *(StructField(b, DoubleType()) for b in BOUNDS)])

    def reader(self, schema: StructType) -> LayerReader:
        return LayerReader(schema, self.options)


def read_layers(spark: SparkSession, folder: str, columns: list[str], encoding: str = "cp949", geometry: bool = True, with_bounds: bool = True, records: int = RECORDS, prefixes: dict[str, list[str]] | None = None) -> DataFrame:
    """All layers of a folder: layer, record (its number in the file), the asked columns as text, bounds, and parts.

    Only the columns in the result are decoded, and without ``geometry`` and
    ``with_bounds`` the geometry files are not read.  Comparisons of bounds with
    numbers, and of attributes with a text or its beginning, that the result is
    filtered by are answered by the source; ``prefixes`` asks for any of several
    beginnings, which Spark does not push down.  Deleted records are left out, a
    record without a shape has null bounds and parts.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LayerSource)
    schema = ["layer string", "record long", *(f"`{c}` string" for c in columns)]
    schema += [f"{b} double" for b in BOUNDS] if with_bounds else []
    schema += [f"parts {_PARTS}"] if geometry else []
    reader = spark.read.format("layers").schema(", ".join(schema)).option("encoding", encoding).option("records", records)
    return reader.option("prefixes", json.dumps(prefixes or {})).load(folder)


def read_shapefile(spark: SparkSession, folder: str, columns: list[str], encoding: str = "cp949", geometry: bool = True) -> DataFrame:
    """:func:`read_layers` without bounds."""
    return read_layers(spark, folder, columns, encoding, geometry, with_bounds=False)


# ---------------------------------------------------------------- writer
def layer_files(rows: list[dict], widths: dict[str, int], kind: int, encoding: str) -> dict[str, bytes]:
    """The three files of a layer; ``rows`` have parts, deleted, and the attributes as text, cut at their widths."""
    shp, shx, dbf = [], [], []
    place = 50
    for number, row in enumerate(rows, start=1):
        body = encoded(row["parts"], kind)
        shp.append(struct.pack(">2i", number, len(body) // 2) + body)
        shx.append(struct.pack(">2i", place, len(body) // 2))
        place += 4 + len(body) // 2
        values = b"".join((row[c] or "").encode(encoding, "replace")[:w].ljust(w) for c, w in widths.items())
        dbf.append((b"*" if row["deleted"] else b" ") + values)
    size, head = 1 + sum(widths.values()), 33 + 32 * len(widths)
    fields = b"".join(c.encode()[:10].ljust(11, b"\0") + b"C" + bytes(4) + bytes([w]) + bytes(15) for c, w in widths.items())
    top = bytes([3, 0, 0, 0]) + struct.pack("<IHH", len(rows), head, size) + bytes(20) + fields + b"\r"

    def main(words: int) -> bytes:
        return struct.pack(">i20xi", 9994, words) + struct.pack("<2i8d", 1000, kind, *(0.0,) * 8)

    return {"shp": main(place) + b"".join(shp), "shx": main(50 + 4 * len(rows)) + b"".join(shx), "dbf": top + b"".join(dbf)}


def write_layers(df: DataFrame, folder: str, widths: dict[str, int], parts: str = "parts", deleted: str | None = None, kind: int = LINE, encoding: str = "cp949") -> int:
    """Write each partition as layers of at most ``LAYER_RECORDS`` records; the number of layers.

    A task writes its files under names of its own and then moves them, so that a
    repeated task replaces them by equal ones.
    """
    import uuid

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        rows, n = [], 0

        def flush() -> None:
            for end, data in layer_files(rows, widths, kind, encoding).items():
                draft = f"{path}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(draft) as out:
                    out.write(data)
                fs.move(draft, f"{path}/layer-{TaskContext.get().partitionId():05d}-{n:05d}.{end}")

        for batch in batches:
            for row in batch.to_pylist():
                points = None if row[parts] is None else [[(p["x"], p["y"]) for p in part] for part in row[parts]]
                rows.append({c: row[c] for c in widths} | {"parts": points, "deleted": bool(deleted and row[deleted])})
                if len(rows) == LAYER_RECORDS:
                    flush()
                    rows, n = [], n + 1
        if rows:
            flush()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return sum(r.n for r in df.mapInArrow(write, "n long").collect())  # a number a task
