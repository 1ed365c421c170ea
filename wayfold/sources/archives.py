"""CSV members of ZIP archives as a Spark data source.

Only an archive's directory is read to plan, one task for each member; a member is
decompressed and decoded as a stream, so neither it nor its archive is ever whole
in memory.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import sys
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from wayfold.sources.shapefile import _store

BATCH, BLOCK = 4096, 1 << 20


@dataclass
class Member(ds.InputPartition):
    archive: str
    name: str


class MemberReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        self.header, self.every = options.get("header", "true") == "true", options.get("members", "first") == "all"
        self.encoding = options.get("encoding", "")

    def partitions(self) -> list[Member]:
        fs, path = _store(self.path)
        folder, _, pattern = path.rpartition("/")
        if "*" not in pattern and fs.get_file_info(path).type == pafs.FileType.Directory:
            folder, pattern = path, "*.zip"
        found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and fnmatch.fnmatch(f.base_name, pattern))
        out = []
        for archive in found:
            with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                names = [i.filename for i in z.infolist() if not i.is_dir()]
            out += [Member(archive, n) for n in (names if self.every else names[:1])]
        return out or [Member("", "")]

    def read(self, at: Member) -> Iterator[pa.RecordBatch]:
        if not at.archive:
            return
        fs, _ = _store(self.path)
        csv.field_size_limit(sys.maxsize)
        with fs.open_input_file(at.archive) as f, zipfile.ZipFile(f) as z:
            with z.open(at.name) as raw:
                marked = raw.read(3) == b"\xef\xbb\xbf"
            with z.open(at.name) as raw:
                encoding = self.encoding or ("utf-8-sig" if marked else "cp949")
                lines = csv.reader(io.TextIOWrapper(io.BufferedReader(raw, BLOCK), encoding=encoding, errors="replace", newline=""))
                yield from self._rows(lines)

    def _rows(self, lines: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        place = {n: i for i, n in enumerate(self.names)}
        if self.header:
            place = {n: i for i, n in enumerate(next(lines, []))}
        at, rows = [place.get(n) for n in self.names], []
        for row in lines:
            if not row:
                continue
            rows.append([row[i] if i is not None and i < len(row) and row[i] != "" else None for i in at])
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], self.names)


class ArchiveSource(ds.DataSource):
    """``spark.read.format("zipped_csv")`` with a schema of texts."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        raise ValueError("a schema of texts is needed")

    def reader(self, schema: StructType) -> MemberReader:
        return MemberReader(schema, self.options)


def read_zipped_csv(spark: SparkSession, path: str, schema: str, header: bool = True, members: str = "first", encoding: str = "") -> DataFrame:
    """CSV in ZIP archives: the first member of each, or ``members="all"`` of them, as texts.

    ``path`` is an archive, a folder of them, or a folder and a pattern.  Without
    ``encoding`` a member is UTF-8 if it starts with a byte-order mark, else cp949;
    bad bytes are replaced.  Empty fields, and columns that a member lacks, are null;
    blank lines are skipped.
    """
    spark.dataSource.register(ArchiveSource)
    columns = spark.createDataFrame([], schema).columns
    reader = spark.read.format("zipped_csv").schema(", ".join(f"`{c}` string" for c in columns))
    return reader.option("header", str(header).lower()).option("members", members).option("encoding", encoding).load(path)


def write_zipped_csv(df: DataFrame, folder: str, rows_a_member: int = 1_000_000, encoding: str = "cp949") -> int:
    """Each partition as an archive of CSV members with a header; the number of archives.

    A member is compressed as a stream.  A task writes under a name of its own and
    then moves the archive, so that a repeated task replaces it by an equal one.
    """
    columns = df.columns

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(folder)
        fs.create_dir(path, recursive=True)
        draft, n = f"{path}/_{uuid.uuid4().hex}", 0
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns)))
        with fs.open_output_stream(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for first in rows:
                # a fixed time, so that a repeated task writes the same bytes
                with z.open(zipfile.ZipInfo(f"part-{n:05d}.csv"), "w") as raw, io.TextIOWrapper(raw, encoding, errors="replace", newline="") as text:
                    lines = csv.writer(text)
                    lines.writerow(columns)
                    lines.writerows(chain([first], islice(rows, rows_a_member - 1)))
                n += 1
        if n:
            fs.move(draft, f"{path}/part-{TaskContext.get().partitionId():05d}.zip")
        else:
            fs.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([int(n > 0)], pa.int64())], ["n"])

    return sum(r.n for r in df.mapInArrow(write, "n long").collect())  # a number a task
