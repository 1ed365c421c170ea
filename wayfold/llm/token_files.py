"""Token ids in files of fixed-width bit packing.

An id takes the minimum bits of its vocabulary.  Ids lie in blocks of
``BLOCK`` ids; 64 ids fill ``width`` whole 64-bit words, so numpy packs and
unpacks a block column by column, and any span of ids is read without its
neighbours.  A file is

    blocks | block offsets (u64) | doc ids (i64) | null flags (u8) | ends of documents (u64) | trailer

with the trailer naming the number of blocks, documents and ids, the width
and the block size.  Files are ranges of doc_id: reading them by name gives
all documents in ascending order of doc_id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe
from wayfold.llm.shared_files import reading, writing
from wayfold.llm.workers import tidy
from wayfold.workspace import Workspace

BLOCK = 65_536
TRAILER = struct.Struct("<QQQII8s")
MAGIC = b"WFTOKEN1"
#: Ids that a reader holds at a time.
SPAN = 1 << 18


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Whole groups of 64 ids as ``width`` little-endian words each; the last is filled with zeros."""
    groups = -(-len(ids) // 64)
    column = np.zeros(groups * 64, dtype="<u8")
    column[: len(ids)] = ids
    column = np.ascontiguousarray(column.reshape(groups, 64).T)
    words = np.zeros((width, groups), dtype="<u8")
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[at] |= column[j] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= column[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.frombuffer(data, dtype="<u8").reshape(-1, width).T)
    out = np.empty((64, words.shape[1]), dtype="<u4")
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        x = words[at] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[at + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return np.ascontiguousarray(out.T).reshape(-1)


class TokenFileWriter:
    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets, self.at = [0], 0
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.ends.append(self.n_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            whole = len(flat) // BLOCK * BLOCK
            for start in range(0, whole, BLOCK):
                self._block(flat[start : start + BLOCK])
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.stream.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def finish(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        for values, kind in (
            (self.offsets, "<u8"),
            ([x or 0 for x in self.doc_ids], "<i8"),
            ([x is None for x in self.doc_ids], "u1"),
            (self.ends, "<u8"),
        ):
            self.stream.write(np.array(values, dtype=kind).tobytes())
        self.stream.write(TRAILER.pack(len(self.offsets) - 1, len(self.ends), self.n_ids, self.width, BLOCK, MAGIC))


class TokenFileReader:
    """Random access to the documents and ids of one file."""

    def __init__(self, f):
        self.f = f
        size = f.size()
        self.n_blocks, self.n_docs, self.n_ids, self.width, self.block, magic = TRAILER.unpack(
            f.read_at(TRAILER.size, size - TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = size - TRAILER.size - 17 * self.n_docs - 8 * (self.n_blocks + 1)

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(f.read_at(n * np.dtype(kind).itemsize, at), dtype=kind)
            at += x.nbytes
            return x

        self.offsets = take(self.n_blocks + 1, "<u8")
        doc_ids = take(self.n_docs, "<i8")
        null = take(self.n_docs, "u1")
        self.ends = take(self.n_docs, "<u8").astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.doc_ids = [None if n else int(x) for x, n in zip(doc_ids, null)]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their groups are read."""
        parts = []
        while start < stop:
            b, within = divmod(start, self.block)
            upto = min(stop - b * self.block, self.block)
            first, last = within // 64, -(-upto // 64)
            step = 8 * self.width
            data = self.f.read_at((last - first) * step, int(self.offsets[b]) + first * step)
            parts.append(unpack(data, self.width)[within - first * 64 : upto - first * 64])
            start = b * self.block + upto
        return np.concatenate(parts) if parts else np.empty(0, dtype="<u4")

    def documents(self) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        """(number, parts of its ids) of each document, reading about SPAN ids at a time."""
        i = 0
        while i < self.n_docs:
            j = int(np.searchsorted(self.ends, self.starts[i] + SPAN, side="right"))
            if j <= i:
                a, b = int(self.starts[i]), int(self.ends[i])
                yield i, (self.read(x, min(x + SPAN, b)) for x in range(a, b, SPAN))
                i += 1
                continue
            base = int(self.starts[i])
            flat = self.read(base, int(self.ends[j - 1]))
            for k in range(i, j):
                yield k, iter([flat[self.starts[k] - base : self.ends[k] - base]])
            i = j


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> list[dict]:
    """Encode each document, end it with ``end_id``, and write files in ascending order of doc_id.

    Returns one entry for each file, in order: name, n_docs, n_ids and base,
    the number of ids in all files before it.  Only these entries reach the
    driver, one for each partition.

    * A null text is empty; it has the end id alone.
    * Rows without a doc_id come first.  Rows that repeat a doc_id are written
      each, in order of a hash of their text.
    * An empty table gives no files.  Other columns are ignored.
    """

    @tidy
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, name = None, f"part-{TaskContext.get().partitionId():06d}.tokens"
        groups = bpe.encode_documents(batches, tokenizer)
        first = next(groups, None)
        if first is None:
            return
        end = np.array([end_id], dtype="<u4")
        width = bits_for(max(bpe.encoder(tokenizer).vocabulary_size, end_id + 1))
        with writing(folder, name) as out:
            w = TokenFileWriter(out, width)
            while first is not None:
                for doc_id, ids in zip(*first):
                    w.add(doc_id, np.concatenate([ids, end]))
                first = next(groups, None)
            w.finish()
        yield pa.RecordBatch.from_pydict({"name": [name], "n_docs": [len(w.ends)], "n_ids": [w.n_ids]})

    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    written = (
        docs.select("doc_id", "text")
        .repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(write, "name string, n_docs long, n_ids long")
    )
    files, base = [], 0
    for row in sorted(written.collect()):  # one row a file
        files.append(row.asDict() | {"base": base})
        base += row.n_ids
    return files


def read_token_files(spark: SparkSession, folder: str, files: list[dict]) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    @tidy
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                with reading(folder, name) as f:
                    r = TokenFileReader(f)
                    crcs = np.zeros(r.n_docs, dtype=np.int64)
                    for i, parts in r.documents():
                        crc = 0
                        for part in parts:
                            crc = zlib.crc32(np.ascontiguousarray(part, dtype="<u4"), crc)
                        crcs[i] = crc
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_ids, pa.int64()), pa.array(r.starts + base), pa.array(r.ends - r.starts), pa.array(crcs)],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    if not files:
        return spark.createDataFrame([], schema)
    listing = spark.createDataFrame([(f["name"], f["base"]) for f in files], "name string, base long")
    return listing.repartition(len(files)).mapInArrow(read, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and checksums of all documents, read back from their token files; see :func:`write_token_files`."""
    import public_tokenizers

    folder = Workspace(spark, "token-files").path
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, folder, files)
