"""Harmonic packing of documents into sequences.

A piece of n tokens belongs to class k = capacity // n, and a bin of class k
takes exactly k pieces.  Of a document the whole sequences are cut off first;
what is left, under ``capacity`` tokens, goes whole to its class.  The room that
k pieces leave in a bin, under capacity / (k + 1), is filled with the next
tokens of one document that is cut for this, the filler.  Each worker fills
its classes' bins independently and holds fewer than k pieces of class k.

The open bins of ``GATHER`` workers, which are few whatever the workers have
read, meet in one task, which packs them by the same classes.  What is left
there is laid end to end and cut at the capacity; the last stretch becomes
sequences of its powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import bpe
from wayfold.llm.workers import tidy
from wayfold.workspace import Workspace

CAPACITY = 2048
#: Sequences that one worker may number; workers whose open bins meet in one task.
NUMBERS, GATHER = 1 << 40, 64

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ROWS = 4096
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class HarmonicPacker:
    """One worker's bins.  A piece is (doc_id, start, length, ids, tokens of its document)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.bins: dict[int, list] = {}
        self.filler: list[tuple] = []
        self.filling = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        at = 0
        while n - at >= self.capacity:
            self._sequence([(doc_id, at, self.capacity, ids[4 * at : 4 * (at + self.capacity)], n)])
            at += self.capacity
        if at < n:
            self.place((doc_id, at, n - at, ids[4 * at :], n))

    def place(self, piece: tuple) -> None:
        """A piece shorter than a sequence: whole to its class, or to the filler if a bin's room might outlast it."""
        if self.filling < self.capacity // 2:
            self.filler.append(piece)
            self.filling += piece[2]
            return
        k = self.capacity // piece[2]
        held = self.bins.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            del self.bins[k]
            self._sequence(held + self._fill(self.capacity - sum(p[2] for p in held)))

    def _fill(self, room: int) -> list[tuple]:
        """Pieces of ``room`` tokens; the filler has as many."""
        taken = []
        self.filling -= room
        while room:
            head, rest = self._split(self.filler.pop(), room)
            if rest:
                self.filler.append(rest)
            taken.append(head)
            room -= head[2]
        return taken

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.out.append((*piece, self.sequence, offset))
            offset += piece[2]
        self.sequence += 1

    def open(self) -> list[tuple]:
        """The pieces that are in no sequence yet, in order of class."""
        left = [p for k in sorted(self.bins) for p in self.bins[k]] + self.filler[::-1]
        self.bins, self.filler, self.filling = {}, [], 0
        return left

    def finish(self) -> None:
        """Lay all open pieces end to end."""
        left = self.open()
        total, filled = sum(p[2] for p in left), 0
        room, now = 0, []
        for piece in left:
            while piece is not None:
                if not room:
                    if now:
                        self._sequence(now)
                    rest = total - filled
                    room, now = self.capacity if rest >= self.capacity else 1 << (rest.bit_length() - 1), []
                head, piece = self._split(piece, room)
                now.append(head)
                room, filled = room - head[2], filled + head[2]
        if now:
            self._sequence(now)

    @staticmethod
    def _split(piece: tuple, room: int) -> tuple[tuple, tuple | None]:
        doc_id, start, length, ids, n = piece
        if length <= room:
            return piece, None
        return (doc_id, start, room, ids[: 4 * room], n), (doc_id, start + room, length - room, ids[4 * room :], n)

    def take(self) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.out)
        self.out = []


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + ROWS]), _KINDS)], names=_NAMES)


def fill_bins(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Rows of :data:`SCHEMA`; open pieces have no offset, and their worker's number as sequence_id."""

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4").tobytes()
        worker = TaskContext.get().partitionId()
        packer = HarmonicPacker(capacity, worker * NUMBERS)
        for doc_ids, encoded in bpe.encode_documents(batches, tokenizer):
            for doc_id, ids in zip(doc_ids, encoded):
                packer.add(doc_id, ids.astype("<u4").tobytes() + end)
            if len(packer.out) >= ROWS:
                yield from packer.take()
        yield from packer.take()
        yield from _batches([(*piece, worker, None) for piece in packer.open()])

    return docs.select("doc_id", "text").mapInArrow(work, SCHEMA)


def gather_bins(open_pieces: DataFrame, capacity: int) -> DataFrame:
    """The sequences of what the workers have left open."""

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("grp", *_NAMES[:5])))
            for group, *piece in columns:
                if group != now:
                    if packer:
                        packer.finish()
                        yield from packer.take()
                    now, packer = group, HarmonicPacker(capacity, (1 << 62) + group * NUMBERS)
                packer.place(tuple(piece))
            yield from packer.take()
        if packer:
            packer.finish()
            yield from packer.take()

    grouped = open_pieces.withColumn("grp", F.floor(F.col("sequence_id") / GATHER))
    ordered = grouped.repartition("grp").sortWithinPartitions("grp", "sequence_id", "doc_id", "start", "ids")
    return ordered.mapInArrow(work, SCHEMA)


def harmonic_pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents, each with its ids and its place in a sequence.

    ``ids`` are little-endian unsigned 32-bit integers.  A sequence is its
    pieces in order of ``offset``, padded to ``capacity`` unless its length is a
    power of two.

    * Each document ends with ``end_id``; a null or empty text has it alone.
    * Rows that repeat a doc_id, or have none, are packed each for itself.
    * ``capacity`` is a power of two.  Other columns are ignored; an empty
      table gives an empty result.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    work = Workspace(docs.sparkSession, "packing")
    placed = work.table(fill_bins(docs, tokenizer, end_id, capacity), "bins")
    return placed.filter("offset IS NOT NULL").unionByName(gather_bins(placed.filter("offset IS NULL"), capacity))


def packed_digests(pieces: DataFrame) -> DataFrame:
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with checksums of their ids; see :func:`harmonic_pack`."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_digests(harmonic_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1))
