"""Alignment of two tokenizers' tokens, each distinct segment once.

A text is cut before white space, and only before characters at which no entry of
either vocabulary goes on from what is not white space, so no token of either
tokenizer spans a cut.  Tokens and alignment of a text are then those of its
segments in a row.

1. Each input partition cuts its texts and writes, chunk by chunk, one code a
   segment into a file of the shared folder.  A chunk's distinct segments leave
   as one row for each hash bucket.
2. The rows meet by bucket, where each segment is tokenized and aligned once, and
   each chunk gets the alignments of its segments back.
3. The replies meet by chunk and are joined to the codes by position, which gives
   each document's groups and links, and for each pair of ids that some document
   of the chunk links the number of documents.
4. Spark sums the numbers by pair and marks those that are highest for their
   first id; joined back by chunk they give what the documents' links count.

No row is made for a segment's or a link's occurrence.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm import bpe
from wayfold.llm.shared_files import reading, writing
from wayfold.llm.workers import tidy
from wayfold.workspace import Workspace

#: A chunk ends with the document that reaches one of these numbers of segments, or of bytes of its distinct ones.
CHUNK_SEGMENTS, CHUNK_DISTINCT, CHUNK_BYTES = 3_000_000, 400_000, 32 << 20
#: Alignments that a worker keeps, by number and bytes; beyond, it forgets them and makes them again when needed.
MOST_KEPT, MOST_KEPT_BYTES = 300_000, 64 << 20
#: White space before which a text may be cut, if the vocabularies allow it.
CUTS = " \n\t\r"
#: Its piece for a space, and what stands for the byte of a piece of one byte.
MARK, _BYTE = "▁", re.compile(r"<0x([0-9A-F]{2})>")


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = sorted(set(range(256)).difference(printable))
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


def uncrossed(entries: Iterable[bytes], cuts: str = CUTS) -> set[str]:
    """Those of ``cuts`` that follow what is not white space within no entry."""
    left = set(cuts)
    for raw in entries:
        text = raw.decode("utf-8", "surrogateescape")
        left.difference_update(c for before, c in zip(text, text[1:]) if c in left and not before.isspace())
    return left


class Aligner:
    """Both tokenizers, and the characters before which a text may be cut."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] is not None or (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("the first tokenizer must be byte-level, without normalizer or added space")
        self.a = bpe.load(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        probe = "ﬁ①Å  x\n "
        if self.b.normalize(probe) != (MARK + probe).replace(" ", MARK):
            raise ValueError("the second tokenizer must add a space and change nothing else")
        symbols = byte_symbols()
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes_a = {i: t.encode() if t in special else bytes(map(symbols.__getitem__, t)) for t, i in self.a.get_vocab().items()}
        self.bytes_b = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.length_a = {i: len(x) for i, x in self.bytes_a.items()}
        self.length_b = [len(x) for x in self.bytes_b]
        self.mark = self.b.piece_to_id(MARK)
        cuts = uncrossed(self.bytes_b, "".join(sorted(uncrossed(self.bytes_a.values()))))
        # before others than a space the added one must stay a piece of its own
        cuts.difference_update([x[1:2].decode("utf-8", "replace") for x in self.bytes_b if x[:1] == b" " and x[1:2] in (b"\n", b"\t", b"\r")])
        self.cuts = cuts if self.bytes_b[self.mark] == b" " else set()
        inner = f"[^\\S{re.escape(''.join(sorted(self.cuts)))}]"
        self.segment = re.compile(rf"\s*\S*(?:{inner}\s*\S*)*") if self.cuts else re.compile(r".+", re.DOTALL)

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = _BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(MARK, " ").encode()

    def split(self, text: str | None) -> list[str]:
        """The segments of a space and the text; none for an empty text."""
        if not text:
            return []
        found = self.segment.findall(" " + text)
        return found if found[-1] else found[:-1]

    def _encode_b(self, segments: list[str]) -> list[list[int]]:
        """Pieces as they stand within a text; the library puts a space before each text that it gets."""
        # of a segment that begins with a space that one is taken off, before others the added one is dropped again
        found = self.b.encode([s[1:] if s[0] == " " else s for s in segments])
        return [(ids or [self.mark]) if s[0] == " " else ids[1:] for s, ids in zip(segments, found)]

    def align(self, segments: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """For each segment its numbers of tokens, groups and links, the pairs of ids, and the groups as a text.

        The numbers are four 32-bit integers, all ones for a segment that either
        tokenizer does not give back; each link is a pair of 32-bit ids.
        """
        out = []
        all_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)] if segments else []
        for segment, a, b in zip(segments, all_a, self._encode_b(segments)):
            raw = segment.encode()
            if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
                out.append((b"\xff" * 16, b"", b""))
                continue
            end_a, end_b = list(accumulate(map(self.length_a.__getitem__, a))), list(accumulate(map(self.length_b.__getitem__, b)))
            pairs, groups, i, j, from_a, from_b = [], [], 0, 0, 0, 0
            while i < len(a):
                pairs += (a[i], b[j])
                x, y = end_a[i], end_b[j]
                i, j = i + (x <= y), j + (y <= x)
                if x == y:
                    groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                    from_a, from_b = i, j
            numbers = np.array([len(a), len(b), len(groups), len(pairs) // 2], "<u4").tobytes()
            out.append((numbers, np.array(pairs, "<u4").tobytes(), ";".join(groups).encode()))
        return out


@lru_cache(maxsize=4)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# ---------------------------------------------------------------- files and rows
def packed(*arrays: np.ndarray) -> bytes:
    """Arrays, compressed byte plane by byte plane."""
    parts = []
    for x in arrays:
        planes = np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T).tobytes()
        parts += [x.dtype.str.encode().ljust(8), len(x).to_bytes(8, "little")]
        body = pa.compress(planes, codec="zstd", asbytes=True)
        parts += [len(body).to_bytes(8, "little"), body]
    return b"".join(parts)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n = np.dtype(data[at : at + 8].decode().strip()), int.from_bytes(data[at + 8 : at + 16], "little")
        size, at = int.from_bytes(data[at + 16 : at + 24], "little"), at + 24
        planes = pa.decompress(data[at : at + size], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(kind.itemsize, n).T).reshape(-1).view(kind))
        at += size
    return out


def listed(texts: list[bytes]) -> bytes:
    """Texts in a row behind their number and lengths."""
    return np.array([len(texts), *map(len, texts)], "<u4").tobytes() + b"".join(texts)


def unlisted(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


class Chunk:
    """Documents as codes of their segments."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.doc_ids: list[int | None] = []
        self.docs: list[np.ndarray] = []
        self.n = self.n_bytes = 0

    def add(self, doc_id: int | None, segments: list[str]) -> None:
        codes = self.codes
        for s in set(segments).difference(codes):
            codes[s] = len(codes)
            self.n_bytes += len(s)
        self.doc_ids.append(doc_id)
        self.docs.append(np.fromiter(map(codes.__getitem__, segments), dtype="<u4", count=len(segments)))
        self.n += len(segments)

    @property
    def full(self) -> bool:
        return self.n >= CHUNK_SEGMENTS or len(self.codes) >= CHUNK_DISTINCT or self.n_bytes >= CHUNK_BYTES

    def write(self, folder: str, name: str, n_buckets: int) -> Iterator[tuple[int, str, bytes]]:
        """Write the codes, renumbered in order of (bucket, segment); (bucket, chunk, segments) of each bucket."""
        raw = {s: s.encode() for s in self.codes}
        order = sorted((zlib.crc32(r) % n_buckets, r, self.codes[s]) for s, r in raw.items())
        rank = np.empty(len(order), "<u4")
        rank[[code for _, _, code in order]] = np.arange(len(order), dtype="<u4")
        codes = np.concatenate([np.empty(0, "<u4"), *self.docs])
        with writing(folder, name) as out:
            ids = np.array([d or 0 for d in self.doc_ids], "<i8")
            none = np.array([d is None for d in self.doc_ids], "u1")
            out.write(packed(rank[codes] if len(codes) else codes, np.array([len(d) for d in self.docs], "<i8"), ids, none))
        buckets = np.array([b for b, _, _ in order], dtype=np.int64)
        edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=n_buckets)).tolist() if len(order) else []
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(buckets[a]), name, listed([r for _, r, _ in order[a:b]])
        yield -1, name, listed([])  # so that a chunk without segments is seen too


def read_codes(folder: str, name: str) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, number of segments of each, codes)."""
    with reading(folder, name) as f:
        codes, sizes, ids, none = unpacked(f.read())
    return [None if x else i for i, x in zip(ids.tolist(), none.tolist())], sizes, codes


def by_chunk(batches: Iterable[pa.RecordBatch], key: str = "chunk") -> Iterator[tuple[str, list[pa.RecordBatch]]]:
    """The slices of sorted batches that belong to one chunk."""
    now, held = None, []
    for batch in batches:
        names = batch.column(key).to_pylist() if batch.num_rows else []
        at = 0
        while at < len(names):
            end = at + 1
            while end < len(names) and names[end] == names[at]:
                end += 1
            if held and names[at] != now:
                yield now, held
                held = []
            now = names[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield now, held


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all members of runs that begin at ``starts``."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over stretches of the given sizes."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


# ---------------------------------------------------------------- operator
class Alignment:
    """The alignment of one table.

    ``docs`` is read once, and a task that is repeated must read the same rows in
    the same order, as those of a table do.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, n_buckets: int | None = None):
        self.spark, self.paths, self.with_groups = docs.sparkSession, (path_a, path_b), with_groups
        self.work = Workspace(self.spark, "alignment")
        self.codes, self.parts = self.work.folder("codes"), self.work.folder("parts")
        self.n_buckets = n_buckets or 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.local = self.work.table(self._local(self._aligned(docs)), "local")
        self.counts = self.work.table(self._counts(), "counts")

    def _aligned(self, docs: DataFrame) -> DataFrame:
        """(chunk, bucket, reply): the alignments of the chunk's segments of the bucket, in order of their codes."""
        paths, folder, n_buckets = self.paths, self.codes, self.n_buckets

        @tidy
        def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cut, part, chunk, n = aligner(*paths).split, TaskContext.get().partitionId(), Chunk(), 0

            def flush() -> Iterator[pa.RecordBatch]:
                rows = list(chunk.write(folder, f"{part:06d}-{n:06d}", n_buckets))
                for at in range(0, len(rows), 64):
                    b, c, s = zip(*rows[at : at + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c), pa.array(s, pa.binary())], ["bucket", "chunk", "segments"])

            for batch in batches:
                ids, texts = batch.column("doc_id"), batch.column("text")
                for at in range(0, batch.num_rows, 256):
                    for doc_id, text in zip(ids.slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist()):
                        chunk.add(doc_id, cut(text))
                        if chunk.full:
                            yield from flush()
                            chunk, n = Chunk(), n + 1
            if chunk.docs:
                yield from flush()

        @tidy
        def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run, now, kept, size = aligner(*paths), None, {}, 0
            for batch in batches:
                for i in range(batch.num_rows):
                    bucket, chunk, segments = (batch.column(c)[i].as_py() for c in ("bucket", "chunk", "segments"))
                    segments = unlisted(segments)
                    if bucket != now or len(kept) > MOST_KEPT or size > MOST_KEPT_BYTES:
                        now, kept, size = bucket, {}, 0
                    new = [s for s in segments if s not in kept]
                    for s, found in zip(new, run.align([s.decode() for s in new])):
                        kept[s] = found
                        size += len(s) + sum(map(len, found))
                    numbers, pairs, groups = zip(*map(kept.__getitem__, segments)) if segments else ((), (), ())
                    reply = listed([b"".join(numbers), b"".join(pairs), listed(list(groups))])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), pa.array([bucket], pa.int32()), pa.array([reply], pa.binary())], ["chunk", "bucket", "reply"]
                    )

        return (
            docs.select("doc_id", "text")
            .mapInArrow(split, "bucket int, chunk string, segments binary")
            .repartition("bucket")
            .sortWithinPartitions("bucket", "chunk")
            .mapInArrow(align, "chunk string, bucket int, reply binary")
        )

    def _local(self, aligned: DataFrame) -> DataFrame:
        """(chunk, place, a, b, n): documents of the chunk that link two ids; place -1 stands for the chunk itself."""
        codes_in, parts_in, with_groups = self.codes, self.parts, self.with_groups

        @tidy
        def compose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, rows in by_chunk(batches):
                numbers, links, groups = [np.empty((0, 4), "<u4")], [np.empty(0, "<u8")], []
                for batch in rows:
                    for reply in batch.column("reply"):
                        x, y, z = unlisted(reply.as_py())
                        numbers.append(np.frombuffer(x, "<u4").reshape(-1, 4))
                        links.append(np.frombuffer(y, "<u8"))
                        groups += unlisted(z)
                rows.clear()
                numbers, links = np.concatenate(numbers).astype(np.int64), np.concatenate(links)
                bad = numbers[:, 0] == 0xFFFFFFFF
                numbers[bad] = 0
                pairs, link = np.unique(links, return_inverse=True)  # a in the lower half, b in the upper
                starts = np.cumsum(numbers[:, 3]) - numbers[:, 3]
                doc_ids, sizes, codes = read_codes(codes_in, name)
                broken = sums(bad[codes], sizes) > 0
                held, digests, at = np.zeros(len(pairs), np.int64), [], 0
                for size, no_tokens in zip(sizes.tolist(), broken.tolist()):
                    own = codes[at : at + size]
                    at += size
                    if no_tokens or not size:
                        digests.append("")
                        continue
                    digests.append(hashlib.sha256(b";".join(map(groups.__getitem__, own.tolist()))).hexdigest())
                    own = np.unique(own)
                    held[np.unique(link[spread(starts[own], numbers[own, 3])])] += 1
                with writing(parts_in, name) as out:
                    out.write(packed(link.astype("<u4"), *(np.ascontiguousarray(c) for c in numbers.T.astype("<i8")), broken.astype("u1")))
                with writing(parts_in, f"{name}-texts") as out:
                    out.write(listed([x.encode() for x in digests]) + (listed(groups) if with_groups else b""))
                for start in range(-1, len(pairs), 1 << 16):
                    at = np.arange(start, min(start + (1 << 16), len(pairs)))
                    of = pairs[np.maximum(at, 0)] if len(pairs) else np.zeros(len(at), "<u8")
                    none = at < 0
                    a, b = np.where(none, -1, (of & 0xFFFFFFFF).astype(np.int64)), np.where(none, -1, (of >> np.uint64(32)).astype(np.int64))
                    n = np.where(none, 0, held[np.maximum(at, 0)] if len(held) else 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n, pa.int64())],
                        ["chunk", "place", "a", "b", "n"],
                    )

        replies = aligned.repartition("chunk").sortWithinPartitions("chunk", "bucket")
        return replies.mapInArrow(compose, "chunk string, place int, a int, b int, n long")

    def _counts(self) -> DataFrame:
        """(a, b, n, best): documents that link two ids, and whether no other b has more; an a has no more b than the second vocabulary."""
        total = self.local.groupBy("a", "b").agg(F.sum("n").alias("n"))
        return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))

    def pairs(self) -> DataFrame:
        """(a, b, n_docs, best) of every pair of ids that some document links."""
        return self.counts.filter("a >= 0 AND n > 0").withColumnRenamed("n", "n_docs")

    def documents(self) -> DataFrame:
        """The result a document; see :func:`align`."""
        codes_in, parts_in, with_groups = self.codes, self.parts, self.with_groups
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        schema = ", ".join(f"{c} long" for c in names[:-1]) + ", groups_sha256 string"
        schema, names = (schema + ", groups string", [*names, "groups"]) if with_groups else (schema, names)

        @tidy
        def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, rows in by_chunk(batches):
                n, best = (np.concatenate([b.column(c).cast(pa.int64()).to_numpy() for b in rows])[1:] for c in ("n", "best"))
                with reading(parts_in, name) as f:
                    link, n_a, n_b, n_groups, n_links, broken = unpacked(f.read())
                doc_ids, sizes, codes = read_codes(codes_in, name)
                with reading(parts_in, f"{name}-texts") as f:
                    raw = f.read()
                digests = [x.decode() for x in unlisted(raw)]
                found = [sums(x[codes], sizes) for x in (n_a, n_b, n_groups, n_links, sums(best[link], n_links), sums(n[link], n_links))]
                for x in found:
                    x[broken == 1] = 0
                columns = [pa.array(doc_ids, pa.int64()), *map(pa.array, found), pa.array(digests, pa.string())]
                if not with_groups:
                    yield pa.RecordBatch.from_arrays(columns, names)
                    continue
                groups = unlisted(raw[4 + 4 * len(digests) + sum(map(len, digests)) :])
                ends = np.cumsum(sizes)
                for at in range(0, len(doc_ids), 64):
                    span = range(at, min(at + 64, len(doc_ids)))
                    own = [b"" if broken[i] else b";".join(map(groups.__getitem__, codes[ends[i] - sizes[i] : ends[i]].tolist())) for i in span]
                    part = [c.slice(at, len(span)) for c in columns]
                    yield pa.RecordBatch.from_arrays([*part, pa.array([x.decode() for x in own], pa.string())], names)

        counted = self.local.drop("n").join(self.counts, ["a", "b"]).select("chunk", "place", "n", "best")
        return counted.repartition("chunk").sortWithinPartitions("chunk", "place").mapInArrow(finish, schema)


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Tokens, groups and links of each document, and what its links count in all of them.

    ``path_a`` is a byte-level tokenizer of the tokenizers library, which gets a space
    and the text, ``path_b`` a model of sentencepiece, which adds the space itself.
    Strings of special tokens are plain text.

    Columns: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    and with ``with_groups`` the groups as text.

    * A null or empty text, and one that either tokenizer does not give back byte by
      byte, has no tokens: zeros and an empty digest; it counts for no pair.
    * Rows that repeat a doc_id, or have none, are documents of their own.
    * Other columns are ignored; an empty table gives an empty result.
    * A document is put together by one worker, which holds its codes.
    """
    return Alignment(docs, path_a, path_b, with_groups).documents()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of all documents under two public tokenizers; see :func:`align`."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
