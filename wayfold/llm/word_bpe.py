"""BPE ids and decoded texts through a table of distinct words.

1. Each input partition splits its texts into words and writes, chunk by
   chunk, one code a word into a file of the shared folder.  A chunk's words
   leave as one row for each hash bucket, so a word has one bucket.
2. The rows meet by bucket.  There each distinct word of the corpus is encoded
   once, and each chunk gets the ids of its words back in the same order.
3. The replies meet by chunk and are joined to the file's codes by position.
   Decoding joins each id to its piece; the table of pieces has the size of
   the vocabulary.

No row is made for a word's occurrence, and a word that every document holds
is one entry a chunk.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bpe
from wayfold.llm.shared_files import reading, writing
from wayfold.llm.workers import tidy
from wayfold.workspace import Workspace

#: A chunk ends with the document that reaches either number.
CHUNK_WORDS, CHUNK_DISTINCT = 3_000_000, 400_000
#: Words that are encoded at a time.
ENCODE = 20_000

#: Below this code point the library's normalizer is str.lower() and its classes are those of ``regex``.
SAFE_BELOW = 0x250
_UNSAFE = re.compile(f"[^\x00-\x1b{chr(0x20)}-\x84\x86-{chr(0x12F)}{chr(0x131)}-{chr(SAFE_BELOW - 1)}]")


@lru_cache(maxsize=4)
def splitter(path: str) -> WordSplitter:
    return WordSplitter(path)


class WordSplitter:
    """A text's words, as the library's normalizer and pre-tokenizer cut it."""

    def __init__(self, path: str):
        self.tokenizer = bpe.load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            raise ValueError("a tokenizer of lower-cased words is needed")
        self.word = regex.compile(cuts[0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        self.byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}

    def split(self, text: str) -> list[str]:
        if any(s in text for s in self.special):
            return [w for part in self.at_special.split(text) for w in ([part] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() and not _UNSAFE.search(text) or not _UNSAFE.search(text):
            return self.word.findall(text.lower())
        norm = self.tokenizer.normalizer.normalize_str(text)
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(norm)
        return [bytes(self.byte_of[c] for c in piece).decode("utf-8") for piece, _ in cut]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, which the library reads as a text of its own."""
        out = []
        for at in range(0, len(words), ENCODE):
            part = words[at : at + ENCODE]
            out += [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out


class Chunk:
    def __init__(self):
        self.codes: dict[str, int] = {}
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.n_words = 0

    def add(self, doc_id: int | None, words: list[str]) -> None:
        codes = self.codes
        for w in set(words).difference(codes):
            codes[w] = len(codes)
        self.docs.append((doc_id, np.fromiter(map(codes.__getitem__, words), dtype=np.uint32, count=len(words))))
        self.n_words += len(words)

    @property
    def full(self) -> bool:
        return self.n_words >= CHUNK_WORDS or len(self.codes) >= CHUNK_DISTINCT


def write_chunk(chunk: Chunk, folder: str, name: str, n_buckets: int) -> Iterator[tuple]:
    """Write the codes, renumbered in order of (bucket, word); yield (bucket, chunk, words) rows."""
    words = sorted((zlib.crc32(w.encode("utf-8", "surrogatepass")) % n_buckets, w) for w in chunk.codes)
    rank = np.empty(len(words), dtype=np.uint32)
    for i, (_, w) in enumerate(words):
        rank[chunk.codes[w]] = i
    codes = np.concatenate([c for _, c in chunk.docs]) if chunk.docs else np.empty(0, np.uint32)
    codes = rank[codes] if len(rank) else codes
    planes = np.ascontiguousarray(codes.astype("<u4").view("u1").reshape(-1, 4).T)
    with writing(folder, name) as out:
        parts = [
            pa.compress(x, codec="zstd", asbytes=True)
            for x in (
                *(p.tobytes() for p in planes),
                np.array([d or 0 for d, _ in chunk.docs], "<i8").tobytes(),
                np.array([d is None for d, _ in chunk.docs], "u1").tobytes(),
                np.array([len(c) for _, c in chunk.docs], "<i8").tobytes(),
            )
        ]
        out.write(np.array([len(chunk.docs), len(codes), *map(len, parts)], "<i8").tobytes())
        for p in parts:
            out.write(p)
    buckets = np.array([b for b, _ in words], dtype=np.int64)
    edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=n_buckets)) if len(words) else []
    for a, b in zip(edges[:-1], edges[1:]):
        # words hold no white space, so a line end separates them
        yield int(buckets[a]), name, "\n".join(w for _, w in words[a:b])
    yield -1, name, ""  # so that a chunk without words is seen too


def read_chunk(folder: str, name: str) -> tuple[list, np.ndarray, np.ndarray]:
    with reading(folder, name) as f:
        data = f.read()
    n_docs, n_codes, *sizes = np.frombuffer(data[:72], "<i8").tolist()
    at, parts = 72, []
    for size, raw in zip(sizes, [n_codes] * 4 + [8 * n_docs, n_docs, 8 * n_docs]):
        parts.append(pa.decompress(data[at : at + size], decompressed_size=raw, codec="zstd", asbytes=True) if raw else b"")
        at += size
    codes = np.ascontiguousarray(np.stack([np.frombuffer(p, "u1") for p in parts[:4]], axis=1)).view("<u4").reshape(-1)
    doc_ids = [None if n else x for x, n in zip(np.frombuffer(parts[4], "<i8").tolist(), np.frombuffer(parts[5], "u1"))]
    return doc_ids, codes, np.frombuffer(parts[6], "<i8")


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows of sorted batches with one key, in order."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def word_tables(docs: DataFrame, tokenizer: str, folder: str, n_buckets: int | None = None) -> DataFrame:
    """(chunk, bucket, ids): for each chunk the ids of its words, in order of the chunk's codes.

    ``ids`` holds 32-bit integers: the number of words, the number of ids of
    each, and all their ids.
    """
    n_buckets = n_buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    @tidy
    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, chunk, n = splitter(tokenizer), TaskContext.get().partitionId(), Chunk(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(write_chunk(chunk, folder, f"chunk-{part:06d}-{n:06d}", n_buckets))
            for at in range(0, len(rows), 64):
                b, c, w = zip(*rows[at : at + 64])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(c), pa.array(w)], ["bucket", "chunk", "words"])

        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 256):
                for doc_id, text in zip(ids.slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist()):
                    chunk.add(doc_id, cut.split(text or ""))
                    if chunk.full:
                        yield from flush()
                        chunk, n = Chunk(), n + 1
        if chunk.docs:
            yield from flush()

    @tidy
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, now, table = splitter(tokenizer), None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("bucket", "chunk", "words")}
                if row["bucket"] != now:
                    now, table = row["bucket"], {}
                words = row["words"].split("\n") if now >= 0 else []
                new = [w for w in words if w not in table]
                for w, ids in zip(new, run.encode(new)):
                    table[w] = (len(ids), np.array(ids, dtype="<u4").tobytes())
                found = [table[w] for w in words]
                flat = np.array([len(found), *(n for n, _ in found)], dtype="<u4").tobytes() + b"".join(x for _, x in found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]]), pa.array([now], pa.int32()), pa.array([flat], pa.binary())], ["chunk", "bucket", "ids"]
                )

    return (
        docs.select("doc_id", "text")
        .mapInArrow(split, "bucket int, chunk string, words string")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "chunk")
        .mapInArrow(encode, "chunk string, bucket int, ids binary")
    )


def word_bpe(docs: DataFrame, tokenizer: str, with_texts: bool = True) -> DataFrame:
    """Ids and decoded text of each document.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one
    space), decoded_sha256, and with ``with_texts`` also ids (array) and decoded.

    * A null or empty text has no ids and decodes to the empty text.
    * The string of a special token in a text is that token.
    * Rows that repeat a doc_id, or have none, give a row each.
    * A document is encoded by one worker, which holds its codes.
    * Other columns are ignored; an empty table gives an empty result.
    """
    folder = Workspace(docs.sparkSession, "word-bpe").path
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_texts else ""

    @tidy
    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = splitter(tokenizer).tokenizer
        piece = {i: w for w, i in t.get_vocab(with_added_tokens=True).items()}
        decimal = {i: str(i) for i in piece}
        for name, rows in grouped(batches, "chunk"):
            counts, flat = [np.empty(0, "<u4")], [np.empty(0, "<u4")]
            for row in rows:
                x = np.frombuffer(row["ids"], "<u4")
                counts.append(x[1 : 1 + x[0]])
                flat.append(x[1 + x[0] :])
            rows.clear()
            n_ids, ids = np.concatenate(counts).astype(np.int64), np.concatenate(flat).tolist()
            ends = np.cumsum(n_ids).tolist()
            numbers, pieces, start = [], [], 0
            for end in ends:
                word = ids[start:end]
                numbers.append(" ".join([decimal[i] for i in word]))
                pieces.append(" ".join([piece[i] for i in word]))
                start = end
            doc_ids, codes, lengths = read_chunk(folder, name)
            totals = n_ids[codes] if len(codes) else np.empty(0, np.int64)
            sums = np.concatenate([[0], np.cumsum(totals)])
            out, at = [], 0
            for doc_id, length in zip(doc_ids, lengths.tolist()):
                word = codes[at : at + length].tolist()
                text = " ".join(map(numbers.__getitem__, word))
                decoded = " ".join(map(pieces.__getitem__, word))
                row = (doc_id, int(sums[at + length] - sums[at]), _sha(text), _sha(decoded))
                out.append((*row, [int(i) for i in text.split()], decoded) if with_texts else row)
                at += length
                if len(out) == 1024 or with_texts and len(out) == 32:
                    yield _batch(out, with_texts)
                    out = []
            if out:
                yield _batch(out, with_texts)

    replies = word_tables(docs, tokenizer, folder)
    return replies.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(join, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _batch(rows: list[tuple], with_texts: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_texts:
        kinds, names = [*kinds, pa.list_(pa.int32()), pa.string()], [*names, "ids", "decoded"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded texts of all documents; see :func:`word_bpe`."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return word_bpe(docs, public_tokenizers.path("word_bpe_49k.json"), with_texts=False)
