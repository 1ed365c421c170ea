"""Byte-pair ids by the tokenizers library, encoding each distinct chunk once.

A byte-level tokenizer cuts a text with a fixed pattern before it merges
bytes.  In a text without two neighbouring white-space characters a piece
always begins at a space, at a line end, after a line end, and where ASCII
punctuation follows an ASCII letter.  Such a text is cut there, and its ids are
the ids of its chunks in a row.  Every other text, and any text that holds the
string of a special token, is given to the library whole.

Chunks are cut and looked up with numpy, over the bytes of many texts at once:
a chunk is found by a 64-bit hash and confirmed by its bytes, and the library
encodes those that are not known yet.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfold.llm.spans import LONG, head, lanes, span_hash, text_bytes

#: Chunks after which a worker forgets them; this only costs encoding them again.
MOST_CHUNKS = 600_000
#: Bytes that are cut at a time; a text with more is given to the library whole.
BLOCK_BYTES = 1 << 19
#: Documents, and new chunks, that are encoded at a time.
BLOCK_DOCS, BLOCK_CHUNKS = 512, 4096

_ENCODERS: dict[str, ChunkEncoder] = {}


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file; what it knows outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


class ChunkTable:
    """Open addressing from a chunk, known by its hash and its bytes, to a run of ids."""

    def __init__(self, most: int):
        self.size = 1 << max(10, (2 * most - 1).bit_length())
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.size, dtype=np.uint64)
        self.entry = np.zeros(self.size, dtype=np.int32)
        self.n = self.n_ids = self.n_bytes = 0
        self.at = np.empty(1024, dtype=np.int64)
        self.bytes = np.empty(1024, dtype=np.int64)
        self.start = np.empty(1024, dtype=np.int64)
        self.length = np.empty(1024, dtype=np.int32)
        self.ids = np.empty(4096, dtype=np.uint32)
        self.pool = np.zeros(8192, dtype=np.uint8)

    def _same(self, entry: np.ndarray, data: np.ndarray, view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each entry's bytes are those of the span beside it."""
        same = self.bytes[entry] == sizes
        pool = np.ndarray(len(self.pool) - 7, dtype="<u8", buffer=self.pool, strides=(1,))
        rest = np.flatnonzero(same & (sizes <= LONG))
        here, there, left = starts[rest], self.at[entry[rest]], sizes[rest]
        while len(rest):
            equal = head(view, here, left) == head(pool, there, left)
            same[rest[~equal]] = False
            go = equal & (left > 8)
            rest, here, there, left = rest[go], here[go] + 8, there[go] + 8, left[go] - 8
        for i in np.flatnonzero(same & (sizes > LONG)).tolist():
            a, b, n = int(starts[i]), int(self.at[entry[i]]), int(sizes[i])
            same[i] = np.array_equal(data[a : a + n], self.pool[b : b + n])
        return same

    def find(self, key: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entries of the spans with these keys, -1 where there is none."""
        view, sizes = lanes(data), ends - starts
        found = np.full(len(key), -1, dtype=np.int64)
        left = np.arange(len(key))
        slot = (key & np.uint64(self.size - 1)).astype(np.int64)
        while len(left):
            held = self.key[slot]
            hit = np.flatnonzero(held == key[left])
            same = np.zeros(len(left), dtype=bool)
            same[hit] = self._same(self.entry[slot[hit]], data, view, starts[left[hit]], sizes[left[hit]])
            found[left[same]] = self.entry[slot[same]]
            go = ~same & (held != 0)
            left, slot = left[go], (slot[go] + 1) & (self.size - 1)
        return found

    def add(self, key: np.ndarray, chunks: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Chunks that are not in the table, of distinct keys; the table has room for them."""
        raw = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        sizes = np.array([len(c) for c in chunks], dtype=np.int64)
        n, n_ids, n_bytes = self.n + len(key), self.n_ids + len(ids), self.n_bytes + len(raw)
        for name, need in (("at", n), ("bytes", n), ("start", n), ("length", n), ("ids", n_ids), ("pool", n_bytes + 8)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), dtype=old.dtype)]))
        at = slice(self.n, n)
        self.bytes[at], self.length[at] = sizes, lengths
        self.at[at] = self.n_bytes + np.cumsum(sizes) - sizes
        self.start[at] = self.n_ids + np.cumsum(lengths) - lengths
        self.ids[self.n_ids : n_ids] = ids
        self.pool[self.n_bytes : n_bytes] = raw
        number = np.arange(self.n, n, dtype=np.int32)
        slot = (key & np.uint64(self.size - 1)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = np.flatnonzero(self.key[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key[slot[put]], self.entry[slot[put]] = key[left[put]], number[left[put]]
            rest = np.ones(len(left), dtype=bool)
            rest[put] = False
            left, slot = left[rest], (slot[rest] + 1) & (self.size - 1)
        self.n, self.n_ids, self.n_bytes = n, n_ids, n_bytes

    def runs(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries in a row, and the number of each."""
        lengths = self.length[entries].astype(np.int64)
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[entries] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.ids[at], lengths


class ChunkEncoder:
    """Texts to ids."""

    def __init__(self, path: str, most: int = MOST_CHUNKS):
        self.tokenizer = load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        cut = spec["pre_tokenizer"] or {}
        self.can_cut = (
            spec["normalizer"] is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and (cut.get("type"), cut.get("use_regex"), cut.get("add_prefix_space")) == ("ByteLevel", True, False)
        )
        self.vocabulary_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.table = ChunkTable(most)
        kind = np.zeros(256, dtype=np.uint8)
        letters = [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]
        space = [*range(0x09, 0x0E), *range(0x1C, 0x21)]
        marks = [c for c in range(0x21, 0x7F) if c not in letters and not 0x30 <= c <= 0x39]
        kind[letters], kind[space], kind[marks] = 1, 2, 3
        kind[[0xC2, 0xE1, 0xE2, 0xE3]] = 4  # may begin a white-space character
        self.kind = kind

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, data: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts can't be cut."""
        odd = np.zeros(len(bounds), dtype=bool)  # one more than there are texts
        white = kind == 2
        at = np.flatnonzero(kind == 4)
        if len(at):
            padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint32)
            a, b, c = padded[at], padded[at + 1], padded[at + 2]
            wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
            three = a << 16 | b << 8 | c
            wide |= (three == 0xE19A80) | (three >= 0xE28080) & (three <= 0xE2808A) | (three == 0xE38080)
            wide |= np.isin(three, [0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F])
            odd[np.searchsorted(bounds, at[wide], side="right") - 1] = True
        twice = np.flatnonzero(white[1:] & white[:-1]) + 1
        odd[np.searchsorted(bounds, twice, side="right") - 1] = True
        raw = data.tobytes()
        for s in self.special:
            x = raw.find(s)
            while x >= 0:
                odd[np.searchsorted(bounds, x, side="right") - 1] = True
                x = raw.find(s, x + 1)
        return odd[:-1]

    def encode_block(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts between ``bounds``, at most BLOCK_BYTES together."""
        n = len(bounds) - 1
        kind = self.kind[data]
        whole = self._whole(data, kind, bounds) if self.can_cut else np.ones(n, dtype=bool)
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            line = data == 0x0A
            cut[:-1] = line | (data == 0x20)
            cut[1:] |= line
            cut[1:-1] |= (kind[1:] == 3) & (kind[:-1] == 1)
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        text = np.searchsorted(bounds, starts, side="right") - 1
        ours = ~whole[text]
        starts, ends, text = starts[ours], ends[ours], text[ours]
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * n
        if len(starts):
            key = span_hash(data, starts, ends)
            key[key == 0] = 1
            entries = self.table.find(key, data, starts, ends)
            while (entries < 0).any():  # again only for chunks that share a hash
                entries = self._learn(data, starts, ends, key, entries)
            ids, lengths = self.table.runs(entries)
            after = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(text, np.arange(n + 1))].tolist()
            for i, (a, b) in enumerate(zip(after[:-1], after[1:])):
                out[i] = ids[a:b]
        at = np.flatnonzero(whole).tolist()
        for i, ids in zip(at, self._library([data[bounds[i] : bounds[i + 1]].tobytes().decode() for i in at])) if at else ():
            out[i] = ids
        return out

    def _learn(self, data, starts, ends, key, entries) -> np.ndarray:
        """Encode one new chunk of each hash; the entries of all."""
        new = np.flatnonzero(entries < 0)
        new = new[np.unique(key[new], return_index=True)[1]]
        if self.table.n + len(new) > self.table.most:
            self.table.clear()
            entries = np.full(len(key), -1, dtype=np.int64)
            new = np.unique(key, return_index=True)[1]
        raw = data.tobytes()
        for at in range(0, len(new), BLOCK_CHUNKS):
            part = new[at : at + BLOCK_CHUNKS]
            chunks = [raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
            lengths = np.array([len(x) for x in found], dtype=np.int64)
            flat = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(lengths.sum()))
            self.table.add(key[part], chunks, flat, lengths)
        open_ = np.flatnonzero(entries < 0)
        entries[open_] = self.table.find(key[open_], data, starts[open_], ends[open_])
        return entries

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null is an empty text."""
        n = len(texts)
        data, bounds = text_bytes(texts)
        out: list[np.ndarray] = []
        at = 0
        while at < n:
            to = int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, side="right")) - 1
            if to <= at:  # a text beyond the block
                out += self._library([data[bounds[at] : bounds[at + 1]].tobytes().decode()])
                to = at + 1
            else:
                out += self.encode_block(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
            at = to
        return out


def encode_documents(batches: Iterable, path: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc_ids, ids) of Arrow batches with the columns doc_id and text, a few at a time."""
    run = encoder(path)
    for batch in batches:
        ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
        for at in range(0, batch.num_rows, BLOCK_DOCS):
            yield ids.slice(at, BLOCK_DOCS).to_pylist(), run.encode(texts.slice(at, BLOCK_DOCS))
