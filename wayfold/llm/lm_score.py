"""Document scores by masked pseudo-likelihood.

A network predicts every token from the two tokens on either side of it.  The
vectors of the four neighbours are mixed and squashed; what comes out gives
first the token's class, then a word or bucket of that class, and in a bucket
one of its words, so that a prediction costs three small softmaxes for a
vocabulary of some 17,000 words and their buckets.  A document's score is the sum of its tokens'
log probabilities.

Words beyond the vocabulary share the last place of a bucket.  Such a word's
probability is that of the place times its share of the place's count, from the
counts of all tokens.  The most frequent of these counts are held in memory;
the rest, which grow with the corpus, are joined.

Tokens are runs of letters, marks and digits of any script, A-Z and their like
counted as small letters; characters of scripts without spaces between words,
and all other characters, are tokens of their own.

Training: documents are dealt by a hash of themselves to shards of about
``SHARD_TOKENS`` tokens and to ``ROUNDS`` rounds.  In a round each shard starts from
the same weights and walks through its documents of that round, in order of the
hash, predicting every token; the shards' changes are averaged, each weight's
by how much a shard had to say on it.  So every token is predicted once, and
the result does not depend on how the rows are partitioned.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.secret_scan import segments
from wayfold.llm.spans import span_hash, text_bytes
from wayfold.llm.workers import tidy
from wayfold.workspace import Workspace

#: Classes of as many words or buckets: one place for a text's border, then words, then buckets of as many words.
CLASSES, PER_CLASS, BUCKETS, PER_BUCKET = 32, 32, 128, 128
#: Words with a place of their own in a class, and in all; the last place of a bucket is for all other words.
FIRST = CLASSES * PER_CLASS - BUCKETS - 1
WORDS = FIRST + BUCKETS * (PER_BUCKET - 1)
TAIL = 1 + FIRST
IDS = TAIL + BUCKETS * PER_BUCKET
#: Bits of a hash that say where in the vocabulary to look for it.
FIRST_BITS = 16
#: Tokens whose counts scoring holds in memory; those of all others are joined.
KNOWN = 1 << 16
WINDOW, VECTOR, HIDDEN = (-2, -1, 1, 2), 16, 15
SHARD_TOKENS, ROUNDS = 1 << 21, 3
BATCH, RATE, DAMP, SEED = 1 << 14, 0.2, 0.1, 11
#: Logits under this bound neither overflow nor vanish as powers of e in 32 bits, nor do sums of such powers times weights.
CALM = 60.0
#: Tokens that are learned one after the other before more are read; bytes that are cut at a time; tokens scored at a time; rows of weights sent together; rows of a product that stay in the cache.
LEARN, BLOCK_BYTES, CHUNK, ROWS, CACHED = 1 << 16, 1 << 19, 1 << 15, 1024, 1024


class TokenHasher:
    """Hashes of the tokens of many texts, from their bytes."""

    #: Blocks of scripts that put no spaces between words.
    UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF))

    def __init__(self):
        # 0 is space, 1 part of a word, 2 a token of its own; characters beyond the first plane are 2
        self.kind = np.full(1 << 16, 2, dtype=np.uint8)
        self.lower = np.arange(1 << 16, dtype=np.uint32)
        for cp in (*range(0xD800), *range(0xE000, 1 << 16)):
            c = chr(cp)
            category = unicodedata.category(c)[0]
            if category in "LMN" and not any(a <= cp <= b for a, b in self.UNSPACED):
                self.kind[cp] = 1
            elif category == "Z" or c.isspace():
                self.kind[cp] = 0
            small = c.lower()
            if len(small) == 1 and len(small.encode()) == len(c.encode()):
                self.lower[cp] = ord(small)
        self.byte_kind, self.byte_lower = (t[:256].astype(np.uint8).tobytes() for t in (self.kind, self.lower))

    def _block(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the tokens of whole characters; ``edges`` are starts of texts."""
        flat = data.tobytes()
        kind, folded = (np.frombuffer(bytearray(flat.translate(t)), dtype=np.uint8) for t in (self.byte_kind, self.byte_lower))
        inner = (data & 0xC0) == 0x80
        leads = np.flatnonzero(data >= 0xC0)
        lead = data[leads]
        for size, low, high, mask in ((2, 0xC0, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF8, 0x07)):
            at = leads[(lead >= low) & (lead < high)]
            if not len(at):
                continue
            cp = (data[at] & mask).astype(np.uint32)
            for j in range(1, size):
                cp = cp << 6 | (data[at + j] & 0x3F)
            wide = cp >= 1 << 16
            of = np.where(wide, 2, self.kind[cp & 0xFFFF])
            small = np.where(wide, cp, self.lower[cp & 0xFFFF])
            for j in range(size):
                kind[at + j] = of
                bits = small >> np.uint32(6 * (size - 1 - j)) & 0x3F
                folded[at + j] = bits | 0x80 if j else small >> np.uint32(6 * (size - 1)) | low
        border = np.zeros(len(data) + 1, dtype=bool)
        border[edges] = True
        word = kind == 1
        joined = np.zeros(len(data) + 1, dtype=bool)  # whether a place continues the token before it
        joined[1:-1] = word[1:] & word[:-1] & ~border[1:-1]
        joined[:-1] |= inner
        starts = np.flatnonzero((kind > 0) & ~joined[:-1])
        ends = np.flatnonzero((kind > 0) & ~joined[1:]) + 1
        return span_hash(folded, starts, ends), starts

    def tokens(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens, and how many lie before each text's end."""
        data, bounds = text_bytes(column)
        hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while at < len(data):
            end = self._end(data, at, bounds)
            h, s = self._block(data[at:end], bounds[(bounds >= at) & (bounds <= end)] - at)
            hashes.append(h)
            starts.append(s + at)
            at = end
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds[1:])

    def _end(self, data: np.ndarray, at: int, bounds: np.ndarray) -> int:
        """About a block further, where no token goes on: after an ASCII space or mark, or at a text's end."""
        if at + BLOCK_BYTES >= len(data):
            return len(data)
        for x in range(at, len(data), BLOCK_BYTES):
            for start in (max(x, x + BLOCK_BYTES - 1024), x):  # most blocks have one near their end
                part = data[start : x + BLOCK_BYTES]
                apart = np.flatnonzero((part < 0x80) & (self.kind[part] != 1))
                if len(apart):
                    return start + int(apart[-1]) + 1
            text = bounds[(bounds > x) & (bounds <= x + BLOCK_BYTES)]
            if len(text):
                return int(text[-1])
        return len(data)


@lru_cache(maxsize=1)
def hasher() -> TokenHasher:
    return TokenHasher()


#: The place among classes of every id.
PLACE = np.concatenate([np.arange(TAIL), TAIL + np.repeat(np.arange(BUCKETS), PER_BUCKET)]).astype(np.uint16)


class Vocabulary:
    """Ids of tokens: 0 a text's border, then the most frequent words, then those of the buckets."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, known: np.ndarray, times: np.ndarray):
        """``words``: hashes by falling frequency; ``counts``: of each id; ``known``: sorted hashes, which occur ``times``."""
        order = np.argsort(words, kind="stable")
        rank = np.arange(len(words))
        tail = rank - FIRST
        self.sorted = words[order]
        self.id = np.where(tail < 0, 1 + rank, TAIL + tail % BUCKETS * PER_BUCKET + tail // BUCKETS)[order]
        self.counts, self.known, self.times = counts, known, times
        # hashes are spread evenly: those of the same first bits are few
        self.start = np.searchsorted(self.sorted, np.arange(1 << FIRST_BITS, dtype=np.uint64) << np.uint64(64 - FIRST_BITS))
        self.most = int(np.diff(self.start, append=len(words)).max())

    @staticmethod
    def other(hashes: np.ndarray) -> np.ndarray:
        return TAIL + (hashes % np.uint64(BUCKETS)).astype(np.int64) * PER_BUCKET + PER_BUCKET - 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        other = self.other(hashes)
        if not len(self.sorted):
            return other
        at, last = self.start.take(hashes >> np.uint64(64 - FIRST_BITS)), len(self.sorted) - 1
        for _ in range(self.most):
            at += self.sorted.take(at, mode="clip") < hashes
        np.minimum(at, last, out=at)
        return np.where(self.sorted.take(at) == hashes, self.id.take(at), other)

    def log_shares(self, hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of each token's share of its id's count, less its own log count where the second result says so."""
        logs, open_ = np.zeros(len(ids)), np.zeros(len(ids), dtype=bool)
        shared = np.flatnonzero((ids >= TAIL) & ((ids - TAIL) % PER_BUCKET == PER_BUCKET - 1))
        if len(shared):
            h = hashes[shared]
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            found = self.known[at] == h
            logs[shared] = np.where(found, np.log(self.times[at]), 0) - np.log(self.counts[ids[shared]])
            open_[shared] = ~found
        return logs, open_


def padded(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with two borders around each text, and the place of each id."""
    sizes = np.diff(ends, prepend=0)
    place = np.arange(len(ids)) + 2 * (np.repeat(np.arange(len(ends)), sizes) + 1)
    line = np.zeros(len(ids) + 2 * (len(ends) + 1), dtype=np.int64)
    line[place] = ids
    return line, place


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by id, the distinct ids, and where each begins in that order."""
    ids = ids.astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    ids = ids[order].astype(np.int64)
    first = np.flatnonzero(np.diff(ids, prepend=-1))
    return order, ids[first], first


def sums_of_runs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each run of rows, of an even number of 32-bit columns; two columns at a time, as if they were one number."""
    return np.add.reduceat(rows.view(np.complex64), first, axis=0).view(np.float32)


def parts_of(a: int, b: int) -> Iterator[slice]:
    """The rows from ``a`` on before ``b``, ``CACHED`` at a time."""
    for at in range(a, b, CACHED):
        yield slice(at, min(at + CACHED, b))


class Network:
    """Tables of rows of weights; the last column of an output table is a bias, as is the last row of ``mix``."""

    SHAPES = {
        "vectors": (IDS, VECTOR),
        "mix": (len(WINDOW) * VECTOR + 1, HIDDEN),
        "classes": (CLASSES, HIDDEN + 1),
        "places": (CLASSES * PER_CLASS, HIDDEN + 1),
        "words": (BUCKETS * PER_BUCKET, HIDDEN + 1),
    }

    def __init__(self, tables: dict[str, np.ndarray]):
        self.tables = tables
        self.vectors, self.mix, self.classes, self.places, self.words = (tables[name] for name in self.SHAPES)
        self.squares = {name: np.full(len(t), DAMP, dtype=np.float32) for name, t in tables.items()}

    @classmethod
    def fresh(cls, counts: np.ndarray) -> Network:
        """Small random weights, with the biases of the counts."""
        rng = np.random.default_rng(SEED)
        net = cls({name: (rng.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in cls.SHAPES.items()})
        table = np.bincount(PLACE, weights=counts).reshape(CLASSES, PER_CLASS) + 0.5
        net.mix[-1] = 0
        net.classes[:, -1] = np.log(table.sum(axis=1) / table.sum())
        net.places[:, -1] = np.log(table / table.sum(axis=1, keepdims=True)).ravel()
        table = counts[TAIL:].reshape(BUCKETS, PER_BUCKET) + 0.01
        net.words[:, -1] = np.log(table / table.sum(axis=1, keepdims=True)).ravel()
        return net

    def _mix(self) -> np.ndarray:
        """Rows of ``mix`` of all sides of the window next to each other, with a column of zeros after each side's."""
        out = np.zeros((VECTOR, len(WINDOW), HIDDEN + 1), dtype=np.float32)
        out[:, :, :-1] = self.mix[:-1].reshape(len(WINDOW), VECTOR, HIDDEN).transpose(1, 0, 2)
        return out.reshape(VECTOR, -1)

    def hidden(self, around: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """What is made of the neighbours of all places but the margins of ``around``, which has no ids but ``ids``.

        A vector's part in it depends only on its side of the window: it is worked out once an id and
        looked up at each place.  The last column of the result is ones.
        """
        n = len(around) + WINDOW[0] - WINDOW[-1]
        parts = self.vectors.take(ids, axis=0) @ self._mix()
        parts[:, :HIDDEN] += self.mix[-1]
        parts = parts.reshape(-1, HIDDEN + 1)
        row = np.empty(IDS, dtype=np.int64)
        row[ids] = np.arange(0, len(parts), len(WINDOW))
        row = row.take(around)
        h = parts.take(row[:n], axis=0)
        for j, d in enumerate(WINDOW[1:], 1):
            h += parts.take(row[d - WINDOW[0] : d - WINDOW[0] + n] + j, axis=0)
        np.tanh(h, out=h)
        h[:, -1] = 1
        return h

    def _softmaxes(self, distinct: np.ndarray, first: np.ndarray, h: np.ndarray) -> Iterator[tuple[slice, str, slice, np.ndarray, np.ndarray | None]]:
        """(rows, table, its rows, powers of e, what was taken off the logits before) of the softmaxes of sorted targets.

        ``distinct`` targets begin at the rows ``first``.  Each row's largest logit is taken off where
        weights are so large that powers might overflow, otherwise nothing is.
        """
        one = np.ones(HIDDEN + 1, dtype=np.float32)
        calm = all((np.abs(t) @ one).max() < CALM for t in (self.classes, self.places, self.words))  # h is within 1

        def powers(rows: slice, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            x = h[rows] @ turned
            off = None
            if not calm:
                off = x.max(axis=1)
                x -= off[:, None]
            return np.exp(x, out=x), off

        turned = self.classes.T.copy()
        for rows in parts_of(0, len(h)):
            yield rows, "classes", slice(0, CLASSES), *powers(rows, turned)
        tail = int(np.searchsorted(distinct, TAIL))
        ends = np.append(first, len(h))
        for size, table, skip, of in (
            (PER_CLASS, "places", 0, PLACE[distinct] // PER_CLASS),
            (PER_BUCKET, "words", tail, (distinct[tail:] - TAIL) // PER_BUCKET),
        ):
            turned = self.tables[table].reshape(-1, size, HIDDEN + 1).transpose(0, 2, 1).copy()
            edges = np.flatnonzero(np.diff(of.astype(np.int64), prepend=-1, append=-1))
            groups = of[edges[:-1]].tolist()
            edges = ends[skip + edges].tolist()
            for group, a, b in zip(groups, edges[:-1], edges[1:]):
                mine = slice(group * size, group * size + size)
                for rows in parts_of(a, b):
                    yield rows, table, mine, *powers(rows, turned[group])

    def _own(self, distinct: np.ndarray) -> np.ndarray:
        """The sum of each target's rows of weights, whose product with ``h`` is the sum of its logits."""
        place = PLACE[distinct]
        own = self.classes.take(place // PER_CLASS, axis=0) + self.places.take(place, axis=0)
        tail = int(np.searchsorted(distinct, TAIL))
        own[tail:] += self.words.take(distinct[tail:] - TAIL, axis=0)
        return own

    def log_probs(self, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of the token at each of ascending places, from its neighbours."""
        out, one = np.empty(len(place)), np.ones(max(CLASSES, PER_CLASS, PER_BUCKET), dtype=np.float32)
        for at in range(0, len(place), CHUNK):
            part = place[at : at + CHUNK]
            around = line[part[0] + WINDOW[0] : part[-1] + 1 + WINDOW[-1]]
            order, distinct, first = runs(line[part])
            h = self.hidden(around, runs(around)[1]).take(part[order] - part[0], axis=0)
            sums = {table: np.ones(len(part), dtype=np.float32) for table in ("classes", "places", "words")}
            odds = np.einsum("ij,ij->i", h, np.repeat(self._own(distinct), np.diff(first, append=len(h)), axis=0)).astype(np.float64)
            for rows, table, _, x, off in self._softmaxes(distinct, first, h):
                np.matmul(x, one[: x.shape[1]], out=sums[table][rows])
                if off is not None:
                    odds[rows] -= off
            for x in sums.values():
                odds -= np.log(x)
            out[at + order] = odds
        return out

    def learn(self, line: np.ndarray, place: np.ndarray) -> None:
        """One step of gradient ascent on ascending places, each row of weights at a rate by the root of its squares."""
        low, n = int(place[0]), int(place[-1]) + 1 - int(place[0])
        around = line[low + WINDOW[0] : low + n + WINDOW[-1]]
        by_id, ids, at_id = runs(around)
        order, distinct, first = runs(line[place])
        rows_of = place[order] - low
        h = self.hidden(around, ids)
        sorted_h = h.take(rows_of, axis=0)
        back = np.zeros((len(order) + 1, HIDDEN + 1), dtype=np.float32)  # the last row is for places that have no target
        back[:-1] = np.repeat(self._own(distinct), np.diff(first, append=len(order)), axis=0)
        # biases are no part of what goes back: their column gives the powers' sums instead
        names = ("classes", "places", "words")
        with_sums = {table: self.tables[table].copy() for table in names}
        for t in with_sums.values():
            t[:, -1] = 1
        gradients = {table: np.zeros_like(self.tables[table]) for table in names}
        for rows, table, mine, x, _ in self._softmaxes(distinct, first, sorted_h):
            mean = x @ with_sums[table][mine]
            scale = -1 / mean[:, -1:]
            mean *= scale
            back[rows] += mean
            gradients[table][mine] += x.T @ (sorted_h[rows] * scale)
        said = sums_of_runs(sorted_h, first)
        tail = int(np.searchsorted(distinct, TAIL))
        gradients["words"][distinct[tail:] - TAIL] += said[tail:]
        of = PLACE[distinct]
        edges = np.flatnonzero(np.diff(of.astype(np.int32), prepend=-1))
        of, said = of[edges], sums_of_runs(said, edges)
        gradients["places"][of] += said
        np.add.at(gradients["classes"], of // PER_CLASS, said)
        for table in names:
            self._step(table, slice(None), gradients[table])

        row_at = np.full(n, len(order))
        row_at[rows_of] = np.arange(len(order))
        span = WINDOW[-1] - WINDOW[0]
        dx = np.zeros((n + 2 * span, HIDDEN + 1), dtype=np.float32)  # with margins, where nothing changes
        np.multiply(back.take(row_at, axis=0), 1 - h * h, out=dx[span:-span])  # the last column is zeros
        # at each place of ``around``, those of the targets that it is a neighbour of
        around_it = dx.take((np.arange(len(around)) + span + WINDOW[0])[:, None] - np.array(WINDOW), axis=0).reshape(len(around), -1)
        change = around_it @ self._mix().T
        vectors = self.vectors.take(around, axis=0)
        of_mix = sum(vectors[part].T @ around_it[part] for part in parts_of(0, len(around)))
        of_mix = of_mix.reshape(VECTOR, len(WINDOW), HIDDEN + 1)[:, :, :-1].transpose(1, 0, 2).reshape(-1, HIDDEN)
        self._step("mix", slice(None), np.concatenate([of_mix, (np.ones(len(dx), dtype=np.float32) @ dx)[None, :-1]]))
        self._step("vectors", ids, sums_of_runs(change.take(by_id, axis=0), at_id))

    def _step(self, table: str, rows, gradient: np.ndarray) -> None:
        squares = self.squares[table][rows] + np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        self.squares[table][rows] = squares
        self.tables[table][rows] += gradient * (RATE / np.sqrt(squares))[:, None]


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n): the hash of each distinct token and its count over all documents."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return key, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

    @tidy
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in segments(batch):
                h, _ = hasher().tokens(part.column("text"))
                held.append(np.unique(h, return_counts=True))
                size += len(held[-1][0])
                if size > 1_000_000:
                    held = [merged(held)]
                    if len(held[0][0]) > 500_000:
                        yield rows(*held[0])
                        held = []
                    size = sum(len(k) for k, _ in held)
        if held:
            yield rows(*merged(held))

    def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["token", "n"])

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The frequent tokens and their counts, and the counts of all ids; a fixed number of each."""
    top = counts.orderBy(F.desc("n"), "token").limit(KNOWN).toArrow()
    known, times = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    words = known[:WORDS]
    by_id = np.zeros(IDS)
    # unsigned remainder; BUCKETS divides 2**64
    for r in counts.groupBy(F.pmod("token", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n")).collect():
        by_id[TAIL + r.bucket * PER_BUCKET + PER_BUCKET - 1] = r.n
    np.subtract.at(by_id, Vocabulary.other(words), times[: len(words)])
    order = np.argsort(known)
    vocab = Vocabulary(words, by_id, known[order], times[order])
    by_id[vocab.ids(words)] = times[: len(words)]
    return vocab


def numbered(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, doc_id, key, n_tokens, ids, shares, rare) of each document.

    ``ids`` are 16-bit integers, ``shares`` the sum of the tokens' log shares, to
    which the log counts of the tokens in ``rare`` are still to be added, see
    :func:`with_rare`.  ``row`` numbers the rows of one run, and ``key`` is a hash of
    the document.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocab)  # KNOWN counts

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in segments(batch):
                h, ends = hasher().tokens(part.column("text"))
                ids = words.ids(h)
                shares, open_ = words.log_shares(h, ids)
                sizes = np.diff(ends, prepend=0)
                owner = np.repeat(np.arange(len(ends)), sizes)
                bounds = np.concatenate([[0], ends])
                cuts = np.concatenate([[0], np.cumsum(open_)])[bounds]
                flat = pa.py_buffer(ids.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(ends)), pa.int64()),
                        part.column("doc_id").cast(pa.int64()),
                        part.column("key"),
                        pa.array(sizes, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((2 * bounds).astype("<i4").tobytes()), flat]),
                        pa.array(np.bincount(owner, weights=shares, minlength=len(ends)), pa.float64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h[open_].view(np.int64))),
                    ],
                    ["row", "doc_id", "key", "n_tokens", "ids", "shares", "rare"],
                )
                row += len(ends)

    schema = "row long, doc_id long, key long, n_tokens long, ids binary, shares double, rare array<long>"
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(work, schema)


def _lines(column: pa.Array, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded ids of some rows of a column of 16-bit ids."""
    parts = [np.frombuffer(x, "<u2") for x in column[at:to].to_pylist()]
    ends = np.cumsum([len(p) for p in parts])
    return padded(np.concatenate(parts), ends)


def train(documents: DataFrame, vocab: Vocabulary, work: Workspace, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Network:
    """A network that has predicted every token of a written table of :func:`numbered`."""
    net = Network.fresh(vocab.counts)
    n_shards = max(1, -(-int(vocab.counts.sum()) // shard_tokens))
    names = list(Network.SHAPES)
    for turn in range(rounds):
        held = documents.sparkSession.sparkContext.broadcast((net.tables, net.squares))  # one network

        @tidy
        def walk(batches: Iterable[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            tables, squares = held.value
            mine = Network({name: t.copy() for name, t in tables.items()})
            mine.squares = {name: s.copy() for name, s in squares.items()}
            waiting, n = [], 0

            def step() -> None:
                line, place = padded(np.concatenate(waiting), np.cumsum([len(p) for p in waiting]))
                for at in range(0, len(place), BATCH):
                    mine.learn(line, place[at : at + BATCH])

            for batch in batches:
                for ids in batch.column("ids").to_pylist():
                    waiting.append(np.frombuffer(ids, "<u2"))
                    n += len(waiting[-1])
                    if n >= LEARN:
                        step()
                        waiting, n = [], 0
            if n:
                step()
            rows = []
            for k, name in enumerate(names):
                change, said = mine.tables[name] - tables[name], mine.squares[name] - squares[name]
                for at in range(0, len(said), ROWS):
                    if said[at : at + ROWS].any():
                        part = change[at : at + ROWS].astype(np.float16)
                        rows.append((k, at, TaskContext.get().partitionId() % 64, part.tobytes(), said[at : at + ROWS].tobytes()))
            if rows:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["tab", "at", "salt", "change", "said"])

        def summed(table: pa.Table, kind: type) -> pa.Table:
            """Changes times what their shard had to say, that itself and its square, each summed over shards."""
            first, parts = table.slice(0, 1), []
            for change, said in zip(table.column("change").to_pylist(), table.column("said").to_pylist()):
                if kind is np.float16:
                    weight = np.frombuffer(said, np.float32).astype(np.float64)
                    change = np.frombuffer(change, kind).astype(np.float64).reshape(len(weight), -1) * weight[:, None]
                    parts.append((change, np.stack([weight, weight * weight])))
                else:
                    parts.append((np.frombuffer(change, kind), np.frombuffer(said, kind)))
            change, said = (sum(p[i] for p in parts) for i in (0, 1))
            return pa.table(
                {
                    "tab": first.column("tab"),
                    "at": first.column("at"),
                    "salt": first.column("salt"),
                    "change": pa.array([change.tobytes()], pa.binary()),
                    "said": pa.array([said.tobytes()], pa.binary()),
                }
            )

        mine = documents.filter((F.pmod("key", F.lit(rounds)) == turn) & (F.col("n_tokens") > 0))
        shard = F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")
        dealt = mine.select("key", "ids", shard.alias("shard")).repartitionById(n_shards, "shard").sortWithinPartitions("key", "ids")
        schema = "tab int, at int, salt int, change binary, said binary"
        sums = dealt.select("ids").mapInArrow(walk, schema)
        sums = sums.groupBy("tab", "at", "salt").applyInArrow(lambda t: summed(t, np.float16), schema)
        sums = sums.groupBy("tab", "at").applyInArrow(lambda t: summed(t, np.float64), schema)
        for r in work.table(sums, f"round-{turn}").collect():  # one network
            name = names[r.tab]
            said = np.frombuffer(bytes(r.said), np.float64).reshape(2, -1)
            rows, some = slice(r["at"], r["at"] + said.shape[1]), np.maximum(said[0], 1e-30)
            change = np.frombuffer(bytes(r.change), np.float64).reshape(said.shape[1], -1)
            net.tables[name][rows] += (change / some[:, None]).astype(np.float32)
            net.squares[name][rows] += (said[1] / some).astype(np.float32)
        held.unpersist()
    return net


def score(documents: DataFrame, net: Network) -> DataFrame:
    """(row, doc_id, n_tokens, log_prob, rare) of a written table of :func:`numbered`."""
    model = documents.sparkSession.sparkContext.broadcast(net.tables)  # one network

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(model.value)
        for batch in batches:
            sizes, sums = batch.column("n_tokens").to_numpy(), np.zeros(batch.num_rows)
            at, ends = 0, np.cumsum(sizes)
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * CHUNK, side="right")))
                logs = network.log_probs(*_lines(batch.column("ids"), at, to))
                sums[at:to] = np.bincount(np.repeat(np.arange(to - at), sizes[at:to]), weights=logs, minlength=to - at)
                at = to
            log_prob = pa.array(sums + batch.column("shares").to_numpy())
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("n_tokens"), log_prob, batch.column("rare")]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "log_prob", "rare"])

    return documents.select("row", "doc_id", "n_tokens", "ids", "shares", "rare").mapInArrow(
        work, "row long, doc_id long, n_tokens long, log_prob double, rare array<long>"
    )


def with_rare(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_prob) of a written table of :func:`score`, with the log counts of its rare tokens."""
    rare = scored.select("row", F.explode("rare").alias("token")).join(counts, "token")
    added = rare.groupBy("row").agg(F.sum(F.log("n")).alias("added"))
    whole = F.col("log_prob") + F.coalesce("added", F.lit(0.0))
    return scored.select("row", "doc_id", "n_tokens", "log_prob").join(added, "row", "left").select("doc_id", "n_tokens", whole.alias("log_prob"))


def lm_score(docs: DataFrame, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Each document's pseudo-log-likelihood under a model trained on all of ``docs``.

    Columns: doc_id, n_tokens, log_prob, perplexity.

    * A text that is null, empty or white space has no tokens, log_prob 0 and
      a null perplexity.
    * Each row has its own result, whatever its doc_id; rows count as often
      as they occur.  Rows equal in doc_id and text are learned in one shard.
    * Other columns are ignored; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "lm-score")
    counts = work.table(token_counts(docs), "counts")
    vocab = vocabulary(counts)
    documents = work.table(numbered(docs, vocab), "numbered")
    net = train(documents, vocab, work, rounds, shard_tokens)
    scored = with_rare(work.table(score(documents, net), "scored"), counts)
    mean = F.col("log_prob") / F.col("n_tokens")
    return scored.withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-mean)))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_prob and perplexity of every document; see :func:`lm_score`."""
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
