"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

Signatures.  One permutation spreads the shingles over a circle of slots (a
mixed hash is the permutation of shingles); a second one, of the slots, is
shifted by one slot for each next coordinate.  The coordinates of a shingle are
thus a contiguous stretch of one table, and a signature is the minimum over
the stretches of a document.

Candidates.  Documents with one set of shingles count as one.  Two sets of
similarity 0.8 share no band with probability (1 - 0.8**5)**51, under 2e-9.

Verification, on the full sets, without all pairs of a bucket:

1. each member of a bucket against the bucket's smallest id;
2. components of these links; then only pairs of a bucket that lie in
   different components are still open.  They are settled in tiles of bounded
   size by matrix products, and a tile returns links that join components.

After the second pass each pair that shares a band is linked, in one
component, or refuted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.components import components
from wayfold.llm.verdicts import surviving
from wayfold.llm.secret_scan import segments
from wayfold.llm.spans import mix, span_hash, text_bytes
from wayfold.llm.workers import tidy
from wayfold.workspace import Workspace

BANDS, ROWS = 51, 5
SLOTS = 1 << 20
#: Bytes that are hashed at a time, shingles and sets of a tile's side, columns and rows of a matrix in work.
BLOCK_BYTES, TILE_SHINGLES, TILE_SETS, TILE_COLUMNS, TILE_ROWS = 1 << 19, 500_000, 1_000, 2_048, 256
#: Parts over which the rows of one key are spread; rows of an Arrow batch of texts or sets.
SALTS, BATCH = 64, 1_000

_A = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Hashed shingles of many texts at once, from their bytes."""

    def __init__(self, words: int):
        self.words = words
        self.space = np.zeros(256, dtype=bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def _word_hashes(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the words of a block; ``edges`` are the starts of texts in it."""
        solid = ~self.space[data]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[edges] = True
        before = np.concatenate([[False], solid[:-1]]) & ~cut[:-1]
        after = np.concatenate([solid[1:], [False]]) & ~cut[1:]
        starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        return span_hash(self.lower[data], starts, ends), starts

    def _words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts and the number of words before each text's end."""
        hashes, starts, at = [], [], 0
        while at < len(data):
            end = min(at + BLOCK_BYTES, len(data))
            if end < len(data):
                back = np.flatnonzero(self.space[data[at:end]])
                end = at + int(back[-1]) + 1 if len(back) else self._long_word(data, at, bounds)
            h, s = self._word_hashes(data[at:end], bounds[(bounds >= at) & (bounds < end)] - at)
            hashes.append(h)
            starts.append(s + at)
            at = end
        if not hashes:
            return np.empty(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
        return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds[1:])

    def _long_word(self, data: np.ndarray, at: int, bounds: np.ndarray) -> int:
        """End of a stretch that has no space in a whole block: the next text's start or space."""
        inside = bounds[(bounds > at) & (bounds <= at + BLOCK_BYTES)]
        if len(inside):
            return int(inside[-1])
        end = int(bounds[np.searchsorted(bounds, at, side="right")])
        for x in range(at + BLOCK_BYTES, end, BLOCK_BYTES):
            back = np.flatnonzero(self.space[data[x : min(x + BLOCK_BYTES, end)]])
            if len(back):
                return x + int(back[0])
        return end

    def sets(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The sorted distinct shingles of each text."""
        k = self.words
        data, bounds = text_bytes(column)
        hashes, ends = self._words(data, bounds)
        chain = np.zeros(max(0, len(hashes) - k + 1), dtype=np.uint64)
        for j in range(k):
            chain = chain * _A + hashes[j : j + len(chain)]
        chain = mix(chain)
        start = 0
        for end in ends.tolist():
            if end - start >= k:
                yield np.unique(chain[start : end - k + 1])
            elif end > start:
                short = np.array([end - start], dtype=np.uint64)
                for h in hashes[start:end]:
                    short = short * _A + h
                yield mix(short)
            else:
                yield np.empty(0, np.uint64)
            start = end


@lru_cache(maxsize=2)
def shingler(words: int) -> Shingler:
    return Shingler(words)


class CirculantMinHash:
    def __init__(self):
        n = BANDS * ROWS
        circle = np.random.default_rng(20_240_229).permutation(SLOTS).astype(np.uint32)
        self.table = np.concatenate([circle, circle[:n]])
        self.stretches = as_strided(self.table, shape=(SLOTS, n), strides=(4, 4), writeable=False)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slots = (shingles & np.uint64(SLOTS - 1)).astype(np.int64)
        least = self.stretches[slots[:2048]].min(axis=0)
        for at in range(2048, len(slots), 2048):
            least = np.minimum(least, self.stretches[slots[at : at + 2048]].min(axis=0))
        return least

    @staticmethod
    def bands(signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band; the band is part of the key."""
        parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _A, (len(signatures), BANDS)).copy()
        for j in range(ROWS):
            key = mix(key * _A + parts[:, :, j])
        return key.view(np.int64)


@lru_cache(maxsize=1)
def minhash() -> CirculantMinHash:
    return CirculantMinHash()


def set_digest(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, digest of the set, band keys); digest and keys are null for an empty set."""

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, mh = shingler(words), minhash()
        for batch in batches:
            for part in (s.slice(at, 256) for s in segments(batch) for at in range(0, s.num_rows, 256)):
                sizes, digests, found = [], [], []
                for s in cut.sets(part.column("text")):
                    sizes.append(len(s))
                    digests.append(set_digest(s.tobytes()) if len(s) else None)
                    if len(s):
                        found.append(mh.signature(s))
                keys = iter(mh.bands(np.stack(found)) if found else ())
                bands = [next(keys) if n else None for n in sizes]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("text_key"),
                        pa.array(sizes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "digest", "bands"],
                )

    schema = "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(work, schema)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(digest, shingles) of each text: 64-bit hashes in ascending order, as bytes, and their digest."""

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = shingler(words)
        for batch in batches:
            for part in (s.slice(at, 256) for s in segments(batch) for at in range(0, s.num_rows, 256)):
                sets = [s.tobytes() for s in cut.sets(part.column("text"))]
                digests = [set_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    return docs.select("text").mapInArrow(work, "digest binary, shingles binary")


def similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def verify_stars(tiles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows (leader, salt, side, id, shingles): side 0 is the leader's own set."""

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            a, b = [], []
            columns = (batch.column(c) for c in ("leader", "side", "id", "shingles"))
            for lead, side, i, data in zip(*(c.to_pylist() for c in columns)):
                s = np.frombuffer(data, "<u8")
                if side == 0:
                    leader, own = lead, s
                elif lead == leader:
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    if similar(common, len(own), len(s), percent):
                        a.append(lead)
                        b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = tiles.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "side")
    return ordered.mapInArrow(work, "a long, b long")


def tile_links(ids: list[int], comps: list[int], inner: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different components, as many as join them; a pair needs one ``inner`` side."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count >= 2
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(shared.sum()), TILE_COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + TILE_COLUMNS])
        x = np.zeros((n, TILE_COLUMNS), dtype=np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        common += x @ x.T
    comp, inside = np.array(comps), np.array(inner)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    links = []
    for at in range(0, n, TILE_ROWS):
        rows = slice(at, min(at + TILE_ROWS, n))
        linked = similar(np.rint(common[rows]).astype(np.int64), sizes[rows, None], sizes[None, :], percent)
        linked &= (comp[rows, None] != comp[None, :]) & (inside[rows, None] | inside[None, :])
        for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
            i += at
            if i < j and (ri := root(comps[i])) != (rj := root(comps[j])):
                up[ri] = rj
                links.append((ids[i], ids[j]))
    return links


def verify_tiles(tiles: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of rows (bucket, tile, id, comp, inner, shingles)."""

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def settle() -> pa.RecordBatch:
            ids, comps, inner, sets = zip(*held)
            links = tile_links(list(ids), list(comps), list(inner), list(sets), percent) if len(held) > 1 else []
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in (x.slice(at, 256) for x in batches for at in range(0, x.num_rows, 256)):
            names = ("bucket", "tile", "id", "comp", "inner", "shingles")
            for bucket, tile, i, comp, inner, data in zip(*(batch.column(c).to_pylist() for c in names)):
                if held and (bucket, tile) != now:
                    yield settle()
                    held = []
                now = (bucket, tile)
                held.append((i, comp, inner, np.frombuffer(data, "<u8")))
        if held:
            yield settle()

    ordered = tiles.repartition("bucket", "tile").sortWithinPartitions("bucket", "tile")
    return ordered.mapInArrow(work, "a long, b long")


def near_verdicts(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_key, n_shingles, component_id and ``stays``.

    A row is known by its doc_id and ``text_key``, a hash of its text.  Of a
    component the row with the smallest of both stays.
    """
    work = Workspace(docs.sparkSession, "near-dedup")
    signed = work.table(
        signatures(docs, words).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "signatures", BATCH
    )
    named = signed.filter("doc_id IS NOT NULL AND digest IS NOT NULL").withColumn("row", F.struct("doc_id", "text_key"))

    # each distinct set gets a number of its own; salted, since one set may be that of a third of all rows
    bottom = work.table(named.groupBy("digest", "salt").agg(F.min("row").alias("least"), F.first("n_shingles").alias("n")), "bottom", small=True)
    top = bottom.groupBy("digest").agg(F.min("least").alias("rep"))
    # written by the tasks that number them, so that a repeated task gives no set two numbers
    top = work.table(top.withColumn("set_id", F.monotonically_increasing_id()), "sets")
    bands = named.join(
        bottom.join(top, "digest").filter("least = rep").select("digest", "salt", "rep", "set_id"), ["digest", "salt"]
    )
    # rows that repeat a set's smallest row give equal members, which the distinct() below takes together
    bands = bands.filter("row = rep").select("set_id", "n_shingles", F.explode("bands").alias("bucket"))
    members = bands.select("bucket", F.col("set_id").alias("id"), F.col("n_shingles").alias("n"))

    leaders = (
        members.groupBy("bucket")
        .agg(F.min(F.struct("id", "n")).alias("lead"), F.min("id").alias("_low"), F.max("id").alias("_high"))
        .filter("_low < _high")
        .select("bucket", F.col("lead.id").alias("leader"), F.col("lead.n").alias("leader_n"))
    )
    crowded = work.table(members.join(leaders, "bucket").filter("id <> leader").distinct(), "crowded")

    fits = F.lit(100) * F.least("n", "leader_n") >= F.lit(percent) * F.greatest("n", "leader_n")
    pairs = work.table(
        crowded.filter(fits).select("leader", "id").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")),
        "pairs",
        small=True,
    )
    # sets are made again for candidates only; all documents' sets would outweigh the texts
    wanted = crowded.select("id").union(crowded.select(F.col("leader").alias("id"))).distinct()
    wanted = work.table(top.join(wanted, F.col("set_id") == F.col("id")).select("id", "digest", "rep.doc_id"), "wanted", small=True)
    texts = docs.select("doc_id", "text").join(wanted.select("doc_id"), "doc_id", "left_semi")
    # a doc_id that is repeated brings texts of other sets too: a set is known by its digest
    sets = full_sets(texts, words).join(wanted.select("id", "digest"), "digest").dropDuplicates(["digest"])
    sets = work.table(sets.select("id", "shingles"), "shingles", BATCH)

    heads = pairs.select("leader", "salt").distinct().join(sets.withColumnRenamed("id", "leader"), "leader")
    stars = heads.select("leader", "salt", F.lit(0).alias("side"), F.col("leader").alias("id"), "shingles").unionByName(
        pairs.join(sets, "id").select("leader", "salt", F.lit(1).alias("side"), "id", "shingles")
    )
    found = work.table(verify_stars(stars, percent), "star-links", BATCH, small=True)
    comps = components(found, work, "stars")

    # what is open: pairs of a bucket, without its leader, in different components
    of = comps.withColumnRenamed("component", "comp")
    lead_of = of.select(F.col("id").alias("leader"), F.col("comp").alias("lead_comp"))
    placed = work.table(
        crowded.join(of, "id", "left")
        .join(lead_of, "leader", "left")
        .select(
            "bucket",
            "id",
            "n",
            F.coalesce("comp", "id").alias("comp"),
            (~F.coalesce("comp", "id").eqNullSafe(F.coalesce("lead_comp", "leader"))).alias("inner"),
        ),
        "placed",
        small=True,
    )
    per_side = placed.groupBy("bucket").agg(
        F.min("comp").alias("low"),
        F.max("comp").alias("high"),
        *(
            F.greatest(
                F.lit(1),
                F.ceil(F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)) / TILE_SHINGLES),
                F.ceil(F.count(F.when(side, 1)) / TILE_SETS),
            )
            .cast("int")
            .alias(name)
            for name, side in (("inner_blocks", F.col("inner")), ("outer_blocks", ~F.col("inner")))
        ),
    )
    still = per_side.filter("low < high").drop("low", "high")
    # inner blocks meet each other and all outer blocks; outer blocks are of one component
    block = F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("inner_blocks")).otherwise(F.col("outer_blocks"))).cast("int")
    others = F.when(
        F.col("inner"),
        F.concat(
            F.transform(
                F.sequence(F.lit(0), F.col("inner_blocks") - 1),
                lambda j: F.concat_ws(":", F.lit("i"), F.least(j, F.col("block")), F.greatest(j, F.col("block"))),
            ),
            F.transform(
                F.sequence(F.lit(0), F.col("outer_blocks") - 1), lambda j: F.concat_ws(":", F.lit("o"), F.col("block"), j)
            ),
        ),
    ).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("inner_blocks") - 1), lambda j: F.concat_ws(":", F.lit("o"), j, F.col("block")))
    )
    # where both sides fit one block, one tile holds the bucket
    one = (F.col("inner_blocks") == 1) & (F.col("outer_blocks") == 1)
    open_rows = (
        placed.join(still, "bucket")
        .withColumn("block", block)
        .withColumn("tile", F.explode(F.when(one, F.array(F.lit("all"))).otherwise(others)))
        .select("bucket", "tile", "id", "comp", "inner")
    )
    more = work.table(verify_tiles(open_rows.join(sets, "id"), percent), "tile-links", BATCH, small=True)
    if not more.isEmpty():
        # only the components that the tiles join are solved again
        a = more.join(of.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left")
        ab = a.join(of.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
        joined = components(ab.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), work, "tiles")
        joined = joined.select(F.col("id").alias("component"), F.col("component").alias("top"))
        alone = joined.join(comps.select(F.col("component")).distinct(), "component", "left_anti").select(
            F.col("component").alias("id"), F.col("top").alias("component")
        )
        comps = comps.join(joined, "component", "left").select("id", F.coalesce("top", "component").alias("component")).unionByName(alone)

    # a component is named after the smallest row of its sets
    linked = top.join(comps, F.col("set_id") == F.col("id")).select("digest", "rep", "component")
    names = linked.groupBy("component").agg(F.min("rep").alias("name"))
    named_sets = linked.join(names, "component").select("digest", "name")
    verdict = top.select("digest", "rep").join(named_sets, "digest", "left").select("digest", F.coalesce("name", "rep").alias("name"))
    verdict = bottom.select("digest", "salt").join(verdict, "digest")
    own = F.struct("doc_id", "text_key")
    return signed.join(verdict, ["digest", "salt"], "left").select(
        "doc_id",
        "text_key",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("name.doc_id", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | F.col("name").isNull() | (own == F.col("name"))).alias("stays"),
    )


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: the component of near copies it is in.

    Columns: doc_id, n_shingles, component_id, kept.  Words are split at ASCII
    white space and A-Z lower-cased; a document's set is its distinct
    shingles of ``words`` words, or its whole sequence if it has fewer.  Two
    documents are linked if 100 * common >= percent * union.

    * A text that is null, empty or without words has the empty set; it is
      linked with nothing.
    * Rows that repeat a doc_id and its text share one verdict.  If their texts
      differ, each row has the component of its own text's set.
    * Rows without a doc_id are linked with nothing, have no component, and are
      kept.
    * Other columns are ignored; an empty table gives an empty result.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return near_verdicts(docs, words, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, of each component.

    * A row goes by its own text, also where other rows have its doc_id.  If
      rows of one component share its smallest doc_id, one of them stays.
    * Of rows equal in doc_id and text one stays, whatever their other columns.
    * Rows without a doc_id, and texts without words, stay.
    """
    work = Workspace(docs.sparkSession, "near-drop")
    verdict = near_verdicts(docs, words, percent).select("doc_id", F.col("text_key").alias("key"), "stays")
    return surviving(docs, F.xxhash64("text"), work.table(verdict, "verdict", small=True))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at four words and 0.8; see :func:`near_dedup`."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


ORACLE = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS g
  FROM d
),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON r.doc_id = p.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(s.g)
"""
