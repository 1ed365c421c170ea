"""Importance resampling towards a target distribution, over hashed n-grams.

An n-gram is known by the CRC-32 of its words joined by one space.  Each word's
CRC is computed once; that of a run of words follows from the CRCs of its parts
by the algebra of CRC combination: appending a text of n bytes applies the n-byte
shift, a matrix over GF(2), to the CRC so far and adds the CRC of what is
appended.  The string of a run of words is never made.

1. Each task counts its rows' n-grams by bucket; the counts are summed.  There is
   one number for each bucket, so what reaches the driver has a fixed size.
2. The buckets' gains go back to the tasks, and each document gets its weight.
3. Documents are ranked by range partitions of their scores: a row's place is the
   number of rows in the ranges before it and its place within its own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.spans import text_bytes
from wayfold.llm.workers import tidy
from wayfold.workspace import Workspace

BUCKETS, LONGEST, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Words up to this many bytes have a table of their own for the shift by their length.
TABLED = 64
#: Bytes and documents that are worked on at a time; a longer text is taken alone.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 2048

POLYNOMIAL = 0xEDB88320

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[0x80:] = True


# ---------------------------------------------------------------- algebra of CRC
@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """What one byte adds to a CRC."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A matrix, given by its products with each value of each of the four bytes, times vectors of 32 bits."""
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@lru_cache(maxsize=1)
def shifts() -> tuple[np.ndarray, np.ndarray]:
    """Matrices of the shifts by 0 to TABLED bytes, and of those by powers of two bytes."""
    byte = byte_table()
    value = np.arange(256, dtype=np.uint32)
    unit = np.stack([value << np.uint32(8 * j) for j in range(4)])
    one = unit >> 8 ^ byte[unit & 255]
    small = [unit]
    for _ in range(TABLED):
        small.append(_apply(one, small[-1]))
    powers = [one]
    for _ in range(40):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(small), np.stack(powers)


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs shifted by so many bytes each."""
    small, powers = shifts()
    table, place = small.reshape(-1), np.minimum(lengths, TABLED) * 1024
    out = table[place + (crc & 255)]
    for j in (1, 2, 3):
        out ^= table[place + (256 * j) + (crc >> np.uint32(8 * j) & 255)]
    far = np.flatnonzero(lengths > TABLED)
    if len(far):
        moved, left = out[far], lengths[far] - TABLED
        for j in range(int(left.max()).bit_length()):
            bit = (left >> j & 1).astype(bool)
            moved[bit] = _apply(powers[j], moved[bit])
        out[far] = moved
    return out


def joined(head: np.ndarray, tail: np.ndarray, tail_lengths: np.ndarray) -> np.ndarray:
    """CRCs of heads followed by tails."""
    return shift(head, tail_lengths) ^ tail


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of each word: all words a byte at a time, and those of many bytes one by one."""
    table = byte_table()
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(-np.minimum(lengths, TABLED + 1), kind="stable")  # so that those still open come first
    by_length = np.sort(np.minimum(lengths, TABLED + 1))
    at, c = starts[order], crc[order]
    n_long = len(starts) - int(np.searchsorted(by_length, TABLED, side="right"))
    for j in range(TABLED):
        n = len(starts) - int(np.searchsorted(by_length, j, side="right"))
        if n <= n_long:
            break
        c[n_long:n] = c[n_long:n] >> 8 ^ table[(c[n_long:n] ^ data[at[n_long:n] + j]) & 255]
    crc[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in order[:n_long].tolist():
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]].tobytes())
    return crc


# ---------------------------------------------------------------- features
def features(data: np.ndarray, bounds: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of run from one word on: (CRCs of the runs, number of the document of each).

    ``data`` has the bytes of the documents in a row, ``bounds`` their bounds.
    """
    low = _LOWER[data]
    inside = np.concatenate([[False], _IN_WORD[low], [False]])
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[bounds] = True  # a word ends with its document
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | fresh))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | fresh))
    lengths = ends - starts
    doc = np.searchsorted(bounds, starts, side="right") - 1
    words = word_crcs(low, starts, lengths)
    yield words, doc
    if longest < 2:
        return
    space = np.uint32(zlib.crc32(b" "))
    before = shift(words, np.ones(len(words), dtype=np.int64)) ^ space  # each word with a space after it
    runs = words
    for n in range(2, longest + 1):
        head = before if n == 2 else shift(runs, np.ones(len(runs), dtype=np.int64)) ^ space
        runs = joined(head[: max(0, len(words) - n + 1)], words[n - 1 :], lengths[n - 1 :])
        yield runs[(same := doc[: len(runs)] == doc[n - 1 :])], doc[n - 1 :][same]


def _blocks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and bounds of their texts."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(column).fill_null(""))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES, side="right")) - 1
            to = min(max(to, at + 1), at + BLOCK_DOCS, batch.num_rows)
            yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
            at = to


def bucket_counts(docs: DataFrame, longest: int = LONGEST, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows of ``docs`` lie in each bucket."""

    @tidy
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, dtype=np.int64)
        for _, data, bounds in _blocks(batches):
            for crc, _ in features(data, bounds, longest):
                total += np.bincount(crc % n_buckets, minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(n_buckets, dtype=np.int64)  # at most n_buckets rows reach the driver
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's ratio of smoothed shares, floored."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = ((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


# ---------------------------------------------------------------- operator
def weigh(docs: DataFrame, target: DataFrame, longest: int = LONGEST, n_buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of each document's features.

    * A null or empty text has no words, no features and the weight 0.
    * Each row has its own result, whatever its doc_id; other columns are ignored.
    * An empty ``target`` or ``docs`` counts as one without features.
    """
    # one number a bucket
    gain = docs.sparkSession.sparkContext.broadcast(
        gains(bucket_counts(docs, longest, n_buckets), bucket_counts(target, longest, n_buckets))
    )

    @tidy
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in _blocks(batches):
            n = part.num_rows
            count, words, total = np.zeros(n, np.int64), None, np.zeros(n, np.int64)
            for crc, doc in features(data, bounds, longest):
                here = np.bincount(doc, minlength=n)
                count += here
                words = here if words is None else words
                # sums of whole numbers under 2**53 are exact
                total += np.bincount(doc, weights=gain.value[crc % n_buckets], minlength=n).astype(np.int64)
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            columns = [part.column("doc_id").cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (words, count, weight))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A draw from the Gumbel distribution that a document's id fixes, times 1000 and floored; a null id is the text 'null'."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``weighed`` with its score and, for the drawn documents, its rank.

    Of the rows of at least ``least_words`` words the given part with the highest
    scores is drawn, without replacement; ties go to the smaller doc_id, a null one
    last.  Rows that are equal in all this are drawn in any order.
    """
    spark, order = weighed.sparkSession, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    work = Workspace(spark, "resampling")
    scored = work.table(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fit = F.col("n_words") >= least_words
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.filter(fit).repartitionByRange(n_ranges, *order).sortWithinPartitions(*order)
    # the id holds the number of the range above 33 bits of the place in it
    ranged = work.table(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    sizes = ranged.groupBy(F.shiftright("_at", 33).alias("range")).count().collect()  # a row for each range
    before, n = {}, 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        before[r["range"]] = n
        n += r["count"]
    starts = spark.createDataFrame(sorted(before.items()), "range long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = (
        ranged.withColumn("range", F.shiftright("_at", 33))
        .join(F.broadcast(starts), "range")
        .withColumn("rank", F.when(place <= percent * n // 100, place))
        .drop("range", "_at", "_before")
    )
    return ranked.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is drawn, with the column ``resample_rank``; rows without a doc_id stay out."""
    drawn = draw(weigh(docs, target, **options), percent).filter("rank IS NOT NULL AND doc_id IS NOT NULL")
    best = drawn.groupBy(F.col("doc_id").alias("_r_id")).agg(F.min("rank").alias("resample_rank"))
    return docs.drop("resample_rank").join(best, F.col("doc_id") == F.col("_r_id")).drop("_r_id")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of all documents towards the benchmark's texts; see :func:`weigh` and :func:`draw`."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return draw(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = """
WITH tbl AS (
  SELECT list(list_reduce([CAST(i AS BIGINT)] || [CAST(k AS BIGINT) FOR k IN range(8)],
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
),
texts AS (
  SELECT 's' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
),
w AS (SELECT side, id, regexp_extract_all(x, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS (
  SELECT side, id, unnest(w) AS g FROM w
  UNION ALL
  SELECT side, id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w
),
k AS (SELECT DISTINCT g FROM f),
b AS (
  SELECT g, xor(list_reduce([4294967295] || [CAST('0x' || substr(hex(encode(g)), 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, strlen(g) + 1)],
    lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM k, tbl
),
n AS (
  SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM f JOIN b USING (g) GROUP BY bucket
),
z AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM n),
gain AS (
  SELECT bucket, floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS gain FROM n, z
),
d AS (
  SELECT id, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM f JOIN b USING (g) JOIN gain USING (bucket) WHERE side = 's' GROUP BY id
),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM documents JOIN w ON w.side = 's' AND w.id = doc_id LEFT JOIN d ON d.id = doc_id
),
r AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN r ON r.doc_id = scored.doc_id
"""
