"""Exact dedup by a tree-merge of sorted digest runs.

Every document becomes an entry ``(digest, doc_id)`` of the run of one leaf.
A run is sorted by digest and holds one entry a digest: the smallest id and
the number of rows.  In each round ``fan_in`` neighbouring runs are exchanged
and merged into one, so that after ``log_fan_in(leaves)`` rounds one logical
run, spread over the partitions by digest, is left.  A round moves at most
one entry for each digest and run, so a text that a third of all rows share
costs ``leaves`` entries and never meets in one task.  The verdict goes back
down by joining on (digest, leaf), which no hot text can skew either.

Merging is by order: an aggregation of structs is planned as a sort aggregate,
which walks entries sorted by run and digest and needs no table of them.  A
task sorts its part of a run before it hands it on; what it gets is such
sorted parts in a row, which Spark's sort, a TimSort, merges as the runs they
are.

An entry carries a second hash and the byte length next to the SHA-256;
entries merge only if all three agree, at every level.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.verdicts import surviving
from wayfold.workspace import Workspace

#: Runs at the bottom of the tree and how many of them merge at a time.
LEAVES, FAN_IN = 64, 8

KEY = ["digest", "check", "bytes"]


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_entries(docs: DataFrame, leaves: int = LEAVES) -> DataFrame:
    body = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    return body.select(
        "doc_id",
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.xxhash64("body").alias("check"),
        F.octet_length("body").alias("bytes"),
        F.pmod(F.xxhash64("doc_id"), F.lit(leaves)).cast("int").alias("run"),
    )


def _merged(entries: DataFrame, least: Column, count: Column) -> DataFrame:
    """One entry for each digest of a run; a struct as the least value makes Spark merge by order."""
    merged = entries.groupBy("run", *KEY).agg(F.min(F.when(least.isNotNull(), F.struct(least.alias("id")))).alias("first"), count.alias("n"))
    return merged.select("run", *KEY, F.col("first.id").alias("keep_id"), "n")


def leaf_runs(entries: DataFrame) -> DataFrame:
    return _merged(entries, F.col("doc_id"), F.count(F.lit(1)))


def merge_runs(runs: DataFrame, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """The root's run of the leaves' runs."""
    level, width = runs, leaves
    while width > 1:
        width = -(-width // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        level = _merged(level, F.col("keep_id"), F.sum("n"))
    return level.drop("run")


def exact_dedup(docs: DataFrame, leaves: int = LEAVES, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: which copy of its text stays.

    Columns: doc_id, keep_id, group_size (rows with this text), kept, text_sha256.

    * Texts are equal if identical after white space is normalised.
    * A null text equals the empty text.
    * Of equal texts the smallest doc_id stays.  Rows that repeat a doc_id and
      its text share one verdict.
    * A row without a doc_id stays only if no row of its text has one.
    * Other columns are ignored; an empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession, "exact-dedup")
    entries = work.table(digest_entries(docs, leaves), "entries")
    runs = work.table(leaf_runs(entries), "runs")
    verdict = runs.select("run", *KEY).join(merge_runs(runs, leaves, fan_in), KEY)
    return entries.join(verdict, ["run", *KEY]).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, that of the smallest doc_id, of each text.

    * A row goes by its own text, also where other rows have its doc_id.
    * Of rows equal in doc_id and text one stays, whatever their other columns.
    * A row without a doc_id stays only if no row of its text has one; then
      one of them stays.
    """
    work = Workspace(docs.sparkSession, "exact-drop")
    verdict = exact_dedup(docs).select("doc_id", F.unhex("text_sha256").alias("key"), F.col("kept").alias("stays"))
    key = F.unhex(F.sha2(normalised(F.col("text")), 256))
    return surviving(docs, key, work.table(verdict, "verdict"), once_without_id=True)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of :func:`exact_dedup` on every document, nulls and odd rows as stated there."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""
