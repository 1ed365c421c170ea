"""Line dedup: drop lines that many documents share.

Lines are exploded with their document and position, and the keys long enough
to count are hashed, once.  Counting the distinct documents of each hash is
planned as two partial aggregations, by (hash, document) and then by hash, so
a line of every document is spread over all tasks.  The positions to drop go
back to their text, which is put together again from what lies between them.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.workspace import Workspace

MIN_CHARS, MIN_DOCS = 40, 5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def long_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, h) of each line whose key is long enough to count; ``h`` has 128 bits."""
    # a step of its own, so that a text is hashed once and not for each of its lines
    split = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_key"), split_lines(F.col("text")).alias("lines"))
    # outer, or Spark would split each text once more to test that it has lines
    each = split.select("doc_id", "text_key", F.posexplode_outer("lines").alias("pos", "line"))
    keyed = each.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= MIN_CHARS)
    return keyed.select("doc_id", "text_key", "pos", F.unhex(F.md5("key")).alias("h"))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of lines in at least ``min_docs`` documents, and the largest doc_id that holds each."""
    return (
        lines.groupBy("h")
        .agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_id"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h", "last_id")
    )


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    A line whose key has at least 40 code points and is found in at least
    ``min_docs`` documents loses all its lines, except in the largest doc_id
    that holds it.  A document's own repetitions count once.

    * A null or empty text is one empty line, which stays.
    * Rows that repeat a doc_id are one document to the count, and each is
      cleaned by its own positions; rows without a doc_id are not counted and
      stay whole.
    * Other columns pass through; columns of the three names are replaced, and
      names that start with ``_ld_`` are reserved.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    work = Workspace(docs.sparkSession, "line-dedup")
    lines = work.table(long_lines(docs.select("doc_id", "text")), "lines")
    # a line of many documents makes this join skewed; AQE splits its rows, and the side of
    # shared lines holds one row a line
    gone = (
        lines.join(work.table(shared_lines(lines, min_docs), "shared", small=True), "h")
        .filter(F.col("doc_id") < F.col("last_id"))
        .groupBy(F.col("doc_id").alias("_ld_id"), F.col("text_key").alias("_ld_of"))
        .agg(F.array_sort(F.collect_set("pos")).alias("_ld_gone"))  # equal rows have equal positions
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = split_lines(F.col("text"))
    # what lies between positions that go, in linear time; -1 and the number of lines stand at the ends
    marks = F.concat(F.array(F.lit(-1)), F.col("_ld_gone"), F.array(F.size("_ld_lines")))
    between = F.transform(
        F.arrays_zip(F.slice("_ld_marks", 1, F.size("_ld_gone") + 1).alias("a"), F.slice("_ld_marks", 2, F.size("_ld_gone") + 1).alias("b")),
        lambda m: F.slice(F.col("_ld_lines"), m["a"] + 2, m["b"] - m["a"] - 1),
    )
    some = F.col("_ld_gone").isNotNull()
    return (
        docs.withColumn("_ld_key", F.xxhash64("text"))
        .join(gone, (F.col("doc_id") == F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_of")), "left")
        .withColumn("n_lines", (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_ld_gone"), F.lit(0)).cast("long"))
        .withColumn("_ld_lines", F.when(some, whole))
        .withColumn("_ld_marks", F.when(some, marks))
        .withColumn("kept_text", F.when(some, F.array_join(F.flatten(between), "\n")).otherwise(text))
        .select(*docs.columns, "kept_text", "n_lines", "n_dropped")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lines and digests of kept texts of all documents; see :func:`line_dedup`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
s AS (
  SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
m AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id < s.last_id AS gone
  FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
