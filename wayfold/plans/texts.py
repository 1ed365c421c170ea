"""Queries: claims and evidence, terms, markup, nested cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import text
from wayfold.plans.base import query
from wayfold.sources import sinks
from wayfold.sources.tables import table, tables


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\d+')) AS BIGINT) AS n_numbers,
       CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), '\d+'))) AS BIGINT) AS n_distinct,
       CAST(len(regexp_extract_all(coalesce(text, ''), '\[\d+\]')) AS BIGINT) AS n_citations FROM documents""")
def token_extract(spark: SparkSession, sf: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    runs = F.regexp_extract_all(body, F.lit(r"(\d+)"), 1)
    return table(spark, sf, "documents").select(
        "doc_id",
        F.size(runs).cast("long").alias("n_numbers"),
        F.size(F.array_distinct(runs)).cast("long").alias("n_distinct"),
        F.size(text.citations(body)).cast("long").alias("n_citations"),
    )


_WORDS = r"list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{6,}'))"


@query(f"""
WITH q AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
n AS (SELECT item_id, count(*) AS need FROM q GROUP BY 1),
h AS (SELECT q.item_id, d.doc_id, count(*) AS got FROM q JOIN d ON q.w = d.w GROUP BY ALL)
SELECT h.item_id, CAST(count(*) AS BIGINT) AS n_docs, array_to_string(list_sort(list(h.doc_id))[1:3], ',') AS first_docs
FROM h JOIN n ON h.item_id = n.item_id WHERE got >= need * 0.8 GROUP BY h.item_id""")
def evidence_search(spark: SparkSession, sf: str) -> DataFrame:
    """For each claim the documents that hold at least four fifths of its words."""
    benchmark, documents = tables(spark, sf, "benchmark", "documents")

    def words(df: DataFrame, key: str) -> DataFrame:
        found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{6,})"), 1))
        return df.select(key, F.explode(found).alias("w"))

    q = words(benchmark, "item_id")
    d = words(documents, "doc_id").join(q.select("w").distinct(), "w", "left_semi")
    need = q.groupBy("item_id").agg(F.count(F.lit(1)).alias("need"))
    hits = q.join(d, "w").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("got"))
    enough = hits.join(need, "item_id").filter(F.col("got") >= F.col("need") * 0.8)
    # the first three by rank, so that no list of a claim's documents is gathered
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("doc_id"))
    first = enough.withColumn("place", place).filter("place <= 3").groupBy("item_id").agg(
        F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_docs")
    )
    return enough.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs")).join(first, "item_id")


@query(r"""
WITH n AS (SELECT doc_id, CAST(unnest(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '\d+'), lambda x: length(x) <= 3))) AS INTEGER) AS v FROM documents)
SELECT DISTINCT doc_id, v FROM n WHERE v NOT IN (SELECT p_size FROM part)""")
def orphan_values(spark: SparkSession, sf: str) -> DataFrame:
    """Short numbers of texts that no cell of the table has."""
    documents, part = tables(spark, sf, "documents", "part")
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\d+)"), 1)
    v = documents.select("doc_id", F.explode(F.filter(runs, lambda x: F.length(x) <= 3)).alias("v"))
    v = v.select("doc_id", F.col("v").cast("int").alias("v")).distinct()
    return v.join(part.select(F.col("p_size").alias("v")).distinct(), "v", "left_anti").select("doc_id", "v")


_TERMS = ["password", "token", "license", "copyright", "secret", "@mail"]


@query(f"""
WITH t(term) AS (VALUES {", ".join(f"('{t}')" for t in _TERMS)})
SELECT term, CAST(count(*) FILTER (WHERE instr(lower(text), term) > 0) AS BIGINT) AS n_docs, min(doc_id) FILTER (WHERE instr(lower(text), term) > 0) AS first_doc FROM documents, t GROUP BY term""")
def banned_terms(spark: SparkSession, sf: str) -> DataFrame:
    """All terms are tested in one pass; the result is a row for each."""
    low = F.lower("text")
    docs = table(spark, sf, "documents")
    parts = []
    for i, t in enumerate(_TERMS):
        hit = F.instr(low, F.lit(t)) > 0
        parts += [F.count(F.when(hit, 1)).alias(f"n{i}"), F.min(F.when(hit, F.col("doc_id"))).alias(f"f{i}")]
    rows = F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"n{i}").alias("n_docs"), F.col(f"f{i}").alias("first_doc")) for i, t in enumerate(_TERMS)))
    return docs.agg(*parts).select(F.explode(rows).alias("r")).select("r.*")


@query("""
SELECT doc_id, instr(text, 'license') AS at, substr(text, greatest(1, instr(text, 'license') - 20), instr(text, 'license') - greatest(1, instr(text, 'license') - 20) + 7 + 20) AS context
FROM documents WHERE instr(text, 'license') > 0""")
def context_window(spark: SparkSession, sf: str) -> DataFrame:
    at = F.instr(F.col("text"), F.lit("license"))
    docs = table(spark, sf, "documents").filter(at > 0)
    return docs.select("doc_id", at.cast("long").alias("at"), text.context(F.col("text"), at, F.lit(7), 20).alias("context"))


@query(r"""
SELECT page_id, CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(html, '<p\b')) AS BIGINT) AS n_paragraphs,
       CAST(len(regexp_extract_all(html, '<a\b')) AS BIGINT) AS n_links, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages""")
def markup_profile(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id",
        F.length(text.without_tags(F.col("html"))).cast("long").alias("n_chars"),
        text.tag_count(F.col("html"), "p").alias("n_paragraphs"),
        text.tag_count(F.col("html"), "a").alias("n_links"),
        F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"),
    )


@query("""
WITH m AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL), n AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1)
SELECT m.conv_id, role, first_turn, coalesce(lead(first_turn) OVER (PARTITION BY m.conv_id ORDER BY first_turn, role) - 1, last_turn) AS until_turn FROM m JOIN n ON m.conv_id = n.conv_id""")
def page_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """From the first mention of each marker to the one before the next marker."""
    c = table(spark, sf, "conversations")
    first = c.groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("_m"))
    w = Window.partitionBy("conv_id")
    until = F.coalesce(F.lead("first_turn").over(w.orderBy("first_turn", "role")) - 1, F.max("_m").over(w))
    return first.select("conv_id", "role", "first_turn", until.alias("until_turn"))


@query("""
SELECT user_id AS cell, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_cells_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of nested rows, flattened, with a field of their JSON."""
    cells = table(spark, sf, "events").groupBy(F.col("user_id").alias("cell")).agg(F.collect_list(F.struct("event_id", "props")).alias("rows"))
    return cells.selectExpr("cell", "inline(rows)").select("cell", "event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("""
SELECT n_nationkey, '| ' || n_name || ' | ' || CAST(n_regionkey AS VARCHAR) || ' |' AS row FROM nation""")
def markdown_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", sinks.markdown_row(F.col("n_name"), F.col("n_regionkey")).alias("row"))


@query("""
WITH r AS (SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1)
SELECT CAST(n_regionkey AS VARCHAR) AS region, n FROM r UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT) FROM r""")
def total_row(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("string").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.with_total(counted, "region", "TOTAL", ["n"])


@query("SELECT CAST(count(*) FILTER (WHERE instr(replace(text, 'token', '***'), 'token') > 0) AS BIGINT) AS n_leaks FROM documents")
def mask_leaks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(sinks.masked(F.col("text"), "token").alias("text"))
    return sinks.leaks(docs, ["text"], "token")


@query("""
WITH w AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, len(w) > 0 AS has_words FROM w""")
def wrap_presence(spark: SparkSession, sf: str) -> DataFrame:
    """A turn takes lines if and only if it has words."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.wrapped_lines(F.col("text"), 40).alias("n"))
    return rows.select("conv_id", "turn", (F.col("n") > 0).alias("has_words"))


@query("""
WITH a AS (SELECT role, turn, length(text) AS n FROM conversations WHERE conv_id % 2 = 0), b AS (SELECT role, turn, length(text) AS n FROM conversations WHERE conv_id % 2 = 1)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_first, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_second""")
def run_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that only one of two runs has, with their multiplicity, from one aggregation."""
    rows = table(spark, sf, "conversations").select("role", "turn", F.length("text").alias("n"), (F.col("conv_id") % 2).alias("side"))
    d = rows.groupBy("role", "turn", "n").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("d"))
    return d.agg(
        F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).cast("long").alias("only_first"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).cast("long").alias("only_second"),
    )
