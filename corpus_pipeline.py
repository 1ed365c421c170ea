"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from wayfold.workspace import Workspace, scratch


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without letters or of no language go."""
    return language_id.keep_identified(docs)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, linked at 0.8 of their five-word shingles, the smallest doc_id stays."""
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.mask_secrets(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    import public_tokenizers

    pieces = packing.harmonic_pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return packing.packed_digests(pieces)


STAGES = [
    ("language", stage_language),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("secrets", stage_secrets),
    ("packing", stage_packing),
]

#: Language identification is learned and so not expressible in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents."""
    work = Workspace(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch():
            docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
