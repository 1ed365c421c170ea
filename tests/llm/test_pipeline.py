"""The pipeline, stage by stage against the operators' own verdicts, and the queries against their SQL."""

import duckdb
import pytest

import corpus_pipeline
from wayfold.llm import exact_dedup, near_dedup, registry, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages(spark, frame, odd_docs, tmp_path):
    docs = frame(odd_docs)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
        kept[name] = sorted(r.doc_id for r in docs.select("doc_id").distinct().collect())
    ids = {i for i, _, _ in odd_docs}
    assert set(kept["language"]) == ids - {3, 4, 5, 6}
    assert set(kept["exact_dedup"]) == set(kept["language"]) - {1, 2}
    # 10 is 0 with four more words; the near copies of 40 are linked at five words
    assert 10 not in kept["near_dedup"] and 40 in kept["near_dedup"]
    assert {7, 8, 9, 11, 12, 13} <= set(kept["near_dedup"])
    assert kept["secrets"] == kept["near_dedup"] == kept["packing"]
    masked = spark.read.parquet(str(tmp_path / "secrets")).filter("doc_id = 13").first()
    assert secret_scan.MASK in masked.text and "AKIA" not in masked.text


def test_stage_decisions_are_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = {r.doc_id for r in exact_dedup.exact_dedup(docs).filter("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.stage_exact_dedup(spark, docs, SF).collect()} == exact
    near = {r.doc_id for r in near_dedup.near_dedup(docs, 5, 80).filter("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.stage_near_dedup(spark, docs, SF).collect()} == near


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = [tuple(r[c] for c in want.columns) for r in got.collect()]
    assert sorted(rows) == sorted(want.fetchall())
