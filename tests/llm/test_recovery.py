"""What a repeated task leaves behind: equal files under equal names, and nothing of a failed attempt."""

import pytest
from pyspark.sql import functions as F

from wayfold.llm import word_bpe
from wayfold.llm.shared_files import reading, writing
from wayfold.workspace import Workspace, scratch, shared_root


def chunk_of(texts):
    c = word_bpe.Chunk()
    for i, t in enumerate(texts):
        c.add(i, t.split())
    return c


def test_a_repeated_chunk_is_the_same(tmp_path):
    texts = ["b a c a", "", "d é b"]
    seen = []
    for _ in range(2):
        rows = list(word_bpe.write_chunk(chunk_of(texts), str(tmp_path), "chunk", 4))
        seen.append((rows, (tmp_path / "chunk").read_bytes()))
    assert seen[0] == seen[1]
    words = [w for b, _, block in seen[0][0] if b >= 0 for w in block.split("\n")]
    ids, codes, lengths = word_bpe.read_chunk(str(tmp_path), "chunk")
    assert ids == [0, 1, 2] and lengths.tolist() == [4, 0, 3]
    assert [words[c] for c in codes] == "b a c a d é b".split()


def test_a_failed_attempt_has_no_file(tmp_path):
    with pytest.raises(RuntimeError), writing(str(tmp_path), "x") as out:
        out.write(b"half")
        raise RuntimeError
    assert not list(tmp_path.iterdir())
    with writing(str(tmp_path), "x") as out:
        out.write(b"whole")
    with writing(str(tmp_path), "x") as out:
        out.write(b"again")
    with reading(f"file://{tmp_path}", "x") as f:
        assert f.read() == b"again"


def test_workspace(spark):
    work = Workspace(spark, "test")
    assert work.path.startswith(shared_root(spark))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    df = work.table(spark.range(100).withColumn("x", F.lit("a")), "t", batch_rows=7, small=True)
    assert spark.conf.get(key) == before and df.count() == 100 and len(df.inputFiles()) <= 4
    work.drop()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(work.folder("t")).count()


def test_scratch_drops_what_was_opened_within(spark):
    kept = Workspace(spark, "test")
    with scratch():
        inner = Workspace(spark, "test")
        copy = kept.table(inner.table(spark.range(5), "a"), "b")
    assert copy.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(inner.folder("a")).count()
