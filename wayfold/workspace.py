"""Durable intermediate tables.

Jobs that run for hours lose executors.  Lineage is cut by writing a table to
the folder that the cluster names in ``spark.checkpoint.dir``, which driver
and executors share; a lost executor then costs only its running tasks.
Where the setting is absent (tests, a notebook) a folder of our own is used.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Only used where the session names no shared folder and runs on one machine.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """Folder of the session's durable tables, without a trailing slash."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs(LOCAL_FALLBACK, exist_ok=True)
        root = f"file://{LOCAL_FALLBACK}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_OPENED: list[Workspace] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Drops the workspaces opened within, once what was made from them is written elsewhere."""
    before = len(_OPENED)
    try:
        yield
    finally:
        for work in _OPENED[before:]:
            work.drop()
        del _OPENED[before:]


class Workspace:
    """A folder of durable tables for one run of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        _OPENED.append(self)

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str, batch_rows: int | None = None, small: bool = False) -> DataFrame:
        """Write ``df`` and return a reader of what was written.

        ``batch_rows`` bounds the Arrow batches that Python workers get while
        it is written, for rows of many kilobytes.  The rows of a ``small`` table,
        of a few bytes each, are dealt to an eighth of the shuffle's partitions
        once they are made, so that it is not many tiny files.
        """
        where, key = self.folder(name), "spark.sql.execution.arrow.maxRecordsPerBatch"
        if small:
            df = df.repartition(max(4, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        before = self.spark.conf.get(key)
        if batch_rows is not None:
            self.spark.conf.set(key, str(batch_rows))
        try:
            df.write.mode("overwrite").parquet(where)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self) -> None:
        """Delete the folder; only once no result that reads it is needed."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
