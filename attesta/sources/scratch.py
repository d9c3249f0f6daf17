"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is written: whole texts are wide.
BATCH_ROWS = 2500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master and an error elsewhere."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="attesta-"))
    return _LOCAL[0]


@contextmanager
def shuffled_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned within it shuffle both sides; only sides marked with broadcast() are sent to all.

    Spark goes by the size of a table's files, but millions of short rows pack into a few MB of them: each such
    side would be held whole by the driver, and a step may have several.
    """
    old = {k: spark.conf.get(k, None) for k in _BROADCAST}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors.

    What is still there when the driver ends is deleted then.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/attesta-{uuid.uuid4().hex}"
        self.count = 0

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def save(self, df: DataFrame) -> DataFrame:
        if not self.count:
            fs, where = self._at(self.base)
            fs.mkdirs(where)
            fs.deleteOnExit(where)
        self.count += 1
        path = f"{self.base}/{self.count}"
        old = self.spark.conf.get(_BATCH)
        try:
            self.spark.conf.set(_BATCH, str(min(int(old), BATCH_ROWS)))
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_BATCH, old)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._attesta_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            path = getattr(df, "_attesta_path", None)
            if path:
                fs, where = self._at(path)
                fs.delete(where, True)

    def tidy(self) -> None:
        """Let the driver's cleaner drop the shuffle files of finished steps now, not at some later GC.

        Listeners hold on to the last query that ran, so a query of no rows goes first.
        """
        self.spark.range(0).collect()
        gc.collect()
        self.spark._jvm.System.gc()
