"""Streaming forms: heartbeats with a time to live, the best verdict of each pair, a frozen set of sources, a running budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TTL = "90 seconds"


def sessions(heartbeats: DataFrame, ttl: str = TTL, late: str = "10 minutes") -> DataFrame:
    """session key, start, last-by and beats of each run of heartbeats with no gap over the time to live."""
    return heartbeats.withWatermark("ts", late).groupBy(F.session_window("ts", ttl).alias("w"), "key").agg(F.count(F.lit(1)).alias("beats")).select("key", F.col("w.start").alias("started"), F.col("w.end").alias("stale_at"), "beats")


def _newest(spark: SparkSession, path: str, until: int | None) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The newest finished epoch of each bucket, and the (epoch, bucket) folders that it superseded."""
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    number = lambda f: int(f.getPath().getName().partition("=")[2])
    named = lambda at, kind: [f for f in fs.listStatus(at) if f.getPath().getName().startswith(kind)]
    newest, old = {}, []
    for epoch in sorted(named(base, "epoch=") if fs.exists(base) else [], key=number):
        at = epoch.getPath()
        if (until is not None and number(epoch) > until) or not fs.exists(at.suffix("/_SUCCESS")):
            continue
        for bucket in map(number, named(at, "bucket=")):
            if bucket in newest:
                old.append((newest[bucket], bucket))
            newest[bucket] = number(epoch)
    return newest, old


def best(spark: SparkSession, path: str, until: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """What ``upsert_best`` has kept so far (or up to an epoch, of some buckets); None before the first batch."""
    newest = _newest(spark, path, until)[0]
    paths = [f"{path}/epoch={e}/bucket={b}" for b, e in sorted(newest.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def upsert_best(stream: DataFrame, path: str, fold, key: list[str], buckets: int = 64):
    """A writer that keeps fold(all rows so far) of an append-only stream as a table at path; read it with ``best``.

    The table is dealt to buckets by the key that ``fold`` folds by (its columns stay in the result). A
    batch reads and writes the buckets it touches only, in a folder of its own, so a batch that is
    replayed gives the same result; buckets that a finished earlier batch superseded are deleted.
    """

    def batch(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        of_key = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        touched = [r[0] for r in rows.select(of_key).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return
        before = best(spark, path, epoch - 1, touched)
        both = rows if before is None else before.unionByName(rows)
        fold(both).withColumn("bucket", of_key).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/epoch={epoch}")
        for e, b in _newest(spark, path, epoch - 1)[1]:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={e}/bucket={b}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return stream.writeStream.foreachBatch(batch)


def intake(stream: DataFrame, frozen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of sources in the frozen set (a table of ids), and rows that came too late for it. Both keep no state."""
    ids = frozen.select("id").distinct()
    return stream.join(ids, "id", "left_semi"), stream.join(ids, "id", "left_anti")


def running_budget(requests: DataFrame, total: int, key: str, order: str, amount: str) -> DataFrame:
    """key, order, granted, remaining as requests arrive: whole or not at all, one counter of state per key.

    Rows of a micro-batch are taken in order; batches come as they come. Zero, less and null are
    granted for nothing.
    """
    rows = requests.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("n"))

    def take(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        left = state.get[0] if state.exists else total
        batch = pd.concat(list(parts)).sort_values("o")
        granted, remaining = [], []
        for n in batch["n"]:
            fits = n <= left or n <= 0
            left -= max(int(n), 0) if fits else 0
            granted.append(bool(fits))
            remaining.append(left)
        state.update((left,))
        yield pd.DataFrame({"k": k[0], "o": batch["o"].to_numpy(), "granted": granted, "remaining": remaining})

    done = rows.groupBy("k").applyInPandasWithState(take, "k string, o bigint, granted boolean, remaining bigint", "unspent bigint", "append", "NoTimeout")
    return done.select(F.col("k").cast(requests.schema[key].dataType).alias(key), F.col("o").alias(order), "granted", "remaining")
