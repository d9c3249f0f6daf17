"""What the operators share: tables in the shared folder, ids, texts and Arrow helpers.

Nulls: a null text counts as empty. A null id sorts after every other id and is returned as null.
Only the named columns of an input are read, so extra columns with any names are harmless.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Stands for a null id inside the operators: it sorts last.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_of(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def back_to_id(name: str) -> Column:
    return F.when(F.col(name) == NO_ID, F.lit(None).cast("long")).otherwise(F.col(name))


def has_words(text: Column, blank: str) -> Column:
    """Whether there is anything but blank characters; trimming at the left stops at the first one."""
    return F.ltrim(text, F.lit(blank)) != ""


def once(docs: DataFrame, blank: str) -> DataFrame:
    """The documents with one row of those that share both id and text; texts of blank characters alone stay."""
    names = named(docs, "id", "a", "b")
    key = [c.alias(n) for c, n in zip((id_of(), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")), names, strict=True)]
    again = docs.filter(has_words(F.col("text"), blank)).groupBy(*key).count().filter("count > 1").select(*names)
    again = Scratch(docs.sparkSession).save(again)
    if not again.limit(1).count():
        return docs
    keyed = docs.select("*", *key)
    one = keyed.join(again, names, "left_semi").dropDuplicates(names)
    return keyed.join(again, names, "left_anti").unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal rows by key to as many tasks as the session has shuffle partitions."""
    return df.repartition(partitions(df), *cols)


def in_turn(df: DataFrame, share: str) -> DataFrame:
    """Deal numbered shares to the tasks in turn, so that all get as many; each task has them one after the other."""
    return df.repartitionById(partitions(df), share).sortWithinPartitions(share)


def named(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, or longer ones where the table has columns of these names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(sizes: np.ndarray, limit: int):
    """Slices of consecutive rows whose sizes add up to at most limit (one row at least)."""
    start, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > start and total + s > limit:
            yield start, i
            start, total = i, 0
        total += s
    if len(sizes) > start:
        yield start, len(sizes)


def utf8(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width, kind = np.int32, 4
    else:
        width, kind = np.int64, 8
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(offsets, width, len(column) + 1, column.offset * kind).astype(np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: every input bit reaches every output bit."""
    x = x + MIX[0]
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))
