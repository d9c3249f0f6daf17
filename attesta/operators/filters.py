"""Before the work: a compact filter of the keys that are asked for, so that a large side isn't shuffled for a join that few of its rows pass, and narrow rows dealt over the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: ``PER_KEY`` for each key, at most MOST (a broadcast of MOST / 64 small rows).
PER_KEY, LEAST, MOST = 16, 1 << 12, 1 << 24
#: Rows of a task that does much with each; below it, rows that are worth a task of their own.
SHARE, WORTH = 1 << 15, 1 << 10


def spread(rows: DataFrame, *key: str) -> DataFrame:
    """The rows dealt evenly over the tasks (by a key, or in turn), by their number.

    A reader deals files by bytes, so millions of narrow rows, each of which takes long or becomes many, would be one task's.
    """
    n = rows.count()
    tasks = max(-(-n // SHARE), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // WORTH)), 1)
    return rows.repartition(tasks, *key)


def passing(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows whose key may be among the asked ones: none of those is lost, some others pass; an exact join follows.

    Each asked key sets one bit of a table of 64-bit words, which is broadcast: its size has a bound, whatever is asked for.
    Asked keys may repeat. So many different ones that most bits would be set: all rows pass, without a filter.
    """
    keys = asked.agg(F.approx_count_distinct(key)).first()[0]
    if keys > MOST:
        return rows
    bits = LEAST
    while bits < min(MOST, PER_KEY * keys):
        bits *= 2

    h = F.xxhash64(key)
    word, bit = F.shiftright(F.pmod(h, F.lit(bits)), 6), F.pmod(h, F.lit(64)).cast("int")
    table = asked.select(word.alias("_word"), bit.alias("_bit")).select("_word", F.expr("shiftleft(1L, _bit)").alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_set"))
    found = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(table), "_word").filter(F.expr("getbit(_set, _bit)") == 1)
    return found.select(*[F.col(f"`{c}`") for c in rows.columns])
