"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's texts, in an order of their hashes, are one stream of words, cut into blocks of ``block_words``.
The mix takes whole passes over a source's blocks and then a part of one more, in an order of its own for
each pass (a keyed permutation of block numbers, computed, not stored), until it has the target's words: the
last block is cut there, so every source gets its rounded target exactly, and no word comes more often than
``most`` times.

Blocks are dealt to output shards by a binary tree: a node has a quota of blocks for each source, the left half
of its shards gets a multivariate hypergeometric draw of them, the right half the rest. So each shard has its
exact share of blocks, in sources as a shuffle of all blocks would have given, and the shards' ranges of a
source's draws are disjoint. A node's draw depends on the seed and its place in the tree alone: each task
walks to its shards by itself. Blocks of a shard are then shuffled within it.

Targets: sources in order of code points, null last, weigh ``weights`` in turn and share ``budget`` times all
words; a source's target stops at ``most`` times its words, and what is over is shared again by weight.

Size: number of words; null text: 0, and such rows are never taken. Equal rows are one text after another in the
stream: each has its own words. Long texts are whole and span many blocks. Null ids are kept. An empty table
gives an empty result. Other columns are not read. Reruns give the same mix for the same rows and seed,
however they are partitioned. The driver and the tasks hold one row per source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import MIX, Scratch, mix64, table

WEIGHTS = (3, 1, 2)
BUDGET = Fraction(3, 2)
MOST = 2
BLOCK_WORDS = 256
#: Blocks of a shard.
SHARD_BLOCKS = 4096
SEED = 12
#: Texts whose places are summed in one task.
BUCKET_ROWS = 1 << 12
#: numpy's hypergeometric draws take populations below this.
LARGEST_POPULATION = 10**9


def words(text: Column) -> Column:
    """Number of runs of other characters than blanks."""
    return F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, most: int = MOST) -> list[Fraction]:
    """Words wanted of each source; sizes are in the order of the sources."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, open_ = budget * sum(sizes), set(range(len(sizes)))
    out = [Fraction(0)] * len(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = {i for i in open_ if unit * weight[i] > most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ -= full
    return out


class Order:
    """A keyed permutation of 0..n-1: four Feistel rounds on twice as many bits, walked until inside."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.low = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = mix64(np.arange(1, 5, dtype=np.uint64) * MIX[0] + np.uint64(key & (2**64 - 1)))

    def _round(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.low
        for k in keys:
            if back:
                a, b = b ^ (mix64(a + k) & self.low), a
            else:
                a, b = b, a ^ (mix64(b + k) & self.low)
        return (a << self.half) | b

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = np.asarray(x, np.uint64).copy()
        at = np.arange(len(out))
        while len(at):
            out[at] = self._round(out[at], self.keys[::-1] if back else self.keys, back)
            at = at[out[at] >= self.n]
        return out.astype(np.int64)

    def block(self, rank: np.ndarray) -> np.ndarray:
        return self._walk(rank, False)

    def rank(self, block: np.ndarray) -> np.ndarray:
        return self._walk(block, True)


def _key(*parts: int) -> int:
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = mix64(x ^ np.uint64(p & (2**64 - 1)))
    return int(x[0])


@dataclass
class Share:
    """What is drawn of a source: draws in order, the last one cut."""

    words: int  # of the source
    taken: int
    no: int
    seed: int
    size: int  # words of a block

    def __post_init__(self) -> None:
        self.blocks = -(-self.words // self.size)
        self.short = self.words - (self.blocks - 1) * self.size if self.blocks else 0
        passes, rest = divmod(self.taken, self.words) if self.words else (0, 0)
        self.draws, self.cut = passes * self.blocks, 0
        if rest:
            at = int(self.order(passes).rank(np.array([self.blocks - 1]))[0])  # when the short block comes
            if rest <= at * self.size:
                n = -(-rest // self.size)
                self.cut = rest - (n - 1) * self.size
            elif rest <= at * self.size + self.short:
                n, self.cut = at + 1, rest - at * self.size
            else:
                n = 1 + -(-(rest - self.short) // self.size)
                self.cut = rest - self.short - (n - 2) * self.size
            self.draws += n

    def order(self, nth: int) -> Order:
        return Order(self.blocks, _key(self.seed, self.no, nth))

    def drawn(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words of the draws first..last-1."""
        d = np.arange(first, last)
        nth, rank = np.divmod(d, self.blocks)
        block = np.empty_like(d)
        for p in np.unique(nth).tolist():
            block[nth == p] = self.order(p).block(rank[nth == p])
        n = np.where(block == self.blocks - 1, self.short, self.size)
        if self.cut and last == self.draws:
            n[-1] = self.cut
        return nth, block, n


def hypergeometric(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among n drawn of all."""
    if int(have.sum()) < LARGEST_POPULATION:
        return rng.multivariate_hypergeometric(have, n, method="marginals")
    out, rest = np.zeros_like(have), int(have.sum())
    for i, k in enumerate(have.tolist()):  # kind by kind; so large a population has a normal distribution to all digits
        rest -= k
        if k + rest < LARGEST_POPULATION:
            x = int(rng.hypergeometric(k, rest, n)) if k + rest else 0
        else:
            total = k + rest
            sd = math.sqrt(max(0.0, n * (k / total) * (rest / total) * ((total - n) / max(1, total - 1))))
            x = min(max(round(n * k / total + sd * rng.standard_normal()), max(0, n - rest)), k, n)
        out[i] = x
        n -= x
    return out


def quotas(draws: np.ndarray, shards: int, seed: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard, each source's first draw and number of draws: of the shards first..last-1 alone."""
    stack = [(0, shards, np.zeros_like(draws), draws)]
    while stack:
        lo, hi, at, have = stack.pop()
        if hi <= first or lo >= last:
            continue
        if hi - lo == 1:
            yield lo, at, have
            continue
        mid = (lo + hi) // 2
        total = int(have.sum())
        left = hypergeometric(np.random.default_rng(_key(seed, lo, hi)), have, total * (mid - lo) // (hi - lo))
        stack += [(mid, hi, at + left, have - left), (lo, mid, at, left)]


@dataclass
class Mix:
    """Of each row: doc_id, h, source_no, source_size, target, size, begin (its first word in its source's stream).
    Of each run of words in the mix: shard, place, source_no, pass, block, doc_id, h, begin, from_word, n_words."""

    docs: DataFrame
    spans: DataFrame


def _hash(seed: int, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def _ordered(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        words(F.coalesce(F.col(text_col), F.lit(""))).alias("size"),
        _hash(seed, id_col, text_col).alias("h"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: Fraction = BUDGET, most: int = MOST, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> Mix:
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = _ordered(docs, id_col, text_col, source_col, seed)
    rows = scratch.save(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("times")))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["size"] for r in sums]
    wanted = targets(sizes, weights, budget, most)
    shares = [Share(w, min(math.floor(t + Fraction(1, 2)), most * w), i, seed, block_words) for i, (w, t) in enumerate(zip(sizes, wanted, strict=True))]
    sources = spark.createDataFrame([(i, r["source"], r["size"], float(t)) for i, (r, t) in enumerate(zip(sums, wanted, strict=True))], "source_no int, source string, source_size bigint, target double")
    # A source's stream of words: hashes in order, summed by ranges of hashes first.
    bits = max(0, (max([r["n"] for r in sums], default=0) // BUCKET_ROWS).bit_length())
    part = F.shiftright(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long")
    named = rows.join(F.broadcast(sources), rows["source"].eqNullSafe(sources["source"])).select("doc_id", "source_no", "source_size", "target", "size", "times", "h", part.alias("range"))
    ranges = named.groupBy("source_no", "range").agg(F.sum(F.col("size") * F.col("times")).alias("n"))
    before = W.partitionBy("source_no").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("source_no", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("source_no", "range").orderBy("h", F.asc_nulls_first("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = named.join(ranges, ["source_no", "range"]).withColumn("begin", F.col("base") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(inside), F.lit(0)))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    placed = scratch.save(placed.select("doc_id", "source_no", "source_size", "target", "size", "h", (F.col("begin") + F.col("copy") * F.col("size")).alias("begin")))
    # The blocks that each text has words in.
    block = F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words)))
    pieces = placed.filter("size > 0").select("doc_id", "h", "source_no", "begin", "size", block.alias("block"))
    total = sum(s.draws for s in shares)
    shards = max(1, -(-total // shard_blocks))
    each = np.array([s.draws for s in shares], np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "place", "source_no", "pass", "block", "n"]
        for batch in batches:
            first, last = batch.column(0)[0].as_py(), batch.column(0)[-1].as_py() + 1
            for shard, at, have in quotas(each, shards, seed, first, last):
                cols = [[], [], [], []]
                for i in np.flatnonzero(have).tolist():
                    nth, no, n = shares[i].drawn(int(at[i]), int(at[i] + have[i]))
                    for c, x in zip(cols, (np.full(len(no), i), nth, no, n), strict=True):
                        c.append(x)
                if not cols[0]:
                    continue
                source_no, nth, no, n = map(np.concatenate, cols)
                place = np.random.default_rng(_key(seed, shards, shard)).permutation(len(no))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(no), shard)), pa.array(place), pa.array(source_no.astype(np.int32)), pa.array(nth.astype(np.int32)), pa.array(no), pa.array(n)], names)

    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    drawn = spark.range(0, shards, 1, tasks).mapInArrow(draw, "shard bigint, place bigint, source_no int, pass int, block bigint, n bigint")
    low = F.col("block") * block_words
    start, end = F.greatest("begin", low), F.least(F.col("begin") + F.col("size"), low + F.col("n"))
    # Spark reckons a map's result as large as its input, here the numbers of the shards, and would broadcast it.
    spans = pieces.join(drawn.hint("merge"), ["source_no", "block"]).select("shard", "place", "source_no", "pass", "block", "doc_id", "h", "begin", (start - F.col("begin")).alias("from_word"), (end - start).alias("n_words")).filter("n_words > 0")
    return Mix(placed, spans)


def with_words(docs: DataFrame, mixed: Mix, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: shard, place, begin, source_no, doc_id and the words of each span, joined by blanks. A block's spans are in order of begin."""
    blank = r"[\x20\x09-\x0D]+"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hash(seed, id_col, text_col).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t, s = texts.groupBy("doc_id", "h").agg(F.first("text").alias("text")).alias("t"), mixed.spans.alias("s")
    cut = F.slice(F.split(F.regexp_replace("text", "^" + blank, ""), blank), (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int"))
    return s.join(t, F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("s.h") == F.col("t.h"))).select("shard", "place", "begin", "source_no", "s.doc_id", F.concat_ws(" ", cut).alias("text"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """A folder for each shard, its rows in the order of the mix."""
    mixed.repartition("shard").sortWithinPartitions("shard", "place", "begin").write.partitionBy("shard").parquet(path)


def taken(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of the documents."""
    got = mixed.spans.groupBy("source_no", "begin").agg(F.sum("n_words").alias("taken"))
    docs = mixed.docs
    some = docs.filter("size > 0").join(got, ["source_no", "begin"], "left")
    cols = ["doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return some.select(*cols).unionByName(docs.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*cols))


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return taken(mix(table(spark, sf_dir, "documents")))
