"""An inverted index with block maxima: exact best documents by BM25, most postings unread.

Documents fall in classes by the binary logarithm of their length; a class has blocks of its own, since what
a word can give depends on the length above all. Within a class a word's postings are dealt by the first bits
of the document's hash, as many as leave about ``BLOCK`` of them together: a word that most documents have is
many rows, and no task gathers it. A block carries the greatest part of a score that one of its postings gives.

A query is answered in three steps. Its rarest words' postings name documents, and the k-th best of their whole
scores is a bound. In each class, words whose greatest parts together (of no more of them than such a document has words)
stay below a part of it can't bring a document up alone: only the blocks of the other words are read, and of those only
blocks that reach the bound with the best of the query's other words. Documents that can still reach it are then
looked up in the frequent words' blocks, one block for a word and a document. All comparisons leave ``SLACK`` for the
order of additions, so the result is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import pinned

K1, B = 1.5, 0.75
BLOCK = 512
#: Folders of a stored index: a search opens those of its words.
PARTS = 64
#: Postings and blocks of a word that are enough for a first bound.
SEED_POSTINGS, SEED_BLOCKS = 256, 32
SLACK = 1e-7
#: Words that aren't read first may add up to this part of the bound: the less, the fewer documents are looked up.
SHARE = 0.5


def _counts(words: pa.Array) -> pa.Array:
    """Of each list: its different words and how often it has them."""
    size = np.diff(words.offsets.to_numpy())
    flat = words.flatten().dictionary_encode()
    wide = max(1, len(flat.dictionary))
    key, n = np.unique(np.repeat(np.arange(len(size)), size) * wide + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, code = np.divmod(key, wide)
    found = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64())], ["token", "tf"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(size) + 1)), pa.int32()), found)


def _part(token: Column | str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PARTS)).cast("int")


def _place(h: Column, bits: Column) -> Column:
    """The first bits of a hash, as a number."""
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(h, 64 - bits)")).cast("long")


@dataclass
class Index:
    """blocks: part, token, size, place, top, docs (doc, h, tf, len); words: token, df, size, held, bits, top; n documents of ``mean`` words.

    size: a class of documents; held, bits and top: the word's postings there, the bits of place and the greatest impact.
    """

    blocks: DataFrame
    words: DataFrame
    docs: DataFrame
    n: int
    mean: float

    def save(self, path: str) -> None:
        self.blocks.repartition("part").sortWithinPartitions("token", "size", "place").write.partitionBy("part").parquet(f"{path}/blocks")
        self.words.write.parquet(f"{path}/words")
        self.docs.write.parquet(f"{path}/docs")
        self.docs.sparkSession.createDataFrame([(self.n, self.mean)], "n bigint, mean double").write.parquet(f"{path}/statistics")


def load(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    one = read("statistics").first()
    return Index(read("blocks"), read("words"), read("docs"), one["n"], one["mean"])


def impact(mean: float) -> Column:
    """The part of a score that a posting gives, without the word's weight."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))


def build(docs: DataFrame, only: DataFrame | None = None, block: int = BLOCK) -> Index:
    """The index of docs: doc, text. ``only`` (token) keeps the postings of the words that will be asked."""
    texts = docs.select("doc", T.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    rows = texts.select("doc", F.xxhash64("doc").alias("h"), F.size("w").cast("long").alias("len"), F.arrow_udf(_counts, "array<struct<token:string,tf:bigint>>")("w").alias("e"))
    flat = rows.select("doc", "h", "len", F.explode("e").alias("e")).select("doc", "h", "len", "e.token", "e.tf")
    n, mean = texts.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
    mean = mean or 1.0
    if only is not None:
        flat = flat.join(only.select("token").distinct(), "token", "left_semi")
    flat = pinned(flat.withColumn("size", F.floor(F.log2(F.greatest("len", F.lit(1)))).cast("int")))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("held") / block))).cast("int")
    words = flat.groupBy("token", "size").agg(F.count(F.lit(1)).alias("held"), F.max(impact(mean)).alias("top"))
    words = pinned(words.select("token", "size", "held", "top", F.sum("held").over(W.partitionBy("token")).alias("df"), bits.alias("bits")))
    placed = flat.join(words.select("token", "size", "bits"), ["token", "size"]).withColumn("place", _place(F.col("h"), F.col("bits")))
    blocks = placed.groupBy("token", "size", "place").agg(F.max(impact(mean)).alias("top"), F.sort_array(F.collect_list(F.struct("doc", "h", "tf", "len"))).alias("docs"))
    return Index(pinned(blocks.withColumn("part", _part("token"))), words, docs.select("doc"), n, mean)


def asked(index: Index, queries: DataFrame) -> DataFrame:
    """qid, token, size, weight, most (its greatest part of a score there), bits, held, df: the words of each query that any document has."""
    own = queries.select("qid", F.explode(F.array_distinct(T.tokens(F.coalesce("text", F.lit(""))))).alias("token"))
    weight = F.log(1 + (index.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return own.join(index.words, "token").select("qid", "token", "size", weight.alias("weight"), (weight * F.col("top")).alias("most"), "bits", "held", "df")


def bounds(index: Index, words: DataFrame, k: int) -> DataFrame:
    """qid, bound: k documents reach it (0 if there are fewer), the best ones by the rarest words, with their whole scores."""
    rare = W.partitionBy("qid").orderBy("df", "token", "size").rowsBetween(W.unboundedPreceding, -1)
    seeds = words.withColumn("seen", F.coalesce(F.sum("held").over(rare), F.lit(0))).filter(F.col("seen") < max(SEED_POSTINGS, 10 * k))
    tops = index.blocks.select("token", "size", "place", F.col("top").alias("high")).join(seeds.select("token", "size").distinct(), ["token", "size"], "left_semi")
    rank = F.row_number().over(W.partitionBy("token", "size").orderBy(F.desc("high"), "place"))
    chosen = tops.withColumn("r", rank).filter(F.col("r") <= max(SEED_BLOCKS, k)).select("token", "size", "place")
    parts = _postings(index, index.blocks.join(chosen, ["token", "size", "place"]).join(seeds.select("qid", "token", "size", "weight"), ["token", "size"]))
    scores = parts.groupBy("qid", "doc", "h", "size").agg(F.sum("part").alias("score"))
    order = W.partitionBy("qid").orderBy(F.desc("score"))
    first = scores.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 4 * k).select("qid", "doc", "h", "size")
    whole = _looked_up(index, first, words).groupBy("qid", "doc").agg(F.sum("score").alias("score"))
    return whole.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).groupBy("qid").agg(F.min(F.when(F.col("r") == k, F.col("score"))).alias("bound"))


def _looked_up(index: Index, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """qid, doc, score: what each of the query's words gives to the documents of pairs (qid, doc, h, size). One block for a word and a document."""
    keyed = pairs.join(words.select("qid", "token", "size", "weight", "bits"), ["qid", "size"]).select("qid", "doc", "token", "size", "weight", _place(F.col("h"), F.col("bits")).alias("place"))
    touched = index.blocks.join(keyed.select("token", "size", "place").distinct(), ["token", "size", "place"], "left_semi")
    flat = touched.select("token", F.explode("docs").alias("e")).select("token", "e.doc", "e.tf", "e.len")
    return keyed.join(flat, ["token", "doc"]).select("qid", "doc", (F.col("weight") * impact(index.mean)).alias("score"))


def _postings(index: Index, blocks: DataFrame) -> DataFrame:
    flat = blocks.select("qid", "size", "weight", F.explode("docs").alias("e")).select("qid", "size", "weight", "e.*")
    return flat.select("qid", "doc", "h", "size", (F.col("weight") * impact(index.mean)).alias("part"))


def wanted(index: Index, words: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query words of each class with essential, rest (what the words that aren't can add) and bound; and the blocks that may hold a best document.

    A query's words of a class are sorted by their greatest part; documents there have at most ``most_words`` of them.
    """
    own = F.sort_array(F.collect_list(F.struct("most", "token", "weight", "bits")))
    sets = words.groupBy("qid", "size").agg(own.alias("w")).join(limits, "qid", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - SLACK)
    sums = F.aggregate("w", F.array(F.lit(0.0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["most"])))
    most_words = F.least(F.size("w").cast("double"), F.pow(F.lit(2.0), F.col("size") + 1) - 1).cast("int")
    sets = sets.withColumn("sums", sums).withColumn("most_words", most_words)
    reach = lambda i: F.get("sums", i) - F.get("sums", F.greatest(i - F.col("most_words"), F.lit(0)))  # noqa: E731  of the first i words
    each = sets.select("qid", "size", "bound", F.posexplode("w").alias("i", "e"), "sums", "most_words", F.size("w").alias("n"), F.get("w", F.size("w") - F.col("most_words"))["most"].alias("last"))
    rated = each.select("qid", "size", "bound", "e.*", reach(F.col("i") + 1).alias("reach"), reach(F.col("n")).alias("all"), "last")
    essential = F.col("reach") >= F.col("bound") * SHARE
    rest = F.coalesce(F.max(F.when(~essential, F.col("reach"))).over(W.partitionBy("qid", "size")), F.lit(0.0))
    rated = pinned(rated.select("qid", "size", "token", "weight", "bits", "bound", essential.alias("essential"), rest.alias("rest"), (F.col("all") - F.greatest("most", "last")).alias("others")))
    mine = rated.filter("essential").select("qid", "token", "size", "weight", "bound", "others")
    blocks = index.blocks.join(mine, ["token", "size"]).filter(F.col("weight") * F.col("top") + F.col("others") >= F.col("bound"))
    return rated, blocks


def best(index: Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """qid, rank, doc, score: the best k documents of each query, ties by document, those without a common word last."""
    words = pinned(asked(index, queries))
    parts = [r["p"] for r in words.select(_part("token").alias("p")).distinct().collect()]  # PARTS at most
    index = Index(index.blocks.filter(F.col("part").isin(parts)), index.words, index.docs, index.n, index.mean)
    rated, blocks = wanted(index, words, bounds(index, words, k))
    limit = rated.select("qid", "size", "bound", "rest").distinct()
    found = _postings(index, blocks).groupBy("qid", "doc", "h", "size").agg(F.sum("part").alias("score"))
    found = pinned(found.join(limit, ["qid", "size"]).filter(F.col("score") + F.col("rest") >= F.col("bound")).select("qid", "doc", "h", "size", "score"))
    more = _looked_up(index, found, rated.filter("not essential"))
    scores = found.select("qid", "doc", "score").unionByName(more).groupBy("qid", "doc").agg(F.sum("score").alias("score"))
    order = W.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc")
    top = pinned(scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    # Queries that fewer than k documents share a word with: the first of the others, of which 2k are enough.
    count = top.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    short = queries.select("qid").join(count, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("n") < k)
    first = index.docs.orderBy("doc").limit(2 * k)
    fill = short.crossJoin(F.broadcast(first)).join(top.select("qid", "doc"), ["qid", "doc"], "left_anti")
    fill = fill.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy("doc"))).filter(F.col("r") + F.col("n") <= k)
    return top.select("qid", "rank", "doc", "score").unionByName(fill.select("qid", (F.col("r") + F.col("n")).cast("int").alias("rank"), "doc", F.lit(0.0).alias("score")))
