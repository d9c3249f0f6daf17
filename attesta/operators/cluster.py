"""Which sources are independent: simhash, leader clusters, embeddings, provenance."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import shuffled_joins
from .graph import components, forest, leaders_by_keys, pinned

NEAR_BITS, DIMENSIONS, SIMILAR = 3, 256, 0.80
#: Words of which the counts are looked up at a time.
WORDS = 1 << 17
#: Patterns that are compared in one group.
CROWD = 2048
#: FNV-1a of 64 bits.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def _fnv1a(texts: pa.Array) -> pa.Array:
    raw = [t.encode() for t in texts.fill_null("").to_pylist()]
    size = np.array([len(b) for b in raw], np.int64)
    out = np.full(len(raw), OFFSET, np.uint64)
    flat, start = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(size)])[:-1]
    for i in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > i)
        out[live] = (out[live] ^ flat[start[live] + i].astype(np.uint64)) * np.uint64(PRIME)
    return pa.array(out.view(np.int64))


def fnv1a(text: Column | str) -> Column:
    """FNV-1a as the bit pattern of a long: all words of a batch advance byte by byte together."""
    return F.arrow_udf(_fnv1a, "bigint")(text)


def _simhash(words: pa.Array) -> pa.Array:
    size, flat = np.diff(words.offsets.to_numpy()), words.flatten()
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(len(size), np.uint64)
    b = 0
    while b < len(size):  # about WORDS words at a time, so that a batch costs little beside itself
        a, b = b, max(b + 1, int(np.searchsorted(first, first[b] + WORDS, "right")) - 1)
        part = flat.slice(first[a], first[b] - first[a]).dictionary_encode()
        if not len(part):
            continue
        hashes = np.asarray(_fnv1a(part.dictionary)).view(np.uint64)
        code = part.indices.to_numpy()
        some = a + np.flatnonzero(size[a:b])
        for bit in range(64):
            sign = ((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int32) * 2 - 1
            out[some] |= (np.add.reduceat(sign[code], first[some] - first[a]) > 0).astype(np.uint64) << np.uint64(bit)
    return pa.array(out.view(np.int64))


def simhash(sources: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
    """node, other columns, bits: a bit is set where more word occurrences have it than not; no words: 0.

    One pass without a shuffle: the distinct words of some texts are hashed once.
    """
    return sources.select(F.col(id_col).alias("node"), *also, F.arrow_udf(_simhash, "bigint")(T.tokens(F.col(text_col))).alias("bits"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _masks(bits: list[int], most: int) -> list[int]:
    """Masks of half of these bits, of which one is equal in any two patterns that differ in at most ``most`` of them.

    Of 2 * most blocks, most are without a difference; a mask keeps half of the bits, so few
    patterns of a large table share one by chance.
    """
    edges = [len(bits) * i // (2 * most) for i in range(2 * most + 1)]
    blocks = [sum(1 << b for b in bits[lo:hi]) for lo, hi in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, most)]


def _places(hashes: DataFrame, most: int, crowd: int) -> Callable[[DataFrame], DataFrame]:
    """Gives rows of scope and bits a row for each place (meet) where patterns may be near theirs. hashes: all patterns, scope and bits.

    Patterns meet where they have half of their bits in common. Where over ``crowd`` do, they meet by half of the
    other bits as well, and so on: with 64 bits and three differences, what shares a mask of the third level
    differs in 8 bits, so no place has over max(crowd, 256) patterns. Patterns that share a place may still be far apart.
    """
    spark, key = hashes.sparkSession, ["scope", "part", "value"]

    def parted(rows: DataFrame, masks: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(masks), "parent").withColumn("value", F.col("bits").bitwiseAND(F.col("mask"))).drop("parent", "mask")

    rows = hashes.select("scope", "bits").distinct().withColumn("parent", F.lit(0))
    known, levels = [(0, list(range(64)), 0)], []  # of each parent: its number, the bits left, the bits it has in common
    while True:
        children, nodes = [], []
        for parent, free, common in known:
            for mask in _masks(free, most):
                left = [b for b in free if not mask >> b & 1]
                nodes.append((len(nodes), left, common | mask))
                children.append((parent, nodes[-1][0], (common | mask) - (1 << 64) if (common | mask) >> 63 else common | mask))
        # A table of fixed size: 20, 400 or 8000 masks.
        masks = spark.createDataFrame(children, "parent int, part int, mask bigint")
        last = len(nodes[0][1]) < 4 * most
        parts = parted(rows, masks)
        large = None if last else pinned(parts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select(*key))
        if large is None or not large.limit(1).count():
            levels.append((masks, None))
            break
        levels.append((masks, large))
        rows, known = pinned(parts.join(large, key, "left_semi").select("scope", "bits", F.col("part").alias("parent"))), nodes

    def dealt(rows: DataFrame) -> DataFrame:
        out, own = None, rows.withColumn("parent", F.lit(0))
        for level, (masks, large) in enumerate(levels):
            parts = parted(own, masks)
            here = parts if large is None else parts.join(large, key, "left_anti")
            here = here.withColumn("meet", F.xxhash64(F.lit(level), "part", "value")).drop("part", "value")
            out = here if out is None else out.unionByName(here)
            if large is not None:
                own = parts.join(large, key, "left_semi").drop("value").withColumnRenamed("part", "parent")
        return out

    return dealt


def near_bits(hashes: DataFrame, most: int = NEAR_BITS, crowd: int = CROWD) -> DataFrame:
    """scope, a, b: different patterns of one scope with at most ``most`` differing bits. hashes: scope, bits."""
    rows = hashes.select("scope", "bits").filter("bits <> 0").distinct()
    parts = _places(rows, most, crowd)(rows)
    l, r = parts.alias("l"), parts.alias("r")
    return l.join(r, ["scope", "meet"]).filter("l.bits < r.bits").filter(hamming(F.col("l.bits"), F.col("r.bits")) <= most).select("scope", F.col("l.bits").alias("a"), F.col("r.bits").alias("b")).distinct()


def near_pairs(hashes: DataFrame, most: int = NEAR_BITS) -> DataFrame:
    """a, b of at most ``most`` differing bits: the least nodes of two patterns, and a pattern's least node with each of its others."""
    rows = pinned(hashes.select("node", "bits").filter("bits <> 0"))
    least = pinned(rows.groupBy("bits").agg(F.min("node").alias("node")))
    same = rows.join(least.select("bits", F.col("node").alias("a")), "bits").filter("node <> a").select("a", F.col("node").alias("b"))
    close = near_bits(least.withColumn("scope", F.lit(0)), most)
    name = lambda side: least.select(F.col("bits").alias(side), F.col("node").alias(f"n{side}"))
    return close.join(name("a"), "a").join(name("b"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).unionByName(same)


def ranked(df: DataFrame, col: str) -> DataFrame:
    """col, n (0, 1, ...): its different values but null in order.

    They are sorted over all partitions and numbered within each; a partition's offset is the
    size of those before it, so no task sees more than its share.
    """
    rows = pinned(df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col).withColumn("part", F.spark_partition_id()))
    size = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # One row per partition of the sort.
    before = size.withColumn("before", F.sum("size").over(W.orderBy("part")) - F.col("size")).select("part", "before")
    return rows.join(F.broadcast(before), "part").select(col, (F.row_number().over(W.partitionBy("part").orderBy(col)) - 1 + F.col("before")).alias("n"))


def labels(comp: DataFrame, col: str) -> DataFrame:
    """source_id, cluster_id (cl_0000, ... in order of the least member)."""
    return comp.join(ranked(comp, col), col).select(F.col("node").alias("source_id"), F.format_string("cl_%04d", F.col("n")).alias("cluster_id"))


def partition(sources: DataFrame, id_col: str = "id", url_col: str = "url", text_col: str = "text", scope_col: str | None = None) -> DataFrame:
    """Leader clusters: a source joins the first leader with its canonical URL or a near simhash.

    With a scope, only sources of one scope meet. Null or empty URLs and texts match nothing.
    Near patterns are never listed, since a dense table has quadratically many pairs of them: a task
    keeps the least source of each kind that a pattern meets.
    """
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    base = sources.select(F.col(id_col).alias("node"), scope.alias("scope"), F.col(url_col).alias("url"), F.col(text_col).alias("text"))
    # Numbers in the order of the ids: minima of longs need no sort.
    ids = pinned(ranked(base, "node"))
    key = lambda url, bits: F.struct("scope", url.alias("url"), bits.alias("bits")).alias("key")
    urls = base.filter("coalesce(url, '') <> ''").select("node", key(T.canonical_url(F.col("url")), F.lit(0).cast("long")))
    hashes = pinned(simhash(base, "node", "text", "scope").filter("bits <> 0"))
    places = _places(hashes, NEAR_BITS, CROWD)

    def near(asked: DataFrame, held: DataFrame) -> DataFrame:
        l, r = (places(x.select("key.scope", "key.bits", *also).filter("bits <> 0")).alias(name) for x, name, also in ((asked, "l", ()), (held, "r", ("lead", "open"))))
        return l.join(r, ["scope", "meet"]).filter(hamming(F.col("l.bits"), F.col("r.bits")) <= NEAR_BITS).select(key(F.lit(""), F.col("l.bits")), "lead", "open")

    own = urls.union(hashes.select("node", key(F.lit(""), F.col("bits")))).join(ids, "node").select(F.col("n").alias("node"), "key")
    found = leaders_by_keys(ids.select(F.col("n").alias("node")), own, near)
    return labels(found.select(F.col("node").alias("n"), "leader").join(ids, "n").select("node", "leader"), "leader")


def lexical_features(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, bucket, weight: word and letter-triple counts in 256 hashed buckets, of unit length."""
    words = texts.select(F.col(id_col).alias("node"), F.explode(T.tokens(F.col(text_col))).alias("w"))
    grams = F.when(F.length("w") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - 2, F.lit(1))), lambda i: F.substring(F.col("w"), i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    feats = words.select("node", F.explode(F.concat(F.array("w"), grams)).alias("f"))
    counts = feats.groupBy("node", F.conv(F.right(F.sha1("f"), F.lit(2)), 16, 10).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy("node").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("len"))
    return counts.join(norm, "node").select("node", "bucket", (F.col("n") / F.col("len")).alias("weight"))


def _embed(texts: list[str]) -> np.ndarray:
    """Vectors of unit length: counts of words and letter triples in hashed buckets; no words: zero."""
    out = np.zeros((len(texts), DIMENSIONS))
    seen: dict[str, list[int]] = {}  # a word's buckets: its own and its triples'
    known: dict[str, int] = {}

    def bucket(f: str) -> int:
        at = known.get(f)
        if at is None:
            at = known[f] = hashlib.sha1(f.encode()).digest()[-1]
        return at

    for i, text in enumerate(texts):
        flat: list[int] = []
        for w in re.findall(r"\w+", text.lower()):
            own = seen.get(w)
            if own is None:
                own = seen[w] = [bucket(w), *(bucket(w[j : j + 3]) for j in range(len(w) - 2))]
            flat += own
        out[i] = np.bincount(np.array(flat, np.int64), minlength=DIMENSIONS)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


def _counts(words: pa.Array) -> pa.Array:
    """Each text's counts of words and letter triples in hashed buckets, as 256 numbers of 32 bits; no words: null."""
    size, flat = np.diff(words.offsets.to_numpy()), words.flatten()
    first = np.concatenate([[0], np.cumsum(size)])
    known: dict[str, int] = {}

    def bucket(f: str) -> int:
        at = known.get(f)
        if at is None:
            at = known[f] = hashlib.sha1(f.encode()).digest()[-1]
        return at

    out: list[bytes | None] = []
    b = 0
    while b < len(size):
        a, b = b, max(b + 1, int(np.searchsorted(first, first[b] + WORDS, "right")) - 1)
        part = flat.slice(first[a], first[b] - first[a]).dictionary_encode()
        table = np.zeros((len(part.dictionary), DIMENSIONS), np.int32)  # of each distinct word
        for i, w in enumerate(part.dictionary.to_pylist()):
            for f in (w, *(w[j : j + 3] for j in range(len(w) - 2))):
                table[i, bucket(f)] += 1
        code = part.indices.to_numpy()
        for lo, hi in itertools.pairwise((first[a : b + 1] - first[a]).tolist()):
            total = np.zeros(DIMENSIONS, np.int32)
            for at in range(lo, hi, 4096):
                total += table[code[at : min(hi, at + 4096)]].sum(0, dtype=np.int32)
            out.append(total.tobytes() if hi > lo else None)
    return pa.array(out, pa.binary())


def lexical_counts(texts: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
    """node, counts (as of ``_counts``) and other columns of texts with words: ``lexical_features`` as one value a text, without a shuffle."""
    return texts.select(F.col(id_col).alias("node"), *also, F.arrow_udf(_counts, "binary")(T.tokens(F.col(text_col))).alias("counts")).filter("counts is not null")


def close_pairs(vectors: DataFrame, least: float = SIMILAR, block: int = 256) -> DataFrame:
    """a, b, cosine of the pairs of one scope at or above a similarity. vectors: scope, node (of numbers or text, unique), counts.

    A scope is cut into blocks of about ``block`` texts and every two of its blocks meet in a group, so
    a small scope is one group with each text once, and no group has over about two blocks.
    """
    kind = vectors.schema["node"].dataType
    size = vectors.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n"))
    cut = vectors.join(size, "scope").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("scope", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "counts")
    dealt = met.repartition("scope", "i", "j").sortWithinPartitions("scope", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> pa.RecordBatch:
            nodes = [r[1] for r in held]
            v = np.frombuffer(b"".join(r[2] for r in held), np.int32).reshape(-1, DIMENSIONS).astype(float)
            v /= np.sqrt((v * v).sum(1, keepdims=True))
            cosine = v @ v.T
            own = np.array([r[0] for r in held])
            hit = np.triu(cosine >= least, 1)
            if now[1] != now[2]:
                hit &= own[:, None] != own[None, :]
            a, b = np.nonzero(hit)
            named = pa.array(nodes, field)
            return pa.RecordBatch.from_arrays([named.take(pa.array(a)), named.take(pa.array(b)), pa.array(cosine[a, b])], ["a", "b", "cosine"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            field = batch.schema.field("node").type
            for scope, i, j, own, node, counts in zip(*cols, strict=True):
                if (scope, i, j) != now:
                    if len(held) > 1:
                        yield flush()
                    now, held = (scope, i, j), []
                held.append((own, node, counts))
        if len(held) > 1:
            yield flush()

    name = kind.simpleString()
    return dealt.mapInArrow(run, f"a {name}, b {name}, cosine double")


def cosine_pairs(features: DataFrame, least: float = SIMILAR) -> DataFrame:
    """a, b, cosine of all pairs at or above a similarity. features: node, bucket, weight, and scope if pairs stay in one.

    Buckets are taken rarest first. What is left of a vector after its first buckets may be shorter
    than the similarity asked for; two vectors that share none of these first buckets can't reach it.
    So only first buckets are joined, and the pairs found are measured on whole vectors.
    """
    rows = features if "scope" in features.columns else features.withColumn("scope", F.lit(0))
    rows = pinned(rows.select("scope", "node", "bucket", "weight"))
    common = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    rest = W.partitionBy("node").orderBy(F.col("df").desc(), F.col("bucket").desc()).rowsBetween(W.unboundedPreceding, 0)
    first = rows.join(F.broadcast(common), "bucket").withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(rest)).filter(F.col("rest") >= least * least - 1e-9)  # one row per bucket
    l, r = first.alias("l"), first.alias("r")
    found = l.join(r, ["scope", "bucket"]).filter("l.node < r.node").select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    dense = rows.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    dense = dense.select("node", F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("v"))
    both = found.join(dense.select(F.col("node").alias("a"), F.col("v").alias("va")), "a").join(dense.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("a", "b", dot.alias("cosine")).filter(F.col("cosine") >= least)


def semantic_edges(sources: DataFrame, id_col: str, text_col: str, least: float = SIMILAR, scope_col: str | None = None) -> DataFrame:
    """a, b: similar sources of a scope; equal texts are a star and measured once. Empty texts match nothing."""
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    base = sources.select(F.col(id_col).alias("b"), scope.alias("scope"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("text <> ''")
    one = base.groupBy("scope", F.sha2("text", 256).alias("h")).agg(F.min("b").alias("a"), F.first("text").alias("text"))
    star = base.select("b", "scope", F.sha2("text", 256).alias("h")).join(one.select("scope", "h", "a"), ["scope", "h"]).select("a", "b")
    return star.union(close_pairs(pinned(lexical_counts(one, "a", "text", "scope")), least).select("a", "b")).filter("a <> b")


def refine(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Clusters merged along edges; merges are never undone."""
    star = clusters.withColumn("a", F.min("source_id").over(W.partitionBy("cluster_id"))).select("a", F.col("source_id").alias("b"))
    return labels(components(star.union(edges.select("a", "b")), clusters.select(F.col("source_id").alias("node"))), "comp")


def provenance_edges(sources: DataFrame, id_col: str, wire: Column, byline: Column, scope_col: str | None = None) -> DataFrame:
    """Edges between sources of the same wire or the same author (of one scope); each group is a star."""
    out = None
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    for key in (T.wire(wire), T.byline(byline)):
        rows = sources.select(F.col(id_col).alias("b"), scope.alias("s"), key.alias("k")).filter("k is not null")
        part = rows.join(rows.groupBy("s", "k").agg(F.min("b").alias("a")), ["s", "k"]).select("a", "b")
        out = part if out is None else out.union(part)
    return out.filter("a <> b").distinct()


def _named_by_least(clusters: DataFrame) -> DataFrame:
    """node, comp: the clusters by their least member."""
    return clusters.select(F.col("source_id").alias("node"), F.min("source_id").over(W.partitionBy("cluster_id")).alias("comp"))


def semantic_merges(clusters: DataFrame, sources: DataFrame, id_col: str, text_col: str, least: float = SIMILAR, scope_col: str | None = None) -> DataFrame:
    """a, b, cosine (four places): the merges that a walk over all similar pairs, in order of their ids, would add to the clusters.

    Of two groups of equal texts only the pairs with the smallest id of all can be merges: any other
    one closes a circle of smaller ones.
    """
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    base = pinned(sources.select(F.col(id_col).alias("id"), scope.alias("scope"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("text <> ''").withColumn("h", F.sha2("text", 256)))
    one = base.groupBy("scope", "h").agg(F.min("id").alias("a"), F.first("text").alias("text"))
    held = pinned(base.join(one.select("scope", "h", "a"), ["scope", "h"]).select(F.col("a").alias("first"), "id"))
    vectors = pinned(lexical_counts(one, "a", "text", "scope"))
    close = close_pairs(vectors, least)
    empty = base.join(vectors.select(F.col("node").alias("id")), "id", "left_anti").select("id")
    same = held.join(empty.select(F.col("id").alias("first")), "first", "left_anti").filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    pairs = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("first"), "cosine").join(held, "first").select("a", F.col("id").alias("b"), "cosine")
    return forest(same.union(pairs).select("a", "b", F.bround(F.round("cosine", 9), 4).alias("cosine")), _named_by_least(clusters))


def provenance_merges(clusters: DataFrame, sources: DataFrame, id_col: str, wire: Column, byline: Column, scope_col: str | None = None) -> DataFrame:
    """a, b, signal, key: the merges by wire, then by author, in order of each group's first id and its others."""
    scope = F.col(scope_col).cast("string") if scope_col else F.lit("")
    out = None
    for signal, key in (("wire", T.wire(wire)), ("byline", T.byline(byline))):
        rows = sources.select(F.col(id_col).alias("b"), scope.alias("s"), key.alias("key")).filter("key is not null")
        part = rows.join(rows.groupBy("s", "key").agg(F.min("b").alias("a")), ["s", "key"]).filter("a <> b").select("a", "b", F.lit(signal).alias("signal"), "key")
        out = part if out is None else out.union(part)
    merged = forest(out.withColumn("turn", F.when(F.col("signal") == "wire", 0).otherwise(1)), _named_by_least(clusters), "turn")
    return merged.drop("turn")


def compose(sources: DataFrame, scope_col: str | None = None, least: float = SIMILAR, similar=semantic_edges) -> DataFrame:
    """source_id, cluster_id by text and URL, then similarity, then provenance. sources: id, url, text, wire, byline.

    ``similar`` may be any function with the signature of ``semantic_edges``: another embedder's edges.
    """
    with shuffled_joins(sources.sparkSession):
        first = pinned(partition(sources, scope_col=scope_col))
        second = pinned(refine(first, similar(sources, "id", "text", least, scope_col)))
        return pinned(refine(second, provenance_edges(sources, "id", F.col("wire"), F.col("byline"), scope_col)))
