"""Connected components and leader clusters on DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch


def pinned(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder."""
    return Scratch(df.sparkSession).save(df)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, comp: the least node reachable over edges (a, b); nodes without edges are their own.

    Each node takes the least label among its neighbours, then the label of its label (pointer
    jumping), until nothing changes. Minima are pre-aggregated before each shuffle, and the joins on a
    popular label are plain equi-joins that adaptive execution can split.
    """
    scratch = Scratch(edges.sparkSession)
    one = edges.filter("a <> b").select("a", "b")
    both = scratch.save(one.union(one.select("b", "a")).distinct())
    start = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
    labels = scratch.save(start)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("comp").alias("up"))
        new = scratch.save(step.join(up, "mid").select("node", "old", F.least("mid", "up").alias("comp")))
        changed = new.filter("old <> comp").limit(1).count()
        scratch.drop(labels)
        labels = new.select("node", "comp")
        labels._attesta_path = new._attesta_path
        if not changed:
            break
    scratch.drop(both)
    if nodes is None:
        return labels
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def leaders_by_keys(nodes: DataFrame, own: DataFrame, near: DataFrame | Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """node, leader: in order of the nodes, each joins its least adjacent leader or becomes one.

    Nodes are adjacent if they hold an equal key (own: node, key) or near ones. near: pairs of keys (a, b), or a
    function of keys that ask (key) and keys that are held (key, lead, open) to rows key, lead, open: for each asked
    key those of the held ones near it, or anything with the same minima.

    Each round takes two minima per key instead of pairs of nodes, so a key that a third of all nodes hold costs one
    row per node. A node is settled once no adjacent one that may still lead comes before its leader or, without one,
    itself. A leader is seen by all others in the round after it was found, so each round has the unsettled nodes and
    these leaders only.
    """
    scratch = Scratch(nodes.sparkSession)
    if isinstance(near, DataFrame):
        views = scratch.save(near.select(F.col("a").alias("key"), F.col("b").alias("seen")).union(near.select("b", "a")).distinct())
        near = lambda asked, held: views.join(asked, "key", "left_semi").join(held.withColumnRenamed("key", "seen"), "seen").select("key", "lead", "open")
    keys = own.groupBy("node").agg(F.collect_set("key").alias("keys"))
    new = scratch.save(nodes.select("node").distinct().join(keys, "node", "left").withColumn("lead", F.lit(None).cast(nodes.schema["node"].dataType)).withColumn("settled", F.lit(False)))
    done = []
    while True:
        rest = new.filter("not settled")
        if not rest.limit(1).count():
            break
        at = new.filter("not settled or lead is null").select("node", "lead", "settled", F.explode("keys").alias("key"))
        at = at.groupBy("key").agg(F.min(F.when(F.col("settled"), F.col("node"))).alias("lead"), F.min(F.when(~F.col("settled") & F.col("lead").isNull(), F.col("node"))).alias("open"), F.max(~F.col("settled")).alias("asks"))
        at = scratch.save(at)
        held = at.filter("lead is not null or open is not null").select("key", "lead", "open")
        seen = held.unionByName(near(at.filter("asks").select("key"), held)).groupBy("key").agg(F.min("lead").alias("lead"), F.min("open").alias("open"))
        seen = rest.select("node", F.explode("keys").alias("key")).join(seen, "key").groupBy("node").agg(F.min("lead").alias("_lead"), F.min("open").alias("open"))
        step = rest.join(seen, "node", "left").select("node", "keys", F.least("lead", "_lead").alias("lead"), "open")
        new = scratch.save(step.select("node", "keys", "lead", (F.col("open").isNull() | (F.col("open") >= F.coalesce("lead", "node"))).alias("settled")))
        scratch.drop(at)
        done.append(new.filter("settled").select("node", F.coalesce("lead", "node").alias("leader")))
    out = nodes.select("node", F.col("node").alias("leader")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def forest(edges: DataFrame, labels: DataFrame, *order: str) -> DataFrame:
    """The edges that a walk over all edges in this order would merge two components by; labels: node, comp before it.

    edges: a, b, the columns of order (which with a and b leave no tie) and any others. Borůvka rounds: each
    component takes its first edge to another one, in this order; those edges are the walk's own, since the
    order is total, and at least halve the number of components. Edges within a component go.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    rank = F.struct(*order, "a", "b").alias("_rank")
    ends = lambda e, l: e.join(l.select(F.col("node").alias("a"), F.col("comp").alias("_ca")), "a").join(l.select(F.col("node").alias("b"), F.col("comp").alias("_cb")), "b").filter("_ca <> _cb")
    left = scratch.save(ends(edges.withColumn("_rank", rank), labels))
    names, chosen = edges.columns, []
    while left.limit(1).count():
        both = left.select(F.col("_ca").alias("c"), "_rank").union(left.select(F.col("_cb").alias("c"), "_rank"))
        first = both.groupBy("c").agg(F.min("_rank").alias("_rank")).select("_rank").distinct()
        mine = scratch.save(left.join(first, "_rank", "left_semi"))
        chosen.append(mine.select(*names))
        up = scratch.save(components(mine.select(F.col("_ca").alias("a"), F.col("_cb").alias("b"))).toDF("_c", "_root"))
        moved = left.join(up.select(F.col("_c").alias("_ca"), F.col("_root").alias("_ra")), "_ca", "left").join(up.select(F.col("_c").alias("_cb"), F.col("_root").alias("_rb")), "_cb", "left")
        moved = moved.select(*names, "_rank", F.coalesce("_ra", "_ca").alias("_ca"), F.coalesce("_rb", "_cb").alias("_cb")).filter("_ca <> _cb")
        old, left = left, scratch.save(moved)
        scratch.drop(old, up)
    out = edges.limit(0)
    for part in chosen:
        out = out.unionByName(part)
    return out
