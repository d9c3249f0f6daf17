"""Linked groups of near copies without listing all pairs of a group.

``link`` takes the members of band buckets and returns the connected components of all exactly
verified links, in these steps:

1. In each bucket, members are compared by their sketches; one that agrees with members of another
   group proposes one of them and joins that group. So a bucket of n near copies proposes about n
   pairs. Distributed union-find turns the proposals into coarse groups: a superset of the links.
2. A hot bucket (over ``BLOCK`` members) is compared in blocks, each with the bucket's first member,
   so a large group of near copies is one coarse group by now. Where a hot bucket still holds
   several coarse groups, its members meet again under every pair of such buckets that they share;
   a pair of near copies nearly always shares two bands, and chance does so rarely. Hot buckets
   that still hold several groups are then crossed: all members outside the largest group meet all
   others, block by block. So every pair of a bucket is compared, or in one group by then, and the
   result doesn't depend on ``BLOCK``.
3. Each coarse group gets the whole texts of its members. A member's set is compared exactly with
   those of all members that are in another component by then; links merge components, and only
   merging links are written. A group of copies takes one comparison each, and no pair is skipped
   unless its two members are already in one component.
4. A coarse group of more than ``GROUP_BYTES`` is dealt to several tasks by a hash of the member,
   twice, and then crossed in the same way, so pairs of different tasks are compared too.

No task holds more than one block of a group. Tables between steps are in the shared folder; nothing
but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import Scratch, in_turn, partitions, spread

BLOCK = 4096
GROUP_BYTES = 4 << 20
#: Band entries that a task sorts at a time.
SHARE = 1 << 20


def propose(rids: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, first: np.ndarray, agree: Callable, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs that join the members of each bucket (its first member's place in ``first``) whose sketches agree."""
    size = np.diff(first)
    lead = np.repeat(first[:-1], size)

    def near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        # Jaccard is at most the ratio of the sizes.
        fits = np.minimum(sizes[one], sizes[other]) * den >= np.maximum(sizes[one], sizes[other]) * num
        return fits & agree(sketches[one], sketches[other])

    at = np.arange(len(rids))
    star = near(at, lead) & (at != lead)
    out = list(zip(rids[lead[star]].tolist(), rids[star].tolist(), strict=True))
    # Members unlike their bucket's first are held against all others of the bucket.
    odd = np.flatnonzero(~star & (at != lead) & (np.repeat(size, size) > 2))
    label = np.where(star, lead, at)
    for i in odd.tolist():
        lo = int(lead[i])
        others = np.arange(lo + 1, int(lo + size[np.searchsorted(first, lo, "right") - 1]))
        others = others[label[others] != label[i]]
        others = others[near(np.full(len(others), i), others)]
        for own in dict.fromkeys(label[others].tolist()):
            out.append((int(rids[others[label[others] == own][0]]), int(rids[i])))
        if len(others):
            span = slice(lo, int(lo + size[np.searchsorted(first, lo, "right") - 1]))
            label[span][np.isin(label[span], label[others])] = label[i]
    return out


PAIRS = "a bigint, b bigint"


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    best = sorted({(min(x), max(x)) for x in out})
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in best], pa.int64()), pa.array([b for _, b in best], pa.int64())], ["a", "b"])


def _proposals(rows: DataFrame, agree: Callable, num: int, den: int) -> DataFrame:
    """rows: bucket, part, rid, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(cols: tuple) -> pa.RecordBatch:
            edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            out = propose(cols[2], cols[3], cols[4], np.array([0, *edge, len(cols[0])]), agree, num, den)
            return _pairs(out)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:4]]
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            held.append((*cols, sketch))
            # All but the last group are whole.
            cols = tuple(np.concatenate([h[i] for h in held]) for i in range(5))
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush(tuple(c[:cut] for c in cols))
            held = [tuple(c[cut:] for c in cols)]
        if held:
            yield flush(held[0])

    dealt = spread(rows.select("bucket", "part", "rid", "size", "sketch"), "bucket", "part").sortWithinPartitions("bucket", "part", "rid")
    return dealt.mapInArrow(run, PAIRS).distinct()


def exact_links(sets: list[np.ndarray], label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that merge components: every pair whose components differ when it is reached is compared."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    code = np.empty(len(flat), np.int64)
    code[order] = np.cumsum(np.concatenate([[0], flat[order][1:] != flat[order][:-1]]))
    first = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(code.max(initial=0)) + 1, bool)
    label = label.copy()
    out = []
    for i in range(len(sets)):
        rest, n = label[i + 1 :], size[i + 1 :]
        others = i + 1 + np.flatnonzero((rest != label[i]) & (np.minimum(n, size[i]) * den >= np.maximum(n, size[i]) * num))
        if not len(others) or not size[i]:
            continue
        mine = code[first[i] : first[i + 1]]
        mark[mine] = True
        n = size[others]
        edge = np.concatenate([[0], np.cumsum(n)])
        spot = np.arange(edge[-1]) + np.repeat(first[others] - edge[:-1], n)
        total = np.concatenate([[0], np.cumsum(mark[code[spot]])])
        shared = total[edge[1:]] - total[edge[:-1]]
        mark[mine] = False
        hits = others[(den * shared >= num * (n + size[i] - shared)) & (shared > 0)]
        for own in dict.fromkeys(label[hits].tolist()):
            out.append((i, int(hits[label[hits] == own][0])))
        if len(hits):
            label[np.isin(label, label[hits])] = label[i]
    return out


def _verified(rows: DataFrame, shingles: Callable, num: int, den: int) -> DataFrame:
    """Merging links (a, b). rows: grp, part, rid, comp, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rids, comps, sets = None, [], [], []

        def flush() -> list[tuple[int, int]]:
            if len(rids) < 2:
                return []
            return [(rids[i], rids[j]) for i, j in exact_links(sets, np.array(comps), num, den)]

        for batch in batches:
            out: list[tuple[int, int]] = []
            for grp, part, rid, comp, own in zip(*(batch.column(i).to_pylist() for i in range(4)), shingles(batch.column(4)), strict=True):
                if (grp, part) != now:
                    out += flush()
                    now, rids, comps, sets = (grp, part), [], [], []
                rids.append(rid)
                comps.append(comp)
                sets.append(own)
            yield _pairs(out)
        yield _pairs(flush())

    dealt = spread(rows.select("grp", "part", "rid", "comp", "text"), "grp", "part").sortWithinPartitions("grp", "part", "rid")
    return dealt.mapInArrow(run, PAIRS)


ENTRY = np.dtype([("bucket", "<u8"), ("offset", "<u4")])


def shares(df: DataFrame, entries: int) -> int:
    """How many shares so many band entries are dealt to: ``SHARE`` in each, one for each shuffle partition at least."""
    return max(partitions(df), -(-entries // SHARE))


def pack_bands(bands: np.ndarray, rids: np.ndarray, shares: int) -> Iterator[pa.RecordBatch]:
    """share, blob: (bucket, rid) entries dealt out by bucket; bands has a row of buckets for each rid."""
    high = rids >> 32  # ids of one writing task differ in their low halves only
    for own in np.unique(high):
        bucket = np.ascontiguousarray(bands[high == own]).view(np.uint64).ravel()
        to = (bucket % np.uint64(shares)).astype(np.int32 if shares >> 15 else np.int16)  # short ones are sorted by radix
        order = np.argsort(to, kind="stable")
        entry = np.empty(len(bucket), ENTRY)
        entry["bucket"], entry["offset"] = bucket[order], np.repeat(rids[high == own].astype(np.uint32), bands.shape[1])[order]
        to = to[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        head = np.int64(own << 32).tobytes()
        cuts = zip(first.tolist(), [*first[1:].tolist(), len(to)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(to[first].astype(np.int32)), pa.array([head + entry[a:b].tobytes() for a, b in cuts], pa.binary())], ["share", "blob"])


def by_bucket(bucket: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """The order by bucket and rid; most buckets have one entry, so only those of the others are sorted by rid."""
    order = np.argsort(bucket)
    high = bucket[order]
    same = high[1:] == high[:-1]
    edge = np.zeros(min(1, len(high)), bool)
    many = np.flatnonzero(np.concatenate([edge, same]) | np.concatenate([same, edge]))
    order[many] = order[many][np.lexsort((rid[order[many]], high[many]))]
    return order


class Members:
    """The members of one share's buckets, in blocks; entries may come in any number of pieces."""

    def __init__(self, block: int) -> None:
        self.block, self.bucket, self.rid, self.size, self.limit = block, [], [], 0, 4 * SHARE
        self.out: dict[int, tuple[int, int]] = {}  # of hot buckets: blocks so far, and the first member

    def add(self, bucket: np.ndarray, rid: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.bucket.append(bucket)
        self.rid.append(rid)
        self.size += len(rid)
        if self.size > self.limit:  # a hot bucket's members need not wait for the others
            yield from self.give(False)
            self.limit = max(4 * SHARE, 2 * self.size)

    def give(self, last: bool) -> Iterator[pa.RecordBatch]:
        """bucket, part, rid, hot of buckets with two members or more; before the last entries, of hot ones alone."""
        if not self.rid:
            return
        bucket, rid = np.concatenate(self.bucket), np.concatenate(self.rid)
        order = by_bucket(bucket, rid)
        bucket, rid = bucket[order], rid[order]
        again = np.concatenate([[False], (bucket[1:] == bucket[:-1]) & (rid[1:] == rid[:-1])])[: len(rid)]
        bucket, rid = bucket[~again], rid[~again]
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(rid) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(rid)))
        known = np.array([b in self.out for b in bucket[first].tolist()], bool) if self.out else np.zeros(len(first), bool)
        hot = known | (n > self.block)
        go = (n > 1) | known if last else n > self.block
        base = np.zeros(len(first), np.int64)
        extra: list[tuple[int, int, int]] = []
        for i in np.flatnonzero(hot & go).tolist():
            b, blocks = int(bucket[first[i]]), -(-int(n[i]) // self.block)
            base[i], lead = self.out.get(b, (0, int(rid[first[i]])))
            extra += [(b, p, lead) for p in range(int(base[i]), int(base[i]) + blocks) if p]
            self.out[b] = (int(base[i]) + blocks, lead)
        each = np.repeat(go, n)
        part = np.repeat(base, n) + (np.arange(len(rid)) - np.repeat(first, n)) // self.block
        more = np.array(extra, np.uint64).reshape(-1, 3)
        cols = [np.concatenate([bucket[each], more[:, 0]]).view(np.int64), np.concatenate([part[each], more[:, 1].astype(np.int64)]).astype(np.int32), np.concatenate([rid[each], more[:, 2].astype(np.int64)]), np.concatenate([np.repeat(hot, n)[each], np.ones(len(more), bool)])]
        for lo in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in cols], ["bucket", "part", "rid", "hot"])
        self.bucket, self.rid = [bucket[~each]], [rid[~each]]
        self.size = len(self.rid[0])


def buckets(scratch: Scratch, blobs: DataFrame, block: int = BLOCK) -> DataFrame:
    """bucket, part, rid, hot: members of buckets with at least two, from packed bands (a saved table).

    Shares come to a task one after the other, sorted by Spark, so a task holds one share; members of a
    bucket that is larger still leave in blocks as they come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Members(block)
        for batch in batches:
            for share, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if share != now:
                    yield from held.give(True)
                    now, held = share, Members(block)
                blob = blob.as_py()
                entry = np.frombuffer(blob, ENTRY, -1, 8)
                yield from held.add(entry["bucket"], entry["offset"].astype(np.int64) + np.frombuffer(blob, "<i8", 1)[0])
        yield from held.give(True)

    out = scratch.save(in_turn(blobs, "share").mapInArrow(run, "bucket bigint, part int, rid bigint, hot boolean"))
    scratch.tidy()
    return out


def _part(parts: str | Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("rid", F.lit(salt)), parts).cast("int")


def _every(parts: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))


def crossed(rows: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """The rows of each group once more, as parts in which every two members of different components meet.

    The group's largest component needs no comparison inside. All others are dealt to ``outer`` blocks
    and each of these meets every block of the whole group; a block has ``limit`` of size, or one row.
    rows: key, rid, comp and whatever else.
    """
    sums = rows.groupBy(key, "comp").agg(F.sum(size).alias("s"))
    most = sums.groupBy(key).agg(F.max(F.struct("s", "comp")).alias("m"), F.sum("s").alias("s"))
    blocks = lambda s: F.ceil(s / limit).cast("int")
    known = rows.join(most.select(key, F.col("m.comp").alias("main"), blocks(F.col("s")).alias("inner"), blocks(F.col("s") - F.col("m.s")).alias("outer")).filter("outer > 0"), key)
    a, b = F.col("a"), F.col("b")
    whole = known.withColumn("b", _part("inner", 1)).withColumn("a", _every("outer"))
    odd = known.filter("comp <> main").withColumn("a", _part("outer", 2)).withColumn("b", _every("inner"))
    return whole.unionByName(odd.select(*whole.columns)).withColumn("part", a * F.col("inner") + b).drop("a", "b", "main", "inner", "outer").dropDuplicates([key, "part", "rid"])


def _several(rows: DataFrame, key: str) -> DataFrame:
    """Groups of more than one component, with their sizes n."""
    return rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select(key, "n")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("rid"))
    return rows.join(labels.select(F.col("node").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _coarse(scratch: Scratch, members: DataFrame, about: DataFrame, agree: Callable, num: int, den: int, block: int) -> DataFrame | None:
    """Labels (node, comp) of all members that agree with another one."""
    found = scratch.save(_proposals(members.join(about, "rid"), agree, num, den))
    labels = components(found) if _some(found) else None
    hot = members.filter("hot")
    if not _some(hot):
        return labels
    # Once more under every pair of hot buckets that aren't of one group.
    named = scratch.save(_labelled(hot.select("bucket", "rid").distinct(), labels))
    mixed = scratch.save(_several(named, "bucket"))
    if not _some(mixed):
        return labels

    def rest(known: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        # What shares one hot bucket alone meets there: all members outside a bucket's largest group with all others.
        left = scratch.save(_labelled(named.join(mixed, "bucket", "left_semi").select("bucket", "rid"), labels))
        if _some(_several(left, "bucket")):
            last = crossed(left, "bucket", F.lit(1), block).select("bucket", "part", "rid")
            whole = scratch.save(known.unionByName(_proposals(last.join(about, "rid"), agree, num, den)))
            labels = components(whole) if _some(whole) else None
            scratch.drop(whole)
        scratch.drop(named, known, left)
        return labels

    mine = named.join(mixed, "bucket", "left_semi").groupBy("rid", "comp").agg(F.sort_array(F.collect_set("bucket")).alias("own"))  # a band each at most
    both = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.xxhash64(x, y))))
    pairs = scratch.save(mine.select("rid", "comp", F.explode(both).alias("bucket")))
    shared = scratch.save(_several(pairs, "bucket").withColumn("parts", F.ceil(F.col("n") / block).cast("int")))
    if not _some(shared):
        return rest(found, labels)
    again = pairs.join(shared, "bucket")
    leads = again.filter("parts > 1").groupBy("bucket", "parts").agg(F.min("rid").alias("rid")).withColumn("part", _every("parts"))
    dealt = again.withColumn("part", _part("parts", 0)).select("bucket", "part", "rid").unionByName(leads.select("bucket", "part", "rid")).distinct()
    more = scratch.save(found.unionByName(_proposals(dealt.join(about, "rid"), agree, num, den)))
    if not _some(more):
        return rest(more, None)
    scratch.drop(found, pairs)
    return rest(more, components(more))


def link(scratch: Scratch, members: DataFrame, about: DataFrame, texts: DataFrame, shingles: Callable, num: int, den: int, agree: Callable, block: int = BLOCK) -> DataFrame | None:
    """Components (node, comp) of the members whose sets have a Jaccard similarity of num / den or more.

    members: from ``buckets``. about: rid, size, sketch. texts: rid, text. shingles: an Arrow array of
    texts to their sets. None: no link at all.
    """
    coarse = _coarse(scratch, members, about, agree, num, den, block)
    if coarse is None:
        return None
    weight = F.octet_length("text").cast("long") + 64
    whole = coarse.select(F.col("node").alias("rid"), F.col("comp").alias("grp")).join(texts, "rid")
    sizes = whole.groupBy("grp").agg(F.ceil(F.sum(weight) / GROUP_BYTES).cast("int").alias("parts"))
    whole = scratch.save(whole.join(sizes, "grp").select("grp", "parts", "rid", "text"))
    links = scratch.save(_verified(whole.withColumn("part", _part("parts", 1)).withColumn("comp", F.col("rid")), shingles, num, den))
    large = whole.filter("parts > 1")
    if _some(large):
        ids = large.select(F.col("rid").alias("a"))
        for deal in (2, None):
            # Labels of the large groups alone: the others are done.
            own = links.join(ids, "a", "left_semi")
            known = _labelled(large, components(own) if _some(own) else None)
            dealt = known.withColumn("part", _part("parts", deal)) if deal else crossed(known, "grp", weight, GROUP_BYTES)
            more = scratch.save(links.unionByName(_verified(dealt, shingles, num, den)).distinct())
            scratch.drop(links)
            links = more
    scratch.drop(whole)
    return components(links) if _some(links) else None
