"""MinHash near-duplicates with odd sketches.

A text's words are the runs of bytes other than space and 09-0D, with A-Z lower-cased; its set is
the distinct shingles of ``words`` consecutive words. Bands of MinHash values give candidates; odd
sketches (parity bitmaps of the MinHash samples, compared by XOR and population count) keep those
whose estimated similarity is not clearly too low; candidates are then confirmed on full sets.

Texts with fewer words have their whole sequence as the one shingle; texts without words (null and
empty ones too) have an empty set and link with nothing. Equal sets are one node from the start, so
copies cost one row. A null id sorts after all others. Rows are told apart by id and text: rows that
share an id link only by their texts, and the id serves order and output. ``groups`` gives rows that
share both the same values; ``one_of_each`` keeps one of them. Long texts are whole. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, back_to_id, chunks, id_of, mix64, named, once, table, text_of, utf8
from .linking import BLOCK, buckets, link, pack_bands, shares
from .minhash import bands, odd_limit, odd_sketch, signatures

BLANK = " \t\n\x0b\x0c\r"
SAMPLES, ROWS, BANDS, BITS = 128, 5, 20, 256
#: The sketch's estimate may be so much too low: over five standard deviations at 128 samples.
SLACK = 0.18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(7 << 20))
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of a batch of texts, and each text's first word (one more than texts)."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True  # a text's last word does not run on into the next text
    w0 = np.flatnonzero(~gap[1:-1] & (gap[:-2] | cut[:-1]))
    w1 = np.flatnonzero(~gap[1:-1] & (gap[2:] | cut[1:])) + 1
    up, down = _powers(len(data), _BASE), _powers(len(data), pow(_BASE, -1, 1 << 64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[_LOWER[data]] * up[:-1], out=sums[1:])
    return mix64((sums[w1] - sums[w0]) * down[w0] + (w1 - w0).astype(np.uint64)), np.searchsorted(w0, starts)


def sets_of(data: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes."""
    hashes, first = word_hashes(data, starts)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        joined = mix64(joined * np.uint64(3) + hashes[j : j + len(joined)])
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if hi - lo >= words:
            s = np.sort(joined[lo : hi - words + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif hi > lo:
            h = np.full(1, hi - lo, np.uint64)
            for x in hashes[lo:hi]:
                h = mix64(h * np.uint64(5) + x)
            s = h
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out


KEY = ["doc", "h1", "h2"]
SIGNED = "doc bigint, h1 bigint, h2 bigint, n bigint, digest binary, bands array<bigint>, sketch binary"


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc, h1, h2, n (set size), digest of the set, bands and odd sketch; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(3))
            for lo, hi in chunks(np.diff(starts), 4 << 20):
                sets = sets_of(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], words)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                first = np.concatenate([[0], np.cumsum(n[some])])
                flat = np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, np.uint64)
                sig = signatures(flat, first, SAMPLES)
                b, o = bands(sig, ROWS, BANDS), odd_sketch(sig, BITS)
                band_col: list = [None] * len(n)
                sketch_col: list = [None] * len(n)
                for at, i in enumerate(some.tolist()):
                    band_col[i], sketch_col[i] = b[at], o[at].tobytes()
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                cols = [*(batch.column(c)[lo:hi] for c in range(3)), pa.array(n), pa.array(digests, pa.binary()), pa.array(band_col, pa.list_(pa.int64())), pa.array(sketch_col, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, [*KEY, "n", "digest", "bands", "sketch"])

    return docs.select(*KEY, "text").mapInArrow(run, SIGNED)


def _key(id_col: str, text_col: str) -> list[Column]:
    """A row's id and its text's hash."""
    return [id_of(id_col).alias("doc"), F.xxhash64(text_of(text_col)).alias("h1"), F.xxhash64(F.lit(1), text_of(text_col)).alias("h2")]


def _packed(reps: DataFrame, parts: int) -> DataFrame:
    """Bands (an array of each rid) packed and dealt out by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from pack_bands(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(0).to_numpy(), parts)

    return reps.select("rid", "bands").mapInArrow(run, "share int, blob binary")


def groups(docs: DataFrame, num: int, den: int, words: int, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc (null ids as the largest long), h1, h2, n, component (its first row's doc), kept (is that row): one row per input row."""
    scratch = Scratch(docs.sparkSession)
    base = docs.select(*_key(id_col, text_col), text_of(text_col).alias("text"))
    rows = scratch.save(signed(base, words))
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min(F.struct(*KEY)).alias("first"))
    classes = scratch.save(classes.select(F.monotonically_increasing_id().alias("rid"), "digest", "first"))
    # A plain join and nothing else in its stage: a digest that very many rows share can be split.
    own = F.struct(*KEY)
    is_rep = F.col("first") == own
    placed = scratch.save(rows.join(classes, "digest", "left").select(*KEY, "n", "rid", F.coalesce("first", own).alias("first"), F.when(is_rep, F.col("bands")).alias("bands"), F.when(is_rep, F.col("sketch")).alias("sketch")))
    scratch.drop(rows)
    reps = placed.filter("bands is not null")
    members = buckets(scratch, _packed(reps, shares(docs, classes.count() * BANDS)), block)
    wanted = scratch.save(members.select("rid").distinct())
    about = scratch.save(reps.select("rid", F.col("n").alias("size"), "sketch").join(wanted, "rid", "left_semi").dropDuplicates(["rid"]))
    heads = classes.join(wanted, "rid", "left_semi").select("rid", "first.*")
    texts = scratch.save(base.join(heads, KEY).dropDuplicates(KEY).select("rid", "text"))
    placed = placed.drop("bands", "sketch")
    scratch.drop(wanted)
    scratch.tidy()
    most = odd_limit(SAMPLES, BITS, num / den - SLACK)

    def agree(many: np.ndarray, one: np.ndarray) -> np.ndarray:
        return np.bitwise_count(many.view(np.uint64) ^ one.view(np.uint64)).sum(1) <= most

    def shingles(texts: pa.Array) -> Iterator[np.ndarray]:
        data, starts = utf8(texts)
        for lo, hi in chunks(np.diff(starts), 4 << 20):
            yield from sets_of(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo], words)

    labels = link(scratch, members, about, texts, shingles, num, den, agree, block)
    scratch.drop(members, about, texts)
    scratch.tidy()
    head = F.col("first")
    if labels is not None:
        linked = classes.join(labels.withColumnRenamed("node", "rid"), "rid").select("rid", "comp", "first")
        least = linked.groupBy("comp").agg(F.min("first").alias("head"))
        placed = placed.join(scratch.save(linked.join(least, "comp").select("rid", "head")), "rid", "left")
        head = F.coalesce("head", "first")
    return placed.select(*KEY, "n", head["doc"].alias("component"), (head == F.struct(*KEY)).alias("kept"))


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    """Groups of documents with a Jaccard similarity of 0.85 or more on three-word shingles."""
    out = groups(table(spark, sf_dir, "documents"), 85, 100, 3)
    return out.select(back_to_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), back_to_id("component").alias("component_id"), "kept")


def one_of_each(docs: DataFrame, num: int = 80, den: int = 100, words: int = 5) -> DataFrame:
    """The documents without those that have a smaller one in their group; all columns stay."""
    docs = once(docs, BLANK)
    names = named(docs, *KEY)
    gone = groups(docs, num, den, words).filter("not kept").select(*[F.col(c).alias(n) for c, n in zip(KEY, names, strict=True)]).distinct()
    same = [c == F.col(n) for c, n in zip(_key("doc_id", "text"), names, strict=True)]
    return docs.join(gone, same, "left_anti")
