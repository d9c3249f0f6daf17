"""Fuzzy line deduplication by MinHash over character shingles.

A document's lines are split at line breaks and trimmed of white space at both ends. Equal lines
are one node. Lines with a Jaccard similarity of ``num / den`` or more on their distinct shingles of
``SIZE`` characters (a shorter line is one shingle) are linked: bands of MinHash values find
candidates with high recall, exact similarity verifies them, union-find gives components. Of every
component the first line stays, by document id and then line number; all its other lines go.

Blank lines are never duplicates. Null texts have one blank line. A null id sorts last. In
``line_groups`` rows that share an id are one document; with ``by_text``, and so in ``drop_lines``,
they are told apart by a 64-bit hash of their texts, and ``drop_lines`` keeps one of those that share
both. Lines of any length are whole. A document that had words and keeps no line is dropped by
``drop_lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, back_to_id, chunks, has_words, id_of, mix64, named, once, table, text_of
from .linking import BLOCK, buckets, link, pack_bands, shares
from .minhash import bands, signatures

SIZE = 7
ROWS, BANDS = 4, 12
#: Fewer equal samples of 48 than at a similarity of 0.8 by five standard deviations.
LEAST_EQUAL = 24
BLANK = " \t\r\f\x0b"
#: Shingles that are hashed at a time.
STEP = 1 << 14


def char_sets(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a batch of lines, and each line's first; repeats are left in."""
    pad = "\0" * (size - 1)
    short = [len(t) < size for t in texts]
    if any(short):  # a short line is one shingle: itself and so many zeros
        texts = [(t + pad)[:size] if s else t for t, s in zip(texts, short, strict=True)]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(t) - size + 1 for t in texts], np.int64)
    h = np.empty(max(0, len(codes) - size + 1), np.uint64)
    for lo in range(0, len(h), STEP):  # in pieces that stay in the cache
        part = h[lo : lo + STEP]
        wide = codes[lo : lo + len(part) + size - 1].astype(np.uint64)
        part[:] = wide[: len(part)]
        for j in range(1, size):
            part *= np.uint64(0x9E3779B97F4A7C15)
            part += wide[j : len(part) + j]
        part[:] = mix64(part)
    # Shingles that run from one line into the next don't count.
    whole = np.ones(len(h), bool)
    ends = np.cumsum(n + size - 1)
    for j in range(1, size):
        whole[ends[:-1] - j] = False
    return h[whole], np.concatenate([[0], np.cumsum(n)])


def shingles(lines: pa.Array) -> Iterator[np.ndarray]:
    """Each line's set, as sorted hashes."""
    texts = lines.to_pylist()
    for lo, hi in chunks(np.array([len(t) for t in texts]), 1 << 19):
        hashes, first = char_sets(texts[lo:hi])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            s = np.sort(hashes[a:b])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]


def trimmed(raw: Column) -> Column:
    """Without white space at both ends. Spark's trim by a set reads the whole string, so only lines that need it get it."""
    edges = [f(b) for b in BLANK for f in (raw.startswith, raw.endswith)]
    return F.when(reduce(or_, edges), F.trim(raw, F.lit(BLANK))).otherwise(raw)


def occurrences(docs: DataFrame, id_col: str, text_col: str, by_text: bool = False) -> DataFrame:
    """doc, line_no, line and its 128-bit hash for every line that isn't blank; by_text: t, the text's hash, too."""
    own = ["doc", "t"] if by_text else ["doc"]
    rows = docs.select(id_of(id_col).alias("doc"), *[F.xxhash64(text_of(text_col)).alias(c) for c in own[1:]], F.posexplode(F.split(text_of(text_col), "\n")).alias("line_no", "raw"))
    rows = rows.filter(has_words(F.col("raw"), BLANK)).select(*own, "line_no", trimmed(F.col("raw")).alias("line"))
    return rows.select(*own, "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _signed(lines: DataFrame, shape: str, make, most: int = 1 << 19) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(np.array([len(t) for t in texts]), most):
                hashes, first = char_sets(texts[lo:hi])
                yield from make(batch.column(0)[lo:hi], signatures(hashes, first, ROWS * BANDS), hashes, first)

    return lines.select("rid", "text").mapInArrow(run, shape)


def banded(lines: DataFrame) -> DataFrame:
    """The bands of every line, packed and dealt out by bucket."""
    parts = shares(lines, lines.count() * BANDS)

    def make(rids: pa.Array, sig: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        return pack_bands(bands(sig, ROWS, BANDS), rids.to_numpy(), parts)

    return _signed(lines, "share int, blob binary", make, 1 << 22)


def sketched(lines: DataFrame) -> DataFrame:
    """rid, size, sketch (a byte of each sample) of lines that share a bucket with others."""

    def make(rids: pa.Array, sig: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.empty(len(rids), np.int64)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            s = np.sort(hashes[a:b])
            size[i] = 1 + np.count_nonzero(s[1:] != s[:-1])
        low = mix64(sig.astype(np.uint64)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([rids, pa.array(size), pa.array([x.tobytes() for x in low], pa.binary())], ["rid", "size", "sketch"])

    return _signed(lines, "rid bigint, size bigint, sketch binary", make)


def agree(many: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (many == one).sum(1) >= LEAST_EQUAL


def line_groups(docs: DataFrame, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False, block: int = BLOCK) -> DataFrame:
    """doc, line_no, keep_doc, keep_line of every line that isn't blank: its component's first line; by_text: t and keep_t too."""
    at = {"doc": "keep_doc"} | ({"t": "keep_t"} if by_text else {}) | {"line_no": "keep_line"}
    scratch = Scratch(docs.sparkSession)
    seen = occurrences(docs, id_col, text_col, by_text)
    one = seen.groupBy("h1", "h2").agg(F.min(F.struct(*at, "line")).alias("f"))
    lines = scratch.save(one.select(F.monotonically_increasing_id().alias("rid"), "h1", "h2", *[F.col(f"f.{c}").alias(c) for c in at], F.col("f.line").alias("text")))
    scratch.tidy()
    members = buckets(scratch, banded(lines), block)
    texts = scratch.save(lines.join(members.select("rid").distinct(), "rid", "left_semi"))
    about = scratch.save(sketched(texts))
    labels = link(scratch, members, about, texts.select("rid", "text"), shingles, num, den, agree, block)
    scratch.drop(members, about)
    scratch.tidy()
    heads = lines.select("h1", "h2", *[F.col(c).alias(k) for c, k in at.items()])
    if labels is not None:
        moved_rows = texts.drop("text").join(labels.select(F.col("node").alias("rid"), "comp"), "rid")
        firsts = moved_rows.groupBy("comp").agg(F.min(F.struct(*at)).alias("f"))
        moved = scratch.save(moved_rows.join(firsts, "comp").select("h1", "h2", "f"))
        heads = heads.join(moved, ["h1", "h2"], "left").select("h1", "h2", *[F.coalesce(f"f.{c}", k).alias(k) for c, k in at.items()])
        # A table of its own: the join below is a plain one, so a line that very many rows share can be split.
        heads = scratch.save(heads)
        scratch.drop(lines, texts, moved)
    scratch.tidy()
    return seen.select(*at, "h1", "h2").join(heads, ["h1", "h2"]).select(*at, *at.values())


def drop_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without their repeated lines, same columns; those left without words go."""
    docs = once(docs, BLANK + "\n")
    out = line_groups(docs, num, den, by_text=True)
    d, t, g = named(docs, "of", "t", "gone")
    gone = out.filter("doc <> keep_doc or t <> keep_t or line_no <> keep_line").groupBy(F.col("doc").alias(d), F.col("t").alias(t)).agg(F.collect_set("line_no").alias(g))
    joined = docs.join(gone, [id_of("doc_id") == F.col(d), F.xxhash64(text_of()) == F.col(t)], "left")
    kept = F.array_join(F.filter(F.split(text_of(), "\n"), lambda line, i: ~F.array_contains(F.col(g), i)), "\n")
    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(kept)
    cols = [text.alias(c) if c == "text" else F.char_length(text).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return joined.filter(F.col(g).isNull() | has_words(text, BLANK + "\n")).select(*cols)


def op2_lines(spark, sf_dir: str) -> DataFrame:
    """Every line of every document with its component (its first line) and whether it stays."""
    out = line_groups(table(spark, sf_dir, "documents"))
    kept = (F.col("doc") == F.col("keep_doc")) & (F.col("line_no") == F.col("keep_line"))
    return out.select(back_to_id("doc").alias("doc_id"), "line_no", back_to_id("keep_doc").alias("component_doc_id"), F.col("keep_line").alias("component_line_no"), kept.alias("kept"))
