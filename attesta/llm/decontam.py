"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in a normal form: lower case, every run of characters other than letters and
digits as one space. A test item of n characters may occur with up to k = floor(error_rate * n)
edits. It is split into k + 1 pieces; k edits leave at least one piece whole, so one Aho-Corasick
pass over a document finds every possible place. Each place is verified with Myers' bit-parallel
distance, which finds the item anywhere in the window around the hit. Nothing else decides.

An item with k = 0 (up to 12 characters by default) must stand between word edges, for a short word is
part of many others; longer items may start and end anywhere.

Items are a stated query set: they are read in blocks of at most ``block_bytes`` bytes, each a
broadcast of its own, and every block runs over all documents, so an automaton's size is bounded however
many items there are. A task has one block at a time: with several it holds ``HELD_BYTES`` of documents
and lets every block search them.
Null or empty texts and items match nothing; items without an id are left out. Items of one normal form
are searched once and all named. Repeated documents: one row each. Documents are whole; a long one only
takes longer. An empty table of documents gives an empty result, one of items no match. ``clean`` keeps
all columns; ``search`` reads no others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

ERROR_RATE = 0.08
BLOCK_BYTES = 16 << 20
#: Bytes of documents that a task holds while several blocks search them.
HELD_BYTES = 64 << 20
_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges of nearly equal length that cover n characters."""
    return [(j * n // (k + 1), (j + 1) * n // (k + 1)) for j in range(k + 1)]


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of m characters to any part of text, and the first end."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | vn
        d0 = (((eq & vp) + vp) ^ vp) | x
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = hn | (full & ~(d0 | hp))
        vn = d0 & hp
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """One block of items (their ids and normal form), ready to search texts."""

    def __init__(self, items: list[tuple[list[int], str]], error_rate: float) -> None:
        import ahocorasick

        self.items = []
        self.auto = ahocorasick.Automaton()
        by_piece: dict[str, list] = {}
        for ids, text in items:
            k = int(error_rate * len(text))
            if not k:
                text = f" {text} "
            n, at = len(text), len(self.items)
            self.items.append((ids, text, k, masks_of(text)))
            for lo, hi in pieces(n, k):
                by_piece.setdefault(text[lo:hi], []).append((at, hi))
        for piece, spots in by_piece.items():
            self.auto.add_word(piece, spots)
        if by_piece:
            self.auto.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, least distance, end of that match in the normal form), one for each item found."""
        text = f" {text} " if text else ""
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, list[tuple[int, int]]] = {}
        for last, spots in self.auto.iter(text) if self.items and text else ():
            for at, hi in spots:
                item, pattern, k, masks = self.items[at]
                if at in found and found[at][0] == 0:
                    continue
                # The item would start here if nothing were inserted or deleted before the piece.
                start = last + 1 - hi
                lo, up = max(0, start - k), min(len(text), start + len(pattern) + k)
                if any(a <= lo and up <= b for a, b in tried.get(at, ())):
                    continue
                if k == 0:
                    best, end = (0, len(pattern)) if text.startswith(pattern, max(0, start)) and start >= 0 else (1, 0)
                    lo = max(0, start)
                else:
                    best, end = myers(masks, len(pattern), text[lo:up])
                tried.setdefault(at, []).append((lo, up))
                if best <= k and (at not in found or (best, lo + end) < found[at]):
                    found[at] = (best, lo + end)
        # The blank before the text doesn't count, nor the one after an item without errors.
        return sorted((i, d, min(end, len(text) - 1) - (1 if self.items[at][2] else 2 - (end == len(text)))) for at, (d, end) in found.items() for i in self.items[at][0])


Block = list[tuple[list[int], str]]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> list[Broadcast]:
    """Normalised items in blocks of bounded size. The driver has one at a time."""

    @F.arrow_udf("string")
    def norm(texts: pa.Array) -> pa.Array:
        return pa.array([normal(t or "") for t in texts.to_pylist()], pa.string())

    rows = items.select(F.col(id_col).cast("long").alias("item"), norm(F.col(text_col)).alias("text")).filter("item is not null and text != ''")
    rows = rows.groupBy("text").agg(F.sort_array(F.collect_set("item")).alias("items")).orderBy(F.col("items")[0])
    out, block, size = [], [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r["text"]) > block_bytes:
            out.append(items.sparkSession.sparkContext.broadcast(block))
            block, size = [], 0
        block.append((list(r["items"]), r["text"]))
        size += len(r["text"])
    return [*out, items.sparkSession.sparkContext.broadcast(block)]


def _matched(batches: Iterator[pa.RecordBatch], column: int, blocks: list[Broadcast], error_rate: float) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """Each batch with its rows' matches."""
    if len(blocks) == 1:
        m = Matcher(blocks[0].value, error_rate)
        for batch in batches:
            yield batch, [m.search(normal(t.as_py() or "")) for t in batch.column(column)]
        return
    # One automaton at a time: every block searches the rows held, then they go out.
    for held in _gathered(batches):
        texts = [[normal(t.as_py() or "") for t in batch.column(column)] for batch in held]
        hits = [[[] for _ in x] for x in texts]
        for block in blocks:
            m = None  # the last one goes before the next is built
            m = Matcher(block.value, error_rate)
            vars(block).pop("_value", None)  # nor is its list kept: it is read again from the worker's file
            for x, h in zip(texts, hits, strict=True):
                for i, t in enumerate(x):
                    h[i] += m.search(t)
        yield from zip(held, [[sorted(x) for x in h] for h in hits], strict=True)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


FOUND = "doc_id bigint, items array<bigint>, distances array<bigint>, ends array<bigint>"


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents' matches: doc_id, items, distances, ends; one row per document, whatever the number of blocks."""
    blocks = _blocks(items, item_col, item_text, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _matched(batches, 1, blocks, error_rate):
            cols = [pa.array([[h[i] for h in x] for x in hits], pa.list_(pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "items", "distances", "ends"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, FOUND)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without a match, with all their columns; one pass, no join."""
    blocks, at = _blocks(items, "item_id", "text", block_bytes), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _matched(batches, at, blocks, error_rate):
            yield batch.filter(pa.array([not h for h in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontam(spark, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds, nearest first found place of each."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").alias("n_items"), "items", "distances", "ends")
