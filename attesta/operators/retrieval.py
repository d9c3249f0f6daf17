"""Retrieval of a stated query set: BM25 by an inverted index, hybrids with embeddings and coverage, top k.

``bm25`` asks an index (see ``index``). A hybrid scales cosines by their range over all documents, and an
embedding has no zero to leave out, so ``retrieve`` streams the documents past blocks of ``BLOCK`` queries: no
pair is shuffled. A pass gives document frequencies, another the range of each score, a third the
best k of each task, which are merged. A task holds the texts that each asked word is in, and scores of
``ROWS`` documents. Ties go to the smaller document; scores are compared to nine places.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from . import cluster, index

K1, B = 1.5, 0.75
BLOCK = 2000
#: Documents scored at a time.
ROWS = 256


def words(text: str | None) -> list[str]:
    return re.findall(r"\w+", (text or "").lower())


def statistics(queries: DataFrame, docs: DataFrame) -> tuple[int, float, dict[str, int]]:
    """Documents, their mean length in words (1 if it is 0), and how many have each of the queries' words."""
    one = docs.select(T.tokens(F.col("text")).alias("w"))
    n, mean = one.agg(F.count(F.lit(1)), F.avg(F.size("w"))).first()
    asked = queries.select(F.explode(T.tokens(F.col("text"))).alias("t")).distinct()
    found = one.select(F.explode(F.array_distinct("w")).alias("t")).join(asked, "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    return n, mean or 1.0, {r["t"]: r["df"] for r in found.collect()}  # one row per word of the query set


class Scorer:
    """Scores of a batch of documents for a block of texts, through the texts that each word is in."""

    def __init__(self, texts: list[str], n: int, mean: float, df: dict[str, int], embed: Callable | None) -> None:
        sets = [set(words(t)) for t in texts]
        self.at = {t: i for i, t in enumerate(sorted(set().union(*sets)))}
        self.idf = np.array([np.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)) for t in self.at])
        pairs = np.array(sorted((self.at[t], i) for i, s in enumerate(sets) for t in s), np.int64).reshape(-1, 2)
        self.first, self.texts = np.searchsorted(pairs[:, 0], np.arange(len(self.at) + 1)), pairs[:, 1]
        self.size = np.maximum(np.bincount(self.texts, minlength=len(texts)), 1)
        self.mean, self.embed = mean, embed
        self.vectors = embed(texts) if embed else None

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, asked word and its number of occurrences; the length of each document."""
        found, length = [], np.zeros(len(texts))
        for i, text in enumerate(texts):
            w = words(text)
            length[i] = len(w)
            found += [(i, self.at[t], c) for t, c in Counter(x for x in w if x in self.at).items()]
        return *np.array(found, np.int64).reshape(-1, 3).T, length

    def _spread(self, doc: np.ndarray, word: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
        """Sums of the parts that documents give to the texts with their words."""
        n = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
        wide = len(self.size)
        return np.bincount(np.repeat(doc, n) * wide + self.texts[at], np.repeat(part, n), docs * wide).reshape(docs, wide).astype(np.float64)  # of nothing it is whole

    def bm25(self, doc: np.ndarray, word: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self._spread(doc, word, self.idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / self.mean)), len(length))

    def cosine(self, texts: list[str]) -> np.ndarray:
        return self.embed(texts) @ self.vectors.T

    def coverage(self, doc: np.ndarray, word: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self._spread(doc, word, np.ones(len(doc)), len(length)) / self.size


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part.column(0), [t or "" for t in part.column(1).to_pylist()]


def _best(docs: DataFrame, qids: list, qid_type, score: Callable, k: int, fields: list[str]) -> DataFrame:
    """qid, doc and fields (the first one ranks) of each task's best k. score: a list of texts to a matrix per field."""
    doc_type = docs.schema["doc"].dataType
    kinds = [to_arrow_type(qid_type), to_arrow_type(doc_type), *[pa.float64()] * len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in qids]
        for ids, texts in _texts(batches):
            ids, all_scores = ids.to_pylist(), score(texts)
            rank = np.round(all_scores[0], 9)
            for q in range(len(qids)):
                column = rank[:, q]
                near = np.argsort(-column, kind="stable") if len(ids) <= k else np.flatnonzero(column >= np.partition(column, len(ids) - k)[len(ids) - k])
                new = [(-column[i], ids[i], *(s[i, q] for s in all_scores)) for i in near.tolist()]
                held[q] = sorted(held[q] + new)[:k]
        rows = [(qids[q], r[1], *r[2:]) for q, mine in enumerate(held) for r in mine]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["qid", "doc", *fields])

    return docs.select("doc", "text").mapInArrow(run, f"qid {qid_type.simpleString()}, doc {doc_type.simpleString()}, " + ", ".join(f"{f} double" for f in fields))


def top_k(scores: DataFrame, k: int = 5, col: str = "score") -> DataFrame:
    """The best k rows of each query, with their rank; ties by document."""
    order = W.partitionBy("qid").orderBy(F.round(col, 9).desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame, block: int) -> Iterator[list]:
    held = []
    for r in queries.select("qid", "text").orderBy("qid").toLocalIterator():
        held.append((r["qid"], r["text"] or ""))
        if len(held) == block:
            yield held
            held = []
    if held:
        yield held


def _united(parts: list[DataFrame], empty: str, docs: DataFrame) -> DataFrame:
    if not parts:
        return docs.sparkSession.createDataFrame([], empty)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bm25(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """qid, rank, doc, score: the best k documents of each query, those without a common word last. queries: qid, text; docs: doc, text.

    Only postings of the queries' words are made; ``index.build`` and ``index.best`` keep an index for many searches.
    """
    words = queries.select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("token"))
    return index.best(index.build(docs, words), queries, k)


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 5, alpha: float = 0.5, embedder: Callable | None = None, reranker: Callable | None = None, expand: bool = True, block: int = BLOCK) -> DataFrame:
    """qid, rank, doc, score, hybrid, rerank (four places, after ranking).

    hybrid: the greatest, over the query's expansions (0 at least), of alpha * cosine + (1 - alpha) *
    BM25, both scaled to 0..1 over all documents. rerank: the share of the query's words that a document
    has. score: 0.7 rerank + 0.3 hybrid. embedder: a list of texts to a matrix of unit rows; reranker:
    the queries and a list of texts to a matrix of texts by queries.
    """
    embed = embedder or cluster._embed
    forms = T.expand_query(F.coalesce("text", F.lit(""))) if expand else F.array(F.coalesce("text", F.lit("")))
    wide = queries.select("qid", "text", forms.alias("forms"))
    n, mean, df = statistics(queries, docs)
    parts = []
    for some in _blocks(queries, block):
        chosen = {r["qid"]: r["forms"] for r in wide.filter(F.col("qid").between(some[0][0], some[-1][0])).collect()}  # a block's
        # Without an embedder of one's own, a query in quotes has the same words as the query.
        asked = [(i, f) for i, (q, t) in enumerate(some) for f in chosen[q] if embedder or f != f'"{t}"']
        owner = np.array([i for i, _ in asked])
        s, plain = Scorer([f for _, f in asked], n, mean, df, embed), Scorer([t for _, t in some], n, mean, df, None)
        names = [t for _, t in some]

        def span(batches: Iterator[pa.RecordBatch], s=s) -> Iterator[pa.RecordBatch]:
            for _, texts in _texts(batches):
                both = [s.bm25(*s.counts(texts)), s.cosine(texts)]
                cols = [x for m in both for x in (m.min(0), m.max(0))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s.size))), *map(pa.array, cols)], ["v", "b0", "b1", "c0", "c1"])

        ends = docs.mapInArrow(span, "v bigint, b0 double, b1 double, c0 double, c1 double").groupBy("v").agg(F.min("b0"), F.max("b1"), F.min("c0"), F.max("c1"))
        ends = np.array(sorted(tuple(r) for r in ends.collect())).reshape(-1, 5)[:, 1:]  # one row per form
        if not len(ends):
            continue

        def score(texts: list[str], s=s, plain=plain, owner=owner, names=names, ends=ends) -> list[np.ndarray]:
            def scaled(m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
                return np.where(hi > lo, (m - lo) / np.where(hi > lo, hi - lo, 1), 0.0)

            mixed = alpha * scaled(s.cosine(texts), ends[:, 2], ends[:, 3]) + (1 - alpha) * scaled(s.bm25(*s.counts(texts)), ends[:, 0], ends[:, 1])
            hybrid = np.zeros((len(texts), len(names)))
            for v, q in enumerate(owner.tolist()):
                hybrid[:, q] = np.maximum(hybrid[:, q], mixed[:, v])
            rerank = reranker(names, texts) if reranker else plain.coverage(*plain.counts(texts))
            return [0.7 * rerank + 0.3 * hybrid, hybrid, rerank]

        parts.append(_best(docs, [q for q, _ in some], queries.schema["qid"].dataType, score, k, ["score", "hybrid", "rerank"]))
    shape = f"qid {queries.schema['qid'].dataType.simpleString()}, doc {docs.schema['doc'].dataType.simpleString()}, score double, hybrid double, rerank double"
    best = top_k(_united(parts, shape, docs), k)
    return best.select("qid", "rank", "doc", *[F.bround(F.round(c, 9), 4).alias(c) for c in ("score", "hybrid", "rerank")])
