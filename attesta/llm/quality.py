"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of character classes and shapes of
the line itself and of both neighbours; two states and their transitions make the chain. Forward and
backward passes give each line's probability of being good; the mean over a document, weighted by
line length, goes through a logistic calibration and is the document's score.

Training takes documents with a label, at most ``train_docs`` of them (those with the smallest hashes
of their ids, of at most ``train_bytes`` bytes each); their lines carry the document's label. Labels,
language, source and id are no features. Without labels of both kinds the score is the labels' mean
(0.5 of nothing). Null texts count as empty; an empty text is one empty line. Repeated rows get equal
scores; two labels of one document count as its larger one, and of several texts with one id the
smallest trains, so a model is the same on every run. Null ids and labels train nothing. Long texts are
whole; batches are cut by bytes, so memory is bounded by the longest document. An empty table gives an
empty result; other columns are not read, and ``classify`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, table, utf8

TRAIN_DOCS = 4000
TRAIN_BYTES = 1 << 16
THRESHOLD = 0.3
ROUNDS = 150
RIDGE = 1e-3
BATCH_BYTES = 2 << 20

#: The character classes that are counted.
CLASSES = {"symbol": b"#$%&*@^~<>=+_\\{}[]", "bang": b"!?", "pipe": b"|", "digit": b"0123456789", "space": b" \t\r", "stop": b".,;:", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123))}
OWN = ["bias", "log_length", "upper", "symbol", "bang", "pipe", "digit", "space", "stop", "word_length", "symbols_a_word", "bangs_a_word", "closed", "capital", "empty", "repeat", "stutter"]
FROM_NEIGHBOURS = ["upper", "symbol", "bang", "pipe", "digit", "symbols_a_word", "closed", "empty", "stutter"]
N_FEATURES = len(OWN) + 2 * (len(FROM_NEIGHBOURS) + 1)


def line_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of a batch of texts, line lengths, and each text's first line."""
    n_docs = len(starts) - 1
    breaks = np.flatnonzero(data == 10)
    # A line starts at each text's start and after each line break.
    heads = np.concatenate([starts[:-1], breaks + 1])
    order = np.argsort(heads, kind="stable")
    # Empty texts share their start with the next text: documents stay in order, breaks come after.
    owner = np.concatenate([np.arange(n_docs), np.searchsorted(starts, breaks, "right") - 1])[order]
    heads = heads[order]
    again = np.lexsort((heads, owner))
    heads, owner = heads[again], owner[again]
    first = np.searchsorted(owner, np.arange(n_docs + 1))
    ends = np.empty_like(heads)
    ends[:-1] = heads[1:] - 1
    ends[first[1:] - 1] = starts[1:]
    n = (ends - heads).astype(np.float64)
    one = np.maximum(n, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=total[1:], dtype=np.int32)
        return (total[ends] - total[heads]).astype(np.float64)

    lut = {k: np.isin(np.arange(256), list(v)) for k, v in CLASSES.items()}
    c = {k: count(lut[k][data]) for k in CLASSES}
    # Latin capitals beyond ASCII: C3 80 to C3 9E in UTF-8; other lead bytes count as small letters.
    wide = data == 0xC3
    capital = np.zeros(len(data), bool)
    capital[:-1] = wide[:-1] & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = c["upper"] + count(capital)
    letters = c["lower"] + c["upper"] + count(data >= 0xC0)
    words = c["space"] + 1
    full = n > 0
    safe = np.concatenate([data, np.zeros(1, np.uint8)])
    last = safe[np.where(full, ends - 1, len(data))]
    begin = safe[np.where(full, heads, len(data))]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * (np.arange(len(data), dtype=np.uint64) * np.uint64(2) + np.uint64(1)), out=sums[1:])
    plain = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data, out=plain[1:], dtype=np.uint64)
    # A position-weighted sum that doesn't depend on where the line starts.
    total = plain[ends] - plain[heads]
    sign = (sums[ends] - sums[heads]) - total * (heads.astype(np.uint64) * np.uint64(2))
    # Words that equal the word before them in the same line.
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = lut["space"][data] | (data == 10)
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True  # words end where texts end
    w0 = np.flatnonzero(~gap[1:-1] & (gap[:-2] | cut[:-1]))
    w1 = np.flatnonzero(~gap[1:-1] & (gap[2:] | cut[1:])) + 1
    word_total = plain[w1] - plain[w0]
    word_sign = (sums[w1] - sums[w0]) - word_total * (w0.astype(np.uint64) * np.uint64(2))
    twice = (word_sign[1:] == word_sign[:-1]) & (word_total[1:] == word_total[:-1]) & ((w1 - w0)[1:] == (w1 - w0)[:-1])
    echo = np.zeros(len(data), bool)
    echo[w0[1:][twice]] = True
    same = np.zeros(len(heads), bool)
    same[1:] = (sign[1:] == sign[:-1]) & (n[1:] == n[:-1]) & (total[1:] == total[:-1]) & (owner[1:] == owner[:-1]) & full[1:]
    cols = {
        "bias": np.ones(len(heads)), "log_length": np.log1p(n) / 6, "upper": upper / np.maximum(letters, 1), "symbol": c["symbol"] / one * 4, "bang": c["bang"] / one * 4, "pipe": c["pipe"] / one * 8,
        "digit": c["digit"] / one * 2, "space": c["space"] / one * 2, "stop": c["stop"] / one * 4, "word_length": np.minimum((n - c["space"]) / words / 10, 3), "symbols_a_word": np.minimum(c["symbol"] / words, 3),
        "bangs_a_word": np.minimum(c["bang"] / words, 3), "closed": np.isin(last, list(b".!?:")).astype(float), "capital": (((begin >= 65) & (begin <= 90)) | (begin == 0xC3)).astype(float), "empty": (~full).astype(float), "repeat": same.astype(float), "stutter": count(echo) / words * 2,
    }
    own = np.stack([cols[k] for k in OWN], 1)
    near = own[:, [OWN.index(k) for k in FROM_NEIGHBOURS]]
    is_first = np.zeros(len(heads), bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(len(heads), bool)
    is_last[first[1:] - 1] = True
    before = np.zeros_like(near)
    before[1:] = near[:-1]
    before[is_first] = 0
    after = np.zeros_like(near)
    after[:-1] = near[1:]
    after[is_last] = 0
    return np.concatenate([own, before, after, is_first[:, None], is_last[:, None]], 1), n, first


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, expected transitions and total log partition; all chains advance together."""
    sizes = np.diff(first)
    by_size = np.argsort(-sizes, kind="stable")
    heads, sizes = first[:-1][by_size], sizes[by_size]
    peak = scores.max(1, keepdims=True)
    emit = np.exp(scores - peak)
    move = np.exp(trans)
    alpha = np.empty_like(emit)
    norm = np.empty(len(emit))
    longest = int(sizes[0]) if len(sizes) else 0
    alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest + 1)]  # chains of over t lines
    for t in range(longest):
        at = heads[: alive[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        norm[at] = a.sum(1)
        alpha[at] = a / norm[at][:, None]
    beta = np.ones_like(emit)
    moved = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = heads[: alive[t + 1]] + t
        ahead = emit[at + 1] * beta[at + 1] / norm[at + 1][:, None]
        if pairs:
            moved += np.einsum("ni,nj->ij", alpha[at], ahead) * move
        beta[at] = ahead @ move.T
    good = alpha * beta
    return (good / good.sum(1, keepdims=True))[:, 1], moved, float(np.log(norm).sum() + peak.sum())


@dataclass
class Model:
    weights: np.ndarray | None
    trans: np.ndarray | None
    slope: float
    shift: float
    prior: float

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(starts) - 1, self.prior)
        return 1 / (1 + np.exp(-(self.slope * self.raw(data, starts) + self.shift)))

    def raw(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Logit of the length-weighted mean of the lines' probabilities."""
        x, n, first = line_features(data, starts)
        return self.pooled(x, n, first)

    def pooled(self, x: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _, _ = marginals(x @ self.weights, first, self.trans)
        weight = np.maximum(n, 1)
        mean = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))


def fit(x: np.ndarray, n: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Model:
    """Maximum conditional likelihood by Adam over all chains, each document weighing the same sum per label."""
    prior = float(labels.mean()) if len(labels) else 0.5
    if prior in (0.0, 1.0) or not len(labels):
        return Model(None, None, 1.0, 0.0, prior)
    line_label = np.repeat(labels, np.diff(first))
    both = np.diff(first) > 1
    target = np.zeros((2, 2))
    for k in (0, 1):
        target[k, k] = (np.diff(first)[(labels == k) & both] - 1).sum()
    w, tr = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(tr), np.zeros_like(tr)]
    onehot = np.stack([1 - line_label, line_label], 1).astype(float)
    lines = len(x)
    for step in range(1, ROUNDS + 1):
        good, moved, _ = marginals(x @ w, first, tr, pairs=True)
        gw = x.T @ (onehot - np.stack([1 - good, good], 1)) / lines - RIDGE * w
        gt = (target - moved) / lines - RIDGE * tr
        for p, g, i in ((w, gw, 0), (tr, gt, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            p += 0.1 * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-9)
    model = Model(w, tr, 1.0, 0.0, prior)
    raw = model.pooled(x, n, first)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic regression of the label on the raw score
        p = 1 / (1 + np.exp(-(a * raw + b)))
        v = p * (1 - p)
        g = np.array([((labels - p) * raw).sum() - 0.01 * a, (labels - p).sum()])
        h = np.array([[(v * raw * raw).sum() + 0.01, (v * raw).sum()], [(v * raw).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a + float(np.clip(d[0], -1, 1)), b + float(np.clip(d[1], -1, 1))
    model.slope, model.shift = max(a, 0.05), b
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fits on labelled documents that aren't held out. The sample is bounded in rows and bytes."""
    known = labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    known = known.filter(~held_out(F.col("k"))).orderBy(F.xxhash64("k"), "k").limit(train_docs)
    ids = known.collect()
    if not ids:
        return Model(None, None, 1.0, 0.0, 0.5)
    wanted = docs.sparkSession.createDataFrame([(r["k"], r["y"]) for r in ids], "k bigint, y int")
    # At most train_docs small rows: a bounded broadcast.
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(text_col, F.lit("")).alias("t")).filter(F.octet_length("t") <= train_bytes).join(F.broadcast(wanted), "k")
    rows = sorted(texts.groupBy("k").agg(F.min("t").alias("t"), F.first("y").alias("y")).collect(), key=lambda r: r["k"])
    parts, ys = [], np.array([r["y"] for r in rows], np.int64)
    for at in range(0, len(rows), 256):
        blobs = [r["t"].encode() for r in rows[at : at + 256]]
        starts = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        parts.append(line_features(np.frombuffer(b"".join(blobs), np.uint8), starts))
    if not parts:
        return Model(None, None, 1.0, 0.0, 0.5)
    first, base = [np.zeros(1, np.int64)], 0
    for x, _, f in parts:
        first.append(f[1:] + base)
        base += len(x)
    return fit(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(first), ys)


def score_udf(model: Model):
    """Scores of a text column, as an Arrow function."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        data, starts = utf8(texts.fill_null(""))
        out = [model.score(data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]) for lo, hi in chunks(np.diff(starts), BATCH_BYTES)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.filter(score_udf(model)(docs[text_col]) >= THRESHOLD)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_udf(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
