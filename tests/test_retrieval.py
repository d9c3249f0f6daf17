"""Retrieval against a plain computation, and routing of claims."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from attesta.operators import cluster, index, retrieval, risk, verdicts

DOCS = {1: "red barn on the hill", 2: "the red red fox", 3: "a quiet harbour town", 4: "fox and barn, barn and fox", 5: ""}
ASKED = {"a": "red fox", "b": "barn", "c": "nothing here matches"}


def plain(alpha=0.5):
    """The same, computed over all pairs in plain Python."""
    words = {k: v.replace(",", "").split() for k, v in DOCS.items()}
    mean = sum(map(len, words.values())) / len(words)
    vec = dict(zip([*ASKED.values(), *DOCS.values()], cluster._embed([*ASKED.values(), *DOCS.values()]), strict=True))

    def bm25(q, d):
        score = 0.0
        for t in set(q.split()):
            n, tf = sum(t in w for w in words.values()), words[d].count(t)
            score += math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[d]) / mean)) if tf else 0
        return score

    def scale(v):
        return {d: (x - min(v.values())) / (max(v.values()) - min(v.values())) if max(v.values()) > min(v.values()) else 0.0 for d, x in v.items()}

    out = {}
    for q, text in ASKED.items():
        key = " ".join(t for t in text.split() if len(t) > 3)
        hybrid = dict.fromkeys(DOCS, 0.0)
        for form in dict.fromkeys([text, key]) if key else [text]:
            own = cluster._embed([form])[0]
            lex, sem = scale({d: bm25(form, d) for d in DOCS}), scale({d: float(own @ vec[t]) for d, t in DOCS.items()})
            hybrid = {d: max(hybrid[d], alpha * sem[d] + (1 - alpha) * lex[d]) for d in DOCS}
        cover = {d: len(set(text.split()) & set(words[d])) / len(set(text.split())) for d in DOCS}
        out[q] = {d: (0.7 * cover[d] + 0.3 * hybrid[d], hybrid[d], cover[d]) for d in DOCS}
    return out


def frames(spark):
    return spark.createDataFrame(list(ASKED.items()), "qid string, text string"), spark.createDataFrame(list(DOCS.items()), "doc int, text string").repartition(3)


def test_retrieve(spark):
    asked, docs = frames(spark)
    want = []
    for q, scores in plain().items():
        want += [(q, i + 1, d, *scores[d]) for i, d in enumerate(sorted(DOCS, key=lambda d: (-round(scores[d][0], 9), d))[:3])]
    for block in (retrieval.BLOCK, 1):
        rows = sorted(tuple(r) for r in retrieval.retrieve(asked, docs, k=3, block=block).collect())
        assert [r[:3] for r in rows] == [w[:3] for w in want]
        assert all(abs(a - b) <= 0.5e-4 + 1e-9 for r, w in zip(rows, want, strict=True) for a, b in zip(r[3:], w[3:], strict=True))
    assert retrieval.retrieve(asked.limit(0), docs).count() == 0


def test_reranker_and_embedder(spark):
    asked, docs = frames(spark)
    got = retrieval.retrieve(asked, docs, k=1, reranker=lambda queries, texts: np.array([[float("harbour" in t)] * len(queries) for t in texts])).collect()
    assert {r["doc"] for r in got} == {3} and all(r["rerank"] == 1.0 for r in got)
    same = retrieval.retrieve(asked, docs, k=2, embedder=cluster._embed).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, retrieval.retrieve(asked, docs, k=2).collect()))


def test_route(spark):
    claims = spark.createDataFrame([("low", "plain prose"), ("hit", "Sales grew 8%"), ("split", "The EU banned X and required Y"), ("none", "Sales grew 9%"), ("unrisked", "8%")], "claim_id string, text string")
    found = spark.createDataFrame([("hit", "verified", "ok"), ("split", "verified", "ok"), ("low", "refuted", "ab_contradiction")], "claim_id string, status string, reason string")
    got = verdicts.route(claims.select("claim_id"), risk.classify(claims.filter(F.col("claim_id") != "unrisked")), found)
    assert {r["claim_id"]: (r["status"], r["reason"]) for r in got.collect()} == {"low": ("cite_write", "non_high_risk"), "hit": ("verified", "ok"), "split": ("unresolved", "needs_atomization"), "none": ("unresolved", "missing"), "unrisked": ("cite_write", "non_high_risk")}


def letters(n, seed):
    """Documents over a few frequent and many rare words, of very different lengths, with ties."""
    r = random.Random(seed)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 3000}"
    docs = [(i, " ".join(word() for _ in range(r.choice([3, 10, 200])))) for i in range(n)]
    return docs + [(n + i, docs[i][1]) for i in range(20)] + [(n + 30, ""), (n + 31, None), (n + 32, "w1 " * 500)]


def brute(docs, queries, k):
    words = {d: retrieval.words(t) for d, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for q, text in queries:
        scores = {}
        for d, w in words.items():
            s = 0.0
            for t in set(retrieval.words(text)):
                if tf := w.count(t):
                    s += math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
            scores[d] = s
        for rank, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k], 1):
            out.append((q, rank, d, round(scores[d], 6)))
    return sorted(out)


def test_index_against_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SEED_POSTINGS", 8)
    monkeypatch.setattr(index, "SEED_BLOCKS", 2)
    docs = letters(900, 1)
    queries = [(1, "w1 w2 w3 w977"), (2, "w1 w1 w2"), (3, docs[5][1]), (4, "absent words"), (5, ""), (6, None), (7, "w2999 w1"), (8, " ".join(f"w{i}" for i in range(1, 60))), (9, "w1")]
    df, q = spark.createDataFrame(docs, "doc bigint, text string").repartition(3), spark.createDataFrame(queries, "qid bigint, text string")
    made = index.build(df, block=16)
    made.save(str(tmp_path / "i"))
    held = index.load(spark, str(tmp_path / "i"))
    assert held.blocks.groupBy("token", "size", "place").count().filter("count > 1").count() == 0
    assert held.blocks.selectExpr("max(size(docs))").first()[0] < 64 < held.words.selectExpr("max(df)").first()[0]
    for k in (3, 12):
        want = brute(docs, queries, k)
        for own in (made, held):
            assert sorted((r["qid"], r["rank"], r["doc"], round(r["score"], 6)) for r in index.best(own, q, k).collect()) == want
        assert sorted((r["qid"], r["rank"], r["doc"], round(r["score"], 6)) for r in retrieval.bm25(q, df, k).collect()) == want
    # Most postings of frequent words stay unread.
    words = index.asked(held, q)
    rated, blocks = index.wanted(held, words, index.bounds(held, words, 3))
    read, there = blocks.selectExpr("sum(size(docs))").first()[0], words.agg(F.sum("held")).first()[0]
    assert 0 < read < 0.7 * there and rated.filter("not essential").count() > 0


def test_index_of_nothing(spark):
    docs, q = spark.createDataFrame([], "doc bigint, text string"), spark.createDataFrame([(1, "a")], "qid bigint, text string")
    assert retrieval.bm25(q, docs).count() == 0 and retrieval.bm25(q.limit(0), docs).count() == 0
    rows = retrieval.bm25(q, spark.createDataFrame([(7, "b"), (8, None)], "doc bigint, text string")).collect()
    assert [(r["rank"], r["doc"], r["score"]) for r in rows] == [(1, 7, 0.0), (2, 8, 0.0)]
