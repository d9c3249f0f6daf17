"""Trained models against plain computations: trees walked node by node, document scores from all paths of a chain."""

import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import quality, urls


def lexical(url):
    """Features of a URL in plain Python; hashes are left out."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    query = re.match(r"(?s)^[^?#]*\?([^#]*)", url)
    run = re.search("([0-9]+)[^0-9]*$", path)
    head = re.match("/[^/]*/(.)", path)
    return {
        "length": len(url), "host_length": len(host), "path_length": len(path), "host_labels": host.count("."), "depth": path.count("/"), "hyphens": host.count("-"), "params": query[1].count("&") + 1 if query and query[1] else 0,
        "last_digit_run": len(run[1]) if run else 0, "fragment": int("#" in url), "second_head": ord(head[1]) if head else 0, "digit_permille": int(sum(c in "0123456789" for c in url) * 1000 / max(len(url), 1)),
    }


def test_scores_are_walks_over_the_trees(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcdefghij0123456789-") for _ in range(r.randint(1, n)))
    address = lambda: f"http://{word(8)}.{word(6)}.{r.choice(['com', 'net', 'org'])}/" + "/".join(word(7) for _ in range(r.randint(0, 4))) + r.choice(["", "?a=1", "?a=1&b=2", "#x", "?q=1#y"])
    rows = [(u := address(), int(".com" in u or "?" in u or r.random() < 0.1)) for _ in range(300)]
    model = urls.train(spark.createDataFrame(rows, "url string, blocked int"))
    assert len(model.trees) > 3
    seen = [u for u, _ in rows[:120]] + [address() for _ in range(80)] + ["", "no scheme", "http://", "http://A.COM"]
    names = list(urls.features(F.col("u")))
    cols = [c.alias(k) for k, c in urls.features(F.col("u")).items()]
    got = spark.createDataFrame([(u,) for u in seen], "u string").select("u", *cols, model.suffix_rate(urls.suffix_of(urls.host_of(F.col("u")))).alias("suffix_permille"), model.score(F.col("u")).alias("score")).collect()
    used = set()

    def walk(node, f):
        while node.feature is not None:
            used.add(node.feature)
            node = node.kids[0] if f[node.feature] <= node.cut else node.kids[1]
        return node.value

    for row in got:
        f = {k: row[k] for k in [*names, "suffix_permille"]}
        plain = lexical(row["u"])
        assert {k: f[k] for k in plain} == plain, row["u"]
        want = 1 / (1 + math.exp(-(model.base + sum(walk(t, f) for t in model.trees))))
        assert abs(row["score"] - want) < 1e-12
    assert len(used) > 2


def test_document_scores_from_all_paths(spark):
    """A document's score by summing over every labelling of its lines."""
    r = random.Random(4)
    line = lambda good: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(8)).capitalize() + "." if good else "".join(r.choice("#$%!| A") for _ in range(30))
    docs = [(i, "\n".join(line(i % 2) for _ in range(r.randint(1, 5)))) for i in range(60)] + [(60, ""), (61, "\n\n"), (62, "One line. é日本")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = quality.train(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int"))
    got = {row["doc_id"]: row["s"] for row in df.select("doc_id", quality.score_udf(model)(F.col("text")).alias("s")).collect()}
    for i, text in docs:
        blob = text.encode()
        x, n, first = quality.line_features(np.frombuffer(blob, np.uint8), np.array([0, len(blob)]))
        assert len(x) == text.count("\n") + 1 == first[1] and n.tolist() == [len(s.encode()) for s in text.split("\n")]
        emit = x @ model.weights
        total, good = 0.0, np.zeros(len(x))
        for path in itertools.product((0, 1), repeat=len(x)):
            weight = math.exp(sum(emit[t, s] for t, s in enumerate(path)) + sum(model.trans[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            good += weight * np.array(path)
        size = np.maximum(n, 1)
        mean = min(max(float((good / total * size).sum() / size.sum()), 1e-6), 1 - 1e-6)
        want = 1 / (1 + math.exp(-(model.slope * math.log(mean / (1 - mean)) + model.shift)))
        assert abs(got[i] - want) < 1e-9, i
