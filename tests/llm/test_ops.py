"""The training-data operators against brute force on small tables with nulls, ties and repeats."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import chat, decontam, lines, linking, media, neardup, packing, quality, suffix, urls, warc
from attesta.llm.common import Scratch

SHAPE = "doc_id bigint, text string, kept string, component_id string"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["the", "an", "re", "ou", "É", "x"]) for _ in range(r.randint(1, 4)))
    base = [" ".join(word() for _ in range(r.randint(20, 120))) for _ in range(25)]
    docs = [(i, t) for i, t in enumerate(base)]
    for i in range(25, 60):
        t = r.choice(base).split(" ")
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = word()
        docs.append((i, " ".join(t)))
    docs += [(60, None), (61, ""), (62, " \t\n"), (63, "one"), (64, "one"), (None, base[0]), (65, "\n".join(base[:5])), (66, base[3] * 40), (3, base[7])]
    return [(i, t, "clash", None) for i, t in docs]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SHAPE).repartition(3)


def find(parent, x):
    while parent.setdefault(x, x) != x:
        x = parent[x]
    return x


def shingle_set(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_neardup(docs):
    big = 2**63 - 1
    rows = [(big if i is None else i, shingle_set(t)) for i, t, *_ in corpus()]
    parent = {}
    for i, a in rows:
        for j, b in rows:
            if a and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    got = neardup.groups(docs, 85, 100, 3).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc"], r["n"]) for r in got) == sorted((i, len(s)) for i, s in rows)
    assert all(r["component"] == find(parent, r["doc"]) for r in got)
    assert neardup.groups(docs.limit(0), 85, 100, 3).count() == 0


@pytest.mark.parametrize("n", range(6))
def test_sets_of_few_words(n):
    for texts in ([" ".join("abcdef"[:n])], [*"abcdef"[:n]]):
        data = "".join(texts).encode()
        sets = neardup.sets_of(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, texts)]), 5)
        assert [len(s) for s in sets] == [int(bool(t)) + (t == "a b c d e f") for t in texts]


def test_rows_without_own_ids(spark):
    r = random.Random(9)
    a, b, c, d, e = (" ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(30)) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (8, d), (None, None), (None, None), (9, "\n"), (9, "\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted([(1, a), (None, b), (None, c), (7, d), (7, e), (None, None), (None, None), (9, "\n"), (9, "\n")], key=repr)
    assert sorted(map(tuple, neardup.one_of_each(df).collect()), key=repr) == want
    assert sorted(map(tuple, lines.drop_lines(df).collect()), key=repr) == want
    kept = {(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in neardup.groups(df, 80, 100, 5).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept").filter("n > 0").collect()}
    assert kept == {(1, 26, 1, True), (2**63 - 1, 26, 1, False), (2**63 - 1, 26, 2**63 - 1, True), (7, 26, 7, True), (8, 26, 7, False)}
    mixed = spark.createDataFrame([(None, f"{a}\n{b}"), (None, f"{a}\n{c}"), (0, a)], "doc_id bigint, text string")
    assert sorted(x["text"] for x in lines.drop_lines(mixed).collect()) == sorted([a, b, c])
    twice = spark.createDataFrame([(None, f"{a}\n{b}"), (None, f"{c}\n{d}"), (0, b)], "doc_id bigint, text string")
    assert sorted(x["text"] for x in lines.drop_lines(twice).collect()) == sorted([a, b, f"{c}\n{d}"])


def test_blocks_of_large_groups(docs, monkeypatch):
    want = {(r["doc"], r["component"]) for r in neardup.groups(docs, 60, 100, 3).collect()}
    monkeypatch.setattr(linking, "GROUP_BYTES", 1500)
    assert {(r["doc"], r["component"]) for r in neardup.groups(docs, 60, 100, 3, block=3).collect()} == want


def test_lines(spark):
    a = "a fairly long line of words that says something once"
    rows = [(0, f"{a}\n\nunique words here\n{a}"), (1, f"  {a}\nother thing"), (2, a.replace("once", "one")), (3, None), (4, "short"), (5, "short"), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc"], r["line_no"]): (r["keep_doc"], r["keep_line"]) for r in lines.line_groups(df).collect()}
    assert got[0, 0] == got[0, 3] == got[1, 0] == got[2, 0] == (0, 0) and got[5, 0] == got[2**63 - 1, 0] == (4, 0) and got[1, 1] == (1, 1)
    left = {r["doc_id"]: r["text"] for r in lines.drop_lines(df).collect()}
    assert left == {0: f"{a}\n\nunique words here", 1: "other thing", 3: None, 4: "short"}
    assert lines.drop_lines(df.limit(0)).count() == 0


def brute_cover(rows):
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        for s in range(len(b) - 49):
            seen[b[s : s + 50]] = min(seen.get(b[s : s + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        off = bytearray(len(b))
        for s in range(len(b) - 49):
            if seen[b[s : s + 50]] < i:
                off[s : s + 50] = b"\1" * 50
        out.append((i, len(b), sum(off), (b"\0" + bytes(off)).count(b"\0\1"), bytes(c for c, o in zip(b, off, strict=True) if not o)))
    return sorted(out)


@pytest.mark.parametrize("hot", [suffix.HOT, 2])
def test_suffix(docs, hot):
    rows = [(2**63 - 1 if i is None else i, t) for i, t, *_ in corpus()]
    assert sorted(tuple(r) for r in suffix.cover(docs, hot=hot).collect()) == [(*r[:4], bytearray(r[4])) for r in brute_cover(rows)]
    assert suffix.cover(docs.limit(0)).count() == 0


def test_long_runs_of_a_pattern(spark, monkeypatch):
    """Runs of far over HOT bytes: equal contexts are decided once, so no anchor after anchor is tried."""
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    runs = ["=" * 3000, "ab" * 1500, "0" * 3000, "x= y" * 700]
    rows = [(i, "".join(word(r.randint(20, 90)) + r.choice(runs)[: r.randint(40, 3000)] for _ in range(5))) for i in range(4)]
    rows += [(4, "=" * 4000 + "!" + "=" * 60), (5, "=" * 4000), (None, " " * 3000), (6, rows[0][1])]
    levels, split = [], suffix._sub_contexts
    monkeypatch.setattr(suffix, "_sub_contexts", lambda c, level: levels.append(level) or split(c, level))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(tuple(x) for x in suffix.cover(df, hot=50).collect())
    assert got == [(*x[:4], bytearray(x[4])) for x in brute_cover([(2**63 - 1 if i is None else i, t) for i, t in rows])]
    assert len(levels) <= 4, levels


def test_common_prefixes():
    r = random.Random(1)
    text = np.array([r.choice([2, 3]) for _ in range(400)] + [0], np.uint8)
    order, group = suffix.common_classes(text, 5)
    pre = [tuple(text[i : i + 5]) for i in order]
    assert all((pre[i] == pre[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(pre)))


def test_media(spark):
    for text in ("", "x" * 191, "é" * 4000, "a" * 192):
        data = media.mux(text.encode())
        (t,) = media.parse(data)
        assert media.joined(data, t) == media.pad(text.encode()) and t["codec"] == "raw " and len(t["keys"]) == -(-len(t["sizes"]) // media.GOP)
    assert media.probe_one(b"\0\0\0\1junk", False)["error"] and media.probe_one(None, False)["error"] == "null"
    rows = media.with_probe(media.with_media(spark.createDataFrame([(1, None), (2, "hi")], "doc_id int, text string"), "text"), payload=True).collect()
    assert [bytes(r["probe"]["payload"]).rstrip() for r in rows] == [b"", b"hi"]


def test_packing(docs):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = {}
    for i, x, *_ in corpus():
        want.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    rows = packing.pack(docs, limit=64, with_ids=True).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for r in rows:
        assert r["length"] <= 64 and r["length"] & (r["length"] - 1) == 0 and r["offset"] == 0
        assert any(w[r["start"] : r["start"] + r["length"]] == r["ids"] and len(w) == r["doc_tokens"] for w in want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(len(w) for v in want.values() for w in v)
    e = packing.Encoder()
    for s in ("", "<|endoftext|> a", "日本語 ɐ test", "é x  \n\n y's 12", "\u0000­"):
        assert e(s) == t.encode(s, add_special_tokens=False).ids


def test_chat(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, None, "yo"), (1, 2, None, "yo"), (2, None, "ann", "x"), (None, 0, "a b", "z"), (1, 700, "ann", "late")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.rotate(df).orderBy("conv_id", "perspective", "position").collect()
    assert len(got) == 3 * 5 + 1 + 1
    for p in ("ann", "bob", "unknown"):
        mine = [r for r in got if r["conv_id"] == 1 and r["perspective"] == p]
        assert [r["position"] for r in mine] == list(range(5)) and all(r["mask"] == (r["speaker"] == p) for r in mine)
        whole = "".join(r["segment"] for r in mine)
        assert all(whole[r["char_start"] : r["char_end"]] == r["segment"] for r in mine)
    assert chat.rotate(df.limit(0)).count() == 0


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontam(spark):
    r = random.Random(2)
    for _ in range(60):
        p, t = ("".join(r.choice("abc") for _ in range(n)) for n in (r.randint(1, 40), r.randint(0, 60)))
        assert decontam.myers(decontam.masks_of(p), len(p), t)[0] == edits(p, t)
    item = "the quick brown fox jumps over the lazy dog and then it sleeps until the morning comes"
    docs = [(1, f"before {item.upper()} after"), (2, item.replace("quick", "quack").replace("lazy", "la-zy")), (3, item[:40]), (4, None), (5, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, item)], "item_id bigint, text string")
    found = {x["doc_id"]: x["items"] for x in decontam.search(d, b).collect()}
    assert found == {1: [7, 10], 2: [7, 10], 3: [], 4: [], 5: []}
    assert sorted(x["doc_id"] for x in decontam.clean(d, b).collect()) == [3, 4, 5]
    assert decontam.clean(d, b.limit(0)).count() == 5


def test_decontam_blocks(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    item = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12)) for _ in range(6)]
    docs = [(1, f"x {item[5]} y {item[0]} z {item[3]}"), (2, item[4]), (2, item[4]), (None, item[1]), (None, "clean"), (3, "clean"), (4, None), (5, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # Item 2 has two texts that end up in different blocks.
    spark.createDataFrame([(9, item[0]), (2, item[1]), (7, item[2]), (1, item[3]), (5, item[4]), (2, item[5])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda: sorted(map(repr, decontam.op5_decontam(spark, str(tmp_path)).collect()))
    want = rows()
    assert len(want) == len(docs) and any("items=[1, 2, 9]" in x for x in want)
    monkeypatch.setattr(decontam.search, "__defaults__", (*decontam.search.__defaults__[:-1], 100))
    monkeypatch.setattr(decontam, "HELD_BYTES", 1, raising=False)
    assert rows() == want


def test_warc(spark):
    rows = [(3, "http://a", "same"), (1, "http://b", "same"), (2, "http://c", None), (4, "http://d", ""), (1, "http://e", "same"), (5, None, "é")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    payloads, records = warc.write(df, Scratch(spark))
    assert payloads.count() == 3
    back = warc.read(payloads, records, Scratch(spark)).collect()
    assert all(r["error"] is None for r in back) and len(back) == 6
    for r in back:
        html = next((h or "") for k, _, h in rows if k == r["key"])
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() and r["payload_bytes"] == len(html.encode())
    assert sorted((r["key"], r["record_type"], r["refers"]) for r in back if r["key"] in (1, 3)) == [(1, "response", None), (1, "revisit", 1), (3, "revisit", 1)]
    broken = payloads.withColumn("payload", F.concat("payload", F.lit("x").cast("binary")))
    assert all(r["error"] for r in warc.read(broken, records, Scratch(spark)).collect())


def test_quality(spark):
    good, bad = "A calm sentence about things.\nAnother one follows it.", "BUY!! NOW!! ###\n$$$ *** %%%"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) + f"\n{i}") for i in range(80)] + [(100, None), (101, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int")
    m = quality.train(docs, labels)
    got = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.score_udf(m)("text").alias("s")).collect()}
    assert all((got[i] >= 0.3) == bool(i % 2) for i in range(80)) and 0 <= got[100] == got[101] <= 1
    assert quality.train(docs, labels.limit(0)).prior == 0.5
    # Marginals of a small chain against all paths.
    r = np.random.default_rng(0)
    s, tr = r.normal(size=(4, 2)), r.normal(size=(2, 2))
    paths = [[p >> i & 1 for i in range(4)] for p in range(16)]
    w = np.array([np.exp(sum(s[i, p[i]] for i in range(4)) + sum(tr[p[i], p[i + 1]] for i in range(3))) for p in paths])
    want = [(w * [p[i] for p in paths]).sum() / w.sum() for i in range(4)]
    assert np.allclose(quality.marginals(s, np.array([0, 4]), tr)[0], want)


def test_urls(spark):
    rows = [(1, "http://A.Example.com/en/7x?q"), (2, "https://www.x.com/en/1"), (3, "http://a.example.net/de/8"), (4, "http://b.net/de/9#t"), (5, "no scheme"), (6, None), (7, "http://notcom/en/"), (8, "http://q.org/es/")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    assert [got[i]["rule"] for i in range(1, 9)] == ["example.com/en/7", "com/en/", "example.net/de/8", "net/de/", None, None, None, "org/es/"]
    assert got[1]["host"] == "a.example.com" and got[1]["path"] == "/en/7x" and got[5]["host"] == "" and got[1]["verdict"] == "allow" and got[2]["verdict"] == "block"
    # Trees learn a lexical rule.
    many = spark.createDataFrame([(f"http://h{i}.com/{'9' * (i % 7)}/a", int(i % 7 > 3)) for i in range(400)], "url string, blocked int")
    m = urls.train(many)
    out = many.select("blocked", m.score(F.col("url")).alias("s")).collect()
    assert sum((r["s"] >= 0.5) == bool(r["blocked"]) for r in out) > 390


def test_a_pair_of_one_hot_bucket_is_compared(spark):
    # 24 members of one bucket in blocks of four; 5 and 22 agree, are of different blocks and share no other bucket.
    rows = [(1, part, rid, True) for rid in range(24) for part in [rid // 4]] + [(1, part, 0, True) for part in range(1, 6)]
    members = spark.createDataFrame(rows, "bucket bigint, part int, rid bigint, hot boolean")
    about = spark.createDataFrame([(rid, 9, bytes([5 if rid == 22 else rid])) for rid in range(24)], "rid bigint, size bigint, sketch binary")
    agree = lambda many, one: (many == one).all(1)
    found = linking._coarse(Scratch(spark), members, about, agree, 80, 100, 4)
    assert found is not None and {(r["node"], r["comp"]) for r in found.collect()} == {(5, 5), (22, 5)}
