"""Conversation repair, mixing and the divergence audit against brute force, with nulls, ties, repeats, long rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import divergence, mixing, repair

BLANKS = " \t\n\x0b\x0c\r"
LEGAL = re.compile("(s?(ua)+)?")


# ---- conversation repair -------------------------------------------------------------------


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """Rows in order with their first fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, t, role, text in rows:
        bare = text.strip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def cheapest(rows):
    """All edit strings with up to two inserts in each gap: the cheapest, then the least."""
    best = None
    for ops in itertools.product("KRD", repeat=len(rows)):
        if any(o != "D" and r[3] in ("blank", "duplicate") for o, r in zip(ops, rows, strict=True)):
            continue
        cost0 = sum({"K": 0, "R": 2, "D": 3}[o] + (o != "D" and r[3] == "truncated") for o, r in zip(ops, rows, strict=True))
        if best and cost0 > best[0]:
            continue
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost = cost0 + 2 * sum(gaps)
            if best and cost > best[0]:
                continue
            audit = "".join("I" * g + o for g, o in zip(gaps, [*ops, ""], strict=True))
            made, i = [], 0
            for e in audit:
                row = rows[i] if e != "I" else None
                i += e != "I"
                if e == "D":
                    continue
                initial = (row[1][:1] or "?") if e == "K" else "a" if made and made[-1][0][:1] == "u" else "u"
                made.append((row[1] if e == "K" else {"a": "assistant", "u": "user"}[initial], "" if e == "I" else row[2], initial))
            if LEGAL.fullmatch("".join(m[2] for m in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t, _ in made))
    return best


def expected(original):
    by = {}
    for r in damaged(original):
        by.setdefault(r[0], []).append(r)
    out = {}
    for c in {r[0] for r in original}:
        rows = faults(by.get(c, []))
        turns = [r[0] for r in rows if r[0] is not None]
        kinds = Counter(r[3] for r in rows)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, text = cheapest(rows)
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def conversations():
    r = random.Random(5)
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "x"), (1, None, "assistant", "x."), (2, 4, "user", "tie."), (2, 4, "assistant", "tie."), (2, 4, "assistant", "tie."), (2, 900, "", "no role."), (3, 1, "tool", " \t\x0b"), (4, 7, "system", "s."), (4, 8, "system", "t!\n")]
    for c in range(10, 90):
        t = 0
        for _ in range(r.randint(1, 4)):
            t += r.choice((1, 1, 2))
            rows.append((c, t, r.choice(["user", "assistant", "user", "assistant", "system", "ann", None]), r.choice(["Same.", f"Say {t}.", "cut off", None, "", "Well?", "é\n"])))
    return rows + [(7, 2**62, "user", "far."), (7, -(2**62), "user", "far off."), (95, 0, "user", "x" * 300000 + ".")]


SHAPE = "conv_id bigint, turn bigint, role string, text string, kind string, digest string, place string"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize(("piece", "fan"), [(repair.PIECE, repair.FAN), (2, 2)])
def test_repairs_against_all_edits(spark, piece, fan):
    rows = conversations()
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SHAPE).repartition(3)
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in repair.repair(repair.damage(df), df, piece, fan).collect()}
    assert got == expected(rows)
    assert {a for *_, audit, _ in got.values() for a in audit} == set("DIKR")


def walked(rows):
    """The same edits by a walk over states, for conversations of any length."""
    best = {"": (0, "")}

    def inserts():
        for frm, to in (("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
            if frm in best:
                best[to] = min(best.get(to, (1 << 60, "")), (best[frm][0] + 2, best[frm][1] + "I"))

    inserts()
    for _, role, _, fault in rows:
        new = {}
        for state, (cost, audit) in best.items():
            ways = [(state, 3, "D")]
            if fault not in ("blank", "duplicate"):
                to = "a" if state == "u" else "u"
                cut = int(fault == "truncated")
                ways.append((to, 2 + cut, "R"))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    ways.append((role[:1], cut, "K"))
            for to, more, letter in ways:
                new[to] = min(new.get(to, (1 << 60, "")), (cost + more, audit + letter))
        best = new
        inserts()
    return min(v for k, v in best.items() if k in ("", "a"))


def test_one_long_conversation(spark):
    """Three levels of pieces, many equal rows, many rows of one turn."""
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", f"{t}!", f"{t}?", ""])) for t in range(900)] + [(1, 40, "user", f"tie {i}.") for i in range(100)] + [(1, 41, "user", "copy.")] * 50
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = repair.repair(df, piece=16, fan=8).first()
    flat = faults(rows)
    assert (got["cost"], got["audit"]) == walked(flat)
    assert got["duplicate"] == sum(f[3] == "duplicate" for f in flat) and got["illegal"] == sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(flat))


def test_nothing_left_after_damage(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "x.")], "conv_id bigint, turn bigint, role string, text string")
    row = repair.repair(repair.damage(df), df).first()
    assert tuple(row[f] for f in FIELDS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# ---- mixing --------------------------------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, source string, size string, h string, target string"


def mixed_docs():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    text = lambda n: r.choice(["", " "]) + r.choice([" ", "\n", " \t"]).join(word() for _ in range(n)) + r.choice(["", "\x0b"])
    rows = [(i, text(r.choice([1, 3, 20, 90])), r.choice(["b", "a", "c", None, "é", ""])) for i in range(60)]
    return rows + [(70, None, "a"), (71, "", "only empty"), (72, " \t\r\n", "only empty"), (None, "w x y", "b"), (None, "w x y", "b"), (73, "same same", "c"), (73, "same same", "c"), (74, text(3000), "long"), (75, "one", "single"), (75, None, None)]


def sizes_of(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]


def test_targets():
    got = mixing.targets([100, 10, 50, 0])  # weights 3, 1, 2, 3
    assert got == [132, 20, 88, 0]  # 220 of 240 are left for weights 3 and 2
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    r = random.Random(1)
    for _ in range(200):
        sizes = [r.choice([0, 1, 5, 100, 10**6]) for _ in range(r.randint(1, 9))]
        got = mixing.targets(sizes)
        assert sum(got) == Fraction(3, 2) * sum(sizes) and all(0 <= t <= 2 * s for t, s in zip(got, sizes, strict=True))
        units = {t / (3, 1, 2)[i % 3] for i, (t, s) in enumerate(zip(got, sizes, strict=True)) if t < 2 * s}
        assert len(units) <= 1 and all(t / (3, 1, 2)[i % 3] <= u for u in units for i, t in enumerate(got))


@pytest.mark.parametrize(("block", "shard"), [(mixing.BLOCK_WORDS, mixing.SHARD_BLOCKS), (4, 7)])
def test_mixing(spark, block, shard, tmp_path):
    rows = mixed_docs()
    make = lambda n: spark.createDataFrame([(i, t, "x", s, "clash", "clash", "clash") for i, t, s in rows], DOCS).repartition(n)
    mixed = mixing.mix(make(3), block_words=block, shard_blocks=shard)
    got = sorted(map(repr, mixing.taken(mixed).collect()))
    assert got == sorted(map(repr, mixing.taken(mixing.mix(make(5), block_words=block, shard_blocks=shard)).collect()))  # however it is dealt
    size = sizes_of(rows)
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(k for k, (*_, s) in zip(size, rows, strict=True) if s == n) for n in names}
    target = dict(zip(names, mixing.targets([total[n] for n in names]), strict=True))
    docs = mixed.docs.collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["source_size"], r["target"]) for r in docs) == sorted((i or -1, k, total[s], float(target[s])) for k, (i, _, s) in zip(size, rows, strict=True))
    # Brute force: each span marks its words; words of a source are laid end to end.
    seen = {n: np.zeros(total[n], int) for n in range(len(names)) for n in [names[n]]}
    shards = {}
    for r in mixed.spans.collect():
        a = r["begin"] + r["from_word"]
        seen[names[r["source_no"]]][a : a + r["n_words"]] += 1
        shards.setdefault(r["shard"], {}).setdefault(r["place"], set()).add((r["source_no"], r["pass"], r["block"]))
    for n in names:
        assert seen[n].sum() == min(int(target[n] + Fraction(1, 2)), 2 * total[n]) and seen[n].max(initial=0) - seen[n].min(initial=2 if len(seen[n]) else 0) <= 1
    assert all(len(b) == 1 for s in shards.values() for b in s.values()) and all(set(s) == set(range(len(s))) for s in shards.values())
    blocks = [b for s in shards.values() for v in s.values() for b in v]
    assert len(blocks) == len(set(blocks)) and (block > 4 or len(shards) > 50)
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    if block == 4:
        mixing.write_shards(mixing.with_words(make(2), mixed), str(tmp_path / "s"))
        out = spark.read.parquet(str(tmp_path / "s")).collect()
        want = Counter(w for (i, t, s) in rows for w in [])
        for r in mixed.spans.collect():
            d = next(t for i, t, s in rows if i == r["doc_id"] and len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) > 0 and s == names[r["source_no"]])
            want.update(re.findall(r"[^\x20\x09-\x0D]+", d)[r["from_word"] : r["from_word"] + r["n_words"]])
        assert Counter(w for r in out for w in r["text"].split(" ")) == want


def test_tree_and_orders():
    draws = np.array([1000, 1, 0, 77, 4096])
    for shards in (1, 2, 3, 50):
        leaves = list(mixing.quotas(draws, shards, 9, 0, shards))
        parts = [x for lo in range(0, shards, 7) for x in mixing.quotas(draws, shards, 9, lo, min(lo + 7, shards))]
        assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(leaves, parts, strict=True))
        at = np.zeros_like(draws)
        for _, first, n in leaves:
            assert (first == at).all() and (n >= 0).all()
            at = at + n
        assert (at == draws).all()
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        o = mixing.Order(n, 12345)
        p = o.block(np.arange(n))
        assert sorted(p.tolist()) == list(range(n)) and (o.rank(p) == np.arange(n)).all()
    rng = np.random.default_rng(1)  # beyond numpy's populations: exact sums, near the mean
    have = np.array([3 * 10**9, 10**9, 7, 0, 500])
    got = mixing.hypergeometric(rng, have, 2 * 10**9)
    assert got.sum() == 2 * 10**9 and (got <= have).all() and abs(got[0] - 1.5e9) < 1e5


# ---- divergence audit ----------------------------------------------------------------------


def audit_docs():
    r = random.Random(6)
    words = ["alpha", "Beta", "gamma", "délta", "ÉTÉ", "x", "日本", "ß", "tail", "only"]
    text = lambda k: "".join(r.choice(words[:k]) + r.choice([" ", ", ", "1", "-", "_", "\n", "@["]) for _ in range(r.randint(0, 40)))
    rows = [(i, text(r.choice([3, 10])), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "é", None])) for i in range(70)]
    return rows + [(80, None, "fr", "s1"), (81, "few words", "fr", "s2"), (82, "", "fr", None), (83, "twice twice", "it", "s"), (83, "twice twice", "it", "s"), (84, "twice", "it", "s"), (None, "a" * 100000 + " alpha", "en", "s1"), (85, "alpha", "en", "silent"), (86, "12 34", "de", "numbers")]


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))) for _, t, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(w for *_, ws in mine for w in set(ws))
        kept = [w for w, n in df.items() if n >= least]
        n = {s: Counter(w for _, x, ws in mine if x == s for w in ws if df[w] >= least) for s in {d[1] for d in mine}}
        whole = sum(n.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (c.total() + len(kept)) for w in kept}
        ps, q = {s: p(c) for s, c in n.items()}, p(whole)
        for s in n:
            pairs = [(sum((ps[s][w] - ps[o][w]) ** 2 // ps[o][w] for w in kept), o) for o in n if o != s]
            terms = [((ps[s][w] - q[w]) ** 2 // q[w], w) for w in kept if n[s][w] and ps[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize(("top", "cells", "chunk"), [(200, divergence.CELLS, divergence.CHUNK_BYTES), (3, 4, 30)])
def test_divergence(spark, top, cells, chunk, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", chunk)
    rows = audit_docs()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id bigint, text string, lang string, source string, n string, term string").repartition(3)
    got = divergence.audit(df, top=top).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == brute_audit(rows, top=top)


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(divergence, "hashed", lambda words: np.array([len(w) % 2 for w in words], np.uint64))
    texts = ["ab cd ab", "abc é ab cd", "", "zz ab"]
    who, term, n, docs = divergence.counted(pa.array(texts), np.array([0, 1, 1, 0]))
    want = Counter((g, w) for g, t in zip([0, 1, 1, 0], texts, strict=True) for w in t.split())
    assert {(int(g), t.decode()): int(c) for g, t, c in zip(who, term, n, strict=True)} == want
    assert sum(docs.tolist()) == sum(len(set(t.split())) for t in texts)


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(500):
        total = r.randint(1, 2**47)
        c = r.randint(0, total - 1)
        assert int(divergence.share(np.array([c]), total)[0]) == 1 + 10**9 * (c + 1) // total
