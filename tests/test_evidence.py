"""URLs, findings and replay on hand-written rows."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import cluster, evaluate, filters, gate, runs, schema
from attesta.operators.graph import forest
from attesta.sources import tables

URLS = [
    (None, ""), ("", ""), ("example.com/a", "https:example.com/a"), ("other.org/b", "https:other.org/b"), ("//third.net/c", "https://third.net/c"), ("mailto:a@b", "https:a@b"), ("  HTTPS://www.X.org ", "https://x.org/"),
    ("http://x.org/p/?q=x+y", "https://x.org/p?q=x+y"), ("http://x.org/p?q=x%20y", "https://x.org/p?q=x+y"), ("http://x.org/?a-b=2&a=3", "https://x.org/?a=3&a-b=2"), ("http://x.org/?a=2&a=1&b&c=&=v", "https://x.org/?=v&a=1&a=2"),
    ("http://x.org/a?u%74m_x=1&k=%c3%a9*~", "https://x.org/a?k=%C3%A9%2A~"), ("http://x.org/?k=100%&z=%zz", "https://x.org/?k=100%25&z=%25zz"), ("http://x.org:8080/a//", "https://x.org:8080/a"), ("http://x.org?b=1#f?c=2", "https://x.org/?b=1"),
    ("ht\ntp://x.org/a", "https://x.org/a"), ("/rel/path", "https:///rel/path"), ("////x", "https:////x"), ("http:///y", "https:///y"), ("http://www.www.x.org", "https://www.x.org/"), ("http://x.org/a?x=a/b&y=1=2", "https://x.org/a?x=a%2Fb&y=1%3D2"),
    ("#frag", "https:///"), ("?a=1", "https:///?a=1"), ("http://x.org/?q=a;b", "https://x.org/?q=a%3Bb"), ("http://é.org/ü?ß=ö", "https://é.org/ü?%C3%9F=%C3%B6"),
]


def test_canonical_urls(spark):
    rows = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(URLS)], "i int, u string").select("i", T.canonical_url(F.col("u")).alias("c")).collect()
    assert {URLS[r["i"]][0]: r["c"] for r in rows} == dict(URLS)


def test_sources_without_scheme_stay_apart(spark):
    rows = [("a", "example.com/a", "one red barn on a hill"), ("b", "other.org/b", "the price of grain fell in March again"), ("c", "//third.net/c", "a quiet harbour town by the sea"), ("d", "HTTP://www.third.net/c/#x", "nothing that is like it"), ("e", None, "some text of its own"), ("f", "", "and another one here")]
    got = {r["source_id"]: r["cluster_id"] for r in cluster.partition(spark.createDataFrame(rows, "id string, url string, text string")).collect()}
    assert got["c"] == got["d"] and len(set(got.values())) == 5


@pytest.mark.parametrize(
    ("found", "expect"),
    [
        ([(True, False, "a", "x")], ("contradicts", "refuted", "x")), ([(False, True, "b", "x")], ("contradicts", "material_qualifier_omitted", "x")), ([(True, None, "c", "x")], ("entails", "no_contrary_evidence_found", None)),
        ([(True, None, None, None)], ("contradicts", "refuted", "")), ([(None, None, "A", "x")], ("entails", "no_contrary_evidence_found", None)), ([], ("neutral", "no_contrary_search", None)),
        ([(None, True, "", "p"), (True, None, "E", "q"), (True, True, "B", "r"), (None, True, "A", "s"), (True, None, "A", "t")], ("contradicts", "refuted", "p|r|s")),
    ],
)
def test_findings(spark, found, expect):
    df = spark.createDataFrame([("k", i, *f) for i, f in enumerate(found)], "claim string, _ord int, refutes boolean, qualifies boolean, quality_rating string, summary string")
    row = evaluate.findings_verdict(df, "claim", spark.createDataFrame([("k",)], "claim string")).first()
    assert (row["verdict"], row["reason"], row["summaries"]) == expect


def test_replay(spark):
    refs = spark.createDataFrame([(c, s) for c, s in ["a1", "a2", "b1", "c1", "d1", "a1", "x9"]], "claim_id string, source_id string")
    said = [("a", "1", 0, "verifier", "old", "h1"), ("a", "1", 1, None, "A", "h1"), ("a", "1", 2, "panel", "no", "no"), ("a", "2", 3, "verifier", "A", "stale"), ("b", "1", 4, "verifier", "B before", "h1"), ("c", "1", 5, "panel", "C", "h1"), ("x", "9", 6, "verifier", None, None)]
    verdicts = spark.createDataFrame(said, "claim_id string, source_id string, _ord int, producer string, claim_text_hash string, snapshot_hash string")
    claims = spark.createDataFrame([("a", 0, "A before"), ("a", 1, "A"), ("b", 2, "B"), ("c", 3, "C"), ("d", 4, "D")], "claim_id string, _ord int, claim_text_hash string")
    sources = spark.createDataFrame([("1", "h1"), ("2", "h2")], "source_id string, content_hash string")
    got = sorted(tuple(r) for r in evaluate.replay_plan(refs, verdicts, claims, sources).collect())
    want = [("a", "1", "frozen", None), ("a", "1", "frozen", None), ("a", "2", "tamper", "snapshot_changed"), ("b", "1", "requery", "claim_changed"), ("c", "1", "requery", "no_verdict"), ("d", "1", "requery", "no_verdict"), ("x", "9", "frozen", None)]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2]))


def walk(edges, labels):
    """Edges in order; those that join two components."""
    labels, out = dict(labels), []
    for o, a, b in sorted(edges):
        if labels[a] != labels[b]:
            out.append((o, a, b))
            old, new = max(labels[a], labels[b]), min(labels[a], labels[b])
            labels = {k: new if v == old else v for k, v in labels.items()}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_is_the_walks_own(spark, seed):
    r = random.Random(seed)
    labels = {i: i - i % (2 if i < 10 else 1) for i in range(40)}
    edges = {(r.randint(0, 3), *sorted(r.sample(range(40), 2))) for _ in range(60)} | {(0, i, i + 1) for i in range(20, 39)}
    got = forest(spark.createDataFrame(sorted(edges), "o int, a int, b int").repartition(3), spark.createDataFrame(list(labels.items()), "node int, comp int"), "o")
    assert sorted(tuple(x) for x in got.collect()) == walk(edges, labels)


def test_merges(spark):
    same, near = "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dogs"
    rows = [("b", same, None, "By Ann  Lee"), ("c", near, "AP", None), ("a", near, " ap ", "ann lee"), ("d", same, "", "ann lee"), ("e", "entirely different words here", None, None), ("f", "", "x", None), ("g", "", "x", "Ann Lee"), ("h", "...", None, ""), ("i", "...", None, None)]
    docs = spark.createDataFrame(rows, "id string, text string, wire string, byline string")
    own = docs.select(F.col("id").alias("source_id"), F.when(F.col("id").isin("e", "f"), "one").otherwise(F.col("id")).alias("cluster_id"))
    got = sorted((r["a"], r["b"]) for r in cluster.semantic_merges(own, docs, "id", "text").collect())
    assert got == [("a", "b"), ("a", "c"), ("a", "d")]
    got = sorted(tuple(r) for r in cluster.provenance_merges(own, docs, "id", F.col("wire"), F.col("byline")).collect())
    assert got == [("a", "b", "byline", "ann lee"), ("a", "c", "wire", "ap"), ("a", "d", "byline", "ann lee"), ("a", "g", "byline", "ann lee"), ("f", "g", "wire", "x")]


@pytest.mark.parametrize("crowd", [2048, 300, 5])
def test_near_bits_of_a_crowd(spark, crowd):
    r = random.Random(crowd)
    base = r.getrandbits(64)
    crowded = {base ^ (r.getrandbits(10) << 20) for _ in range(600)} | {base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
    patterns = sorted({x - (1 << 64) if x >> 63 else x for x in crowded | {r.getrandbits(64) for _ in range(150)}})
    rows = [("s", x) for x in patterns] + [("t", x) for x in patterns[::7]] + [("s", 0)]
    got = {tuple(x) for x in cluster.near_bits(spark.createDataFrame(rows, "scope string, bits bigint").repartition(3), crowd=crowd).collect()}
    near = lambda xs: {(a, b) for i, a in enumerate(xs) for b in xs[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == {("s", *p) for p in near(patterns)} | {("t", *p) for p in near(patterns[::7])} and len(got) > 3000


SECOND = {
    "type": "object", "required": ["name", "rows"],
    "properties": {"name": {"type": "string", "minLength": 2}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "rows": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string"}, "tag": {"enum": ["a", "b"]}}}}, "on": {"type": "boolean"}},
}


@pytest.mark.parametrize("which", ["second", "query"])
def test_schemas_read_from_files(spark, tmp_path, which):
    (tmp_path / "s.json").write_text(json.dumps(SECOND if which == "second" else runs.query_schema(), indent=1))
    cases = [
        ('{"name": "ab", "rows": [{"id": "x", "tag": "a"}]}', []), ("[]", ["(root): object"]), ("{", ["(root): object"]), (None, None), ("{}", ["name: required", "rows: required"]),
        ('{"name": "a", "rows": []}', ["name: length", "rows: items"]), ('{"name": 7, "rows": {}, "n": "x", "on": 1}', ["name: type", "n: type", "rows: type", "on: type", "name: length", "rows: items", "n: range", "n: range"]),
        ('{"name": "ab", "rows": [{"id": "x"}, {"tag": "z"}, 4], "n": 9}', ["rows[].id: required", "rows[]: type", "rows[].tag: value", "n: range"]), ('{"name": "ab", "rows": [{"id": null}, {"id": 3}], "n": 2.5}', ["rows[].id: required", "n: type", "rows[].id: type"]),
    ]
    if which == "query":
        cases = [("{}", [f"{p}: required" for p in ("task", "context", "questions", "constraints", "output")]), ("7", ["(root): object"])]
    faults = schema.compiled(schema.read_schema(spark, f"file://{tmp_path}/s.json"))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", faults(F.col("t")).alias("e")).collect()}
    for i, (text, want) in enumerate(cases):
        assert got[i] == (["(root): object"] if want is None else want), text


def test_filter_loses_nothing(spark, monkeypatch):
    for most in (filters.MOST, 1 << 12):
        monkeypatch.setattr(filters, "MOST", most)
        rows = spark.range(50000).selectExpr("cast(id as string) as g", "id as _other")
        asked = spark.range(0, 50000, 25).selectExpr("cast(id as string) as g")
        got = filters.passing(rows, "g", asked)
        assert got.columns == rows.columns
        left = {r["g"] for r in got.collect()}
        assert {str(i) for i in range(0, 50000, 25)} <= left and (most < 1 << 20 or len(left) < 8000)
    assert filters.passing(rows, "g", asked.limit(0)).count() == 0


def test_snapshots_by_relative_paths(spark, tmp_path):
    (tmp_path / "s/snaps").mkdir(parents=True)
    (tmp_path / "s/snaps/a.txt").write_text("one\r\ntwo")
    (tmp_path / "s/b.txt").write_text("b")
    (tmp_path / "far.txt").write_text("far")
    digest = lambda t: "sha256:" + hashlib.sha256(t.encode()).hexdigest()
    rows = [("a", "snaps/a.txt", digest("one\ntwo")), ("b", "./b.txt", "sha256:0"), ("c", f"{tmp_path}/far.txt", digest("far")), ("d", f"file://{tmp_path}/s/b.txt", ""), ("e", "snaps/none.txt", None), ("f", None, None), ("g", "", "x"), ("h", f"{tmp_path}/none.txt", None), ("i", "b.txt", None)]
    got = {r["id"]: (r["snapshot_text"], r["snapshot_error"]) for r in tables.load_snapshots(spark, f"file://{tmp_path}/s", spark.createDataFrame(rows, "id string, snapshot_path string, content_hash string")).collect()}
    assert got == {
        "a": ("one\r\ntwo", None), "b": (None, "snapshot hash mismatch"), "c": ("far", None), "d": ("b", None), "e": (None, "snapshot file missing: snaps/none.txt"), "f": (None, "no snapshot_path"), "g": (None, "no snapshot_path"),
        "h": (None, f"snapshot file missing: {tmp_path}/none.txt"), "i": ("b", None),
    }


def test_report_as_text(spark, tmp_path):
    columns = {n: 1 for _, t in gate.LINES for n in re.findall(r"\{(\w+)\}", t)} | {"verdict": "FAIL", "manifest_ok": False, "leak_rate": 0.125}
    found = spark.createDataFrame([tuple(float(v) if k.endswith("_rate") else v for k, v in columns.items())], list(columns))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    tables.write_lines(gate.report_text(found, {"dangling": ids("src_2", "src_1"), "a leak": ids("c9")}), f"file://{tmp_path}/r")
    text = next((tmp_path / "r").glob("part-*")).read_text().splitlines()
    assert text[0] == "verdict: FAIL, manifest false" and text[3] == "leaks: 12.5%, 1 of 1 unresolved and 1 refuted claims" and text[7:] == ["  a leak: c9", "  dangling: src_1", "  dangling: src_2"] and len(text) == 10


@pytest.mark.parametrize("crowd", [2048, 60])
def test_dense_sources_are_not_paired(spark, monkeypatch, crowd):
    r = random.Random(7)
    bits = [r.getrandbits(10) << 26 for _ in range(500)]  # each near some fifty others
    scopes = [r.choice(["s", "s", "s", "t", None]) for _ in bits]
    urls = [f"https://x.org/{r.randrange(800)}" for _ in bits]
    ids = [f"{n:05d}" for n in r.sample(range(99999), len(bits))]
    leads, want = [], {}
    for n, scope, url, x in sorted(zip(ids, scopes, urls, bits, strict=True)):
        meets = lambda m: m[1] == scope and (m[2] == url or (x and m[3] and (x ^ m[3]).bit_count() <= (3 if scope else 0)))  # noqa: B023, E731
        want[n] = next((m[0] for m in leads if meets(m)), n)
        if want[n] == n:
            leads.append((n, scope, url, x))
    number = {n: f"cl_{i:04d}" for i, n in enumerate(sorted(set(want.values())))}
    df = spark.createDataFrame(list(zip(ids, scopes, urls, map(str, bits), strict=True)), "id string, scope string, url string, text string")
    monkeypatch.setattr(cluster, "simhash", lambda s, i, t, *also: s.select(F.col(i).alias("node"), *also, F.col(t).cast("long").alias("bits")))
    monkeypatch.setattr(cluster, "CROWD", crowd)
    monkeypatch.setattr(cluster, "near_bits", None)  # a row for each pair of near patterns
    got = {x["source_id"]: x["cluster_id"] for x in cluster.partition(df, scope_col="scope").collect()}
    assert got == {n: number[m] for n, m in want.items()}
