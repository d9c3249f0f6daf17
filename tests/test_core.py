"""Operators of claim verification on hand-written rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import anchors, bindings, cluster, evaluate, passages, risk, runs, verdicts
from attesta.operators.graph import components, leaders_by_keys
from attesta.sources import tables


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("snapshot", "span", "expect"),
    [("Ｆｕｌｌ width", "Full width", True), ("a &amp; b", "a & b", True), ("“quoted” text", '"quoted" text', True), ("1990–1995", "1990-1995", True), ("wait…", "wait...", True), ("a  b\n c", "a b c", True), ("Case", "case", False), ("abc", "", False), ("a b c", "a c", False)],
)
def test_span_match(spark, snapshot, span, expect):
    row = anchors.with_anchors(spark.createDataFrame([("", span, snapshot)], "claim string, span string, snapshot string")).first()
    assert row["span_matched"] == expect
    if expect:
        whole = one(spark, T.normalize, snapshot)
        assert whole[row["char_start"] : row["char_end"]] == one(spark, T.normalize, span)


@pytest.mark.parametrize(
    ("claim", "span", "ok"),
    [("$4.2bn in sales", "sales of 4.2 billion", True), ("$4.2bn", "$4.2 million", False), ("8%", "8 units", False), ("$130.5 billion", "$130,497 million", True), ("$131.2 billion", "$130.5 billion", False), ("TLS 1.3", "the protocol", True), ("TLS 1.3", "TLS 1.2", False), ("in 2020", "in 2021", False), ("RFC 9114 says", "it says", True)],
)
def test_numeric(spark, claim, span, ok):
    row = spark.createDataFrame([(claim, span)], "c string, s string").select(anchors.quantities("c").alias("c"), anchors.quantities("s").alias("s")).select(anchors.numeric_ok(F.col("c"), F.col("s"))).first()
    assert row[0] == ok


def test_polarity_and_referents(spark):
    rows = [("It is prohibited", "It is not prohibited", False), ("It is prohibited", "It is prohibited now", True), ("abc", "xyz", True)]
    df = spark.createDataFrame(rows, "c string, s string, e boolean").select("e", anchors.polarity_ok(F.col("c"), F.col("s")).alias("ok"))
    assert all(r["e"] == r["ok"] for r in df.collect())
    got = spark.createDataFrame([("data center revenue", "total revenue")], "c string, s string").select(anchors.referent_flags(F.col("c"), F.col("s"))).first()[0]
    assert got == ["scope:data center:total"]


def test_risk(spark):
    rows = [("a", "Sales grew 8% in 2020"), ("b", "plain prose only"), ("c", "The EU banned X and required Y"), ("d", None)]
    got = {r["claim_id"]: r for r in risk.classify(spark.createDataFrame(rows, "claim_id string, text string")).collect()}
    assert got["a"]["computed_risk"] == "high" and got["b"]["computed_risk"] == "normal" and got["d"]["computed_risk"] == "normal"
    assert got["c__a1"]["atom_text"] == "The EU required Y" and not got["c"]["atomic"]


def test_parts_keep_digits_at_their_edges(spark):
    rows = [("a", "4880133118426010 And 101 euros and call +1 (872) 555-0271"), ("b", "0 and 1"), ("c", "5% ;  10 , and  7 euros ")]
    got = {r["claim_id"]: r for r in risk.classify(spark.createDataFrame(rows, "claim_id string, text string")).collect()}
    told = {k: [got[f"{k}__a{i}"]["atom_text"] for i in range(9) if f"{k}__a{i}" in got] for k in "abc"}
    assert told == {"a": ["4880133118426010", "101 euros", "call +1 (872) 555-0271"], "b": ["0", "1"], "c": ["5%", "10", "7 euros"]}


def test_risk_of_whole_claims_and_of_many_parts(spark):
    rows = [("a", "Sales grew 8% in 2020"), ("b", "plain prose only"), ("c", "The EU banned X and required Y"), ("d", None), ("e", "He said so and it was 5% and that")]
    claims = spark.createDataFrame(rows, "claim_id string, text string")
    whole = risk.classify_whole(claims)
    parents = risk.classify(claims).filter("atomized_from is null")
    assert whole.schema.names == parents.schema.names and sorted(whole.collect(), key=str) == sorted(parents.collect(), key=str)
    # The first verb is at the end: a search for it from each of the parts is quadratic.
    text = "the plain words of a part and " * 8000 + "they banned it and required 5%"
    long = spark.createDataFrame([("l", text)], "claim_id string, text string")
    start = time.monotonic()
    got = risk.classify(long).select("atomic", "needs_atomization").collect()
    assert [tuple(r) for r in got] == [(False, True)] and time.monotonic() - start < 20


def test_entities_without_a_semicolon(spark):
    text = "a &amp; b &amp &copy;&am &copy c &#65; &notit; &quot;"
    assert one(spark, T.normalize, text) == 'a & b & ©&am © c A ¬it; "'
    assert one(spark, lambda c: T.normalize(c, open_entities=False), text) == 'a & b &amp ©&am &copy c A &notit; "'


def test_fnv_and_graph(spark):
    assert spark.createDataFrame([("abc",)], "w string").select(cluster.fnv1a("w")).first()[0] == 16654208175385433931 - (1 << 64)
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node bigint")
    assert {tuple(r) for r in components(edges, nodes).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7)}
    # Each node's key is itself, so near keys are edges.
    got = leaders_by_keys(nodes, nodes.select("node", F.col("node").alias("key")), edges)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7)}


def test_decisions(spark):
    rows = [("v", "s1", "c1", "A", "entails", True, 1), ("v", "s2", "c2", "C", "entails", True, 2), ("r", "s1", "c1", "A", "contradicts", True, 3), ("r", "s2", "c2", "b", "entails", True, 4), ("r", "s3", "c3", "B", "contradicts", True, 5), ("i", "s1", "c1", "A", "entails", True, 4), ("i", "s2", "c1", "A", "entails", True, 5), ("u", "s1", "c1", "A", "entails", False, 6), ("u", "s2", "c2", "A", "entails", False, 7)]
    rows += [("k", "s1", "c1", "A", "entails", True, 1), ("k", "s2", "c2", "C", "contradicts", True, 2), ("k", "s3", "c3", None, "entails", True, 3)]
    shape = "claim_id string, source_id string, cluster_id string, grade string, label string, anchors_ok boolean, key_ord bigint"
    df = spark.createDataFrame(rows, shape)
    told = lambda d: {r["claim_id"]: (r["status"], r["reason"], r["independent_entails"], r["conflict"], r["proof_source_ids"], r["proof_grades"], r["refuted_by"]) for r in d.collect()}
    plain = {
        "v": ("verified", "ok", 2, False, ["s1", "s2"], ["A", "C"], None), "r": ("refuted", "ab_contradiction", 0, False, [], [], ["s1", "s3"]), "i": ("unresolved", "insufficient_independent_entails", 1, False, [], [], None),
        "u": ("unresolved", "insufficient_independent_entails", 0, False, [], [], None), "k": ("unresolved", "conflict", 0, True, [], [], None),
    }
    assert told(verdicts.decide(df)) == plain
    panel = spark.createDataFrame([("k", "entails"), ("r", "entails"), ("v", "neutral")], "claim_id string, panel_consensus string")
    got = told(verdicts.decide(df, panel))
    assert got["k"] == ("verified", "ok", 2, False, ["s1", "s3"], ["A", ""], None) and got["v"][:3] == ("unresolved", "panel_no_consensus", 2)
    assert got["r"] == ("unresolved", "insufficient_independent_entails", 1, False, [], [], None)
    claims = spark.createDataFrame([("v", None), ("x", True), ("y", False)], "claim_id string, skipped_budget boolean")
    more = {r["claim_id"]: (r["reason"], r["coverage_degraded"]) for r in verdicts.decide(df, None, claims).collect()}
    assert more == {"v": ("ok", False), "x": ("skipped_budget", True), "y": ("missing", False)}
    assert verdicts.decide(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="broken row"):
        verdicts.decide(df.withColumn("structural_error", F.when(F.col("claim_id") == "v", "broken row"))).collect()


def session(spark, **changes):
    """A run of four claims: verified, without a matching span, stopped by the panel, and low-risk."""
    t = {
        "sources": ([(f"s{i}", g, f"h{i}", i) for i, g in enumerate(["A", "B", "c", " a", ""])], "id string, quality_rating string, content_hash string, _ord bigint"),
        "claims": ([(c, "t" + c) for c in ("ver", "fab", "mine", "low")], "claim_id string, claim_text_hash string"),
        "risk": ([("ver", "high", True, None), ("fab", "high", True, None), ("mine", "high", True, None), ("low", "normal", True, None), ("ver__a0", "high", True, "ver")], "claim_id string, computed_risk string, atomic boolean, atomized_from string"),
        "verdicts": ([(f"v{i}", c, s, "verifier", "entails", "done", None, ok, "h" + s[1], None, "t" + c, i) for i, (c, s, ok) in enumerate([("ver", "s0", True), ("ver", "s1", True), ("fab", "s0", False), ("mine", "s0", True), ("mine", "s2", True)])], "verdict_id string, claim_id string, source_id string, producer string, label string, span_state string, fail_reason string, anchors_ok boolean, snapshot_hash string, source_grade string, claim_text_hash string, _ord bigint"),
        "clusters": ([("s0", "k0"), ("s1", "k1")], "source_id string, cluster_id string"),
        "panel": ([("ver", "entails"), ("mine", "no_consensus")], "claim_id string, panel_consensus string"),
    }
    return verdicts.validate(*[spark.createDataFrame(changes.get(k, rows), shape) for k, (rows, shape) in t.items()])


def test_validate(spark):
    run = session(spark)
    got = {r["claim_id"]: (r["status"], r["reason"], r["high_risk"]) for r in run["decided"].collect()}
    assert got == {"ver": ("verified", "ok", True), "fab": ("unresolved", "insufficient_independent_entails", True), "mine": ("unresolved", "panel_no_consensus", True), "low": ("cite_write", "non_high_risk", False)}
    assert run["errors"].count() == 0 and tuple(run["outcome"].first()) == (0, 1, 0)
    # Without votes there is no panel, and the claim it stopped holds.
    assert session(spark, panel=[])["outcome"].first()["verified"] == 2
    assert session(spark, verdicts=[])["outcome"].first()["exit"] == 1
    bad = session(spark, sources=[("s0", "F", "h0", 0), ("s0", "A", "h0", 1), (None, None, None, 2)], risk=[("gone", "high", True, None), ("ver", "high", False, None)])
    assert sorted(r["error"] for r in bad["errors"].collect()) == ["bad grade", "duplicate id", "missing id", "no decision", "unknown source", "unknown source"]
    assert bad["outcome"].first()["exit"] == 2 and {r["claim_id"]: r["reason"] for r in bad["decided"].collect()}["ver"] == "needs_atomization"


def test_holding(spark):
    docs = spark.createDataFrame([(1, 'say "a b" now'), (2, "xaby"), (3, None), (4, "ｆｕｌｌ &amp; wide"), (5, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, ""), (4, "full & wide"), (5, None), (6, "a b")], "item_id bigint, text string")
    for size in (passages.BLOCK_CHARS, 2):
        pairs = lambda form: sorted((r["item_id"], r["doc_id"]) for r in passages.holding(docs, items, form, size).collect())  # noqa: B023, E731
        assert pairs(lambda c: c) == [(1, 1), (2, 2), (6, 1)]
        assert pairs(T.normalize) == [(1, 1), (2, 2), (4, 4), (6, 1)]
    assert passages.holding(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "found"), [("7" + " " * 30 + "percent", [("pct", 7.0)]), ("7" + " " * 16 + "thousandfold", []), ("5 hhz", []), ("6 ghz", [("mag", 6.0)]), ("version" + " " * 40 + "12", []), ("$" + " " * 40 + "9", [("mag", 9.0)]), ("2,026, and 2026", [("year", 2026.0)]), ("in 2026", [("year", 2026.0)]), ("3 mm", [("mag", 3e6)])])
def test_quantities(text, found):
    assert anchors.read_quantities(text) == found


def test_number_sets(spark):
    assert anchors.number_set("RFC 9114, version 1, 12 or $4 and 1.3 in 2020, x5") == ["9114", "1", "12", "4", "1.3", "2020", "5"]
    assert anchors.number_set("RFC 9114, version 1, 12 or $4 and 1.3 in 2020, x5", True) == ["12", "4", "1.3", "2020"]
    assert spark.createDataFrame([("3 cats", ), (None,)], "t string").select(anchors.numbers("t", True)).collect()[1][0] == []


def test_fetch_class(spark):
    long = "words of the page " * 80
    rows = [(long, "success"), ("short", "captcha"), (f"<p>Login</p>{long}", "login"), (f"{long} 404", "error"), ('<html><head><title>t</title></head><div id="root"></div>' + " " * 300, "empty"), (f"<noscript>x</noscript>{long}", "success"), ("words " * 60, "partial"), (f"{long} robot", "captcha"), (None, "captcha")]
    df = spark.createDataFrame(rows, "t string, k string")
    assert all(r["k"] == r["got"] for r in df.select("k", passages.fetch_class(F.col("t")).alias("got")).collect())
    assert df.limit(1).select(passages.fetch_class(F.col("t"), ["zebra"])).first()[0] == "partial"
    assert df.limit(1).select(passages.fetch_class(F.col("t"), None, F.lit(503))).first()[0] == "error"


def test_kappa_and_url(spark):
    got = evaluate.kappa(spark.createDataFrame([(1, 1), (0, 0), (1, 0), (1, 1)], "x int, y int")).first()
    assert got["kappa"] == 0.5
    assert one(spark, T.canonical_url, "HTTP://www.Example.com/A/?utm_source=x&b=2&a=1#f") == "https://example.com/a?a=1&b=2"


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "a1"}\n\nnot json\n{"id": "a2"}\n')
    (tmp_path / "b.jsonl").write_text("".join(f'{{"id": "b{i}", "pad": "{"x" * 300}"}}\n' for i in range(40)))
    shape = spark.createDataFrame([], "id string").schema
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several splits of a file, and files packed by size
        good, bad = tables.read_jsonl(spark, f"file://{tmp_path}/*.jsonl", shape)
        assert [r["id"] for r in good.orderBy("_ord").collect()] == ["a1", "a2", *[f"b{i}" for i in range(40)]]
        assert [(r["line"], r["raw"]) for r in bad.collect()] == [(3, "not json")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tables.read_jsonl(spark, f"file://{tmp_path}/*.jsonl", shape, "lenient")[1].count() == 0
    with pytest.raises(Exception):
        tables.read_jsonl(spark, f"file://{tmp_path}/a.jsonl", shape, "raising")[0].collect()
    assert tables.read_jsonl(spark, f"file://{tmp_path}/none.jsonl", shape, missing="none")[0].count() == 0


def test_documents_and_bodies(spark, tmp_path):
    shape = spark.createDataFrame([], "id string, n int").schema
    (tmp_path / "d.json").write_text('[{"id": "x", "n": 1},\n {"id": "y"}]')
    (tmp_path / "bad.json").write_text("{oops")
    rows = lambda p: sorted(map(tuple, tables.read_document(spark, f"file://{tmp_path}/{p}", shape, [("z", 9)]).collect()))
    assert rows("d.json") == [("x", 1), ("y", None)] and rows("bad.json") == rows("none.json") == [("z", 9)]
    (tmp_path / "out/b").mkdir(parents=True)
    for p, t in (("out/b/1.md", "second"), ("out/a.md", "first"), ("out/c.txt", "no")):
        (tmp_path / p).write_text(t)
    assert tables.read_body(spark, f"file://{tmp_path}/out").first()["text"] == "first\nsecond"
    for n, label in (("ann", "entails"), ("bob", "neutral")):
        (tmp_path / f"labeler_{n}.jsonl").write_text(f'{{"unit_id": "u", "label": "x"}}\n{{"unit_id": "u", "label": "{label}"}}\n')
    got = tables.read_labels(spark, f"file://{tmp_path}/labeler_*.jsonl", spark.createDataFrame([], "unit_id string, label string").schema)
    assert {(r["labeler"], r["label"]) for r in got.collect()} == {("ann", "entails"), ("bob", "neutral")}
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    for _ in range(2):
        tables.write_jsonl(df, f"file://{tmp_path}/w.jsonl")
        assert spark.read.json(f"file://{tmp_path}/w.jsonl").count() == 1
    paths = {"d": f"file://{tmp_path}/d.json", "no": f"file://{tmp_path}/nothing"}
    frozen = tables.freeze_bench(spark, paths, "now")
    assert frozen["files"]["no"] is None and tables.bench_drift(spark, frozen, paths) == []
    (tmp_path / "d.json").write_text("[]")
    assert tables.bench_drift(spark, frozen | {"frozen_at": "then"}, paths) == ["signature", "d"]


def test_freeze(spark, tmp_path):
    shape = "id string, text string, content_hash string, url string, _ord bigint"
    path = f"file://{tmp_path}/snaps"
    rows = [("a", "one\r\ntwo", None, "u", 1), ("a", "again", None, "u", 2), (None, "x", None, "u", 3), ("b", None, None, "u", 4), ("c", "", None, "u", 5)]
    out, errors = tables.freeze_session(spark.createDataFrame(rows, shape), path)
    assert sorted((r["id"] or "", r["error"]) for r in errors.collect()) == [("", "missing id"), ("a", "duplicate id"), ("b", "no text")]
    done = {r["id"]: r for r in out.collect()}
    assert set(done) == {"a", "c"} and {r["id"]: r["snapshot_text"] for r in tables.read_snapshots(spark, path).collect()} == {"a": "one\ntwo", "c": ""}
    again = [("a", None, done["a"]["content_hash"], "u", 1), ("c", "new", done["c"]["content_hash"] + "0", "u", 2)]
    out, errors = tables.freeze_session(spark.createDataFrame(again, shape), path)
    assert errors.count() == 0 and out.count() == 2
    snaps = tables.read_snapshots(spark, path)
    assert {r["id"]: r["snapshot_text"] for r in snaps.collect()} == {"a": "one\ntwo", "c": "new"} and tables.snapshot_errors(out, snaps).count() == 0
    src = spark.createDataFrame([("i", "", "r", "s"), ("r", None, "r", "s"), ("s", None, None, "s"), ("m", None, "gone", "s"), ("n", None, None, "")], "id string, text string, raw_path string, snapshot_path string")
    files = lambda n, t: spark.createDataFrame([(n, t)], "path string, text string")
    got = {r["id"]: (r["found_text"], r["text_error"]) for r in tables.resolve_text(src, files("r", "raw"), files("s", "snap")).collect()}
    assert got == {"i": ("", None), "r": ("raw", None), "s": ("snap", None), "m": (None, "raw_path points at missing file: gone"), "n": (None, "no text and no path")}


def test_commit(spark, tmp_path):
    df = spark.range(100)
    assert tables.table_hash(df) == tables.table_hash(df.repartition(3)) != tables.table_hash(spark.range(101))
    base = f"file://{tmp_path}/session"
    m = tables.commit_run(spark, base, {"t": df}, {"code": "1"})
    assert tables.read_current(spark, base)[0]["run_id"] == m["run_id"] and tables.publishable(m)
    assert not tables.verified(json.loads(json.dumps(m)) | {"code": "2"})
    stamp = (tmp_path / f"session/runs/{m['run_id']}/manifest.json").stat().st_mtime_ns
    assert tables.commit_run(spark, base, {"t": df}, {"code": "1"})["run_id"] == m["run_id"]
    assert (tmp_path / f"session/runs/{m['run_id']}/manifest.json").stat().st_mtime_ns == stamp
    n = tables.commit_run(spark, base, {"t": spark.range(5)}, {"code": "1"})
    assert tables.read_current(spark, base)[0]["run_id"] == n["run_id"] and sorted(p.name for p in (tmp_path / "session/runs").iterdir() if not p.name.startswith(".")) == sorted([m["run_id"], n["run_id"]])
    tables.assert_publishable(spark, base, n["run_id"])
    for run in (m["run_id"], "run_none"):
        with pytest.raises(ValueError):
            tables.assert_publishable(spark, base, run)
    assert tables.manifest_of(spark, base, m["run_id"])["superseded_by"] == n["run_id"]
    spark.range(6).write.mode("overwrite").parquet(f"{base}/runs/{n['run_id']}/t")
    with pytest.raises(ValueError):
        tables.read_current(spark, base)


def test_budget_lock_and_hashes(spark):
    rows = [("a", 1, 3, False), ("a", 2, 3, False), ("a", 3, 2, True), ("a", 4, 3, False), ("a", 5, 99, True)]
    got = runs.budget(spark.createDataFrame(rows, "k string, o bigint, n bigint, back boolean"), 5, "k", "o", "n", "back").orderBy("o").collect()
    assert [(r["granted"], r["remaining"]) for r in got] == [(True, 2), (False, 2), (True, 4), (True, 1), (True, 5)]
    one_row = spark.range(1).select(runs.holder_may(F.lit(True), F.lit(True)), runs.holder_may(F.lit(True), F.lit(False)), runs.is_stale(F.lit(True), F.lit(91.0)), runs.is_stale(F.lit(False), F.lit(91.0))).first()
    assert tuple(one_row) == (True, False, True, False)
    assert risk.rules_hash() == risk.rules_hash() and risk.rules_hash().startswith("sha256:")
    assert one(spark, T.claim_text_hash, "a\r\n") != one(spark, T.content_hash, "a\r\n")
    raw = spark.createDataFrame([("a",), ("b",)], "claim_id string")
    levels = spark.createDataFrame([("a", "high"), ("b", "normal")], "claim_id string, computed_risk string")
    assert [r["claim_id"] for r in bindings.of_high_risk(raw, levels).collect()] == ["a"]


def test_oracles_have_queries():
    from attesta.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_texts_of_a_batch_are_python_strings_in_turn():
    """All texts of a batch, and all their normal forms, were Python strings at once."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([f"{i} ﬁ &amp; " + "é" * 20000 for i in range(600)] + [None, ""], pa.string())
    for form in (T._compat, T._compat_closed):
        tracemalloc.start()
        got = form(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 << 20
        assert len(got) == 602 and got[599].as_py() == "599 fi & " + "é" * 20000 and got[600].as_py() is None and got[601].as_py() == ""
    assert len(T._compat(texts[:0])) == 0
