"""Report gate, bindings, probes, agreement and session bookkeeping on hand-written rows."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import bindings, cluster, gate, graph, probes, runs
from attesta.sources.scratch import Scratch

REF = "array<struct<source_id:string,grade:string,cluster:string,verifier:string,span:string,snapshot:string>>"


def refs(*spans, grades="AB", clusters=("c1", "c2"), snapshots=None):
    return [(f"s{i}", grades[i], clusters[i], "entails", s, (snapshots or [f"It says: {t}." for t in spans])[i]) for i, s in enumerate(spans)]


#: claim_id, claim, panel, refs, demonstrates, the cause that must block it.
WRONG = [
    ("fabricated", "The law bans every drone.", "entails", refs("bans every drone", "all drones are banned", snapshots=["The law limits drones.", "It limits drones."]), None, "anchor:span"),
    ("number", "The plant made 900 cars.", "entails", refs("made 700 cars", "700 cars"), None, "anchor:numeric"),
    ("near_miss", "A fine of $131.2 million was set.", "entails", refs("a fine of $130.5 million", "fined $130.5 million"), None, "anchor:numeric"),
    ("scale", "A fine of $6 billion was set.", "entails", refs("a fine of $6 million", "fined $6 million"), None, "anchor:numeric"),
    ("percent", "Rents rose 9% in 2023.", "entails", refs("rents rose 4% in 2023", "a 4% rise in 2023"), None, "anchor:numeric"),
    ("polarity", "A permit is required for fishing.", "entails", refs("a permit is not required for fishing", "no permit is not required for fishing"), None, "anchor:polarity"),
    ("version", "The server needs SSL 3.1 now.", "entails", refs("the server needs SSL 3.0", "needs SSL 3.0"), None, "anchor:numeric"),
    ("quote", "Smoking is prohibited in parks.", "contradicts", refs("smoking is prohibited in parks", "smoking in parks is prohibited"), None, "panel:contradicts"),
    ("scope", "Data center sales were $5 billion.", "contradicts", refs("total sales were $5 billion", "total sales of $5 billion"), None, "panel:contradicts"),
    ("risk_ratio", "The pill halves heart attacks, a relative risk cut of 50%.", "contradicts", refs("an absolute risk cut of 50%", "the absolute risk fell by 50%"), None, "panel:contradicts"),
    ("no_panel", "Data center sales were $5 billion.", None, refs("total sales were $5 billion", "total sales of $5 billion"), "panel_necessity", None),
    ("quote_no_panel", "Smoking is prohibited in parks.", None, refs("smoking is prohibited in parks", "smoking in parks is prohibited"), "panel_necessity", None),
]
TRUE = [
    ("plain", "Smoking is prohibited in parks.", "entails", refs("smoking is prohibited in parks", "prohibited in parks"), True, None),
    ("rounded", "Sales were $130.5 billion.", "entails", refs("sales of $130,497 million", "$130.5 billion in sales"), True, None),
    ("tolerance", "Exports reached $400.1 million.", "entails", refs("exports of $400.1 million", "$400,000 thousand of exports"), True, None),
    ("year", "The dam opened in 1994.", "entails", refs("the dam opened in 1994", "opened in 1994"), True, None),
    ("percent", "Rents rose 9% in 2023.", "entails", refs("rents rose 9 percent in 2023", "in 2023 rents rose by 9%"), True, None),
    ("label", "Rule 12 bars open fires.", "entails", refs("the rule bars open fires", "bars open fires"), True, None),
    ("code", "RFC 1149 allows pigeons.", "entails", refs("this memo allows pigeons", "allows pigeons"), True, None),
    ("attached", "HTTP/2 requires framing.", "entails", refs("the protocol requires framing", "requires framing"), True, None),
    ("negative", "The permit must not be sold.", "entails", refs("the permit must not be sold", "permits must not be sold"), True, None),
    ("quotes", "The board ruled it was unfair.", "entails", refs("the board ruled it was “unfair”", "ruled: “unfair”"), True, None),
    ("scaled", "The city has 2.5 million people.", "entails", refs("2.5 million people live in the city", "2,500 thousand people live there"), True, None),
    ("third_source", "Smoking is prohibited.", "entails", refs("smoking is prohibited", "is prohibited", grades="CA"), True, None),
    ("version_left_out", "SSL 3.1 drops old ciphers.", "entails", refs("the protocol drops old ciphers", "drops old ciphers"), True, None),
    ("one_source", "Smoking is prohibited in parks.", "entails", refs("smoking is prohibited in parks"), False, "independence:lt2_clusters"),
    ("same_cluster", "Smoking is prohibited.", "entails", refs("smoking is prohibited", "smoking is prohibited", clusters=("c1", "c1")), False, "independence:lt2_clusters"),
    ("paraphrase", "Smoking is prohibited.", "entails", refs("smokers are banned", "smoking is prohibited", snapshots=["No smokers.", "smoking is prohibited"]), False, "anchor:span"),
    ("split_panel", "Smoking is prohibited.", "no_consensus", refs("smoking is prohibited", "is prohibited"), False, "panel:no_consensus"),
    ("far_negation", "Fishing without a permit is prohibited here.", "entails", refs("no person may fish; a permit is needed, not prohibited", "not prohibited with a permit"), False, "anchor:polarity"),
    ("grades", "Smoking is prohibited.", "entails", refs("smoking is prohibited", "is prohibited", grades="CC"), False, "independence:no_ab_grade"),
]


def probe(spark, rows, extra):
    df = spark.createDataFrame([r[:5] for r in rows], f"claim_id string, claim string, panel string, refs {REF}, {extra}")
    return df, probes.causes(probes.anchored_refs(df), panel_first="demonstrates" in extra)


def test_wrong_claims_are_blocked(spark):
    df, found = probe(spark, WRONG, "demonstrates string")
    got = {r["claim_id"]: r for r in found.collect()}
    assert {k: r["cause"] for k, r in got.items()} == {r[0]: r[5] for r in WRONG}
    assert got["no_panel"]["status"] == "verified" and got["scope"]["referent"] and not got["quote"]["referent"]
    rates = {r["group"]: (r["n"], r["leaked"], r["leak_rate"]) for r in probes.leak_summary(found, df).collect()}
    assert rates == {"headline": (10, 0, 0.0), "demo": (2, 2, 1.0)}
    assert [r["cause"] for r in probes.ranked_causes(found).collect()] == ["anchor:numeric", "panel:contradicts", "anchor:polarity", "anchor:span"]


def test_true_claims_pass(spark):
    df, found = probe(spark, TRUE, "headline boolean")
    assert {r["claim_id"]: r["cause"] for r in found.collect()} == {r[0]: r[5] for r in TRUE}
    assert {r["headline"]: (r["verified"], r["n"]) for r in probes.recall_summary(found, df).collect()} == {True: (13, 13), False: (0, 6)}


def test_independence(spark):
    a, b = "The mill burned down on the first night of the harvest feast.", "Seven boats crossed the strait carrying letters and salted fish."
    body = "Officials said on Monday that the bridge will stay closed until the inspection of every cable is done."
    rows = [
        ("tracking", "collapse", [("1", "A", "https://x.com/s?id=1&utm_source=a", a, None, None), ("2", "A", "https://www.x.com/s/?utm_source=b&id=1", b, None, None)], True),
        ("copy", "collapse", [("1", "A", "https://x.com/1", body, None, None), ("2", "B", "https://y.com/1", body, None, None), ("3", "C", "https://z.com/1", body, None, None)], True),
        ("wire", "collapse", [("1", "B", "https://x.com/2", a, "Reuters", None), ("2", "B", "https://y.com/2", b, " reuters ", None)], True),
        ("author", "collapse", [("1", "B", "https://x.com/3", a, None, "By Ann Lee"), ("2", "B", "https://y.com/3", b, None, "ann  lee")], True),
        ("reworded_wire", "collapse", [("1", "B", "https://x.com/6", a, "AP", None), ("2", "C", "https://y.com/6", b, "AP", None)], True),
        ("text_and_comment", "separate", [("1", "A", "https://x.com/7", body, None, None), ("2", "B", "https://y.com/7", b, None, "Bo Ek")], True),
        ("apart", "separate", [("1", "A", "https://x.com/4", a, "AP", "x"), ("2", "B", "https://y.com/4", b, "Reuters", "y")], True),
        ("missed", "collapse", [("1", "A", "https://x.com/5", a, None, None), ("2", "A", "https://y.com/5", b, None, None)], False),
        ("empty", "separate", [("1", "A", None, None, None, None), ("2", "C", "", "", None, None)], True),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "scenario_id string, kind string, sources array<struct<id:string,grade:string,url:string,text:string,wire:string,byline:string>>")
    found = probes.independence(df).cache()
    assert {r["scenario_id"]: r["ok"] for r in found.collect()} == {r[0]: r[3] for r in rows}
    assert {r["scenario_id"]: r["would_verify"] for r in found.collect()}["apart"]
    assert {r["kind"]: (r["n"], r["failed"], r["manufactured"]) for r in probes.independence_summary(found).collect()} == {"collapse": (6, 1, 1), "separate": (3, 0, 0)}
    # Without the demonstration and the blank rows: as published.
    told = probes.independence_summary(found.filter("scenario_id not in ('missed', 'empty')")).collect()
    assert {r["kind"]: (r["n"], r["failed"]) for r in told} == {"collapse": (5, 0), "separate": (2, 0)}

    def all_alike(sources, id_col, text_col, least, scope_col):
        one = sources.groupBy(scope_col).agg(F.min(id_col).alias("a"))
        return sources.join(one, scope_col).select("a", F.col(id_col).alias("b"))

    assert {r["scenario_id"]: r["n_clusters"] for r in probes.independence(df, all_alike).collect()}["missed"] == 1


def test_independence_broadcasts_no_table_of_its_sources(spark, monkeypatch):
    rows = [(f"s{i}", "collapse", [(str(j), "A", f"https://x.com/{i}/{j}", f"a plain text of number {i} or {i * j}", "AP" if i % 2 else None, None) for j in range(4)]) for i in range(8)]
    df = spark.createDataFrame(rows, "scenario_id string, kind string, sources array<struct<id:string,grade:string,url:string,text:string,wire:string,byline:string>>")
    plans, save, keys = [], Scratch.save, ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")

    def plan(df):
        q = df._jdf.queryExecution()
        plans.append((q.executedPlan().toString().count("BroadcastHashJoin"), q.optimizedPlan().toString().count("strategy=broadcast")))

    monkeypatch.setattr(Scratch, "save", lambda self, df: (plan(df), save(self, df))[1])
    before = [spark.conf.get(k, None) for k in keys]
    found = probes.independence(df)
    plan(found)
    # Only the masks and the parts' offsets, which are marked, are sent to all: one row for each mask or partition.
    assert all(sent <= marked for sent, marked in plans) and [spark.conf.get(k, None) for k in keys] == before
    assert found.count() == 8 and found.filter("n_sources = 4").count() == 8


def test_leaders_by_keys_in_turn(spark):
    rng = random.Random(3)
    for _ in range(3):
        held = {n: {rng.randrange(12) for _ in range(rng.randrange(3))} for n in range(40)}
        near = {(rng.randrange(12), rng.randrange(12)) for _ in range(5)}
        touch = lambda x, y: any(p == q or (p, q) in near or (q, p) in near for p in held[x] for q in held[y])
        want = {}
        for n in range(40):
            want[n] = next((m for m in range(n) if want[m] == m and touch(m, n)), n)
        own = spark.createDataFrame([(n, f"k{k}") for n, ks in held.items() for k in ks], "node int, key string")
        pairs = spark.createDataFrame([(f"k{a}", f"k{b}") for a, b in near], "a string, b string")
        got = graph.leaders_by_keys(spark.range(40).selectExpr("cast(id as int) node"), own, pairs)
        assert {r["node"]: r["leader"] for r in got.collect()} == want


def test_near_bits_and_cosine_are_whole(spark):
    rng = random.Random(5)
    bits = [rng.getrandbits(64) for _ in range(30)]
    bits += [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 6))) for b in bits]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    got = {(r["a"], r["b"]) for r in cluster.near_bits(spark.createDataFrame([("", b) for b in signed], "scope string, bits bigint")).collect()}
    assert got == {(min(p), max(p)) for p in itertools.combinations(set(signed), 2) if bin((p[0] ^ p[1]) & (1 << 64) - 1).count("1") <= 3}
    words = [f"word{i}" for i in range(30)]
    texts = [(i, " ".join(rng.sample(words, 12))) for i in range(40)]
    feats = cluster.lexical_features(spark.createDataFrame(texts, "id int, text string"), "id", "text").cache()
    vec = {}
    for r in feats.collect():
        vec.setdefault(r["node"], {})[r["bucket"]] = r["weight"]
    dot = lambda x, y: sum(w * vec[y].get(k, 0) for k, w in vec[x].items())
    want = {p: dot(*p) for p in itertools.combinations(range(40), 2) if dot(*p) >= 0.9}
    found = {(r["a"], r["b"]): r["cosine"] for r in cluster.cosine_pairs(feats, 0.9).collect()}
    assert want and found.keys() == want.keys() and all(math.isclose(found[k], want[k]) for k in want)


def test_close_pairs_are_whole(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(30)] + ["ab", "é", "한국어", "a"]
    rows = [(i, f"s{i % 3 // 2}", " ".join(rng.sample(words, 12))) for i in range(60)] + [(60, "s0", ""), (61, "s0", None), (62, None, "word1"), (63, None, "word1")]
    docs = spark.createDataFrame(rows, "id bigint, scope string, text string").repartition(3)
    feats = cluster.lexical_features(docs, "id", "text").join(docs.select(F.col("id").alias("node"), "scope"), "node")
    want = {(r["a"], r["b"]): r["cosine"] for r in cluster.cosine_pairs(feats, 0.8).collect()}
    vectors = cluster.lexical_counts(docs, "id", "text", "scope")
    assert vectors.count() == 62
    for block in (256, 5):  # blocks of a scope meet in pairs
        found = [(r["a"], r["b"], r["cosine"]) for r in cluster.close_pairs(vectors, 0.8, block).collect()]
        assert len(found) == len(want) > 0 and all(math.isclose(want[min(a, b), max(a, b)], c) for a, b, c in found)


def test_similarity_in_scopes_is_shuffled_by_text_not_by_word(spark, monkeypatch):
    monkeypatch.setattr(cluster, "lexical_features", None)  # a row for each word and triple
    docs = spark.createDataFrame([(i, i // 4, f"some common words of text {i % 2}") for i in range(16)], "id bigint, scope bigint, text string")
    edges = {(r["a"], r["b"]) for r in cluster.semantic_edges(docs, "id", "text", scope_col="scope").collect()}
    assert {(4 * i, 4 * i + 1) for i in range(4)} <= {(min(e), max(e)) for e in edges}


def test_labels_are_dense_and_ordered(spark):
    comp = spark.createDataFrame([(f"n{i:03}", f"n{i - i % 3:03}") for i in range(90)], "node string, comp string").repartition(7)
    got = {r["source_id"]: r["cluster_id"] for r in cluster.labels(comp, "comp").collect()}
    assert got == {f"n{i:03}": f"cl_{i // 3:04d}" for i in range(90)}
    assert cluster.labels(comp.limit(0), "comp").count() == 0


def test_backstop_and_present(spark):
    said = spark.createDataFrame([("Sales grew 8%", "a"), ("Sales grew 8%", "b"), ("Sales grew 8%", None), ("Sales grew", "b"), (None, "b")], "text string, claim_id string")
    got = gate.backstop(said, spark.createDataFrame([("a",), (None,)], "claim_id string"))
    assert {(r["claim_id"], r["reason"]) for r in got.collect()} == {("b", "non-verified claim b"), (None, "no claim")}
    claims = spark.createDataFrame([("c1", "the red barn"), ("c2", "abcde"), ("c3", "shared words only"), ("c44", None)], "claim_id string, text string")
    body = spark.createDataFrame([("see c441. A red barn stood; shared words",), (None,)], "text string")
    shared = spark.createDataFrame([("shared words",)], "text string")
    assert {r[0] for r in gate.present(claims, body, shared).collect()} == {"c1", "c44"}
    assert {r[0] for r in gate.present(claims, body).collect()} == {"c1", "c3", "c44"}
    assert gate.present(claims.limit(0), body).count() == 0


def test_report_of_nothing_passes(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    decided = "claim_id string, status string, high_risk boolean, proof_source_ids array<string>"
    verdicts = "claim_id string, source_id string, label string, anchors_ok boolean, span_matched boolean, span_state string, fail_reason string"
    args = [empty("id string"), empty("claim_id string, text string"), empty("claim_id string, computed_risk string"), empty(verdicts), empty(decided), empty("text string")]
    got = gate.report(*args).first()
    assert got["verdict"] == "PASS" and got["citation_resolution_rate"] == got["span_match_rate"] == got["verified_coverage_rate"] == 1.0 and got["leak_rate"] == 0.0
    assert gate.report(*args, manifest_ok=False).first()["verdict"] == "FAIL"
    args[2] = spark.createDataFrame([("x", "high")], "claim_id string, computed_risk string")
    assert gate.report(*args).first()["verdict"] == "FAIL"


def test_build_verdicts(spark):
    raw = spark.createDataFrame([("c", "s", "entails", "sold 9 cars", "done", "m", "p"), ("c", "s", "perhaps", "sold 9 cars", "done", "m", "p"), ("c", "s", "entails", None, "failed", None, None), ("c", "gone", "entails", "", "done", "m", "p"), ("gone", "s", "entails", "", "done", "m", "p")], "claim_id string, source_id string, label string, evidence_span string, span_state string, model_id string, prompt_hash string")
    claims = spark.createDataFrame([("c", "They sold 9 cars")], "claim_id string, text string")
    sources = spark.createDataFrame([("s", " a", "h", "Last year they sold 9 cars.")], "source_id string, quality_rating string, content_hash string, snapshot string")
    got = {(r["label"], r["span_state"]): r for r in bindings.build_verdicts(raw, claims, sources).collect()}
    good, bad, failed = got["entails", "done"], got[None, "failed"], got["entails", "failed"]
    assert good["anchors_ok"] and good["char_start"] == 15 and good["source_grade"] == "A" and good["verdict_id"].startswith("v_")
    assert bad["fail_reason"] == "malformed_label" and not bad["anchors_ok"] and bad["polarity_ok"] and bad["char_start"] == -1
    assert failed["fail_reason"] is None and not failed["span_matched"]
    assert {(r["claim_id"], r["source_id"]) for r in bindings.unknown_pairs(raw, claims, sources).collect()} == {("c", "gone"), ("gone", "s")}


@pytest.mark.parametrize(("grade", "flags", "to"), [("A", [], "A"), ("A", ["no_date"], "C"), ("b", ["no_date", "broken_citations"], "E"), ("D", ["no_date"], "E"), ("A", ["no_author"], "E"), ("Z", [], None), (None, ["no_author"], None)])
def test_reduced_grade(spark, grade, flags, to):
    row = spark.createDataFrame([(grade, flags)], "g string, f array<string>").select(bindings.reduced_grade(F.col("g"), F.col("f")).alias("r"), bindings.good_enough(F.col("g"), F.lit("definitive_claim")).alias("ok")).first()
    assert row["r"] == to and row["ok"] == (grade in ("A", "b"))


def test_query_errors(spark):
    good = {
        "task": {"title": "A title that fits", "objective": "o" * 20, "type": "analytical"}, "context": {"background": "b" * 50, "audience": "general", "use_case": "u" * 20}, "questions": {"primary": "q" * 20, "secondary": ["a", "b"]},
        "constraints": {"timeframe": {"start": "2020", "end": "present"}, "geography": {"scope": "global"}, "sources": {"required_types": ["news"], "min_quality": "B"}}, "output": {"format": "policy_brief", "length": {"min_words": 500, "max_words": 50000}, "structure": {}},
    }

    def but(**changes):
        doc = json.loads(json.dumps(good))
        for path, value in changes.items():
            *head, last = path.split("__")
            at = doc
            for k in head:
                at = at[k]
            if value is None:
                del at[last]
            else:
                at[last] = value
        return json.dumps(doc)

    cases = [
        (but(), []), (but(context=None), ["context: required"]), (but(task__type="odd"), ["task.type: value"]), (but(task__title=7), ["task.title: length"]), (but(questions__secondary=["a"]), ["questions.secondary: items"]),
        (but(questions__secondary="ab"), ["questions.secondary: items"]), (but(constraints__sources__required_types=["news", "x"]), ["constraints.sources.required_types: value"]), (but(output__length__min_words=10), ["output.length.min_words: range"]),
        (but(output__length__max_words=50001), ["output.length.max_words: range"]), (but(keywords=["a"]), ["keywords: items"]), (but(constraints__timeframe__end=None), ["constraints.timeframe.end: required"]), ("{", ["(root): object"]), ("[]", ["(root): object"]), (None, ["(root): object"]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["e"] for r in df.select("i", runs.query_errors(F.col("t")).alias("e")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1] for c in cases]


def test_budget_in_turn(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([0, 1, 3, 9, 20, -2, None])) for k in ("a", "b", None) for i in range(30)]
    want = {}
    for key in ("a", "b", None):
        left = 40
        for k, i, n in rows:
            if k == key:
                n = n or 0
                ok = n <= left or n <= 0
                left -= max(n, 0) if ok else 0
                want[k, i] = (ok, left)
    df = spark.createDataFrame(rows, "k string, i bigint, n int").repartition(5)
    assert {(r["k"], r["i"]): (r["granted"], r["remaining"]) for r in runs.budget(df, 40, "k", "i", "n").collect()} == want


@pytest.mark.parametrize("tasks", [1, 7])
def test_budget_of_one_hot_key(spark, tasks):
    rng = random.Random(tasks)
    rows = [("hot", i, rng.choice([0, 1, 2, 5, 11, 30]), rng.random() < 0.2) for i in range(300)] + [(None, i, 3, False) for i in range(40)] + [(f"k{i}", i, 7, False) for i in range(50)]
    want, state = {}, {}
    for k, i, n, back in rows:
        left, out = state.get(k, (60, False))
        ok = back or n <= left
        left = min(60, left + n) if back else left - n if ok else left
        state[k] = (left, out or not ok)
        want[k, i] = (ok, *state[k])
    df = spark.createDataFrame(rows, "k string, i bigint, n int, back boolean").repartition(5)
    got = runs.budget(df, 60, "k", "i", "n", "back", tasks=tasks)
    assert {(r["k"], r["i"]): (r["granted"], r["remaining"], r["exhausted"]) for r in got.collect()} == want


def test_spending_is_the_requests_in_turn():
    rng = random.Random(3)
    for _ in range(300):
        total = rng.randint(0, 40)
        held, done = runs.Spending(total), []
        for _ in range(rng.randint(0, 25)):
            n, back = rng.randint(-1, 15), rng.random() < 0.3
            held.take(n, back)
            done.append((n, back))
        assert len(held.pieces) <= total + 1
        for left in range(total + 1):
            now, denied = left, False
            for n, back in done:
                if n > 0:
                    denied |= not back and n > now
                    now = min(total, now + n) if back else now - n if n <= now else now
            assert held.after(left) == (now, denied)


def test_spending_keeps_few_pieces_once_all_is_spent():
    held = runs.Spending(500)
    for e in range(4000):
        held.take(e % 7, False)
    assert len(held.pieces) <= 3 and held.after(500) == (0, True) and held.after(0) == (0, True)
    held = runs.Spending(3)
    held.take(4, False)
    assert held.after(3) == (3, True)


def test_agreement_and_score(spark):
    rows = [("x", 1, "a"), ("x", 2, "b"), ("y", 1, "a"), ("y", 2, "b"), ("z", 1, "a"), ("z", 2, "a")]
    pairs, low = probes.agreement(spark.createDataFrame(rows, "labeler string, unit_id int, label string"))
    assert {(r["first"], r["second"]): r["kappa"] for r in pairs.collect()} == {("x", "y"): 1.0, ("x", "z"): 0.0, ("y", "z"): 0.0}
    assert tuple(low.first()) == (0.0, 0.3333, "FAIL", 1)
    empty = probes.agreement(spark.createDataFrame([], "labeler string, unit_id int, label string"))
    assert empty[0].count() == 0 and tuple(empty[1].first()) == (None, None, "FAIL", 0)
    status = lambda d: spark.createDataFrame(list(d.items()), "claim_id string, status string")
    got = probes.score(status({"a": "verified", "b": "verified", "c": "unresolved"}), status({"a": "verified", "c": "verified", "d": "refuted"}), spark.createDataFrame([("a", "s")], "claim_id string, stratum string"))
    assert {r["stratum"]: (r["n"], r["false_entail"], r["false_neg"], r["tp"]) for r in got.collect()} == {"s": (1, 0, 0, 1), "unspecified": (3, 1, 1, 0), None: (4, 1, 1, 1)}


def test_lock_and_session(spark):
    cases = [((False, False, False, True, 0.0, False), "acquired"), ((True, True, True, True, 200.0, False), "reacquired"), ((True, False, False, True, 5.0, False), "live holder"), ((True, False, False, True, 91.0, False), "live holder, stale heartbeat"), ((True, False, False, False, 90.0, False), "dead holder, fresh heartbeat"), ((True, False, False, False, 91.0, False), "reclaimed"), ((True, False, False, True, 5.0, True), "reclaimed")]
    df = spark.createDataFrame([c[0] for c in cases], "h boolean, m boolean, p boolean, a boolean, age double, f boolean")
    out = runs.lock_outcome(*[F.col(c) for c in df.columns])
    assert [r["outcome"] for r in df.select(*[v.alias(k) for k, v in out.items()]).collect()] == [c[1] for c in cases]
    rows = [("a", 1, "completed"), ("a", 2, "pending"), ("a", 3, "in_progress"), ("b", 1, "completed"), ("c", 1, None)]
    got = {r["session_id"]: (r["next_phase"], r["state"], r["done"]) for r in runs.session_status(spark.createDataFrame(rows, "session_id string, phase int, state string")).collect()}
    assert got == {"a": (2, "pending", 1), "b": (None, "complete", 1), "c": (1, "pending", 0)}


def test_query_errors_reads_each_part_once_and_in_many_tasks(spark, tmp_path):
    """Every test of a part read it anew, and a small file was one task, however many rows it had."""
    from attesta.plans import checks

    asked = spark.range(1).select(runs.query_errors(F.lit("{}")).alias("e"), F.rand().alias("r"))
    paths = asked._jdf.queryExecution().analyzed().toString().count("schema_of_variant")
    assert 0 < paths <= 60
    spark.range(6000).select(F.col("id").alias("p_partkey"), F.lit("a name of a part").alias("p_name"), F.lit("type").alias("p_type")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = checks.query_errors(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() > 1 and out.count() == 6000


def test_present_in_bounded_shares(spark, monkeypatch):
    """The claims' runs go to as many tasks as their number asks for, and a filter that most keys would pass is left out."""
    from attesta.operators import filters

    rows = spark.range(1000).select(F.col("id").cast("string").alias("g"))
    monkeypatch.setattr(filters, "MOST", 64)
    assert "Join" not in filters.passing(rows, "g", rows)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(gate, "RUNS", 50)
    text = lambda i: F.md5(i.cast("string"))
    i = F.col("id")
    claims = spark.range(40).select(F.when(i % 2 == 0, "told").otherwise("open").alias("kind"), F.format_string("n%03d", i).alias("claim_id"), text(i).alias("text"))
    body = spark.range(20).select(F.when(i == 3, "see n011").otherwise(text(i)).alias("text")).unionByName(spark.range(20, 22).select(text(i).alias("text")))
    out = gate._present(claims, body, claims.filter("kind = 'told'").select("text"), "told")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("], 26") == 2  # 1280 characters: both sides of the join
    assert {r.claim_id for r in out.collect()} == {f"n{k:03d}" for k in range(22) if k != 3}


def test_anchored_claims_in_many_tasks_read_words_once(spark, tmp_path):
    """Words were taken from a text anew for each stem, and narrow rows of one file were one task's."""
    from attesta.operators import anchors
    from attesta.plans import catalog

    plan = spark.range(1).select(anchors.polarity_ok(F.lit("a"), F.lit("b")).alias("p"), anchors.referent_flags(F.lit("a"), F.lit("b")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") <= 4 and plan.count("lower(coalesce") == 2
    spark.range(4000).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    out = catalog.anchored_claims(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() > 1 and out.count() == 4000
    rows = [("it is not disputed that no sales rose", "sales were never disputed", False), ("not disputed, disputed", "disputed, not disputed", False), ("Sales rose", "no sales rose", False), ("Sales rose", "sales rose", True), (None, "no sales", True), ("", None, True)]
    got = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "c string, s string, ok boolean, i int").withColumn("p", anchors.polarity_ok(F.col("c"), F.col("s"))).orderBy("i").collect()
    assert [r.p for r in got] == [r.ok for r in got]


def test_simhash_of_a_batch_takes_little_memory():
    """Signs of all words of a batch at once took eight bytes a word; texts without words, and longer than a step, keep their places."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    texts = [[], ["a", "b", "a"], ["w%d" % (i % 500) for i in range(cluster.WORDS + 7)], [], *[["x%d" % (i * j % 97) for j in range(1000)] for i in range(1500)], []]
    words = pa.array(texts, pa.list_(pa.string()))
    tracemalloc.start()
    got = cluster._simhash(words).to_numpy()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * words.flatten().__len__() / 2
    for i in (0, 1, 2, 3, 4, 700, 1503, 1504):
        h = np.asarray(cluster._fnv1a(pa.array(texts[i], pa.string()))).view(np.uint64)
        want = sum(1 << b for b in range(64) if sum(1 if int(x) >> b & 1 else -1 for x in h) > 0)
        assert int(got[i]) % (1 << 64) == want


def test_near_pairs_shuffles_no_text(spark, tmp_path):
    from attesta.plans import catalog

    seen = []
    docs = [(3, "one two three four"), (1, "one two three four"), (2, None), (5, ""), (4, "one two three four "), (7, "something else")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    keep, cluster.near_pairs = cluster.near_pairs, lambda h, *a: seen.append(h) or keep(h, *a)
    try:
        rows = {tuple(r) for r in catalog.near_pairs(spark, str(tmp_path)).collect()}
    finally:
        cluster.near_pairs = keep
    assert rows == {(1, 4)}
    keys = [line for line in seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert keys and not any("text#" in k for k in keys)
