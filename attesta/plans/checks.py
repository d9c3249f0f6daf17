"""Queries of the report gate, bindings, probes, agreement and session bookkeeping.

Claims, verdicts and sessions are read off the driver's tables by arithmetic on their keys, so that
SQL can give the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bindings, gate, probes, runs
from ..operators.filters import spread
from ..sources import tables
from .catalog import _ANCHORED, _DECIDE, _FEATURES, _RULE_SQL, _SIMHASH, cited, query, read


def name(prefix: str, number):
    return F.concat(F.lit(prefix), number.cast("string"))


# ---- report gate ---------------------------------------------------------------------------


@query("body_backstop", f"""
SELECT rules, claim_id, CASE WHEN claim_id IS NULL THEN 'no claim' ELSE 'non-verified claim ' || claim_id END AS reason
FROM (SELECT doc_id % 3 AS m, CASE WHEN doc_id % 3 <> 0 THEN 'c' || doc_id END AS claim_id, array_to_string(list_filter([{_RULE_SQL}], lambda x: x IS NOT NULL), ',') AS rules FROM documents) WHERE rules <> '' AND m <> 1""")
def body_backstop(spark, d):
    docs, i = read(spark, d, "documents"), F.col("doc_id")
    found = gate.backstop(docs.select("text", F.when(i % 3 != 0, name("c", i)).alias("claim_id")), docs.filter("doc_id % 3 = 1").select(name("c", i).alias("claim_id")))
    return found.select("rules", "claim_id", "reason")


@query("citation_errors", """
WITH c AS (SELECT DISTINCT 'src_' || (p_partkey % 90) AS id FROM part), s AS (SELECT 'src_' || (s_suppkey + 5) AS id FROM supplier)
SELECT id, 'dangling' AS kind FROM c WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT id, 'orphan' FROM s WHERE id NOT IN (SELECT id FROM c)""")
def citation_errors(spark, d):
    body = read(spark, d, "part").select(F.concat("p_name", F.lit(" ["), name("src_", F.col("p_partkey") % 90), F.lit("]")).alias("text"))
    return gate.citation_errors(body, read(spark, d, "supplier").select(name("src_", F.col("s_suppkey") + 5).alias("id")))


_GATE = """
WITH p AS (SELECT p_partkey AS k, 'k' || p_partkey || 'x' AS claim_id, md5(p_partkey::VARCHAR) AS text FROM part),
body AS (SELECT 'On ' || text || ' (src_' || (k % 90) || ')' || CASE WHEN k % 11 = 0 THEN ' see ' || claim_id ELSE '' END AS text FROM p WHERE k % 5 = 0),
d AS (SELECT k, claim_id, text, CASE k % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'refuted' ELSE 'cite_write' END AS status FROM p WHERE k % 100 <> 49),
ver AS (SELECT * FROM d WHERE status = 'verified'), src AS (SELECT 'src_' || (s_suppkey + 5) AS id FROM supplier), cit AS (SELECT DISTINCT 'src_' || (k % 90) AS id FROM p WHERE k % 5 = 0),
v AS (SELECT claim_id, k, k % 12 <> 0 AS ok, k % 20 <> 0 AS matched, k % 16 = 0 AS bad FROM p),
g AS (SELECT claim_id, status, substr(text, i::INT, 6) AS g FROM d, range(1, 28) r(i)),
bg AS (SELECT DISTINCT substr(t, i::INT, 6) AS g FROM (SELECT regexp_replace(text, '[^0-9A-Za-z가-힣%]', '', 'g') AS t FROM body), range(1, 200) r(i) WHERE i <= length(t) - 5),
named AS (SELECT claim_id FROM d WHERE k % 55 = 0),
leak AS (SELECT claim_id FROM d WHERE status IN ('unresolved', 'refuted') AND (claim_id IN (SELECT claim_id FROM named) OR claim_id IN (SELECT claim_id FROM g WHERE g IN (SELECT g FROM bg) AND g NOT IN (SELECT g FROM g WHERE status = 'verified')))),
cov AS (SELECT claim_id FROM ver WHERE claim_id IN (SELECT claim_id FROM named) OR claim_id IN (SELECT claim_id FROM g WHERE g IN (SELECT g FROM bg))),
n AS (SELECT (SELECT count(*) FROM ver) AS high_risk_verified, (SELECT count(*) FROM d WHERE status = 'cite_write') AS cite_write, (SELECT count(*) FROM d WHERE status = 'unresolved') AS unresolved, (SELECT count(*) FROM d WHERE status = 'refuted') AS refuted,
 (SELECT count(*) FROM cit) AS citations_total, (SELECT count(*) FROM cit WHERE id NOT IN (SELECT id FROM src)) AS citations_dangling, (SELECT count(*) FROM src) AS sources_total, (SELECT count(*) FROM src WHERE id NOT IN (SELECT id FROM cit)) AS orphan_sources,
 (SELECT count(*) FROM leak) AS leaks, (SELECT count(*) FROM ver WHERE k % 12 = 0) AS missing_proof, (SELECT count(*) FROM p WHERE k % 100 = 49) AS coverage_missing, (SELECT count(*) FROM cov) AS covered, (SELECT count(*) FILTER (matched) FROM v WHERE k % 4 = 0 AND k % 100 <> 49) AS matched, (SELECT count(*) FILTER (bad) FROM v) AS degraded, (SELECT count(*) FROM v) AS total)
SELECT 'FAIL' AS verdict, round_even((citations_total - citations_dangling) / citations_total, 3) AS citation_resolution_rate, round_even(missing_proof / high_risk_verified, 3) AS missing_entailment_proof_rate, round_even(matched / high_risk_verified, 3) AS span_match_rate,
 round_even(covered / high_risk_verified, 3) AS verified_coverage_rate, round_even(leaks / (unresolved + refuted), 3) AS leak_rate, round_even(orphan_sources / sources_total, 3) AS orphan_source_rate, round_even(degraded / total, 3) AS degraded_verdict_rate, false AS coverage_ok, true AS manifest_ok,
 high_risk_verified, cite_write, unresolved, refuted, citations_total, citations_dangling, sources_total, orphan_sources, leaks, missing_proof, coverage_missing FROM n"""


@query("report_gate", _GATE)
def report_gate(spark, d):
    k = F.col("p_partkey")
    claim, source = F.concat(name("k", k), F.lit("x")), name("src_", k % 90)
    p = read(spark, d, "part").select(k, claim.alias("claim_id"), F.md5(k.cast("string")).alias("text"), source.alias("source_id"))
    status = F.when(k % 4 == 0, "verified").when(k % 4 == 1, "unresolved").when(k % 4 == 2, "refuted").otherwise("cite_write")
    body = p.filter(k % 5 == 0).select(F.concat(F.lit("On "), "text", F.lit(" ("), "source_id", F.lit(")"), F.when(k % 11 == 0, F.concat(F.lit(" see "), "claim_id")).otherwise("")).alias("text"))
    decided = p.filter(k % 100 != 49).select("claim_id", status.alias("status"), (k % 4 < 3).alias("high_risk"), F.array("source_id").alias("proof_source_ids"))
    risk = p.select("claim_id", F.when((k % 4 < 3) | (k % 100 == 49), "high").otherwise("normal").alias("computed_risk"))
    verdicts = p.select("claim_id", "source_id", F.lit("entails").alias("label"), (k % 12 != 0).alias("anchors_ok"), (k % 20 != 0).alias("span_matched"), F.when(k % 16 == 0, "failed").otherwise("done").alias("span_state"), F.lit(None).cast("string").alias("fail_reason"))
    return gate.report(read(spark, d, "supplier").select(name("src_", F.col("s_suppkey") + 5).alias("id")), p.select("claim_id", "text"), risk, verdicts, decided, body)


_PERCENT = lambda c: f"printf('%.1f%%', {c} * 100)"


@query("report_text", f"""WITH g AS ({_GATE}), t AS (SELECT unnest([
 'verdict: ' || verdict || ', manifest ' || manifest_ok, 'citations: ' || {_PERCENT("citation_resolution_rate")} || ' resolved, ' || citations_dangling || ' of ' || citations_total || ' dangling',
 'proof: ' || {_PERCENT("missing_entailment_proof_rate")} || ' of ' || high_risk_verified || ' verified claims without one, ' || {_PERCENT("span_match_rate")} || ' of spans found',
 'leaks: ' || {_PERCENT("leak_rate")} || ', ' || leaks || ' of ' || unresolved || ' unresolved and ' || refuted || ' refuted claims', 'coverage: ' || {_PERCENT("verified_coverage_rate")} || ' of verified claims told, ' || coverage_missing || ' without a status',
 'sources: ' || {_PERCENT("orphan_source_rate")} || ' of ' || sources_total || ' orphaned', 'verdicts: ' || {_PERCENT("degraded_verdict_rate")} || ' degraded, ' || cite_write || ' claims to cite']) AS text, unnest(range(1, 8)) AS line FROM g)
SELECT line::INTEGER AS line, text FROM t""")
def report_text(spark, d):
    return gate.report_text(report_gate(spark, d))


@query("strict_handoff", "SELECT 'c' || c_custkey AS claim_id, 'r' || (c_custkey % 5) AS reason FROM customer WHERE c_custkey % 3 = 1 AND c_nationkey % 2 = 0")
def strict_handoff(spark, d):
    k, c = F.col("c_custkey"), read(spark, d, "customer")
    decided = c.select(name("c", k).alias("claim_id"), F.when(k % 3 == 0, "verified").when(k % 3 == 1, "unresolved").otherwise("cite_write").alias("status"), name("r", k % 5).alias("reason"))
    return gate.strict_handoff(decided, c.select(name("c", k).alias("claim_id"), F.when(F.col("c_nationkey") % 2 == 0, "high").otherwise("normal").alias("computed_risk")))


@query("version_drift", """
WITH o AS (SELECT 'p' || s_suppkey AS component, 'v' || (s_suppkey % 4) AS stored FROM supplier WHERE s_suppkey % 7 <> 0), n AS (SELECT 'p' || s_suppkey AS component, 'v' || (s_suppkey % 5) AS running FROM supplier WHERE s_suppkey % 11 <> 0)
SELECT component, stored, running FROM o FULL JOIN n USING (component) WHERE stored IS DISTINCT FROM running""")
def version_drift(spark, d):
    k, s = F.col("s_suppkey"), read(spark, d, "supplier")
    return gate.version_drift(s.filter(k % 7 != 0).select(name("p", k).alias("component"), name("v", k % 4).alias("version")), s.filter(k % 11 != 0).select(name("p", k).alias("component"), name("v", k % 5).alias("version")))


@query("lens_models", """
SELECT s_suppkey, l AS lens, CASE WHEN len(m) > 0 THEN m[(l % greatest(len(m), 1))::INT + 1] END AS model
FROM (SELECT s_suppkey, list_sort(list_filter(['m' || (s_suppkey % 3), CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE '' END, NULL], lambda x: x <> '')) AS m FROM supplier), range(0, 3) r(l)""")
def lens_models(spark, d):
    k = F.col("s_suppkey")
    models = F.array(name("m", k % 3), F.when(k % 2 == 0, "a").otherwise(""), F.lit(None).cast("string"))
    return read(spark, d, "supplier").select(k, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("lens"), models.alias("m")).select(k, "lens", gate.lens_of(F.col("m"), F.col("lens")).alias("model"))


# ---- bindings ------------------------------------------------------------------------------


@query("built_verdicts", f"""{_ANCHORED}, r AS (SELECT 'c' || item_id AS claim_id, 'src_' || doc_id AS source_id, item_id % 7 <> 0 AS known, CASE WHEN item_id % 7 = 0 OR item_id % 9 = 0 THEN 'failed' ELSE 'done' END AS state, CASE WHEN item_id % 5 = 0 THEN 'neutral' ELSE 'entails' END AS label, b.text AS span, d.text AS snap, s, t FROM p JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))
SELECT 'v_' || substr(sha256(claim_id || '|' || source_id || '|verifier|m|p|' || span), 1, 16) AS verdict_id, claim_id, source_id, CASE WHEN known THEN label END AS label, state AS span_state, CASE WHEN NOT known THEN 'malformed_label' END AS fail_reason, state = 'done' AS span_matched,
 CASE WHEN state = 'done' THEN strpos(t, s)::INTEGER - 1 ELSE -1 END AS char_start, CASE WHEN state = 'done' THEN (strpos(t, s) - 1 + length(s))::INTEGER ELSE -1 END AS char_end, state = 'done' AS numeric_ok, true AS polarity_ok, state = 'done' AS anchors_ok, '' AS referents, 'B' AS source_grade, sha256(snap) AS snapshot_hash FROM r""")
def built_verdicts(spark, d):
    rows = cited(spark, d, T.normalize)
    i = F.col("item_id")
    label = F.when(i % 7 == 0, "maybe").when(i % 5 == 0, "neutral").otherwise("entails")
    raw = rows.select(name("c", i).alias("claim_id"), name("src_", F.col("doc_id")).alias("source_id"), label.alias("label"), F.col("span").alias("evidence_span"), F.when(i % 9 == 0, "failed").otherwise("done").alias("span_state"), F.lit("m").alias("model_id"), F.lit("p").alias("prompt_hash"))
    docs = read(spark, d, "documents").select(name("src_", F.col("doc_id")).alias("source_id"), F.lit("b").alias("quality_rating"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("snapshot"))
    return bindings.build_verdicts(raw, read(spark, d, "benchmark").select(name("c", i).alias("claim_id"), "text"), docs)


@query("unknown_pairs", """
SELECT 'c' || user_id AS claim_id, 's' || (event_id % 40) AS source_id, 'unknown claim' AS error FROM events WHERE user_id % 10 = 0
UNION ALL SELECT 'c' || user_id, 's' || (event_id % 40), 'unknown source' FROM events WHERE event_id % 40 >= 25""")
def unknown_pairs(spark, d):
    e = read(spark, d, "events")
    raw = e.select(name("c", F.col("user_id")).alias("claim_id"), name("s", F.col("event_id") % 40).alias("source_id"))
    return bindings.unknown_pairs(raw, e.filter("user_id % 10 <> 0").select(name("c", F.col("user_id")).alias("claim_id")), read(spark, d, "nation").select(name("s", F.col("n_nationkey")).alias("source_id")))


@query("binding_errors", """
WITH v AS (SELECT 'v' || event_id AS verdict_id, event_id AS e, event_id % 30 AS s, user_id AS u FROM events)
SELECT verdict_id, 'unknown source' AS error FROM v WHERE s >= 25 UNION ALL SELECT verdict_id, 'snapshot hash' FROM v WHERE s < 25 AND s % 5 <> 0 AND e % 3 = 0
UNION ALL SELECT verdict_id, 'grade' FROM v WHERE s < 25 AND e % 4 = 1 AND s % 3 <> 0 UNION ALL SELECT verdict_id, 'claim hash' FROM v WHERE s < 25 AND u % 2 = 0 AND e % 7 = 0""")
def binding_errors(spark, d):
    e, s, n = F.col("event_id"), F.col("event_id") % 30, F.col("n_nationkey")
    rows = read(spark, d, "events")
    v = rows.select(name("v", e).alias("verdict_id"), name("c", F.col("user_id")).alias("claim_id"), name("s", s).alias("source_id"), F.when(e % 3 == 0, "other").otherwise(name("h", s)).alias("snapshot_hash"), F.when(e % 4 == 1, " a").alias("source_grade"), F.when(e % 7 == 0, "other").otherwise(name("t", F.col("user_id"))).alias("claim_text_hash"))
    claims = rows.filter("user_id % 2 = 0").select(name("c", F.col("user_id")).alias("claim_id"), name("t", F.col("user_id")).alias("claim_text_hash")).distinct()
    sources = read(spark, d, "nation").select(name("s", n).alias("source_id"), F.when(n % 5 != 0, name("h", n)).alias("content_hash"), F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").alias("quality_rating"))
    return bindings.binding_errors(v, claims, sources)


@query("reduced_grades", """
SELECT c_custkey, g AS grade, r AS reduced, r <= CASE c_custkey % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'D' ELSE 'E' END AS enough FROM (SELECT c_custkey, g, CASE WHEN f THEN 'E' ELSE substr('ABCDE', least(a + b + n + 1, 5)::INT, 1) END AS r
FROM (SELECT c_custkey, substr('ABCDE', (c_custkey % 5)::INT + 1, 1) AS g, c_custkey % 5 AS n, CASE WHEN c_nationkey % 3 = 0 THEN 2 ELSE 0 END AS a, CASE WHEN c_nationkey % 4 = 0 THEN 1 ELSE 0 END AS b, c_nationkey % 8 = 1 AS f FROM customer))""")
def reduced_grades(spark, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    grade = F.substring(F.lit("ABCDE"), (k % 5).cast("int") + 1, F.lit(1))
    flags = F.array_compact(F.array(F.when(n % 3 == 0, F.lit("no_date")), F.when(n % 4 == 0, F.lit("broken_citations")), F.when(n % 8 == 1, F.lit("retracted"))))
    rows = read(spark, d, "customer").select(k, grade.alias("grade"), bindings.reduced_grade(grade, flags).alias("reduced"), F.when(k % 3 == 0, "definitive_claim").when(k % 3 == 1, "background").otherwise("other").alias("kind"))
    return rows.select(k, "grade", "reduced", bindings.good_enough(F.col("reduced"), F.col("kind")).alias("enough"))


@query("query_errors", """
WITH q AS (SELECT p_partkey AS k, p_name AS t, p_type AS y FROM part)
SELECT k AS p_partkey, array_to_string(list_filter([CASE WHEN k % 6 = 1 THEN 'context: required' END, CASE WHEN k % 6 = 2 THEN 'context.use_case: required' END, CASE WHEN k % 4 <> 0 THEN 'task.type: value' END,
  CASE WHEN length(t) NOT BETWEEN 10 AND 100 THEN 'task.title: length' END, CASE WHEN k % 3 = 0 THEN 'questions.secondary: items' END, CASE WHEN k % 5 = 0 THEN 'constraints.sources.required_types: value' END, CASE WHEN k % 1000 < 500 THEN 'output.length.min_words: range' END], lambda x: x IS NOT NULL), ',') AS errors
FROM q WHERE k % 13 <> 0 UNION ALL SELECT k, '(root): object' FROM q WHERE k % 13 = 0""")
def query_errors(spark, d):
    k = F.col("p_partkey")
    text = lambda s: F.lit(s)
    context = F.struct(text("b" * 60).alias("background"), text("general").alias("audience"), F.when(k % 6 != 2, "u" * 30).alias("use_case"))
    sources = F.struct(F.array(F.lit("news"), F.when(k % 5 == 0, "rumour").otherwise("datasets")).alias("required_types"), text("B").alias("min_quality"))
    doc = F.to_json(F.struct(
        F.struct(F.col("p_name").alias("title"), text("o" * 30).alias("objective"), F.when(k % 4 == 0, "analytical").otherwise(F.col("p_type")).alias("type")).alias("task"), F.when(k % 6 != 1, context).alias("context"),
        F.struct(text("q" * 30).alias("primary"), F.when(k % 3 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("secondary")).alias("questions"),
        F.struct(F.struct(text("2020").alias("start"), text("present").alias("end")).alias("timeframe"), F.struct(text("global").alias("scope")).alias("geography"), sources.alias("sources")).alias("constraints"),
        F.struct(text("policy_brief").alias("format"), F.struct((k % 1000).alias("min_words")).alias("length"), F.struct(F.lit(True).alias("include_bibliography")).alias("structure")).alias("output"),
    ))
    broken = F.when(k % 13 != 0, doc).when(k % 2 == 0, "{oops").otherwise("[1]")
    return spread(read(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_partkey").select(k, broken.alias("doc")).select(k, F.array_join(runs.query_errors(F.col("doc")), ",").alias("errors"))


# ---- probes and agreement ------------------------------------------------------------------

_REFS = """e AS (SELECT user_id AS claim_id, event_id % 7 AS source_id, event_id AS key_ord, 'done' AS span_state, CASE event_id % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'neutral' ELSE 'entails' END AS label, event_id % 61 <> 0 AND event_id % 67 <> 2 AND event_id % 71 <> 3 AS anchors_ok FROM events WHERE event_id % 4 <> 0 OR event_id % 5 = 0)"""
_PANEL = {"panel": "claim_id % 3 = 1", "m2": "claim_id % 3 <> 0", "shown": "CASE claim_id % 3 WHEN 1 THEN 'entails' WHEN 2 THEN 'contradicts' END", "join": ""}
_CAUSE = f"""
WITH d AS (WITH {_REFS}, {_DECIDE.format(**_PANEL)}),
r AS (SELECT user_id AS claim_id, event_id AS k, event_id % 7 AS s, event_id % 4 AS l, event_id % 61 <> 0 AND event_id % 67 <> 2 AND event_id % 71 <> 3 AS ok, CASE WHEN event_id % 61 = 0 THEN 'anchor:span' WHEN event_id % 67 = 2 THEN 'anchor:numeric' ELSE 'anchor:polarity' END AS step FROM events WHERE event_id % 4 <> 0 OR event_id % 5 = 0),
a AS (SELECT claim_id, arg_min(step, k) FILTER (l <> 1 AND NOT ok) AS anchor, count(DISTINCT s % 3) FILTER (l > 1 AND ok) AS n, coalesce(bool_or(l > 1 AND ok AND s % 4 < 2), false) AS graded, bool_or(k % 17 = 0) AS referent FROM r GROUP BY 1)
SELECT claim_id, status, reason, independent_entails, referent, CASE WHEN status = 'verified' THEN NULL WHEN anchor IS NOT NULL THEN anchor {{order}} ELSE 'other:' || reason END AS cause FROM d JOIN a USING (claim_id)"""
_APART = "WHEN n < 2 THEN 'independence:lt2_clusters' WHEN NOT graded THEN 'independence:no_ab_grade'"
_LEAK = _CAUSE.format(order=f"WHEN reason = 'ab_contradiction' THEN 'panel:refuted' WHEN reason = 'panel_no_consensus' OR claim_id % 3 = 2 THEN 'panel:contradicts' {_APART}")
_MISS = _CAUSE.format(order=f"{_APART} WHEN reason = 'panel_no_consensus' OR claim_id % 3 = 2 THEN 'panel:no_consensus'")


def refs(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    s = e % 7
    label = F.when(e % 4 == 0, "contradicts").when(e % 4 == 1, "neutral").otherwise("entails")
    span, numeric, polarity = e % 61 != 0, e % 67 != 2, e % 71 != 3
    rows = read(spark, d, "events").filter("event_id % 4 <> 0 or event_id % 5 = 0")
    return rows.select(u.alias("claim_id"), F.when(u % 3 == 1, "entails").when(u % 3 == 2, "contradicts").alias("panel"), e.alias("key_ord"), s.alias("source_id"), name("cl_", s % 3).alias("cluster_id"), F.when(s % 4 == 0, "a").when(s % 4 == 1, "B").otherwise("C").alias("grade"), label.alias("label"), span.alias("span_matched"), numeric.alias("numeric_ok"), polarity.alias("polarity_ok"), (span & numeric & polarity).alias("anchors_ok"), (e % 17 == 0).alias("referent"))


@query("leak_causes", _LEAK)
def leak_causes(spark, d):
    return probes.causes(refs(spark, d), panel_first=True)


@query("recall_causes", _MISS)
def recall_causes(spark, d):
    return probes.causes(refs(spark, d), panel_first=False)


@query("leak_summary", f"SELECT CASE WHEN claim_id % 10 = 0 THEN 'demo' ELSE 'headline' END AS \"group\", count(*) AS n, count(*) FILTER (status = 'verified') AS leaked, round_even(count(*) FILTER (status = 'verified') / count(*), 4) AS leak_rate FROM ({_LEAK}) GROUP BY 1")
def leak_summary(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("claim_id"), F.when(F.col("user_id") % 10 == 0, "panel_necessity").alias("demonstrates")).distinct()
    return probes.leak_summary(leak_causes(spark, d), rows)


@query("recall_summary", f"SELECT claim_id % 3 = 1 AS headline, count(*) AS n, count(*) FILTER (status = 'verified') AS verified, round_even(count(*) FILTER (status = 'verified') / count(*), 4) AS recall FROM ({_MISS}) GROUP BY 1")
def recall_summary(spark, d):
    return probes.recall_summary(recall_causes(spark, d), read(spark, d, "events").select(F.col("user_id").alias("claim_id"), (F.col("user_id") % 3 == 1).alias("headline")).distinct())


@query("ranked_causes", f"SELECT cause, count(*) AS n FROM ({_LEAK}) WHERE cause IS NOT NULL GROUP BY 1")
def ranked_causes(spark, d):
    return probes.ranked_causes(leak_causes(spark, d))


_PROBE = rf"""
WITH RECURSIVE {_SIMHASH}, ds AS (SELECT doc_id AS id, text FROM documents), {_FEATURES.replace('@p_', 'of_').replace('@table', 'ds')},
x AS (SELECT doc_id, (doc_id // 4) AS s, bits, doc_id % 2 = 0 AS a, CASE WHEN doc_id % 9 = 0 THEN nullif(lower(trim(source)), '') END AS wire FROM documents JOIN b USING (doc_id)),
cosine AS (SELECT p.id AS m, q.id AS n FROM of_v p JOIN of_v q ON p.bucket = q.bucket AND p.id // 4 = q.id // 4 AND p.id <> q.id GROUP BY 1, 2 HAVING sum(p.weight * q.weight) >= 0.8),
link AS (SELECT m.doc_id AS m, n.doc_id AS n FROM x m JOIN x n ON m.s = n.s AND m.doc_id <> n.doc_id AND (m.wire = n.wire OR (m.bits <> 0 AND n.bits <> 0 AND bit_count(xor(m.bits, n.bits)) <= 3)) UNION SELECT m, n FROM cosine),
reach(n, m) AS (SELECT doc_id, doc_id FROM x UNION SELECT r.n, l.n FROM reach r JOIN link l ON l.m = r.m),
c AS (SELECT n AS doc_id, min(m) AS c FROM reach GROUP BY 1),
rep AS (SELECT s, c, arg_min(a, doc_id::VARCHAR) AS good FROM x JOIN c USING (doc_id) GROUP BY 1, 2),
n AS (SELECT s, count(*) AS n_clusters, bool_or(good) AS graded FROM rep GROUP BY 1), k AS (SELECT s, count(*) AS n_sources FROM x GROUP BY 1)
SELECT s AS scenario_id, CASE WHEN s % 2 = 0 THEN 'collapse' ELSE 'separate' END AS kind, n_sources, n_clusters, CASE WHEN s % 2 = 0 THEN n_clusters = 1 ELSE n_clusters = n_sources END AS ok, n_clusters >= 2 AND graded AS would_verify FROM n JOIN k USING (s)"""


@query("independence_probe", _PROBE)
def independence_probe(spark, d):
    i = F.col("doc_id")
    source = F.struct(i.cast("string").alias("id"), F.when(i % 2 == 0, "A").otherwise("C").alias("grade"), F.concat(F.lit("https://example.com/"), i.cast("string")).alias("url"), "text", F.when(i % 9 == 0, F.col("source")).alias("wire"), F.lit(None).cast("string").alias("byline"))
    docs = read(spark, d, "documents").groupBy(F.floor(i / 4).alias("scenario_id")).agg(F.sort_array(F.collect_list(source)).alias("sources"))  # four at most
    return probes.independence(docs.withColumn("kind", F.when(F.col("scenario_id") % 2 == 0, "collapse").otherwise("separate")))


_LABELERS = """r AS (SELECT 'p' || (event_id % 3) AS labeler, user_id AS unit_id, CASE WHEN event_id % 5 < 4 THEN user_id % 3 ELSE event_id % 3 END AS label FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 3, user_id ORDER BY event_id DESC) = 1),
b AS (SELECT x.unit_id, x.labeler AS first, y.labeler AS second, x.label AS x, y.label AS y FROM r x JOIN r y USING (unit_id) WHERE x.labeler < y.labeler),
n AS (SELECT first, second, count(*) AS n, count(*) FILTER (x = y) AS s FROM b GROUP BY 1, 2),
m AS (SELECT first, second, sum(p * q) AS pq FROM (SELECT first, second, x AS v, count(*) AS p FROM b GROUP BY 1, 2, 3) JOIN (SELECT first, second, y AS v, count(*) AS q FROM b GROUP BY 1, 2, 3) USING (first, second, v) GROUP BY 1, 2),
k AS (SELECT first, second, n AS n_shared, round_even((s / n - pq / (n * n)) / (1 - pq / (n * n)), 4) AS kappa FROM n JOIN m USING (first, second))"""


def labelled(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    rows = read(spark, d, "events").select(name("p", e % 3).alias("labeler"), u.alias("unit_id"), F.when(e % 5 < 4, u % 3).otherwise(e % 3).alias("label"), e.alias("_ord"))
    return tables.last_labels(rows)


def labelers(spark, d):
    return probes.agreement(labelled(spark, d))


@query("labeler_disagreements", f"WITH {_LABELERS} SELECT unit_id, string_agg(labeler || '=' || label, ';' ORDER BY labeler) AS labels FROM r GROUP BY 1 HAVING min(label) <> max(label)")
def labeler_disagreements(spark, d):
    told = F.transform(F.map_entries("labels"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return probes.disagreements(labelled(spark, d)).select("unit_id", F.array_join(told, ";").alias("labels"))


@query("labeler_pairs", f"WITH {_LABELERS} SELECT * FROM k")
def labeler_pairs(spark, d):
    return labelers(spark, d)[0]


@query("labeler_gate", f"WITH {_LABELERS} SELECT min(kappa) AS min_kappa, round_even(avg(kappa), 4) AS mean_kappa, CASE WHEN min(kappa) >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS gate, (SELECT count(DISTINCT unit_id) FROM b WHERE x <> y) AS n_disagreements FROM k")
def labeler_gate(spark, d):
    return labelers(spark, d)[1]


@query("gold_status", f"SELECT claim_id, status FROM (WITH e AS (SELECT user_id AS claim_id, event_id % 7 AS source_id, event_id AS key_ord, 'done' AS span_state, CASE WHEN event_id % 50 = 0 THEN 'contradicts' WHEN event_id % 4 = 1 THEN 'neutral' ELSE 'entails' END AS label, NOT ((user_id + event_id % 7) % 5 = 0) AS anchors_ok FROM events), {_DECIDE.format(panel='false', m2='false', shown='NULL', join='')})")
def gold_status(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    s = e % 7
    rows = read(spark, d, "events")
    gold = rows.select(u.alias("claim_id"), s.alias("source_id"), F.when(e % 50 == 0, "contradicts").when(e % 4 == 1, "neutral").otherwise("entails").alias("label"), e.alias("key_ord"))
    ids = read(spark, d, "nation").filter("n_nationkey < 7").select(F.col("n_nationkey").cast("long").alias("source_id"))
    n = F.col("source_id")
    anchored = gold.select("claim_id", "source_id").distinct().filter((F.col("claim_id") + n) % 5 == 0).withColumn("anchors_ok", F.lit(False))
    return probes.gold_status(gold, ids.select(n, F.when(n % 4 < 2, "A").otherwise("C").alias("quality_rating")), anchored, ids.select(n, name("cl_", n % 3).alias("cluster_id")))


@query("gold_score", """
WITH c AS (SELECT c_mktsegment AS stratum, coalesce(c_custkey % 10 <> 3 AND c_custkey % 3 = 0, false) AS s, c_custkey % 10 <> 4 AND c_nationkey % 2 = 0 AS g FROM customer WHERE c_custkey % 10 <> 3 OR c_custkey % 10 <> 4),
t AS (SELECT stratum, count(*) AS n, count(*) FILTER (s AND NOT g) AS false_entail, count(*) FILTER (g AND NOT s) AS false_neg, count(*) FILTER (s AND g) AS tp FROM c GROUP BY ROLLUP (stratum))
SELECT *, round_even(tp / nullif(tp + false_entail, 0), 4) AS precision, round_even(tp / nullif(tp + false_neg, 0), 4) AS recall FROM t""")
def gold_score(spark, d):
    k, c = F.col("c_custkey"), read(spark, d, "customer")
    system = c.filter(k % 10 != 3).select(k.alias("claim_id"), F.when(k % 3 == 0, "verified").otherwise("unresolved").alias("status"))
    gold = c.filter(k % 10 != 4).select(k.alias("claim_id"), F.when(F.col("c_nationkey") % 2 == 0, "verified").otherwise("refuted").alias("status"))
    return probes.score(system, gold, c.select(k.alias("claim_id"), F.col("c_mktsegment").alias("stratum")))


# ---- sessions ------------------------------------------------------------------------------


#: By user, and all events under one key.
_BUDGET = """
r AS (SELECT g, event_id, n, row_number() OVER (PARTITION BY g ORDER BY event_id) AS i FROM q),
f AS (SELECT g, event_id, i, true AS granted, t - n AS remaining, false AS exhausted FROM r, (SELECT {total} AS t) WHERE i = 1
 UNION ALL SELECT r.g, r.event_id, r.i, r.n = 0 OR r.n <= f.remaining, f.remaining - CASE WHEN r.n <= f.remaining THEN r.n ELSE 0 END, exhausted OR (r.n > f.remaining) FROM f JOIN r ON r.g = f.g AND r.i = f.i + 1)"""


@query("budget_requests", f"WITH RECURSIVE q AS (SELECT user_id AS g, event_id, event_id % 4 AS n FROM events), {_BUDGET.format(total=30)} SELECT g AS user_id, event_id, granted, remaining, exhausted FROM f")
def budget_requests(spark, d):
    return runs.budget(read(spark, d, "events").withColumn("n", F.col("event_id") % 4), 30, "user_id", "event_id", "n")


@query("budget_one_key", f"WITH RECURSIVE q AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 5 END AS g, event_id, event_id % 7 AS n FROM events), {_BUDGET.format(total=4001)} SELECT g, event_id, granted, remaining, exhausted FROM f")
def budget_one_key(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select(F.when(e % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id") % 5).alias("g"), "event_id", (e % 7).alias("n"))
    return runs.budget(rows, 4001, "g", "event_id", "n", tasks=8)


@query("run_estimates", """
WITH c AS (SELECT c_custkey, least(c_nationkey * 2, 120) AS v, least(c_nationkey * 3, 90) AS p FROM customer), t AS (SELECT *, v * 1860 + p * 2200 AS i, v * 250 + p * 300 AS o FROM c)
SELECT c_custkey, v::BIGINT AS verifier_calls, p::BIGINT AS panel_calls, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens, (i + o)::BIGINT AS total_tokens, round_even(i / 1e6 * 3 + o / 1e6 * 15, 4) AS usd FROM t""")
def run_estimates(spark, d):
    columns = runs.estimate_run(F.col("c_nationkey"))
    return read(spark, d, "customer").select("c_custkey", *[columns[k].cast("double" if k == "usd" else "long").alias(k) for k in ("verifier_calls", "panel_calls", "input_tokens", "output_tokens", "total_tokens", "usd")])


@query("lock_outcomes", """
WITH l AS (SELECT event_id, event_id % 2 = 0 AS held, event_id % 3 = 0 AS mine, event_id % 5 = 0 AS alive, event_id % 180 > 90 AS stale, event_id % 7 = 0 AS force FROM events),
r AS (SELECT *, CASE WHEN held AND NOT mine AND NOT force THEN CASE WHEN alive AND stale THEN 'live holder, stale heartbeat' WHEN alive THEN 'live holder' WHEN NOT stale THEN 'dead holder, fresh heartbeat' END END AS no FROM l)
SELECT event_id, no IS NULL AS granted, coalesce(no, CASE WHEN NOT held THEN 'acquired' WHEN mine THEN 'reacquired' ELSE 'reclaimed' END) AS outcome FROM r""")
def lock_outcomes(spark, d):
    e = F.col("event_id")
    out = runs.lock_outcome(e % 2 == 0, e % 3 == 0, e % 3 == 0, e % 5 == 0, (e % 180).cast("double"), e % 7 == 0)
    return read(spark, d, "events").select("event_id", *[v.alias(k) for k, v in out.items()])


@query("session_status", """
WITH s AS (SELECT DISTINCT l_orderkey AS session_id, l_linenumber AS phase, CASE WHEN l_linenumber <= l_orderkey % 8 THEN 'completed' WHEN l_linenumber = l_orderkey % 8 + 1 THEN 'in_progress' ELSE 'pending' END AS state FROM lineitem),
a AS (SELECT session_id, min(phase) FILTER (state <> 'completed') AS next_phase, arg_min(state, phase) FILTER (state <> 'completed') AS now, count(*) FILTER (state = 'completed') AS done, count(*) AS "of" FROM s GROUP BY 1)
SELECT session_id, next_phase, coalesce(now, 'complete') AS state, done, "of" FROM a""")
def session_status(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    state = F.when(n <= k % 8, "completed").when(n == k % 8 + 1, "in_progress").otherwise("pending")
    return runs.session_status(read(spark, d, "lineitem").select(k.alias("session_id"), n.alias("phase"), state.alias("state")).distinct())
