"""The report gate: does a written body assert only what was verified?"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import rate
from .filters import passing, spread
from .risk import matched_rules

GRAM = 6
#: Runs of claims in a task.
RUNS = 1 << 20


def backstop(sentences: DataFrame, verified: DataFrame) -> DataFrame:
    """text, rules, claim_id, reason of high-risk sentences that no verified claim backs. verified: claim_id."""
    rules = matched_rules(F.coalesce("text", F.lit("")))
    risky = sentences.withColumn("r", rules).filter(F.size("r") > 0)
    loose = risky.join(verified.select("claim_id").filter("claim_id is not null").distinct(), "claim_id", "left_anti")
    reason = F.when(F.coalesce("claim_id", F.lit("")) == "", "no claim").otherwise(F.concat(F.lit("non-verified claim "), F.col("claim_id")))
    return loose.select("text", F.array_join("r", ",").alias("rules"), "claim_id", reason.alias("reason"))


def citation_errors(body: DataFrame, sources: DataFrame) -> DataFrame:
    """id, kind: dangling (cited, not a source) and orphan (a source, not cited). body: text; sources: id."""
    cited = body.select(F.explode(T.citations(F.col("text"))).alias("id")).distinct()
    known = sources.select("id").filter("coalesce(id, '') <> ''").distinct()
    return cited.join(known, "id", "left_anti").withColumn("kind", F.lit("dangling")).union(known.join(cited, "id", "left_anti").withColumn("kind", F.lit("orphan")))


def missing_proof(verified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """claim_id of verified claims with a proof source that has no anchored entailing verdict. verified: claim_id, proof_source_ids."""
    proofs = verified.select("claim_id", F.explode("proof_source_ids").alias("source_id"))
    return proofs.join(verdicts.filter("label = 'entails' and anchors_ok").select("claim_id", "source_id").distinct(), ["claim_id", "source_id"], "left_anti").select("claim_id").distinct()


def uncovered(risk: DataFrame, decided: DataFrame) -> DataFrame:
    """claim_id of high-risk claims without a terminal status."""
    return risk.filter("computed_risk = 'high'").select("claim_id").distinct().join(decided.select("claim_id"), "claim_id", "left_anti")


def present(claims: DataFrame, body: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """claim_id of claims whose id, or a run of six content characters, stands in the body.

    Runs that texts of ``shared`` have don't count. claims: claim_id, text; body, shared: text. A
    run lies within one file of the body. Every step is an equi-join on runs of one length; of the body only
    runs that pass a filter of what is asked for are shuffled.
    """
    return _present(claims.withColumn("kind", F.lit("")), body, shared).select("claim_id")


#: The report as text: what each line tells, and of which of its columns.
LINES = (
    ("verdict", "{verdict}, manifest {manifest_ok}"), ("citations", "{citation_resolution_rate} resolved, {citations_dangling} of {citations_total} dangling"), ("proof", "{missing_entailment_proof_rate} of {high_risk_verified} verified claims without one, {span_match_rate} of spans found"),
    ("leaks", "{leak_rate}, {leaks} of {unresolved} unresolved and {refuted} refuted claims"), ("coverage", "{verified_coverage_rate} of verified claims told, {coverage_missing} without a status"), ("sources", "{orphan_source_rate} of {sources_total} orphaned"), ("verdicts", "{degraded_verdict_rate} degraded, {cite_write} claims to cite"),
)


def report_text(found: DataFrame, details: dict[str, DataFrame] | None = None) -> DataFrame:
    """line (from 1), text of a report: one row for each of LINES, rates as per cent; then a row for each row of the details (name to a table of id), in order of name and id."""
    rates = [c for c in found.columns if c.endswith("_rate")]

    def shown(template: str) -> Column:
        parts: list[Column] = []
        for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
            parts.append(F.lit(piece) if i % 2 == 0 else F.format_string("%.1f%%", F.col(piece) * 100) if piece in rates else F.col(piece).cast("string"))
        return F.concat(*parts)

    rows = F.array(*[F.struct(F.lit(i).alias("part"), F.lit("").alias("id"), F.concat(F.lit(f"{n}: "), shown(t)).alias("text")) for i, (n, t) in enumerate(LINES)])
    out = found.select(F.explode(rows).alias("r")).select("r.*")
    for i, (name, df) in enumerate(sorted((details or {}).items())):
        out = out.unionByName(df.select(F.lit(len(LINES) + i).alias("part"), F.col("id").cast("string").alias("id"), F.concat(F.lit(f"  {name}: "), F.col("id").cast("string")).alias("text")))
    # A report's own lines and faults: what a person reads.
    return out.select(F.row_number().over(W.orderBy("part", "id", "text")).alias("line"), "text")


def _present(claims: DataFrame, body: DataFrame, shared: DataFrame | None, exempt: str | None = None) -> DataFrame:
    """kind, claim_id of claims in the body, which is read once for all kinds and once for ids. Runs of ``shared`` count for the exempt kind alone."""
    runs = lambda d, *key: d.select(*key, F.explode(T.char_ngrams(T.content_only(F.col("text")), GRAM)).alias("g"))
    claims, body = spread(claims, "claim_id"), spread(body)
    size = claims.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    dealt = lambda d: d.repartition(1 + size // RUNS, "g")
    mine = runs(claims, "kind", "claim_id")
    # The claims' runs, the longest table, are shuffled once, a bounded share to a task: what the body has of them meets the shared ones first.
    told = passing(runs(body), "g", mine.select("g")).distinct()
    if shared is not None:
        told = told.join(runs(spread(shared)).distinct().withColumn("common", F.lit(True)), "g", "left")
        free = F.col("common").isNull() if exempt is None else F.col("common").isNull() | (F.col("kind") == F.lit(exempt))
    by_text = dealt(mine).join(dealt(told), "g").filter(free if shared is not None else F.lit(True)).select("kind", "claim_id")
    ids = claims.select("kind", "claim_id", F.length("claim_id").alias("n")).filter("n > 0").distinct()
    # The few distinct lengths of ids, not the ids.
    lengths = [r[0] for r in ids.select("n").distinct().collect()]
    at = F.concat(F.array().cast("array<string>"), *[T.char_ngrams(F.col("text"), n) for n in lengths])
    named = passing(body.select(F.explode(at).alias("claim_id")), "claim_id", ids.select("claim_id")).distinct()
    by_id = ids.join(named, "claim_id", "left_semi").select("kind", "claim_id")
    return by_text.union(by_id).distinct()


def report(sources: DataFrame, ledger: DataFrame, risk: DataFrame, verdicts: DataFrame, decided: DataFrame, body: DataFrame, manifest_ok: bool = True) -> DataFrame:
    """One row: verdict (PASS or FAIL), seven rates, counts.

    sources: id; ledger: claim_id, text; risk: claim_id, computed_risk; verdicts: claim_id, source_id,
    label, anchors_ok, span_matched, span_state, fail_reason; decided: claim_id, status, high_risk,
    proof_source_ids; body: text. Rates of nothing are 1 where high is good and 0 where low is.
    """
    verified = decided.filter("high_risk and status = 'verified'")
    open_ = decided.filter("status in ('unresolved', 'refuted')").select("claim_id", "status")
    told = verified.select("claim_id").join(ledger, "claim_id")
    errors = citation_errors(body, sources)
    lost = missing_proof(verified, verdicts)
    proofs = verified.select("claim_id", F.explode("proof_source_ids").alias("source_id")).distinct()
    shown = verdicts.join(proofs, ["claim_id", "source_id"], "left_semi")
    both = open_.select("claim_id").join(ledger, "claim_id").withColumn("kind", F.lit("open")).unionByName(told.withColumn("kind", F.lit("told")))
    there = _present(both.select("kind", "claim_id", "text"), body, told, "told")
    one = F.count(F.lit(1))
    n = lambda df, name, what=one: df.agg(what.alias(name))
    some = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    parts = [
        verified.agg(one.alias("high_risk_verified")), decided.agg(some(F.col("status") == "cite_write").alias("cite_write"), some(F.col("status") == "unresolved").alias("unresolved"), some(F.col("status") == "refuted").alias("refuted")),
        body.select(F.explode(T.citations(F.col("text"))).alias("id")).distinct().agg(one.alias("citations_total")), errors.agg(some(F.col("kind") == "dangling").alias("citations_dangling"), some(F.col("kind") == "orphan").alias("orphan_sources")),
        n(sources.select("id").filter("coalesce(id, '') <> ''").distinct(), "sources_total"), there.agg(some(F.col("kind") == "open").alias("leaks"), some(F.col("kind") == "told").alias("covered")), n(lost, "missing_proof"), n(uncovered(risk, decided), "coverage_missing"),
        shown.agg(one.alias("shown"), some(F.col("span_matched")).alias("matched")), verdicts.agg(one.alias("all_verdicts"), some((F.col("span_state") == "failed") | (F.coalesce("fail_reason", F.lit("")) != "")).alias("degraded")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(F.broadcast(p))  # both sides have one row
    c = F.col
    failed = (c("leaks") > 0) | (c("citations_dangling") > 0) | (c("missing_proof") > 0) | (c("coverage_missing") > 0) | F.lit(not manifest_ok)
    rates = {
        "citation_resolution_rate": rate(c("citations_total") - c("citations_dangling"), c("citations_total"), 1.0), "missing_entailment_proof_rate": rate(c("missing_proof"), c("high_risk_verified"), 0.0),
        "span_match_rate": rate(c("matched"), c("shown"), 1.0), "verified_coverage_rate": rate(c("covered"), c("high_risk_verified"), 1.0), "leak_rate": rate(c("leaks"), c("unresolved") + c("refuted"), 0.0),
        "orphan_source_rate": rate(c("orphan_sources"), c("sources_total"), 0.0), "degraded_verdict_rate": rate(c("degraded"), c("all_verdicts"), 0.0),
    }
    counts = ["high_risk_verified", "cite_write", "unresolved", "refuted", "citations_total", "citations_dangling", "sources_total", "orphan_sources", "leaks", "missing_proof", "coverage_missing"]
    return row.select(F.when(failed, "FAIL").otherwise("PASS").alias("verdict"), *[v.alias(k) for k, v in rates.items()], (c("coverage_missing") == 0).alias("coverage_ok"), F.lit(manifest_ok).alias("manifest_ok"), *counts)


def strict_handoff(decided: DataFrame, risk: DataFrame) -> DataFrame:
    """claim_id, reason of the claims that a stricter second look takes: unresolved and high-risk, nothing else."""
    high = risk.filter("computed_risk = 'high'").select("claim_id").distinct()
    return decided.filter("status = 'unresolved'").select("claim_id", "reason").join(high, "claim_id", "left_semi")


def version_drift(stored: DataFrame, running: DataFrame) -> DataFrame:
    """component, stored, running where the versions differ or one side lacks it. Both: component, version."""
    both = stored.select("component", F.col("version").alias("stored")).join(running.select("component", F.col("version").alias("running")), "component", "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("running")))


def lens_of(models: Column, position: Column) -> Column:
    """The model of a lens, by its place: named models, sorted, in turn; null without any."""
    named = F.sort_array(F.filter(models, lambda m: F.coalesce(m, F.lit("")) != ""))
    return F.when(F.size(named) > 0, F.try_element_at(named, (F.pmod(position, F.greatest(F.size(named), F.lit(1))) + 1).cast("int")))
