"""From verdicts and votes to decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels of a verdict, lenses of the panel, votes.
LABELS, LENSES, VOTES = ["entails", "contradicts", "neutral"], ["refute", "source_quality", "numeric_consistency"], ["entails", "contradicts", "neutral"]


def normalized_label(label: Column, state: Column, reason: Column) -> Column:
    bad = F.coalesce(reason.isin("validation_error", "malformed_label"), F.lit(False))
    return F.when(bad, "malformed").when(F.coalesce(state == "failed", F.lit(False)), "failed").when(label.isin(LABELS), label).otherwise("malformed")


def effective_label(normalized: Column, anchored: Column) -> Column:
    """What a verdict counts as: without an anchor, or failed, it says nothing."""
    firm = normalized.isin("entails", "contradicts") & F.coalesce(anchored, F.lit(False))
    return F.when(firm, normalized).otherwise("neutral")


def effective_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict per claim and source: panel over verifier, done over not, then the first; key_ord is the pair's first place."""
    rank = F.when(F.col("producer") == "panel", 1).when(F.col("producer") == "verifier", 0).otherwise(-1)
    done = F.coalesce((F.col("span_state") == "done").cast("int"), F.lit(0))
    pair = W.partitionBy("claim_id", "source_id")
    best = pair.orderBy(rank.desc(), done.desc(), F.col("_ord"))
    return verdicts.withColumns({"_rn": F.row_number().over(best), "key_ord": F.min("_ord").over(pair)}).filter("_rn = 1").drop("_rn")


def latest_votes(votes: DataFrame) -> DataFrame:
    """The last valid vote of each claim and lens, or else its last row."""
    voted = F.coalesce((F.col("vote_state") == "done") & F.col("vote").isin(VOTES), F.lit(False))
    last = W.partitionBy("claim_id", "lens").orderBy(voted.desc(), F.col("_ord").desc())
    return votes.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


def panel_consensus(votes: DataFrame) -> DataFrame:
    """claim_id, panel_consensus, n_valid, n_models, model_diverse, missing_lenses, failed_lenses, and votes and vote_models, maps with an entry for each lens (null: none)."""
    valid = F.coalesce(F.col("vote").isin(VOTES), F.lit(False)) & ~F.coalesce(F.col("vote_state") == "failed", F.lit(False))
    rows = latest_votes(votes).filter(F.col("lens").isin(LENSES)).withColumn("ok", valid)
    per = [F.max(F.when(F.col("lens") == x, F.col("ok").cast("int"))).alias(f"l_{x}") for x in LENSES]
    said = [F.max(F.when(F.col("lens") == x, F.col(c))).alias(f"{c}_{x}") for c in ("vote", "model_id") for x in LENSES]  # one row per lens
    tally = [F.sum((F.col("ok") & (F.col("vote") == v)).cast("int")).alias(f"v_{v}") for v in VOTES]
    agg = rows.groupBy("claim_id").agg(*per, *said, *tally, F.sum(F.col("ok").cast("int")).cast("int").alias("n_valid"), F.count_distinct(F.when(F.col("ok"), F.col("model_id"))).cast("int").alias("n_models"))
    named = lambda test: F.array_join(F.array_compact(F.array(*[F.when(test(F.col(f"l_{x}")), F.lit(x)) for x in LENSES])), ",")
    by_lens = lambda c: F.create_map(*[y for x in LENSES for y in (F.lit(x), F.col(f"{c}_{x}"))])
    top = F.lit("no_consensus")
    for v in reversed(VOTES):
        top = F.when(F.col(f"v_{v}") >= 2, v).otherwise(top)
    return agg.select("claim_id", F.when(F.col("n_valid") < 3, "no_consensus").otherwise(top).alias("panel_consensus"), "n_valid", "n_models", (F.col("n_models") >= 2).alias("model_diverse"), named(lambda c: c.isNull()).alias("missing_lenses"), named(lambda c: c == 0).alias("failed_lenses"), by_lens("vote").alias("votes"), by_lens("model_id").alias("vote_models"))


DECIDED = "status reason independent_entails conflict coverage_degraded panel_consensus proof_source_ids proof_grades refuted_by".split()


def decide(tuples: DataFrame, panel: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame:
    """claim_id and DECIDED of each claim from claim_id, source_id, cluster_id, grade, label (normalised), anchors_ok, key_ord.

    A claim holds with entailing sources from two independent clusters, the first source of one of
    them graded A or B; an anchored A or B contradiction refutes it, any other one beside an entailing
    source is a conflict. With a panel (claim_id, panel_consensus) it must agree, and its ``entails``
    overrules contradictions. Proofs, with their grades, are named for verified claims alone, and
    ``refuted_by`` for refuted ones; refuted claims and conflicts count no independent sources.
    claims (claim_id, and skipped_budget if known) adds those without a tuple. A tuple with a
    ``structural_error`` fails the job.
    """
    eff = effective_label(F.col("label"), F.col("anchors_ok"))
    if "structural_error" in tuples.columns:
        bad = F.coalesce("structural_error", F.lit("")) != ""
        eff = F.when(bad, F.raise_error(F.concat(F.col("claim_id").cast("string"), F.lit(": "), "structural_error")).cast("string")).otherwise(eff)
    grade = F.upper(F.coalesce("grade", F.lit("")))
    rows = tuples.withColumns({"eff": eff, "g": grade, "good": grade.isin("A", "B"), "cluster_id": F.coalesce("cluster_id", F.col("source_id").cast("string"))})
    entails, against = F.col("eff") == "entails", F.col("eff") == "contradicts"
    source = F.col("source_id").cast("string").alias("source")
    per = rows.groupBy("claim_id", "cluster_id").agg(
        F.min(F.when(entails, F.struct("key_ord", source, "g", "good"))).alias("rep"), F.max(against).alias("con"),
        F.collect_list(F.when(against & F.col("good"), F.struct("key_ord", source))).alias("hard"),
    )
    claim = per.groupBy("claim_id").agg(F.sort_array(F.collect_list("rep")).alias("reps"), F.max("con").alias("con"), F.sort_array(F.flatten(F.collect_list("hard"))).alias("hard"))
    if claims is not None:
        skipped = F.coalesce("skipped_budget", F.lit(False)) if "skipped_budget" in claims.columns else F.lit(False)
        claim = claims.select("claim_id", skipped.alias("skipped")).join(claim, "claim_id", "left")
    else:
        claim = claim.withColumn("skipped", F.lit(False))
    if panel is not None:
        claim = claim.join(panel.select("claim_id", "panel_consensus"), "claim_id", "left")
        agrees = F.coalesce(F.col("panel_consensus") == "entails", F.lit(False))
    else:
        claim = claim.withColumn("panel_consensus", F.lit(None).cast("string"))
        agrees = F.lit(False)
    n = F.size("reps")
    enough = (n >= 2) & F.exists("reps", lambda r: r["good"])
    passed = enough if panel is None else enough & agrees
    reason = (
        F.when(F.col("reps").isNull(), F.when(F.col("skipped"), "skipped_budget").otherwise("missing")).when((F.size("hard") > 0) & ~agrees, "ab_contradiction")
        .when((n > 0) & F.col("con") & ~agrees, "conflict").when(passed, "ok").when(enough, "panel_no_consensus").otherwise("insufficient_independent_entails")
    )
    told = claim.withColumn("reason", reason)
    r = F.col("reason")
    named = lambda field: F.when(r == "ok", F.transform("reps", lambda x: x[field])).otherwise(F.array().cast("array<string>"))
    return told.select(
        "claim_id", F.when(r == "ab_contradiction", "refuted").when(r == "ok", "verified").otherwise("unresolved").alias("status"), "reason",
        F.when(r.isin("ok", "panel_no_consensus", "insufficient_independent_entails"), n).otherwise(0).alias("independent_entails"), (r == "conflict").alias("conflict"), F.col("skipped").alias("coverage_degraded"), "panel_consensus",
        named("source").alias("proof_source_ids"), named("g").alias("proof_grades"), F.when(r == "ab_contradiction", F.transform("hard", lambda x: x["source"])).alias("refuted_by"),
    )


def registry_errors(sources: DataFrame) -> DataFrame:
    """source_id, error: missing or repeated ids, and grades other than A to E (blank is allowed)."""
    n = F.count(F.lit(1)).over(W.partitionBy("id"))
    first = F.row_number().over(W.partitionBy("id").orderBy("_ord"))
    rows = sources.withColumns({"n": n, "rn": first})
    kinds = F.array_compact(F.array(
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.lit("missing id")), F.when((F.col("rn") > 1) & (F.coalesce(F.col("id"), F.lit("")) != ""), F.lit("duplicate id")),
        F.when(~F.trim(F.coalesce("quality_rating", F.lit(""))).rlike("^[A-Ea-e]?$"), F.lit("bad grade")),
    ))
    return rows.select(F.col("id").alias("source_id"), F.explode(kinds).alias("error"))


def route(claims: DataFrame, risk: DataFrame, decisions: DataFrame) -> DataFrame:
    """claim_id, status, reason: low-risk claims need no proof; compounds wait; the rest as decided."""
    parents = risk.filter("atomized_from is null").select("claim_id", "computed_risk", "atomic")
    rows = claims.join(parents, "claim_id", "left").join(decisions.select("claim_id", F.col("status").alias("s"), F.col("reason").alias("r")), "claim_id", "left")
    high = F.coalesce(F.col("computed_risk") == "high", F.lit(False))
    split = ~F.coalesce("atomic", F.lit(True))
    return rows.select("claim_id", F.when(~high, "cite_write").when(split, "unresolved").otherwise(F.coalesce("s", F.lit("unresolved"))).alias("status"), F.when(~high, "non_high_risk").when(split, "needs_atomization").otherwise(F.coalesce("r", F.lit("missing"))).alias("reason"))


def validate(sources: DataFrame, claims: DataFrame, risk: DataFrame, verdicts: DataFrame, clusters: DataFrame | None = None, panel: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole of a run: errors (subject, error), decided (one row per claim) and outcome (one row with the exit code).

    sources: id, quality_rating, content_hash, _ord; claims: claim_id, claim_text_hash (any other column
    too); risk: claim_id, computed_risk, atomic, atomized_from; verdicts: as of ``effective_verdicts``
    with verdict_id, label, span_state, fail_reason, anchors_ok, snapshot_hash, source_grade,
    claim_text_hash; clusters: source_id, cluster_id (missing: the source itself); panel: claim_id,
    panel_consensus (without rows: no panel). decided has high_risk and the columns of ``decide``;
    low-risk claims are ``cite_write``. Exit 2: an error, or a high-risk row without a decision; 1: no
    high-risk claim is verified; else 0. Outputs are filters of decided, so nothing is computed twice.
    """
    from .bindings import binding_errors

    known = sources.filter("coalesce(id, '') <> ''").groupBy(F.col("id").alias("source_id")).agg(F.min(F.struct("_ord", "quality_rating", "content_hash")).alias("s")).select("source_id", "s.quality_rating", "s.content_hash")
    best = effective_verdicts(verdicts)
    errors = registry_errors(sources).select(F.col("source_id").alias("subject"), "error").unionByName(binding_errors(best, claims, known).select(F.col("verdict_id").alias("subject"), "error"))
    parents = risk.filter("atomized_from is null").groupBy("claim_id").agg(F.max(F.col("computed_risk") == "high").alias("high"), F.min(F.coalesce("atomic", F.lit(True))).alias("atomic"))
    rows = claims.select("claim_id").distinct().join(parents, "claim_id", "left").withColumn("high", F.coalesce("high", F.lit(False)))
    mine = best.join(rows.filter("high and atomic").select("claim_id"), "claim_id", "left_semi").join(known, "source_id", "left")
    own = F.col("source_id").cast("string")
    mine = mine.join(clusters.select("source_id", "cluster_id"), "source_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", own)) if clusters is not None else mine.withColumn("cluster_id", own)
    label = normalized_label(F.col("label"), F.col("span_state"), F.col("fail_reason"))
    tuples = mine.select("claim_id", "source_id", "cluster_id", F.trim("quality_rating").alias("grade"), label.alias("label"), "anchors_ok", "key_ord")
    voted = panel if panel is not None and panel.limit(1).count() else None
    found = decide(tuples, voted, rows.filter("high and atomic").select("claim_id"))
    rest = rows.filter("not (high and atomic)").select(
        "claim_id", F.when(F.col("high"), "unresolved").otherwise("cite_write").alias("status"), F.when(F.col("high"), "needs_atomization").otherwise("non_high_risk").alias("reason"), F.lit(0).alias("independent_entails"),
        F.lit(False).alias("conflict"), F.lit(False).alias("coverage_degraded"), F.lit(None).cast("string").alias("panel_consensus"), F.array().cast("array<string>").alias("proof_source_ids"), F.array().cast("array<string>").alias("proof_grades"),
        F.lit(None).cast("array<string>").alias("refuted_by"), "high",
    )
    decided = found.withColumn("high", F.lit(True)).unionByName(rest).withColumnRenamed("high", "high_risk")
    lost = parents.filter("high").join(claims.select("claim_id"), "claim_id", "left_anti")
    errors = errors.unionByName(lost.select(F.col("claim_id").cast("string").alias("subject"), F.lit("no decision").alias("error")))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = one(errors, "errors").join(F.broadcast(one(decided.filter("high_risk and status = 'verified'"), "verified")))  # one row each
    outcome = counts.select("errors", "verified", F.when(F.col("errors") > 0, 2).when(F.col("verified") == 0, 1).otherwise(0).alias("exit"))
    return {"errors": errors, "decided": decided, "outcome": outcome}
