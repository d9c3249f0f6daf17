"""Probes of the whole chain: do wrong claims leak, do true ones pass, is independence faked?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, shuffled_joins
from . import anchors, cluster, verdicts


def anchored_refs(rows: DataFrame) -> DataFrame:
    """One row per ref of (claim_id, claim, panel, refs), refs an array of source_id, grade, cluster, verifier, span, snapshot."""
    flat = rows.select("claim_id", "claim", "panel", F.posexplode("refs").alias("key_ord", "r")).select("claim_id", "claim", "panel", "key_ord", "r.*")
    out = anchors.with_anchors(flat)
    return out.select("claim_id", "panel", "key_ord", "source_id", F.col("cluster").alias("cluster_id"), "grade", F.coalesce("verifier", F.lit("entails")).alias("label"), "span_matched", "numeric_ok", "polarity_ok", "anchors_ok", (F.size("referent_flags") > 0).alias("referent"))


def causes(refs: DataFrame, panel_first: bool) -> DataFrame:
    """claim_id, status, reason, independent_entails, referent, cause: the first step that keeps a claim from being verified.

    refs: as of ``anchored_refs``; a null panel is one that is off. Anchors come first; then the panel
    and independence, or the other way round. A verified claim has no cause.
    """
    refs = refs.withColumn("key_ord", F.col("key_ord").cast("long"))
    on, off = refs.filter("panel is not null"), refs.filter("panel is null")
    decided = verdicts.decide(on, on.groupBy("claim_id").agg(F.first("panel").alias("panel_consensus"))).unionByName(verdicts.decide(off))
    step = F.when(~F.col("span_matched"), "anchor:span").when(~F.col("numeric_ok"), "anchor:numeric").when(~F.col("polarity_ok"), "anchor:polarity").otherwise("anchor:unknown")
    lost = F.col("label").isin("entails", "contradicts") & ~F.col("anchors_ok")
    held = (F.col("label") == "entails") & F.col("anchors_ok")
    seen = refs.groupBy("claim_id").agg(
        F.min(F.when(lost, F.struct("key_ord", step.alias("step")))).alias("anchor"), F.count_distinct(F.when(held, F.col("cluster_id"))).alias("clusters"), F.max(F.coalesce(held & F.upper("grade").isin("A", "B"), F.lit(False))).alias("graded"),
        F.first("panel").alias("panel"), F.max("referent").alias("referent"),
    )
    both = decided.join(seen, "claim_id")
    no_panel = (F.col("reason") == "panel_no_consensus") | F.coalesce(F.col("panel") != "entails", F.lit(False))
    named = F.concat(F.lit("panel:"), F.coalesce("panel", F.lit("none"))) if panel_first else F.lit("panel:no_consensus")
    panel = [(no_panel, named)]
    apart = [(F.col("clusters") < 2, F.lit("independence:lt2_clusters")), (~F.col("graded"), F.lit("independence:no_ab_grade"))]
    order = [(F.col("reason") == "ab_contradiction", F.lit("panel:refuted")), *panel, *apart] if panel_first else [*apart, *panel]
    cause = F.when(F.col("status") == "verified", F.lit(None)).when(F.col("anchor").isNotNull(), F.col("anchor.step"))
    for test, word in order:
        cause = cause.when(test, word)
    return both.select("claim_id", "status", "reason", "independent_entails", "referent", cause.otherwise(F.concat(F.lit("other:"), F.col("reason"))).alias("cause"))


def leak_summary(found: DataFrame, rows: DataFrame) -> DataFrame:
    """group (headline or demo), n, leaked, leak_rate of wrong claims. rows: claim_id, demonstrates (not null: demo)."""
    both = rows.select("claim_id", F.when(F.col("demonstrates").isNull(), "headline").otherwise("demo").alias("group")).join(found, "claim_id")
    out = both.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "verified").alias("leaked"))
    return out.withColumn("leak_rate", F.bround(F.col("leaked") / F.col("n"), 4))


def recall_summary(found: DataFrame, rows: DataFrame) -> DataFrame:
    """headline, n, verified, recall of true claims. rows: claim_id, headline."""
    both = rows.select("claim_id", F.coalesce("headline", F.lit(False)).alias("headline")).join(found, "claim_id")
    out = both.groupBy("headline").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "verified").alias("verified"))
    return out.withColumn("recall", F.bround(F.col("verified") / F.col("n"), 4))


def ranked_causes(found: DataFrame) -> DataFrame:
    """cause, n; most frequent first, ties by name."""
    return found.filter("cause is not null").groupBy("cause").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "cause")


def independence(scenarios: DataFrame, similar=cluster.semantic_edges) -> DataFrame:
    """scenario_id, kind, n_sources, n_clusters, ok, would_verify. scenarios: scenario_id, kind, sources (id, grade, url, text, wire, byline).

    Every scenario is partitioned by itself, all of them at once. A collapse must leave one cluster,
    a separation as many as sources. would_verify: would these clusters let a claim through that
    every source entails?
    """
    scratch = Scratch(scenarios.sparkSession)
    with shuffled_joins(scenarios.sparkSession):
        flat = scenarios.select("scenario_id", "kind", F.posexplode("sources").alias("pos", "s")).select("scenario_id", "kind", "pos", "s.*")
        flat = flat.withColumns({"source": F.col("id"), "id": F.to_json(F.array(F.col("scenario_id").cast("string"), F.col("id")))})
        flat = scratch.save(flat)  # read by every step: without it each would gather the scenarios anew
        comp = cluster.compose(flat, scope_col="scenario_id", similar=similar)
        rows = flat.join(comp, flat.id == comp.source_id).drop("source_id")
        tuples = rows.select(F.col("scenario_id").alias("claim_id"), F.col("source").alias("source_id"), "cluster_id", F.coalesce("grade", F.lit("A")).alias("grade"), F.lit("entails").alias("label"), F.lit(True).alias("anchors_ok"), F.col("pos").cast("long").alias("key_ord"))
        passed = verdicts.decide(tuples).select(F.col("claim_id").alias("scenario_id"), (F.col("status") == "verified").alias("would_verify"))
        n = rows.groupBy("scenario_id", "kind").agg(F.count(F.lit(1)).alias("n_sources"), F.count_distinct("cluster_id").alias("n_clusters"))
        ok = F.when(F.col("kind") == "collapse", F.col("n_clusters") == 1).otherwise(F.col("n_clusters") == F.col("n_sources"))
        out = scratch.save(n.withColumn("ok", ok).join(passed, "scenario_id"))
    scratch.drop(flat)
    return out


def independence_summary(found: DataFrame) -> DataFrame:
    """kind, n, failed, failure_rate (of collapses: faked independence; else: merged too much), manufactured (failed collapses that would verify)."""
    out = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.count_if((F.col("kind") == "collapse") & ~F.col("ok") & F.col("would_verify")).alias("manufactured"))
    return out.withColumn("failure_rate", F.bround(F.col("failed") / F.col("n"), 4))


def agreement(labels: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Pairs (first, second, n_shared, kappa) and one row (min_kappa, mean_kappa, gate, n_disagreements). labels: labeler, unit_id, label.

    Cells of each pair of labelers are counted by a self-join on the unit; there are as many rows per
    unit as pairs of its labelers.
    """
    l, r = labels.alias("l"), labels.alias("r")
    both = l.join(r, "unit_id").filter("l.labeler < r.labeler").select("unit_id", F.col("l.labeler").alias("first"), F.col("r.labeler").alias("second"), F.col("l.label").alias("x"), F.col("r.label").alias("y"))
    key = ["first", "second"]
    cells = both.groupBy(*key, "x", "y").agg(F.count(F.lit(1)).alias("c"))
    n = cells.groupBy(*key).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    mx, my = cells.groupBy(*key, F.col("x").alias("v")).agg(F.sum("c").alias("p")), cells.groupBy(*key, F.col("y").alias("v")).agg(F.sum("c").alias("q"))
    chance = mx.join(my, [*key, "v"]).groupBy(*key).agg(F.sum(F.col("p") * F.col("q")).alias("pq"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("pq", F.lit(0)) / (F.col("n") * F.col("n"))
    value = F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    pairs = n.join(chance, key, "left").select(*key, F.col("n").alias("n_shared"), F.bround(value, 4).alias("kappa"))
    unlike = both.filter("x <> y").select("unit_id").distinct().agg(F.count(F.lit(1)).alias("n_disagreements"))
    low = pairs.agg(F.min("kappa").alias("min_kappa"), F.bround(F.avg("kappa"), 4).alias("mean_kappa"))
    gate = F.when(F.coalesce(F.col("min_kappa") >= threshold, F.lit(False)), "PASS").otherwise("FAIL")
    return pairs, low.join(F.broadcast(unlike)).select("min_kappa", "mean_kappa", gate.alias("gate"), "n_disagreements")  # one row each


def disagreements(labels: DataFrame) -> DataFrame:
    """unit_id, labels (a map of labeler to label) of the units that have different labels: each labeler there is at odds with some other."""
    units = labels.groupBy("unit_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("labeler", "label")))).alias("labels"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return units.filter("lo <> hi").select("unit_id", "labels")


def gold_status(gold: DataFrame, sources: DataFrame, anchored: DataFrame, clusters: DataFrame) -> DataFrame:
    """claim_id, status by the same rules from people's labels, without a panel.

    gold: claim_id, source_id, label, key_ord; sources: source_id, quality_rating; anchored: claim_id,
    source_id, anchors_ok (missing: holds); clusters: source_id, cluster_id (missing: its own).
    """
    rows = gold.join(sources.select("source_id", F.col("quality_rating").alias("grade")), "source_id", "left").join(anchored.select("claim_id", "source_id", "anchors_ok"), ["claim_id", "source_id"], "left").join(clusters.select("source_id", "cluster_id"), "source_id", "left")
    return verdicts.decide(rows.withColumn("anchors_ok", F.coalesce("anchors_ok", F.lit(True)))).select("claim_id", "status")


def score(system: DataFrame, gold: DataFrame, strata: DataFrame) -> DataFrame:
    """stratum (null: all), n, false_entail, false_neg, tp, precision, recall of claims verified. system, gold: claim_id, status."""
    both = system.select("claim_id", F.col("status").alias("s")).join(gold.select("claim_id", F.col("status").alias("g")), "claim_id", "full").join(strata.select("claim_id", "stratum"), "claim_id", "left")
    yes = lambda c: F.coalesce(F.col(c) == "verified", F.lit(False))
    rows = both.select(F.coalesce("stratum", F.lit("unspecified")).alias("stratum"), yes("s").alias("s"), yes("g").alias("g"))
    out = rows.rollup("stratum").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") & ~F.col("g")).alias("false_entail"), F.count_if(~F.col("s") & F.col("g")).alias("false_neg"), F.count_if(F.col("s") & F.col("g")).alias("tp"))
    part = lambda miss: F.bround(F.col("tp") / F.nullif(F.col("tp") + F.col(miss), F.lit(0)), 4)
    return out.withColumns({"precision": part("false_entail"), "recall": part("false_neg")})
