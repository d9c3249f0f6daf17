"""Measures: agreement, confusion by stratum, leaks, report gate, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .filters import passing

#: Caps on model calls.
MAX_VERIFIER, MAX_PANEL, MAX_CONCURRENT, PANEL_LENSES = 120, 90, 3, 3


def kappa(pairs: DataFrame) -> DataFrame:
    """n, observed, expected and Cohen's kappa (four places) of the columns x and y."""
    cells = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    mx, my = cells.groupBy(F.col("x").alias("v")).agg(F.sum("c").alias("p")), cells.groupBy(F.col("y").alias("v")).agg(F.sum("c").alias("q"))
    chance = mx.join(my, "v").agg(F.coalesce(F.sum(F.col("p") * F.col("q")), F.lit(0)).alias("pq"))
    po, pe = F.col("same") / F.col("n"), F.col("pq") / (F.col("n") * F.col("n"))
    value = F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    # Both sides have one row.
    return n.join(F.broadcast(chance)).select(F.col("n").cast("long").alias("n"), F.bround(po, 4).alias("observed"), F.bround(pe, 4).alias("expected"), F.bround(value, 4).alias("kappa"))


def confusion(rows: DataFrame, stratum: str = "stratum") -> DataFrame:
    """n, tp, fp, fn, tn, precision and recall of ``said`` against ``gold`` per stratum and overall (null)."""
    count = lambda c: F.sum(c.cast("long")).alias
    said, gold = F.col("said"), F.col("gold")
    out = rows.rollup(stratum).agg(F.count(F.lit(1)).alias("n"), count(said & gold)("tp"), count(said & ~gold)("fp"), count(~said & gold)("fn"), count(~said & ~gold)("tn"))
    rate = lambda a, b: F.bround(F.col("tp") / F.nullif(F.col(a) + F.col(b), F.lit(0)), 4)
    return out.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn")})


def leaks(texts: DataFrame, body: DataFrame, n: int = 6) -> DataFrame:
    """id, shared: how many distinct n-grams of a text's content the body has. Both sides: id, text."""
    grams = lambda d: d.select("id", F.explode(T.char_ngrams(T.content_only(F.col("text")), n)).alias("g"))
    mine = grams(texts)
    wanted = mine.select("g").distinct()
    # Of the body's n-grams only those that pass the filter are shuffled.
    seen = passing(grams(body).select("g"), "g", wanted).distinct().join(wanted, "g", "left_semi")
    hits = mine.join(seen, "g").groupBy("id").agg(F.count_distinct("g").alias("shared"))
    return texts.select("id").join(hits, "id", "left").select("id", F.coalesce("shared", F.lit(0)).alias("shared"))


def rate(part: Column, whole: Column, empty: float) -> Column:
    return F.bround(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(empty)), 3)


def estimate_calls(high_risk: Column, per_claim: float = 2.0, share: float = 1.0) -> dict[str, Column]:
    """Verifier and panel calls of a run under the caps."""
    raw = F.greatest(F.bround(high_risk * per_claim, 0).cast("long"), F.lit(0))
    candidates = F.ceil(F.greatest(high_risk, F.lit(0)) * share).cast("long")
    panel = candidates * PANEL_LENSES
    return {"verifier_calls": F.least(raw, F.lit(MAX_VERIFIER)), "panel_calls": F.least(panel, F.lit(MAX_PANEL)), "verifier_capped": raw > MAX_VERIFIER, "panel_capped": panel > MAX_PANEL}


def cap_concurrency(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(n, F.lit(MAX_CONCURRENT)))


def findings_verdict(findings: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """contradicts with a refutation or qualification of grade A or B (of either case) or without a grade, else entails.

    ``keys`` has the claims that must be there: neutral without a finding. Null flags are false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    refutes = yes(F.col("refutes"))
    hit = (refutes | yes(F.col("qualifies"))) & F.upper(F.coalesce("quality_rating", F.lit(""))).isin("A", "B", "")
    summaries = F.transform(F.slice(F.sort_array(F.collect_list(F.when(hit, F.struct("_ord", F.coalesce("summary", F.lit("")).alias("summary"))))), 1, 3), lambda x: x["summary"])
    agg = findings.groupBy(key).agg(F.max(hit).alias("hit"), F.max(hit & refutes).alias("ref"), F.array_join(summaries, "|").alias("first_three"))
    if keys is not None:
        agg = keys.select(key).distinct().alias("k").join(agg.alias("a"), F.col(f"k.{key}").eqNullSafe(F.col(f"a.{key}")), "left").select(f"k.{key}", "hit", "ref", "first_three")
    none = F.col("hit").isNull()
    verdict = F.when(none, "neutral").when(F.col("hit"), "contradicts").otherwise("entails")
    reason = F.when(none, "no_contrary_search").when(F.col("ref"), "refuted").when(F.col("hit"), "material_qualifier_omitted").otherwise("no_contrary_evidence_found")
    return agg.select(key, verdict.alias("verdict"), reason.alias("reason"), F.when(F.col("hit"), F.col("first_three")).alias("summaries"))


def unit_budget(requests: DataFrame, total: int, key: str, order: str) -> DataFrame:
    """Adds granted: requests of one unit each are granted until the key's total is spent."""
    from pyspark.sql import Window as W

    return requests.withColumn("granted", F.row_number().over(W.partitionBy(key).orderBy(order)) <= total)


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row (by _ord, where the table has it) of each key."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.col("_ord") if "_ord" in rows.columns else F.lit(0)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def replay_plan(refs: DataFrame, verdicts: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The refs with action and reason: what a second run may take from the first.

    refs: claim_id, source_id and any others. verdicts: claim_id, source_id, _ord, producer, claim_text_hash,
    snapshot_hash; the last one of a pair by a verifier (or by nobody named) holds. claims: claim_id,
    claim_text_hash. sources: source_id, content_hash. frozen: both hashes are as they were; requery: no verdict, or
    the claim has another text now; tamper: only the stored source changed. What isn't there has a null hash.
    """
    held = _last(verdicts.filter("coalesce(producer, 'verifier') = 'verifier'").select("claim_id", "source_id", "_ord", "claim_text_hash", "snapshot_hash"), "claim_id", "source_id").withColumn("_judged", F.lit(True))
    now = _last(claims, "claim_id").select("claim_id", F.col("claim_text_hash").alias("_claim"))
    kept = _last(sources, "source_id").select("source_id", F.col("content_hash").alias("_source"))
    both = refs.join(held, ["claim_id", "source_id"], "left").join(now, "claim_id", "left").join(kept, "source_id", "left")
    claim, source = F.col("claim_text_hash").eqNullSafe(F.col("_claim")), F.col("snapshot_hash").eqNullSafe(F.col("_source"))
    none = F.col("_judged").isNull()
    action = F.when(none | ~claim, "requery").when(source, "frozen").otherwise("tamper")
    reason = F.when(none, "no_verdict").when(~claim, "claim_changed").when(~source, "snapshot_changed")
    return both.select(*refs.columns, action.alias("action"), reason.alias("reason"))
