"""Raw verdicts made into verdicts bound to their claim, source and snapshot; a source's own grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import anchors
from .verdicts import LABELS

#: Grades from best to worst, what a flag takes away, the least grade of a kind of content.
GRADES = "ABCDE"
TO_LOWEST = ["no_author", "retracted", "predatory_journal", "content_farm"]
LEVELS_DOWN = {"no_date": 2, "broken_citations": 1}
LEAST_GRADE = {"definitive_claim": "B", "statistics": "C", "expert_opinion": "C", "background": "D", "prediction": "C"}


def of_high_risk(raw: DataFrame, risk: DataFrame) -> DataFrame:
    """The raw verdicts on high-risk claims (an atom's row counts as well): only these are anchored."""
    return raw.join(risk.filter("computed_risk = 'high'").select("claim_id").distinct(), "claim_id", "left_semi")


def build_verdicts(raw: DataFrame, claims: DataFrame, sources: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """Verdicts with anchors. raw: claim_id, source_id, label, evidence_span, span_state, model_id, prompt_hash;
    claims: claim_id, text; sources: source_id, quality_rating, content_hash, snapshot.

    With risk (claim_id, computed_risk), only high-risk claims' verdicts are built, and before any text is read.
    Only pairs of a known claim and source come out (``unknown_pairs`` has the rest). An unknown
    label is a failed, malformed verdict. Anchors are read where the state is done; else they don't
    hold, and the polarity counts as fine.
    """
    raw = raw if risk is None else of_high_risk(raw, risk)
    rows = raw.join(claims.select("claim_id", F.col("text").alias("claim")), "claim_id").join(sources.select("source_id", "quality_rating", "content_hash", "snapshot"), "source_id")
    known = F.coalesce(F.col("label").isin(LABELS), F.lit(False))
    state = F.when(known, F.col("span_state")).otherwise("failed")
    out = anchors.with_anchors(rows.withColumns({"evidence_span": F.coalesce("evidence_span", F.lit("")), "span_state": state}), "claim", "evidence_span", "snapshot")
    done = F.coalesce(F.col("span_state") == "done", F.lit(False))
    hold = lambda name, other: F.when(done, F.col(name)).otherwise(F.lit(other)).alias(name)
    return out.select(
        T.verdict_id(F.col("claim_id"), F.col("source_id"), F.lit("verifier"), F.col("model_id"), F.col("prompt_hash"), F.col("evidence_span")).alias("verdict_id"), "claim_id", "source_id", F.when(known, F.col("label")).alias("label"),
        "span_state", F.when(~known, "malformed_label").alias("fail_reason"), hold("span_matched", False), hold("char_start", -1), hold("char_end", -1), hold("numeric_ok", False), hold("polarity_ok", True), hold("anchors_ok", False),
        F.when(done, F.array_join("referent_flags", ",")).otherwise("").alias("referents"), F.upper(F.trim("quality_rating")).alias("source_grade"), F.col("content_hash").alias("snapshot_hash"),
    )


def unknown_pairs(raw: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, source_id, error of raw verdicts on a claim or source that isn't there."""
    bad = lambda side, key, word: raw.join(side.select(key).distinct(), key, "left_anti").select("claim_id", "source_id", F.lit(word).alias("error"))
    return bad(claims, "claim_id", "unknown claim").union(bad(sources, "source_id", "unknown source"))


def binding_errors(verdicts: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """verdict_id, error. verdicts: verdict_id, claim_id, source_id, snapshot_hash, source_grade, claim_text_hash;
    claims: claim_id, claim_text_hash; sources: source_id, content_hash, quality_rating.

    An unknown claim is no error here. Hashes and grades are compared where the side that binds them has one.
    """
    rows = verdicts.alias("v").join(sources.select("source_id", "content_hash", "quality_rating", F.lit(True).alias("there")), "source_id", "left").join(claims.select("claim_id", F.col("claim_text_hash").alias("expected")), "claim_id", "left")
    grade = lambda c: F.nullif(F.upper(F.trim(F.coalesce(F.col(c), F.lit("")))), F.lit(""))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    there = F.col("there").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(~there, F.lit("unknown source")), F.when(there & given("content_hash") & ~F.col("snapshot_hash").eqNullSafe(F.col("content_hash")), F.lit("snapshot hash")),
        F.when(there & grade("source_grade").isNotNull() & ~grade("source_grade").eqNullSafe(grade("quality_rating")), F.lit("grade")),
        F.when(there & given("expected") & given("claim_text_hash") & (F.col("claim_text_hash") != F.col("expected")), F.lit("claim hash")),
    ))
    return rows.select("verdict_id", F.explode(kinds).alias("error"))


def reduced_grade(grade: Column, flags: Column) -> Column:
    """The grade after red flags (an array of names): some go straight to the lowest, others down by levels, E at most."""
    start = F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.upper(F.trim(grade)))
    drop = sum((F.when(F.array_contains(flags, k), n).otherwise(0) for k, n in LEVELS_DOWN.items()), F.lit(0))
    lowest = F.arrays_overlap(flags, F.array(*[F.lit(k) for k in TO_LOWEST]))
    at = F.when(lowest, len(GRADES)).otherwise(F.least(start + drop, F.lit(len(GRADES))))
    return F.when(start > 0, F.substring(F.lit(GRADES), at.cast("int"), F.lit(1)))


def good_enough(grade: Column, content: Column) -> Column:
    """Does a grade reach the least one for a kind of content? Unknown kinds ask for nothing."""
    least = F.lit("E")
    for kind, g in LEAST_GRADE.items():
        least = F.when(content == kind, g).otherwise(least)
    return F.coalesce(F.upper(F.trim(grade)) <= least, F.lit(False))
