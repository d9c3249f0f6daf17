"""High-risk claims: rules, and splitting of compound claims."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Portable word edges: Java and RE2 differ on \b beyond ASCII.
L, R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
#: What makes a claim risky, in reporting order.
MONTHS = "jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(tember)?|oct(ober)?|nov(ember)?|dec(ember)?"
VERBS = "ban(s|ned)?|bar(s|red)?|prohibit(ed|s)?|restrict(s|ed|ing)?|block(s|ed)?|require[ds]?|caused?|led to|results? in|increased?|decreased?|reduced?|ruled?|overturn(ed|s)?|uph(eld|olds?)|struck|legaliz(ed|es)?|mandate[ds]?|acquired?|merged?|fined?|approved?|rejected?|found|sued?|convicted?"
KOREAN_VERBS = "(금지|허용|의무화|인수|합병|판결|벌금|승인|기각)(했|한|함|됐|된)"
RULES = {
    "number": rf"{L}\p{{Nd}}([\p{{Nd}},.]*\p{{Nd}})?{R}",
    "percent": rf"(?i)\p{{Nd}}+(\.\p{{Nd}}+)?\s?%|{L}(percent|퍼센트){R}",
    "currency": f"(?i)[$€£¥₩]|{L}(usd|eur|gbp|krw|won|dollars?|euros?|원|달러){R}",
    "date": rf"(?i){L}(\p{{Nd}}{{4}}|\p{{Nd}}{{1,2}}/\p{{Nd}}{{1,2}}/\p{{Nd}}{{2,4}}|{MONTHS}){R}",
    "claim_verb": f"(?i){L}({VERBS}){R}|{KOREAN_VERBS}",
}
COORDINATORS = r"(?i),?\s+and\s+also\s+|,?\s+as\s+well\s+as\s+|,?\s+and\s+|;\s+|,?\s+그리고\s+|,?\s+또한\s+|\s+및\s+"


def matched_rules(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in RULES.items()]))


def is_risky(text: Column) -> Column:
    out = F.lit(False)
    for p in RULES.values():
        out = out | text.rlike(p)
    return out


def _once(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used: inside lambdas Spark shares nothing else."""
    return F.transform(F.array(value), then)[0]


def atoms_struct(text: Column) -> Column:
    """struct(atoms, atomic, needs): a compound is split only if each part is risky by itself."""
    verb = f"(?i)^(({VERBS}){R}|{KOREAN_VERBS})"

    def completed(x: Column) -> Column:
        parts, subject = x["parts"], x["subject"]
        own = F.transform(parts, lambda p, i: F.when((i > 0) & (subject != "") & p.rlike(verb), F.concat(subject, F.lit(" "), p)).otherwise(p))
        return _once(F.struct(own.alias("own"), x["t"].alias("t")), counted)

    def counted(x: Column) -> Column:
        return _once(F.struct(x["own"].alias("own"), x["t"].alias("t"), F.size(F.filter(x["own"], is_risky)).alias("risky")), told)

    def told(x: Column) -> Column:
        own, risky = x["own"], x["risky"]
        single = (F.size(own) < 2) | (risky < 2)
        safe = ~single & (risky == F.size(own))
        return F.struct(F.when(safe, own).otherwise(F.array(x["t"])).alias("atoms"), single.alias("atomic"), (~single & ~safe).alias("needs_atomization"))

    def parted(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, COORDINATORS), lambda p: F.trim(p)), lambda p: p != "")  # not F.trim itself: it would take a part's place as the characters to trim
        subject = F.trim(F.regexp_extract(t, f"(?is)^(.*?){L}(({VERBS}){R}|{KOREAN_VERBS})", 1))
        return _once(F.struct(t.alias("t"), parts.alias("parts"), subject.alias("subject")), completed)

    return _once(F.trim(F.coalesce(text, F.lit(""))), parted)


def rules_hash() -> str:
    """A digest of all rules, so that a run can pin them apart from the code."""
    body = json.dumps({"rules": RULES, "coordinators": COORDINATORS}, sort_keys=True, ensure_ascii=False)
    return "sha256:" + hashlib.sha256(body.encode()).hexdigest()


def _risk(rules: Column) -> Column:
    return F.when(F.size(rules) > 0, "high").otherwise("normal")


def _judged(claims: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return claims.select(F.col(id_col).cast("string").alias("claim_id"), atoms_struct(F.col(text_col)).alias("s"), matched_rules(F.coalesce(text_col, F.lit(""))).alias("rules"))


def _row(claim: Column, rules: Column, atomic: Column, needs: Column, source: Column, atom: Column) -> Column:
    return F.struct(claim.alias("claim_id"), _risk(rules).alias("computed_risk"), F.array_join(rules, ",").alias("rules"), atomic.alias("atomic"), needs.alias("needs_atomization"), source.alias("atomized_from"), atom.alias("atom_text"))


def classify(claims: DataFrame, id_col: str = "claim_id", text_col: str = "text") -> DataFrame:
    """One row per claim, and one per atom of a safely split claim (``<id>__a<n>``). Each text is read and split once."""
    claim, s, none = F.col("claim_id"), F.col("s"), F.lit(None).cast("string")
    atom = lambda a, i: _once(matched_rules(a), lambda r: _row(F.concat(claim, F.lit("__a"), i.cast("string")), r, F.lit(True), F.lit(False), claim, a))
    parent = F.array(_row(claim, F.col("rules"), s["atomic"], s["needs_atomization"], none, none))
    split = ~s["atomic"] & ~s["needs_atomization"]
    rows = F.when(split, F.concat(parent, F.transform(s["atoms"], atom))).otherwise(parent)
    return _judged(claims, id_col, text_col).select(F.inline(rows))


def classify_whole(claims: DataFrame, id_col: str = "claim_id", text_col: str = "text") -> DataFrame:
    """The rows of ``classify`` for the claims themselves, without their atoms."""
    row = _row(F.col("claim_id"), F.col("rules"), F.col("s.atomic"), F.col("s.needs_atomization"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return _judged(claims, id_col, text_col).select(row.alias("r")).select("r.*")
