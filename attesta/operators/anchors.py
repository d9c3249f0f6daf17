"""Anchors: is a cited span verbatim in its source, and do its numbers and polarity agree?"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words before a number that make it a label, units and scales after it, tolerance.
LABEL_WORDS = "version ver article art section sec chapter ch clause paragraph para rule figure fig table item no number rfc iso ieee part step phase tier level grade type class page vol volume edition appendix annex".split()
UNITS = "usd eur gbp krw won dollar dollars euro euros pound pounds kg km mph ghz mhz mb gb tb degree degrees year years month months day days hour hours people case cases death deaths pt pts bps".split()
SCALES = {"bn": 1e9, "b": 1e9, "billion": 1e9, "m": 1e6, "mm": 1e6, "million": 1e6, "k": 1e3, "thousand": 1e3, "tn": 1e12, "t": 1e12, "trillion": 1e12}
SCALE_WORDS = "bn billion mm million thousand trillion b m k t".split()
TOLERANCE = 0.0005
#: Terms that name different quantities.
REFERENTS = [
    ("scope", ["total", "overall", "company-wide", "companywide", "consolidated", "group-wide"], ["segment", "division", "data center", "data-center", "business unit", "product line"]),
    ("fiscal_calendar", ["fiscal"], ["calendar"]),
    ("period", ["annual", "full-year", "full year", "yearly"], ["quarterly", "quarter"]),
    ("risk", ["relative risk", "relative reduction"], ["absolute risk", "absolute reduction"]),
    ("margin", ["gross"], ["net"]),
]
_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")
_LABEL = re.compile(rf"(?:{'|'.join(LABEL_WORDS)})\.?$", re.I)
_LONGEST = max(map(len, LABEL_WORDS)) + 1
_RIGHT = re.compile(rf"\s*(?:(?P<pct>%|(?:percent|pct|퍼센트)\b)|(?P<scale>{'|'.join(SCALE_WORDS)})\b|(?P<unit>°|(?:{'|'.join(UNITS)})\b))", re.I)
#: The older measure's units: percent and scales (no mm, no pct) among them.
_RIGHT_OLD = re.compile(rf"\s*(?:[%°]|(?:percent|bn|billion|million|trillion|thousand|m|k|b|t|{'|'.join(UNITS)})\b)", re.I)
QUANTITIES = "array<struct<cls:string,val:double>>"


def read_quantities(text: str | None) -> list[tuple[str, float]]:
    """(class, value) of each number that states something: pct, mag, year or ver."""
    found = {}
    for m in _NUMBER.finditer(text or ""):
        digits, start = m.group().replace(",", ""), m.start()
        edge = start  # the end of what stands before the number and its blanks, however many
        while edge and text[edge - 1].isspace():
            edge -= 1
        before, after = text[max(0, edge - _LONGEST) : edge], _RIGHT.match(text, m.end())
        money = before[-1:] in tuple("$€£¥₩")
        value, kind = float(digits), None
        glued = start > 0 and (text[start - 1] in "/-#" or text[start - 1].isalpha())
        if after and after["pct"]:
            kind = "pct"
        elif after or money:
            kind = "mag"
            value *= SCALES[after["scale"].lower()] if after and after["scale"] else 1
        elif "." in digits:
            kind = "ver"
        elif glued or _LABEL.search(before):
            continue
        elif re.fullmatch("1[89]\\d\\d|20\\d\\d", digits):
            kind = "year"
        elif len(digits) > 1:
            kind = "mag"
        if kind:
            found[kind, round(value, 6)] = None
    return list(found)


def number_set(text: str | None, salient: bool = False) -> list[str]:
    """The numbers of a text as written, without commas, in order; salient: those that state something.

    The older measure, kept beside ``read_quantities``: no scale and no class. A decimal, a year and a
    number with a unit or currency count anywhere; other numbers need two digits and no label.
    """
    found = {}
    for m in _NUMBER.finditer(text or ""):
        digits, start = m.group().replace(",", ""), m.start()
        edge = start
        while edge and text[edge - 1].isspace():
            edge -= 1
        before = text[max(0, edge - _LONGEST) : edge]
        marked = "." in digits or _RIGHT_OLD.match(text, m.end()) or before[-1:] in tuple("$€£¥₩") or re.fullmatch("1[89]\\d\\d|20\\d\\d", digits)
        named = start > 0 and (text[start - 1] in "/-#" or text[start - 1].isalpha()) or _LABEL.search(before)
        if not salient or marked or (not named and len(digits) > 1):
            found[digits] = None
    return list(found)


def numbers(text: Column | str, salient: bool = False) -> Column:
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([number_set(t, salient) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(read, "array<string>")(text)


def _read_all(texts: pa.Array) -> pa.Array:
    first, cls, val = [0], [], []
    for t in texts:
        for c, v in read_quantities(t.as_py()):
            cls.append(c)
            val.append(v)
        first.append(len(cls))
    found = pa.StructArray.from_arrays([pa.array(cls, pa.string()), pa.array(val, pa.float64())], ["cls", "val"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), found)


def quantities(text: Column | str) -> Column:
    return F.arrow_udf(_read_all, QUANTITIES)(text)


def span_columns(span: Column, snapshot: Column) -> dict[str, Column]:
    """Place of a normalised span in a normalised snapshot."""
    at = F.when(span == "", F.lit(0)).otherwise(F.position(span, snapshot))
    hit = at > 0
    none = F.lit(-1)
    return {"span_matched": hit, "char_start": F.when(hit, at - 1).otherwise(none), "char_end": F.when(hit, at - 1 + F.char_length(span)).otherwise(none), "occurrence": F.when(hit, F.lit(0)).otherwise(none)}


def numeric_ok(claim: Column, span: Column) -> Column:
    """claim, span: columns of ``quantities``. Each measured value of the claim needs its like in the span."""

    def of(q: Column, cls: str) -> Column:
        return F.filter(q, lambda x: x["cls"] == cls)

    def each(cls: str, tol: float) -> Column:
        near = lambda c, s: F.abs(c["val"] - s["val"]) <= tol * F.greatest(F.abs(c["val"]), F.abs(s["val"]))
        return F.forall(of(claim, cls), lambda c: F.exists(of(span, cls), lambda s: near(c, s)))

    measured = each("mag", TOLERANCE) & each("pct", TOLERANCE) & each("year", 0.0)
    return measured & ((F.size(of(span, "ver")) == 0) | each("ver", 0.0))


def _told(text: Column) -> Column:
    """stem of each long word of a text, and whether a negation stands right before it."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({T.QUOTED_WORD})"), F.lit(1))
    before = F.concat(F.array(F.lit("")), words)  # one more than words: the last pair has no word
    return F.filter(F.zip_with(words, before, lambda w, p: F.struct(F.when(F.length(w) >= 4, T.stem(w)).alias("stem"), T.is_negation(p).alias("no"))), lambda e: e["stem"].isNotNull())


def _bound(parts: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """A function of parts, each evaluated once however often it is used."""
    return F.transform(F.array(F.struct(*[c.alias(k) for k, c in parts.items()])), use)[0]


def polarity_ok(claim: Column, span: Column) -> Column:
    """Do the first words of each stem that both have agree in negation?"""

    def agree(p: Column) -> Column:
        no = lambda side, s: F.element_at(side["no"], F.array_position(side["stem"], s).cast("int"))
        return F.forall(F.array_intersect(p["a"]["stem"], p["b"]["stem"]), lambda s: no(p["a"], s) == no(p["b"], s))

    # Fields of an array of structs are arrays: bound once more, they are drawn once.
    split = lambda p: F.struct(*[F.struct(p[k]["stem"].alias("stem"), p[k]["no"].alias("no")).alias(k) for k in "ab"])
    return _bound({"a": _told(claim), "b": _told(span)}, lambda p: F.transform(F.array(split(p)), agree)[0])


def referent_flags(claim: Column, span: Column) -> Column:
    """Names of the groups whose opposite terms stand on the two sides, as group:claim term:span term."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))

    def flags(p: Column) -> Column:
        test = lambda name, x, y: F.when(p["c"].contains(x) & p["s"].contains(y), F.lit(f"{name}:{x}:{y}"))
        none = F.array().cast("array<string>")
        # A term that stands on neither side is in no pair.
        return F.array_compact(F.flatten(F.array(*[F.when(p["c"].contains(a) | p["s"].contains(a), F.array(*[test(name, x, y) for b in right for x, y in ((a, b), (b, a))])).otherwise(none) for name, left, right in REFERENTS for a in left])))

    return _bound({"c": low(claim), "s": low(span)}, flags)


def with_anchors(df: DataFrame, claim: str = "claim", span: str = "span", snapshot: str = "snapshot") -> DataFrame:
    """Adds span_matched, char_start, char_end, numeric_ok, polarity_ok, referent_flags and anchors_ok."""
    base = df.withColumns({"__s": T.normalize(F.col(span)), "__t": T.normalize(F.col(snapshot)), "__qc": quantities(F.col(claim)), "__qs": quantities(F.col(span))})
    out = base.withColumns(span_columns(F.col("__s"), F.col("__t")) | {"numeric_ok": numeric_ok(F.col("__qc"), F.col("__qs")), "polarity_ok": polarity_ok(F.col(claim), F.col(span)), "referent_flags": referent_flags(F.col(claim), F.col(span))})
    return out.withColumn("anchors_ok", F.col("span_matched") & F.col("numeric_ok") & F.col("polarity_ok")).drop("__s", "__t", "__qc", "__qs")
