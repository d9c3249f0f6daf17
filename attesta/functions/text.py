"""Column builders for text: normal form, hashes, tokens, n-grams, URLs."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that the normal form folds, and what they become.
FOLD = {"'": "‘’‚‛", '"': "“”„‟", "-": "‐‑‒–—―−", " ": "    "}
#: Words that are no key terms; negations.
STOP_WORDS = "the a an of to in on for and or is are was were be by with that this it its as at all any under from into real time".split()
NEGATIONS = ["not", "never", "cannot", "neither", "nor", "without", "no"]
KOREAN_NEGATIONS = ["않", "못", "아니", "없"]
#: Query keys, by prefix, that do not identify a page.
TRACKING = ["utm_", "fbclid", "gclid", "mc_", "ref", "ref_src", "cmpid", "igshid"]
#: Words that ask for exceptions and corrections.
REFUTATIONS = ["exceptions", "unless", "except", "limitations", "caveats", "however criticism", "disputed", "challenged", "overturned", "is false", "not true", "myth", "correction", "retracted", "walked back"]

WORD = r"[\p{L}\p{N}_]+"
PLAIN_WORD = "[0-9A-Za-z가-힣]+"
QUOTED_WORD = "[0-9A-Za-z가-힣']+"


#: Texts of a batch that are Python strings at a time.
PIECE = 64


def _each(texts: pa.Array, form: Callable[[str], str]) -> pa.Array:
    """A function of each text; only some texts at a time are Python strings."""
    parts = [pa.array([None if t is None else form(t) for t in texts.slice(i, PIECE).to_pylist()], pa.string()) for i in range(0, len(texts), PIECE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def _compat(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: html.unescape(unicodedata.normalize("NFKC", t)))


#: Entities that end with a semicolon.
_CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_entity(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])


def _compat_closed(texts: pa.Array) -> pa.Array:
    return _each(texts, lambda t: _CLOSED.sub(_closed_entity, unicodedata.normalize("NFKC", t)))


def fold(text: Column) -> Column:
    """Quotes, dashes, ellipsis and blanks in one form; white space collapsed and trimmed."""
    old = "".join(FOLD.values())
    new = "".join(k * len(v) for k, v in FOLD.items())
    one = F.replace(F.translate(F.coalesce(text, F.lit("")), old, new), F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(one, r"(?U)\s+", " "))


def normalize(text: Column, open_entities: bool = True) -> Column:
    """Normal form for anchoring: NFKC and HTML entities (one Arrow function), then ``fold``.

    Old entities count without their semicolon too, as in browsers (``&amp`` at a cut), unless open_entities is False.
    """
    compat = F.arrow_udf(_compat if open_entities else _compat_closed, "string")
    # ASCII without entities is its own compatibility form and skips Python's part of the work.
    return fold(F.when(text.rlike("[^\\x00-\\x7F]|&"), compat(text)).otherwise(text))


def canonical_text(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_text(text), 256))


def claim_text_hash(text: Column) -> Column:
    """The text as it is, unlike ``content_hash``."""
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(text, F.lit("")), 256))


def verdict_id(*parts: Column) -> Column:
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("v_"), F.substring(F.sha2(joined, 256), 1, 16))


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), F.lit(1))


def key_terms(text: Column, n: int = 8) -> Column:
    """The first n distinct words of three letters or more that are no stop words."""
    return F.slice(F.array_distinct(F.filter(tokens(text, PLAIN_WORD), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))), 1, n)


def refutation_queries(claim: Column, most: int = 10) -> Column:
    """Searches that would surface what a claim leaves out."""
    base = F.regexp_replace(F.trim(F.coalesce(claim, F.lit(""))), r"\.+$", "")
    key = F.array_join(key_terms(base), " ")
    direct = F.when(base != "", F.array(F.concat(F.lit("is it true that "), base))).otherwise(F.array().cast("array<string>"))
    by_key = F.array(F.concat(key, F.lit(" exceptions OR limitations")), *[F.concat(key, F.lit(" " + op)) for op in REFUTATIONS])
    return F.slice(F.array_distinct(F.concat(direct, F.when(key != "", by_key).otherwise(F.array().cast("array<string>")))), 1, most)


def expand_query(query: Column) -> Column:
    """The query, its longer words, and the query in quotes."""
    words = tokens(query)
    key = F.array_join(F.filter(words, lambda t: F.length(t) > 3), " ")
    plain = F.array(query)
    keyed = F.when((key != "") & (key != F.lower(query)), F.array(key)).otherwise(F.array().cast("array<string>"))
    quoted = F.when(F.size(words) > 1, F.array(F.concat(F.lit('"'), query, F.lit('"')))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(plain, keyed, quoted))


def content_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9A-Za-z가-힣%]", "")


def char_ngrams(text: Column, n: int = 6) -> Column:
    """Distinct runs of n characters, in one linear pass (a lookahead matches at every place)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def stem(token: Column) -> Column:
    return F.substring(F.lower(token), 1, 5)


def is_negation(token: Column) -> Column:
    t = F.lower(token)
    out = t.isin(NEGATIONS) | t.endswith("n't")
    for k in KOREAN_NEGATIONS:
        out = out | token.contains(k)
    return out


def byline(text: Column) -> Column:
    one = F.trim(F.regexp_replace(F.trim(text), r"(?U)\s+", " "))
    return F.nullif(F.lower(F.trim(F.regexp_replace(one, "(?i)^by ", ""))), F.lit(""))


def wire(text: Column) -> Column:
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def source_text(*choices: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices], F.lit(""))


def _unquoted(part: Column) -> Column:
    """A query's key or value: ``+`` is a blank, escapes are UTF-8; a percent sign that starts no escape stays."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9a-fA-F]{2})", "%25"))


def _quoted(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """One spelling of a page's address: https, lower case, no www., trackers or fragment; keys and values sorted, in one escaping.

    Null and empty: empty. Without a scheme the whole is a path, which stays apart from any host's; ``//`` alone
    starts a host. Keys without a value go.
    """
    u = F.translate(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"(?U)^[\s\x00-\x1F]+|\s+$", ""), "\t\r\n", "")
    rest = F.regexp_replace(u, "^[a-z][a-z0-9+.-]*:", "")
    host = F.regexp_replace(F.regexp_extract(rest, "^//([^/?#]*)", 1), r"^www\.", "")
    tail = F.regexp_replace(F.regexp_replace(rest, "^//[^/?#]*", ""), "(?s)#.*$", "")
    bare = F.rtrim(F.regexp_extract(tail, r"^[^?]*", 0), F.lit("/"))
    path = F.when(bare == "", "/").otherwise(bare)
    given = F.filter(F.split(F.regexp_extract(tail, r"(?s)\?(.*)$", 1), "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    pairs = F.transform(given, lambda p: F.struct(_unquoted(F.regexp_extract(p, "^[^=]*", 0)).alias("k"), _unquoted(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike("^(" + "|".join(TRACKING) + ")")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")
    start = F.when((host != "") | path.startswith("/"), "https://").otherwise("https:")
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(start, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def citations(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit("(src_[0-9a-zA-Z_]+)"), F.lit(1)))
