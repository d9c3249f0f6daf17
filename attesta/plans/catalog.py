"""Named queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors, cluster, evaluate, passages, retrieval, risk, verdicts
from ..operators.filters import spread

Q: dict = {}
SQL: dict[str, str] = {}


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


W = r"[\p{L}\p{N}_]+"

_OLD, _NEW = "‘’‚‛“”„‟‐‑‒–—―−", "''" * 4 + '"' * 4 + "-" * 7

# ---- text ----------------------------------------------------------------------------------


@query("content_hash", r"SELECT doc_id, 'sha256:' || sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS content_hash FROM documents")
def content_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


#: The normal form in SQL, for texts of which compatibility forms and entities change nothing but ligatures.
_FOLDED = rf"trim(regexp_replace(replace(translate({{0}}, '{_OLD}', '{_NEW}'), '…', '...'), '\s+', ' ', 'g'))"
_UNESCAPED = "html"
for _k, _v in {"&quot;": '"', "&copy;": "©", "&middot;": "·", "&amp;": "&"}.items():  # all that the pages have
    _UNESCAPED = f"replace({_UNESCAPED}, '{_k}', '{_v}')"


@query("normalize_text", f"SELECT page_id, sha256({_FOLDED.format(_UNESCAPED)}) AS normal_sha256 FROM pages")
def normalize_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(T.normalize(F.col("html"), open_entities=False), 256).alias("normal_sha256"))




@query("fold_text", rf"SELECT doc_id, sha256(trim(regexp_replace(replace(translate(text, '{_OLD}', '{_NEW}'), '…', '...'), '\s+', ' ', 'g'))) AS folded FROM documents")
def fold_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


@query("verdict_ids", "SELECT event_id, 'v_' || substr(sha256(user_id::VARCHAR || '|' || event_type || '|verifier||'), 1, 16) AS verdict_id FROM events")
def verdict_ids(spark, d):
    return read(spark, d, "events").select("event_id", T.verdict_id(F.col("user_id"), F.col("event_type"), F.lit("verifier"), F.lit(None).cast("string"), F.lit("")).alias("verdict_id"))


#: Over URLs in which each percent sign starts an escape of UTF-8, as DuckDB's own function demands.
@query("canonical_url", r"""
WITH u AS (SELECT page_id, url, regexp_replace(translate(trim(lower(coalesce(url, '')), chr(9) || chr(10) || chr(13) || ' '), chr(9) || chr(10) || chr(13), ''), '^[a-z][a-z0-9+.-]*:', '') AS r FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_extract(r, '^//([^/?#]*)', 1), '^www\.', '') AS host, regexp_replace(regexp_replace(r, '^//[^/?#]*', ''), '#.*$', '') AS t FROM u),
p AS (SELECT page_id, url, host, coalesce(nullif(rtrim(regexp_extract(t, '^[^?]*'), '/'), ''), '/') AS path,
  list_sort(list_filter(list_transform(list_filter(string_split(regexp_extract(t, '\?(.*)$', 1), '&'), lambda x: regexp_matches(x, '^[^=]*=.')),
    lambda x: {'k': url_decode(replace(regexp_extract(x, '^[^=]*'), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))}),
    lambda x: NOT regexp_matches(x.k, '^(utm_|fbclid|gclid|mc_|ref|ref_src|cmpid|igshid)'))) AS q FROM t),
e AS (SELECT *, array_to_string(list_transform(q, lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS query FROM p)
SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN '' ELSE CASE WHEN host <> '' OR path LIKE '/%' THEN 'https://' ELSE 'https:' END || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM e""")
def canonical_url(spark, d):
    return read(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("key_terms", r"""
SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'p': list_position(w, x), 'x': x}))[1:8], lambda s: s.x), ' ') AS terms
FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+'), lambda t: length(t) >= 3 AND t NOT IN ('the','a','an','of','to','in','on','for','and','or','is','are','was','were','be','by','with','that','this','it','its','as','at','all','any','under','from','into','real','time')) AS w FROM benchmark)""")
def key_terms(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.key_terms(F.col("text")), " ").alias("terms"))


_REFUTATIONS = ", ".join(f"k || ' {op}'" for op in ["exceptions OR limitations", *T.REFUTATIONS])
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("refutation_queries", rf"""
WITH b AS (SELECT item_id, regexp_replace(trim(text), '\.+$', '') AS base FROM benchmark), w AS (SELECT item_id, base, list_filter(regexp_extract_all(lower(base), '[0-9A-Za-z가-힣]+'), lambda t: length(t) >= 3 AND t NOT IN ({_STOP})) AS w FROM b),
k AS (SELECT item_id, base, array_to_string(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'p': list_position(w, x), 'x': x}}))[1:8], lambda s: s.x), ' ') AS k FROM w),
l AS (SELECT item_id, list_concat(CASE WHEN base <> '' THEN ['is it true that ' || base] ELSE [] END, CASE WHEN k <> '' THEN [{_REFUTATIONS}] ELSE [] END)[1:10] AS l FROM k)
SELECT item_id, (i - 1)::INTEGER AS pos, l[i::INT] AS search FROM l, range(1, 11) r(i) WHERE i <= len(l)""")
def refutation_queries(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.posexplode(T.refutation_queries(F.col("text"))).alias("pos", "search"))


@query("expanded_queries", rf"""
WITH w AS (SELECT item_id, text, regexp_extract_all(lower(text), '{W}') AS w FROM benchmark), k AS (SELECT *, array_to_string(list_filter(w, lambda t: length(t) > 3), ' ') AS k FROM w),
l AS (SELECT item_id, list_filter([text, CASE WHEN k <> '' AND k <> lower(text) THEN k END, CASE WHEN len(w) > 1 THEN '"' || text || '"' END], lambda x: x IS NOT NULL) AS l FROM k)
SELECT item_id, (i - 1)::INTEGER AS pos, l[i::INT] AS search FROM l, range(1, 4) r(i) WHERE i <= len(l)""")
def expanded_queries(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.posexplode(T.expand_query(F.col("text"))).alias("pos", "search"))


_HAS = lambda where, words: "(" + " OR ".join(f"contains({where}, '{w}')" for w in words) + ")"


@query("fetch_class", rf"""
WITH p AS (SELECT page_id, html, lower(html) AS low, lower(substr(html, 1, 500)) AS top, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(html), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<noscript[^>]*>.*?</noscript>', '', 'g'), '(?s)<head[^>]*>.*?</head>', '', 'g'), '<[^>]*>', '', 'g')) AS bare FROM pages)
SELECT page_id, CASE WHEN {_HAS('low', ['<noscript>', '<div id="root"></div>'])} AND bare = '' THEN 'empty' WHEN {_HAS('low', ['captcha', 'verify', 'robot', '보안 인증'])} OR length(html) < 200 THEN 'captcha'
  WHEN {_HAS('top', ['login', 'sign in', '로그인', 'password'])} THEN 'login' WHEN {_HAS('low', ['404', 'not found', 'access denied'])} THEN 'error' WHEN length(html) >= 1000 AND {_HAS('low', ['the', 'und'])} THEN 'success' ELSE 'partial' END AS kind FROM p""")
def fetch_class(spark, d):
    return read(spark, d, "pages").select("page_id", passages.fetch_class(F.col("html"), ["the", "und"]).alias("kind"))


@query("bylines", r"SELECT p_partkey, nullif(lower(trim(regexp_replace(trim(regexp_replace(trim(p_name), '\s+', ' ', 'g')), '(?i)^by ', ''))), '') AS byline FROM part")
def bylines(spark, d):
    return read(spark, d, "part").select("p_partkey", T.byline(F.col("p_name")).alias("byline"))


# ---- risk ----------------------------------------------------------------------------------

_RULE_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in risk.RULES.items())


@query("risk_rules", f"SELECT doc_id, array_to_string(list_filter([{_RULE_SQL}], lambda x: x IS NOT NULL), ',') AS rules, CASE WHEN len(list_filter([{_RULE_SQL}], lambda x: x IS NOT NULL)) > 0 THEN 'high' ELSE 'normal' END AS computed_risk FROM documents")
def risk_rules(spark, d):
    rules = risk.matched_rules(F.coalesce("text", F.lit("")))
    return read(spark, d, "documents").select("doc_id", F.array_join(rules, ",").alias("rules"), F.when(F.size(rules) > 0, "high").otherwise("normal").alias("computed_risk"))


def _risky(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in risk.RULES.values()) + ")"


_VERB = f"(({risk.VERBS}){risk.R}|{risk.KOREAN_VERBS})"
_ATOMS = rf"""a0 AS (SELECT doc_id::VARCHAR AS claim_id, trim(coalesce(text, ''), ' ') AS t, coalesce(text, '') AS text FROM documents),
a1 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '{risk.COORDINATORS}'), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts, trim(regexp_extract(t, '(?is)^(.*?){risk.L}{_VERB}', 1), ' ') AS subject FROM a0),
a2 AS (SELECT *, list_transform(parts, lambda x, i: CASE WHEN i > 1 AND subject <> '' AND regexp_matches(x, '(?i)^{_VERB}') THEN subject || ' ' || x ELSE x END) AS own FROM a1),
a3 AS (SELECT *, len(list_filter(own, lambda x: {_risky('x')})) AS risky FROM a2),
a4 AS (SELECT claim_id, text, own, len(parts) < 2 OR risky < 2 AS atomic, len(parts) >= 2 AND risky >= 2 AND risky < len(own) AS needs FROM a3)"""
_TOLD = lambda x: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{p}') THEN '{k}' END" for k, p in risk.RULES.items()) + "], lambda y: y IS NOT NULL), ',')"


@query("claim_atoms", f"""WITH {_ATOMS}, x AS (SELECT claim_id, text AS told, atomic, needs, NULL::VARCHAR AS atomized_from, NULL::VARCHAR AS atom_text FROM a4
 UNION ALL SELECT claim_id || '__a' || (i - 1), own[i], true, false, claim_id, own[i] FROM (SELECT *, unnest(range(1, len(own) + 1))::INT AS i FROM a4 WHERE NOT atomic AND NOT needs))
SELECT claim_id, CASE WHEN {_TOLD('told')} = '' THEN 'normal' ELSE 'high' END AS computed_risk, {_TOLD('told')} AS rules, atomic, needs AS needs_atomization, atomized_from, atom_text FROM x""")
def claim_atoms(spark, d):
    return risk.classify(read(spark, d, "documents"), "doc_id", "text")


# ---- anchors -------------------------------------------------------------------------------


def cited(spark, d, form=lambda c: c) -> DataFrame:
    """item_id, doc_id, span, snapshot of the documents that hold a benchmark passage, both in a form."""
    return passages.holding(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark"), form)


@query("span_match", "SELECT b.item_id, d.doc_id, CAST(strpos(d.text, b.text) - 1 AS INTEGER) AS char_start FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def span_match(spark, d):
    at = F.position(F.col("span"), F.col("snapshot"))
    return cited(spark, d).select("item_id", "doc_id", (at - 1).cast("int").alias("char_start"))


_ANCHORED = f"WITH p AS (SELECT item_id, doc_id, {_FOLDED.format('b.text')} AS s, {_FOLDED.format('d.text')} AS t FROM benchmark b, documents d WHERE contains({_FOLDED.format('d.text')}, {_FOLDED.format('b.text')}))"


@query("anchored_spans", f"{_ANCHORED} SELECT item_id, doc_id, true AS span_matched, (strpos(t, s) - 1)::INTEGER AS char_start, (strpos(t, s) - 1 + length(s))::INTEGER AS char_end, true AS numeric_ok, true AS polarity_ok, '' AS referents, true AS anchors_ok FROM p")
def anchored_spans(spark, d):
    # A passage is its own claim: its numbers and negations agree with themselves.
    out = anchors.with_anchors(cited(spark, d, T.normalize).withColumn("claim", F.col("span")))
    return out.select("item_id", "doc_id", "span_matched", "char_start", "char_end", "numeric_ok", "polarity_ok", F.array_join("referent_flags", ",").alias("referents"), "anchors_ok")


#: Claims that differ from their spans in known ways: share, amount (in other scales), year, negation, scope, place.
@query("anchored_claims", """
WITH o AS (SELECT o_orderkey AS k FROM orders),
r AS (SELECT k, k % 17 <> 0 AS span_matched, k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AS numeric_ok, (k % 5 = 0) = (k % 3 = 0) AS polarity_ok, CASE WHEN k % 4 = 0 THEN 'scope:total:segment' ELSE '' END AS flags FROM o)
SELECT k AS o_orderkey, span_matched, numeric_ok, polarity_ok, flags, span_matched AND numeric_ok AND polarity_ok AS anchors_ok FROM r""")
def anchored_claims(spark, d):
    k = F.col("o_orderkey")
    said = lambda scope, share, amount, year, no: F.concat(scope, F.lit(" output rose "), share.cast("string"), F.lit("% to $"), amount, F.lit(" in "), year.cast("string"), F.lit(" and was "), F.when(no, "not disputed").otherwise("disputed"))
    share, million, year = k % 40 + 10, k % 9 + 1, k % 20 + 2000
    claim = said(F.lit("Total"), share, F.concat(million.cast("string"), F.lit(" million")), year, k % 5 == 0)
    thousand = million * 1000 + F.when(k % 11 == 0, 100).otherwise(0)
    span = said(F.when(k % 4 == 0, "Segment").otherwise("Total"), share + F.when(k % 7 == 0, 1).otherwise(0), F.concat(thousand.cast("string"), F.lit(" thousand")), year + F.when(k % 13 == 0, 1).otherwise(0), k % 3 == 0)
    rows = spread(read(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", claim.alias("claim"), span.alias("span")).withColumn("snapshot", F.concat(F.lit("Before. "), F.when(k % 17 != 0, F.col("span")).otherwise("nothing of it"), F.lit(" After.")))
    return anchors.with_anchors(rows).select("o_orderkey", "span_matched", "numeric_ok", "polarity_ok", F.array_join("referent_flags", ",").alias("flags"), "anchors_ok")


_LABELS = "|".join(anchors.LABEL_WORDS)
_SCALED = " ".join(f"WHEN '{k}' THEN {v:.0f}" for k, v in anchors.SCALES.items())
_QUANTITIES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?') AS n, regexp_split_to_array(text, '\d[\d,]*(?:\.\d+)?') AS s FROM documents),
x AS (SELECT doc_id, replace(n[i], ',', '') AS n, s[i] AS l, s[i + 1] || coalesce(n[i + 1], '') AS r FROM (SELECT *, unnest(range(1, len(n) + 1))::INT AS i FROM d)),
y AS (SELECT *, n::DOUBLE AS v, regexp_matches(r, '(?i)^\s*(%|(percent|pct|퍼센트)([^\p{{L}}\p{{N}}_]|$))') AS pct, lower(regexp_extract(r, '(?i)^\s*({'|'.join(anchors.SCALE_WORDS)})([^\p{{L}}\p{{N}}_]|$)', 1)) AS scale,
 regexp_matches(r, '(?i)^\s*(°|({'|'.join(anchors.UNITS)})([^\p{{L}}\p{{N}}_]|$))') AS unit, regexp_matches(l, '[$€£¥₩]\s*$') AS money, regexp_matches(l, '(?i)({_LABELS})\.?\s*$') OR regexp_matches(l, '[-/#\p{{L}}]$') AS named FROM x),
z AS (SELECT doc_id, CASE WHEN pct THEN 'pct' WHEN scale <> '' OR unit OR money THEN 'mag' WHEN contains(n, '.') THEN 'ver' WHEN named THEN NULL WHEN regexp_full_match(n, '1[89]\d\d|20\d\d') THEN 'year' WHEN length(n) > 1 THEN 'mag' END AS cls,
 round(CASE WHEN NOT pct AND scale <> '' THEN v * CASE scale {_SCALED} END ELSE v END, 6) AS val FROM y)
SELECT DISTINCT doc_id, cls, val FROM z WHERE cls IS NOT NULL"""


@query("quantities", _QUANTITIES)
def quantities(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(anchors.quantities("text")).alias("q")).select("doc_id", "q.cls", "q.val")


# ---- independence --------------------------------------------------------------------------


@query("fnv_words", rf"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM benchmark),
h AS (SELECT w, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2*i+1)::INT, 2))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM w)
SELECT w, CAST(h AS VARCHAR) AS fnv FROM h""")
def fnv_words(spark, d):
    words = read(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct()
    h = cluster.fnv1a("w")
    return words.select("w", F.when(h >= 0, h.cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)").cast("string").alias("fnv"))


_SIMHASH = rf"""
w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM documents) GROUP BY ALL), v AS (SELECT DISTINCT w FROM w),
h AS (SELECT w, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), (2*i+1)::INT, 2))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM v),
s AS (SELECT doc_id, i, sum(CASE WHEN (h::UBIGINT >> i::UBIGINT) % 2 = 1 THEN n ELSE -n END) AS s FROM w JOIN h USING (w), range(64) r(i) GROUP BY 1, 2),
u AS (SELECT doc_id, sum(CASE WHEN s > 0 THEN power(2, i)::HUGEINT ELSE 0 END)::HUGEINT AS u FROM s GROUP BY 1),
b AS (SELECT doc_id, CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE coalesce(u, 0) END::BIGINT AS bits FROM documents LEFT JOIN u USING (doc_id))"""


@query("simhash_documents", f"WITH {_SIMHASH} SELECT doc_id, bits FROM b")
def simhash_documents(spark, d):
    return cluster.simhash(read(spark, d, "documents"), "doc_id", "text").select(F.col("node").alias("doc_id"), "bits")


@query("near_pairs", f"""WITH {_SIMHASH}, o AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text), n AS (SELECT doc_id AS node, bits FROM b JOIN o USING (doc_id) WHERE bits <> 0), p AS (SELECT bits, min(node) AS node FROM n GROUP BY 1)
SELECT x.node AS a, y.node AS b FROM p x JOIN p y ON x.node < y.node AND bit_count(xor(x.bits, y.bits)) <= 3 UNION ALL SELECT p.node, n.node FROM n JOIN p USING (bits) WHERE n.node > p.node""")
def near_pairs(spark, d):
    # Equal texts are one node: pairs are between different texts.
    # They are told by SHA-256 and measured where they are read, so no text is shuffled or held.
    docs = cluster.simhash(read(spark, d, "documents").withColumn("h", F.sha2("text", 256)), "doc_id", "text", "h")
    return cluster.near_pairs(docs.groupBy("h").agg(F.min("node").alias("node"), F.min("bits").alias("bits")))


_URLS = SQL["canonical_url"].replace("SELECT page_id, CASE", "SELECT page_id AS id, CASE")
_CLUSTERS = rf"""
WITH RECURSIVE documents AS (SELECT page_id AS doc_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages), {_SIMHASH},
n AS (SELECT u.id, u.canonical, nullif(b.bits, 0) AS bits, row_number() OVER (ORDER BY u.id) AS i FROM ({_URLS}) u JOIN b ON b.doc_id = u.id),
near AS (SELECT x.i, list(y.i) AS before FROM n x JOIN n y ON y.i < x.i AND (x.canonical = y.canonical OR bit_count(xor(x.bits, y.bits)) <= 3) GROUP BY 1),
walk(i, leaders, own) AS (SELECT 0::BIGINT, []::BIGINT[], 0::BIGINT UNION ALL
 SELECT w.i + 1, CASE WHEN len(list_intersect(w.leaders, coalesce(near.before, []))) > 0 THEN w.leaders ELSE list_append(w.leaders, w.i + 1) END, coalesce(list_min(list_intersect(w.leaders, coalesce(near.before, []))), w.i + 1)
 FROM walk w LEFT JOIN near ON near.i = w.i + 1 WHERE w.i < (SELECT count(*) FROM n))
SELECT n.id AS source_id, printf('cl_%04d', dense_rank() OVER (ORDER BY own) - 1) AS cluster_id FROM walk JOIN n USING (i)"""


@query("source_clusters", _CLUSTERS)
def source_clusters(spark, d):
    pages = read(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return cluster.partition(pages)


@query("lexical_features", rf"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM benchmark),
f AS (SELECT item_id, w AS f FROM w UNION ALL SELECT item_id, substr(w, i::INT, 3) FROM (SELECT item_id, w, unnest(range(1, greatest(length(w) - 1, 1))) AS i FROM w WHERE length(w) >= 3)),
c AS (SELECT item_id, ('0x' || right(sha1(f), 2))::INT AS bucket, count(*) AS n FROM f GROUP BY 1, 2)
SELECT item_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 9) AS weight FROM c""")
def lexical_features(spark, d):
    return cluster.lexical_features(read(spark, d, "benchmark"), "item_id", "text").select(F.col("node").alias("item_id"), "bucket", F.round("weight", 9).alias("weight"))


@query("similar_names", rf"""
WITH ns AS (SELECT min(p_partkey) AS id, p_name AS text FROM part GROUP BY 2), w AS (SELECT id, unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM ns),
f AS (SELECT id, w AS f FROM w UNION ALL SELECT id, substr(w, i::INT, 3) FROM (SELECT id, w, unnest(range(1, greatest(length(w) - 1, 1))) AS i FROM w WHERE length(w) >= 3)),
c AS (SELECT id, ('0x' || right(sha1(f), 2))::INT AS bucket, count(*) AS n FROM f GROUP BY 1, 2), v AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM c)
SELECT x.id AS a, y.id AS b, round_even(round(sum(x.weight * y.weight), 9), 4) AS cosine FROM v x JOIN v y USING (bucket) WHERE x.id < y.id GROUP BY 1, 2 HAVING sum(x.weight * y.weight) >= 0.6 - 1e-9""")
def similar_names(spark, d):
    # Equal names are one node.
    names = read(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return cluster.cosine_pairs(cluster.lexical_features(names, "id", "p_name"), 0.6 - 1e-9).select("a", "b", F.bround(F.round("cosine", 9), 4).alias("cosine"))


@query("provenance_clusters", "SELECT doc_id AS source_id, printf('cl_%04d', dense_rank() OVER (ORDER BY m) - 1) AS cluster_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(nullif(lower(trim(source)), ''), doc_id::VARCHAR)) AS m FROM documents)")
def provenance_clusters(spark, d):
    docs = read(spark, d, "documents")
    own = docs.select(F.col("doc_id").alias("source_id"), F.col("doc_id").cast("string").alias("cluster_id"))
    return cluster.refine(own, cluster.provenance_edges(docs, "doc_id", F.col("source"), F.lit(None).cast("string")))


# ---- verdicts: claims, sources and labels are read off the events ---------------------------

_VERDICTS = """v AS (SELECT user_id AS claim_id, event_id % 7 AS source_id, CASE WHEN event_id % 3 = 0 THEN 'panel' ELSE 'verifier' END AS producer,
  CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'done' END AS span_state, CASE event_id % 4 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'neutral' ELSE 'entails' END AS label,
  event_id % 6 <> 0 AS anchors_ok, event_id AS _ord FROM events)"""
_EFFECTIVE = _VERDICTS + """, e AS (SELECT *, min(_ord) OVER (PARTITION BY claim_id, source_id) AS key_ord FROM v
  QUALIFY row_number() OVER (PARTITION BY claim_id, source_id ORDER BY CASE producer WHEN 'panel' THEN 1 ELSE 0 END DESC, CASE span_state WHEN 'done' THEN 1 ELSE 0 END DESC, _ord) = 1)"""


def raw_verdicts(spark, d) -> DataFrame:
    e = F.col("event_id")
    label = F.when(e % 4 == 0, "contradicts").when(e % 4 == 1, "neutral").otherwise("entails")
    return read(spark, d, "events").select(F.col("user_id").alias("claim_id"), (e % 7).alias("source_id"), F.when(e % 3 == 0, "panel").otherwise("verifier").alias("producer"), F.when(e % 5 == 0, "failed").otherwise("done").alias("span_state"), label.alias("label"), (e % 6 != 0).alias("anchors_ok"), e.alias("_ord"))


def raw_votes(spark, d) -> DataFrame:
    e = F.col("event_id")
    lens = F.when(e % 3 == 0, verdicts.LENSES[0]).when(e % 3 == 1, verdicts.LENSES[1]).otherwise(verdicts.LENSES[2])
    return read(spark, d, "events").select(F.col("user_id").alias("claim_id"), lens.alias("lens"), F.when(e % 8 == 0, "bogus").when(e % 5 < 3, "entails").otherwise("contradicts").alias("vote"), F.when(e % 9 == 0, "failed").otherwise("done").alias("vote_state"), F.concat(F.lit("m"), (e % 2).cast("string")).alias("model_id"), e.alias("_ord"))


@query("effective_verdicts", f"WITH {_EFFECTIVE} SELECT claim_id, source_id, producer, span_state, label, anchors_ok, _ord, key_ord FROM e")
def effective_verdicts(spark, d):
    return verdicts.effective_verdicts(raw_verdicts(spark, d))


_VOTES = """v AS (SELECT user_id AS claim_id, CASE event_id % 3 WHEN 0 THEN 'refute' WHEN 1 THEN 'source_quality' ELSE 'numeric_consistency' END AS lens,
  CASE WHEN event_id % 8 = 0 THEN 'bogus' WHEN event_id % 5 < 3 THEN 'entails' ELSE 'contradicts' END AS vote, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'done' END AS vote_state, 'm' || (event_id % 2) AS model_id, event_id AS _ord FROM events),
l AS (SELECT *, vote IN ('entails', 'contradicts', 'neutral') AND vote_state <> 'failed' AS ok FROM v QUALIFY row_number() OVER (PARTITION BY claim_id, lens ORDER BY CASE WHEN vote_state = 'done' AND vote IN ('entails', 'contradicts', 'neutral') THEN 1 ELSE 0 END DESC, _ord DESC) = 1),
a AS (SELECT claim_id, count(*) FILTER (ok)::INTEGER AS n_valid, count(DISTINCT model_id) FILTER (ok)::INTEGER AS n_models, count(*) FILTER (ok AND vote = 'entails') AS e, count(*) FILTER (ok AND vote = 'contradicts') AS c, count(*) FILTER (ok AND vote = 'neutral') AS n FROM l GROUP BY 1),
p AS (SELECT claim_id, CASE WHEN n_valid < 3 THEN 'no_consensus' WHEN e >= 2 THEN 'entails' WHEN c >= 2 THEN 'contradicts' WHEN n >= 2 THEN 'neutral' ELSE 'no_consensus' END AS panel_consensus, n_valid, n_models, n_models >= 2 AS model_diverse FROM a)"""


@query("panel_consensus", f"WITH {_VOTES} SELECT * FROM p")
def panel_consensus(spark, d):
    return verdicts.panel_consensus(raw_votes(spark, d)).drop("missing_lenses", "failed_lenses", "votes", "vote_models")


def _of_lenses(value: str) -> str:
    return "array_to_string([" + ", ".join(f"'{x}=' || coalesce(max({value}) FILTER (lens = '{x}'), '-')" for x in verdicts.LENSES) + "], ';')"


def _lenses_where(test: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test.format(x)} THEN '{x}' END" for x in verdicts.LENSES) + "], lambda x: x IS NOT NULL), ',')"


#: Claims of a user are 97, so that most have few votes: lenses are missing or failed.
@query("panel_rows", f"""WITH {_VOTES.replace("user_id AS claim_id", "user_id * 100 + event_id % 97 AS claim_id", 1)},
o AS (SELECT claim_id, {_of_lenses("vote")} AS votes, {_of_lenses("model_id")} AS vote_models, {_lenses_where("count(*) FILTER (lens = '{}') = 0")} AS missing_lenses, {_lenses_where("count(*) FILTER (lens = '{}' AND NOT ok) > 0")} AS failed_lenses FROM l GROUP BY 1)
SELECT * FROM p JOIN o USING (claim_id)""")
def panel_rows(spark, d):
    e = F.col("_ord")
    votes = raw_votes(spark, d).withColumn("claim_id", F.col("claim_id") * 100 + e % 97)
    told = lambda c: F.array_join(F.array(*[F.concat(F.lit(f"{x}="), F.coalesce(F.col(c)[x], F.lit("-"))) for x in verdicts.LENSES]), ";")
    return verdicts.panel_consensus(votes).withColumns({"votes": told("votes"), "vote_models": told("vote_models")})


def tuples(spark, d) -> DataFrame:
    e = verdicts.effective_verdicts(raw_verdicts(spark, d))
    label = verdicts.normalized_label(F.col("label"), F.col("span_state"), F.lit(None).cast("string"))
    s = F.col("source_id")
    return e.select("claim_id", "source_id", F.concat(F.lit("cl_"), (s % 3).cast("string")).alias("cluster_id"), F.when(s % 4 == 0, "a").when(s % 4 == 1, "B").otherwise("C").alias("grade"), label.alias("label"), "anchors_ok", "key_ord")


_DECIDE = """t AS (SELECT claim_id, source_id, 'cl_' || (source_id % 3) AS cluster_id, substr('ABCC', (source_id % 4)::INT + 1, 1) AS g, source_id % 4 IN (0, 1) AS good, key_ord, CASE WHEN span_state = 'failed' OR NOT anchors_ok THEN 'neutral' ELSE label END AS eff FROM e),
r AS (SELECT * FROM t WHERE eff = 'entails' QUALIFY row_number() OVER (PARTITION BY claim_id, cluster_id ORDER BY key_ord) = 1),
k AS (SELECT claim_id, count(*)::INTEGER AS n, bool_or(good) AS graded, string_agg(source_id::VARCHAR, ',' ORDER BY key_ord) AS proof, string_agg(g, ',' ORDER BY key_ord) AS grades FROM r GROUP BY 1),
c AS (SELECT claim_id, string_agg(source_id::VARCHAR, ',' ORDER BY key_ord) FILTER (eff = 'contradicts' AND good) AS hard, bool_or(eff = 'contradicts') AS con FROM t GROUP BY 1),
j AS (SELECT c.claim_id, coalesce(k.n, 0) AS n, coalesce(k.graded, false) AS graded, proof, grades, con, hard, {panel} AS agrees, {m2} AS m2, {shown} AS panel_consensus FROM c LEFT JOIN k USING (claim_id) {join}),
d1 AS (SELECT claim_id, 'refuted' AS status, 'ab_contradiction' AS reason FROM j WHERE hard IS NOT NULL AND NOT agrees),
d2 AS (SELECT claim_id, 'unresolved' AS status, 'conflict' AS reason FROM j WHERE n > 0 AND con AND NOT agrees AND claim_id NOT IN (SELECT claim_id FROM d1)),
d3 AS (SELECT claim_id, 'verified' AS status, 'ok' AS reason FROM j WHERE n >= 2 AND graded AND (NOT m2 OR agrees) AND claim_id NOT IN (SELECT claim_id FROM d1 UNION SELECT claim_id FROM d2)),
d4 AS (SELECT claim_id, 'unresolved' AS status, CASE WHEN m2 AND NOT agrees AND n >= 2 AND graded THEN 'panel_no_consensus' ELSE 'insufficient_independent_entails' END AS reason FROM j WHERE claim_id NOT IN (SELECT claim_id FROM d1 UNION SELECT claim_id FROM d2 UNION SELECT claim_id FROM d3)),
o AS (SELECT * FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4) JOIN j USING (claim_id))
SELECT claim_id, status, reason, CASE WHEN reason IN ('ab_contradiction', 'conflict') THEN 0 ELSE n END AS independent_entails, reason = 'conflict' AS conflict, false AS coverage_degraded, panel_consensus,
 CASE WHEN status = 'verified' THEN proof ELSE '' END AS proof_source_ids, CASE WHEN status = 'verified' THEN grades ELSE '' END AS proof_grades, CASE WHEN status = 'refuted' THEN hard END AS refuted_by FROM o"""


def told(decided: DataFrame) -> DataFrame:
    """Lists as text."""
    return decided.withColumns({c: F.array_join(c, ",") for c in ("proof_source_ids", "proof_grades", "refuted_by")})


@query("decisions", f"WITH {_EFFECTIVE}, " + _DECIDE.format(panel="false", m2="false", shown="NULL::VARCHAR", join=""))
def decisions(spark, d):
    return told(verdicts.decide(tuples(spark, d)))


_VOTED = f"WITH {_EFFECTIVE}, {_VOTES.replace('v AS', 'v2 AS').replace('FROM v ', 'FROM v2 ')}, " + _DECIDE.format(panel="coalesce(p.panel_consensus = 'entails', false)", m2="true", shown="p.panel_consensus", join="LEFT JOIN p USING (claim_id)")


@query("decisions_with_panel", _VOTED)
def decisions_with_panel(spark, d):
    return told(verdicts.decide(tuples(spark, d), verdicts.panel_consensus(raw_votes(spark, d))))


# Claims 0 to 199 of which some have no verdict, a fifth is low-risk and some are compounds.
_RUN = f"""c AS (SELECT i AS claim_id, i % 5 <> 2 AS high, i % 11 <> 5 AS atomic FROM range(0, 200) r(i)), d AS ({_VOTED})
SELECT claim_id, CASE WHEN NOT high THEN 'cite_write' WHEN NOT atomic THEN 'unresolved' ELSE coalesce(status, 'unresolved') END AS status, CASE WHEN NOT high THEN 'non_high_risk' WHEN NOT atomic THEN 'needs_atomization' ELSE coalesce(reason, 'missing') END AS reason,
 CASE WHEN high AND atomic THEN coalesce(independent_entails, 0) ELSE 0 END AS independent_entails, high AND atomic AND coalesce(conflict, false) AS conflict, false AS coverage_degraded, CASE WHEN high AND atomic THEN coalesce(d.panel_consensus, p2.panel_consensus) END AS panel_consensus,
 CASE WHEN high AND atomic THEN coalesce(proof_source_ids, '') ELSE '' END AS proof_source_ids, CASE WHEN high AND atomic THEN coalesce(proof_grades, '') ELSE '' END AS proof_grades, CASE WHEN high AND atomic THEN refuted_by END AS refuted_by, high AS high_risk
FROM c LEFT JOIN d USING (claim_id) LEFT JOIN (WITH {_VOTES} SELECT * FROM p) p2 USING (claim_id)"""


def validated_run(spark, d) -> dict[str, DataFrame]:
    s, i = F.col("source_id"), F.col("id")
    ids = spark.range(7).withColumn("_ord", i)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    sources = ids.select(i.cast("string").alias("id"), F.when(i % 4 == 0, " a").when(i % 4 == 1, "B").otherwise("C").alias("quality_rating"), name("h", i).alias("content_hash"), "_ord")
    claims = spark.range(200).select(i.alias("claim_id"), name("t", i).alias("claim_text_hash"))
    risk_rows = spark.range(200).select(i.alias("claim_id"), F.when(i % 5 != 2, "high").otherwise("normal").alias("computed_risk"), (i % 11 != 5).alias("atomic"), F.lit(None).cast("string").alias("atomized_from"))
    raw = raw_verdicts(spark, d).withColumns({"verdict_id": name("v", F.col("_ord")), "source_id": s.cast("string"), "fail_reason": F.lit(None).cast("string"), "snapshot_hash": name("h", s), "source_grade": F.when(F.col("_ord") % 2 == 0, F.when(s % 4 == 0, "A").when(s % 4 == 1, "b").otherwise("C")), "claim_text_hash": name("t", F.col("claim_id"))})
    clusters = ids.select(i.cast("string").alias("source_id"), name("cl_", i % 3).alias("cluster_id"))
    return verdicts.validate(sources, claims, risk_rows, raw, clusters, verdicts.panel_consensus(raw_votes(spark, d)))


@query("validated_claims", f"WITH {_RUN}")
def validated_claims(spark, d):
    return told(validated_run(spark, d)["decided"])


@query("validated_outcome", f"WITH x AS (WITH {_RUN}) SELECT 0::BIGINT AS errors, count(*) FILTER (status = 'verified' AND high_risk) AS verified, CASE WHEN count(*) FILTER (status = 'verified' AND high_risk) = 0 THEN 1 ELSE 0 END AS exit FROM x")
def validated_outcome(spark, d):
    return validated_run(spark, d)["outcome"]


@query("routed_claims", f"""WITH {_ATOMS}, d AS (WITH {_EFFECTIVE}, {_DECIDE.format(panel="false", m2="false", shown="NULL::VARCHAR", join="")})
SELECT a.claim_id, CASE WHEN {_TOLD('text')} = '' THEN 'cite_write' WHEN NOT atomic THEN 'unresolved' ELSE coalesce(d.status, 'unresolved') END AS status, CASE WHEN {_TOLD('text')} = '' THEN 'non_high_risk' WHEN NOT atomic THEN 'needs_atomization' ELSE coalesce(d.reason, 'missing') END AS reason
FROM a4 a LEFT JOIN d ON d.claim_id::VARCHAR = a.claim_id""")
def routed_claims(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("claim_id"), "text")
    found = verdicts.decide(tuples(spark, d)).withColumn("claim_id", F.col("claim_id").cast("string"))
    return verdicts.route(docs.select("claim_id"), risk.classify_whole(docs), found)


@query("registry_errors", "SELECT CAST(s_suppkey AS VARCHAR) AS source_id, 'bad grade' AS error FROM supplier WHERE s_nationkey % 7 >= 5")
def registry_errors(spark, d):
    rows = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.substring(F.lit("ABCDEFG"), (F.col("s_nationkey") % 7).cast("int") + 1, F.lit(1)).alias("quality_rating"), F.col("s_suppkey").alias("_ord"))
    return verdicts.registry_errors(rows)


# ---- retrieval -----------------------------------------------------------------------------

_BM25 = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
x AS (SELECT doc_id, len(w) AS dl, unnest(w) AS t FROM t), tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM x GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '{W}')) AS t FROM forms),
b AS (SELECT qid, doc_id AS doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY 1, 2)"""


def asked(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), read(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


@query("bm25_top5", _BM25.replace("WITH t", "WITH forms AS (SELECT item_id AS qid, text FROM benchmark), t", 1) + "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank, doc, round(score, 4) AS score FROM (SELECT qid, doc, round(score, 9) AS score FROM b) QUALIFY rank <= 5")
def bm25_top5(spark, d):
    return retrieval.bm25(*asked(spark, d)).withColumn("score", F.round(F.round("score", 9), 4))


_FEATURES = rf"""@p_w AS (SELECT id, unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM @table),
@p_f AS (SELECT id, w AS f FROM @p_w UNION ALL SELECT id, substr(w, i::INT, 3) FROM (SELECT id, w, unnest(range(1, greatest(length(w) - 1, 1))) AS i FROM @p_w WHERE length(w) >= 3)),
@p_c AS (SELECT id, ('0x' || right(sha1(f), 2))::INT AS bucket, count(*) AS n FROM @p_f GROUP BY 1, 2),
@p_v AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM @p_c)"""


@query("retrieve_top5", rf"""
WITH k AS (SELECT item_id, text, array_to_string(list_filter(regexp_extract_all(lower(text), '{W}'), lambda t: length(t) > 3), ' ') AS k FROM benchmark),
forms AS (SELECT 2 * item_id AS qid, item_id, text FROM k UNION ALL SELECT 2 * item_id + 1, item_id, k FROM k WHERE k <> '' AND k <> lower(text)),
{_BM25.split("WITH ", 1)[1]}, qs AS (SELECT qid AS id, text FROM forms), ds AS (SELECT doc_id AS id, text FROM documents), {_FEATURES.replace('@p_', 'of_q').replace('@table', 'qs')}, {_FEATURES.replace('@p_', 'of_d').replace('@table', 'ds')},
cos AS (SELECT x.id AS qid, y.id AS doc, sum(x.weight * y.weight) AS c FROM of_qv x JOIN of_dv y USING (bucket) GROUP BY 1, 2),
g AS (SELECT f.qid, f.item_id, d.doc_id AS doc, coalesce(b.score, 0) AS l, coalesce(cos.c, 0) AS c FROM forms f CROSS JOIN documents d LEFT JOIN b ON b.qid = f.qid AND b.doc = d.doc_id LEFT JOIN cos ON cos.qid = f.qid AND cos.doc = d.doc_id),
h AS (SELECT *, min(l) OVER p AS l0, max(l) OVER p AS l1, min(c) OVER p AS c0, max(c) OVER p AS c1 FROM g WINDOW p AS (PARTITION BY qid)),
y AS (SELECT item_id, doc, greatest(0, max(0.5 * CASE WHEN c1 > c0 THEN (c - c0) / (c1 - c0) ELSE 0 END + 0.5 * CASE WHEN l1 > l0 THEN (l - l0) / (l1 - l0) ELSE 0 END)) AS hybrid FROM h GROUP BY 1, 2),
qq AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{W}')) AS w FROM benchmark), dd AS (SELECT doc_id AS doc, list_distinct(regexp_extract_all(lower(text), '{W}')) AS w FROM documents),
z AS (SELECT item_id AS qid, doc, hybrid, len(list_intersect(qq.w, dd.w)) / greatest(len(qq.w), 1) AS rerank FROM y JOIN qq USING (item_id) JOIN dd USING (doc)),
r AS (SELECT *, round(0.7 * rerank + 0.3 * hybrid, 9) AS score FROM z)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank, doc, round_even(score, 4) AS score, round_even(round(hybrid, 9), 4) AS hybrid, round_even(round(rerank, 9), 4) AS rerank FROM r QUALIFY rank <= 5""")
def retrieve_top5(spark, d):
    return retrieval.retrieve(*asked(spark, d))


# ---- measures ------------------------------------------------------------------------------


@query("kappa_labels", """
WITH c AS (SELECT quality AS x, 1 - toxic AS y FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (x = y) AS s FROM c),
m AS (SELECT sum(p * q) AS pq FROM (SELECT x AS v, count(*) AS p FROM c GROUP BY 1) JOIN (SELECT y AS v, count(*) AS q FROM c GROUP BY 1) USING (v))
SELECT n, round_even(s / n, 4) AS observed, round_even(pq / (n * n), 4) AS expected, round_even((s / n - pq / (n * n)) / (1 - pq / (n * n)), 4) AS kappa FROM n, m""")
def kappa_labels(spark, d):
    return evaluate.kappa(read(spark, d, "labels").select(F.col("quality").alias("x"), (1 - F.col("toxic")).alias("y")))


@query("confusion_by_language", """
WITH r AS (SELECT lang AS stratum, quality = 1 AS gold, n_chars % 3 > 0 AS said FROM documents JOIN labels USING (doc_id)),
c AS (SELECT stratum, count(*) AS n, count(*) FILTER (said AND gold) AS tp, count(*) FILTER (said AND NOT gold) AS fp, count(*) FILTER (NOT said AND gold) AS fn, count(*) FILTER (NOT said AND NOT gold) AS tn FROM r GROUP BY ROLLUP (stratum))
SELECT *, round_even(tp / nullif(tp + fp, 0), 4) AS precision, round_even(tp / nullif(tp + fn, 0), 4) AS recall FROM c""")
def confusion_by_language(spark, d):
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.col("lang").alias("stratum"), (F.col("quality") == 1).alias("gold"), (F.col("n_chars") % 3 > 0).alias("said"))
    return evaluate.confusion(rows)


@query("leaked_grams", """
WITH t AS (SELECT item_id, regexp_replace(text, '[^0-9A-Za-z가-힣%]', '', 'g') AS t FROM benchmark), m AS (SELECT DISTINCT item_id, substr(t, i::INT, 6) AS g FROM (SELECT item_id, t, unnest(range(1, greatest(length(t) - 4, 1))) AS i FROM t)),
p AS (SELECT regexp_replace(html, '[^0-9A-Za-z가-힣%]', '', 'g') AS t FROM pages), s AS (SELECT DISTINCT substr(t, i::INT, 6) AS g FROM (SELECT t, unnest(range(1, greatest(length(t) - 4, 1))) AS i FROM p))
SELECT item_id AS id, count(s.g) AS shared FROM benchmark LEFT JOIN m USING (item_id) LEFT JOIN s USING (g) GROUP BY 1""")
def leaked_grams(spark, d):
    return evaluate.leaks(read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")))


@query("call_estimates", "SELECT c_custkey, least(greatest(round_even(c_nationkey * 2.5, 0)::BIGINT, 0), 120) AS verifier_calls, least(ceil(c_nationkey * 1.5)::BIGINT * 3, 90) AS panel_calls, round_even(c_nationkey * 2.5, 0) > 120 AS verifier_capped, ceil(c_nationkey * 1.5) * 3 > 90 AS panel_capped, greatest(1, least(c_nationkey, 3))::BIGINT AS concurrent FROM customer")
def call_estimates(spark, d):
    n = F.col("c_nationkey")
    return read(spark, d, "customer").select("c_custkey", *[c.alias(k) for k, c in evaluate.estimate_calls(n, 2.5, 1.5).items()], evaluate.cap_concurrency(n).cast("long").alias("concurrent"))


# ---- merges ---------------------------------------------------------------------------------

_REACHED = """
link AS (SELECT o, a AS m, b AS n FROM e UNION ALL SELECT o, b, a FROM e),
reach(o, n) AS (SELECT DISTINCT e.o, y.id FROM e JOIN x ON x.id = e.a JOIN x y ON y.c = x.c
 UNION SELECT r.o, y.id FROM reach r JOIN link l ON l.m = r.n AND l.o < r.o JOIN x ON x.id = l.n JOIN x y ON y.c = x.c)"""


@query("semantic_merges", rf"""
WITH RECURSIVE ds AS (SELECT doc_id AS id, text FROM documents), {_FEATURES.replace('@p_', 'of_').replace('@table', 'ds')},
x AS (SELECT doc_id AS id, doc_id // 8 AS s, CASE WHEN doc_id % 8 IN (1, 6) THEN doc_id // 8 * 8 + 1 ELSE doc_id END AS c FROM documents),
e AS (SELECT row_number() OVER (ORDER BY p.id, q.id) AS o, p.id AS a, q.id AS b, round_even(round(sum(p.weight * q.weight), 9), 4) AS cosine FROM of_v p JOIN of_v q ON p.bucket = q.bucket AND p.id // 8 = q.id // 8 AND p.id < q.id GROUP BY p.id, q.id HAVING sum(p.weight * q.weight) >= 0.8),
{_REACHED}
SELECT a, b, cosine FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.o = e.o AND r.n = e.b)""")
def semantic_merges(spark, d):
    # Eight documents are a question's sources; two of them are one cluster already.
    i = F.col("doc_id")
    docs = read(spark, d, "documents").select("doc_id", "text", F.floor(i / 8).alias("scenario"))
    before = docs.select(i.alias("source_id"), F.when((i % 8).isin(1, 6), F.concat(F.lit("s"), "scenario")).otherwise(F.concat(F.lit("d"), i.cast("string"))).alias("cluster_id"))
    return cluster.semantic_merges(before, docs, "doc_id", "text", scope_col="scenario")


@query("provenance_merges", rf"""
WITH RECURSIVE x AS (SELECT doc_id AS id, doc_id - doc_id % 3 AS c, CASE WHEN doc_id % 2 = 0 THEN nullif(lower(trim(source)), '') END AS wire, nullif(lower(lang) || ' writer ' || doc_id % 41, '') AS byline FROM documents),
k AS (SELECT 0 AS turn, wire AS key, id FROM x WHERE wire IS NOT NULL UNION ALL SELECT 1, byline, id FROM x WHERE byline IS NOT NULL),
g AS (SELECT turn, key, min(id) OVER (PARTITION BY turn, key) AS a, id AS b FROM k),
e AS (SELECT row_number() OVER (ORDER BY turn, a, b) AS o, * FROM g WHERE a <> b),
w(o, labels) AS (SELECT 0::BIGINT, map_from_entries((SELECT list((id, c)) FROM x)) UNION ALL
 SELECT w.o + 1, CASE WHEN labels[e.a] = labels[e.b] THEN labels ELSE map_from_entries(list_transform(map_entries(labels), lambda r: (r.key, CASE WHEN r.value = greatest(labels[e.a], labels[e.b]) THEN least(labels[e.a], labels[e.b]) ELSE r.value END))) END FROM w JOIN e ON e.o = w.o + 1)
SELECT e.a, e.b, CASE WHEN turn = 0 THEN 'wire' ELSE 'byline' END AS signal, key FROM e JOIN w ON w.o = e.o - 1 WHERE w.labels[e.a] <> w.labels[e.b]""")
def provenance_merges(spark, d):
    i = F.col("doc_id")
    docs = read(spark, d, "documents").select("doc_id", "source", F.concat(F.lit("By "), "lang", F.lit(" Writer "), (i % 41).cast("string")).alias("byline"))
    before = docs.select(i.alias("source_id"), F.floor(i / 3).alias("cluster_id"))
    return cluster.provenance_merges(before, docs, "doc_id", F.when(i % 2 == 0, F.col("source")), F.col("byline"))


@query("unit_budget", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 40 AS granted FROM events")
def unit_budget(spark, d):
    return evaluate.unit_budget(read(spark, d, "events"), 40, "user_id", "event_id").select("event_id", "granted")


_GRADES = "['A', 'b', 'C', 'a', '', NULL]"


@query("findings", f"""
WITH f AS (SELECT user_id, event_id AS o, event_id % 11 = 0 AS r, CASE WHEN event_id % 17 <> 0 THEN event_id % 13 = 0 END AS q, {_GRADES}[(event_id % 6)::INT + 1] AS g FROM events),
h AS (SELECT *, coalesce(r OR q, false) AND coalesce(upper(g), '') IN ('A', 'B', '') AS hit FROM f),
a AS (SELECT user_id, bool_or(hit) AS hit, bool_or(hit AND r) AS ref, array_to_string(list_slice(list('s' || o ORDER BY o) FILTER (hit), 1, 3), '|') AS s FROM h GROUP BY 1)
SELECT k.c_custkey AS user_id, CASE WHEN a.user_id IS NULL THEN 'neutral' WHEN hit THEN 'contradicts' ELSE 'entails' END AS verdict,
 CASE WHEN a.user_id IS NULL THEN 'no_contrary_search' WHEN ref THEN 'refuted' WHEN hit THEN 'material_qualifier_omitted' ELSE 'no_contrary_evidence_found' END AS reason, CASE WHEN hit THEN s END AS summaries
FROM customer k LEFT JOIN a ON a.user_id = k.c_custkey""")
def findings(spark, d):
    e = F.col("event_id")
    events = read(spark, d, "events")
    grades = F.array(*[F.lit(g) for g in ("A", "b", "C", "a", "", None)])
    rows = events.select("user_id", e.alias("_ord"), (e % 11 == 0).alias("refutes"), F.when(e % 17 != 0, e % 13 == 0).alias("qualifies"), grades[(e % 6).cast("int")].alias("quality_rating"), F.concat(F.lit("s"), e.cast("string")).alias("summary"))
    return evaluate.findings_verdict(rows, "user_id", read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")))


#: Claims are users, sources are 97: refs, verdicts (of three producers, the last one of a pair holds), claims and sources with what they are now.
_REPLAY = """
WITH e AS (SELECT event_id, user_id AS c, event_id % 97 AS s, event_type AS t FROM events),
v AS (SELECT c, s, event_id, md5(c || 'x' || CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END) AS ch, md5(s || 'y' || CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END) AS sh FROM e WHERE t <> 'view' AND event_id % 4 < 3),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY c, s ORDER BY event_id DESC) = 1),
r AS (SELECT e.event_id, e.c, e.s, l.event_id IS NOT NULL AS judged, ch IS NOT DISTINCT FROM CASE WHEN e.c % 31 <> 0 THEN md5(e.c || 'x0') END AS ch, sh IS NOT DISTINCT FROM md5(e.s || 'y' || CASE WHEN e.s % 29 = 0 THEN 1 ELSE 0 END) AS sh FROM e LEFT JOIN l USING (c, s))
SELECT event_id, c AS claim_id, s AS source_id, CASE WHEN NOT judged OR NOT ch THEN 'requery' WHEN sh THEN 'frozen' ELSE 'tamper' END AS action,
 CASE WHEN NOT judged THEN 'no_verdict' WHEN NOT ch THEN 'claim_changed' WHEN NOT sh THEN 'snapshot_changed' END AS reason FROM r"""


@query("replay_plan", _REPLAY)
def replay_plan(spark, d):
    e = F.col("event_id")
    rows = read(spark, d, "events").select("event_id", F.col("user_id").alias("claim_id"), (e % 97).alias("source_id"), "event_type")
    digest = lambda c, mark, stale: F.md5(F.concat(F.col(c).cast("string"), F.lit(mark), F.when(stale, "1").otherwise("0")))
    said = rows.filter("event_type <> 'view'").select("claim_id", "source_id", e.alias("_ord"), F.when(e % 4 == 3, "panel").when(e % 4 == 2, "verifier").alias("producer"), digest("claim_id", "x", e % 19 == 0).alias("claim_text_hash"), digest("source_id", "y", e % 23 == 0).alias("snapshot_hash"))
    claims = rows.select("claim_id").distinct().select("claim_id", F.when(F.col("claim_id") % 31 != 0, F.md5(F.concat(F.col("claim_id").cast("string"), F.lit("x0")))).alias("claim_text_hash"))
    sources = rows.select("source_id").distinct().select("source_id", digest("source_id", "y", F.col("source_id") % 29 == 0).alias("content_hash"))
    return evaluate.replay_plan(rows.drop("event_type"), said, claims, sources)


@query("grade_histogram", "SELECT substr('ABCD', (s_nationkey % 4)::INT + 1, 1) AS grade, count(*) AS n, repeat('█', count(*)::INT) AS bar FROM supplier GROUP BY 1")
def grade_histogram(spark, d):
    return passages.grade_histogram(read(spark, d, "supplier"), F.substring(F.lit("ABCD"), (F.col("s_nationkey") % 4).cast("int") + 1, F.lit(1)))


@query("coverage_gap", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def coverage_gap(spark, d):
    high = read(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey")
    return high.join(read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


def flagship(spark, sf_dir: str) -> DataFrame:
    return anchored_spans(spark, sf_dir)


def queries() -> dict:
    from . import checks  # noqa: F401  adds its queries

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from . import checks  # noqa: F401  adds its queries

    return dict(SQL)
