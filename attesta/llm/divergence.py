"""Source divergence audit: how far the words of each source are from those of its language's other sources.

Terms are runs of ASCII letters and bytes from 0x80, with A-Z lower-cased. A task maps the joined UTF-8
bytes of its texts through a table of 256 entries, so that word boundaries are the places where the class
changes; xxHash groups the slices, and every slice is compared byte by byte with the first one of its
group (a group of several words is parted by bytes). A chunk of texts leaves one row per language, source
and term. Spark adds them up, keeps the terms of at least ``least_docs`` documents of their language, and
writes one row per language and term: its sources and counts, which is a row of a sparse matrix.

Values are integers: p = 1 + floor(SCALE * (count + 1) / (N + V)) for a group (a source of a language, or the
whole language), N its occurrences of kept terms, V the language's kept terms; f(p, q) = floor((p - q)^2 / q).
``pairs`` sums f over all kept terms for any two sources of a language: over the terms that a source has by
its entries, over all others by the few different counts of the other source. ``terms`` keeps the ``top``
terms of each source that are more frequent there than in the language.

Null text, language or source: empty. Every source of a language has its rows, with or without terms. Each row
is a document of its own, repeated or not. Texts of any length are whole; a task holds one text beside
``CHUNK_BYTES`` of others. Ties in value: the smaller item in UTF-8 is first. An empty table gives an empty result;
other columns are not read. One row per source and language is held by the driver and the tasks, and
8 bytes per pair of sources of one language by a task: the result has a row for each such pair as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, chunks, table, utf8

SCALE = 10**9
LEAST_DOCS = 3
TOP = 200
CHUNK_BYTES = 4 << 20
#: Numbers of a dense block: so many terms of all sources at once.
CELLS = 1 << 20

_upper = np.arange(65, 91)
#: Of each byte: whether it belongs to a term, and what it is lower-cased.
IN_TERM = np.zeros(256, bool)
IN_TERM[_upper] = IN_TERM[_upper + 32] = IN_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[_upper] += 32


def slices(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where terms begin and end in the joined bytes, and the text that each is in."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True  # terms end where texts end
    begin = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grouped(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each slice, equal for equal bytes only, and the bytes of each number."""
    blob = data.tobytes()
    words = [blob[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    _, lead, group = np.unique(hashed(words), return_index=True, return_inverse=True)
    size = end - begin
    first = lead[group]
    same = size == size[first]
    # Bytes of all slices of the right length beside those of the first of their group.
    at = np.flatnonzero(same)
    n = size[at]
    head = np.cumsum(n) - n
    step = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(head, n)
    equal = data[np.repeat(begin[at], n) + step] == data[np.repeat(begin[first[at]], n) + step]
    if len(at):
        same[at] = np.logical_and.reduceat(equal, head)
    names = [words[i] for i in lead.tolist()]
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # another word with this hash
        if words[i] not in others:
            others[words[i]] = len(names)
            names.append(words[i])
        group[i] = others[words[i]]
    return group, names


def counted(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Of each group of texts and term that occur together: group, term, occurrences, texts."""
    data, starts = utf8(texts)
    data = LOWER[data]
    begin, end, doc = slices(data, starts)
    if not len(begin):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    term, names = grouped(data, begin, end)
    key, n = np.unique(term * np.int64(len(texts)) + doc, return_counts=True)
    term, doc = np.divmod(key, len(texts))
    key = term * np.int64(group.max() + 1) + group[doc]
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    term, who = np.divmod(key[head], group.max() + 1)
    return who, [names[i] for i in term.tolist()], np.add.reduceat(n, head), np.diff(np.append(head, len(key)))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs: of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = (batch.column(i).dictionary_encode() for i in (1, 2))
            code = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy(zero_copy_only=False)
            starts = utf8(batch.column(0))[1]
            for lo, hi in chunks(np.diff(starts), CHUNK_BYTES):
                kinds, group = np.unique(code[lo:hi], return_inverse=True)
                who, term, n, seen = counted(batch.column(0).slice(lo, hi - lo), group)
                lang_no, source_no = np.divmod(kinds[who], max(1, len(sources.dictionary)))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang_no)), sources.dictionary.take(pa.array(source_no)), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())], ["lang", "source", "term", "n", "docs"])

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))])
    found = texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) in whole numbers, exact for totals below 2^48."""
    step = 31250
    whole, rest = np.divmod((np.asarray(count, np.int64) + 1) * step, np.int64(total) if np.isscalar(total) else total)
    return 1 + whole * (SCALE // step) + rest * (SCALE // step) // total


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Language:
    """The sources of one language in order, their N + V, and sums of f over pairs so far."""

    def __init__(self, sources: list[str], totals: list[int]) -> None:
        self.sources = sources
        self.total = np.array(totals, np.int64)  # the last one is the whole language's
        self.none = share(np.zeros(len(totals), np.int64), self.total)
        self.sums = np.zeros((len(sources), len(sources)), np.int64)

    def add(self, indptr: np.ndarray, who: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes rows of the sparse matrix terms x sources; gives entry number, source and f against the language where p > q."""
        terms, wide = len(indptr) - 1, len(self.sources)
        row = np.repeat(np.arange(terms), np.diff(indptr))
        p = share(n, self.total[who])
        dense = np.repeat(self.none[:wide, None], terms, 1)
        dense[who, row] = p
        order = np.lexsort((row, who))  # the same matrix by source
        by = np.searchsorted(who[order], np.arange(wide + 1))
        for a in range(wide):
            mine = order[by[a] : by[a + 1]]
            # Terms that the source has: their p against every other source's.
            other = dense[:, row[mine]]
            self.sums[a] += (distance(p[mine], other) - distance(self.none[a], other)).sum(1)
            # All terms, as if it had none: f depends on the other source's count alone.
            q, times = np.unique(np.append(p[mine], self.none[a]), return_counts=True)
            times[np.searchsorted(q, self.none[a])] += terms - len(mine) - 1
            self.sums[:, a] += (distance(self.none[:wide, None], q) * times).sum(1)
        whole = np.add.reduceat(n, indptr[:-1]) if terms else n
        q = share(whole, self.total[-1])[row]
        more = np.flatnonzero(p > q)
        return more, who[more], distance(p[more], q[more])


def _best(who: np.ndarray, value: np.ndarray, top: int) -> np.ndarray:
    """Entries with at least the top-th largest value of their source: a superset of its first ones."""
    order = np.lexsort((-value, who))
    w, v = who[order], value[order]
    head = np.searchsorted(w, w, "left")
    last = np.minimum(head + top - 1, np.searchsorted(w, w, "right") - 1)
    return order[v >= v[last]]


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = term_counts(docs, text, lang, source)
    matrix = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("entries"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    matrix = scratch.save(matrix.select("lang", "term", F.col("entries.source").alias("sources"), F.col("entries.n").alias("n")))
    scratch.tidy()
    groups = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).distinct()
    sums = matrix.select("lang", F.explode(F.arrays_zip("sources", "n")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.n").alias("n"))
    kept = {r["lang"]: r["v"] for r in matrix.groupBy("lang").agg(F.count(F.lit(1)).alias("v")).collect()}
    found: dict[str, list] = {}
    for r in groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).collect():
        found.setdefault(r["lang"], []).append((r["source"], r["n"]))
    known: dict[str, tuple[list[str], list[int]]] = {}
    for k, v in found.items():
        v.sort(key=lambda x: x[0].encode())
        known[k] = ([s for s, _ in v], [n + kept.get(k, 0) for n in (*(n for _, n in v), sum(n for _, n in v))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, Language] = {}
        shape = ["lang", "source", "part", "item", "value"]

        def pack(name: str, at: Language, who: np.ndarray, part: str, items: pa.Array, value: np.ndarray) -> pa.RecordBatch:
            n = len(value)
            return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(at.sources, pa.string()).take(pa.array(who)), pa.array([part] * n, pa.string()), items, pa.array(value, pa.int64())], shape)

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for no, name in enumerate(langs.dictionary.to_pylist()):
                rows = np.flatnonzero(langs.indices.to_numpy(zero_copy_only=False) == no)
                if name not in state:
                    state[name] = Language(*known[name])
                at = state[name]
                step = max(1, CELLS // len(at.sources))
                for lo in range(0, len(rows), step):
                    mine = batch.take(pa.array(rows[lo : lo + step]))
                    lists = mine.column(2)
                    who = pc.index_in(lists.flatten(), pa.array(at.sources, lists.type.value_type)).to_numpy(zero_copy_only=False).astype(np.int64)
                    indptr = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
                    n = mine.column(3).flatten().to_numpy(zero_copy_only=False)
                    entry, who_of, value = at.add(indptr, who, n)
                    best = _best(who_of, value, top)
                    term = np.searchsorted(indptr, entry[best], "right") - 1
                    yield pack(name, at, who_of[best], "term", mine.column(1).take(pa.array(term)), value[best])
        for name, at in state.items():
            a, b = np.nonzero(~np.eye(len(at.sources), dtype=bool))
            yield pack(name, at, a, "pair", pa.array(at.sources, pa.string()).take(pa.array(b)), at.sums[a, b])

    scored = scratch.save(matrix.mapInArrow(run, "lang string, source string, part string, item string, value bigint"))
    # Sources of a language without kept terms are 0 apart.
    other = groups.select("lang", F.col("source").alias("item"))
    zero = groups.join(other, "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = scored.filter("part = 'pair'").unionByName(zero).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = scored.filter("part = 'term'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """All documents: every pair of sources of a language, and each source's most over-represented terms."""
    return audit(table(spark, sf_dir, "documents"))


_TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT i) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + v.v))::BIGINT AS p, (1 + {SCALE}::HUGEINT * (k.n + 1) // (v.n + v.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM s WHERE part = 'pair' OR rank <= {TOP}"""
