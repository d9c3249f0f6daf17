"""Which documents hold which passages, and what a fetched page is."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_CHARS = 16 << 20
#: Documents that are searched, and hits that are told, at a time.
PIECE = 256
#: Words of pages that are no content, and the empty root of a page that scripts fill.
LOGIN = ["login", "sign in", "로그인", "password"]
CAPTCHA = ["captcha", "verify", "robot", "보안 인증"]
REFUSED = ["404", "not found", "access denied"]
SHELL = ["<noscript>", '<div id="root"></div>']
#: Characters: of a page's top, of a page too short to be one, of a whole text.
TOP, SHORT, WHOLE = 500, 200, 1000


def holding(docs: DataFrame, items: DataFrame, form: Callable[[Column], Column] = lambda c: c, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, span, doc_id, snapshot of every document whose text holds an item's, both in a form (as they are by default).

    docs: doc_id, text; items: item_id, text: a stated query set. Its texts go to the tasks in blocks of
    a checked size, one automaton each, and every block passes over all documents; whatever their
    length and wherever they stand, passages are found. Empty items are in no document.
    """
    import ahocorasick

    spans = items.select("item_id", F.col("text").alias("span"), form(F.col("text")).alias("form")).filter("form <> ''").orderBy("item_id")
    shape = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("span", T.StringType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("snapshot", T.StringType())])
    id_type = to_arrow_type(shape[0].dataType)
    blocks, size = [[]], 0
    for r in spans.toLocalIterator():
        if size + len(r["form"]) > block_chars and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((r["item_id"], r["span"], r["form"]))
        size += len(r["form"])
    rows = docs.select("doc_id", F.col("text").alias("snapshot"), form(F.col("text")).alias("form")).filter("form is not null")

    def pass_over(block: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = ahocorasick.Automaton()
            for i, (_, _, text) in enumerate(block):
                auto.add_word(text, [*auto.get(text, []), i])
            auto.make_automaton()
            for batch in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
                row, item = [], []
                for at, text in enumerate(batch.column(2)):
                    hit = {i for _, found in auto.iter(text.as_py()) for i in found}
                    row += [at] * len(hit)
                    item += sorted(hit)
                for i in range(0, len(row), PIECE):  # each hit carries its whole text
                    where, of = pa.array(row[i : i + PIECE], pa.int64()), item[i : i + PIECE]
                    cols = [pa.array([block[j][0] for j in of], id_type), pa.array([block[j][1] for j in of], pa.string()), batch.column(0).take(where), batch.column(1).take(where)]
                    yield pa.RecordBatch.from_arrays(cols, shape.names)

        return rows.mapInArrow(run, shape)

    blocks = [b for b in blocks if b]
    if not blocks:
        return docs.sparkSession.createDataFrame([], shape)
    found = pass_over(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(pass_over(block))
    return found


def fetch_class(html: Column, keywords: list[str] | None = None, status: Column | None = None) -> Column:
    """What a fetched page is: captcha, login, error, empty (scripts fill it), success or partial.

    Success takes ``WHOLE`` characters and, with keywords, one of them. status: the HTTP code, if known.
    """
    text = F.coalesce(html, F.lit(""))
    low, top = F.lower(text), F.lower(F.substring(text, 1, TOP))
    some = lambda where, words: F.greatest(*[where.contains(w) for w in words], F.lit(False))
    bare = F.trim(F.regexp_replace(F.regexp_replace(low, "(?s)<(script|style|noscript|head)[^>]*>.*?</\\1>", ""), "<[^>]*>", ""))
    on_topic = some(low, [k.lower() for k in keywords]) if keywords else F.lit(True)
    refused = some(low, REFUSED) | (F.coalesce(status >= 400, F.lit(False)) if status is not None else F.lit(False))
    empty = some(low, SHELL) & (bare == "")
    return (
        F.when(empty, "empty").when(some(low, CAPTCHA) | (F.char_length(text) < SHORT), "captcha").when(some(top, LOGIN), "login").when(refused, "error")
        .when((F.char_length(text) >= WHOLE) & on_topic, "success").otherwise("partial")
    )


def grade_histogram(sources: DataFrame, grade: Column) -> DataFrame:
    """grade, n and a bar of n blocks for each grade that occurs."""
    return sources.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n")).withColumn("bar", F.expr("repeat('█', cast(n as int))"))
