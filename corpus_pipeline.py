"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``. Nulls, empty texts, repeated rows and empty tables: as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import decontam, lines, neardup, packing, quality
from attesta.llm.common import Scratch, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts; it is trained on labelled rows of the raw documents."""
    return quality.classify(docs, quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that nearly equal an earlier one; documents left without words go."""
    return lines.drop_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies (five words, similarity 0.8)."""
    return neardup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as sequences of at most 2048 ids: one row per piece."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packed)]

#: A trained classifier, MinHash components and a tokenizer are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
