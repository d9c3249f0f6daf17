"""Multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once: that speaker's turns as
the assistant and with the loss mask on, all others as named users with the mask off. The result has
one row per conversation, perspective and turn with the rendered segment and its place in the
dialogue (``char_start``, ``char_end``, in characters), so that a conversation of any length is never
gathered in one task; joining a perspective's segments in ``position`` order gives its text.

Order is turn, then role, then text (nulls first). Null role: ``unknown``; null text: empty; rows with
a null conversation id form one conversation. Equal rows are kept: they are counted, placed side by
side and told apart by position only. Names are ASCII letters, digits, ``_`` and ``-``; a role with
other characters gets ``_`` for each and a hash of itself at the end, so it neither breaks out of its
header nor shares a name with another. ``<|im_`` in a text becomes ``<\\|im_``: a turn can't forge a
header. An empty table gives an empty result, and other columns are not read. Texts of any length are
whole. Positions are summed by blocks of ``BLOCK_TURNS`` turn numbers; turns of one number (or none)
are one block, which a task sorts on disk where need be and never holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Turns in one block: positions are summed by block first, then inside each block.
BLOCK_TURNS = 256
HEAD, MID, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
#: What starts a mark, and how a text's own is spelled.
MARK, SPELLED = "<|im_", "<\\|im_"


def _null_safe(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, position, turn, speaker, role, name, segment, char_start, char_end, mask."""
    rows = (
        turns.select(
            F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("speaker"), F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(MARK), F.lit(SPELLED)).alias("text")
        )
        .groupBy("conv_id", "turn", "speaker", "text")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("block", F.floor(F.col("turn") / block_turns))
    )
    # A conversation's participants, and its blocks, are few next to its turns.
    blocks = rows.groupBy("conv_id", "block", "speaker").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.char_length("text")).alias("chars"))
    speakers = blocks.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # Length of a segment beside its text: assistants and users have headers of fixed and of name length.
    is_own = F.col("speaker") == F.col("perspective")
    clean = F.regexp_replace("speaker", "[^A-Za-z0-9_-]", "_")
    name = F.when(clean == F.col("speaker"), clean).otherwise(F.concat(clean, F.lit("-"), F.substring(F.md5("speaker"), 1, 8)))
    frame = len(HEAD + MID + TAIL)
    extra = F.when(is_own, F.lit(frame + len("assistant"))).otherwise(F.char_length(name) + frame + len("user name="))
    b, s = blocks.alias("b"), speakers.alias("s")
    per_block = (
        b.join(s, _null_safe(F.col("b.conv_id"), F.col("s.conv_id")))
        .select("b.conv_id", "block", "speaker", "perspective", "n", "chars")
        .groupBy("conv_id", "perspective", "block")
        .agg(F.sum("n").alias("n"), F.sum(F.col("chars") + F.col("n") * extra).alias("chars"))
    )
    before = W.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    starts = per_block.select("conv_id", "perspective", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("c0"))
    r, t = rows.alias("r"), starts.alias("t")
    placed = r.join(t, _null_safe(F.col("r.conv_id"), F.col("t.conv_id")) & _null_safe(F.col("r.block"), F.col("t.block"))).select("r.conv_id", "perspective", "r.block", "turn", "speaker", "text", "times", "n0", "c0")
    inside = W.partitionBy("conv_id", "perspective", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(W.unboundedPreceding, -1)
    segment = F.when(is_own, F.concat(F.lit(HEAD + "assistant" + MID), "text", F.lit(TAIL))).otherwise(F.concat(F.lit(HEAD + "user name="), name, F.lit(MID), "text", F.lit(TAIL)))
    size = F.char_length("text") + extra
    return (
        placed.withColumn("p0", F.col("n0") + F.coalesce(F.sum("times").over(inside), F.lit(0)))
        .withColumn("a0", F.col("c0") + F.coalesce(F.sum(F.col("times") * size).over(inside), F.lit(0)))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
        .select(
            "conv_id", "perspective", (F.col("p0") + F.col("copy")).cast("long").alias("position"), "turn", "speaker", F.when(is_own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
            F.when(~is_own, name).alias("name"), segment.alias("segment"), (F.col("a0") + F.col("copy") * size).cast("long").alias("char_start"),
            (F.col("a0") + (F.col("copy") + 1) * size).cast("long").alias("char_end"), is_own.alias("mask"),
        )
    )


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    return rotate(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<\|im_') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t
), s AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.text, t.speaker = p.perspective AS mask,
         regexp_replace(t.speaker, '[^A-Za-z0-9_-]', '_', 'g') || CASE WHEN regexp_matches(t.speaker, '[^A-Za-z0-9_-]') THEN '-' || substr(md5(t.speaker), 1, 8) ELSE '' END AS clean
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), r AS (
  SELECT *, CASE WHEN mask THEN '<|im_start|>assistant' || chr(10) || text || '<|im_end|>' || chr(10)
            ELSE '<|im_start|>user name=' || clean || chr(10) || text || '<|im_end|>' || chr(10) END AS segment,
         row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text) - 1 AS position
  FROM s
), e AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY position) AS BIGINT) AS char_end FROM r
)
SELECT conv_id, perspective, CAST(position AS BIGINT) AS position, turn, speaker,
       CASE WHEN mask THEN 'assistant' ELSE 'user' END AS role, CASE WHEN NOT mask THEN clean END AS name,
       segment, CAST(char_end - length(segment) AS BIGINT) AS char_start, char_end, mask FROM e
"""
