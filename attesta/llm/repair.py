"""Conversation structure repair by a higher-order fold in Spark SQL.

Windows derive each turn's first fault: ``blank`` (no other characters than blanks), ``duplicate`` (its role and
text came earlier in the conversation) or ``truncated`` (it doesn't end in ``.``, ``!`` or ``?``). The turns
are collected in order as small structs without their texts, and ``aggregate`` carries four (cost, audit)
structs through them: the cheapest edits so far that leave nothing, a system turn, a user turn or an
assistant turn as the last one. ``least`` of such structs is the cheaper one, then the smaller audit in ASCII; a state
that can't be reached is null, which ``least`` leaves out. Appending the same letters keeps the order of
two audits of equal cost (neither can be a prefix of the other), so carrying the least alone is exact.

Edits: Keep costs 0; Rerole (to user or assistant) 2; Delete 3, required for blank and duplicate turns; Insert
a user or assistant turn without text 2; a truncated turn that stays adds 1. What is left must have the
role initials ``(s?(ua)+)?``, so the state alone tells what an insert or a new role is.

A conversation is folded in pieces of at most ``PIECE`` turns, from each of the four states that may come before
a piece; pieces are composed ``FAN`` at a time, level by level, until each conversation is one. So neither a conversation
with a third of all rows nor one of many turns is gathered: only the letters of its audit are. Texts
come back by a join, and a conversation's repaired turns go through one task in order, one at a time, which a digest of
all of them demands.

Order: turn (nulls first), then role, then the SHA-256 of the text. Null roles and texts are one space; turns
of a null conversation id form one conversation. Equal rows are counted and stand side by side; all but the
first are duplicates. The role's initial is its first character; an empty role's is none, so it can't be kept.
Null turns count for order only. A span of turns beyond 64 bits has null gaps. Texts are whole. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

BLANK = " \t\n\x0b\x0c\r"
PIECE = 256
FAN = 64
#: Turn numbers of a block: places are summed by block first.
BLOCK_TURNS = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
STATES = ("o", "s", "u", "a")
_BEST = "struct<cost:bigint,audit:string>"
_STATE = f"struct<{','.join(f'{x}:{_BEST}' for x in STATES)}>"
TURN = "conv_id bigint, position bigint, role string, text string, edit string"


def damage(turns: DataFrame) -> DataFrame:
    """A stated fault for about a quarter of all turns, by a hash of conversation and turn."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _add(best: Column, cost: Column | int, letters: Column) -> Column:
    return F.when(best.isNotNull(), F.struct((best["cost"] + cost).alias("cost"), F.concat(best["audit"], letters).alias("audit")))


def _state(o: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(o.alias("o"), s.alias("s"), u.alias("u"), a.alias("a"))


def _closed(x: Column) -> Column:
    """The states that inserts lead to as well."""
    i = F.lit("I")
    user = F.least(x["u"], _add(F.least(x["o"], x["s"], x["a"]), INSERT, i))
    return _let(user, lambda u: _state(x["o"], x["s"], u, F.least(x["a"], _add(u, INSERT, i))))


def _fold_turn(x: Column, t: Column) -> Column:
    """One turn with its copies, all of which but the first go."""
    copies = t["times"] - 1
    gone = F.repeat(F.lit("D"), copies.cast("int"))

    def delete(best: Column) -> Column:
        return _add(best, DELETE * t["times"], F.concat(F.lit("D"), gone))

    def stay(best: Column, initial: str, rerole: bool = True) -> Column:
        left = DELETE * copies + F.when(t["truncated"], TRUNCATED).otherwise(0)
        kept = F.when(t["initial"] == initial, _add(best, left + KEEP, F.concat(F.lit("K"), gone)))
        new = _add(best, left + REROLE, F.concat(F.lit("R"), gone)) if rerole else F.lit(None).cast(_BEST)
        return F.when(~t["must"], F.least(kept, new))

    before_user = F.least(x["o"], x["s"], x["a"])
    stepped = _state(delete(x["o"]), F.least(delete(x["s"]), stay(x["o"], "s", False)), F.least(delete(x["u"]), stay(before_user, "u")), F.least(delete(x["a"]), stay(x["u"], "a")))
    return _let(stepped, _closed)


def _fold_piece(x: Column, p: Column) -> Column:
    """What comes before, then a piece, over every state between them."""

    def to(state: str) -> Column:
        ways = []
        for i, name in enumerate(STATES):
            left, right = x[name], F.get(p["ways"], F.lit(i))[state]
            ways.append(F.when(left.isNotNull() & right.isNotNull(), F.struct((left["cost"] + right["cost"]).alias("cost"), F.concat(left["audit"], right["audit"]).alias("audit"))))
        return F.least(*ways)

    return _state(*map(to, STATES))


def _ways(items: str, fold: Callable[[Column, Column], Column]) -> Column:
    """The fold from each state that may come before; before a conversation's first piece there is nothing."""
    starts = F.when(F.col("no") == 0, F.array(F.lit("o"))).otherwise(F.array(*map(F.lit, STATES)))
    unit = lambda s, name: F.when(s == name, F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit")))
    return F.transform(starts, lambda s: F.aggregate(items, _closed(_state(*(unit(s, x) for x in STATES))).cast(_STATE), lambda x, t: fold(x, t).cast(_STATE)))


def _illegal(items: str, last: str, first: str) -> Column:
    """Neighbours whose initials can't follow each other."""
    pairs = F.transform(items, lambda t, i: F.concat(F.get(F.col(items), i - 1)[last], t[first]))
    return F.size(F.filter(pairs, lambda x: x.isNotNull() & ~x.isin(*LEGAL))).cast("long")


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def outlined(turns: DataFrame) -> DataFrame:
    """Turns without texts: equal ones once, with their faults and ``place`` in the conversation."""
    blank, last = F.ltrim("text", F.lit(BLANK)) == "", F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)
    rows = _plain(turns).select("conv_id", "turn", "role", "digest", blank.alias("blank"), ~last.isin(".", "!", "?") & ~blank, F.substring("role", 1, 1).alias("initial")).toDF("conv_id", "turn", "role", "digest", "blank", "open", "initial")
    rows = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in ("blank", "open", "initial")])
    nth = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    rows = rows.withColumn("again", (nth > 1) & ~F.col("blank")).withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("times").alias("n"))
    before = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0")).alias("b")
    inside = W.partitionBy("r.conv_id", "r.block").orderBy(F.asc_nulls_first("turn"), "role", "digest").rowsBetween(W.unboundedPreceding, -1)
    r = rows.alias("r")
    placed = r.join(starts, F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("r.block").eqNullSafe(F.col("b.block")))
    n = F.col("times")
    return placed.select(
        "r.conv_id", "turn", "role", "digest", "initial", "times", (F.col("blank") | F.col("again")).alias("must"), (F.col("open") & ~F.col("again")).alias("cut"),
        F.when(F.col("blank"), n).otherwise(0).alias("blank"), F.when(F.col("blank"), 0).when(F.col("again"), n).otherwise(n - 1).alias("duplicate"),
        (F.col("n0") + F.coalesce(F.sum("times").over(inside), F.lit(0))).alias("place"),
    )


def _plain(turns: DataFrame) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text")).withColumn("digest", F.sha2("text", 256))


def edits(outline: DataFrame, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """conv_id, counts of faults, illegal, cost, audit. ``outline`` is read twice: save it first."""
    item = F.struct("place", "initial", "must", F.col("cut").alias("truncated"), "times")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate")]
    pieces = outline.groupBy("conv_id", F.floor(F.col("place") / piece).alias("no")).agg(F.sort_array(F.collect_list(item)).alias("turns"), *sums, F.sum(F.col("cut").cast("long")).alias("truncated"), F.sum(F.col("times") - 1).alias("beside"))
    ends = [F.col("turns")[0]["initial"].alias("first"), F.element_at("turns", -1)["initial"].alias("last")]
    pieces = pieces.select("conv_id", "no", "blank", "duplicate", "truncated", (_illegal("turns", "initial", "initial") + F.col("beside")).alias("illegal"), *ends, _ways("turns", _fold_turn).alias("ways"))
    top = (outline.agg(F.max("place")).first()[0] or 0) // piece
    while top:
        part = F.struct("no", "first", "last", "ways")
        pieces = pieces.groupBy("conv_id", F.floor(F.col("no") / fan).alias("no")).agg(F.sort_array(F.collect_list(part), asc=True).alias("parts"), *[F.sum(c).alias(c) for c in COUNTS])
        ends = [F.col("parts")[0]["first"].alias("first"), F.element_at("parts", -1)["last"].alias("last")]
        pieces = pieces.select("conv_id", "no", "blank", "duplicate", "truncated", (F.col("illegal") + _illegal("parts", "last", "first")).alias("illegal"), *ends, _ways("parts", _fold_piece).alias("ways"))
        top //= fan
    found = F.col("ways")[0]
    return pieces.select("conv_id", *COUNTS, F.least(found["o"], found["a"]).alias("best")).select("conv_id", *COUNTS, "best.cost", "best.audit")


def repaired(turns: DataFrame, outline: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position, role, text, edit; a conversation's are in order in one partition."""
    letters = F.concat(F.regexp_extract_all("audit", F.lit("I*[KRD]"), 0), F.array(F.regexp_extract("audit", "I*$", 0)))
    steps = found.select("conv_id", F.posexplode(letters).alias("place", "step")).filter("step not in ('', 'D')").alias("s")
    o, t = outline.select("conv_id", "place", "turn", "role", "digest").alias("o"), _plain(turns).groupBy("conv_id", "turn", "role", "digest").agg(F.first("text").alias("text")).alias("t")
    steps = steps.join(o, F.col("s.conv_id").eqNullSafe(F.col("o.conv_id")) & (F.col("s.place") == F.col("o.place")), "left").select("s.conv_id", "s.place", "step", "turn", "role", "digest").alias("p")
    same = F.col("p.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("p.turn").eqNullSafe(F.col("t.turn")) & (F.col("p.role") == F.col("t.role")) & (F.col("p.digest") == F.col("t.digest"))
    whole = steps.join(t, same, "left").select("p.conv_id", "place", "step", "p.role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, following = (), 0, "user"
        for batch in batches:
            rows = []
            for c, _, step, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    conv, position, following = c, 0, "user"
                for edit in step:
                    if edit == "D":
                        continue
                    now = role if edit == "K" else following
                    following = "assistant" if now[:1] == "u" else "user"
                    rows.append((c, position, now, "" if edit == "I" else text, edit))
                    position += 1
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["conv_id", "position", "role", "text", "edit"])

    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, TURN)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of turns as ``repaired`` gives them: ``role:text``, joined by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = (), None
        for batch in batches:
            out = []
            for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if sha:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield _digest_rows(out)
        if sha:
            yield _digest_rows([(conv, sha.hexdigest())])

    return turns.select("conv_id", "role", "text").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def repair(turns: DataFrame, ids: DataFrame | None = None, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; ``ids`` has the conversations that must be there."""
    scratch = Scratch(turns.sparkSession)
    outline = scratch.save(outlined(turns))
    found = scratch.save(edits(outline, piece, fan)).alias("f")
    wide = lambda c: c.cast("decimal(20,0)")
    missing = (wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count("turn"))).try_cast("bigint")
    # Distinct turns by conversation and turn first, so that no conversation is in one task.
    gaps = outline.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.when(F.count("turn") == 0, 0).otherwise(missing).alias("gaps")).alias("g")
    sha = digests(repaired(turns, outline, found)).alias("h")
    every = (turns if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("c")
    on = lambda x: F.col("c.conv_id").eqNullSafe(F.col(f"{x}.conv_id"))
    whole = every.join(found, on("f"), "left").join(gaps, on("g"), "left").join(sha, on("h"), "left")
    known = F.col("audit").isNotNull()
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return whole.select("c.conv_id", F.when(known, F.col("gaps")).otherwise(0).cast("long").alias("gaps"), *map(number, (*COUNTS, "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op11_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged as stated: their faults and the cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    return repair(damage(turns), turns)


def _plus(best: str, cost: str, letter: str) -> str:
    return f"printf('%09d', substr({best}, 1, 9)::BIGINT + {cost}) || substr({best}, 10) || '{letter}'"


#: A recursive walk over single turns: the best edits of a state are nine digits of cost, then the audit.
OP11_SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
bits(key, i, crc) AS (SELECT DISTINCT key, 0, 4294967295::UBIGINT FROM c
  UNION ALL SELECT key, i + 1, list_reduce(list_prepend(xor(crc, ascii(substr(key, i + 1, 1))::UBIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END) FROM bits WHERE i < length(key)),
kind AS (SELECT key, xor(crc, 4294967295::UBIGINT) % 20 AS kind FROM bits WHERE i = length(key)),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c JOIN kind USING (key) WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, substr(role, 1, 1) AS ini, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM n),
r AS (SELECT *, NOT blank AND NOT dup AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM f),
w(conv_id, i, o, s, u, a) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000002I', '000000004II' FROM r
  UNION ALL SELECT conv_id, i, o, s, v, least(a, {_plus("v", "2", "I")}) FROM (SELECT conv_id, i, o, s, a, least(u, {_plus("least(o, s, a)", "2", "I")}) AS v FROM (
    SELECT r.conv_id, r.i, {_plus("o", "3", "D")} AS o,
      least({_plus("s", "3", "D")}, CASE WHEN ini = 's' AND NOT (blank OR dup) THEN {_plus("o", "cut::INT", "K")} END) AS s,
      least({_plus("u", "3", "D")}, CASE WHEN ini = 'u' AND NOT (blank OR dup) THEN {_plus("least(o, s, a)", "cut::INT", "K")} END, CASE WHEN NOT (blank OR dup) THEN {_plus("least(o, s, a)", "2 + cut::INT", "R")} END) AS u,
      least({_plus("a", "3", "D")}, CASE WHEN ini = 'a' AND NOT (blank OR dup) THEN {_plus("u", "cut::INT", "K")} END, CASE WHEN NOT (blank OR dup) THEN {_plus("u", "2 + cut::INT", "R")} END) AS a
    FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))),
b AS (SELECT conv_id, least(o, a) AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
e AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS edit, generate_subscripts(string_split(substr(best, 10), ''), 1) AS j FROM b WHERE length(best) > 9),
g AS (SELECT *, sum((edit <> 'I')::INT) OVER x AS i, sum((edit <> 'D')::INT) OVER x AS m FROM e WINDOW x AS (PARTITION BY conv_id ORDER BY j)),
h AS (SELECT g.*, r.role, r.text, max((edit = 'K' AND m = 1 AND ini = 's')::INT) OVER (PARTITION BY g.conv_id) AS led FROM g LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i WHERE edit <> 'D'),
t AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY m)) AS sha FROM h GROUP BY 1),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dup::INT) AS duplicate, sum(cut::INT) AS truncated, count(*) FILTER (prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id"""
