"""Running a session: budgets, locks, cost, status, and the form of a structured query."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schema
from .evaluate import estimate_calls
from .graph import pinned

#: Tokens of a call, prices of a million tokens, seconds that a heartbeat holds.
TOKENS = {"verifier_in": 600 + 60 + 1200, "verifier_out": 250, "panel_in": 700 + 1500, "panel_out": 300}
PRICE_IN, PRICE_OUT = 3.0, 15.0
TTL = 90.0

#: The form of a structured query. Required paths, words allowed, sizes of texts and lists, ranges, types.
REQUIRED = (
    "task context questions constraints output task.title task.objective task.type context.background context.audience context.use_case "
    "questions.primary questions.secondary constraints.timeframe constraints.geography constraints.sources constraints.timeframe.start "
    "constraints.timeframe.end constraints.sources.required_types constraints.sources.min_quality output.format output.length output.structure"
).split()
ALLOWED = {
    "task.type": "exploratory comparative analytical predictive evaluative", "context.audience": "technical executive academic general policy_maker", "constraints.geography.scope": "global regional national local",
    "constraints.sources.min_quality": "A B C D", "output.format": "comprehensive_report executive_brief comparative_analysis literature_review technical_whitepaper policy_brief",
    "output.citation_style": "APA IEEE Chicago Harvard inline", "output.tone": "academic professional conversational technical",
}
SOURCE_TYPES = "peer_reviewed official_docs industry_reports news expert_opinion case_studies patents datasets"
TEXT_SIZES = {"task.title": (10, 100), "task.objective": (20, 500), "context.background": (50, 1000), "context.use_case": (20, 300), "questions.primary": (20, 300)}
LIST_SIZES = {"questions.secondary": (2, 7), "constraints.sources.required_types": (1, 8), "keywords": (3, 15)}
LEAST, MOST = {"output.length.min_words": 500}, {"output.length.max_words": 50000}


def query_schema() -> dict:
    """The form of a structured query as a JSON Schema."""
    root: dict = {}

    def part(path: str) -> dict:
        at = root
        for name in path.split("."):
            at = at.setdefault("properties", {}).setdefault(name, {})
        return at

    for path in (*REQUIRED, *ALLOWED, *TEXT_SIZES, *LIST_SIZES, *LEAST, *MOST):
        part(path)
    for path in REQUIRED:
        around, _, name = path.rpartition(".")
        (part(around) if around else root).setdefault("required", []).append(name)
    for path, words in ALLOWED.items():
        part(path)["enum"] = words.split()
    for path, (lo, hi) in TEXT_SIZES.items():
        part(path).update(minLength=lo, maxLength=hi)
    for path, (lo, hi) in LIST_SIZES.items():
        part(path).update(minItems=lo, maxItems=hi)
    part("constraints.sources.required_types")["items"] = {"enum": SOURCE_TYPES.split()}
    for path, n in LEAST.items():
        part(path)["minimum"] = n
    for path, n in MOST.items():
        part(path)["maximum"] = n
    return root


def query_errors(text: Column) -> Column:
    """Faults of a structured query (JSON text) as ``path: fault``, in a fixed order; none: an empty array."""
    return schema.compiled(query_schema())(text)


class Spending:
    """What some requests in turn make of any amount that is left before them: pieces of the range 0..total.

    From its start on, a piece gives the amount plus ``add`` (or ``add`` alone, where it is ``fixed``), and says
    whether a request was denied.
    """

    def __init__(self, total: int) -> None:
        self.total, self.pieces = total, [(0, 0, False, False)]  # start, add, fixed, denied
        self.settled = math.inf  # a request of more changes nothing: all amounts are lower by now, and denied before

    def take(self, n: int, back: bool) -> None:
        if n <= 0 or n > self.settled and not back:
            return
        out, ends = [], [p[0] for p in self.pieces[1:]] + [self.total + 1]
        for (start, add, fixed, denied), end in zip(self.pieces, ends, strict=True):
            if back:
                low, high = (start, add + n, fixed, denied), (self.total, True, denied)
                at = self.total - n - add + 1  # from here on the total is reached
            else:
                low, high = (start, add, fixed, True), (add - n, fixed, denied)
                at = n - add
            if fixed:  # one value, on one side
                at = start if (add + n > self.total if back else add >= n) else end
            if at > start:
                out.append(low)
            if at < end:
                out.append((max(at, start), *high))
        self.pieces, ends = [], [p[0] for p in out[1:]] + [self.total + 1]
        for (start, add, fixed, denied), end in zip(out, ends, strict=True):
            # A piece of one amount gives one value, so what is used up becomes one piece whatever it began with.
            p = (start, start + add, True, denied) if end - start == 1 and not fixed else (start, add, fixed, denied)
            if not self.pieces or p[1:] != self.pieces[-1][1:]:
                self.pieces.append(p)
        self.settled = max(add if fixed else end - 1 + add for (_, add, fixed, _), end in zip(out, ends, strict=True)) if all(p[3] for p in out) else math.inf

    def after(self, left: int) -> tuple[int, bool]:
        _, add, fixed, denied = self.pieces[bisect.bisect_right(self.pieces, left, key=lambda p: p[0]) - 1]
        return (add if fixed else left + add), denied


def budget(requests: DataFrame, total: int, key: str, order: str, amount: str, returned: str | None = None, tasks: int | None = None) -> DataFrame:
    """key, order, granted, remaining, exhausted of requests of any size, taken in turn: one is granted whole or not at all.

    Zero, less and null are granted for nothing. Rows with ``returned`` give their amount back, up to the
    total. exhausted: a request was denied, this one or one before it. Rows that share key and order go by amount.

    Rows are dealt by ranges of key and order, so a key with a third of all requests is in many tasks. Where a key is in
    several, each of them first says what it makes of any amount (``Spending``, at most one piece for each unit of the
    total); those are applied in order of the ranges, and each task then starts with what is left for it.
    """
    rows = requests.select(F.col(key).cast("string").alias("k"), F.col(order).cast("long").alias("o"), F.coalesce(F.col(amount), F.lit(0)).cast("long").alias("n"), (F.coalesce(F.col(returned), F.lit(False)) if returned else F.lit(False)).alias("back"))
    dealt = rows.repartitionByRange(tasks, "k", "o") if tasks else rows.repartitionByRange("k", "o")
    rows = pinned(dealt.withColumn("part", F.spark_partition_id()))
    shares = pinned(rows.select("part", "k").distinct())
    split = shares.groupBy("k").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select(F.col("k").alias("j"))
    in_order = lambda df: df.repartition("part").sortWithinPartitions("part", "k", "o", "n", "back")

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        shape = pa.schema([("part", pa.int32()), ("k", pa.string()), ("pieces", pa.list_(pa.struct([("start", pa.int64()), ("add", pa.int64()), ("fixed", pa.bool_()), ("denied", pa.bool_())])))])

        def row() -> pa.RecordBatch:
            pieces = [dict(zip(("start", "add", "fixed", "denied"), p, strict=True)) for p in held.pieces]
            return pa.RecordBatch.from_pylist([{"part": now[0], "k": now[1], "pieces": pieces}], shape)

        for batch in batches:
            for part, k, n, back in zip(*(batch.column(c).to_pylist() for c in ("part", "k", "n", "back")), strict=True):
                if (part, k) != now:
                    if held:
                        yield row()
                    now, held = (part, k), Spending(total)
                held.take(n, back)
        if held:
            yield row()

    said = in_order(rows.join(split, F.col("k").eqNullSafe(F.col("j")), "left_semi")).mapInArrow(say, "part int, k string, pieces array<struct<start:bigint,add:bigint,fixed:boolean,denied:boolean>>")

    def follow(parts: pa.Table) -> pa.Table:
        left, out, out_of, held = total, [], False, Spending(total)
        for r in sorted(parts.to_pylist(), key=lambda r: r["part"]):
            out.append({"part": r["part"], "k": r["k"], "left": left, "out": out_of})
            held.pieces = [(p["start"], p["add"], p["fixed"], p["denied"]) for p in r["pieces"]]
            left, denied = held.after(left)
            out_of = out_of or denied
        return pa.Table.from_pylist(out, pa.schema([("part", pa.int32()), ("k", pa.string()), ("left", pa.int64()), ("out", pa.bool_())]))

    starts = said.groupBy("k").applyInArrow(follow, "part int, k string, left bigint, out boolean").alias("s")
    r = rows.alias("r")
    begun = r.join(starts, (F.col("r.part") == F.col("s.part")) & F.col("r.k").eqNullSafe(F.col("s.k")), "left").select("r.*", F.coalesce("left", F.lit(total)).cast("long").alias("left"), F.coalesce("out", F.lit(False)).alias("out"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, out_of = None, total, False
        for batch in batches:
            done: list[tuple] = []
            for part, k, n, back, start, out in zip(*(batch.column(c).to_pylist() for c in ("part", "k", "n", "back", "left", "out")), strict=True):
                if (part, k) != now:
                    now, left, out_of = (part, k), start, out
                fits = back or n <= left or n <= 0
                left = min(total, left + max(n, 0)) if back else left - max(n, 0) if fits else left
                out_of = out_of or not fits
                done.append((fits, left, out_of))
            granted, remaining, exhausted = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("o"), pa.array(granted, pa.bool_()), pa.array(remaining, pa.int64()), pa.array(exhausted, pa.bool_())], ["k", "o", "granted", "remaining", "exhausted"])

    done = in_order(begun).mapInArrow(take, "k string, o bigint, granted boolean, remaining bigint, exhausted boolean")
    return done.select(F.col("k").cast(requests.schema[key].dataType).alias(key), F.col("o").alias(order), "granted", "remaining", "exhausted")


def estimate_run(high_risk: Column, per_claim: float = 2.0, share: float = 1.0, price_in: float = PRICE_IN, price_out: float = PRICE_OUT) -> dict[str, Column]:
    """Calls under the caps, their tokens, and dollars to four places."""
    calls = estimate_calls(high_risk, per_claim, share)
    v, p = calls["verifier_calls"], calls["panel_calls"]
    read, wrote = v * TOKENS["verifier_in"] + p * TOKENS["panel_in"], v * TOKENS["verifier_out"] + p * TOKENS["panel_out"]
    return calls | {"input_tokens": read, "output_tokens": wrote, "total_tokens": read + wrote, "usd": F.bround(read / 1e6 * price_in + wrote / 1e6 * price_out, 4)}


def lock_outcome(held: Column, mine: Column, same_process: Column, alive: Column, age: Column, force: Column, ttl: float = TTL) -> dict[str, Column]:
    """granted, outcome of asking for a session's lock; age: seconds since its last heartbeat.

    A holder that lives, or died with a fresh heartbeat, keeps it unless forced; a dead and stale one loses it.
    """
    stale = age > ttl
    other = held & ~mine
    refused = F.when(other & ~force & alive & stale, "live holder, stale heartbeat").when(other & ~force & alive, "live holder").when(other & ~force & ~stale, "dead holder, fresh heartbeat")
    return {"granted": refused.isNull(), "outcome": F.coalesce(refused, F.when(~held, "acquired").when(same_process, "reacquired").otherwise("reclaimed"))}


def holder_may(held: Column, mine: Column) -> Column:
    """May the asker refresh the heartbeat, or let go of the lock? Only who holds it."""
    return F.coalesce(held & mine, F.lit(False))


def is_stale(held: Column, age: Column, ttl: float = TTL) -> Column:
    return F.coalesce(held & (age > ttl), F.lit(False))


def session_status(sessions: DataFrame) -> DataFrame:
    """session_id, next_phase, state, done, of: the first phase that isn't completed. sessions: session_id, phase, state.

    In-progress and pending phases wait; a session without any is complete (next_phase is null).
    """
    waits = F.coalesce(F.col("state") != "completed", F.lit(True))
    agg = sessions.groupBy("session_id").agg(F.min(F.when(waits, F.struct("phase", "state"))).alias("at"), F.count_if(~waits).alias("done"), F.count(F.lit(1)).alias("of"))
    return agg.select("session_id", F.col("at.phase").alias("next_phase"), F.when(F.col("at").isNull(), "complete").otherwise(F.coalesce("at.state", F.lit("pending"))).alias("state"), "done", "of")
