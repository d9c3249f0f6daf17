"""Streams over files, in two batches each."""

import datetime as dt

import pytest

from attesta.operators import verdicts
from attesta.streaming import sessions


@pytest.fixture
def run(spark, tmp_path):
    """run(schema, batches, make): the rows that make(stream) appends, over one file per batch."""

    def go(schema, batches, make):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out").collect()

    return go


def test_running_budget(run):
    batches = [[("a", 2, 5), ("a", 1, 4), ("b", 1, None)], [("a", 3, 1), ("a", 4, 3), ("b", 2, 11), ("b", 3, 10)]]
    got = {(r["k"], r["i"]): (r["granted"], r["remaining"]) for r in run("k string, i bigint, n int", batches, lambda s: sessions.running_budget(s, 10, "k", "i", "n"))}
    assert got == {("a", 1): (True, 6), ("a", 2): (True, 1), ("a", 3): (True, 0), ("a", 4): (False, 0), ("b", 1): (True, 10), ("b", 2): (False, 10), ("b", 3): (True, 0)}


def test_intake(spark, run):
    frozen = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    batches = [[("a", 1), ("c", 2)], [("b", 3), (None, 4)]]
    late = run("id string, n int", batches, lambda s: sessions.intake(s, frozen)[1])
    assert {r["n"] for r in late} == {2, 4}


def test_sessions(run):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[("x", at(0)), ("x", at(60)), ("x", at(300))], [("x", at(100)), ("y", at(5000))]]
    got = {(r["key"], r["started"], r["beats"]) for r in run("key string, ts timestamp", batches, sessions.sessions)}
    assert got == {("x", at(0), 3), ("x", at(300), 1)}


def test_upsert_best(spark, tmp_path):
    schema = "claim_id string, source_id string, producer string, span_state string, _ord bigint"
    batches = [[("c", "s", "verifier", "failed", 1), ("d", "s", "verifier", "done", 5)], [("c", "s", "verifier", "done", 2), ("c", "t", "panel", "done", 3)], [("c", "s", "verifier", "done", 4)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        fold = lambda rows: verdicts.effective_verdicts(rows).drop("key_ord")
        query = sessions.upsert_best(stream, f"{tmp_path}/best", fold, ["claim_id"], 4).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        if i == 1:
            second = {(r["claim_id"], r["source_id"], r["_ord"]) for r in sessions.best(spark, f"{tmp_path}/best").collect()}
    assert second == {("c", "s", 2), ("c", "t", 3), ("d", "s", 5)}
    every = spark.createDataFrame([r for rows in batches for r in rows], schema)
    got = sessions.best(spark, f"{tmp_path}/best")
    assert sorted(map(tuple, got.select("claim_id", "source_id", "_ord").collect())) == sorted(map(tuple, fold(every).select("claim_id", "source_id", "_ord").collect()))
    # A replay of the last batch needs the one before it, and no other.
    assert sessions.best(spark, f"{tmp_path}/best", 1).where("claim_id = 'c'").count() == 2
    # The other claim's bucket is as the first batch wrote it, unless both share one.
    of = {r["claim_id"]: r["b"] for r in every.selectExpr("claim_id", "pmod(xxhash64(claim_id), 4) as b").distinct().collect()}
    folders = {p.name: sorted(int(x.name.partition("=")[2]) for x in p.glob("bucket=*")) for p in (tmp_path / "best").glob("epoch=*")}
    assert of["d"] in folders["epoch=0"] or of["c"] == of["d"]
    assert of["c"] not in folders["epoch=0"]
    # A batch that was cut off isn't read.
    (tmp_path / "best" / "epoch=2" / "_SUCCESS").unlink()
    assert {(r["source_id"], r["_ord"]) for r in sessions.best(spark, f"{tmp_path}/best").where("claim_id = 'c'").collect()} == {("s", 2), ("t", 3)}
