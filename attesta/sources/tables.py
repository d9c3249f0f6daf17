"""Reading and writing the engine's tables: JSON lines, text folders, frozen snapshots, signed runs."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import versions
from .scratch import Scratch


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at a path, or one that matches a pattern?"""
    fs, where = _fs(spark, path)
    return bool(fs.globStatus(where))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), _ord (over all files, in order of their names), value of every line, blank ones too.

    Lines of one split follow each other in one partition, so a line's place in its split is known from
    the row's number; one small row per split (its first number and how many) gives the rest.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = splits.select("file", "block", "first", earlier(W.partitionBy("file").orderBy("block")).alias("in_file"), earlier(W.orderBy("file", "block")).alias("in_all"))
    at = F.col("id") - F.col("first")
    return rows.join(place, ["file", "block"]).select("file", (at + F.col("in_file") + 1).alias("line"), (at + F.col("in_all")).alias("_ord"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "strict", missing: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows with ``_ord`` (their place in file order), and errors (file, line, raw).

    strict: bad lines are errors; lenient: they are dropped; raising: the read fails. Blank lines count
    as places, not as rows. Of a path with versions (``publish_jsonl``) the newest is read. missing: ``none`` makes an absent file an empty table.
    """
    path = versions.current(spark, path) or path
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        path = f"{path}.old"
    nothing = spark.createDataFrame([], "file string, line bigint, raw string")
    if missing == "none" and not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_ord", T.LongType())])), nothing
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "FAILFAST" if mode == "raising" else "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines(spark, path).filter(F.trim("value") != "").select("file", "line", "_ord", "value", F.from_json("value", schema if mode == "raising" else full, options).alias("r"))
    if mode == "raising":
        return parsed.select("r.*", "_ord"), nothing
    good = parsed.filter(F.col("r._corrupt").isNull()).select("r.*", "_ord").drop("_corrupt")
    bad = parsed.filter(F.col("r._corrupt").isNotNull()).select("file", "line", F.col("value").alias("raw"))
    return good, bad if mode == "strict" else nothing


def read_document(spark: SparkSession, path: str, schema: T.StructType, default: list | None = None) -> DataFrame:
    """The records of one JSON document (an array or an object); the default where it is missing or isn't JSON."""
    other = spark.createDataFrame(default or [], schema)
    if not exists(spark, path):
        return other
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = Scratch(spark).save(rows)
    broken = rows.filter(F.col("_corrupt").isNotNull()).limit(1).count()
    return other if broken else rows.drop("_corrupt")


def read_folder(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """path, text of every matching file below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_body(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """One row: the texts below a folder, in order of their paths, joined by line breaks. A report's size, no corpus."""
    if not exists(spark, path):
        return spark.createDataFrame([("",)], "text string")
    parts = F.sort_array(F.collect_list(F.struct("path", "text")))
    return read_folder(spark, path, glob).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))


def read_labels(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """labeler, unit_id, label from files named labeler_<name>.jsonl; the last row of each labeler and unit."""
    full = lines(spark, glob).filter(F.trim("value") != "").select(F.regexp_extract("file", r"labeler_([^/]*)\.jsonl$", 1).alias("labeler"), "_ord", F.from_json("value", schema).alias("r"))
    return last_labels(full.select("labeler", "_ord", "r.*"))


def file_hashes(spark: SparkSession, paths: dict[str, str]) -> dict[str, str | None]:
    """Name to SHA-256 of a file's bytes, null for absent files; files are hashed by the executors."""
    there = {k: p for k, p in paths.items() if exists(spark, p)}
    out: dict[str, str | None] = dict.fromkeys(paths)
    for name, path in there.items():  # few files, named by the caller
        out[name] = "sha256:" + spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    return out


def freeze_bench(spark: SparkSession, paths: dict[str, str], frozen_at: str | None = None) -> dict:
    """A signed manifest of a benchmark's files."""
    manifest = {"frozen_at": frozen_at, "files": file_hashes(spark, paths)}
    return manifest | {"signature": sign(manifest)["signature"]}


def bench_drift(spark: SparkSession, manifest: dict, paths: dict[str, str]) -> list[str]:
    """What no longer is as it was frozen."""
    out = [] if sign(manifest)["signature"] == manifest.get("signature") else ["signature"]
    now, then = file_hashes(spark, paths), manifest.get("files", {})
    return out + sorted(k for k in {*now, *then} if now.get(k) != then.get(k))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines as a plain folder at a path, in place of what was there: written beside it, then renamed.

    A folder can't be renamed over another, so for a moment, or after a crash there, only ``<path>.old`` is left;
    ``read_jsonl`` then reads that. Other readers should use ``publish_jsonl``, which leaves no such moment.
    """
    spark = df.sparkSession
    fs, _ = _fs(spark, path)
    beside, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    df.write.json(beside)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(jvm_path(path)):
        fs.delete(jvm_path(old), True)
        fs.rename(jvm_path(path), jvm_path(old))
    fs.rename(jvm_path(beside), jvm_path(path))
    fs.delete(jvm_path(old), True)


def publish_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines as the next version at a path (see ``versions``): at any moment ``read_jsonl`` finds the version before or this one, whole."""
    return versions.publish(df, path, "json")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced as a whole."""
    fs, where = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(beside), fs.makeQualified(where), over)


def last_labels(rows: DataFrame) -> DataFrame:
    """labeler, unit_id, label: the last row of each labeler (named by its file) and unit."""
    last = W.partitionBy("labeler", "unit_id").orderBy(F.col("_ord").desc())
    return rows.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


def resolve_text(sources: DataFrame, raw: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The sources with found_text and text_error: the inline text (an empty one too), else that at raw_path, else at snapshot_path.

    raw, snapshots: path, text. A path that is named and has no file is an error, whatever comes after it.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = sources.join(raw.select(F.col("path").alias("raw_path"), F.col("text").alias("__raw")), "raw_path", "left").join(snapshots.select(F.col("path").alias("snapshot_path"), F.col("text").alias("__snap")), "snapshot_path", "left")
    text = F.when(F.col("text").isNotNull(), F.col("text")).when(named("raw_path"), F.col("__raw")).when(named("snapshot_path"), F.col("__snap"))
    where = F.when(named("raw_path"), F.concat(F.lit("raw_path points at missing file: "), "raw_path")).when(named("snapshot_path"), F.concat(F.lit("snapshot_path points at missing file: "), "snapshot_path")).otherwise("no text and no path")
    return rows.withColumns({"found_text": text, "text_error": F.when(text.isNull(), where)}).select(*[F.col(c) for c in sources.columns], "found_text", "text_error")


def freeze(sources: DataFrame, text_col: str = "text") -> DataFrame:
    """Canonical text, its hash and version 1 of each source; the inline text goes."""
    text = X.canonical_text(F.coalesce(text_col, F.lit("")))
    return sources.withColumns({"snapshot_text": text, "content_hash": F.concat(F.lit("sha256:"), F.sha2(text, 256)), "snapshot_version": F.lit(1)}).drop(text_col)


def freeze_session(sources: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Freezes sources (id, text, content_hash, _ord) below a path: the sources with their hashes, and errors (id, error).

    A source whose stored snapshot still has its hash is left as it is; new and changed ones are added
    as a further part of the table, and the last part of an id counts. Missing and repeated ids are
    errors and aren't frozen, nor is a source without any text.
    """
    spark = sources.sparkSession
    blank = F.coalesce("id", F.lit("")) == ""
    rows = sources.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("_ord")))
    kind = F.when(blank, "missing id").when(F.col("rn") > 1, "duplicate id")
    good = rows.filter(~blank & (F.col("rn") == 1)).drop("rn")
    shape = "id string, snapshot_text string, snapshot_hash string, part bigint"
    before = spark.read.schema(shape).parquet(path) if exists(spark, path) else spark.createDataFrame([], shape)
    stored = before.groupBy("id").agg(F.max(F.struct("part", "snapshot_hash", "snapshot_text")).alias("s"))
    stored = stored.select("id", F.col("s.snapshot_hash").alias("stored_hash"), X.content_hash(F.col("s.snapshot_text")).alias("true_hash"))
    both = good.join(stored, "id", "left")
    intact = F.coalesce((F.col("content_hash") == F.col("true_hash")), F.lit(False))
    fresh = freeze(both.filter(~intact & F.col("text").isNotNull()).drop("content_hash", "stored_hash", "true_hash"))
    errors = rows.select("id", kind.alias("error")).unionByName(both.select("id", F.when(~intact & F.col("text").isNull(), "no text").alias("error"))).filter("error is not null")
    kept = both.filter(intact).drop("text", "stored_hash", "true_hash").withColumn("snapshot_version", F.lit(1))
    out = Scratch(spark).save(kept.unionByName(fresh.drop("snapshot_text").select(*kept.columns)))
    errors = Scratch(spark).save(errors)
    new = fresh.select("id", "snapshot_text", F.col("content_hash").alias("snapshot_hash"))
    if new.limit(1).count():
        part = (before.agg(F.max("part")).first()[0] or 0) + 1
        new.withColumn("part", F.lit(part).cast("long")).write.mode("append").parquet(path)
    return out, errors


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """id, snapshot_text as last frozen below a path."""
    return spark.read.parquet(path).groupBy("id").agg(F.max(F.struct("part", "snapshot_text")).alias("s")).select("id", "s.snapshot_text")


def snapshot_errors(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """id, error: snapshots that are missing or no longer have their hash."""
    both = sources.select("id", "content_hash").join(snapshots.select("id", "snapshot_text"), "id", "left")
    kind = F.when(F.col("snapshot_text").isNull(), "missing snapshot").when(X.content_hash(F.col("snapshot_text")) != F.col("content_hash"), "hash differs")
    return both.select("id", kind.alias("error")).filter("error is not null")


def load_snapshots(spark: SparkSession, session: str, sources: DataFrame) -> DataFrame:
    """The sources with snapshot_text and snapshot_error: the text at snapshot_path, which is below the session unless it is absolute.

    sources: id, snapshot_path, content_hash. A text is given only if it has the source's hash, where that has one.
    """
    rel = F.coalesce("snapshot_path", F.lit(""))
    absolute = rel.rlike("^(/|[a-z][a-z0-9+.-]*:/)")
    bare = lambda c: F.regexp_replace(c, "^[a-z][a-z0-9+.-]*:/+", "/")  # noqa: E731  file:/x and file:///x are one place
    at = F.when(absolute, bare(rel)).otherwise(F.concat(bare(F.lit(session.rstrip("/"))), F.lit("/"), F.regexp_replace(rel, r"^(\./)+", "")))
    rows = sources.withColumn("_at", F.when(rel != "", at))
    inside = read_folder(spark, session, "*").select(bare(F.col("path")).alias("_at"), F.col("text").alias("_text"))
    elsewhere = [r[0] for r in rows.filter(absolute & ~F.col("_at").startswith(bare(F.lit(session.rstrip("/") + "/")))).select("snapshot_path").distinct().collect()]  # paths outside of the session: few
    there = [p for p in elsewhere if exists(spark, p)]
    if there:
        inside = inside.unionByName(spark.read.text(there, wholetext=True).select(bare(F.col("_metadata.file_path")).alias("_at"), F.col("value").alias("_text")))
    both = rows.join(inside, "_at", "left")
    wrong = (F.coalesce("content_hash", F.lit("")) != "") & (X.content_hash(F.col("_text")) != F.col("content_hash"))
    error = F.when(F.col("_at").isNull(), "no snapshot_path").when(F.col("_text").isNull(), F.concat(F.lit("snapshot file missing: "), rel)).when(wrong, "snapshot hash mismatch")
    return both.select(*[F.col(c) for c in sources.columns], F.when(error.isNull(), F.col("_text")).alias("snapshot_text"), error.alias("snapshot_error"))


def write_lines(df: DataFrame, path: str) -> None:
    """The lines of a report (line, text) as one text file in a folder, in order."""
    df.coalesce(1).sortWithinPartitions("line").select("text").write.mode("overwrite").text(path)


def table_hash(df: DataFrame) -> str:
    """A digest of a table's rows that no order or partitioning changes; equal rows count.

    Row digests are counted and summed in eight 32-bit lanes, so no row reaches the driver.
    """
    cols = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(8)]
    got = df.agg(F.count(F.lit(1)).alias("n"), *lanes).first()
    return "sha256:" + hashlib.sha256("|".join(str(x) for x in got).encode()).hexdigest()


def sign(manifest: dict) -> dict:
    """The manifest with its signature and run id, over canonical JSON without these."""
    body = {k: v for k, v in manifest.items() if k not in ("signature", "run_id", "superseded_by")}
    digest = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return manifest | {"signature": "sha256:" + digest, "run_id": "run_" + digest[:12]}


def verified(manifest: dict) -> bool:
    return sign(manifest)["signature"] == manifest.get("signature") and sign(manifest)["run_id"] == manifest.get("run_id")


def publishable(manifest: dict | None) -> bool:
    return bool(manifest) and verified(manifest) and not manifest.get("superseded_by")


def manifest_of(spark: SparkSession, base: str, run_id: str) -> dict | None:
    where = f"{base}/runs/{run_id}/manifest.json"
    return json.loads(spark.read.text(where, wholetext=True).first()[0]) if exists(spark, where) else None


def commit_run(spark: SparkSession, base: str, tables: dict[str, DataFrame], manifest: dict) -> dict:
    """Writes tables beside, renames the folder to runs/<id>, then replaces the pointer file CURRENT by one rename.

    Readers see the run before or this one, never none. A run that is there already is not written
    again: its id is its content. The run that CURRENT pointed to is marked as superseded.
    """
    signed = sign(manifest | {"outputs": {k: table_hash(v) for k, v in sorted(tables.items())}})
    run_id = signed["run_id"]
    fs, target = _fs(spark, f"{base}/runs/{run_id}")
    if not exists(spark, f"{base}/runs/{run_id}/manifest.json"):
        staging = f"{base}/runs/.staging-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
        write_text(spark, f"{staging}/manifest.json", json.dumps(signed, sort_keys=True, indent=2))
        fs.rename(_fs(spark, staging)[1], target)
    before = json.loads(spark.read.text(f"{base}/CURRENT", wholetext=True).first()[0])["run_id"] if exists(spark, f"{base}/CURRENT") else run_id
    write_text(spark, f"{base}/CURRENT", json.dumps({"run_id": run_id, "signature": signed["signature"]}))
    old = manifest_of(spark, base, before) if before != run_id else None
    if old:
        write_text(spark, f"{base}/runs/{before}/manifest.json", json.dumps(old | {"superseded_by": run_id}, sort_keys=True, indent=2))
    return signed


def assert_publishable(spark: SparkSession, base: str, run_id: str) -> None:
    """Raises ValueError unless the run is there, is what was signed, and none came after it."""
    if not publishable(manifest_of(spark, base, run_id)):
        raise ValueError(f"run {run_id} is missing, not what was signed, or superseded")


def read_current(spark: SparkSession, base: str) -> tuple[dict, dict[str, DataFrame]]:
    """The committed manifest and tables, after checking signature, pointer and every table's hash."""
    pointer = json.loads(spark.read.text(f"{base}/CURRENT", wholetext=True).first()[0])
    manifest = json.loads(spark.read.text(f"{base}/runs/{pointer['run_id']}/manifest.json", wholetext=True).first()[0])
    if not verified(manifest) or manifest["signature"] != pointer["signature"] or manifest["run_id"] != pointer["run_id"]:
        raise ValueError("the committed run isn't what was signed")
    tables = {k: spark.read.parquet(f"{base}/runs/{pointer['run_id']}/{k}") for k in manifest["outputs"]}
    for k, df in tables.items():
        if table_hash(df) != manifest["outputs"][k]:
            raise ValueError(f"table {k} differs from its signed hash")
    return manifest, tables
