"""The manifest of a session: a tree of digests over its sections, their tables and the tables' files.

Leaves are files with length, time of change and SHA-256, kept as a table beside the manifest; an entry's
digest is over its leaves, the root's over all entries, in no order. A check lists the files again, hashes those
whose length or time differ (or all), and names the entries and files that drifted. Files are hashed by the executors; a
file is one row there, so it has at most ``LARGEST`` bytes.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import pinned
from .tables import exists, sign, table_hash

VERSION = "1"
LARGEST = 1 << 30
LEAF = "section string, entry string, file string, bytes bigint, changed timestamp, digest string"

#: Sections of a session and where their entries are below it.
ENTRIES = {
    "inputs": {"claim_ledger": "artifacts/claim_ledger.jsonl", "claim_evidence_refs": "artifacts/claim_evidence_refs.jsonl", "sources": "sources/sources.jsonl", "independence_partition": "artifacts/independence_partition.json", "risk_classifications": "artifacts/risk_classifications.jsonl", "entailment_verdicts": "artifacts/entailment_verdicts.jsonl", "panel_consensus": "artifacts/panel_consensus.jsonl"},
    "outputs": {"verified_claims": "outputs/verified_claims.json", "unresolved_claims": "outputs/unresolved_claims.json", "refuted_claims": "outputs/refuted_claims.json"},
}


def listed(spark: SparkSession, base: str, entries: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """section, entry, file (below the entry), bytes, changed: all files of the entries that are there. An entry is a file or a folder."""
    out = None
    for section, names in (entries or ENTRIES).items():
        for entry, path in names.items():
            if not exists(spark, f"{base}/{path}"):
                continue
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{base}/{path}")
            below = F.regexp_replace(F.substring_index("path", f"/{path}", -1), "^/", "")
            part = files.select(F.lit(section).alias("section"), F.lit(entry).alias("entry"), below.alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"), F.col("path").alias("at"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "section string, entry string, file string, bytes bigint, changed timestamp, at string")


def hashed(files: DataFrame) -> DataFrame:
    """The listed files as leaves. Contents are read by path, a file at a time in each task."""
    spark = files.sparkSession
    paths = [r["at"] for r in files.select("at").collect()]  # names of a session's files, not its rows
    if not paths:
        return spark.createDataFrame([], LEAF)
    content = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("at"), F.when(F.col("length") <= LARGEST, F.sha2("content", 256)).otherwise(F.raise_error(F.concat(F.lit("too large to hash as one row: "), "path"))).alias("digest"))
    return files.join(content, "at").select("section", "entry", "file", "bytes", "changed", "digest")


def digests(leaves: DataFrame) -> dict[str, dict[str, str]]:
    """section to entry to digest, from the digests of its files."""
    row = F.sha2(F.concat_ws("\0", "file", "digest"), 256)
    lanes = [F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(8)]
    out: dict[str, dict[str, str]] = {}
    for r in leaves.groupBy("section", "entry").agg(F.count(F.lit(1)).alias("n"), *lanes).collect():  # one row per entry
        out.setdefault(r["section"], {})[r["entry"]] = "sha256:" + hashlib.sha256("|".join(str(x) for x in r[2:]).encode()).hexdigest()
    return out


def facts(sources: DataFrame, verdicts: DataFrame, risk: DataFrame) -> dict:
    """What a session's tables say of how it came about: snapshots (a digest of source, path and hash), sorted prompt hashes and models, the first rule set."""
    names = lambda c: [r[0] for r in verdicts.filter(F.coalesce(c, F.lit("")) != "").select(c).distinct().orderBy(c).collect()]  # noqa: E731  few: one per prompt or model
    rules = risk.filter("coalesce(gazetteer_hash, '') <> ''").agg(F.min_by("gazetteer_hash", "_ord")).first()[0]
    return {"snapshots": table_hash(sources.select("id", "snapshot_path", "content_hash")), "verifier_prompt_hashes": names("verifier_prompt_hash"), "model_ids": names("model_id"), "gazetteer": rules}


def build(spark: SparkSession, base: str, producers: list[str], code: dict[str, str], about: dict, config: dict | None = None, entries: dict[str, dict[str, str]] | None = None, leaves: DataFrame | None = None) -> tuple[dict, DataFrame]:
    """The signed manifest and its leaves. about: see ``facts``."""
    leaves = pinned(hashed(listed(spark, base, entries))) if leaves is None else leaves
    found = digests(leaves)
    sections = {s: {e: found.get(s, {}).get(e) for e in names} for s, names in (entries or ENTRIES).items()}
    body = {"manifest_version": VERSION, "enabled_producers": sorted(producers), "superseded_by": None, "sections": sections, "about": about | {"resolved_config": config}, "code_versions": code}
    root = hashlib.sha256(json.dumps(sections, sort_keys=True).encode()).hexdigest()
    return sign(body | {"root": "sha256:" + root}), leaves


def refreshed(files: DataFrame, leaves: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Leaves of the files as they are now, and the files that had to be hashed: those that aren't as the stored leaves say (or all)."""
    key = ["section", "entry", "file"]
    same = files.join(leaves.select(*key, "bytes", "changed", "digest"), [*key, "bytes", "changed"])
    other = pinned(files if whole else files.join(same.select(*key), key, "left_anti"))
    fresh = hashed(other)
    return pinned(fresh if whole else fresh.unionByName(same.select(fresh.columns))), other


def check(spark: SparkSession, base: str, manifest: dict | None, leaves: DataFrame, producers: list[str], code: dict[str, str], about: dict, config: dict | None = None, entries: dict[str, dict[str, str]] | None = None, whole: bool = False) -> tuple[list[str], DataFrame]:
    """What drifted, by section and entry, and the files that did: section, entry, file, drift (changed, missing, added). Nothing: as signed."""
    if manifest is None:
        return ["manifest absent"], spark.createDataFrame([], "section string, entry string, file string, drift string")
    now_leaves, _ = refreshed(listed(spark, base, entries), leaves, whole)
    now, _ = build(spark, base, producers, code, about, config, entries, now_leaves)
    out = [] if sign(manifest)["signature"] == manifest.get("signature") else ["signature"]
    for part in ("sections", "about", "code_versions"):
        flat = lambda m, part=part: {f"{k}.{e}": x for k, v in m.get(part, {}).items() for e, x in v.items()} if part == "sections" else {f"{part}.{k}": v for k, v in m.get(part, {}).items()}
        a, b = flat(manifest), flat(now)
        out += [k for k in sorted({*a, *b}) if a.get(k) != b.get(k)]
    out += ["enabled_producers"] if manifest.get("enabled_producers") != now["enabled_producers"] else []
    key = ["section", "entry", "file"]
    then, here = leaves.select(*key, F.col("digest").alias("then")), now_leaves.select(*key, F.col("digest").alias("here"))
    kind = F.when(F.col("here").isNull(), "missing").when(F.col("then").isNull(), "added").when(F.col("here") != F.col("then"), "changed")
    return out, then.join(here, key, "full").select(*key, kind.alias("drift")).filter("drift is not null")
