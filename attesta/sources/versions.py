"""Tables that are replaced without a rename: numbered pointers, each created once.

A version is a folder of its own. When it is complete, a pointer to it is created under the next number,
which fails if another writer was first; that writer then takes the number after. Readers take the greatest
pointer that is complete. So at any moment a reader finds the version before or the new one, whole, on any
store that can create a file only where there is none.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

HEADS = "_heads"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _heads(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and place of the pointers, the greatest first."""
    fs, where = _fs(spark, f"{path}/{HEADS}")
    if not fs.exists(where):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(where)]
    return sorted(((int(n), at) for n, at in names if n.isdigit()), reverse=True)


def _pointer(spark: SparkSession, at: str) -> dict | None:
    """A pointer's content; None while its writer is not done with it."""
    rows = spark.read.text(at, wholetext=True).collect()
    try:
        found = json.loads(rows[0][0]) if rows else {}
    except ValueError:
        return None
    return found if found.get("complete") else None


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest complete version, if there is one."""
    for _, at in _heads(spark, path):
        found = _pointer(spark, at)
        if found:
            return f"{path}/{found['folder']}"
    return None


def _create(spark: SparkSession, at: str, text: str) -> bool:
    """Whether this call made the file."""
    fs, where = _fs(spark, at)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def publish(df: DataFrame, path: str, form: str = "parquet", **about: str) -> int:
    """Writes a version, then points to it; its number. about: more entries of the pointer."""
    spark = df.sparkSession
    folder = f"v-{uuid.uuid4().hex}"
    df.write.format(form).save(f"{path}/{folder}")
    text = json.dumps(about | {"folder": folder, "form": form, "complete": True}, sort_keys=True)
    while True:
        number = max([n for n, _ in _heads(spark, path)], default=0) + 1
        if _create(spark, f"{path}/{HEADS}/{number:012d}", text):
            return number


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes versions that no reader will take any more: those before the newest ``keep`` complete ones; their folders."""
    fs, _ = _fs(spark, path)
    known = [(at, p["folder"]) for _, at in _heads(spark, path) if (p := _pointer(spark, at))]
    for at, folder in known[keep:]:
        fs.delete(_fs(spark, at)[1], False)
        fs.delete(_fs(spark, f"{path}/{folder}")[1], True)
    return [folder for _, folder in known[keep:]]
