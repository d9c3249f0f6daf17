"""Content-addressed WARC archive.

``write`` stores two tables: ``payloads`` (SHA-256, bytes), each distinct payload once, and
``records``, the exact header bytes of every record with the digest of its payload. A record's bytes
are its headers, its payload (responses only) and the two closing line ends. ``read`` joins both
tables, rebuilds the record bytes, parses them and recomputes the digests, so a damaged store shows;
a revisit's WARC-Refers-To is the record id of its response, and the response's page is found by it.

Rows of equal payloads meet by partial aggregates of their ids and addresses; the joins that give them
back to their rows have one small row per payload on the other side and nothing else in their stage,
so a payload that a third of all pages share can be split. Null html: empty. Null url: empty. Null
page ids sort last. Of pages with equal payloads the one of the smallest id is the response, then of
the smallest url, then the first written; equal rows are a record each. An empty table gives empty
tables, other columns are not read, and payloads of any length are whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, back_to_id, id_of, table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1: 160 bits are eight groups of 20 bits, four letters each."""
    digest = F.sha1(data)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """The archive's tables: payloads(digest, payload) and records(key, digest, response, headers)."""
    raw = pages.select(id_of(id_col).alias("key"), F.coalesce(url_col, F.lit("")).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "utf-8").alias("payload"))
    marked = raw.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    heads = marked.select("key", "url", "digest", base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    heads = scratch.save(heads)
    first = scratch.save(heads.groupBy("digest").agg(F.min(F.struct("key", "url", "row")).alias("first")))
    linked = heads.join(first, "digest").withColumn("response", (F.col("row") == F.col("first.row")) | (F.col("size") < least_bytes))

    def record_id(*of: str) -> Column:
        x = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in of]))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))

    http = F.concat(F.lit(HTTP), F.lit("Content-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(F.col("response"), F.col("size")).otherwise(0)
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    uri = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", record_id("first.key", "first.url", "first.row")),
        line("WARC-Refers-To-Target-URI", uri("first.url")), line("WARC-Refers-To-Date", F.lit(DATE)),
    )
    headers = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")), line("WARC-Record-ID", record_id("key", "url", "row")),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri("url")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("response"), F.lit("")).otherwise(revisit),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n"), http,
    )
    records = scratch.save(linked.select("key", "digest", "response", F.encode(headers, "utf-8").alias("headers")))
    payloads = scratch.save(marked.select("digest", "payload").dropDuplicates(["digest"]))
    scratch.drop(heads, first)
    return payloads, records


def parse_record(record: bytes) -> dict:
    """Fields of one WARC record with an HTTP block; raises ValueError where it is malformed."""
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("no WARC header")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("block and Content-Length differ")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no HTTP header")
    length = dict(x.split(": ", 1) for x in http.decode("latin-1").split("\r\n")[1:])["Content-Length"]
    return fields | {"payload": payload, "length": int(length)}


READ = "key bigint, digest binary, record_bytes bigint, length bigint, claimed string, record_type string, record_id string, refers_id string, payload_bytes bigint, payload_digest string, error string"


def read(payloads: DataFrame, records: DataFrame, scratch: Scratch) -> DataFrame:
    """Rebuilds every record, parses and checks it; one row per record, ``refers`` being the response's key.

    A payload is joined with its response only; revisits are held against what was recomputed of it
    there, so a payload of many revisits is not copied.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, digest, response, headers, payload in zip(*batch.columns, strict=True):
                key, digest, response, headers, payload = (x.as_py() for x in (key, digest, response, headers, payload))
                record = headers + (payload or b"") + b"\r\n\r\n"
                row = [key, digest, len(record)]
                try:
                    f = parse_record(record)
                    row += [f["length"], f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], f["WARC-Record-ID"], f["WARC-Refers-To"] if f["WARC-Type"] == "revisit" else None]
                    if response:
                        data = f["payload"]
                        whole = hashlib.sha256(data).digest() == digest
                        row += [len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), None if whole else "the payload isn't what its digest says"]
                    else:
                        row += [None, None, None]
                except (ValueError, KeyError) as e:
                    row = [*row[:3], *[None] * 7, f"{type(e).__name__}: {e}"[:200]]
                rows.append(row)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in READ.split(", ")])

    cols = ("key", "digest", "response", "headers")
    told = scratch.save(records.filter("response").join(payloads, "digest", "left").select(*cols, "payload").mapInArrow(run, READ))
    # Revisits and the responses of their payloads: small rows, one response for each payload that has revisits.
    again = scratch.save(records.filter("not response").select(*cols, F.lit(None).cast("binary").alias("payload")).mapInArrow(run, READ).drop("payload_bytes", "payload_digest"))
    proven = told.filter("error is null").select("digest", F.col("record_id").alias("refers_id"), F.col("key").alias("refers"), "payload_bytes", "payload_digest")
    both = told.withColumn("refers", F.lit(None).cast("long")).unionByName(again.join(proven, ["digest", "refers_id"], "left").select(*told.columns, "refers"))
    differs = (F.col("claimed") != F.col("payload_digest")) | (F.col("length") != F.col("payload_bytes")) | F.col("payload_bytes").isNull()
    return both.withColumn("error", F.coalesce("error", F.when(differs, "header and payload differ")))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to the archive and read back."""
    scratch = Scratch(spark)
    back = read(*write(table(spark, sf_dir, "pages"), scratch), scratch)
    return back.select(back_to_id("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back_to_id("refers").alias("refers_to"), "error")


_LETTERS = " || ".join(f"substr('{ALPHABET}', ((g[{i}] >> {s}) & 31) + 1, 1)" for i in range(1, 9) for s in (15, 10, 5, 0))
OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT *, sha1(b) AS h, sha256(b) AS k, octet_length(b) AS n FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (5 * i + 1)::INT, 5))::INT) AS g,
  min(page_id) OVER (PARTITION BY k) AS least, row_number() OVER (PARTITION BY k ORDER BY page_id, url) AS i FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN i = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN i > 1 THEN least END AS refers_to, NULL::VARCHAR AS error FROM g"""
