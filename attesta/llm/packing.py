"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into full pieces of ``limit`` and then into the powers of
two of what is left, largest first. A piece is a sequence of its own: it never crosses documents and,
its length being a power of two, needs no padding. Equal lengths share a ``bucket`` (the power), and
each bucket's sequences are numbered into batches of ``batch_ids`` ids, which training draws from one
bucket at a time; ``write_buckets`` stores a folder for each bucket. A batch is filled within one
input task, so no shuffle is needed; its last batch may be short.

Null or empty text: the end id alone. Repeated rows: packed once each. Long texts are whole; a task holds
one at a time beside 4 MiB of others. An empty table gives an empty result; other columns are not read.
A piece's ``sequence_id`` and its batch are its input task and its number there: unique and the same on a
retry. Marks of the vocabulary in a text (``<|endoftext|>``) are plain text, as its README says to read
them: a document can't forge an end.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, table

LIMIT = 2048
END_ID = 1
#: Up to here (Latin letters) both libraries class characters alike; other texts go to `tokenizers`.
LATIN = "ɏ"
#: Ids of a batch.
BATCH_IDS = 1 << 16
PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int, batch_id bigint"


def cut(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of n ids."""
    full, rest = divmod(n, limit)
    return [limit] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class Encoder:
    """The ids of byte_bpe_50k.json. Its vocabulary as ranks gives the same ids much faster."""

    def __init__(self, model: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(model or P.path("byte_bpe_50k.json"))
        self.slow.encode_special_tokens = True
        with open(ranks or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=merges, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if text and max(text) > LATIN:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, model: str | None = None, ranks: str | None = None, with_ids: bool = False, batch_ids: int = BATCH_IDS) -> DataFrame:
    """One row per piece; a batch is one batch_id of one bucket; with_ids adds the ids themselves. model, ranks: the vocabulary's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(model, ranks)
        base = TaskContext.get().partitionId() << 40
        made = 0
        filled = [0] * limit.bit_length()  # of each bucket: sequences so far
        for batch in batches:
            sizes = np.array([len(t) for t in batch.column(1).to_pylist()], np.int64)
            for lo, hi in chunks(sizes, 1 << 22):
                rows: list[tuple] = []
                kept: list[np.ndarray] = []
                for doc, text in zip(batch.column(0)[lo:hi].to_pylist(), batch.column(1)[lo:hi].to_pylist(), strict=True):
                    ids = np.array([*encode(text), end_id], "<u4")
                    at = 0
                    for n in cut(len(ids), limit):
                        piece, bucket = ids[at : at + n], n.bit_length() - 1
                        rows.append((doc, at, n, zlib.crc32(piece.tobytes()), len(ids), base + made, 0, bucket, base + filled[bucket] // max(1, batch_ids // n)))
                        filled[bucket] += 1
                        if with_ids:
                            kept.append(piece)
                        at, made = at + n, made + 1
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                cols[7] = cols[7].cast(pa.int32())
                names = [x.split()[0] for x in PACKED.split(", ")]
                if with_ids:
                    cols.append(pa.array([x.tolist() for x in kept], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    shape = PACKED + (", ids array<bigint>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, shape)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Stores the pieces (with their ids) by bucket, each file's rows by batch."""
    packed.sortWithinPartitions("bucket", "batch_id", "sequence_id").write.partitionBy("bucket").parquet(path)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids, equal lengths in one bucket."""
    return pack(table(spark, sf_dir, "documents"))
