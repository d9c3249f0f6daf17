"""Media columns: ISO base media files written and read as binary columns.

``mux`` stores bytes losslessly as uncompressed 8x8 RGB frames (192 bytes each) in an ISO media
file: ftyp, moov with full sample tables, mdat. ``probe`` walks the nested boxes of any ISO media
file, decodes the sample tables and returns codec, duration and the byte ranges of the keyframes;
it never looks at the payload. ``samples`` joins the bytes that the sample tables point at.

Nulls and empty texts: payload is padded to at least one frame, so every row has a valid file.
A file that cannot be parsed gives a row with ``error`` set and the other columns null; it never
fails the job. Rows go in Arrow batches (64 MiB of texts, or one longer text, by Spark's default), and
a task holds one batch with its files. Repeated rows get equal files, an empty table gives an empty
result. Other columns stay; where one has the name of a new column, that one is named with ``_`` before.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, table

FRAME = 192
TIMESCALE = 600
FRAME_TICKS = 20
GOP = 12
FRAMES_PER_CHUNK = 64
#: Payloads beyond this have 64-bit sizes and offsets.
LARGEST = (1 << 32) - (1 << 26)
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta")


# ---- writing -------------------------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of one frame."""
    frames = max(1, -(-len(payload) // FRAME))
    return payload.ljust(frames * FRAME, b" ")


def mux(payload: bytes) -> bytes:
    """An ISO media file holding the padded payload as raw frames."""
    data = pad(payload)
    frames = len(data) // FRAME
    ticks = frames * FRAME_TICKS
    unity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mvhd = full(b"mvhd", struct.pack(">4IIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), unity, bytes(24), struct.pack(">I", 2))
    tkhd = full(b"tkhd", struct.pack(">5I8x4H", 0, 0, 1, 0, ticks, 0, 0, 0, 0), unity, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
    mdhd = full(b"mdhd", struct.pack(">4I2H", 0, 0, TIMESCALE, ticks, 0x55C4, 0))
    hdlr = full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0")
    entry = box(b"raw ", struct.pack(">6xH16x2H2II H32sHh", 1, 8, 8, 0x480000, 0x480000, 0, 1, b"", 24, -1))
    chunks = -(-frames // FRAMES_PER_CHUNK)
    last = frames - (chunks - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if chunks > 1 else []
    if not runs or last != FRAMES_PER_CHUNK:
        runs.append((chunks, last, 1))
    keys = range(1, frames + 1, GOP)
    wide = len(data) > LARGEST
    tables = lambda start: box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">3I", 1, frames, FRAME_TICKS)),
        full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">3I", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", FRAME, frames)),
        full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *(start + i * FRAMES_PER_CHUNK * FRAME for i in range(chunks)))),
    )
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))

    def moov(start: int) -> bytes:
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, tables(start))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    start = len(ftyp) + len(moov(0)) + (16 if wide else 8)
    return ftyp + moov(start) + (struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data if wide else box(b"mdat", data))


# ---- reading -------------------------------------------------------------------------------


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Type, body start and end of each box in a range; 64-bit, open-ended and uuid boxes too."""
    at = start
    while at < end:
        if at + 8 > end:
            raise ValueError(f"{end - at} stray bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError(f"cut box {kind!r} at {at}")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has a wrong size")
        yield kind, body, at + size
        at += size


def find(data: memoryview, start: int, end: int, *path: bytes) -> list[tuple[int, int]]:
    """Ranges of all boxes on a path of nested types."""
    spots = [(start, end)]
    for kind in path:
        spots = [(b, e) for s, t in spots for k, b, e in walk(data, s, t) if k == kind]
    return spots


def longs(data: memoryview, at: int, end: int, count: int, width: int = 4) -> list[int]:
    if count * width > end - at:
        raise ValueError("a table is longer than its box")
    return list(struct.unpack_from(f">{count}{'I' if width == 4 else 'Q'}", data, at))


def track(data: memoryview, start: int, end: int) -> dict:
    one = lambda *path: next(iter(find(data, start, end, *path)), None)
    stbl = one(b"mdia", b"minf", b"stbl")
    mdhd, hdlr = one(b"mdia", b"mdhd"), one(b"mdia", b"hdlr")
    if not stbl or not mdhd or not hdlr:
        raise ValueError("a track lacks mdhd, hdlr or stbl")
    if data[mdhd[0]] == 1:
        scale, duration = struct.unpack_from(">IQ", data, mdhd[0] + 20)
    else:
        scale, duration = struct.unpack_from(">II", data, mdhd[0] + 12)
    boxes = {k: (b, e) for k, b, e in walk(data, *stbl)}
    kind = bytes(data[hdlr[0] + 8 : hdlr[0] + 12]).decode("latin-1")
    at, stop = boxes[b"stsd"]
    codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    width = height = None
    if kind == "vide" and at + 44 <= stop:
        width, height = struct.unpack_from(">HH", data, at + 8 + 32)
    if b"stsz" in boxes:
        at, stop = boxes[b"stsz"]
        each, count = struct.unpack_from(">II", data, at + 4)
        sizes = [each] * count if each else longs(data, at + 12, stop, count)
    else:
        at, stop = boxes[b"stz2"]
        bits, count = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if (count * bits + 7) // 8 > stop - at - 12:
            raise ValueError("a table is longer than its box")
        if bits == 16:
            sizes = list(struct.unpack_from(f">{count}H", data, at + 12))
        elif bits == 8:
            sizes = list(data[at + 12 : at + 12 + count])
        else:
            sizes = [(data[at + 12 + i // 2] >> (0 if i % 2 else 4)) & 15 for i in range(count)]
    if b"stco" in boxes:
        at, stop = boxes[b"stco"]
        spots = longs(data, at + 8, stop, struct.unpack_from(">I", data, at + 4)[0])
    else:
        at, stop = boxes[b"co64"]
        spots = longs(data, at + 8, stop, struct.unpack_from(">I", data, at + 4)[0], 8)
    at, stop = boxes[b"stsc"]
    flat = longs(data, at + 8, stop, 3 * struct.unpack_from(">I", data, at + 4)[0])
    runs = [*zip(flat[::3], flat[1::3], strict=True), (len(spots) + 1, 0)]
    offsets: list[int] = []
    for (first, per), (after, _) in zip(runs, runs[1:], strict=False):
        for chunk in range(first - 1, min(after - 1, len(spots))):
            where = spots[chunk]
            for size in sizes[len(offsets) : len(offsets) + per]:
                offsets.append(where)
                where += size
    if len(offsets) != len(sizes):
        raise ValueError(f"chunks hold {len(offsets)} of {len(sizes)} samples")
    if any(o + s > len(data) for o, s in zip(offsets, sizes, strict=True)):
        raise ValueError("a sample lies beyond the file")
    if b"stss" in boxes:
        at, stop = boxes[b"stss"]
        keys = [k - 1 for k in longs(data, at + 8, stop, struct.unpack_from(">I", data, at + 4)[0])]
    else:
        keys = list(range(len(sizes)))
    if any(not 0 <= k < len(sizes) for k in keys):
        raise ValueError("a keyframe is no sample")
    at, stop = boxes[b"stts"]
    steps = longs(data, at + 8, stop, 2 * struct.unpack_from(">I", data, at + 4)[0])
    return {
        "kind": kind, "codec": codec, "width": width, "height": height, "timescale": scale, "duration": duration,
        "decoded": sum(n * t for n, t in zip(steps[::2], steps[1::2], strict=True)), "offsets": offsets, "sizes": sizes, "keys": keys,
    }


def parse(media: bytes) -> list[dict]:
    """The tracks of a file. Only boxes are read, no sample."""
    data = memoryview(media)
    tracks = [track(data, b, e) for b, e in find(data, 0, len(data), b"moov", b"trak")]
    if not tracks:
        raise ValueError("no track")
    return tracks


def joined(media: bytes, t: dict) -> bytes:
    """The samples of a track in decoding order; neighbours are read as one range."""
    out, at, end = [], None, None
    for o, s in zip(t["offsets"], t["sizes"], strict=True):
        if o == end:
            end += s
            continue
        if at is not None:
            out.append(media[at:end])
        at, end = o, o + s
    if at is not None:
        out.append(media[at:end])
    return b"".join(out)


PROBE = "struct<kind:string,codec:string,width:int,height:int,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<at:bigint,bytes:bigint>>,payload:binary,error:string>"


def probe_one(media: bytes | None, payload: bool) -> dict:
    none = dict.fromkeys(("kind", "codec", "width", "height", "timescale", "duration", "samples", "keyframes", "payload", "error"))
    if media is None:
        return none | {"error": "null"}
    try:
        tracks = parse(media)
        t = next((t for t in tracks if t["kind"] == "vide"), tracks[0])
        return none | {
            "kind": t["kind"], "codec": t["codec"], "width": t["width"], "height": t["height"], "timescale": t["timescale"], "duration": t["duration"], "samples": len(t["sizes"]),
            "keyframes": [{"at": t["offsets"][k], "bytes": t["sizes"][k]} for k in t["keys"]], "payload": joined(media, t) if payload else None,
        }
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return none | {"error": f"{type(e).__name__}: {e}"[:200]}


def with_media(df: DataFrame, text_col: str, media_col: str = "media") -> DataFrame:
    """Adds the text's ISO media file as a binary column (null text: empty)."""

    @F.arrow_udf("binary")
    def write(texts: pa.Array) -> pa.Array:
        return pa.array([mux((t or "").encode()) for t in texts.to_pylist()], pa.binary())

    return df.select("*", write(F.col(text_col)).alias(named(df, media_col)[0]))


def with_probe(df: DataFrame, media_col: str = "media", probe_col: str = "probe", payload: bool = False) -> DataFrame:
    """Adds codec, duration and keyframe byte ranges; with payload=True the sample bytes too."""
    fields = [("kind", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("at", pa.int64()), ("bytes", pa.int64())]))), ("payload", pa.binary()), ("error", pa.string())]

    @F.arrow_udf(PROBE)
    def read(media: pa.Array) -> pa.Array:
        return pa.array([probe_one(m.as_py(), payload) for m in media], pa.struct(fields))

    return df.select("*", read(F.col(media_col)).alias(named(df, probe_col)[0]))


def op1_media(spark, sf_dir: str) -> DataFrame:
    """Every document as an ISO media file, read back through its sample tables; codec, duration and keyframe byte ranges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = with_probe(with_media(docs, "text"), payload=True)
    p = F.col("probe")
    ranges = F.transform(p["keyframes"], lambda k: F.concat_ws("+", k["at"].cast("string"), k["bytes"].cast("string")))
    feature = F.concat_ws(
        ";", F.concat(F.lit("codec="), F.trim(p["codec"])), F.concat(F.lit("size="), p["width"], F.lit("x"), p["height"]),
        F.concat(F.lit("seconds="), F.format_string("%.6f", p["duration"] / p["timescale"])), F.concat(F.lit("samples="), p["samples"].cast("string")),
        F.concat(F.lit("keyframes="), F.size(p["keyframes"]).cast("string")), F.concat(F.lit("ranges_md5="), F.md5(F.concat_ws(",", ranges))), F.concat(F.lit("error="), p["error"]),
    )
    return out.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.octet_length(p["payload"]).cast("long").alias("payload_bytes"), F.sha2(p["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(p["payload"], -16, 16)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
        F.trim(p["codec"]).alias("codec"), (p["duration"] / p["timescale"]).alias("seconds"), p["keyframes"].alias("keyframes"),
    )
