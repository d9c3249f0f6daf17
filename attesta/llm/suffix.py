"""Removal of repeated passages by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document of smaller id.

1. Anchors: of the ``K``-byte strings in each window of LENGTH bytes, those with the least hash. Equal
   windows have equal anchors, so strings that repeat meet at an anchor. An anchor's context is the
   union of the windows that chose it. Of equal contexts in one input piece (their bytes are compared
   there) only the smallest document's is sent on, in packed arrays dealt out by anchor.
2. Where all contexts of an anchor meet, those of one document alone are done with, and those that share
   no side of the anchor with another document: a window of LENGTH bytes has half of what surrounds
   its anchor on one side, so equal windows are equal there. Equal contexts claim
   to be covered by the next smaller document that has them; contexts that differ at one anchor are
   asked for. Both are fetched from the texts as bytes, a document's neighbouring claims as one range.
3. Contexts that differ are laid out as one text per block, its suffixes are sorted, and intervals of
   the BWT are extended backward, breadth first: each interval found first sets one entry of the
   longest common prefixes, by increasing value, and the expansion stops at LENGTH. Entries still unset
   part no strings of LENGTH bytes, so the runs between set entries are the classes of equal windows.
4. Covered ranges are joined back to the texts. A claim is compared there byte by byte with what its
   source sent; should a hash ever have lied, the job fails and asks for another ``seed``.

So hashes propose and bytes decide: a removed byte was in a range equal, byte by byte, to one of a
smaller document (copied passages in their inner parts), or in a class of the interval expansion
(their edges, and everything that differs nearby).

An anchor with over ``HOT`` contexts (a run of one pattern has one at each byte) is reduced before the
expansion: each different context is decided once, for the smallest document that has it, and the
result joined back to all its places. Where over ``HOT`` different ones are left, their windows are dealt
out anew by their next anchor (the next larger hash in the window), and so on. Equal windows stay together.

Nulls: a null text is empty, a null id sorts after all others. Rows with equal ids don't cover each
other. Texts shorter than LENGTH keep everything. Nothing is cut: long texts are whole. An empty table
gives an empty result, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, back_to_id, chunks, id_of, in_turn, mix64, partitions, spread, table, text_of, utf8

LENGTH = 50
K = 16
BEFORE = LENGTH - K
WIDTH = BEFORE + LENGTH
HOT = 20000
PIECE = 1 << 20
FLUSH = 8 << 20
BLOCK = 1 << 20
#: Bytes of text whose anchors a task sorts at a time.
SHARE = 8 << 20


# ---- anchors -------------------------------------------------------------------------------


def _word(data: np.ndarray, at: int, n: int) -> np.ndarray:
    """The 8 bytes from each of n positions on, as integers (data is padded)."""
    return np.lib.stride_tricks.as_strided(data[at:].view(np.uint8), (n, 8), (1, 1)).copy().view(np.uint64).ravel()


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every window of so many values."""
    have, out = 1, x
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1]) if have < width else out


_ODD = mix64(np.arange(16, dtype=np.uint64) + np.uint64(11 << 40)) | np.uint64(1)
_WORDS = -(-WIDTH // 8)


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """For a context's bytes as words: which bits stand at or after, and before, each byte."""
    byte = np.arange(_WORDS * 8)
    part = lambda keep: np.where(keep, 255, 0).astype(np.uint8).reshape(-1, _WORDS, 8).view(np.uint64)[..., 0]
    edge = np.arange(WIDTH + 1)[:, None]
    return part(byte >= edge), part(byte < edge)


_FROM, _UNTIL = _masks()


def strings(first: np.ndarray, second: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of K-byte strings, from their two words."""
    return mix64(first * np.uint64(0xD6E8FEB86659FD93) ^ mix64(second + np.uint64(seed)))


def anchors(data: np.ndarray, starts: np.ndarray, seed: int = 0) -> tuple[np.ndarray, ...]:
    """All anchors of a batch of texts: hash, hash of the context, place, the context's range, and hashes
    of the SIDE bytes before and after the anchor (0: the context doesn't hold so many)."""
    n = len(data) - K + 1
    width = LENGTH - K + 1
    if n < width:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none.astype(np.uint16), none.astype(np.uint16)
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(WIDTH + 16, np.uint8)])
    word = _word(padded, 0, len(padded) - 8)  # from BEFORE bytes ahead of each place on
    h = strings(word[BEFORE : BEFORE + n], word[BEFORE + 8 : BEFORE + 8 + n], seed)
    low = _slide(h, width, np.minimum)
    # Windows that reach into the next text don't count.
    size = np.diff(starts)
    good = np.zeros(len(low) + 1, np.int32)
    many = size >= LENGTH
    np.add.at(good, starts[:-1][many], 1)
    np.add.at(good, starts[1:][many] - LENGTH + 1, -1)
    low = np.where(np.cumsum(good)[:-1] > 0, low, np.uint64(0))
    # A place is an anchor if its hash is the least of some window that holds it.
    edge = np.zeros(width - 1, np.uint64)
    best = _slide(np.concatenate([edge, low, edge]), width, np.maximum)
    at = np.flatnonzero((best == h) & (h > 0))
    mine = h[at]
    # Windows that chose it: the run of that least value around it.
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.append(first[1:], len(low)) - 1
    r = np.searchsorted(last, np.maximum(at - width + 1, 0))
    while True:
        off = low[first[r]] != mine
        if not off.any():
            break
        r[off] += 1
    begin = np.maximum(np.maximum(at - width + 1, 0), first[r])
    stop = np.minimum(np.minimum(at, len(low) - 1), last[r]) + LENGTH
    lo, hi = begin - at + BEFORE, stop - at + BEFORE
    c = mix64((lo * 256 + hi + (seed << 16)).astype(np.uint64))
    for k in range(_WORDS):
        c = mix64(c ^ (word[at + 8 * k] & _FROM[lo, k] & _UNTIL[hi, k]) * _ODD[k])

    def side(first: int, there: np.ndarray) -> np.ndarray:
        x = mix64(word[at + first] * _ODD[0] ^ word[at + first + 8] * _ODD[1] ^ word[at + first + SIDE - 8] * _ODD[2])
        return np.where(there, x % np.uint64(65535) + np.uint64(1), np.uint64(0)).astype(np.uint16)

    return mine, c, at, begin, stop, side(BEFORE - SIDE, lo <= BEFORE - SIDE), side(BEFORE + K, hi >= BEFORE + K + SIDE)


ENTRY = np.dtype([("h", "<u4"), ("c", "<u8"), ("row", "<u4"), ("at", "<u4"), ("lo", "u1"), ("hi", "u1"), ("left", "<u2"), ("right", "<u2")])
#: A window has so many bytes on one side of its anchor at least.
SIDE = -(-BEFORE // 2)
RANGE = "doc bigint, mark bigint, begin int, stop int"


def _merged(row: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the ranges of each row."""
    order = np.lexsort((begin, row))
    row, begin, stop = row[order].astype(np.int64), begin[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(row):
        return row, begin, stop
    shift = row * (int(stop.max()) + 2)
    reach = np.maximum.accumulate(stop + shift)
    head = np.concatenate([[True], begin[1:] + shift[1:] > reach[:-1]])
    at = np.flatnonzero(head)
    return row[at], begin[at], np.maximum.reduceat(stop, at)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Are the contexts around places a and b of one text equal?"""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(8 * _WORDS, np.uint8)])
    word = np.ndarray((len(padded) - 7,), np.uint64, padded, strides=(1,))
    out = np.ones(len(a), bool)
    for k in range(_WORDS):
        out &= ((word[a + 8 * k] ^ word[b + 8 * k]) & _FROM[lo, k] & _UNTIL[hi, k]) == 0
    return out


def _find(docs: DataFrame, shares: int, seed: int = 0) -> DataFrame:
    """share, blob: packed anchors of each input piece, dealt out by hash; share below 0: ranges covered already."""

    def flush(ids: list[np.ndarray], begins: list[np.ndarray], texts: list[np.ndarray], found: list[tuple]) -> pa.RecordBatch:
        h, c, row, at, lo, hi, left, right = (np.concatenate([f[i] for f in found]) for i in range(8))
        ids, starts, data = np.concatenate(ids, 1), np.concatenate(begins), np.concatenate(texts)
        texts.clear()
        found.clear()
        doc = ids[0][row]
        order = np.lexsort((doc, c))
        head = np.concatenate([[True], c[order][1:] != c[order][:-1]])[: len(c)]
        first = order[head][np.cumsum(head) - 1]  # of each context's class: one of the smallest document
        over = doc[order] > doc[first]
        one, rep = order[over], first[over]
        over[np.flatnonzero(over)[~((lo[one] == lo[rep]) & (hi[one] == hi[rep]) & _same_bytes(data, at[one], at[rep], lo[one], hi[one]))]] = False
        gone, stay = order[over], order[~over]
        del data, order, head, first, one, rep
        place = at - starts[row]
        out_shares, blobs = [], []
        if len(gone):
            r, b, e = _merged(row[gone], place[gone] - BEFORE + lo[gone], place[gone] - BEFORE + hi[gone])
            out_shares.append(-1 - int(c[0] % np.uint64(shares)))
            blobs.append(np.stack([ids[0][r], ids[1][r], b, e]).astype("<i8").tobytes())
        entry = np.zeros(len(stay), ENTRY)
        entry["h"], entry["c"], entry["row"], entry["at"], entry["lo"], entry["hi"] = h[stay] >> np.uint64(32), c[stay], row[stay], place[stay], lo[stay], hi[stay]
        entry["left"], entry["right"] = left[stay], right[stay]
        to = ((h[stay] & np.uint64(0xFFFFFFFF)) % np.uint64(shares)).astype(np.int64)
        del h, left, right, lo, hi, at, place
        order = np.lexsort((row[stay], to))
        entry, to = entry[order], to[order]
        edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(to)], strict=True):
            out_shares.append(int(to[a]))
            blobs.append(_pack(ids, entry[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(out_shares, pa.int32()), pa.array(blobs, pa.binary())], ["share", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, begins, texts, found, rows, held = [], [], [], [], 0, 0
        for batch in batches:
            data, starts = utf8(batch.column(2))
            for a, b in chunks(np.diff(starts), PIECE):
                bounds = starts[a : b + 1] - starts[a]
                piece = data[starts[a] : starts[b]]
                h, c, at, begin, stop, left, right = anchors(piece, bounds, seed)
                row = np.searchsorted(bounds, at, "right") - 1
                found.append((h, c, (row + rows).astype(np.uint32), at + held, (begin - at + BEFORE).astype(np.uint8), (stop - at + BEFORE).astype(np.uint8), left, right))
                ids.append(np.stack([batch.column(0)[a:b].to_numpy(), batch.column(1)[a:b].to_numpy()]))
                begins.append(bounds[:-1] + held)
                texts.append(piece)
                rows, held = rows + b - a, held + int(bounds[-1])
                if held >= FLUSH:
                    yield flush(ids, begins, texts, found)
                    ids, begins, texts, found, rows, held = [], [], [], [], 0, 0
        if found:
            yield flush(ids, begins, texts, found)

    return docs.select("doc", "mark", "text").mapInArrow(run, "share int, blob binary")


def _pack(ids: np.ndarray, entry: np.ndarray) -> bytes:
    """Ids of the documents in use, then the entries with rows numbered by these."""
    used = np.zeros(ids.shape[1], bool)
    used[entry["row"]] = True
    entry = entry.copy()
    entry["row"] = (np.cumsum(used) - 1)[entry["row"]]
    return np.array([used.sum()], "<i8").tobytes() + np.ascontiguousarray(ids[:, used]).astype("<i8").tobytes() + entry.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    ids, entry = np.frombuffer(blob, "<i8", 2 * n, 8).reshape(2, n), np.frombuffer(blob, ENTRY, -1, 8 + 16 * n)
    return ids[0][entry["row"]], ids[1][entry["row"]], entry


SPOT = "doc bigint, mark bigint, begin int, stop int, h bigint, to_doc bigint, to_mark bigint, to_begin int"
_SPOT_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


def _spots(*cols: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    n = len(cols[0])
    for lo in range(0, n, 100_000):
        part = [pa.nulls(min(100_000, n - lo), k) if c is None else pa.array(c[lo : lo + 100_000].astype(k.to_pandas_dtype())) for c, k in zip(cols, _SPOT_KINDS, strict=True)]
        yield pa.RecordBatch.from_arrays(part, [x.split()[0] for x in SPOT.split(", ")])


def _met(h: np.ndarray, side: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Has another document the same side at the same anchor?"""
    if not len(h):
        return np.zeros(0, bool)
    order = np.lexsort((doc, side, h))
    h, side, doc = h[order], side[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (side[1:] != side[:-1])]))
    last = np.append(head[1:], len(h)) - 1
    out = np.empty(len(h), bool)
    out[order] = np.repeat((doc[head] != doc[last]) & (side[head] > 0), last - head + 1)
    return out


class Anchors:
    """The anchors of one share; ``give`` says what its contexts come to."""

    def __init__(self, share: int) -> None:
        self.share, self.held, self.size, self.limit = share << 32, [], 0, 4 * SHARE // 16
        self.hot = np.zeros(0, np.uint32)

    def add(self, doc: np.ndarray, mark: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((doc, mark, entry))
        self.size += len(doc)
        if self.size > self.limit:  # contexts of hot anchors need not wait: their bytes are asked for anyway
            h, n = np.unique(np.concatenate([e["h"] for _, _, e in self.held]), return_counts=True)
            self.hot = np.union1d(self.hot, h[n > HOT]).astype(np.uint32)
            doc, mark, entry = (np.concatenate([x[i] for x in self.held]) for i in range(3))
            out = np.isin(entry["h"], self.hot)
            yield from self._asked(doc[out], mark[out], entry[out])
            self.held, self.size = [(doc[~out], mark[~out], entry[~out])], int((~out).sum())
            self.limit = max(self.limit, 2 * self.size)

    def _asked(self, doc: np.ndarray, mark: np.ndarray, entry: np.ndarray) -> Iterator[pa.RecordBatch]:
        base = entry["at"].astype(np.int64) - BEFORE
        return _spots(doc, mark, base + entry["lo"], base + entry["hi"], self.share | entry["h"].astype(np.int64), None, None, None)

    def give(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        doc, mark, entry = (np.concatenate([x[i] for x in self.held]) for i in range(3))
        self.held.clear()
        order = np.lexsort((doc, entry["c"], entry["h"]))
        doc, mark, entry = doc[order], mark[order], entry[order]
        h, c = entry["h"], entry["c"]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        new_d = new_c | np.concatenate([[True], doc[1:] != doc[:-1]])
        at_h, at_c, at_d = np.flatnonzero(new_h), np.flatnonzero(new_c), np.flatnonzero(new_d)
        of_h, of_c, of_d = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1, np.cumsum(new_d) - 1
        several = np.minimum.reduceat(doc, at_h) != np.maximum.reduceat(doc, at_h)
        kinds = np.add.reduceat(new_c.astype(np.int64), at_h)
        hot = np.isin(h, self.hot)
        over = (doc > doc[at_c][of_c]) & ~hot
        base = entry["at"].astype(np.int64) - BEFORE
        # The source of a claim: the last context of the next smaller document in its class.
        who = np.flatnonzero(over)
        src = at_d[of_d[who]] - 1
        yield from _spots(doc[src], mark[src], (base + entry["lo"])[src], (base + entry["hi"])[src], None, doc[who], mark[who], (base + entry["lo"])[who])
        need = ~over & ((several & (kinds > 1))[of_h] | hot)
        # Equal windows are equal on one side of the anchor: what no other document has on either is done with.
        i = np.flatnonzero(need & ~hot)
        need[i] = _met(h[i], entry["left"][i], doc[i]) | _met(h[i], entry["right"][i], doc[i])
        yield from self._asked(doc[need], mark[need], entry[need])


def _repeated(found: DataFrame) -> DataFrame:
    """Ranges covered already (h and to_doc are null); contexts to compare (h); contexts that claim to
    equal a larger document's (to_doc, to_mark, to_begin: that one's place).

    Shares come to a task one after the other, sorted by Spark, so a task holds one share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Anchors(0)
        for batch in batches:
            for share, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if share < 0:
                    yield from _spots(*np.frombuffer(blob.as_py(), "<i8").reshape(4, -1), None, None, None, None)
                    continue
                if share != now:
                    yield from held.give()
                    now, held = share, Anchors(share)
                yield from held.add(*_unpack(blob.as_py()))
        yield from held.give()

    return in_turn(found, "share").mapInArrow(run, SPOT)


# ---- contexts ------------------------------------------------------------------------------

CONTEXT = "h bigint, doc bigint, mark bigint, begin int, bytes binary"


def _context_rows(h: np.ndarray | None, doc: np.ndarray, mark: np.ndarray, begin: np.ndarray, whole: bytes, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(doc), 50_000):
        p = slice(at, at + 50_000)
        blobs = [whole[x:y] for x, y in zip(lo[p].tolist(), hi[p].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blobs), pa.int64()) if h is None else pa.array(h[p]), pa.array(doc[p]), pa.array(mark[p]), pa.array(begin[p].astype(np.int32)), pa.array(blobs, pa.binary())], ["h", "doc", "mark", "begin", "bytes"])


def _contexts(texts: DataFrame) -> DataFrame:
    """Bytes of the spots (doc, mark, text, spots): contexts to compare, and claims (h is null) at the place they are for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(2))
            whole = data.tobytes()
            spots = batch.column(3)
            count = np.diff(spots.offsets.to_numpy())
            flat = spots.flatten()
            begin, stop, h, to_doc, to_mark, to_begin = (flat.field(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            claim = flat.field(3).is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(count)), count)
            base = starts[row]
            i = np.flatnonzero(~claim)
            yield from _context_rows(h[i], batch.column(0).to_numpy()[row[i]], batch.column(1).to_numpy()[row[i]], begin[i], whole, (base + begin)[i], (base + stop)[i])
            # A text's claims for one other text at one distance are joined where they overlap or touch.
            i = np.flatnonzero(claim)
            if len(i):
                key = np.stack([row, to_doc, to_mark, to_begin - begin])[:, i]
                order = np.lexsort(key)
                i, key = i[order], key[:, order]
                group = np.cumsum(np.concatenate([[0], (key[:, 1:] != key[:, :-1]).any(0)]))
                g, lo, hi = _merged(group, begin[i], stop[i])
                lead = i[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))][g]
                yield from _context_rows(None, to_doc[lead], to_mark[lead], lo + (to_begin - begin)[lead], whole, base[lead] + lo, base[lead] + hi)

    return texts.select("doc", "mark", "text", "spots").mapInArrow(run, CONTEXT)


def _sub_contexts(contexts: DataFrame, level: int) -> DataFrame:
    """The contexts' windows once more, dealt by the next larger anchor (number ``level`` from the least) as well."""
    width = LENGTH - K + 1

    def split(blobs: list[bytes], h: np.ndarray) -> tuple[np.ndarray, ...]:
        size = np.array([len(b) for b in blobs])
        start = np.concatenate([[0], np.cumsum(size)])
        data = np.frombuffer(b"".join(blobs) + bytes(16), np.uint8)
        word = _word(data, 0, len(data) - 7)
        string = strings(word[:-8], word[8:])
        many = size - LENGTH + 1
        owner = np.repeat(np.arange(len(blobs)), many)
        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        seen = np.sort(string[(start[owner] + offset)[:, None] + np.arange(width)], 1)
        rank = np.cumsum(np.concatenate([np.zeros((len(seen), 1), np.int64), seen[:, 1:] != seen[:, :-1]], 1), 1)
        value = seen[np.arange(len(seen)), np.argmax(rank >= np.minimum(level, rank[:, -1])[:, None], 1)]
        cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])]))
        last = np.append(cut[1:], len(owner)) - 1
        key = mix64(h[owner[cut]].view(np.uint64) ^ mix64(value[cut] + np.uint64(level))).view(np.int64)
        return key, owner[cut], offset[cut], offset[last] + LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                blobs = part.column(4).to_pylist()
                h, owner, lo, hi = split(blobs, part.column(0).to_numpy())
                cols = [c.to_numpy()[owner] for c in part.columns[1:4]]
                out = [blobs[i][a:b] for i, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(cols[0]), pa.array(cols[1]), pa.array((cols[2] + lo).astype(np.int32)), pa.array(out, pa.binary())], ["h", "doc", "mark", "begin", "bytes"])

    return contexts.select("h", "doc", "mark", "begin", "bytes").mapInArrow(run, CONTEXT)


# ---- the transform -------------------------------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of a text (small integers, its last one the only 0) by their first 64 symbols."""
    n = len(text)
    wide = text.max(initial=0) > 255
    size, kind = (4, ">u2") if wide else (8, "u1")
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(kind)
    step = padded.dtype.itemsize
    key = np.lib.stride_tricks.as_strided(padded, (n, size), (step, step)).copy().view(">u8").ravel().astype(np.uint64)
    depth = size
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])).astype(np.uint64)
        if depth >= LENGTH or rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.uint64)
        ahead[: max(0, n - depth)] = rank[depth:] + np.uint64(1)
        key = rank << np.uint64(32) | ahead
        depth *= 2


def common_classes(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and for each place in it a class: equal classes share their first ``length`` symbols.

    Intervals of the transform are extended backward breadth first. An interval that ends where no
    common prefix is known yet sets it to its round's number and lives on; the rest stop.
    """
    n = len(text)
    order = suffix_order(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    before, after = np.full(n, -1), np.full(n, n)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    lcp = np.full(n + 1, -1, np.int32)
    lcp[0] = lcp[n] = 0
    left, right = np.array([0]), np.array([n])
    for depth in range(length):
        size = right - left
        place = np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        lo, hi = np.repeat(left, size), np.repeat(right, size)
        # First and last place of each symbol in an interval; images don't overlap, so they pair in order.
        new_left, new_right = np.sort(lf[place[before[place] < lo]]), np.sort(lf[place[after[place] >= hi]]) + 1
        fresh = lcp[new_right] < 0
        left, right = new_left[fresh], new_right[fresh]
        lcp[right] = depth
        if not len(left):
            break
    return order, np.cumsum(lcp[:n] >= 0)


def covered_windows(contexts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each context, where its windows start that a smaller document has too."""
    size = np.array([len(c) for c in contexts])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.ones(start[-1] + 1, np.int16)
    flat = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8)
    used = np.flatnonzero(np.bincount(flat, minlength=256))
    dense = np.zeros(256, np.int16)
    dense[used] = np.arange(len(used)) + 2
    if len(used) < 250:
        text, dense = text.astype(np.uint8), dense.astype(np.uint8)
    text[:-1] = dense[flat]
    text[start[1:] - 1] = 1
    text[-1] = 0
    order, group = common_classes(text)
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    valid = np.zeros(len(text), bool)
    valid[:-1] = np.arange(len(text) - 1) - start[owner] <= (size - LENGTH)[owner]
    whose = np.full(len(text), np.iinfo(np.int64).max)
    whose[:-1][valid[:-1]] = docs[owner[valid[:-1]]]
    listed = whose[order]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(listed, head), np.diff(np.append(head, len(group))))
    gone = np.zeros(len(text), bool)
    gone[order] = least < listed
    gone &= valid
    at = np.flatnonzero(gone)
    cut = np.searchsorted(at, start)
    return [at[cut[i] : cut[i + 1]] - start[i] for i in range(len(contexts))]


def _decide(contexts: DataFrame) -> DataFrame:
    """Covered ranges from contexts dealt and sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            doc, mark, begin = (rows.column(i).to_numpy() for i in (1, 2, 3))
            places = covered_windows(rows.column(4).to_pylist(), doc)
            out = [np.zeros((4, 0), np.int64)]
            for i, where in enumerate(places):
                if len(where):
                    cut = np.flatnonzero(np.diff(where) > 1) + 1
                    a, b = where[np.concatenate([[0], cut])], where[np.concatenate([cut - 1, [len(where) - 1]])] + LENGTH
                    out.append(np.stack([np.full(len(a), doc[i]), np.full(len(a), mark[i]), begin[i] + a, begin[i] + b]))
            cols = np.concatenate(out, 1)
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32))], ["doc", "mark", "begin", "stop"])

        total = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total += batch.num_rows * LENGTH
            if total < BLOCK:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            h = rows.column(0).to_numpy()
            last = np.flatnonzero(h != h[-1])
            if len(last):
                yield flush(rows.slice(0, int(last[-1]) + 1))
                held = rows.slice(int(last[-1]) + 1).combine_chunks().to_batches()
                total = sum(b.num_rows for b in held) * LENGTH
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return spread(contexts.select("h", "doc", "mark", "begin", "bytes"), "h").sortWithinPartitions("h").mapInArrow(run, RANGE)


def _compared(scratch: Scratch, contexts: DataFrame, hot: int, level: int = 0) -> DataFrame:
    """Covered ranges of all contexts. Of a group of over ``hot``, each different context is decided once, and what is found holds for all its places.

    Where a group has over ``hot`` different ones, their windows are dealt by the next anchor. After the last of the K-byte strings
    of a window, a group's windows have all strings in common: few are different.
    """
    over = lambda rows: scratch.save(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("h"))
    large = over(contexts)
    if not large.limit(1).count():
        return _decide(contexts)
    small = _decide(contexts.join(large, "h", "left_anti"))
    many = contexts.join(large, "h", "left_semi")
    one = scratch.save(many.groupBy("h", "bytes").agg(F.min("doc").alias("least")).withColumn("context", F.monotonically_increasing_id()))
    places = scratch.save(many.join(one, ["h", "bytes"]).select("doc", "mark", "begin", F.octet_length("bytes").alias("n"), "least", "context"))
    whole = places.filter("doc > least").select("doc", "mark", "begin", (F.col("begin") + F.col("n")).alias("stop"))
    # The smallest document's contexts, once each, as rows of their own.
    own = one.select("h", F.col("least").alias("doc"), F.col("context").alias("mark"), F.lit(0).alias("begin"), "bytes")
    still = over(own) if level < LENGTH - K else None
    if still is None or not still.limit(1).count():
        found = _decide(own)
    else:
        parts = scratch.save(_sub_contexts(own.join(still, "h", "left_semi"), level + 1))
        found = _decide(own.join(still, "h", "left_anti")).unionByName(_compared(scratch, parts, hot, level + 1))
    f, p = found.alias("f"), places.filter("doc = least").alias("p")
    back = f.join(p, F.col("f.mark") == F.col("p.context")).select("p.doc", "p.mark", (F.col("p.begin") + F.col("f.begin")).alias("begin"), (F.col("p.begin") + F.col("f.stop")).alias("stop"))
    return small.unionByName(whole).unionByName(back)


# ---- the whole -----------------------------------------------------------------------------

RESULT = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def cover(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, seed: int = 0) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept (the bytes left) for every row."""
    scratch = Scratch(docs.sparkSession)
    row = docs.select(id_of(id_col).alias("doc"), F.xxhash64(text_of(text_col)).alias("mark"), text_of(text_col).alias("text"))
    total = row.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    spots = scratch.save(_repeated(_find(row, max(partitions(docs), -(-total // SHARE)), seed)))
    scratch.tidy()
    listed = spots.filter("h is not null or to_doc is not null").groupBy("doc", "mark").agg(F.collect_list(F.struct("begin", "stop", "h", "to_doc", "to_mark", "to_begin")).alias("spots"))
    fetched = scratch.save(_contexts(row.join(listed, ["doc", "mark"])))
    done = scratch.save(spots.filter("h is null and to_doc is null").select("doc", "mark", "begin", "stop"))
    scratch.drop(spots)
    scratch.tidy()
    found = scratch.save(_compared(scratch, fetched.filter("h is not null"), hot))
    ranges = done.unionByName(found).withColumn("bytes", F.lit(None).cast("binary"))
    claims = fetched.filter("h is null").select("doc", "mark", "begin", (F.col("begin") + F.octet_length("bytes")).alias("stop"), "bytes")
    scratch.tidy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column(1))
            found = batch.column(2)
            rows = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                mine = data[starts[i] : starts[i + 1]]
                off = np.zeros(len(mine), bool)
                whole = mine.tobytes() if found[i].is_valid else b""
                for r in found[i].as_py() or ():
                    if r["bytes"] is not None and whole[r["begin"] : r["stop"]] != r["bytes"]:
                        raise ValueError(f"two contexts of document {doc} have one hash: run again with another seed")
                    off[r["begin"] : r["stop"]] = True
                spans = int(off[:1].sum() + np.count_nonzero(off[1:] & ~off[:-1]))
                rows.append((doc, len(mine), int(off.sum()), spans, mine[~off].tobytes()))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    by_doc = ranges.unionByName(claims).groupBy("doc", "mark").agg(F.collect_list(F.struct("begin", "stop", "bytes")).alias("found"))
    return row.join(by_doc, ["doc", "mark"], "left").select("doc", "text", "found").mapInArrow(run, RESULT)


def op10_suffix(spark, sf_dir: str) -> DataFrame:
    """Every document with its count of bytes that repeat a smaller document's, and what is left."""
    out = cover(table(spark, sf_dir, "documents"))
    return out.select(back_to_id("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
