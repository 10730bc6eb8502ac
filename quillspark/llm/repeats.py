"""Removal of repeated passages with a sparse suffix array that is built by deep-shallow sorting.

Every byte that lies in a LENGTH-byte string which also starts in a document with a smaller id is removed. Each such string
(window) belongs to the piece of the text around its anchor: the GRAM-byte string of least hash in it. Windows that are equal
have equal anchors, so equal windows meet wherever pieces with the same anchor meet.

1. Each block of documents sends the different anchors of its texts to buckets by hash (see exchange.py); it is told how many
   blocks have each.
2. Each block sends the pieces of anchors that occur more than once, each different piece once, with its least document; equal
   pieces of larger documents in the block are settled on the spot. A bucket sorts the suffixes of all the pieces it got (the
   windows; equal pieces are one), and groups of equal ones name the least document of each window: what of each piece is to go follows from that.
3. Each block cuts the texts.

Anchors found in more than `hot` blocks are dealt window by window, by a hash of the window, so no bucket takes in all
surroundings of a frequent passage. Copies cost one entry a block. Nothing passes through the driver.

Defined results. A null text is empty. Texts under LENGTH bytes lose nothing. Rows that repeat an id do not remove from each
other. A row without an id neither removes nor loses anything. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, block_of, by_bucket, n_blocks, splitmix, to_arrow, unpacked_counts, written
from .exchange import SENT, add_up, sent_rows, table
from .suffixes import sort_suffixes

LENGTH = 50
GRAM = 24
_SPAN = LENGTH - GRAM + 1  # places of an anchor in a window
_SLICE = 1 << 20
#: Windows that are sorted at a time (an anchor's are never parted).
_SORTED = 200_000
_ALONE = 255  # in place of an anchor's: the piece is one window of a frequent anchor, complete in its bucket
_PIECES = "bucket int, block int, local boolean, ids binary, rows binary, at binary, ends binary, sizes binary, anchors binary, data binary"
_CUTS = "block int, ids binary, rows binary, at binary, ends binary"
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


class Texts:
    """The texts of a block, end to end."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode() for t in texts]
        self.lens = np.array([len(p) for p in parts], np.int64)
        self.first = np.cumsum(self.lens) - self.lens
        self.bytes = b"".join([*parts, bytes(LENGTH + 8)])
        self.data = np.frombuffer(self.bytes, np.uint8)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, start, end, place): runs of windows with one anchor; end - 1 is the last window's start, and the anchor is
        `place` bytes after the first's."""
        out: list = []
        # window starts, text by text; short texts share a slice, long ones take several
        can = self.first + np.maximum(0, self.lens - LENGTH + 1)
        n = int(self.lens.sum())
        for a in range(0, n, _SLICE):
            b = min(n, a + _SLICE)
            words = np.ndarray((b - a + LENGTH - 8,), "<u8", self.data[a:], strides=(1,)).astype(np.uint64)
            words *= np.uint64(0x9E3779B97F4A7C15)
            words ^= words >> np.uint64(29)
            grams = words[: b - a + _SPAN - 1] * np.uint64(0xBF58476D1CE4E5B9)
            grams += words[8 : 8 + len(grams)] * np.uint64(0x94D049BB133111EB)
            grams += words[16 : 16 + len(grams)] * np.uint64(0xD6E8FEB86659FD93)
            grams = splitmix(grams) & ~np.uint64(63)
            grams |= np.arange(len(grams), dtype=np.uint64) & np.uint64(63)  # tells neighbouring anchors apart
            width, low = 1, grams
            while 2 * width <= _SPAN:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[: b - a], low[_SPAN - width : _SPAN - width + b - a])
            valid = np.zeros(b - a + 1, np.int64)
            here = slice(int(np.searchsorted(self.first + self.lens, a, "right")), int(np.searchsorted(self.first, b, "left")))
            np.add.at(valid, np.clip(self.first[here], a, b) - a, 1)
            np.add.at(valid, np.clip(can[here], a, b) - a, -1)
            valid = np.cumsum(valid[:-1]) > 0
            edge = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (valid[1:] != valid[:-1])]))
            stop = np.concatenate([edge[1:], [b - a]])
            good = valid[edge]
            edge, stop, low = edge[good], stop[good], low[edge[good]]
            out.append((low & ~np.uint64(63), edge + a, stop + a, ((low & np.uint64(63)).astype(np.int64) - edge) & 63))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _joined(at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as maximal runs."""
    by = np.argsort(at, kind="stable")
    at, far = at[by], np.maximum.accumulate(ends[by])
    new = np.concatenate([[True], at[1:] > far[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])
    return at[new], far[last]


def _local(t: Texts, ids: np.ndarray, rows: np.ndarray, blocks_with: np.ndarray, hot: int, bits: int, block: int, shape: pa.Schema) -> pa.Table:
    """What a block sends in step 2. blocks_with: how many blocks have each of its different anchors, in ascending order of these."""
    anchor, start, end, place = t.pieces()
    kinds, index, n = np.unique(anchor, return_inverse=True, return_counts=True)
    use = np.flatnonzero(((n > 1) | (blocks_with > 1))[index])
    is_hot = (blocks_with > hot)[index]
    doc = np.searchsorted(t.first, start, "right") - 1
    doc_of = doc.tolist()
    id_of = ids.tolist()
    least: dict[bytes, list[int]] = {}
    cut_doc, cut_at, cut_end = [], [], []
    cuts: list[int] = []
    for k in use[np.argsort(ids[doc[use]], kind="stable")].tolist():  # ascending ids: the first is the least
        s = t.bytes[start[k] : end[k] + LENGTH - 1]
        have = least.get(s)
        if have is None:
            least[s] = [k]
        elif id_of[doc_of[have[0]]] == id_of[doc_of[k]]:
            have.append(k)
        else:
            cuts.append(k)
    out = []
    if cuts:
        k = np.array(cuts)
        cut_doc, cut_at, cut_end = doc[k], start[k] - t.first[doc[k]], end[k] + LENGTH - 1 - t.first[doc[k]]
        wide = np.int64(1) << np.int64(40)  # documents apart, then maximal runs
        a, e = _joined(cut_doc * wide + cut_at, cut_doc * wide + cut_end)
        d = a // wide
        out.append((block % (1 << bits), block, True, ids[d].tobytes(), rows[d].tobytes(), (a - d * wide).tobytes(), (e - d * wide).tobytes(), b"", b"", b""))
    # one piece of an anchor that no other block has is settled
    known = (blocks_with > 1)[index]
    first = np.array([have[0] for have in least.values()], np.int64)
    several = np.bincount(index[first], minlength=len(kinds)) > 1 if len(first) else np.zeros(len(kinds), bool)
    send = np.array([k for have in least.values() for k in have if known[have[0]] or several[index[have[0]]]], np.int64)
    if len(send):
        warm = send[~is_hot[send]]
        a, w, key, p = start[warm], end[warm] + LENGTH - 1, anchor[warm], place[warm].astype(np.uint8)
        cold = send[is_hot[send]]
        if len(cold):  # one entry a window
            count = end[cold] - start[cold]
            from_ = np.repeat(start[cold] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            name = np.array([xxhash.xxh3_64_intdigest(t.bytes[x : x + LENGTH]) for x in from_.tolist()], np.uint64)
            a, w, key, p = np.concatenate([a, from_]), np.concatenate([w, from_ + LENGTH]), np.concatenate([key, name]), np.concatenate([p, np.full(len(from_), _ALONE, np.uint8)])
        by = np.argsort(key, kind="stable")
        a, w, key, p = a[by], w[by], key[by], p[by]
        d = np.searchsorted(t.first, a, "right") - 1
        for bucket, s in by_bucket(key, bits):
            data = b"".join(t.bytes[x:y] for x, y in zip(a[s].tolist(), w[s].tolist()))
            out.append((bucket, block, False, ids[d[s]].tobytes(), rows[d[s]].tobytes(), (a[s] - t.first[d[s]]).astype("<u4").tobytes(), b"", (w[s] - a[s]).astype("u1").tobytes(), p[s].tobytes(), pa.compress(data, "zstd", asbytes=True)))
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(shape)], schema=shape)


def _variant(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Numbers the different texts of an id (by their hash): 0 for nearly all."""
    by = np.lexsort((rows, ids))
    i, r = ids[by], rows[by]
    same = np.concatenate([[False], i[1:] == i[:-1]])[: len(i)]
    step = np.cumsum(same & np.concatenate([[False], r[1:] != r[:-1]])[: len(i)])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(i))))
    out = np.empty(len(i), "<i4")
    out[by] = step - step[start]
    return out


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])


def _settle(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(block, id, row, at, end) of what is to go, from the pieces of a bucket."""
    ids, rows, at, size, place = (_column(t, c, k) for c, k in (("ids", "<i8"), ("rows", "<i4"), ("at", "<u4"), ("sizes", "u1"), ("anchors", "u1")))
    at, size, each = at.astype(np.int64), size.astype(np.int64), [len(x.as_buffer()) for x in t.column("sizes")]
    block = np.repeat(t.column("block").to_numpy(), each)
    bytes_of = np.add.reduceat(size, np.cumsum([0, *each[:-1]])).tolist()
    data = b"".join([*(pa.decompress(x.as_buffer(), n, "zstd", asbytes=True) for x, n in zip(t.column("data"), bytes_of)), bytes(LENGTH + 16)])
    first = np.cumsum(size) - size
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    anchor = first + np.where(place == _ALONE, 0, place)
    key = splitmix(words[anchor]) * np.uint64(3) + splitmix(words[anchor + 8]) * np.uint64(5) + splitmix(words[anchor + 16])
    # equal pieces of different blocks are one piece with the least of their documents
    number: dict[bytes, int] = {}
    piece = np.array([number.setdefault(data[a : a + n], len(number)) for a, n in zip(first.tolist(), size.tolist())], np.int64)
    one = np.zeros(len(number), np.int64)
    one[piece[::-1]] = np.arange(len(piece))[::-1]
    lowest = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(lowest, piece, ids)
    # the suffixes of the different pieces whose anchor has several, some anchors at a time
    _, a_index, a_count = np.unique(key[one], return_inverse=True, return_counts=True)
    multi = np.flatnonzero(a_count[a_index] > 1)
    multi = multi[np.argsort(a_index[multi], kind="stable")]
    windows = size[one[multi]] - LENGTH + 1
    new = np.flatnonzero(np.diff(a_index[multi], prepend=-1))  # where an anchor's pieces begin
    upto = np.cumsum(windows)[np.append(new[1:] - 1, len(multi) - 1)] if len(multi) else np.zeros(0, np.int64)
    text, s = np.frombuffer(data, np.uint8), 0
    base = np.full(len(number), -1, np.int64)  # of each piece that is sorted: where its windows begin
    base[multi] = np.cumsum(windows) - windows
    least = np.empty(int(windows.sum()), np.int64)
    while s < len(new):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + _SORTED, "right")))
        part = slice(new[s], new[e] if e < len(new) else len(multi))
        own = np.repeat(multi[part], windows[part])
        step = np.arange(len(own)) - np.repeat(np.cumsum(windows[part]) - windows[part], windows[part])
        order, group = sort_suffixes(text, first[one[own]] + step, LENGTH)
        low = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, group, lowest[own[order]])
        least[base[multi[part.start]] + order] = low[group]
        s = e
    # whole pieces of larger documents go; of the others what the sort has found
    whole = lowest[piece] < ids
    w = np.flatnonzero(whole)
    out = [(block[w], ids[w], rows[w], at[w], at[w] + size[w])]
    p = np.flatnonzero(~whole & (base[piece] >= 0))
    for k in range(0, len(p), 20_000):
        q = p[k : k + 20_000]
        count = size[q] - LENGTH + 1
        entry = np.repeat(q, count)
        step = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        hit = least[base[piece[entry]] + step] < ids[entry]
        entry, step = entry[hit], step[hit]
        if len(entry):
            new = np.concatenate([[True], (entry[1:] != entry[:-1]) | (step[1:] != step[:-1] + 1)])
            last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(entry) - 1]])
            e = entry[new]
            out.append((block[e], ids[e], rows[e], at[e] + step[new], at[e] + step[last] + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, hot: int = 64, radix: int = 10) -> DataFrame:
    """CUT rows of every whole text; kept_text is what is left (a cut inside a character leaves U+FFFD)."""
    spark = docs.sparkSession
    both = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    blocks = n_blocks(both, block_bytes)
    bits = bits_for(blocks * block_bytes, 2 << 20)  # a bucket's suffixes take some fifty times the bytes of its pieces
    rows = both.select(block_of(blocks).alias("block"), "id", "text", F.xxhash64("id", "text").alias("row"))
    sent_shape, piece_shape, cuts_shape, cut_shape = (to_arrow(x, spark) for x in (SENT, _PIECES, _CUTS, CUT))

    def ask(key, t):
        keys = np.unique(Texts(t.column("text").to_pylist()).pieces()[0])
        return table(sent_rows(0, key[0].as_py(), keys, None, bits, radix), sent_shape)

    some = rows.where("id is not null")
    told = add_up(some.groupBy("block").applyInArrow(ask, SENT), bits, "repeats", radix)[0]
    told = told.select(F.col("unit").cast("int").alias("block"), "bucket", "totals")

    def send(key, t, a):
        if not t.num_rows:
            return pa.table([pa.array([], f.type) for f in piece_shape], schema=piece_shape)
        a = a.sort_by("bucket")
        blocks_with = np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(x.as_buffer()) for x in a.column("totals"))])
        ids, names = (np.array(t.column(c).to_pylist(), np.int64) for c in ("id", "row"))
        return _local(Texts(t.column("text").to_pylist()), ids, _variant(ids, names), blocks_with, hot, bits, key[0].as_py(), piece_shape)

    def settle(key, t):
        out = []
        local = t.filter(t.column("local"))
        for r in local.select(["block", "ids", "rows", "at", "ends"]).to_pylist():
            out.append(tuple(r.values()))
        sent = t.filter(pa.compute.invert(t.column("local")))
        if sent.num_rows:
            block, *cols = _settle(sent)
            by = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], block[by][1:] != block[by][:-1]])) if len(by) else []
            for s, e in zip(edges, [*edges[1:], len(by)]):
                out.append((int(block[by[s]]), *(np.ascontiguousarray(c[by[s:e]]).tobytes() for c in cols)))
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(cuts_shape)], schema=cuts_shape)

    sent = some.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, _PIECES)
    cuts = written(sent.groupBy("bucket").applyInArrow(settle, _CUTS), "repeats-cuts")

    def cut(key, t, c):
        spans: dict[tuple, tuple] = {}
        if c.num_rows:
            ids, names, at, ends = (_column(c, x, k) for x, k in (("ids", "<i8"), ("rows", "<i4"), ("at", "<i8"), ("ends", "<i8")))
            by = np.lexsort((at, names, ids))
            ids, names, at, ends = ids[by], names[by], at[by], ends[by]
            edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (names[1:] != names[:-1])]))
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(ids)]):
                spans[int(ids[s]), int(names[s])] = _joined(at[s:e], ends[s:e])
        out = []
        has_id = [i is not None for i in t.column("id").to_pylist()]
        name_of = np.full(t.num_rows, -1, np.int64)
        name_of[has_id] = _variant(*(np.array([v for v in t.column(x).to_pylist() if v is not None] if x == "id" else np.array(t.column(x).to_pylist(), np.int64)[has_id], np.int64) for x in ("id", "row")))
        for i, name, text in zip(t.column("id").to_pylist(), name_of.tolist(), t.column("text").to_pylist()):
            data = (text or "").encode()
            a, e = spans.get((i, name), ((), ()))
            kept, last = [], 0
            for x, y in zip(a, e):
                kept.append(data[last:x])
                last = y
            left = b"".join([*kept, data[last:]])
            out.append((i, len(data), len(data) - len(left), len(a), hashlib.sha256(left).hexdigest(), left.decode(errors="replace")))
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(cut_shape)], schema=cut_shape)

    return rows.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(cut, CUT)
