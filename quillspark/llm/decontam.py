"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is split into e + 1 pieces. If a stretch of a document is within e edits of the item,
at least one piece occurs in it unchanged (pigeonhole). All pieces of all items are searched at once in each whole text
(Aho-Corasick); each piece hit proposes a stretch, and Myers' bit-parallel algorithm decides whether the item lies in it within
its budget. Both sides are compared in lower case with every run of non-word characters as one space.

The documents are not shuffled. Items go to the tasks in chunks of at most `chunk_bytes` of text: one broadcast a chunk, as many
passes as there are chunks, so a benchmark of any size is searched whole. A chunk is searched, its hits written and its broadcast
dropped before the next is read: driver and executors hold one at a time.

Defined results. Null or empty texts and items without a word have no hits. Items too short for an edit must stand as whole words. Equal items (under different ids) are each reported.
Rows of documents that repeat an id are each searched; equal hits are given once. Of several places of an item in a document the
closest, and of these the first, is given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, keyed, rows_without, to_arrow, written

HIT = "doc_id long, item_id long, distance int, start long, end long, budget int"
_GAP = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, single spaces for all that isn't a letter or digit, none at the ends."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(n: int, rate: float) -> int:
    """Edits allowed for an item of n characters."""
    return int(n * rate)


def pieces(item: str, e: int) -> list[tuple[int, str]]:
    """(offset, piece): e + 1 pieces of nearly equal length that together are the item."""
    at = [len(item) * i // (e + 1) for i in range(e + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """The least edit distance of item to any stretch of text, and where the first such stretch ends (Myers 1999; Python's
    whole numbers serve as bit vectors of any length)."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = ((eq & up) + up) ^ up | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j
    return best, end


def locate(item: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the closest stretch; of equally close ones the first to end, and its shortest form."""
    d, end = myers(item, text)
    _, back = myers(item[::-1], text[:end][::-1])
    return d, end - back, end


class Matcher:
    """Items of one chunk, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, e) in enumerate(self.items):
            for offset, piece in pieces(t, e) if e else [(-1, f" {t} ")]:
                found.setdefault(piece, []).append((k, offset))
        self.machine = ahocorasick.Automaton()
        for piece, where in found.items():
            self.machine.add_word(piece, (len(piece), where))
        if found:
            self.machine.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int, int, int]]:
        """(item id, distance, start, end, budget) for each item found in a normalised text."""
        if not text or not self.items:
            return
        spots: dict[int, list[int]] = {}
        for last, (n, where) in self.machine.iter(f" {text} "):
            for k, offset in where:
                spots.setdefault(k, []).append(last - n - offset)  # where the item would start
        for k, starts in spots.items():
            i, item, e = self.items[k]
            best = None
            a = b = None
            for s in [*sorted(starts), None]:  # stretches that overlap are searched as one
                if b is not None and (s is None or s - e > b):
                    d, x, y = locate(item, text[a:b])
                    if d <= e and (best is None or d < best[0]):
                        best = (d, a + x, a + y)
                    a = b = None
                if s is not None:
                    a = max(0, s - e) if a is None else a
                    b = min(len(text), s + len(item) + e)
            if best:
                yield i, *best, e


def _chunks(items: DataFrame, chunk_bytes: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The number of chunks of bounded size, and the items in them, read one after the other."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // chunk_bytes))
    part = items.withColumn("c", F.pmod(F.xxhash64("id", "text"), F.lit(n)))

    def each():
        for k in range(n):
            rows = part.where(F.col("c") == k).select("id", "text").collect()
            if chunk := sorted({(r.id, t) for r in rows if (t := normal(r.text))}):
                yield chunk

    return n, each()


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chunk_bytes: int = 4 << 20) -> DataFrame:
    """HIT rows: every document and test item that lies in it within its budget. start and end count characters of the
    normalised text."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    shape = to_arrow(HIT, spark)
    n, chunks = _chunks(id_text(items, item_col, item_text_col).where("id is not null"), chunk_bytes)
    out = spark.createDataFrame([], HIT)
    for chunk in chunks:
        sent = spark.sparkContext.broadcast(chunk)

        def run(batches, sent=sent):
            matcher = Matcher(sent.value, rate)
            for b in batches:
                found = [(i, *hit) for i, t in zip(b.column("id").to_pylist(), b.column("text")) for hit in matcher.search(normal(t.as_py()))]
                cols = zip(*[(i, k, d, x, y, e) for i, k, d, x, y, e in found]) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, shape)], schema=shape)

        hits = rows.mapInArrow(run, HIT)
        if n > 1:
            hits = written(hits, "decontam-hits")
            sent.destroy()
        out = out.unionByName(hits)
    best = F.min(F.struct("distance", "start", "end", "budget"))
    return out.groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.*")


def clean_of(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **k) -> DataFrame:
    """docs without the rows that hold a test item, whatever their ids; all columns as they are."""
    hits = matches(keyed(docs, id_col, text_col), items, id_col="row", **k).select(F.col("doc_id").alias("row")).distinct()
    return rows_without(docs, written(hits, "decontam-gone"), id_col, text_col)
