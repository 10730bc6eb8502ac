"""Languages by prediction by partial matching: a byte context tree for each language, frozen, tells how many bits a text takes.

A language's tree holds, for each context of up to `order` bytes, which bytes came after it and how often. A byte is coded in the
longest context that the tree has: a byte seen there n of T times, among D different ones, takes log2((T + D) / n) bits; else an
escape, log2((T + D) / D) bits, leads to the context that is a byte shorter, where the bytes just excluded no longer count; after the
empty context, the bytes never seen share the rest evenly. These are exact code lengths: the chances of the 256 bytes sum to one in every
context. The language that takes the fewest bits is predicted, the first by name of equals; score is its posterior under
equal priors.

Trees are learnt from a bounded sample: texts are cut into pieces of PIECE bytes (with the bytes before them as context), pieces are
drawn by a hash of their bytes, equal pieces once, at a rate that gives about `sample_bytes` a language and not over `total_bytes` in
all. Whatever the corpus, then, a language is learnt in one bounded task and the trees go to the executors as one broadcast. Everything
else, totals, drawing and scoring, reads whole texts of all rows. Texts are read in lower case.

The costs of all grams that the trees know are computed once a worker and looked up by hash; only bytes after unknown grams walk down
the trees. Both ways give the same numbers.

Defined results. A null text, or one without a letter, is und with score 0; so is every text if no language was learnt. A row
without an id is held out. Rows that repeat an id are each predicted. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_counts, packed_keys, to_arrow, unpacked_counts, unpacked_keys, written

PIECE = 4096
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, code_bits double"
TREE = "lang string, depth int, keys binary, counts binary"
#: Most numbers in the table of known grams (8 bytes each); larger models walk down the trees for every byte.
KNOWN = 1 << 23


def grams(pieces: list[bytes], order: int) -> np.ndarray:
    """For each byte of the pieces, after the first `order` of each, the number its last order + 1 bytes make, itself the lowest."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k) if len(data) > k else np.uint64(0)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return out[np.arange(len(data)) - first >= order]


def _low(order: int) -> np.uint64:
    return np.uint64((1 << (8 * order)) - 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in ascending keys, -1 where they are none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Tree:
    """A language's frozen counts. Of each depth: the grams (context and byte) with counts, the contexts with the sum (T) and number (D) of
    their bytes, and what is left of both in the next shorter context once a context's bytes are excluded (rest, new)."""

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray]):
        self.order = len(keys) - 1
        self.keys, self.counts = keys, [c.astype(float) for c in counts]
        self.contexts, self.T, self.D, self.rest, self.new = [], [], [], [], []
        for d, (k, n) in enumerate(zip(keys, self.counts)):
            of = k >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            self.contexts.append(of[first])
            self.T.append(np.add.reduceat(n, first))
            self.D.append(np.diff(np.append(first, len(k))).astype(float))
            if d:
                shorter = _find(self.contexts[d - 1], self.contexts[d] & _low(d - 1))
                taken = np.add.reduceat(self.counts[d - 1][_find(keys[d - 1], k & _low(d))], first)
                self.new.append(self.D[d - 1][shorter] - self.D[d])
                self.rest.append(self.T[d - 1][shorter] - taken + self.new[d])
            else:
                self.new.append(np.array([256 - self.D[0][0]]))
                self.rest.append(self.new[0])

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(wanted))
        todo, g = np.arange(len(wanted)), wanted
        came = np.full(len(wanted), -1, np.int64)  # the longer context that was escaped from
        for d in range(self.order, -1, -1):
            context = _find(self.contexts[d], (g & _low(d + 1)) >> np.uint64(8))
            gram = _find(self.keys[d], g & _low(d + 1))
            fresh = came < 0
            if d < self.order:
                total = np.where(fresh, self.T[d][context] + self.D[d][context], self.rest[d + 1][came])
                escapes = np.where(fresh, self.D[d][context], self.new[d + 1][came])
            else:
                total, escapes = self.T[d][context] + self.D[d][context], self.D[d][context]
            hit, known = gram >= 0, context >= 0
            out[todo[hit]] += np.log2(total[hit] / self.counts[d][gram[hit]])
            down = known & ~hit & (escapes > 0)
            out[todo[down]] += np.log2(total[down] / escapes[down])
            todo, g, came = todo[~hit], g[~hit], context[~hit]
        out[todo] += np.log2(self.new[0][0])
        return out


class Model:
    """The trees of all languages, and the costs of the grams that any of them knows."""

    def __init__(self, trees: dict[str, Tree]):
        self.languages = sorted(trees, key=lambda x: x.encode())
        self.trees = [trees[x] for x in self.languages]
        self.order = self.trees[0].order
        self.known = np.unique(np.concatenate([t.keys[-1] for t in self.trees]))
        if len(self.known) * len(self.trees) > KNOWN:
            self.known = self.known[:0]
        self.costs = self._walk(self.known)
        self.shift = np.uint64(64 - max(4, int(4 * len(self.known)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        todo = np.arange(len(self.known), dtype=np.int32)
        at = self._slot(self.known)
        while len(todo):  # open addressing: who finds a slot free takes it, the others try the next
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            left = self.slots[at] != todo
            todo, at = todo[left], (at[left] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _walk(self, wanted: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(wanted) for t in self.trees], 1)

    def _known(self, wanted: np.ndarray) -> np.ndarray:
        """Places among the known grams, -1 where there is none."""
        at = self._slot(wanted)
        place = self.slots[at]
        if not len(self.known):
            return place
        wrong = np.flatnonzero((place >= 0) & (self.known[place] != wanted))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.slots) - 1)
            place[wrong] = self.slots[at[wrong]]
            wrong = wrong[(place[wrong] >= 0) & (self.known[place[wrong]] != wanted[wrong])]
        return place

    def bits(self, texts: list[bytes], block: int = 1 << 19) -> np.ndarray:
        """Code length of each text in each language; blocks of about `block` bytes at a time, long texts cut across blocks."""
        out = np.zeros((len(texts), len(self.trees)))
        pieces, of, size = [], [], 0
        for i, t in enumerate(texts):
            t = b"\xff" * self.order + t
            for a in range(0, len(t) - self.order, block):
                pieces.append(t[a : a + self.order + block])
                of.append(i)
                size += len(pieces[-1])
                if size >= block:
                    self._add(out, pieces, of)
                    pieces, of, size = [], [], 0
        if pieces:
            self._add(out, pieces, of)
        return out

    def _add(self, out: np.ndarray, pieces: list[bytes], of: list[int]) -> None:
        g = grams(pieces, self.order)
        place = self._known(g)
        costs = self.costs[place] if len(self.costs) else np.zeros((len(g), len(self.trees)))
        miss = np.flatnonzero(place < 0)
        if len(miss):
            odd, back = np.unique(g[miss], return_inverse=True)
            costs[miss] = self._walk(odd)[back]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) - self.order
        np.add.at(out, of, np.add.reduceat(costs, np.cumsum(sizes) - sizes, axis=0))


def trees(docs: DataFrame, order: int = 4, sample_bytes: int = 1 << 19, total_bytes: int = 4 << 20, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """TREE rows of each language of docs (all of which are learnt from): its grams of each depth."""
    rows = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.lower(F.col(f"`{text_col}`").cast("string")).cast("binary").alias("text")).where("lang is not null and octet_length(text) > 0")
    sizes = written(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")), "ppm-sizes")
    most = min(sample_bytes, total_bytes // max(1, sizes.count()))
    rate = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(most)) / F.col("size")).alias("rate"))
    at = lambda i: F.when(i == 0, F.concat(F.lit(b"\xff" * order), F.substr("text", F.lit(1), F.lit(PIECE)))).otherwise(F.substr("text", i * PIECE + 1 - order, F.lit(PIECE + order)))
    last = F.floor((F.octet_length("text") - 1) / PIECE).cast("int")
    pieces = rows.select("lang", F.explode(F.transform(F.sequence(F.lit(0), last), at)).alias("piece")).join(F.broadcast(rate) if sizes.count() <= 100_000 else rate, "lang")
    drawn = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(1 << 40)) < F.col("rate") * (1 << 40)).select("lang", "piece").distinct()
    shape = to_arrow(TREE, docs.sparkSession)

    def learn(key, t):
        g = grams(t.column("piece").to_pylist(), order)
        made = [np.unique(g & _low(d + 1), return_counts=True) for d in range(order + 1)]
        return pa.table([[key[0].as_py()] * (order + 1), list(range(order + 1)), [packed_keys(k) for k, _ in made], [packed_counts(n) for _, n in made]], schema=shape)

    return drawn.groupBy("lang").applyInArrow(learn, TREE)


def load(rows: list) -> dict[str, Tree]:
    """Trees by language from TREE rows."""
    by: dict[str, dict[int, tuple]] = {}
    for r in rows:
        by.setdefault(r[0], {})[r[1]] = (unpacked_keys(r[2]), unpacked_counts(r[3]))
    return {x: Tree([d[i][0] for i in sorted(d)], [d[i][1] for i in sorted(d)]) for x, d in by.items()}


_MODELS: dict[str, Model] = {}


def predicted(docs: DataFrame, learnt: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score, code_bits) of every row by the trees of `learnt`, which are bounded and broadcast."""
    spark = docs.sparkSession
    schema = "doc_id long, lang_pred string, score double, code_bits double"
    shape = to_arrow(schema, spark)
    told = spark.sparkContext.broadcast([tuple(r) for r in learnt.collect()])
    name = uuid.uuid4().hex
    text = F.lower(F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.when(text.rlike(r"\p{L}"), text).cast("binary").alias("text"))

    def run(batches):
        if told.value and name not in _MODELS:
            _MODELS.clear()
            _MODELS[name] = Model(load(told.value))
        model = _MODELS[name] if told.value else None
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                texts = part.column("text").to_pylist()
                lang, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
                real = [i for i, t in enumerate(texts) if t is not None] if model else []
                if real:
                    cost = model.bits([texts[i] for i in real])
                    best = cost.argmin(1)
                    bits[real] = cost[np.arange(len(real)), best]
                    score[real] = 1 / np.exp2(np.maximum(bits[real][:, None] - cost, -1000)).sum(1)
                    for i, k in zip(real, best.tolist()):
                        lang[i] = model.languages[k]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], schema=shape)

    return rows.mapInArrow(run, schema)


def languages(docs: DataFrame, order: int = 4, sample_bytes: int = 1 << 19, total_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """SCHEMA of every row, learnt from those with an id whose crc32 (as text) mod 4 is not 2."""
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    learnt = written(trees(docs.where(~held(f"`{id_col}`")), order, sample_bytes, total_bytes, text_col, lang_col), "ppm-trees")
    out = predicted(docs, learnt, text_col, id_col)
    return out.select("doc_id", held("doc_id").alias("held_out"), "lang_pred", "score", "code_bits")
