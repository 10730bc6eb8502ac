"""Two tokenisers side by side: which of their tokens cover the same bytes, and how often an id of one stands over an id of the other.

Both tokenisers cut the same bytes (a space and the text). Where both cut, a group ends; tokens whose byte ranges overlap are
linked. Between two neighbouring cuts, of whichever tokeniser, exactly one token of each lies, so a text's links are the stretches
between its cuts, found with running counts of cuts and without a loop over tokens.

Equal texts are brought together by a shuffle of the full text (copies are counted before it), and each different text is tokenised and
aligned once. Blocks of texts keep the id pairs of each text as places in the block's list of different pairs, and send that list, its counts
weighted by the texts' multiplicities, to buckets by pair (exchange.py). A bucket has all pairs of its B ids; it adds up, marks the
pairs that no other of the same B id exceeds, and answers each block, which then has the measures of its texts. Measures go to the
documents by the text's digest: those of texts with many copies by a broadcast of bounded length, all others by a shuffle.

Defined results. Null and empty texts, and those whose bytes the tokens of A or B don't spell (a text with U+2581), have no tokens: all
measures are 0 and groups_sha256 is ''. Special tokens' strings in a text are plain text. Rows that repeat an id or a text are counted each.
An empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, n_blocks, to_arrow, unpacked_counts, written
from .exchange import add_up, sent_rows
from .tokens import encoder

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = "unit long, n int, bucket long, keys binary, counts binary, digests binary, measures binary, hashes binary, sizes binary, places binary, times binary, others binary"
RESULT = "digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Bits of an A id in a pair, and of a B id before it.
A_BITS, B_BITS = 16, 15
#: Most texts whose measures are broadcast (some 200 bytes each).
MOST = 100_000


class Vocabularies:
    """Both tokenisers, the bytes of their tokens, and the decimal ids with the separator that may follow."""

    def __init__(self, a_json: str | None = None, a_ranks: str | None = None, b_model: str | None = None):
        import sentencepiece

        self.a = encoder(a_json, a_ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model or public_tokenizers.path("piece_bpe_32k.model"))
        n_a, n_b = self.a._bpe.n_vocab, self.b.vocab_size()
        self.a_bytes = [self.a._bpe.decode_single_token_bytes(i) for i in range(n_a)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(n_b) for p in (self.b.id_to_piece(i),)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        #: id and what follows it: a token of A within its group, its last; of B within its group, its last
        self.written = [b"%d%c" % (i, end) for n, ends in ((n_a, b",|"), (n_b, b",;")) for end in ends for i in range(n)]
        self.at = (0, n_a, 2 * n_a, 2 * n_a + n_b)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B, or None if they don't spell a space and the text."""
        want = (" " + text).encode()
        a, b = self.a.ids(" " + text, special=False), self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != want or b"".join([self.b_bytes[i] for i in b]) != want:
            return None
        return np.frombuffer(a, np.uint16).astype(np.int64), np.array(b, np.int64)


_VOCABULARIES: dict[tuple, Vocabularies] = {}


def vocabularies(*paths: str | None) -> Vocabularies:
    """One pair of tokenisers a Python worker and choice of files."""
    if paths not in _VOCABULARIES:
        _VOCABULARIES[paths] = Vocabularies(*paths)
    return _VOCABULARIES[paths]


def _mixed(b: np.ndarray) -> np.ndarray:
    """B ids in another order, so that the first bits of a pair spread neighbouring ids, which are often of like frequency."""
    return (b * 20011) & ((1 << B_BITS) - 1)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(data) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Aligned:
    """Groups and links of the texts of a block, given the ids that both tokenisers made of each."""

    def __init__(self, made: list[tuple[np.ndarray, np.ndarray]], v: Vocabularies):
        a, b = (np.concatenate([m[k] for m in made]) for k in (0, 1))
        sizes = [np.array([len(m[k]) for m in made], np.int64) for k in (0, 1)]
        text_of_a = np.repeat(np.arange(len(made)), sizes[0])
        cuts = [np.cumsum(v.a_len[a]) - 1, np.cumsum(v.b_len[b]) - 1]  # the last byte of each token
        is_a, is_b = (np.zeros(cuts[0][-1] + 1, bool) for _ in range(2))
        is_a[cuts[0]] = True
        is_b[cuts[1]] = True
        both = is_a & is_b
        upto = [np.cumsum(x, dtype=np.int32) for x in (is_a, is_b, both)]
        ends = np.flatnonzero(both)
        # links: a stretch between cuts lies in the tokens that the cuts before it have counted
        cut = np.flatnonzero(is_a | is_b)
        link_a, link_b = upto[0][cut] - is_a[cut], upto[1][cut] - is_b[cut]
        self.pairs = (_mixed(b[link_b]) << A_BITS) | a[link_a]
        self.text = text_of_a[link_a]
        count = lambda at: np.bincount(text_of_a[at], minlength=len(made))
        self.measures = np.stack([*sizes, count(upto[0][ends] - 1), count(link_a)], 1)
        # the ids in the order they are written: groups one after the other, A before B
        group_a, group_b = (upto[2][c] - both[c] for c in cuts)
        b_before = np.concatenate([[0], upto[1][ends]])[group_a]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before] = a + np.where(both[cuts[0]], v.at[1], v.at[0])
        order[np.arange(len(b)) + upto[0][ends][group_b]] = b + np.where(both[cuts[1]], v.at[3], v.at[2])
        to = np.cumsum(sizes[0] + sizes[1]).tolist()
        self.hashes = [sha256(b"".join([v.written[c] for c in order[x:y].tolist()])[:-1]).digest() for x, y in zip([0, *to], to)]


def blocks(texts: DataFrame, bits: int, block_bytes: int, paths: tuple = ()) -> DataFrame:
    """BLOCKS rows of texts (digest, text, copies), all different: with n = 0 a block's texts, with n = 1 what it sends to a bucket."""
    shape = to_arrow(BLOCKS, texts.sparkSession)
    most = 1 << 16

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(shape)], schema=shape)

    def rows(unit: int, v: Vocabularies, batch: list[tuple]) -> pa.RecordBatch:
        made = [(d, c, v.tokens(t)) for d, t, c in batch]
        good = [m for m in made if m[2] is not None]
        others = b"".join(d + c.to_bytes(8, "little") for d, c, m in made if m is None)
        if not good:
            return table([(unit, 0, *[None] * 9, others)])
        al = Aligned([m for _, _, m in good], v)
        copies = np.array([c for _, c, _ in good], np.int64)
        entry = np.sort((al.pairs.astype(np.uint64) << np.uint64(16)) | al.text.astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        times = np.diff(np.append(first, len(entry)))
        entry = entry[first]
        text, pair = (entry & np.uint64(most - 1)).astype(np.uint16), entry >> np.uint64(16)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        place, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        totals = np.add.reduceat(times * copies[text], starts)
        by_text = np.argsort(text, kind="stable")
        sizes = np.bincount(text, minlength=len(good))
        place = place[by_text]
        steps = np.diff(place, prepend=0)
        at = np.cumsum(sizes) - sizes
        steps[at] = place[at]
        own = {"digests": b"".join(d for d, _, _ in good), "measures": np.column_stack([copies, al.measures]).astype("<i8").tobytes(), "hashes": b"".join(al.hashes), "sizes": _packed(sizes), "places": _packed(steps), "times": _packed(times[by_text] - 1)}
        out = [(unit, 0, None, None, None, *own.values(), others)]
        out += [(unit, n, k, keys, counts, *[None] * 7) for n, k, _, keys, counts in sent_rows(1, unit, pair[starts] << np.uint64(64 - A_BITS - B_BITS), totals, bits, 8)]
        return table(out)

    def run(batches):
        from pyspark import TaskContext

        v, task, made, batch, size = vocabularies(*paths), TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for a in range(0, b.num_rows, 500):
                for r in zip(*(c.to_pylist() for c in b.slice(a, 500).columns)):
                    batch.append(r)
                    size += len(r[1])
                    if size >= block_bytes or len(batch) == most:
                        yield rows((made << 20) | task, v, batch)
                        made, batch, size = made + 1, [], 0
        if batch:
            yield rows((made << 20) | task, v, batch)

    return texts.select("digest", "text", "copies").mapInArrow(run, BLOCKS)


def _with_best(keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Twice the totals, and one more where no pair of the same B id has a larger one."""
    of = keys >> np.uint64(64 - B_BITS)
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    most = np.repeat(np.maximum.reduceat(totals, first), np.diff(np.append(first, len(of)))) if len(of) else totals
    return 2 * totals + (totals == most)


def text_measures(docs: DataFrame, text_col: str = "text", block_bytes: int = 3 << 20, paths: tuple = ()) -> DataFrame:
    """RESULT row of each different text that isn't empty."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).where("octet_length(text) > 0")
    bits = min(B_BITS, bits_for(n_blocks(rows, 1 << 20) << 18))
    texts = rows.groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text", "copies")
    made = written(blocks(texts, bits, block_bytes, paths), "align-blocks")
    sent = made.where("n = 1").select("n", "bucket", "unit", "keys", "counts")
    answers, _ = add_up(sent, bits, "align", tell=_with_best)
    shape = to_arrow(RESULT, spark)

    def measure(key, t, a):
        r = t.to_pylist()[0]
        part = lambda x, n: [x[i : i + n] for i in range(0, len(x), n)]
        others = part(r["others"], 40)
        cols = [[o[:32] for o in others], [int.from_bytes(o[32:], "little") for o in others], *[[0] * len(others)] * 6, [""] * len(others)]
        if r["digests"]:
            told = np.concatenate([unpacked_counts(x.as_buffer()) for x in a.sort_by("bucket").column("totals")])
            sizes, steps, times = _unpacked(r["sizes"]), _unpacked(r["places"]), _unpacked(r["times"]) + 1
            at = np.cumsum(sizes) - sizes
            run = np.cumsum(steps)
            value = told[run - np.repeat(run[at] - steps[at], sizes)]
            best, total = (np.add.reduceat(times * x, at) for x in (value & 1, value >> 1))
            own = [part(r["digests"], 32), *np.frombuffer(r["measures"], "<i8").reshape(-1, 1 + len(MEASURES)).T.tolist(), best.tolist(), total.tolist(), [h.hex() for h in part(r["hashes"], 32)]]
            cols = [x + y for x, y in zip(cols, own)]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, shape)], schema=shape)

    own = made.where("n = 0").select("unit", "digests", "measures", "hashes", "sizes", "places", "times", "others")
    return written(own.groupBy("unit").cogroup(answers.select(F.col("unit").alias("of"), "bucket", "totals").groupBy("of")).applyInArrow(measure, RESULT), "align-measures")


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 3 << 20, hot: int = 1000, paths: tuple = ()) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    hot: copies from which a text may be looked up by broadcast; at most MOST texts are, whatever the table: a text has to have
    more than a MOST-th part of all rows too."""
    measures = text_measures(docs, text_col, block_bytes, paths)
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.when(F.octet_length(text) > 0, F.unhex(F.sha2(text, 256))).alias("digest"))
    rows = written(rows, "align-rows")
    many = max(hot, (measures.agg(F.sum("copies")).first()[0] or 0) // MOST)
    names = [*MEASURES, "n_best", "count_sum"]
    told = measures.select("digest", *names, "groups_sha256", "copies")
    often, seldom = told.where(F.col("copies") > many).drop("copies"), told.where(F.col("copies") <= many).drop("copies")
    by_broadcast = rows.join(F.broadcast(often), "digest")
    by_shuffle = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti").where("digest is not null").join(seldom, "digest")
    none = rows.where("digest is null")  # no tokens, no part in a shuffle
    out = by_broadcast.unionByName(by_shuffle).unionByName(none, allowMissingColumns=True)
    return out.select("doc_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
