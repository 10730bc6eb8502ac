"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu), h' being h without its
first word, down to p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). As an automaton: a state for each history seen in training, an arc
for each seen word after it, and a failure arc to the state of h' that weighs mu / (c(h) + mu). A text is read once from
left to right: the state is carried, failure arcs are followed until the word has an arc, log-probabilities add up. All texts
of a block advance together, a token a step.

Counting and scoring share one exchange. Documents are dealt over blocks by a hash of their id; a block sends its different
n-gram keys with their training counts to buckets by key (a frequent n-gram is one entry a block, whatever its count; see exchange.py),
a bucket adds them up and answers each block, and the block then has all counts that its own automaton needs: no task and not the
driver ever holds the whole model. Only N and V go through the driver.

Defined results. A null or empty text is the end token alone. Rows that repeat an id are each trained on and scored. A null id
is held out (there is no remainder to take). With no training document every count is 0. An empty table gives no rows.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bits_for, block_of, id_text, n_blocks, splitmix, to_arrow, unpacked_counts
from .exchange import SENT, add_up, sent_rows, table

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Block:
    """The tokens of a block's texts and, for each order, its different n-grams.

    tok: vocabulary index of each token, each text being END, words, END; place: index within the text."""

    def __init__(self, texts: list[str | None], order: int):
        vocab, tok, lens = {b"": 0}, array("i"), array("i")
        for i, t in enumerate(texts):
            words = (t or "").encode().lower().split()
            texts[i] = None  # the words stand in for it
            tok.append(0)
            tok.extend([vocab.setdefault(w, len(vocab)) for w in words])
            tok.append(0)
            lens.append(len(words) + 2)
        self.tok, self.lens, self.size = np.frombuffer(tok, np.int32) if tok else np.zeros(0, np.int32), np.array(lens, np.int64), len(vocab)
        self.doc = np.repeat(np.arange(len(lens), dtype=np.int32), self.lens)
        self.first = np.cumsum(self.lens) - self.lens
        self.place = (np.arange(len(tok)) - np.repeat(self.first, self.lens)).astype(np.int32)
        word_hash = splitmix(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocab), np.uint64, len(vocab)))
        own = word_hash[self.tok] if len(tok) else np.zeros(0, np.uint64)
        key, self.keys, self.index = own, [], []
        for n in range(1, order + 1):
            if n > 1:
                key = np.concatenate([np.zeros(1, np.uint64), splitmix(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:])])[: len(own)]
            there = self.place >= max(1, n - 1)
            keys, index = np.unique(key[there], return_inverse=True)
            at = np.full(len(own), -1, np.int32)
            at[there] = index
            self.keys.append(keys)
            self.index.append(at)
        start = int(np.searchsorted(self.keys[0], word_hash[0]))  # what stands before a text is END as a history
        self.index[0][self.first] = start

    def counts(self, n: int, trained: np.ndarray) -> np.ndarray:
        """Occurrences of each n-gram in the texts that are trained on."""
        at = self.index[n - 1].copy()
        at[self.place < max(1, n - 1)] = -1
        at = at[(at >= 0) & trained[self.doc]]
        return np.bincount(at, minlength=len(self.keys[n - 1]))


class Automaton:
    """Backoff automaton of the n-grams of one block. State 0 is the empty history."""

    def __init__(self, block: Block, totals: list[np.ndarray], n_tokens: int, n_types: int, mu: float):
        self.order, V = len(totals), block.size
        p1 = (totals[0] + 0.1) / (n_tokens + 0.1 * (n_types + 1))
        at1 = np.zeros(V, np.int64)
        at1[block.tok] = block.index[0]
        self.root = np.log10(p1)[at1]  # weight of each word at the empty history
        base = np.concatenate([[0], np.cumsum([len(t) for t in totals[:-1]])]) + 1
        n_states = int(base[self.order - 1])
        self.backoff, self.fail, self.alive = np.zeros(n_states), np.zeros(n_states, np.int64), np.zeros(n_states, bool)
        self.alive[0] = True
        state_of = lambda m, at: base[m - 1] + block.index[m - 1][at]  # noqa: E731  state of the m-gram that ends at a place
        for m in range(1, self.order):
            c = totals[m - 1].astype(float)
            own = slice(int(base[m - 1]), int(base[m - 1]) + len(c))
            self.backoff[own] = np.where(c > 0, np.log10(mu / (c + mu)), 0.0)
            self.alive[own] = c > 0
            if m > 1:
                at = np.flatnonzero(block.place >= max(1, m - 1))
                self.fail[state_of(m, at)] = state_of(m - 1, at)
        # arcs by (state, word), and where they lead: the longest history of a live state
        keys, weights, leads = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        lower = p1
        for n in range(2, self.order + 1):
            at = np.flatnonzero(block.place >= n - 1)
            _, one = np.unique(block.index[n - 1][at], return_index=True)
            at = at[one]  # a place for each different n-gram, by its index
            c, h = totals[n - 1].astype(float), totals[n - 2][block.index[n - 2][at - 1]].astype(float)
            lower = (c + mu * lower[block.index[n - 2][at]]) / (h + mu)
            seen = c > 0
            keys.append((state_of(n - 1, at - 1) * V + block.tok[at])[seen])
            weights.append(np.log10(lower[seen]))
            leads.append(state_of(min(n, self.order - 1), at)[seen])
        keys, self.weights, self.leads = map(np.concatenate, (keys, weights, leads))
        ordered = np.argsort(keys)
        self.keys, self.weights, self.leads = keys[ordered], self.weights[ordered], self.leads[ordered]
        self.V = V
        self.by_word = np.zeros(V, np.int64)  # where the empty history leads
        if self.order > 1:
            self.by_word[block.tok] = base[0] + block.index[0]
            self.by_word[~self.alive[self.by_word]] = 0
            self.start = int(self.by_word[0])
        else:
            self.start = 0

    def scores(self, block: Block) -> np.ndarray:
        """log10 probability of each text, its end included."""
        by_len = np.argsort(-block.lens, kind="stable")
        first, left = block.first[by_len], block.lens[by_len]
        state = np.full(len(by_len), self.start, np.int64)
        total = np.zeros(len(by_len))
        for t in range(1, int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -t, side="left"))  # texts longer than t
            word = block.tok[first[:live] + t]
            todo, s = np.arange(live), state[:live].copy()
            while len(todo):
                key = s * self.V + word[todo]
                at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
                hit = (self.keys[at] == key) & (s > 0) if len(self.keys) else np.zeros(len(todo), bool)
                total[todo[hit]] += self.weights[at[hit]]
                state[todo[hit]] = self.leads[at[hit]]
                miss = ~hit
                todo, s = todo[miss], s[miss]
                root = s == 0
                total[todo[root]] += self.root[word[todo[root]]]
                state[todo[root]] = self.by_word[word[todo[root]]]
                todo, s = todo[~root], s[~root]
                total[todo] += self.backoff[s]
                s = self.fail[s]
        out = np.zeros(len(by_len))
        out[by_len] = total
        return out


def model_scores(docs: DataFrame, order: int = 2, mu: float = 400.0, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20, radix: int = 8) -> DataFrame:
    """SCORES of every whole text, trained on those whose crc32(id as text) mod 10 is not 0."""
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    blocks = n_blocks(rows, block_bytes)
    bits = bits_for(blocks * block_bytes * (order + 1) // 2)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0, F.lit(True))
    rows = rows.select(block_of(blocks).alias("block"), "id", "text", held.alias("held"))
    sent_shape, out_shape = to_arrow(SENT, spark), to_arrow(SCORES, spark)

    def send(key, t):
        block = Block(t.column("text").to_pylist(), order)
        trained = ~np.array(t.column("held").to_pylist(), bool)
        sets = ((n, block.keys[n - 1], block.counts(n, trained)) for n in range(1, order + 1))
        return table([r for n, keys, counts in sets for r in sent_rows(n, key[0].as_py(), keys, counts, bits, radix)], sent_shape)

    answers, top = add_up(rows.groupBy("block").applyInArrow(send, SENT), bits, "lm", radix)
    told = top.where("n = 1").agg(F.sum("tokens"), F.sum("types")).first()
    n_tokens, n_types = (int(x or 0) for x in told)

    def score(key, t, a):
        block = Block(t.column("text").to_pylist(), order)
        a = a.sort_by([("n", "ascending"), ("bucket", "ascending")])
        of = a.column("n").to_numpy()
        data = a.column("totals")
        totals = [np.concatenate([np.zeros(0, np.int64), *(unpacked_counts(d.as_buffer()) for d, k in zip(data, of) if k == n)]) for n in range(1, order + 1)]
        scores = Automaton(block, totals, n_tokens, n_types, mu).scores(block)
        real = block.place > 0
        c = totals[0][block.index[0][real]]
        base = np.bincount(block.doc[real], np.log10((c + 0.1) / (n_tokens + 0.1 * (n_types + 1))), len(block.lens))
        known = np.bincount(block.doc[real], c > 0, len(block.lens)).astype(np.int64)
        n = len(block.lens)
        return pa.table([t.column("id"), t.column("held"), pa.array(block.lens - 1), pa.array(known), pa.array([n_tokens] * n, pa.int64()), pa.array(base), pa.array(scores)], schema=out_shape)

    return rows.groupBy("block").cogroup(answers.select(F.col("unit").cast("int").alias("block"), "n", "bucket", "totals").groupBy("block")).applyInArrow(score, SCORES)
