import math
import zlib
from collections import Counter

import pytest

from quillspark.llm import lm


def brute(rows, order, mu):
    """The model by its recursive definition."""
    docs = [(i, [b""] + (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    c = Counter()
    for (i, d), h in zip(docs, held):
        if not h:
            for n in range(1, order + 1):
                for t in range(max(1, n - 1), len(d)):
                    c[tuple(d[t - n + 1 : t + 1])] += 1
    N = sum(v for k, v in c.items() if len(k) == 1)
    V = sum(1 for k in c if len(k) == 1)

    def p(w, h):
        if not h:
            return (c[w,] + 0.1) / (N + 0.1 * (V + 1))
        return (c[(*h, w)] + mu * p(w, h[1:])) / (c[h] + mu)

    for (i, d), h in zip(docs, held):
        yield i, h, len(d) - 1, sum(c[w,] > 0 for w in d[1:]), N, sum(math.log10(p(w, ())) for w in d[1:]), sum(math.log10(p(d[t], tuple(d[max(0, t - order + 1) : t]))) for t in range(1, len(d)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_the_recursive_definition(spark, docs, order):
    rows = docs.where("doc_id < 40")
    want = sorted(brute([(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()], order, 5.0))
    got = sorted(tuple(r) for r in lm.model_scores(rows, order, 5.0, block_bytes=20_000).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_of_a_history_sum_to_one(spark):
    rows = [(i, "a b a c") for i in range(1, 30)]
    words = ["a", "b", "c", ""]  # "" is the end
    df = spark.createDataFrame(rows + [(100 + k, f"a {w}".strip()) for k, w in enumerate(words[:3])], "doc_id long, text string")
    c = {r[0]: r for r in brute(df.collect(), 2, 5.0)}
    got = {r.doc_id: r.score for r in lm.model_scores(df, 2, 5.0).collect()}
    assert all(got[i] == pytest.approx(c[i][6]) for i in got)


def test_structure_helps_on_held_out_texts(spark):
    cycle = ["one", "two", "three", "four", "five", "six"]
    rows = [(i, " ".join(cycle[(i + k) % 6] for k in range(40))) for i in range(300)]
    out = [r for r in lm.model_scores(spark.createDataFrame(rows, "doc_id long, text string"), 2, 5.0).collect() if r.held_out]
    assert out and all(r.score > r.base_score + 10 for r in out)


def test_odd_rows(odd, empty):
    assert lm.model_scores(empty).count() == 0
    want = sorted(map(str, ((r[0], r[1], r[2], r[3], r[4], round(r[5], 4), round(r[6], 4)) for r in brute([(r.doc_id, r.text) for r in odd.collect()], 2, 400.0))))
    got = sorted(map(str, ((*r[:5], round(r[5], 4), round(r[6], 4)) for r in lm.model_scores(odd).collect())))
    assert got == want


def test_counts_beyond_32_bits_stay_whole():
    import numpy as np

    from quillspark.llm.common import packed_counts, unpacked_counts

    counts = np.array([0, 1, 2**32 - 1, 2**32, 3 * 10**12, 2**62], np.int64)
    assert unpacked_counts(packed_counts(counts)).tolist() == counts.tolist()


def test_levels_of_buckets_change_nothing(spark, docs):
    """Many blocks and buckets in levels of two bits give what one level gives."""
    from quillspark.llm import lm

    some = docs.where("doc_id < 60")
    one, many = (sorted(tuple(r) for r in lm.model_scores(some, order=3, block_bytes=4000, radix=k).collect()) for k in (20, 2))
    assert [r[:5] for r in one] == [r[:5] for r in many]
    assert all(abs(a[6] - b[6]) < 1e-6 for a, b in zip(one, many))
