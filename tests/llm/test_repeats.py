import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import repeats
from quillspark.llm.suffixes import BlindTrie, sort_suffixes


def brute(rows):
    least = {}
    for i, t in rows:
        d = (t or "").encode()
        if i is not None:
            for p in range(len(d) - 49):
                s = d[p : p + 50]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for p in range(len(d) - 49):
            if i is not None and least[d[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def result(df, **k):
    return sorted((tuple(r) for r in repeats.cut_repeats(df, **k).drop("kept_text").collect()), key=str)


def test_equals_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert result(docs) == want and sum(r[2] for r in want) > 0
    assert result(docs, block_bytes=30_000, hot=2) == want


@pytest.mark.parametrize("hot", [0, 1000])
def test_overlapping_passages(spark, hot):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("ab é", k=n))
    shared = [text(n) for n in (40, 50, 51, 70, 200, 400)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(60)) + rng.choice(shared)[rng.randrange(30) :][: rng.randrange(30, 400)] for _ in range(6)]
        rows.append((rng.randrange(45), "".join(parts)))
    rows += [(100 + k, "aaaa" * 60 + "b" * k) for k in range(8)] + [(90, "ab" * 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, block_bytes=4000, hot=hot) == brute(rows)


def test_odd_rows(odd, empty):
    assert result(empty) == []
    assert result(odd, block_bytes=5000) == brute([(r.doc_id, r.text) for r in odd.collect()])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=20, max_size=20), max_size=40), st.sampled_from([0, 8, 16]))
def test_deep_shallow_order(strings, shallow):
    data = np.frombuffer("".join(strings).encode() + bytes(40), np.uint8)
    order, group = sort_suffixes(data, np.arange(len(strings)) * 20, 20, shallow)
    assert [strings[i] for i in order] == sorted(strings)
    names = [strings[i] for i in order]
    assert all((group[k] == group[k - 1]) == (names[k] == names[k - 1]) for k in range(1, len(names)))


@given(st.lists(st.binary(min_size=6, max_size=6)))
def test_blind_trie(strings):
    t = BlindTrie()
    for i, s in enumerate(strings):
        t.add(s, i)
    assert [strings[i] for g in t.groups() for i in g] == sorted(strings)


def test_levels_of_buckets_change_nothing(spark, docs):
    some = docs.where("doc_id < 80")
    one, many = (sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cut_repeats(some, block_bytes=6000, radix=k).collect()) for k in (20, 2))
    assert one == many and sum(r[1] for r in one) > 0
