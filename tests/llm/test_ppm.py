import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import ppm, queries

K = 3


def plain_tree(texts, order):
    """context -> counts of the bytes after it, for every context of up to `order` bytes; texts start after 0xff bytes."""
    tree = defaultdict(Counter)
    for t in texts:
        t = b"\xff" * order + t
        for i in range(order, len(t)):
            for d in range(order + 1):
                tree[t[i - d : i]][t[i]] += 1
    return tree


def plain_chance(tree, context, byte, order):
    """Chance of a byte after a context, escape by escape, with exclusion."""
    p, gone = 1.0, set()
    for d in range(order, -1, -1):
        c = tree.get(context[len(context) - d :] if d else b"")
        if c is None:
            continue
        left = {s: n for s, n in c.items() if s not in gone}
        total = sum(left.values()) + len(left)
        if byte in left:
            return p * left[byte] / total
        if left:
            p *= len(left) / total
        gone |= set(c)
    return p / (256 - len(gone))


def plain_bits(tree, text, order):
    t = b"\xff" * order + text
    return sum(-math.log2(plain_chance(tree, t[i - order : i], t[i], order)) for i in range(order, len(t)))


def tree_of(texts, order):
    g = ppm.grams([b"\xff" * order + t for t in texts], order)
    made = [np.unique(g & ppm._low(d + 1), return_counts=True) for d in range(order + 1)]
    return ppm.Tree([k for k, _ in made], [n for _, n in made])


def test_code_lengths_equal_the_definition():
    learnt = [b"abracadabra", b"the cat sat", "é漢".encode(), b"abab"]
    plain, tree = plain_tree(learnt, K), tree_of(learnt, K)
    for t in [b"abracadabra", b"a", b"zzz", b"the dog", "漢字 é".encode(), bytes(range(0, 255))]:
        m = ppm.Model({"x": tree})
        assert m.bits([t])[0, 0] == pytest.approx(plain_bits(plain, t, K), rel=1e-12)


def test_chances_of_all_bytes_sum_to_one():
    tree = tree_of([b"abracadabra alakazam", b"xyz" * 9], K)
    for context in [b"abr", b"bra", b"qqa", b"qqq", b"\xff\xff\xff", b"xyz"]:
        g = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert np.exp2(-tree.bits(g)).sum() == pytest.approx(1)


def test_table_of_known_grams_changes_nothing(monkeypatch):
    trees = {"x": tree_of([b"some text of one kind", b"more of it"], K), "y": tree_of([b"ein anderer text", b"noch einer"], K)}
    texts = [b"some text", b"ein text", b"", b"!!", b"more " * 50]
    one = ppm.Model(trees).bits(texts)
    small = ppm.Model(trees).bits(texts, block=7)
    monkeypatch.setattr(ppm, "KNOWN", 0)
    assert np.allclose(one, small) and np.allclose(one, ppm.Model(trees).bits(texts))


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 4 == 2


def brute(rows, order):
    """The whole operator on tables that the sample takes whole: pieces are of single texts, equal texts count once."""
    by = defaultdict(set)
    for i, t, lang in rows:
        if not held(i) and lang is not None and t:
            by[lang].add(t.lower().encode())
    trees = {x: plain_tree(ts, order) for x, ts in by.items()}
    for i, t, _ in rows:
        if t is None or not any(c.isalpha() for c in t) or not trees:
            yield i, held(i), "und", 0.0
            continue
        bits = {x: plain_bits(tree, t.lower().encode(), order) for x, tree in trees.items()}
        best = min(sorted(bits, key=lambda x: x.encode()), key=bits.get)
        yield i, held(i), best, 1 / sum(2.0 ** max(-1000, bits[best] - b) for b in bits.values())


def same(got, want):
    got, want = (sorted(x, key=lambda r: str(r[:3])) for x in (got, want))
    return [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_operator_equals_the_definition(spark, docs):
    rows = [(r.doc_id, r.text[:500], r.lang) for r in docs.limit(60).collect()] + [(1000, None, "en"), (1001, "12 34!", "en"), (1002, "", "de"), (1003, "É", None), (None, "und noch ein text", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r)[:4] for r in ppm.languages(df, order=2).collect()]
    assert same(got, brute(rows, 2))


def test_columns_do_not_leak(spark, docs):
    """What a held-out row says about itself changes no prediction."""
    a = ppm.languages(docs).select("doc_id", "lang_pred", "score")
    from pyspark.sql import functions as F

    h = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    b = ppm.languages(docs.withColumn("lang", F.when(h, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))).select("doc_id", "lang_pred", "score")
    assert sorted(a.collect()) == sorted(b.collect())


def test_long_texts_are_sampled_in_pieces(spark):
    """A language whose only text is longer than the sample is learnt from pieces of it, the same ones each time."""
    rows = [(1, "alpha beta gamma delta " * 20000 + "".join(chr(97 + i * i % 26) for i in range(60000)), "aa"), (4, "uno dos tres cuatro " * 10, "bb"), (5, "uno tres", None), (6, "gamma alpha", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = ppm.trees(df, sample_bytes=1 << 16).where("lang = 'aa' and depth = 0").collect()
    total = int(ppm.unpacked_counts(learnt[0].counts).sum())
    assert 0 < total <= 1 << 18
    got = {r.doc_id: r.lang_pred for r in ppm.predicted(df, ppm.trees(df, sample_bytes=1 << 16)).collect()}
    assert got[5] == "bb" and got[6] == "aa"


def test_odd_rows(spark, odd, empty):
    assert ppm.languages(empty).count() == 0
    rows = [(r.doc_id, r.text, r.lang) for r in odd.where("length(text) < 1000 or text is null").collect()]
    got = [tuple(r)[:4] for r in ppm.languages(odd.where("length(text) < 1000 or text is null"), order=2).collect()]
    assert same(got, brute(rows, 2)) and ppm.languages(odd).count() == odd.count()
    assert {r.lang_pred for r in ppm.languages(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op12_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in got)
    assert len(got) > 150 and right / len(got) > 0.97
