"""Weighted distances in bands and longest shared runs against plain versions."""

import random

import numpy as np
import pytest

from quillspark.operators import evaluate


def plain(x, y, ins, dele, sub):
    row = [j * ins for j in range(len(y) + 1)]
    for i, c in enumerate(x, 1):
        new = [i * dele]
        for j, d in enumerate(y, 1):
            new.append(min(row[j] + dele, new[-1] + ins, row[j - 1] + (0 if c == d else sub)))
        row = new
    return row[-1]


@pytest.mark.parametrize("weights", [(2, 1, 1), (1, 1, 1), (1, 3, 5), (4, 1, 2)])
def test_bands_cost_what_the_whole_table_costs(weights):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    a = ["", "", "x", "abc", "a" * 90, "b" * 120] + [word(rng.randint(0, 120)) for _ in range(60)]
    b = ["", "abc", "", "abc", "b" * 95, "b" * 3]
    for x in a[len(b) :]:  # edited, shifted far, or another text altogether
        kind = rng.random()
        b.append(word(30) + x[:-20] if kind < 0.3 else "".join(c for c in x if rng.random() > 0.1) if kind < 0.7 else word(rng.randint(0, 120)))
    got = evaluate.weighted_distances(a, b, *weights)
    assert got.tolist() == [plain(x, y, *weights) for x, y in zip(a, b)]


def test_long_pairs_take_narrow_bands():
    rng = random.Random(1)
    x = "".join(rng.choice("abcdefgh") for _ in range(30_000))
    y = x[:10_000] + "zz" + x[10_000:20_000] + x[20_005:]
    assert evaluate.weighted_distances([x], [y], 2, 1, 1).tolist() == [2 * 2 + 5]


def plain_shared(first, second):
    """The survey's words: from the largest n down."""
    if not len(first) < len(second):
        first, second = second, first
    grams = lambda s, n: [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]
    for n in range(len(first) - 1, 0, -1):
        own = grams(first, n)
        common = set(own) & set(grams(second, n))
        if common:
            return n, round(100 * len(common) / len(own), 2)
    return 0, 0.0


def test_longest_shared_runs(spark):
    rng = random.Random(3)
    some = lambda n: [rng.choice("a b c d e f".split()) for _ in range(n)]
    pairs = [([], []), (["a"], ["a"]), (["a", "b"], ["a", "b"]), (["a"], some(9))]
    for _ in range(80):
        x = some(rng.randint(0, 40))
        k = rng.randint(0, max(0, len(x) - 1))
        pairs.append((x, some(rng.randint(0, 10)) + x[k : k + rng.randint(0, 30)] + some(rng.randint(0, 5))))
    rows = [(i, " ".join(x), " ".join(y)) for i, (x, y) in enumerate(pairs)] + [(1000, None, "a b")]
    got = {r.id: (r.shared_n, r.shared_pct) for r in evaluate.largest_shared_n(spark.createDataFrame(rows, "id long, a string, b string"), "a", "b").collect()}
    assert got == {i: plain_shared(x, y) for i, (x, y) in enumerate(pairs)} | {1000: (0, 0.0)}
    long = [str(i % 5000) for i in range(40_000)]
    assert evaluate._longest_shared(long, ["x"] + long[:30_000] + ["y"])[0] == 30_000


def test_overlaps_by_share(spark):
    boxes = [(1, 0, 0.0, 0.0, 10.0, 10.0, "one two three four"), (1, 1, 5.0, 5.0, 40.0, 40.0, "zero two three five six"), (1, 2, 6.0, 4.0, 50.0, 12.0, "nothing alike"), (1, 3, 100.0, 0.0, 101.0, 1.0, "one")]
    df = spark.createDataFrame([("d", *b) for b in boxes], "doc string, page int, ix int, x1 double, y1 double, x2 double, y2 double, text string")
    got = {(r.a, r.b): (r.case, r.shared_n, r.shared_pct) for r in evaluate.box_overlaps(df, slack=0.0, shares=True).collect()}
    assert got[0, 1] == ("shared words", 2, 33.33) and got[0, 2] == ("none", 0, 0.0) and set(got) == {(0, 1), (0, 2), (1, 2)}
    assert np.all([len(r) == 6 for r in evaluate.box_overlaps(df, slack=0.0).collect()])
