"""Table scores against a plain version that compares everything with everything."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest

from quillspark.operators import table_eval

CELL = "doc string, table_ix int, row int, col int, text string"


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y):
            before, row[j + 1] = row[j + 1], before + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def plain(pred, true, cutoff=0.8):
    """pred, true: lists of tables, each a list of (row, col, text) in order."""
    text = lambda t: " ".join(c[2] for c in t)
    truths = [text(t) for t in true]
    sums, used = [0.0] * 5, set()
    for p in pred:
        near = get_close_matches(text(p), truths, cutoff=0.1, n=1)
        if not near:
            continue
        k = truths.index(near[0])
        used.add(k)
        t = true[k]
        words, taken, pairs = [c[2].lower() for c in t], {}, []
        for r, c, x in p:
            m = get_close_matches(x.lower(), words, cutoff=cutoff, n=1)
            if m:
                same = [i for i, w in enumerate(words) if w == m[0]]
                i = same[taken.get(m[0], 0) % len(same)]
                taken[m[0]] = taken.get(m[0], 0) + 1
                pairs.append((r == t[i][0], c == t[i][1]))
        ratio = SequenceMatcher()
        ratio.set_seq2(text(p))
        ratio.set_seq1(truths[k])
        tokens = lambda t, key: " ".join(x for _, _, x in sorted(t, key=key)).split()
        content = []
        for key in (lambda c: (c[0], c[1]), lambda c: (c[1], c[0])):
            x, y = tokens(p, key), tokens(t, key)
            content.append(2 * lcs(x, y) / (len(x) + len(y)) if x and y else float(x == y))
        own = [ratio.ratio(), *[sum(q[i] for q in pairs) / len(pairs) if pairs else 0.0 for i in (0, 1)], *content]
        sums = [a + b for a, b in zip(sums, own)]
    if not true:
        return (0, len(pred), *[0.0] * 8)
    n, hits = len(pred) + len(true) - len(used), len(used)
    return (len(true), len(pred), sums[0] / max(1, len(pred)), hits / len(pred) if pred else 0, hits / len(true), 2 * hits / (len(pred) + len(true)), *[x / n for x in sums[1:]])


def cells(tables, doc):
    return [(doc, i, r, c, x) for i, t in enumerate(tables) for r, c, x in t]


def test_scores_equal_the_plain_version(spark):
    rng, docs = random.Random(5), {}
    word = lambda: rng.choice(["alpha", "beta", "gamma 7", "delta 12", "Total", "", "1,234", "1,235", "n/a", "omega point"])
    for d in range(12):
        true = [[(r, c, word()) for r in range(3) for c in range(2)] for _ in range(rng.randint(0, 2))]
        pred = []
        for t in true + ([[(0, 0, "§§"), (0, 1, "@@")]] if d % 3 == 0 else []):
            if rng.random() < 0.8:
                pred.append([(r, 1 - c if rng.random() < 0.2 else c, x + rng.choice(["", "", "s", "!"])) for r, c, x in t if rng.random() < 0.9] or t)
        pred = [sorted(t) for t in pred]
        if true or pred:
            docs[f"d{d}"] = (pred, true)
    p = spark.createDataFrame([x for d, (a, _) in docs.items() for x in cells(a, d)], CELL)
    t = spark.createDataFrame([x for d, (_, b) in docs.items() for x in cells(b, d)], CELL)
    got = {r.doc: r for r in table_eval.evaluate_tables(p, t, "doc").collect()}
    assert set(got) == set(docs)
    for d, (pred, true) in docs.items():
        assert tuple(got[d])[1:-1] == pytest.approx(plain(pred, true), abs=2e-6), d


def test_survey_cases(spark):
    """A table against itself, one with two cells swapped, none on one side."""
    t = [[(0, 0, "11"), (0, 1, "12"), (1, 0, "21"), (1, 1, "22")]]
    swapped = [[(0, 0, "12"), (0, 1, "11"), (1, 0, "21"), (1, 1, "22")]]
    df = lambda x: spark.createDataFrame(x, CELL)
    got = {r.doc: r for r in table_eval.evaluate_tables(df(cells(t, "same") + cells(swapped, "swapped") + cells(t, "extra")), df(cells(t, "same") + cells(t, "swapped") + cells(t, "missing")), "doc").collect()}
    assert tuple(got["same"])[1:] == (1, 1, *[1.0] * 9)
    assert (got["swapped"].row_index, got["swapped"].col_index) == (1.0, 0.5)
    assert (got["missing"].n_truth, got["missing"].n_predicted, got["missing"].f1) == (1, 0, 0.0) and (got["extra"].n_truth, got["extra"].composite) == (0, 0.0)


def test_closest_on_awkward_texts(spark):
    rng = random.Random(2)
    texts = ["", "a", "ab", "abc", "é漢", "x" * 300, "x" * 299 + "y"] + ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = lambda k: sorted(set(rng.sample(texts, 40)))
    a, b = rows(0), rows(1)
    df = lambda x, n: spark.createDataFrame([("k", i, t) for i, t in enumerate(x)], f"key string, {n} long, text string")
    for cutoff in (0.1, 0.6, 0.8):
        got = {a[r.a]: b[r.b] for r in table_eval.closest(df(a, "a"), df(b, "b"), ["key"], cutoff).collect()}
        want = {x: m[0] for x in a if (m := get_close_matches(x, b, n=1, cutoff=cutoff))}
        assert got == want


def test_few_texts_are_matched_as_many_are(spark, monkeypatch):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    a = [(d, i, rng.choice([word(rng.randint(0, 9)), "ab" * 120, "same"])) for d in range(12) for i in range(6)] + [(None, 1, "same"), (3, 77, None)]
    b = [(d, i, rng.choice([word(rng.randint(0, 9)), "ab" * 120, "same"])) for d in range(12) for i in range(8)] + [(None, 1, "same"), (40, 1, "same")]
    a, b = spark.createDataFrame(a, "doc int, a long, text string"), spark.createDataFrame(b, "doc int, b long, text string")
    rows = lambda: sorted(tuple(r) for r in table_eval.closest(a, b, ["doc"], 0.6).collect())
    signs = []
    monkeypatch.setattr(table_eval, "candidates", lambda *x, f=table_eval.candidates: signs.append(1) or f(*x))
    few = rows()
    assert few and not signs  # no row a character
    monkeypatch.setattr(table_eval, "FEW", 0)
    assert rows() == few and signs
    monkeypatch.setattr(table_eval, "FEW", 40)
    assert rows() == few
