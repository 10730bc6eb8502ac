import math
import random
from collections import Counter
from fractions import Fraction

from quillspark.llm import quality, queries


def brute(text):
    words = [w.encode() for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again)


def test_counts_equal_plain_counting(spark, docs, odd):
    for df in (docs, odd, spark.createDataFrame([(1, "a b c d e f g h x " * 3 + "a b c d e f g h"), (2, "l\nl\n \nl\nm#"), (3, "a b \x1fc")], "doc_id long, text string")):
        texts = {}
        for r in df.collect():
            texts.setdefault(r.doc_id, []).append(brute(r.text))
        got = {}
        for r in quality.stats(df).collect():
            got.setdefault(r.id, []).append((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_exact_binomial_bound():
    def tail(k, n, p):
        a, b = Fraction(str(p)).as_integer_ratio()
        return float(Fraction(sum(math.comb(n, i) * a**i * (b - a) ** (n - i) for i in range(k + 1)), b**n))

    for n in (1, 50, 400, 3000):
        for p in (0.003, 0.02, 0.2):
            for level in (0.05, 0.001):
                k = quality.most_errors(n, p, level)
                assert (k < 0 or tail(k, n, p) <= level) and tail(k + 1, n, p) > level


def _corpus(spark, bad_share=0.2):
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 < bad_share * 10
        words = [f"w{(i * 7 + k * k) % 997}" + ("###" if bad and k % 2 else "") for k in range(30)]
        rows.append((i, " ".join(words), "en" if i % 2 else "fr"))
        labels.append((i, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_bad_documents_go_and_the_risk_is_kept(spark):
    docs, labels = _corpus(spark)
    rows = quality.quality_rules(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(not r.kept for r in good) <= 0.02 * len(good)
    assert sum(r.kept for r in rows if r.quality == 0) < 0.05 * sum(r.quality == 0 for r in rows)
    assert all("symbols" in r.reasons for r in rows if r.quality == 0 and not r.kept)


def test_strata_of_some_hundred_labels_and_a_pool_of_smaller_ones_act(spark):
    docs, labels = _corpus(spark)
    lang = quality.F.expr("case when doc_id % 3 > 0 then 'en' when doc_id < 1500 then 'fr' when doc_id < 2100 then 'de' when doc_id < 2700 then 'es' end")
    docs = docs.withColumn("lang", lang).where("doc_id % 3 > 0 or doc_id < 3300")
    rows = quality.quality_rules(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").collect()
    for s in ("en", "fr", "de", "es", "\0none"):
        own = [r for r in rows if r.stratum == s]
        assert sum(r.kept for r in own if r.quality == 0) < 0.05 * sum(r.quality == 0 for r in own)
    assert sum(not r.kept for r in rows if r.quality == 1) <= 0.02 * sum(r.quality for r in rows)


def test_few_labels_certify_nothing(spark):
    docs, labels = _corpus(spark)
    assert quality.quality_rules(docs, labels.where("doc_id < 200")).where("size(reasons) > 0").count() == 0


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (99, 1), (5, None)], "doc_id long, quality int")
    rows = quality.quality_rules(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows if r.n_words < 20)
    assert quality.quality_rules(empty, labels).count() == 0
    assert quality.quality_rules(odd, labels.where("false")).count() == odd.count()


def test_query(spark):
    assert queries.op1_quality_rules(spark, "/root/testdata/sf0.001").count() == 200


def test_cutoffs_equal_plain_nested_tests(spark):
    """Strata with enough good labels have their own cutoff, the others share one; each by trying scores from the largest down."""
    rng, rows = random.Random(3), []
    for i in range(700):
        lang = "en" if i < 400 else "de" if i < 660 else "fr" if i < 680 else None
        words = [rng.choice(["alpha", "beta", "gamma", "DELTA!", "eps"]) for _ in range(30)] + ["###"] * rng.randrange(12)
        rows.append((i, " ".join(words), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(700)] + [(0, 1), (9999, 1)], "doc_id long, quality int")
    alpha, delta = 0.05, 0.05
    counted = quality.stats(docs).select("*", *[v.alias("f_" + k) for k, v in quality.features().items()]).collect()
    scores = {}
    for r in counted:
        if r.id % 10 != 0 or r.id == 0:
            scores.setdefault(r.stratum or "\0none", []).append(max(-(-1000 * r["f_" + k] // level) for k, level in quality.LEVELS.items()))
    allowed = lambda n: quality.most_errors(n, alpha, delta / (len(scores) + 1))
    small = [s for s, x in scores.items() if allowed(len(x)) < 0]
    units = {s: [v for o in small for v in scores[o]] if s in small else x for s, x in scores.items()}
    want = {}
    for s, x in units.items():
        good = [v for v in set(x) if sum(y > v for y in x) <= allowed(len(x))]
        for k, level in quality.LEVELS.items():
            want[s, k] = (len(x), min(good) * level // 1000 if good else None)
    got = {(r.stratum, r.feature): (r.n_good, r.cutoff) for r in quality.cutoffs(quality.stats(docs), labels, alpha, delta).collect()}
    assert got == want and len(small) == 2 and all(want[s, "symbols"][1] is not None for s in ("en", "de"))
