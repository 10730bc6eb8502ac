"""What is read once a text, and not once for each word, block or part of it."""

import pandas as pd
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, evaluate, segment


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_ends_where_the_text_does(spark):
    rows = spark.createDataFrame([(" \t\x0b a b\f\r\n",), ("a  ",), (" \n ",), ("",), (None,)], "t string")
    out = rows.select(T.strip(F.col("t")).alias("t"))
    assert [r.t for r in out.collect()] == ["a b", "a  ", "", "", None]
    assert "regexp" not in _plan(out)


def test_keyword_patterns_are_read_once(spark):
    d = spark.createDataFrame([(1, 'NASA and Nasa. Probe said "deep space". Step 4 of NASA, ESA'), (2, None), (3, "")], "i int, t string")
    out = d.select("i", classify.keywords(F.col("t")).alias("k"))
    assert _plan(out).count("regexp_extract_all(") == len(classify.KEYWORD_KINDS)
    assert [r.k for r in out.orderBy("i").collect()] == [["NASA", "ESA", "Probe", "Step", "Step 4", "deep space"], None, []]


def test_words_of_the_trade_by_first_letter(spark):
    import re

    text = " ".join([*classify.DOMAIN_WORDS, *(w.title() for w in classify.DOMAIN_WORDS), "papers wi fi usb-wi-fi notebook DATA_ file.", *(w[:-1] for w in classify.DOMAIN_WORDS)])
    pattern = next(p for p, *_, how in classify.KEYWORD_KINDS if how == "lower")
    assert re.findall(pattern, text) == re.findall(r"(?i)\b(?:" + "|".join(classify.DOMAIN_WORDS) + r")\b", text)
    assert pattern.count("(?:") == 1 + len({w[0] for w in classify.DOMAIN_WORDS})


def test_a_title_is_put_in_order_and_steps_are_counted_once(spark):
    rows = [("*To do* it ", "1. a"), (" How to", "x"), ("How to", "1. x"), ("any", "1. a\n * 2. b\n\t3. c"), ("why not", "x"), ("An Overview\n", "x"), ("Step", None), (None, "1. a\n2. b\n3. c"), (None, None)]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, text string").select("i", classify.knowledge_type(F.col("title"), F.col("text")).alias("k"))
    assert _plan(out).count("regexp_extract_all(") == 1 and "regexp_replace(" not in _plan(out) and _plan(out).count("lower(") == 1
    assert [r.k for r in out.orderBy("i").collect()] == ["sop_step", "faq", "sop_step", "sop_step", "faq", "manual_section", "sop_step", "sop_step", "general"]


def test_texts_are_told_before_their_parts_are_unfolded(spark):
    d = spark.createDataFrame([(1, "T", "Abstract of a paper on the lambda cell\n\nanother paragraph that is long enough")], "i int, title string, text string")
    above = _plan(segment.smart_split(d, "i", "title")).split("Generate ")[0]
    assert "Abstract" not in above
    above = _plan(segment.pack_paragraphs(d, "i")).split("Generate ")[0]
    assert "size(" not in above


def test_missing_words_shuffle_texts_and_not_words(spark):
    d = spark.createDataFrame([(1, "a big dog and a big cat"), (2, "of"), (3, ""), (4, "x")], "i int, text string")
    o = spark.createDataFrame([(1, "big dog and dog"), (2, None), (3, "new"), (5, "x")], "i int, text string")
    out = evaluate.percent_missing(o, d, "i")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # the words are made above it
    assert sorted((r.i, r.pct_missing) for r in out.collect()) == [(1, 0.571), (2, 1.0), (3, 0.0)]


def test_pieces_go_on_some_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(segment, "_HELD", 50)
    udf = {}
    monkeypatch.setattr(segment.F, "pandas_udf", lambda t: lambda f: udf.setdefault("f", f) and (lambda c: c))
    segment.cut_text(F.lit("x"), 10)
    texts = ["ab cd ef gh ij kl"] * 20 + [None, ""]
    got = list(udf["f"](iter([pd.Series(texts)])))
    assert len(got) > 4 and [p for s in got for p in s] == [["ab cd ef", "gh ij kl"]] * 20 + [[], []]
