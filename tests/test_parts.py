"""Pieces by a user's counter, formulas, formats, fallbacks and report names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import language, segment
from quillspark.sources import files


def _words(t):
    return len(t.split())


def test_pieces_by_a_counter_fit_and_lose_nothing(spark):
    rng = random.Random(2)
    count = lambda t: sum(1 + len(w) // 4 for w in t.split())  # noqa: E731  longer words count for more
    for _ in range(60):
        t = "".join(rng.choice(["word ", "a", "longerword ", "\n", "x " * 3, "y" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 40)))
        for most in (3, 12):
            pieces = segment.cut_measured(t, most, count)
            assert all(count(p) <= most for p in pieces) or most == 3
            assert re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", t)
    assert segment.cut_measured("one two\nthree four five", 4, _words) == ["one two", "three four five"]
    assert segment.cut_measured("a b c d e f", 3, _words, overlap=1) == ["a b c", "c d e", "e f"]


def test_chunks_by_tokens_cut_what_is_too_long(spark):
    e = spark.createDataFrame([(1, 0, "one two three four five six seven"), (1, 1, "eight"), (1, 2, "nine ten")], "doc long, seq long, text string").withColumn("type", F.lit("Text"))
    got = [r.text for r in segment.chunk_basic(e, "doc", "seq", most=3, size=segment.token_size, measure=_words).orderBy("chunk_seq").collect()]
    assert got == ["one two three", "four five six", "seven", "eight\n\nnine ten"]
    own = [r.text for r in segment.chunk_basic(e, "doc", "seq", most=3, size=segment.token_size, cut=lambda t, n: [t[:3], t[3:].strip()]).orderBy("chunk_seq").collect()]
    assert own == ["one", "two three four five six seven", "eight\n\nnine ten"]


@pytest.mark.parametrize(
    "text, score, shown",
    [
        ("x^2 + y_1 = 4", 3, "$$\nx^2 + y_1 = 4\n$$"), ("a ≤ b", 2, "$$\na \\leq{} b\n$$"), ("plain words", 0, "plain words"), ("\\frac{a}{b}", 3, "$$\n\\frac{a}{b}\n$$"), ("costs $5 × 2", 2, "costs $5 × 2"), ("f(x) = 2", 3, "$$\nf(x) = 2\n$$"),
        ("∑∑∑∑", 6, "$$\n∑∑∑∑\n$$"), ("the mean was calculated using the following words, which are long enough to be prose x_1^", 2, "the mean was calculated using the following words, which are long enough to be prose x_1^"), ("  ", 0, ""),
    ],
)
def test_formulas(spark, text, score, shown):
    row = spark.createDataFrame([(text,)], "t string").select(T.formula_score(F.col("t")).alias("s"), T.formula_markdown(F.col("t")).alias("m"), T.formula_markdown(F.col("t"), "plain").alias("p"), T.formula_markdown(F.col("t"), "display", names=False).alias("d")).first()
    assert (row.s, row.m, row.p) == (score, shown, text.strip()) and row.d == (text.strip() if "$" in text or not text.strip() else f"$$\n{text.strip()}\n$$")


def test_format_of_a_text_by_its_head(spark):
    heads = {'{"a": 1}': "json", "[1]": "json", "<!DOCTYPE html><p>": "html", "<?xml version='1.0'?>": "xml", "From: a@b\nSubject: c": "eml", "a,b\n1,2": "csv", "plain text": "txt"}
    rows = spark.createDataFrame(list(heads.items()), "h string, want string")
    assert all(r.got == r.want for r in rows.select("want", files.text_format(F.lit("txt"), F.col("h")).alias("got")).collect())


def test_files_that_are_no_text_are_told(spark):
    rows = spark.createDataFrame([("a.txt", 2, bytearray(b"ok")), ("b.txt", 2, bytearray(b"\xff\xfe"))], "path string, length long, content binary")
    good, bad = files.read_text(rows)
    assert [r.text for r in good.collect()] == ["ok"] and [tuple(r) for r in bad.collect()] == [("b.txt", 2, "not UTF-8")]


def test_language_fallback_is_pluggable(spark):
    rows = spark.createDataFrame([("hi there", "fr"), ("un texte bien plus long que cela", "fr"), ("   ", "de"), ("été", None), (None, "de")], "t string, d string")
    own = lambda t: F.when(F.contains(t, F.lit("hi")), "xx").when(t.rlike("[é]"), "yy")
    got = [tuple(r) for r in rows.select(language.short_ascii(F.col("t"), F.col("d")), language.short_ascii(F.col("t"), F.col("d"), own)).collect()]
    assert got == [("en", "xx"), ("fr", "fr"), (None, None), ("en", "yy"), (None, None)]


def test_reports_get_a_name_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([("f", "c", 1.0)], "filename string, connector string, score double")
    path = str(tmp_path / "report")
    assert [files.write_metric_report(df, path, "unique").rsplit("/", 1)[1] for _ in range(3)] == ["report", "report_1", "report_2"]
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{path}_2").count() == 1
