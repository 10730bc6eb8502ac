"""Folds over the parts of one very long document."""

import time

from pyspark.sql import functions as F

from quillspark.operators import segment


def _plain(parts, most=None):
    """Paragraphs in blocks, one after the other."""
    table = lambda t: "|" in t and "\n" in t
    out = []
    for p in parts:
        if out and not table(p) and not table(out[-1]) and len(p) <= 200 and (most is None or len(out[-1]) <= most):
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def test_a_hundred_thousand_paragraphs(spark):
    parts = ["long " * 59 + "long" if i % 7 == 0 else f"a | bar {i}" if i % 31 == 0 else f"x | y\nz | {i}" if i % 53 == 0 else f"a short paragraph {i}" for i in range(100_000)]
    df = spark.createDataFrame([(1, "\n\n".join(parts), "T"), (2, None, "T"), (3, "", "T"), (4, "\n\n\n", "T")], "doc_id long, text string, title string")
    began = time.time()
    got = segment.pack_paragraphs(df, "doc_id", most=10**9).orderBy("block").collect()
    assert [r.content for r in got] == _plain(parts) and {r.doc_id for r in got} == {1}
    elements = spark.createDataFrame([(1, "\n\n".join(parts))], "doc_id long, text string").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("seq", "text")).withColumn("type", F.lit("Text"))
    chunks = segment.chunk_basic(elements, "doc_id", "seq", most=400).orderBy("chunk_seq").collect()
    want, now = [], None
    for p in parts:
        p = " ".join(p.split())
        if now is not None and len(now) < 400 and len(now) + 2 + len(p) <= 400:
            now += "\n\n" + p
        else:
            want += [] if now is None else [now]
            now = p
    assert [r.text for r in chunks] == [*want, now]
    assert time.time() - began < 90
