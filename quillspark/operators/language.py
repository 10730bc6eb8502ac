"""Language of texts by character n-gram profiles that are learnt from labelled texts."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import written

#: Grams times languages of profiles that a task holds as a table (8 bytes each).
_CELLS = 1 << 22


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def _grams(letters: str, n: int) -> Iterator[str]:
    """Overlapping grams, one from each place."""
    out = iter(letters)
    for i in range(1, n):
        out = map(add, out, letters[i:])
    return out


def profiles(df: DataFrame, text: str = "text", lang: str = "lang", n: int = 2) -> DataFrame:
    """(gram, scores: map of language to (score, unseen)) of labelled texts: log-probabilities of the gram and of one that the language
    has not shown, add-one smoothed.

    Grams are counted a batch of texts at a time and then over the corpus. An n of 2 keeps the table at a few thousand rows whatever the
    corpus: there are only so many pairs of letters."""
    schema = StructType().add("lang", "string").add("gram", "string").add("c", "long")
    shape = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            of: dict[str, Counter] = defaultdict(Counter)
            for name, t in zip(b.column(0).to_pylist(), b.column(1)):
                of[name].update(_grams(t.as_py(), n))
            rows = [(name, g, c) for name, found in of.items() for g, c in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), shape)] if rows else [pa.array([], f.type) for f in shape], schema=shape)

    texts = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), _letters(F.col(text)).alias("text"))
    counts = texts.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    total = counts.groupBy("lang").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
    size = F.col("total") + F.col("kinds")
    rows = counts.join(total, "lang").select("lang", "gram", F.struct(F.log((F.col("c") + 1) / size).alias("score"), F.log(1 / size).alias("unseen")).alias("x"))
    return rows.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "x"))).alias("scores"))


def _scored(df: DataFrame, learnt: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """(id, lang, s, u) of texts by profiles that fit a task: what a language's grams score over unseen ones, and its unseen score, for
    each language that has a gram of the text; lang "" has the number of known grams."""
    rows = learnt.collect()
    names = sorted({k for r in rows for k in r.scores})
    at, col = {r.gram: i for i, r in enumerate(rows)}, {k: i for i, k in enumerate(names)}
    gain, shown, unseen = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)), bool), np.zeros(len(names) + 1)
    for i, r in enumerate(rows):
        for k, x in r.scores.items():
            gain[i, col[k]], shown[i, col[k]], unseen[col[k]] = x.score - x.unseen, True, x.unseen
    names.append("")
    model = df.sparkSession.sparkContext.broadcast((at, gain, shown, unseen))
    texts = df.where(F.col(text).isNotNull()).select(id_col, _letters(F.col(text)).alias("_text"))
    schema = StructType([texts.schema[id_col]]).add("lang", "string").add("s", "double").add("u", "double")
    shape = to_arrow_schema(schema)

    def run(batches):
        at, gain, shown, unseen = model.value
        for b in batches:
            of, lang, s = [], [], []
            for i, t in enumerate(b.column(1)):
                found = [(at[g], c) for g, c in Counter(_grams(t.as_py(), n)).items() if g in at]
                if found:
                    places, c = np.array(found).T
                    has = np.append(np.flatnonzero(shown[places].any(axis=0)), len(names) - 1)
                    of.append(np.full(len(has), i))
                    lang.append(has)
                    s.append(np.append(c @ gain[places], c.sum())[has])
            if of:
                k = np.concatenate(lang)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(of))), pa.array(names).take(pa.array(k)), pa.array(np.concatenate(s)), pa.array(unseen[k])], schema=shape)

    return texts.mapInArrow(run, schema)


def detect(df: DataFrame, learnt: DataFrame, id_col: str, text: str = "text", n: int = 2, most_rows: int = 200_000) -> DataFrame:
    """(id, detected): the likeliest language of all that have profiles; ties go to the later name; null for texts without a known
    gram. `eng` for ASCII texts of under five words is left to the caller (see short_ascii()).

    Profiles are made once, as a table. Up to most_rows rows and _CELLS scores they go to the tasks, and a text is scored where it is
    read; larger ones meet the grams of the texts in a join."""
    learnt = written(learnt, "profiles")
    size = learnt.count()
    if size <= most_rows and size * learnt.select(F.explode(F.map_keys("scores"))).distinct().count() <= _CELLS:
        each = _scored(df, learnt, id_col, text, n)
    else:
        grams = df.select(id_col, F.explode(F.regexp_extract_all(_letters(F.col(text)), F.lit(f"(?=(.{{{n}}}))"), F.lit(1))).alias("gram")).groupBy(id_col, "gram").agg(F.count(F.lit(1)).alias("c"))
        # a language gets what its grams score over unseen ones; the unseen score of all grams (those of the entry "") is added in the end
        every = F.array(F.struct(F.lit("").alias("key"), F.struct(F.lit(1.0).alias("score"), F.lit(0.0).alias("unseen")).alias("value")))
        each = grams.join(learnt, "gram").select(id_col, "c", F.explode(F.concat(F.map_entries("scores"), every)).alias("x"))
        each = each.select(id_col, F.col("x.key").alias("lang"), (F.col("c") * (F.col("x.value.score") - F.col("x.value.unseen"))).alias("s"), F.col("x.value.unseen").alias("u"))
    sums = each.groupBy(id_col, "lang").agg(F.sum("s").alias("s"), F.min("u").alias("u"))
    rows = sums.groupBy(id_col).agg(F.max(F.when(F.col("lang") == "", F.col("s"))).alias("n"), F.collect_list(F.when(F.col("lang") != "", F.struct("lang", "s", "u"))).alias("of"))
    best = F.array_max(F.transform("of", lambda x: F.struct((x["s"] + x["u"] * F.col("n")).alias("s"), x["lang"].alias("lang"))))["lang"]
    return df.select(id_col).join(rows.select(id_col, best.alias("detected")), id_col, "left")


def short_ascii(text: Column, detected: Column, fallback: Callable[[Column], Column] = lambda t: F.lit("en"), words: int = 5) -> Column:
    """`fallback` of texts that are ASCII and have under `words` words, and of those without a detected language; null for blank ones,
    else what was detected. The fallback is any column function of the text, a user's own too; what it leaves null stays as detected."""
    blank = F.trim(text) == ""
    short = ~text.rlike(r"[^\x00-\x7F]") & (F.size(F.split(F.trim(text), r"\s+")) < words)
    return F.when(blank | text.isNull(), F.lit(None)).when(short | detected.isNull(), F.coalesce(fallback(text), detected)).otherwise(detected)


def of_elements(found: DataFrame, doc: str, seq: str, lang: str = "detected") -> DataFrame:
    """found with document_lang: the language most of a document's elements have."""
    w = Window.partitionBy(doc)
    n = F.count(F.lit(1)).over(Window.partitionBy(doc, lang))
    return found.withColumn("_n", n).withColumn("document_lang", F.max_by(lang, F.struct("_n", lang)).over(w)).drop("_n")
