"""Quality rules whose cutoffs come with a guarantee (risk-controlled thresholds).

A labelled holdout gives, for each stratum (language) and feature, how many good documents lie above each possible cutoff.
A document's score is the largest of its features, each measured by a fixed level (LEVELS), so one cutoff of the score is a cutoff
of every feature. Cutoffs are tried from the most lenient to the strictest; a cutoff holds if the exact binomial
(Clopper-Pearson) upper bound of its false rejection rate stays at or under the allowed rate. The tests of a stratum are nested
and stop at the first failure (fixed-sequence testing), so they need no correction among themselves; the error probability is
divided by the number of strata and one more: strata with too few good labels for a cutoff of their own are pooled and share
one. Hence, with probability 1 - delta over the holdout, every stratum with its own cutoff, and the pool as a whole, loses at
most `alpha` of its good documents to the cutoffs.

Defined results. Null or empty text: all counts 0, base_failed. A null language is a stratum of its own. A stratum without
good labels, or in a pool with too few, has no certified cutoff and rejects nothing beyond the base rules. Several labels of a document: it is
good if any says so. Null labels and labels of unknown documents count for nothing. Repeated rows each get their row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_arrow, row_key, rows_without, sized_join, splitmix, written

FEATURES = ("symbols", "dup_lines", "repeats", "capitals", "marks", "sameness", "long_words")
#: What each feature is measured by in the score (its level scores 1000).
LEVELS = {"symbols": 200, "dup_lines": 500, "repeats": 300, "capitals": 300, "marks": 500, "sameness": 1000, "long_words": 1000}
#: Features are whole numbers, thousandths, from 0 to this: what is beyond counts as this much (the certified risk holds for the
#: features as they are cut).
TOP = 5000
WINDOW = 8
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_capitals long, n_marks long, n_distinct long"


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a WINDOW-word window found at least twice, and distinct words."""
    n, seen = len(words), {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if n <= WINDOW or len(seen) == n:
        return 0, len(seen)
    mixed, hashed = splitmix(ids + 1), np.zeros(n - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + mixed[j : j + len(hashed)]
    ordered = np.sort(hashed)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0, len(seen)
    places: dict[bytes, list[int]] = {}
    for p in np.flatnonzero(np.isin(hashed, twice)).tolist():  # equal hashes are told from equal windows
        places.setdefault(ids[p : p + WINDOW].tobytes(), []).append(p)
    covered = np.zeros(n + 1, np.int64)
    for at in places.values():
        if len(at) > 1:
            covered[at] += 1
            covered[[p + WINDOW for p in at]] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum()), len(seen)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of _STATS."""
    data = (text or "").encode()
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(data) - counts[0x80:0xC0].sum() - counts[9:14].sum() - counts[32]
    seen, lines, again = set(), 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    repeats, distinct = repeat_words(words)
    return len(words), int(chars), int(counts[_SYMBOLS].sum()), lines, again, repeats, int(counts[65:91].sum()), int(counts[33] + counts[63]), distinct


def stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, row (a key from id and text, never null), stratum and the counts of every whole text."""
    names = [x.split()[0] for x in _STATS.split(", ")]

    def make(ids, keys, texts, strata):
        rows = [text_stats(t) for t in texts]
        return {"id": ids, "row": keys, "stratum": strata} | {n: [r[i] for r in rows] for i, n in enumerate(names)}

    stratum = F.col(f"`{stratum_col}`") if stratum_col in docs.columns else F.lit(None)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), stratum.cast("string").alias("stratum"))
    return by_arrow(rows, make, f"id long, row long, stratum string, {_STATS}")


def features() -> dict[str, Column]:
    """Each feature in thousandths, higher is worse."""
    share = lambda a, b: F.least(F.lit(TOP), F.floor(1000 * F.col(a) / F.greatest(F.lit(1), F.col(b)))).cast("int")
    return {
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "sameness": F.lit(1000) - share("n_distinct", "n_words"),
        "long_words": F.least(F.lit(TOP), F.floor(100 * F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words")))).cast("int"),
    }


def most_errors(n: int, rate: float, level: float) -> int:
    """Largest k for which k errors of n bound the error rate by `rate`: P(X <= k | n, rate) <= level; -1 if there is none."""
    top = int(n * rate)
    if n <= 0 or n * math.log1p(-rate) > math.log(level):
        return -1
    i = np.arange(1, top + 1)
    logs = n * math.log1p(-rate) + np.concatenate([[0.0], np.cumsum(np.log((n - i + 1) / i) + math.log(rate / (1 - rate)))])
    return int((np.cumsum(np.exp(logs)) <= level).sum()) - 1


def cutoffs(counted: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, label_col: str = "quality", id_col: str = "doc_id") -> DataFrame:
    """(stratum, feature, n_good, allowed, cutoff) from the labelled rows of counted (see stats()); n_good and allowed are those of
    the pool where a stratum is in it.

    Labels that do not join with a row count for nothing. Only counts for each score are shuffled."""
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    good = counted.join(told.where("y = 1"), "id", "left_semi").withColumn("stratum", F.coalesce("stratum", F.lit("\0none")))
    score = F.greatest(*[F.ceil(1000 * v / LEVELS[k]) for k, v in features().items()])
    hist = written(good.groupBy("stratum", score.alias("value")).count(), "quality-counts")
    n_tests = hist.select("stratum").distinct().count() + 1

    @F.pandas_udf("long")
    def allowed(n: pd.Series) -> pd.Series:
        return n.map(lambda x: most_errors(int(x), alpha, delta / n_tests)).astype("int64")

    own = hist.groupBy("stratum").agg(F.sum("count").alias("n")).withColumn("own", allowed("n"))
    units = own.select("stratum", F.when(F.col("own") < 0, "\0pool").otherwise(F.concat(F.lit("\0own"), "stratum")).alias("unit"))
    hist = hist.join(units, "stratum").groupBy("unit", "value").agg(F.sum("count").alias("count"))
    total = hist.groupBy("unit").agg(F.sum("count").alias("n_good")).withColumn("allowed", allowed("n_good"))
    above = F.sum("count").over(Window.partitionBy("unit").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1))
    nested = hist.withColumn("above", F.coalesce(above, F.lit(0))).join(total, "unit")
    found = nested.groupBy("unit", "n_good", "allowed").agg(F.min(F.when(F.col("above") <= F.col("allowed"), F.col("value"))).alias("score"))
    of = F.explode(F.map_from_arrays(F.array(*map(F.lit, LEVELS)), F.array(*map(F.lit, LEVELS.values())))).alias("feature", "level")
    rows = units.join(found, "unit").select("stratum", "n_good", "allowed", "score", of)
    return rows.select("stratum", "feature", "n_good", "allowed", F.floor(F.col("score") * F.col("level") / 1000).cast("int").alias("cutoff"))


def judge(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with base_failed, reasons (features above their cutoffs) and kept."""
    by = limits.where("cutoff is not null").groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("feature", "cutoff"))).alias("limits"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = sized_join(counted.withColumn("stratum", F.coalesce("stratum", F.lit("\0none"))), by, ["stratum"])
    over = F.filter(F.array(*[F.when(v > F.try_element_at("limits", F.lit(k)), F.lit(k)) for k, v in features().items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("reasons", over).withColumn("base_failed", base)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0)).drop("limits")


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """id, row, counts, base_failed, reasons, kept for each document."""
    counted = written(stats(docs), "quality")
    return judge(counted, cutoffs(counted, labels, alpha, delta))


def good_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs without the rows that the rules reject, whatever their ids; all columns as they are."""
    bad = quality_rules(docs, labels, **limits).where(~F.col("kept")).select("row")
    return rows_without(docs, written(bad, "quality-gone"), id_col, text_col)
