"""Tables found in documents against the true ones: which is which, where their cells stand and what they say.

Cells are rows (doc, table_ix, row, col, text). Likeness of two texts is the ratio of the standard library's SequenceMatcher. Only
pairs that can reach the asked ratio are compared. Where few texts stand under a key, as in most documents, their characters are counted pair
by pair; where many do, pairs are found by a join: a ratio of c needs c / 2 of both texts' characters in common, so two texts must
share one of their rarest characters (with its number of occurrence), which an equi-join tells, and enough of all of them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.scratch import written


def _signs(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name, sign): a text's characters, each with the number of its occurrence; an empty text has the sign ''."""
    rows = df.select(*keys, name, F.explode(F.when(F.length("text") == 0, F.array(F.lit(""))).otherwise(F.split("text", ""))).alias("c"))
    counts = rows.groupBy(*keys, name, "c").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, name, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "c").select(*keys, name, F.concat("c", F.col("i").cast("string")).alias("sign"))


def candidates(a: DataFrame, b: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """(keys, a, b, bound): the pairs of texts of a (keys, a, text) and b (keys, b, text) under equal keys whose ratio may reach the cutoff, and
    the most it can be. Ids are whole numbers, one a text."""
    both = _signs(a, keys, "a").withColumnRenamed("a", "id").withColumn("side", F.lit(0)).unionByName(_signs(b, keys, "b").withColumnRenamed("b", "id").withColumn("side", F.lit(1)))
    both = both.withColumn("f", F.count(F.lit(1)).over(Window.partitionBy(*keys, "sign")))
    own = Window.partitionBy(*keys, "side", "id")
    both = written(both.withColumns({"n": F.count(F.lit(1)).over(own), "r": F.row_number().over(own.orderBy("f", "sign"))}), "signs")
    # a partner has at least c / (2 - c) of a text's signs in common with it, so one of these is among its first ones
    first = both.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(cutoff / (2 - cutoff)) - 1e-9) + 1)
    side = lambda df, k, n: df.where(F.col("side") == k).select(*keys, F.col("id").alias(n), "sign", F.col("n").alias(f"n_{n}"))
    fits = F.lit(2.0) * F.least("n_a", "n_b") >= F.lit(cutoff) * (F.col("n_a") + F.col("n_b")) - 1e-9
    pairs = side(first, 0, "a").join(side(first, 1, "b"), [*keys, "sign"]).where(fits).select(*keys, "a", "b").distinct()
    shared = pairs.join(side(both, 0, "a"), [*keys, "a"]).join(side(both, 1, "b").select(*keys, "b", "sign", "n_b"), [*keys, "b", "sign"])
    bound = shared.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("k"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return bound.select(*keys, "a", "b", (F.lit(2.0) * F.col("k") / (F.col("n_a") + F.col("n_b"))).alias("bound")).where(F.col("bound") >= F.lit(cutoff) - 1e-9)


#: Pairs of texts under a key, and their characters, up to which they are compared in one row.
FEW, FEW_CHARS = 1024, 1 << 20


def _best(word: str, others: list, cutoff: float, m: SequenceMatcher) -> tuple | None:
    """(ratio, text, -id) of the text most like the word; others: (bound, text, id) by falling bounds."""
    m.set_seq2(word)
    found, ratios = None, {}
    for limit, text, name in others:
        if found is not None and limit < found[0] - 1e-9:  # what is left can't be better
            break
        if text not in ratios:
            m.set_seq1(text)
            ratios[text] = m.ratio() if m.real_quick_ratio() >= cutoff else 0.0
        this = (ratios[text], text, -name)
        if this[0] >= cutoff and (found is None or this > found):
            found = this
    return found


def _bounded(word: str, texts: list, cutoff: float, m: SequenceMatcher) -> list:
    """(bound, text, id) by falling bounds of those that may reach the cutoff, from the characters both have. A text that equals the word is
    alone: no other reaches 1 (SequenceMatcher leaves frequent characters out from 200 characters on)."""
    same = [(1.0, word, i) for i, t in texts if t == word] if len(word) < 200 else []
    if same:
        return same
    m.set_seq2(word)
    out = []
    for i, t in texts:
        m.set_seq1(t)
        if m.real_quick_ratio() >= cutoff and (limit := m.quick_ratio()) >= cutoff - 1e-9 and limit > 0:
            out.append((limit, t, i))
    return sorted(out, reverse=True)


def closest(a: DataFrame, b: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """(keys, a, b, ratio, word, like): for each text of a the text of b that is most like it, if its ratio reaches the cutoff; of equal
    ratios the greater text, of equal texts the smaller id. word and like are the two texts."""
    named = lambda df, name, side: df.select(*keys, F.col(name).alias("id"), "text", F.lit(side).alias("side"))
    real = F.col("text").isNotNull()
    for k in keys:
        real = real & F.col(k).isNotNull()
    both = written(named(a, "a", 0).unionByName(named(b, "b", 1)).where(real), "texts")
    one = F.col("side") == 0
    sizes = both.groupBy(*keys).agg(F.count_if(one).alias("n"), F.count_if(~one).alias("m"), F.sum(F.length("text").cast("long")).alias("chars"))
    many = written(sizes.where((F.col("n") > 0) & (F.col("m") > 0) & ((F.col("n") * F.col("m") > FEW) | (F.col("chars") > FEW_CHARS))).select(*keys), "texts-many")
    some = not many.isEmpty()
    few = both.join(many, keys, "left_anti") if some else both
    of = lambda side: F.array_sort(F.collect_list(F.when(side, F.struct("id", "text"))))
    rows = few.groupBy(*keys).agg(of(one).alias("x"), of(~one).alias("y")).where("size(x) > 0 and size(y) > 0")

    @F.pandas_udf("array<struct<a:long,b:long,ratio:double,word:string,like:string>>")
    def matched(x: pd.Series, y: pd.Series) -> pd.Series:
        out, m = [], SequenceMatcher()
        for words, texts in zip(x, y):
            texts, row = [(t["id"], t["text"]) for t in texts], []
            for w in words:
                if (found := _best(w["text"], _bounded(w["text"], texts, cutoff, m), cutoff, m)) is not None:
                    row.append({"a": w["id"], "b": -found[2], "ratio": found[0], "word": w["text"], "like": found[1]})
            out.append(row)
        return pd.Series(out, dtype=object)

    near = rows.select(*keys, matched("x", "y").alias("f")).select(*keys, F.explode("f").alias("f")).select(*keys, "f.*")
    return near.unionByName(_closest_of_many(*(both.where(side).join(many, keys, "left_semi").select(*keys, F.col("id").alias(n), "text") for side, n in ((one, "a"), (~one, "b"))), keys, cutoff)) if some else near


def _closest_of_many(a: DataFrame, b: DataFrame, keys: list[str], cutoff: float) -> DataFrame:
    """closest() by candidates()."""
    pairs = candidates(a, b, keys, cutoff)
    rows = pairs.join(a.withColumnRenamed("text", "word"), [*keys, "a"]).join(b, [*keys, "b"])
    lists = rows.groupBy(*keys, "a").agg(F.first("word").alias("word"), F.sort_array(F.collect_list(F.struct("bound", "text", F.col("b"))), asc=False).alias("others"))

    @F.pandas_udf("struct<b:long,ratio:double,like:string>")
    def best(words: pd.Series, others: pd.Series) -> pd.DataFrame:
        m = SequenceMatcher()
        out = [_best(w, [(o["bound"], o["text"], o["b"]) for o in rest], cutoff, m) for w, rest in zip(words, others)]
        return pd.DataFrame({"b": pd.Series([None if x is None else -x[2] for x in out], dtype="Int64"), "ratio": pd.Series([None if x is None else x[0] for x in out], dtype="float64"), "like": pd.Series([None if x is None else x[1] for x in out], dtype=object)})

    return lists.select(*keys, "a", "word", best("word", "others").alias("x")).where("x.b is not null").select(*keys, "a", "x.b", "x.ratio", "word", "x.like")


def _joined(cells: DataFrame, doc: str, *order: str) -> DataFrame:
    """(doc, table_ix, text): the cells' texts in the order of the columns, one space between two."""
    items = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return cells.groupBy(doc, "table_ix").agg(F.array_join(F.transform(items, lambda x: x["text"]), " ").alias("text"))


def match_tables(predicted: DataFrame, truth: DataFrame, doc: str, cutoff: float = 0.1) -> DataFrame:
    """(doc, p, t, similarity) of each predicted table: the true one whose text is most like its own, t null and similarity 0 if none is."""
    p = _joined(predicted, doc, "row", "col")
    a, b = p.select(doc, F.col("table_ix").cast("long").alias("a"), "text"), _joined(truth, doc, "row", "col").select(doc, F.col("table_ix").cast("long").alias("b"), "text")
    found = closest(a, b, [doc], cutoff).select(doc, F.col("a").alias("p"), F.col("b").alias("t"), F.col("ratio").alias("similarity"))
    return p.select(doc, F.col("table_ix").cast("long").alias("p")).join(found, [doc, "p"], "left").withColumn("similarity", F.round(F.coalesce("similarity", F.lit(0.0)), 6))


@F.pandas_udf(DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common run of words (gaps allowed) of two texts, by the words both have; equal to 1 if neither has any. The run's
    length is found with a row of bits for each word of the second text, all columns of a row at once."""

    def one(x: str, y: str) -> float:
        x, y = x.split(), y.split()
        if not x or not y:
            return float(x == y)
        places: dict[str, int] = {}
        for i, w in enumerate(y):
            places[w] = places.get(w, 0) | 1 << i
        full = (1 << len(y)) - 1
        free = full
        for w in x:
            hit = free & places.get(w, 0)
            free = ((free + hit) | (free - hit)) & full
        return 2 * (len(y) - free.bit_count()) / (len(x) + len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def cell_scores(predicted: DataFrame, truth: DataFrame, matches: DataFrame, doc: str, cutoff: float = 0.8) -> DataFrame:
    """(doc, p, row_index, col_index, row_content, col_content) of each predicted table with a true one.

    A predicted cell goes with the true cell most like it (lower case); of several with one text, in order, and from the start again
    once all are taken. The indices are the shares of such cells in the right row, and column. Contents are token ratios of the tables read
    row by row, and column by column."""
    pairs = matches.where("t is not null").select(doc, "p", F.col("t").alias("table_ix"))
    low = lambda df: df.withColumn("text", F.lower("text"))
    a = low(predicted).withColumnRenamed("table_ix", "p").join(pairs.select(doc, "p"), [doc, "p"]).select(doc, "p", "row", "col", "text")
    b = low(truth).join(pairs, [doc, "table_ix"]).select(doc, "p", "row", "col", "text")
    name = lambda df, n: df.groupBy(doc, "p", "text").agg(F.xxhash64("text").alias(n))  # noqa: E731  an id for each different text of a table
    one, two = name(a, "a"), name(b, "b")
    near = closest(one, two, [doc, "p"], cutoff).select(doc, "p", F.col("word").alias("text"), "like")
    turn = lambda w: F.row_number().over(Window.partitionBy(doc, "p", w).orderBy("row", "col")) - 1
    sides = b.withColumnRenamed("text", "like").withColumnsRenamed({"row": "r", "col": "c"})
    sides = sides.withColumns({"k": F.row_number().over(Window.partitionBy(doc, "p", "like").orderBy("r", "c")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(doc, "p", "like"))})
    sides = written(sides, "table-places")  # read twice
    mine = a.join(near, [doc, "p", "text"]).withColumn("turn", turn("like"))
    counts = sides.where("k = 0").select(doc, "p", "like", "n")
    hits = mine.join(counts, [doc, "p", "like"]).withColumn("k", (F.col("turn") % F.col("n")).cast("int")).join(sides.drop("n"), [doc, "p", "like", "k"])
    share = lambda x, y: F.round(F.avg((F.col(x) == F.col(y)).cast("double")), 6)
    index = hits.groupBy(doc, "p").agg(share("row", "r").alias("row_index"), share("col", "c").alias("col_index"))
    texts = None
    for k, order in (("row_content", ("row", "col")), ("col_content", ("col", "row"))):
        x = _joined(predicted, doc, *order).withColumnsRenamed({"table_ix": "p", "text": "x"}).join(pairs, [doc, "p"])
        both = x.join(_joined(truth, doc, *order).withColumnRenamed("text", "y"), [doc, "table_ix"]).select(doc, "p", F.round(token_ratio("x", "y"), 6).alias(k))
        texts = both if texts is None else texts.join(both, [doc, "p"])
    return texts.join(index, [doc, "p"], "left").fillna(0.0, ["row_index", "col_index"])


SCORES = ["table_level", "precision", "recall", "f1", "row_index", "col_index", "row_content", "col_content", "composite"]


def evaluate_tables(predicted: DataFrame, truth: DataFrame, doc: str, cutoff: float = 0.8) -> DataFrame:
    """(doc, n_truth, n_predicted, and SCORES) of each document with a table on either side.

    Predicted tables without a true one, and true ones that no predicted one goes with, count 0 in the means of indices and
    contents; table_level is the mean similarity of the predicted tables. A document without true tables scores 0 throughout."""
    matches = written(match_tables(predicted, truth, doc), "table-matches")
    cells = written(cell_scores(predicted, truth, matches, doc, cutoff), "table-cells")
    found = matches.join(cells, [doc, "p"], "left")
    of = found.groupBy(doc).agg(F.count(F.lit(1)).alias("n_predicted"), F.countDistinct("t").alias("hits"), F.sum("similarity").alias("similar"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in SCORES[4:8]])
    rows = truth.groupBy(doc).agg(F.countDistinct("table_ix").alias("n_truth")).join(of, doc, "full_outer")
    rows = rows.fillna(0, ["n_truth", "n_predicted", "hits"]).fillna(0.0, ["similar", *SCORES[4:8]])
    p, r = F.try_divide("hits", "n_predicted"), F.try_divide("hits", "n_truth")
    all_ = F.col("n_predicted") + F.col("n_truth") - F.col("hits")
    cols = {"table_level": F.try_divide("similar", "n_predicted"), "precision": p, "recall": r, "f1": F.try_divide(F.lit(2.0) * F.col("hits"), F.col("n_predicted") + F.col("n_truth"))}
    cols |= {c: F.try_divide(F.col(c), all_) for c in SCORES[4:8]}
    rows = rows.select(doc, "n_truth", "n_predicted", *[F.round(F.when(F.col("n_truth") > 0, F.coalesce(v, F.lit(0.0))).otherwise(0.0), 6).alias(k) for k, v in cols.items()])
    return rows.withColumn("composite", composite())


def composite() -> Column:
    """One number for a document's tables: places count whole, rows' and columns' contents half each."""
    return F.round((F.col("col_index") + F.col("row_index") + (F.col("col_content") + F.col("row_content")) / 2) / 3, 6)
