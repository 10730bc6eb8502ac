"""Corpus evaluation: words, element types, distances, overlaps, boxes and tables against ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written
from .numbering import running


def words_of(t: Column) -> Column:
    """Words of a text for bags of words: lower case, bullets and punctuation but - and ' off. Single characters count only
    where no other single character is next to them and they are letters or digits."""
    return _counted(_split(t))


def _split(t: Column) -> Column:
    return F.filter(F.split(T.drop_bullet(T.drop_punctuation(F.lower(t), "-'")), r"\s+"), lambda x: x != "")


def _counted(w: Column) -> Column:
    lone = lambda i: F.coalesce(F.length(F.try_element_at(w, i)) == 1, F.lit(False))
    return F.filter(w, lambda x, i: (F.length(x) > 1) | (x.rlike(r"^[\p{L}\p{N}]$") & ~lone(i + 2) & ~F.when(i > 0, lone(F.greatest(i, F.lit(1)))).otherwise(F.lit(False))))


def bags(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, word, n)."""
    split = df.select(id_col, _split(F.col(text)).alias("_w"))  # a column of its own, split once a text
    return split.select(id_col, F.explode(_counted(F.col("_w"))).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(word, n_docs, n)."""
    return bags(df, id_col, text).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))


def percent_missing(output: DataFrame, source: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, pct_missing): the share of the source's words that the output lacks, to three places; 0 for an empty source. Documents
    that only one side has are left out.

    Words of both sides are counted in one aggregation, under opposite columns. Texts are brought together by their id before they are
    split, so what is shuffled is the texts and not a row for each word of each."""
    sides = [x.select(id_col, F.col(text).alias("_t"), F.lit(s).alias("_s")) for x, s in ((source, 1), (output, 0))]
    both = sides[0].unionByName(sides[1]).repartition(id_col).select(id_col, _split(F.col("_t")).alias("_w"), "_s")
    words = both.select(id_col, "_s", F.explode_outer(_counted(F.col("_w"))).alias("word"))
    n = words.groupBy(id_col, "word").agg(F.sum("_s").alias("n"), F.sum(1 - F.col("_s")).alias("m"))
    real = F.col("word").isNotNull()
    by = n.groupBy(id_col).agg(F.sum(F.when(real, F.greatest(F.col("n") - F.col("m"), F.lit(0)))).alias("missing"), F.sum(F.when(real, F.col("n"))).alias("total"), F.sum("n").alias("a"), F.sum("m").alias("b"))
    share = F.least(F.lit(1.0), F.round(F.coalesce(F.try_divide(F.col("missing"), F.col("total")), F.lit(0.0)), 3))
    # a side without a word still has its row with a null word, so a and b tell who was there
    return by.where("a > 0 and b > 0").select(id_col, share.alias("pct_missing"))


def type_frequency(elements: DataFrame, doc: str, kind: str = "type", depth: str = "category_depth") -> DataFrame:
    return elements.groupBy(doc, F.col(kind).alias("type"), F.col(depth).alias("depth")).agg(F.count(F.lit(1)).alias("n"))


def type_match(output: DataFrame, source: DataFrame, doc: str, weight: float = 0.5) -> DataFrame:
    """(doc, score) of type_frequency() tables: equal (type, depth) pairs count whole, what is left of a type at `weight`."""
    a, b = (x.withColumn("depth", F.coalesce(F.col("depth").cast("int"), F.lit(-1))) for x in (output, source))
    both = a.withColumnRenamed("n", "o").join(b.withColumnRenamed("n", "s"), [doc, "type", "depth"], "full_outer").fillna(0, ["o", "s"])
    m = F.least("o", "s")
    kinds = both.groupBy(doc, "type").agg(F.sum(m).alias("exact"), F.sum(F.col("o") - m).alias("o"), F.sum(F.col("s") - m).alias("s"))
    part = kinds.groupBy(doc).agg(F.sum(F.col("exact") + weight * F.least("o", "s")).alias("hit"), F.sum(F.col("exact") + F.col("s")).alias("total"), F.sum(F.col("exact") + F.col("o")).alias("made"))
    return part.select(doc, F.when((F.col("total") == 0) | (F.col("made") == 0), F.lit(0.0)).otherwise(F.round(F.least(F.lit(1.0), F.col("hit") / F.col("total")), 6)).alias("score"))


def metric_summary(rows: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """(grouping, value, average, sample_sd, population_sd, count) over each grouping column and over all, in one pass, to three
    places. Spreads leave nulls out and are null for one value or none; count takes nulls too."""
    v = F.col(metric)
    few = F.count(v) <= 1
    sets = rows.groupingSets([[c] for c in by] + [[]], *by).agg(
        F.round(F.avg(v), 3).alias("average"),
        F.when(few, F.lit(None)).otherwise(F.round(F.stddev_samp(v), 3)).alias("sample_sd"),
        F.when(few, F.lit(None)).otherwise(F.round(F.stddev_pop(v), 3)).alias("population_sd"),
        F.count(F.lit(1)).alias("count"),
        *[F.grouping(c).alias(f"_{c}") for c in by],
    )
    name = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in by], F.lit("all"))
    value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in by], F.lit("all"))
    return sets.select(name.alias("grouping"), value.alias("value"), "average", "sample_sd", "population_sd", "count")


def weighted_mean(rows: DataFrame, value: str, weight: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    v, w = F.col(value), F.when(F.col(value).isNotNull(), F.col(weight))
    return rows.groupBy(*by).agg(F.try_divide(F.sum(v * w), F.sum(w)).alias("mean"))


def _normal(t: Column) -> Column:
    return T.standard_quotes(T.strip(F.regexp_replace(t, r"\s+", " ")))


def edit_distance(pairs: DataFrame, output: str, source: str, weights: tuple[int, int, int] = (2, 1, 1)) -> DataFrame:
    """pairs with distance and accuracy (1 - distance / length of the source, in [0, 1]); weights of insertion, deletion and
    substitution. Equal weights run inside Spark; others in an Arrow-batched function, a row of the table a vector step.

    Pairs whose lengths differ by a factor of two or more are given accuracy 0.01 without a distance and never reach it; pairs
    without a source are left out."""
    rows = pairs.where(F.octet_length(source) > 0)
    ratio = F.octet_length(F.coalesce(F.col(output), F.lit(""))) / F.octet_length(source)
    far = rows.where(~((ratio > 0.5) & (ratio < 2.0))).withColumns({"distance": F.lit(None).cast("int"), "accuracy": F.lit(0.01)})
    near = rows.where((ratio > 0.5) & (ratio < 2.0))
    if len(set(weights)) == 1:
        d = F.levenshtein(_normal(F.col(output)), _normal(F.col(source))) * weights[0]
    else:
        d = _weighted(weights)(_normal(F.col(output)), _normal(F.col(source)))
    near = near.withColumn("distance", d).withColumn("accuracy", F.round(F.lit(1.0) - F.least(F.lit(1.0), F.col("distance") / F.greatest(F.lit(1), F.length(_normal(F.col(source))))), 6))
    return near.unionByName(far)


def _weighted(weights: tuple[int, int, int]):
    ins, dele, sub = weights

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(weighted_distances([x or "" for x in a], [y or "" for y in b], ins, dele, sub), dtype="int32")

    return distance


def weighted_distances(a: list[str], b: list[str], ins: int, dele: int, sub: int, block: int = 1 << 22) -> np.ndarray:
    """The least cost of turning each text of a into its text of b.

    Pairs of like lengths are computed together, a diagonal band of the table a step: band cells of all pairs in one array. A path that
    stays within the band of width w costs the least of all paths if it costs no more than any that leaves it: going w places off
    the main diagonals takes w more insertions, or deletions. Bands start narrow and double for the pairs that need it."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    todo, width = np.lexsort((sizes[:, 1], sizes[:, 0])), 16
    while len(todo):
        left = []
        at = 0
        while at < len(todo):
            tall = int(np.abs(sizes[todo[at:], 0] - sizes[todo[at:], 1]).max()) + 2 * width + 1
            own = todo[at : at + max(1, block // tall)]
            got, exact = _banded([a[i] for i in own], [b[i] for i in own], ins, dele, sub, width)
            out[own] = got
            left.append(own[~exact])
            at += len(own)
        todo, width = np.concatenate(left), width * 4
    return out


def _banded(a: list[str], b: list[str], ins: int, dele: int, sub: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(costs within the band, whether no path outside can cost less) of pairs. Cell k of row i stands for place i + k - below of b."""
    n, m = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    below = np.maximum(0, n - m) + width  # cells left of the main diagonal
    wide = int((np.abs(n - m) + 2 * width + 1).max())
    codes = [np.zeros((len(a), int(s.max()) if len(s) else 0), np.int64) for s in (n, m)]
    for x, t in zip(codes, (a, b)):
        for row, text in zip(x, t):
            row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = 1 << 40
    k = np.arange(wide)
    place = k[None, :] - below[:, None]
    inside = place <= (m - n)[:, None] + below[:, None]  # the band ends as far right of the last diagonal as it begins left of the first
    steps = k * ins
    row = np.where((place >= 0) & (place <= m[:, None]) & inside, place * ins, far)
    out = np.where(n == 0, row[np.arange(len(a)), np.clip(m + below, 0, wide - 1)], 0)
    for i in range(1, int(n.max()) + 1 if len(n) else 0):
        j = place + i
        real = (j >= 0) & (j <= m[:, None]) & inside
        same = np.take_along_axis(codes[1], np.clip(j - 1, 0, max(0, codes[1].shape[1] - 1)), 1) == codes[0][:, i - 1 : i] if codes[1].shape[1] else np.zeros(j.shape, bool)
        diagonal = np.where(j >= 1, row + np.where(same, 0, sub), far)
        above = np.concatenate([row[:, 1:], np.full((len(a), 1), far)], 1) + dele
        low = np.where(real, np.minimum(diagonal, above), far)
        row = np.where(real, np.minimum.accumulate(low - steps, 1) + steps, far)
        ends = n == i
        out[ends] = row[ends, np.clip(m[ends] - i + below[ends], 0, wide - 1)]
    # a path outside goes `width` + 1 places beyond both corners' diagonals and comes back
    least = (width + 1) * (ins + dele) + np.where(m > n, (m - n) * ins, (n - m) * dele)
    return out, (out <= least) | (width >= np.maximum(n, m))


def ngrams(df: DataFrame, id_col: str, n: int, text: str = "text") -> DataFrame:
    """(id, h, h2): word n-grams of each text as two 64-bit hashes of their words' hashes: 128 bits tell them apart."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    w = F.col("_w")  # a column of its own: inside the lambda the split would run again for each gram
    part = lambda i, k: F.xxhash64(*[F.get(w, i - 1 + j)[k] for j in range(n)])  # noqa: E731  word by word: a slice would unpack the whole text for each gram
    grams = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(part(i, "a").alias("h"), part(i, "b").alias("h2"))))
    return df.select(id_col, words.alias("_w")).select(id_col, F.explode(grams).alias("g")).select(id_col, "g.h", "g.h2")


def ngram_overlap(a: DataFrame, b: DataFrame, a_id: str, b_id: str, n: int = 5, text: str = "text", most_rows: int = 2_000_000) -> DataFrame:
    """(a_id, b_id, shared, pct): n-grams of a row of b that a row of a has, and their share of b's; pairs that share none are
    left out. b is the shorter side by use (test items): its grams are broadcast up to most_rows of them (counted; 24 bytes each), and
    those of a are then not shuffled."""
    gb = ngrams(b, b_id, n, text).distinct()
    total = gb.groupBy(b_id).agg(F.count(F.lit(1)).alias("total"))
    side = F.broadcast(gb) if gb.limit(most_rows + 1).count() <= most_rows else gb
    hit = ngrams(a, a_id, n, text).join(side, ["h", "h2"]).distinct().groupBy(a_id, b_id).agg(F.count(F.lit(1)).alias("shared"))
    return hit.join(total, b_id).select(a_id, b_id, "shared", F.round(F.col("shared") / F.col("total"), 6).alias("pct"))


def _longest_shared(x: list[str], y: list[str]) -> tuple[int, float]:
    """(n, percentage): the largest n under the words of the shorter list for which both share a run of n words, and the share of the
    shorter list's runs of n words that are shared; (0, 0) for none.

    Runs of 1, 2, 4, ... words get numbers, the same in both lists; a run of n words is two of them that overlap. Sharing n words
    means sharing n - 1, so n is found by halving."""
    if len(y) < len(x):
        x, y = y, x
    names: dict[str, int] = {}
    levels = [[np.array([names.setdefault(w, len(names)) for w in t], np.int64) for t in (x, y)]]

    def runs(n: int) -> list[np.ndarray]:
        p = n.bit_length() - 1
        if 1 << p == n:
            while len(levels) <= p:
                h = 1 << (len(levels) - 1)
                levels.append(_numbered(*[(t[:-h], t[h:]) for t in levels[-1]]))
            return levels[p]
        k = n - (1 << p)
        return _numbered(*[(t[: len(t) - k], t[k:]) for t in runs(1 << p)])

    low, high, best = 0, len(x) - 1, np.zeros(0, np.int64)
    while low < high:
        mid = (low + high + 1) // 2
        a, b = runs(mid)
        common = np.intersect1d(a, b)
        if len(common):
            low, best = mid, common
        else:
            high = mid - 1
    return (low, round(100 * len(best) / (len(x) - low + 1), 2)) if low else (0, 0.0)


def _numbered(*pairs: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Pairs of numbers as numbers, equal where the pairs are."""
    size = 1 + max((int(b.max()) for _, b in pairs if len(b)), default=0)
    joined = np.concatenate([a * size + b for a, b in pairs])
    new = np.unique(joined, return_inverse=True)[1]
    return list(np.split(new.astype(np.int64), np.cumsum([len(a) for a, _ in pairs])[:-1]))


def largest_shared_n(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with shared_n and shared_pct: the largest n, under the words of the shorter text, for which two texts share a word n-gram, and the
    percentage of the shorter one's n-grams that are shared (of equally long ones the second's). 0 for none; words as they are."""

    @F.pandas_udf("struct<shared_n:int,shared_pct:double>")
    def shared(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_longest_shared((p or "").split(), (q or "").split()) for p, q in zip(y, x)], columns=["shared_n", "shared_pct"])

    return pairs.withColumn("_s", shared(F.col(a), F.col(b))).select(*[pairs[c] for c in pairs.columns], "_s.shared_n", "_s.shared_pct")


def box_area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(f"{p}x2") - F.col(f"{p}x1")) * F.greatest(F.lit(0.0), F.col(f"{p}y2") - F.col(f"{p}y1"))


def intersection(a: str, b: str) -> Column:
    w = F.least(F.col(f"{a}x2"), F.col(f"{b}x2")) - F.greatest(F.col(f"{a}x1"), F.col(f"{b}x1"))
    h = F.least(F.col(f"{a}y2"), F.col(f"{b}y2")) - F.greatest(F.col(f"{a}y1"), F.col(f"{b}y1"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: str, b: str) -> Column:
    i = intersection(a, b)
    return F.coalesce(F.try_divide(i, box_area(a) + box_area(b) - i), F.lit(0.0))


def box_overlaps(boxes: DataFrame, keys: tuple[str, str] = ("doc", "page"), cell: float = 200.0, slack: float = 5.0, shares: bool = False) -> DataFrame:
    """Overlapping pairs of boxes (ix, x1, y1, x2, y2, text) on a page, and the case of each: nested, small, empty text,
    duplicate text, shared words, none. With shares, the last two are told by largest_shared_n(), whose columns follow (null for the
    other cases).

    Boxes are put into the cells of a grid; only boxes that share a cell meet, once, in the first cell both have."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    grid = boxes.select(*keys, F.struct("ix", "x1", "y1", "x2", "y2", "text").alias("b"), cells("x1", "x2").alias("cx"), "y1", "y2").select(*keys, "b", "cx", cells("y1", "y2").alias("cy"))
    pairs = grid.withColumnRenamed("b", "a").join(grid, [*keys, "cx", "cy"]).where("a.ix < b.ix")
    first = (F.col("cx") == F.floor(F.greatest("a.x1", "b.x1") / cell)) & (F.col("cy") == F.floor(F.greatest("a.y1", "b.y1") / cell))
    area = intersection("a.", "b.")
    pairs = pairs.where(first & (area > 0)).withColumn("share", area / F.least(box_area("a."), box_area("b.")))
    inside = lambda p, q: (F.col(f"{q}.x1") >= F.col(f"{p}.x1") - slack) & (F.col(f"{q}.y1") >= F.col(f"{p}.y1") - slack) & (F.col(f"{q}.x2") <= F.col(f"{p}.x2") + slack) & (F.col(f"{q}.y2") <= F.col(f"{p}.y2") + slack)
    ta, tb = F.col("a.text"), F.col("b.text")
    blank = lambda t: F.coalesce(T.strip(t), F.lit("")) == ""
    common = F.arrays_overlap(F.split(F.lower(ta), r"\s+"), F.split(F.lower(tb), r"\s+"))
    case = F.when(inside("a", "b") | inside("b", "a"), "nested").when(F.col("share") < 0.1, "small").when(blank(ta) | blank(tb), "empty text").when(F.contains(ta, tb) | F.contains(tb, ta), "duplicate text").when(common, "shared words").otherwise("none")
    rows = pairs.select(*keys, F.col("a.ix").alias("a"), F.col("b.ix").alias("b"), F.round("share", 6).alias("share"), case.alias("case"), ta.alias("_ta"), tb.alias("_tb"))
    if not shares:
        return rows.drop("_ta", "_tb")
    told = F.col("case").isin("shared words", "none")
    rest = rows.where(~told).withColumns({"shared_n": F.lit(None).cast("int"), "shared_pct": F.lit(None).cast("double")})
    asked = largest_shared_n(rows.where(told), "_ta", "_tb").withColumn("case", F.when(F.col("shared_n") > 0, "shared words").otherwise("none"))
    return rest.unionByName(asked).drop("_ta", "_tb")


def table_cells(elements: DataFrame, doc: str, html: str = "text_as_html") -> DataFrame:
    """(doc, table_ix, row, col, text) of the tables of each document; spanned cells are not repeated."""
    tables = elements.select(doc, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))).alias("table_ix", "t"))
    rows = tables.select(doc, "table_ix", F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "r"))
    cells = rows.select(doc, "table_ix", "row", F.posexplode(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))).alias("col", "c"))
    return cells.withColumn("text", T.strip(F.regexp_replace(F.regexp_replace("c", "<[^>]+>", " "), r"\s+", " "))).drop("c")


def align_tables(predicted: DataFrame, truth: DataFrame, doc: str) -> DataFrame:
    """(doc, p, t, similarity): for each predicted table the true one that shares most cell texts (ties: the first)."""
    a = predicted.select(doc, F.col("table_ix").alias("p"), "text").distinct()
    b = truth.select(doc, F.col("table_ix").alias("t"), "text").distinct()
    size = b.groupBy(doc, "t").agg(F.count(F.lit(1)).alias("n"))
    hit = a.join(b, [doc, "text"]).groupBy(doc, "p", "t").agg(F.count(F.lit(1)).alias("k")).join(size, [doc, "t"]).withColumn("s", F.col("k") / F.col("n"))
    return hit.groupBy(doc, "p").agg(F.max(F.struct("s", (-F.col("t")).alias("m"))).alias("x")).select(doc, "p", (-F.col("x.m")).alias("t"), F.round("x.s", 6).alias("similarity"))


def cell_accuracy(predicted: DataFrame, truth: DataFrame, doc: str) -> DataFrame:
    """(doc, t, row_accuracy, col_accuracy): of a true table's cells, those that the predicted table aligned with it has in the
    same row, and column; equal texts are paired in order."""
    pairs = align_tables(predicted, truth, doc)
    number = lambda df, t: df.withColumn("k", F.row_number().over(Window.partitionBy(doc, t, "text").orderBy("row", "col")))
    a = number(predicted.withColumnRenamed("table_ix", "p"), "p").join(pairs.select(doc, "p", "t"), [doc, "p"]).select(doc, "t", "text", "k", F.col("row").alias("r"), F.col("col").alias("c"))
    b = number(truth.withColumnRenamed("table_ix", "t"), "t")
    both = b.join(a, [doc, "t", "text", "k"], "left")
    mean = lambda x, y: F.round(F.avg(F.coalesce((F.col(x) == F.col(y)).cast("double"), F.lit(0.0))), 6)
    return both.groupBy(doc, "t").agg(mean("row", "r").alias("row_accuracy"), mean("col", "c").alias("col_accuracy"))


def table_detection(tables: DataFrame, doc: str) -> DataFrame:
    """(doc, precision, recall, f1) from (doc, n_predicted, n_truth, n_matched); none on both sides is a full score."""
    p, r = F.try_divide(F.col("n_matched"), F.col("n_predicted")), F.try_divide(F.col("n_matched"), F.col("n_truth"))
    none = (F.col("n_predicted") == 0) & (F.col("n_truth") == 0)
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return tables.select(doc, *[F.when(none, F.lit(1.0)).otherwise(F.round(F.coalesce(x, F.lit(0.0)), 6)).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f1, "f1"))])


def composite_structure() -> Column:
    """Composite accuracy of a table from its row_accuracy and col_accuracy (places) and row_content and col_content."""
    return F.round((F.col("col_accuracy") + F.col("row_accuracy") + (F.col("col_content") + F.col("row_content")) / 2) / 3, 6)


def _greedy(a: pd.DataFrame) -> pd.DataFrame:
    """(page, class, rank, hit = 1) of the boxes that get a true one: all pages of a group at once, a rank a step."""
    a = a.sort_values(["rank", "part", "of", "iou", "place"], ascending=[True, True, True, False, True]).reset_index(drop=True)
    page = a.groupby(["part", "of"], sort=False).ngroup().to_numpy()
    _, true = np.unique(np.stack([page, a["place"].to_numpy()], 1), axis=0, return_inverse=True)
    true = true.ravel()
    taken, kept = np.zeros(len(a), bool), []
    rank = a["rank"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(a) else []
    for i, j in zip(first, np.append(first[1:], len(a))):
        free = i + np.flatnonzero(~taken[true[i:j]])
        _, one = np.unique(page[free], return_index=True)  # the best free one of each page
        kept.append(free[one])
        taken[true[kept[-1]]] = True
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return a.loc[kept, ["page", "class", "rank"]].assign(hit=1)


def detection(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5, most: int = 100, grid: int = 101) -> DataFrame:
    """(class, n_truth, precision, recall, f1, ap) of boxes (page, class, score, x1, y1, x2, y2) against (page, class, x1, ...).

    Boxes of a page and class are matched greedily by score, each true one once (of equally good ones the first by its place), the `most`
    best predictions of each page and class taking part (the metric's own limit). Average precision reads the precision that isn't
    improved at any higher recall at `grid` recalls."""
    box = [f"{c}{i}" for c in "xy" for i in (1, 2)]
    w = Window.partitionBy("page", "class").orderBy(F.desc("score"), *box)
    p = written(predicted.select("page", "class", "score", *box).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most), "detection-boxes")
    t = truth.select("page", "class", *[F.col(c).alias(f"t{c}") for c in box]).withColumn("place", F.row_number().over(Window.partitionBy("page", "class").orderBy(*[f"t{c}" for c in box])))
    near = p.join(t, ["page", "class"]).withColumn("iou", iou("", "t")).where(F.col("iou") > threshold)
    # two hashes of page and class tell them apart, whatever their types
    near = written(near.select(F.xxhash64("page", "class").alias("part"), F.xxhash64(F.lit(1), "page", "class").alias("of"), "page", "class", "rank", "place", "iou"), "detection-near")
    parts = max(1, near.count() // 200_000)
    kinds = {c: truth.schema[c].dataType.simpleString() for c in ("page", "class")}
    found = near.groupBy(F.pmod("part", F.lit(parts)).alias("group")).applyInPandas(_greedy, f"page {kinds['page']}, class {kinds['class']}, rank int, hit int")
    hits = p.select("page", "class", "score", "rank").join(found, ["page", "class", "rank"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    hits = written(hits, "detection-hits")
    n = truth.groupBy("class").agg(F.count(F.lit(1)).alias("n_truth"))
    order = [F.desc("score"), F.asc("page"), F.asc("rank")]
    run = running(hits, *order, of={"h": F.col("hit"), "m": F.lit(1)}, within=("class",)).join(n, "class")
    tp = F.col("h")
    run = run.select("class", (tp / F.col("m")).alias("precision"), F.floor(tp / F.col("n_truth") * (grid - 1) + 1e-9).alias("upto"))
    # a point of the grid reads the best precision at its recall or beyond; recalls only rise, so that is the best of its bucket and later ones
    points = run.groupBy("class", "upto").agg(F.max("precision").alias("best"))
    points = points.withColumn("best", F.max("best").over(Window.partitionBy("class").orderBy(F.desc("upto"))))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("class").orderBy("upto")), F.lit(-1))
    ap = points.withColumn("width", F.col("upto") - before).groupBy("class").agg(F.round(F.sum(F.col("best") * F.col("width")) / grid, 6).alias("ap"))
    last = hits.groupBy("class").agg(F.sum("hit").alias("tp"), F.count(F.lit(1)).alias("made"))
    out = n.join(last, "class", "left").join(ap, "class", "left").fillna(0, ["tp", "made"]).fillna(0.0, ["ap"])
    pr, rc = F.col("tp") / F.greatest(F.lit(1), "made"), F.col("tp") / F.col("n_truth")
    return out.select("class", "n_truth", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(2 * pr * rc / (pr + rc + 1e-16), 6).alias("f1"), "ap")


def unmatched(output: DataFrame, truth: DataFrame, id_col: str) -> DataFrame:
    """(id, error) of the documents that only one side has: the failures of a corpus run."""
    sides = [x.select(id_col).distinct().withColumn(n, F.lit(True)) for x, n in ((output, "o"), (truth, "t"))]
    both = sides[0].join(sides[1], id_col, "full_outer").where("o is null or t is null")
    return both.select(id_col, F.when(F.col("o").isNull(), "no output").otherwise("no truth").alias("error"))


def evaluate_corpus(output: DataFrame, truth: DataFrame, id_col: str, by: list[str], weights: tuple[int, int, int] = (2, 1, 1)) -> tuple[DataFrame, DataFrame]:
    """(a row of metrics for each document both sides have, their summary): missing words and edit accuracy. See unmatched() for the
    others, type_match() and cell_accuracy() for element types and tables."""
    missing = percent_missing(output, truth, id_col)
    pairs = truth.select(id_col, *by, F.col("text").alias("source")).join(output.select(id_col, F.col("text").alias("output")), id_col)
    rows = edit_distance(pairs, "output", "source", weights).drop("output", "source").join(missing, id_col)
    return rows, metric_summary(rows, "accuracy", by)
