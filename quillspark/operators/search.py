"""Vector and keyword search over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def score(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Higher is nearer: cosine, or minus the Euclidean distance."""
    if metric == "cosine":
        return F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "l2":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    raise ValueError(metric)


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k nearest rows (id, score), ties by id. A filter comes before the scoring and reaches the scan."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, F.round(score(F.col(vec_col), q, metric), 6).alias("score")).orderBy(F.desc_nulls_last("score"), id_col).limit(k)


#: Rows and columns of a matrix of scores at a time.
_ROWS = 512


class _Best:
    """The k best scores of each query so far, ties by the smaller id; a score that is no number comes first, as Spark orders it."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.name = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def put(self, who: np.ndarray, scores: np.ndarray, names: np.ndarray) -> None:
        """Scores of the queries `who` (rows) and the ids `names` (columns)."""
        if not self.k or not scores.size:
            return
        scores = np.where(np.isnan(scores), np.inf, scores)
        last, tied = self.score[who, -1][:, None], self.name[who, -1][:, None]
        least = np.maximum(last, np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]) if scores.shape[1] > self.k else last
        r, c = np.nonzero((scores >= least) & ((scores > last) | (names[None, :] < tied)))
        if not len(r):
            return
        some = np.unique(r)
        row = np.concatenate([np.repeat(some, self.k), r])
        value = np.concatenate([self.score[who[some]].ravel(), scores[r, c]])
        name = np.concatenate([self.name[who[some]].ravel(), names[c]])
        order = np.lexsort((name, -value, row))
        row = row[order]
        first = np.searchsorted(row, some)
        take = order[(first[:, None] + np.arange(self.k)).ravel()]  # every query has its k old places at least
        self.score[who[some]], self.name[who[some]] = value[take].reshape(-1, self.k), name[take].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score)."""
        there = self.score > -np.inf
        values = self.score[there]
        return np.repeat(np.arange(len(there)), there.sum(1)), self.name[there], np.where(np.isinf(values), np.nan, values)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by cosine for each row of queries (query_id, vector), ties by id.

    Queries go to the tasks in blocks of at most `block` rows; vectors meet a block in matrix products of bounded size, and a task hands on
    the k best a query of all it reads, so neither its memory nor what is shuffled grows with the vectors it holds."""
    spark = vectors.sparkSession
    n = queries.count()
    parts = max(1, -(-n // block))
    dealt = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("p"))
    out = None
    for p in range(parts):
        rows = dealt.where(F.col("p") == p).select("query_id", "vector").collect()
        if not rows:
            continue
        sent = spark.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.vector for r in rows], np.float64)))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            q, ids = _unit(q), np.array(ids, np.int64)
            best = _Best(len(ids), k)
            for b in batches:
                b = b[b["v"].notna()]
                for i0 in range(0, len(b), _ROWS):
                    part = b[i0 : i0 + _ROWS]
                    v, own = _unit(np.stack(part["v"].to_numpy()).astype(np.float64)), part["i"].to_numpy()
                    for j in range(0, len(q), _ROWS):
                        best.put(np.arange(j, min(len(q), j + _ROWS)), np.round(q[j : j + _ROWS] @ v.T, 6), own)
            who, names, values = best.rows()
            yield pd.DataFrame({"query_id": ids[who], "vec_id": names, "score": values})

        near = vectors.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).mapInPandas(run, "query_id long, vec_id long, score double")
        if parts > 1:  # written before the next block is read: driver and executors hold one at a time
            near = written(near, "knn-block")
            sent.destroy()
        out = near if out is None else out.unionByName(near)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centre, its distance without the row's own length), some rows at a time."""
    of, far, own = np.empty(len(x), np.int64), np.empty(len(x)), (c**2).sum(1)
    for i in range(0, len(x), _ROWS):
        d = own - 2 * x[i : i + _ROWS] @ c.T
        of[i : i + _ROWS] = d.argmin(1)
        far[i : i + _ROWS] = d.min(1)
    return of, far


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means of a sample: centres start at rows drawn without repeats, empty ones move to the rows that lie worst."""
    different = np.unique(x, axis=0)
    c = different[rng.permutation(len(different))[:k]]
    for _ in range(rounds):
        of, far = _nearest(x, c)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-far)[: len(empty)]]
    return c


@dataclass
class Index:
    """An inverted file with residual product codes.

    centres: the cells' centres; books: for each stretch of dimensions its code words; cuts: where the stretches begin; rows:
    (cell, vec_id, code) of every vector, in the shared folder, ordered by cell; sizes: rows of each cell that has any."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    rows: DataFrame
    sizes: dict[int, int]

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code words) of unit vectors."""
        cell = _nearest(x, self.centres)[0]
        rest = x - self.centres[cell]
        words = [_nearest(rest[:, i : i + b.shape[1]], b)[0] for i, b in zip(self.cuts, self.books)]
        return cell, np.stack(words, 1).astype(np.uint8)


def vector_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 20_000, width: int = 4, seed: int = 7) -> Index:
    """An Index of every vector that isn't null. It has about as many cells as the square root of the rows, but a sixteenth of the sample at most;
    centres and code words (256 for each `width` dimensions) are fitted on a sample of at most `sample` rows, drawn by a hash of the
    id, and all rows are then coded by it."""
    spark = vectors.sparkSession
    real = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    n = real.count()
    drawn = real.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < min(1.0, 2 * sample / max(1, n)) * (1 << 40)).limit(sample).select("v").collect()
    if not drawn:
        return Index(np.zeros((1, 1)), [np.zeros((1, 1))], [0], spark.createDataFrame([], "cell int, vec_id long, code binary"), {})
    x, rng = _unit(np.array([r.v for r in drawn], np.float64)), np.random.default_rng(seed)
    cells = max(1, min(int(np.ceil(np.sqrt(n))), max(1, len(x) // 16)))
    centres = _centres(x, cells, rng)
    rest = x - centres[_nearest(x, centres)[0]]
    cuts = list(range(0, x.shape[1], width))
    index = Index(centres, [_centres(rest[:, i : i + width], 256, rng) for i in cuts], cuts, None, {})

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, words = index.code(_unit(np.stack(b["v"].to_numpy()).astype(np.float64)))
                yield pd.DataFrame({"cell": cell.astype(np.int32), "vec_id": b["vec_id"], "code": [w.tobytes() for w in words]})

    rows = real.mapInPandas(code, "cell int, vec_id long, code binary")
    rows = written(rows.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"), "vector-index")
    return Index(centres, index.books, cuts, rows, {r.cell: r.n for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()})


def index_search(index: Index, vectors: DataFrame, queries: DataFrame, k: int, share: float = 0.65, rerank: int = 64, block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, vec_id, score, rank, rescored): about the k nearest by cosine for each row of queries (query_id, vector).

    A query goes to the cells nearest to it until they hold `share` of the rows (all of them with share=1); vectors without structure
    need a large share, clustered ones a small one. Queries go to the tasks in blocks of at most `block`; a task reads codes, a
    sixteenth of the vectors or less, looks up their code words and meets a cell's rows with the queries that go there in one matrix
    product. It keeps the `rerank` best of each query over all it reads. Only those are scored exactly (rescored: how many), in a
    join that reads no other vectors' values into Python."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, vec_id long")
    cells = np.array(sorted(index.sizes), np.int64)
    if not len(cells):
        return none.selectExpr("*", "0D as score", "0 as rank", "0L as rescored")
    size, centres, books = np.array([index.sizes[c] for c in cells.tolist()]), index.centres, index.books
    n = queries.count()
    parts = max(1, -(-n // block))
    dealt = queries.where("vector is not null").select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("p"))
    near = none
    for p in range(parts):
        rows = dealt.where(F.col("p") == p).select("query_id", "vector").collect()
        if not rows:
            continue
        ids, q = np.array([r.query_id for r in rows], np.int64), _unit(np.array([r.vector for r in rows], np.float64))
        order = np.argsort((centres[cells] ** 2).sum(1) - 2 * q @ centres[cells].T, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        goes = np.zeros((len(ids), len(centres)), bool)
        np.put_along_axis(goes, cells[order], before < share * size.sum(), 1)
        sent = spark.sparkContext.broadcast((ids, q, goes))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, q, goes = sent.value
            best = _Best(len(ids), rerank)
            for b in batches:
                b = b.sort_values(["cell", "vec_id"])
                words = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1)
                cell, own = b["cell"].to_numpy(), b["vec_id"].to_numpy()
                first = np.flatnonzero(np.concatenate([cell[:1] >= 0, cell[1:] != cell[:-1]]))
                for i, j in zip(first, np.append(first[1:], len(cell))):
                    who = np.flatnonzero(goes[:, cell[i]])
                    for i0 in range(i, j, _ROWS):  # rows of a cell that meet the queries at a time
                        i1 = min(j, i0 + _ROWS)
                        x = centres[cell[i]] + np.concatenate([book[words[i0:i1, m]] for m, book in enumerate(books)], 1)
                        for w in range(0, len(who), _ROWS):
                            best.put(who[w : w + _ROWS], np.round(q[who[w : w + _ROWS]] @ x.T, 9), own[i0:i1])
            who, names, about = best.rows()
            yield pd.DataFrame({"query_id": ids[who], "vec_id": names, "about": about})

        found = index.rows.mapInPandas(scan, "query_id long, vec_id long, about double")
        w = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
        found = written(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= rerank).select("query_id", "vec_id"), "vector-candidates")
        sent.destroy()
        near = near.unionByName(found)
    exact = near.join(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")), "vec_id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    w = Window.partitionBy("query_id")
    scored = exact.select("query_id", "vec_id", F.round(score(F.col("v"), F.col("q")), 6).alias("score"))
    scored = scored.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("score"), "vec_id")), "rescored": F.count(F.lit(1)).over(w)})
    return scored.where(F.col("rank") <= k)


def knn_probe(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", **settings) -> DataFrame:
    """Approximate knn_batch: index_search() in a vector_index() made for the purpose."""
    return index_search(vector_index(vectors, id_col, vec_col), vectors, queries, k, id_col=id_col, vec_col=vec_col, **settings)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact (query_id, vec_id) that the approximate result has."""
    hit = exact.select("query_id", "vec_id").join(approximate.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def vector_audit(vectors: DataFrame, by: str = "label", vec_col: str = "embedding", tolerance: float = 1e-4) -> DataFrame:
    """(by, dim, n, n_unit): rows by dimension, and how many have length one."""
    return vectors.groupBy(by, F.size(vec_col).alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(norm(F.col(vec_col)) - 1) <= tolerance).alias("n_unit"))


def embed(df: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]] | None = None, dims: int = 256, out: str = "embedding") -> DataFrame:
    """df with an embedding a row: of `encode` (batch of texts to as many vectors, called batch by batch), or without one of
    hashed words, normalised."""
    if encode is None:
        from pyspark.ml.feature import HashingTF, Normalizer
        from pyspark.ml.functions import vector_to_array

        rows = df.withColumn("_w", F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"))
        rows = Normalizer(inputCol="_t", outputCol="_n").transform(HashingTF(numFeatures=dims, inputCol="_w", outputCol="_t").transform(rows))
        return rows.withColumn(out, vector_to_array("_n", "float32")).drop("_w", "_t", "_n")

    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        got = list(encode(t.fillna("").tolist()))
        if len(got) != len(t):
            raise ValueError(f"{len(t)} texts gave {len(got)} vectors")
        return pd.Series(got)

    return df.withColumn(out, run(text))


def keyword_search(df: DataFrame, word: str, *columns: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(word.lower()))
    return df.where(hit)
