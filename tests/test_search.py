"""The vector index against exact search."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import search


def _asked(v):
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _set(df):
    return sorted((r.query_id, r.vec_id, r.score, r.rank) for r in df.collect())


def test_recall_with_few_rows_scored_exactly(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index, exact = search.vector_index(v), _set(search.knn_batch(v, _asked(v), 10))
    n = v.count()
    assert sum(index.sizes.values()) == n and len(index.sizes) <= np.ceil(np.sqrt(n))
    rows = search.index_search(index, v, _asked(v), 10, block=16).collect()
    assert {r.rescored for r in rows} == {64} and 64 < 0.05 * n
    assert len({(r.query_id, r.vec_id) for r in rows} & {x[:2] for x in exact}) >= 0.9 * len(exact)
    whole = search.index_search(index, v, _asked(v), 10, share=1, rerank=400)
    assert _set(whole) == exact


def test_equal_vectors_nulls_and_empty_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(400)] + [(400 + i, [float(x) for x in rng.normal(size=5)]) for i in range(300)] + [(9000, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    index = search.vector_index(v)
    assert sum(index.sizes.values()) == 700
    q = v.where("vec_id in (0, 450, 500)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert _set(search.index_search(index, v, q, 7, share=1, rerank=300)) == _set(search.knn_batch(v, q, 7))
    assert search.index_search(search.vector_index(v.where("false")), v, q, 3).count() == 0
    assert search.index_search(index, v, q.where("false"), 3).count() == 0


def test_best_in_tiles_equals_a_sort():
    rng = np.random.default_rng(5)
    scores = np.round(rng.integers(0, 9, (7, 400)) / 8, 6)
    scores[2, [5, 300]], names = np.nan, rng.permutation(400)
    for k in (1, 5, 500):
        best = search._Best(7, k)
        for i in range(0, 400, 33):
            best.put(np.array([0, 2, 3, 6]), scores[[0, 2, 3, 6], i : i + 33], names[i : i + 33])
        who, found, values = best.rows()
        for q in (0, 2, 3, 6):
            order = np.lexsort((names, -np.where(np.isnan(scores[q]), np.inf, scores[q])))[:k]
            assert found[who == q].tolist() == names[order].tolist()
            assert np.array_equal(values[who == q], scores[q][order], equal_nan=True)
        assert not np.isin([1, 4, 5], who).any()


def test_nearest_centres_some_rows_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(20_000, 8)), rng.normal(size=(500, 8))
    want = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
    tracemalloc.start()
    got = search._nearest(x, c)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == want.tolist()
    assert most < 20e6  # all at once: 80 MB and more
