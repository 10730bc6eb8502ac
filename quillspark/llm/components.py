"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_join, to_arrow, written

_LINK = "u long, v long"


def _forest(links: DataFrame) -> DataFrame:
    """Within each partition, links replaced by one from each node to the least node it is joined with there."""
    shape = to_arrow(_LINK, links.sparkSession)

    def run(batches):
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u, v = sorted((root(u), root(v)))
                parent[v] = u
        pairs = np.array([(x, root(x)) for x in parent], np.int64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for a in range(0, len(pairs), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[a : a + 50_000, k]) for k in (0, 1)], schema=shape)

    return links.mapInArrow(run, _LINK)


def components(links: DataFrame, rounds: int = 60, most: int = 500_000) -> DataFrame:
    """(node, component) of every node with a link: component is the least node it is joined with.

    Up to `most` links (counted first; some 100 MB in a task) are joined in one task. Beyond that, steps repeat until the links
    no longer change. None are collected to the driver. A hot node's links meet only in a minimum, and are split by salt
    where each takes it up."""
    now = written(_forest(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")), "links")
    mark = None
    small = now.limit(most + 1).count() <= most
    if small:
        now = written(_forest(now.coalesce(1)), "links")
    for _ in range(0 if small else rounds):
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == mark or not n:
            break
        mark = (n, total)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = sized_join(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        steps = sized_join(down, least, ["u"], "inner").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        now = written(steps.where("u <> v").distinct(), "links")
    else:
        if not small:
            raise RuntimeError("links still change; raise rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
