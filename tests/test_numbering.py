"""Dense numbers and running sums at sizes where ranges are sampled, for several numbers of partitions."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered, running


@pytest.fixture(params=[("true", 3), ("false", 8), ("true", 211)], ids=str)
def settings(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", request.param[0])
    spark.conf.set("spark.sql.shuffle.partitions", request.param[1])
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _wide(spark):
    """100,000 rows with wide texts, a third of them of one group, in no order."""
    h = F.xxhash64("id")
    return spark.range(0, 100_000, 1, 9).select(F.when(h % 3 == 0, F.lit(None)).otherwise(F.pmod(h, F.lit(50))).alias("g"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40)).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("wide"))


def test_numbers_are_dense_and_in_order(spark, settings):
    out = numbered(_wide(spark), "k").select("k", "number").collect()
    assert [r.number for r in sorted(out, key=lambda r: r.k)] == list(range(100_000))


def test_numbers_within_groups(spark, settings):
    groups = {}
    for r in numbered(_wide(spark), F.desc("k"), within=("g",)).select("g", "k", "number").collect():
        groups.setdefault(r.g, []).append((-r.k, r.number))
    assert len(groups) == 51
    for rows in groups.values():
        assert [n for _, n in sorted(rows)] == list(range(len(rows)))


def test_running_sums(spark, settings):
    groups = {}
    for r in running(_wide(spark), "k", of={"m": F.lit(1), "s": F.col("k") % 7}, within=("g",)).select("g", "k", "m", "s").collect():
        groups.setdefault(r.g, []).append((r.k, r.m, r.s))
    for rows in groups.values():
        total = 0
        for i, (k, m, s) in enumerate(sorted(rows)):
            total += k % 7
            assert (m, s) == (i + 1, total)


def test_ties_and_empty_tables(spark):
    same = spark.createDataFrame([(1, "a")] * 5 + [(None, "b")], "k long, t string")
    assert sorted(r.number for r in numbered(same, "k").collect()) == [0, 1, 2, 3, 4, 5]
    assert numbered(same, "k").where("k is null").first().number == 0
    assert numbered(same.where("false"), "k").count() == 0
