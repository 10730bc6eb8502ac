import random

import pytest

from quillspark.llm.components import components


@pytest.mark.parametrize("most", [0, 500_000])
def test_components_of_random_links(spark, most):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)] + [(7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = [tuple(r) for r in components(spark.createDataFrame(links, "u long, v long"), most=most).collect()]
    assert sorted(got) == sorted((x, root(x)) for x in list(up))
    assert components(spark.createDataFrame([], "u long, v long"), most=most).count() == 0


def test_links_that_still_change_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)], "u long, v long").repartition(8)
    with pytest.raises(RuntimeError, match="raise rounds"):
        components(chain, rounds=1, most=0)


def test_a_chain_over_many_partitions_is_whole_or_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)], "u long, v long").repartition(64)
    with pytest.raises(RuntimeError, match="raise rounds"):
        components(chain, rounds=2, most=0)
    assert {r.component for r in components(chain, most=0).collect()} == {0}
