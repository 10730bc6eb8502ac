"""Every registered query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from quillspark.plans import catalog, evaluation_queries, table_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
ROWS_ONLY = [n for n in catalog.QUERIES if n not in catalog.ORACLES]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([_plain(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(str([_plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
