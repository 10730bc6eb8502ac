import pytest

DATA = "/root/testdata/sf0.001"

#: Awkward rows: nulls, empty, white space, ties, repeated rows, a long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "same words here " * 9), (5, "same words here " * 9), (5, "same words here " * 9), (6, "x" * 30000), (7, "a b c d e f g h i j " * 3000), (None, "no id but a text"), (8, "é ñ ß 漢字 😀 ok")]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward rows with columns whose names clash with those the operators use inside."""
    rows = [(i, t, None if i == 2 else "en", None if i == 3 else "s", 0, "h", "t", "b") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, t string, block string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
