"""Leaves of XML texts, and the query against its SQL where documents have blank, missing or marked-up values."""

from collections import Counter

import duckdb
import pytest

from quillspark.plans import catalog, table_queries  # noqa: F401
from quillspark.sources import files


@pytest.mark.parametrize(
    "xml, want",
    [
        ("<a>x</a><b></b><c>y</c>", [(0, "x"), (2, "y")]), ("<a>x</a><b/>z<c> \n</c><d k='v' />y", [(0, "x"), (2, "z"), (5, "y")]), ("<a><b><!-- n --></b></a>y<?p q?>", [(1, "y")]), ("<a><b>\tx </b> <c>y</c>\f</a>", [(0, "x"), (1, "y")]),
        ("<a>&lt;b&gt; &amp;lt; &#38;gt; &quot;&apos;</a>", [(0, "<b> &lt; &gt; \"'")]), ("<a> &#32;&#x41;&#128512;&#xFEFF; </a>", [(0, " A\U0001f600\ufeff")]), ("<a>AT&T &no; &#0; &#xD800; &#x110000; &#; &</a>", [(0, "AT&T &no; &#0; &#xD800; &#x110000; &#; &")]),
        ("<a>1 > 0</a><b>x/>y</b><", [(0, "1 > 0"), (1, "x/>y"), (2, "<")]), ("\x0b", [(0, "\x0b")]), ("<a></a>", []), ("", []), (None, []),
    ],
)
def test_leaves(spark, xml, want):
    rows = files.xml_leaves(spark.createDataFrame([(1, xml)], "id long, text string"), "id")
    assert sorted((r.seq, r.text) for r in rows.collect()) == want


def test_query_on_odd_documents_equals_its_sql(spark, tmp_path):
    texts = ["plain", "", " ", None, "\t\n \f\r", "\x0bx\x0b ", "\n\n a\n\nb \r\n", " <b>x</b> &amp; <!-- y --> ", "\x00", "\xa0\xe9\U0001f600\u2003"]
    sides = ["src1", "", " ", None, " s\n", "\x0bs", "a<b>c</b>&amp;d", "&#32;", "<!-- x", "s/>", "\xa0\xe9"]
    rows = [(t, s, l) for t in texts for s in sides for l in sides]
    df = spark.createDataFrame([(None if i % 97 == 0 else i // 2, *r, 0) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(tuple(r) for r in catalog.QUERIES["xml_leaves"](spark, str(tmp_path)).select("doc_id", "seq", "text").collect())
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(duck.execute(f"select doc_id, seq, text from ({catalog.ORACLES['xml_leaves']})").fetchall())
