"""Literal cases, invariants and plain models of operators that SQL doesn't check."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import classify, entries, evaluate, language, search, segment
from quillspark.sources import files
from quillspark.streaming import ingest


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (T.drop_bullet, "●  An excellent point!", "An excellent point!"),
        (T.drop_bullet, "no bullet", "no bullet"),
        (T.drop_ordered_bullet, "1.1 An important point", "An important point"),
        (T.drop_ordered_bullet, "a.b.  two   words", "two words"),
        (T.drop_ordered_bullet, "..1 stays", "..1 stays"),
        (T.drop_ordered_bullet, "", ""),
        (T.expand_ligatures, "The beneﬁts of ﬂow", "The benefits of flow"),
        (T.repair_quotes, "\x93What a quote!\x94", "“What a quote!”"),
        (T.standard_quotes, "«a» ‘b’", "\"a\" 'b'"),
        (T.squeeze_spaces, "ITEM 1.     BUSINESS \n x", "ITEM 1. BUSINESS x"),
        (T.drop_dashes, "ITEM 1. -BUSINESS", "ITEM 1.  BUSINESS"),
        (T.drop_trailing_punctuation, "ITEM 1. BUSINESS. ", "ITEM 1. BUSINESS"),
        (lambda c: T.drop_prefix(c, "SUMMARY|TITLE", True), "summary: A fine day", "A fine day"),
        (lambda c: T.drop_postfix(c, "END"), "The END", "The"),
        (lambda c: T.text_before(c, "TEETH", 0), "A TEETH B TEETH C", "A"),
        (lambda c: T.text_after(c, "TEETH", 1), "A TEETH B TEETH C", "C"),
        (lambda c: T.text_after(c, "TEETH", 2), "A TEETH B TEETH C", None),
        (T.regroup_paragraphs, "A line of some words\nand one more line\n\nShort one\nLicense 2.0", "A line of some words and one more line\n\nShort one\n\nLicense 2.0"),
        (T.is_title, "A short heading", True),
        (T.is_title, "ends with a comma,", False),
        (T.is_narrative, "This is one full sentence here. And this is another full one.", True),
        (T.is_numbered, "1. first", True),
        (T.element_type, "- item", "ListItem"),
        (T.is_academic, "Abstract: we show \\frac{1}{2}", True),
        (T.promoted_heading, "13.3.3 Summary of it\nmore", "13.3.3 Summary of it"),
        (T.promoted_heading, "**Bold one** then text", "Bold one"),
    ],
)
def test_text(spark, fn, text, want):
    assert one(spark, text, fn) == want


@pytest.mark.parametrize("title, content, want", [("To cable it:", "1. do this", "sop_step"), ("**Setup procedure**", "", "sop_step"), ("x", "1. a\n2. b\n3. c", "sop_step"), ("How to reset", "", "faq"), ("What is this", "", "faq"), ("Chapter 2", "", "manual_section"), ("Else", "", "general")])
def test_knowledge_type(spark, title, content, want):
    df = spark.createDataFrame([(title, content)], "a string, b string")
    assert df.select(classify.knowledge_type(F.col("a"), F.col("b"))).first()[0] == want


def test_keywords(spark):
    assert one(spark, 'The USB and LAN ports. Printer setup. Step 2 of "quick start"', classify.keywords) == ["USB", "LAN", "Printer", "Step", "Step 2", "quick start", "setup"]


def test_first_rule_wins(spark):
    df = spark.createDataFrame([("hp_router.pdf",), ("kb.netgear",), ("nothing",)], "f string")
    assert [r.company for r in classify.infer_company(df, "f").collect()] == ["HP", "NETGEAR", "Unknown"]


def test_chunks_hold_their_size_order_and_text(spark):
    rng = random.Random(1)
    rows = [(d, s, rng.choice(["Title", "NarrativeText", "Table", "CodeSnippet"]), " ".join("w" * rng.randrange(1, 30) for _ in range(rng.randrange(0, 60)))) for d in range(12) for s in range(15)]
    df = spark.createDataFrame(rows, "doc long, seq long, type string, text string")
    for chunks in (segment.chunk_basic(df, "doc", "seq", most=200), segment.chunk_by_title(df, "doc", "seq", most=200, combine_under=80)):
        by: dict = {}
        for r in sorted(chunks.collect(), key=lambda r: (r.doc, r.chunk_seq)):
            assert 0 < len(r.text) <= 200
            by.setdefault(r.doc, []).append(r.text)
        for d in range(12):
            assert "".join("".join(by.get(d, [])).split()) == "".join("".join(r[3] for r in rows if r[0] == d).split())


def test_cut_piece():
    assert segment.cut_piece("aaa bbb ccc", 7, (" ",), 0) == ["aaa bbb", "ccc"]
    assert segment.cut_piece("a" * 10, 4, (" ",), 0) == ["aaaa", "aaaa", "aa"]
    assert segment.cut_piece("one two three four", 9, (" ",), 3) == ["one two", "two three", "ree four"]
    assert segment.cut_piece("", 4, (" ",), 0) == []


def test_parents(spark):
    rows = [(1, 0, "Header", None), (1, 1, "Title", 0), (1, 2, "Title", 1), (1, 3, "Text", None), (1, 4, "Title", 0), (1, 5, "ListItem", 0), (1, 6, "ListItem", 1)]
    df = spark.createDataFrame(rows, "doc long, seq long, type string, category_depth int")
    assert {r.seq: r.parent_seq for r in segment.parents(df, "doc", "seq").collect()} == {0: None, 1: 0, 2: 1, 3: 2, 4: 0, 5: 4, 6: 5}


def test_words_single_characters(spark):
    assert one(spark, "h e l l o world a 7 - don't", evaluate.words_of) == ["world", "don't"]
    assert one(spark, "the a cat, I ran", evaluate.words_of) == ["the", "a", "cat", "i", "ran"]


def test_percent_missing(spark):
    out = spark.createDataFrame([(1, "the cat"), (2, "")], "id long, text string")
    src = spark.createDataFrame([(1, "the cat and the dog"), (2, "")], "id long, text string")
    assert {r.id: r.pct_missing for r in evaluate.percent_missing(out, src, "id").collect()} == {1: 0.6, 2: 0.0}


def test_edit_distance_weights(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("abc", "abcd"), ("abcde", "abcd"), ("a", "abcdefgh")], "o string, s string")
    rows = [(r.o, r.distance, r.accuracy) for r in evaluate.edit_distance(df, "o", "s").collect()]
    assert sorted(rows) == [("a", None, 0.01), ("abc", 2, 0.5), ("abcd", 1, 0.75), ("abcde", 1, 0.75)]


def test_metric_summary_of_few_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, v double")
    got = {(r.grouping, r.value): tuple(r)[2:] for r in evaluate.metric_summary(df, "v", ["k"]).collect()}
    assert got[("k", "a")] == (1.0, None, None, 2) and got[("k", "b")] == (None, None, None, 1) and got[("all", "all")] == (1.0, None, None, 3)


def test_detection(spark):
    truth = spark.createDataFrame([(1, "x", 0.0, 0.0, 10.0, 10.0), (1, "x", 20.0, 20.0, 30.0, 30.0)], "page long, class string, x1 double, y1 double, x2 double, y2 double")
    pred = spark.createDataFrame([(1, "x", 0.9, 0.0, 0.0, 10.0, 10.0), (1, "x", 0.8, 0.0, 0.0, 10.0, 9.0), (1, "x", 0.7, 20.0, 20.0, 30.0, 30.0)], "page long, class string, score double, x1 double, y1 double, x2 double, y2 double")
    r = evaluate.detection(pred, truth).first()
    assert (r.precision, r.recall) == (round(2 / 3, 6), 1.0) and r.ap == pytest.approx((51 + 50 * 2 / 3) / 101, abs=1e-6)


def test_tables(spark):
    html = "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    cells = evaluate.table_cells(spark.createDataFrame([("d", html)], "doc string, text_as_html string"), "doc")
    assert sorted((r.row, r.col, r.text) for r in cells.collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2")]
    r = evaluate.cell_accuracy(cells, cells, "doc").first()
    assert (r.row_accuracy, r.col_accuracy) == (1.0, 1.0)


def test_approximate_search_finds_most(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert search.recall(search.knn_probe(v, q, 10), search.knn_batch(v, q, 10)).first().recall >= 0.9


def test_updates(spark):
    e = spark.createDataFrame([("1", "general", None, None), ("2", "faq", None, None)], "id string, type string, llm_type string, llm_confidence double")
    r = spark.createDataFrame([("2", "sop_step", 0.9)], "id string, llm_type string, llm_confidence double")
    assert sorted(tuple(x[c] for c in ("id", "type", "changed")) for x in entries.apply_results(e, r).collect()) == [("1", "general", False), ("2", "sop_step", True)]
    with pytest.raises(ValueError):
        entries.filter_list(e, e.where("false"), "id")
    assert entries.store_analysis(e.where("false")).first().pct_classified is None


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1,5;2\n3;4\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "a.csv")).collect()] == [("1,5", "2"), ("3", "4")]
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    assert files.read_delimited(spark, str(tmp_path / "b.tsv")).columns == ["x", "y"]
    (tmp_path / "c.ndjson").write_text('{"a": 1}\n{broken\n\n{"a": 2}\n')
    good, bad = files.read_ndjson(spark, str(tmp_path / "c.ndjson"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["{broken"]
    (tmp_path / "d.xml").write_text("<r><c><n>A</n><l>x</l></c><c><n>B</n><l>y</l></c></r>")
    assert [r.n for r in files.read_xml_leaves(spark, str(tmp_path / "d.xml"), "c").collect()] == ["A", "B"]
    (tmp_path / "e.txt").write_bytes(b"ok")
    (tmp_path / "f.txt").write_bytes(b"\xff\xfe bad")
    texts, dead = files.read_text(files.scan_corpus(spark, str(tmp_path), include=["txt"]))
    assert [r.text for r in texts.collect()] == ["ok"] and dead.count() == 1


def test_envelope_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("1", "faq", "T", "C", "s.pdf", 1, ["k"], "2024", {"company": "HP"}), ("2", "general", "U", "D", "s.pdf", 2, [], "2024", {})], "id string, type string, title string, content string, source_file string, source_page int, keywords array<string>, created_at string, metadata map<string,string>")
    files.write_kb_json(e, str(tmp_path / "kb"))
    back = files.read_kb_json(spark, str(tmp_path / "kb"))
    assert sorted((r.id, r.title, r.source_file) for r in back.collect()) == [("1", "T", "s.pdf"), ("2", "U", "s.pdf")]
    assert entries.violations(back).count() == 0


def test_pages_and_exports(spark):
    html = "<html><body><nav><li>no</li></nav><main><h2>Head</h2><p>A <b>bold</b> text</p><ul><li>item</li></ul><pre>x = 1</pre></main></body></html>"
    got = files.page_elements(spark.createDataFrame([(1, html)], "page_id long, html string")).orderBy("seq").collect()
    assert [(r.type, r.text.strip(), r.depth) for r in got] == [("Title", "Head", 1), ("NarrativeText", "A bold text", None), ("ListItem", "item", None), ("CodeSnippet", "x = 1", None)]
    el = spark.createDataFrame([("e1", "Title", "T")], "element_id string, type string, text string")
    for shape in files.EXPORTS:
        assert files.export_records(el, shape).first().record.startswith("{")
    with pytest.raises(ValueError):
        files.export_records(el, "prodigy", side=spark.createDataFrame([("nope", 1)], "element_id string, n int"))


def test_coco(spark):
    el = spark.createDataFrame([("f", 1, "Title", 0.0, 0.0, 2.0, 3.0), ("f", 2, "Table", 0.0, 0.0, 1.0, 1.0)], "filename string, page_number int, type string, x1 double, y1 double, x2 double, y2 double")
    images, kinds, notes = files.to_coco(el)
    assert images.count() == 2 and kinds.count() == 2 and sorted(r.area for r in notes.collect()) == [1.0, 6.0]


def test_incremental_ingest_takes_each_text_once(spark, tmp_path):
    src, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    line = "A first paragraph of some length"
    df = spark.createDataFrame([("a.txt", line)], "source_file string, text string")
    for _ in range(2):  # the same text again in a new file
        df.write.mode("append").json(src)
        ingest.ingest(spark, src, store, mark).awaitTermination()
    assert spark.read.parquet(store).count() == 1


def test_keywords_keep_their_numbers_and_skip_openers(spark):
    assert one(spark, "They met. What now. Paper Step 4 and Section 12", classify.keywords) == ["Paper", "Step 4", "Section 12"]


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (T.is_city_state_zip, "Doylestown, PA 18901", True),
        (T.is_city_state_zip, "Doylestown, Pennsylvania, 18901", True),
        (T.is_city_state_zip, "no place at all", False),
        (T.has_phone, "Phone: 555-867-5309 x12", True),
        (T.has_phone, "Phone: 55", False),
        (T.has_verb, "It is over", True),
        (T.has_verb, "A red door", False),
        (T.element_type, "Austin, TX 78701", "Address"),
        (T.display_source, "a" * 41, "a" * 37 + "..."),
        (T.repair_math, "p#e and #(x) and #e =", "p$\\mu$e and $\\mu$(x) and $\\mu$e ="),
    ],
)
def test_more_text(spark, fn, text, want):
    assert one(spark, text, fn) == want


def test_split_by_the_named_strategy(spark):
    marked = "intro text\n# One\nbody one\n## Two\nbody two\n### Three\nbody three"
    plain = "x" * 210 + "\nChapter 1 Start\nsome words\nChapter 2 Middle\nmore words\nChapter 3 End\nlast words"
    paras = "The first paragraph of text.\n\nAnother one."
    df = spark.createDataFrame([(1, marked), (2, plain), (3, paras)], "id int, text string")
    got = {}
    for r in segment.split_by_strategy(df, "id").orderBy("id", "seq").collect():
        got.setdefault((r.id, r.strategy), []).append((r.title, r.content))
    assert got[1, "markdown"][1:] == [("One", "body one"), ("Two", "body two"), ("Three", "body three")]
    assert got[2, "plaintext"] == [("Chapter 1 Start", "Chapter 1 Start\nsome words"), ("Chapter 2 Middle", "Chapter 2 Middle\nmore words"), ("Chapter 3 End", "Chapter 3 End\nlast words")]
    assert [t for t, _ in got[3, "paragraph"]] == ["The first paragraph of text."]


def test_models_are_asked_batch_by_batch(spark):
    df = spark.createDataFrame([(i, f"t{i}", f"c{i}") for i in range(7)], "id long, title string, content string")
    asked = entries.prompts(entries.llm_batches(df, 3))
    answers = entries.ask(asked, lambda ps: ["[" + ",".join('{"type":"faq","confidence":0.5}' for _ in range(p.count("Title: "))) + "]" for p in ps])
    got = entries.batch_results(answers)
    assert sorted(r.id for r in got.collect()) == list(range(7)) and {r.llm_type for r in got.collect()} == {"faq"}
    with pytest.raises(Exception, match="answers"):
        entries.ask(asked, lambda ps: []).collect()


def test_type_filter_takes_one_list(spark):
    df = spark.createDataFrame([("a",), ("b",)], "type string")
    assert entries.filter_types(df, include=["a"]).count() == entries.filter_types(df, exclude=["a"]).count() == 1
    for k in ({}, {"include": ["a"], "exclude": ["b"]}):
        with pytest.raises(ValueError):
            entries.filter_types(df, **k)


def test_overlap_only_where_an_element_was_cut(spark):
    df = spark.createDataFrame([(1, 0, "aaa bbb", False), (1, 1, "ccc", True), (1, 2, "ddd", False)], "d int, chunk_seq int, text string, is_continuation boolean")
    assert [r.text for r in segment.overlapped(df, "d", 4).orderBy("chunk_seq").collect()] == ["aaa bbb", "bbb ccc", "ddd"]
    assert [r.text for r in segment.overlapped(df, "d", 3, all_chunks=True).orderBy("chunk_seq").collect()] == ["aaa bbb", "bbb ccc", "ccc ddd"]


def test_languages_beyond_any_number_are_told(spark):
    names = [f"l{i:04d}" for i in range(1200)]
    pair = lambda i: chr(97 + i // 26 % 26) + chr(97 + i % 26) + chr(0x3B1 + i // 676)
    df = spark.createDataFrame([(i, f"{pair(i)} " * 30, n) for i, n in enumerate(names)], "id int, text string, lang string")
    found = language.detect(df, language.profiles(df), "id")
    assert df.join(found, "id").where("lang = detected").count() == 1200
    short = spark.createDataFrame([("a b", "fr"), ("é b", "fr"), (" ", "fr"), ("one two three four five", "de")], "t string, d string").select(language.short_ascii(F.col("t"), F.col("d")).alias("x"))
    assert [r.x for r in short.collect()] == ["en", "fr", None, "de"]


def test_languages_are_told_where_a_text_is_read(spark, monkeypatch):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "le chat et le chien", "fr"), (4, None, "fr"), (5, "12 !", None), (6, "und the Katze", None), (6, "der Chien", None), (7, "x", "en"), (8, "漢字", None)]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    learnt = language.profiles(df)
    found = language.detect(df, learnt, "id")
    assert "(?=" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each place of a text
    got = sorted(map(tuple, found.collect()), key=str)
    assert got[:3] == [(1, "en"), (2, "de"), (3, "fr")] and {d for i, d in got if i in (4, 5, 7, 8)} == {None}
    monkeypatch.setattr(language, "_CELLS", 0)
    assert got == sorted(map(tuple, language.detect(df, learnt, "id").collect()), key=str)


def test_envelopes_have_bounded_parts(spark):
    df = spark.createDataFrame([(str(i), "a" if i < 90 else None) for i in range(100)], "id string, source_file string")
    got = files.envelopes(df, most=20).collect()
    assert sum(r.total_entries for r in got) == 100 and sum(r.total_entries for r in got if r.source_file is None) == 10
    assert len(got) > 3 and all(len(r.entries) == r.total_entries for r in got)


def test_rows_of_tables_over_the_limit_are_split_by_cell_and_text(spark):
    html = "<table><tr><th>A</th></tr><tr><td>one</td><td>" + "word " * 12 + "</td></tr><tr><td>" + "x" * 45 + "</td><td>two</td></tr></table>"
    got = segment.chunk_tables(spark.createDataFrame([(1, html)], "id int, text_as_html string"), "id", most=30).orderBy("chunk_index").collect()
    assert all(len(r.text) <= 32 for r in got) and all(r.text.startswith("A ") for r in got)  # the header is carried on top
    words = " ".join(r.text[2:] for r in got).split()
    assert words == ["one", *["word"] * 12, "x" * 30, "x" * 15, "two"]


def test_element_rows_go_to_a_database(spark):
    df = spark.createDataFrame([("a", ["x", "y"], (1, "t"))], "id string, tags array<string>, meta struct<n:int,s:string>")
    url = "jdbc:derby:memory:quill;create=true"
    files.write_element_rows(df, url, "elements", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    back = spark.read.jdbc(url, "elements", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}).collect()
    assert [(r.id, r.tags, r.meta_n, r.meta_s) for r in back] == [("a", '["x","y"]', 1, "t")]
