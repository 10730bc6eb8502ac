from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontam, quality

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_the_one_before_kept(spark, docs):
    from tests.llm.test_near_dup import brute as near

    now = docs.orderBy("doc_id")
    out = dict(corpus_pipeline.STAGES)
    one = out["quality rules"](spark, docs, SF)
    kept = {r.id for r in quality.stats(docs).collect() if r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words}
    assert {r.doc_id for r in one.collect()} == kept and one.columns == now.columns
    two = out["near duplicates"](spark, one, SF)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == {i for i, _, c, _ in near(rows) if i == c}
    three = out["decontamination"](spark, two, SF)
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in two.collect() if any(x in decontam.normal(r.text) for x in items)}
    assert {r.doc_id for r in two.collect()} - {r.doc_id for r in three.collect()} >= dirty
    four = out["personal data"](spark, three, SF)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect()}
    texts = {r.doc_id: r.text for r in four.collect()}
    assert not any("@mail" in t for t in texts.values())
    five = out["packing"](spark, four, SF)
    assert {r.doc_id for r in five.collect()} == set(texts)


def test_odd_rows_pass_through_all_stages(spark, odd, empty):
    for df in (odd, empty):
        df = df.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, SF)
        df.count()


def test_rows_without_an_id_and_repeated_rows_are_judged(spark, docs):
    """Every stage decides on rows: copies of documents without an id, and rows that are equal, get what the documents get."""
    rows = docs.orderBy("doc_id").limit(60)
    more = rows.withColumn("doc_id", F.lit(None).cast("long")).unionByName(rows.limit(5)).withColumn("_gone", F.lit(1))
    out = dict(corpus_pipeline.STAGES)
    one = out["quality rules"](spark, more, SF)
    alone = out["quality rules"](spark, rows, SF)
    assert {r.text for r in one.collect()} == {r.text for r in alone.collect()} and one.columns == more.columns
    two = out["near duplicates"](spark, one, SF)
    texts = [r.text for r in two.collect()]
    assert len(texts) == len(set(texts)) == out["near duplicates"](spark, alone, SF).count()
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = spark.createDataFrame([(None, "before " + items[0] + " after", 1), (1, "a clean one", 2)], "doc_id long, text string, _hit int")
    assert [r._hit for r in out["decontamination"](spark, dirty, SF).collect()] == [2]
