"""One evaluation run over a corpus: texts, element types and tables against the truth, summed up, with what failed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.files import documents_text
from ..sources.scratch import written
from . import evaluate, table_eval


@dataclass
class Run:
    """rows: a row a document of both sides with all metrics (null where a branch has nothing to say); summary: (metric, grouping, value,
    average, sample_sd, population_sd, count); failures: (doc, error) of documents that one side lacks; counts: what was done."""

    rows: DataFrame
    summary: DataFrame
    failures: DataFrame
    counts: dict[str, int]


def _text(output: DataFrame, truth: DataFrame, doc: str, seq: str, weights: tuple[int, int, int]) -> DataFrame:
    """(doc, pct_missing, accuracy) of the documents' texts; documents without any text are left out."""
    out, true = (written(documents_text(x, doc, seq), "run-texts") for x in (output, truth))
    pairs = true.select(doc, F.col("text").alias("source")).join(out.select(doc, F.col("text").alias("output")), doc)
    edit = evaluate.edit_distance(pairs, "output", "source", weights).select(doc, "accuracy")
    return evaluate.percent_missing(out, true, doc).join(edit, doc, "full_outer")


def _types(output: DataFrame, truth: DataFrame, doc: str) -> DataFrame:
    """(doc, type_score): how far the kinds of elements agree."""
    return evaluate.type_match(*(evaluate.type_frequency(x, doc) for x in (output, truth)), doc).withColumnRenamed("score", "type_score")


def _tables(output: DataFrame, truth: DataFrame, doc: str, seq: str) -> DataFrame:
    """Scores of the tables of each document that has one on either side, and their weight: its true tables, 1 for false ones alone.
    A document's tables are numbered in the order of its elements."""
    cells = []
    for x in (output, truth):
        found = x.where((F.col("type") == "Table") & F.col("text_as_html").isNotNull())
        one = evaluate.table_cells(found.select(F.struct(doc, seq).alias("_k"), "text_as_html"), "_k")
        # an element's own tables follow one another; its place in the document and theirs in it make one number that keeps the order
        cells.append(written(one.select(F.col(f"_k.{doc}").alias(doc), (F.col(f"_k.{seq}") * 1000 + F.col("table_ix")).cast("long").alias("table_ix"), "row", "col", "text"), "run-cells"))
    return table_eval.evaluate_tables(*cells, doc).withColumn("table_weight", F.greatest("n_truth", F.lit(1)))


def run_corpus(output: DataFrame, truth: DataFrame, doc: str, by: list[str], seq: str = "seq", weights: tuple[int, int, int] = (2, 1, 1)) -> Run:
    """Elements (doc, seq, type, category_depth, text, text_as_html) of both sides through all three branches; `by` are columns of truth that
    are the same for all elements of a document. The metrics' rows are written once and counted in the same job."""
    failures = evaluate.unmatched(output, truth, doc)
    keys = truth.groupBy(doc).agg(*[F.first(c).alias(c) for c in by]).join(output.select(doc).distinct(), doc)
    rows = keys
    for branch in (_text(output, truth, doc, seq, weights), _types(output, truth, doc), _tables(output, truth, doc, seq)):
        rows = rows.join(branch, doc, "left")
    seen = Observation("corpus run")
    counts = {"documents": F.count(F.lit(1)), "with_text": F.count("accuracy"), "with_types": F.count("type_score"), "with_tables": F.count("composite"), "true_tables": F.coalesce(F.sum("n_truth"), F.lit(0)), "found_tables": F.coalesce(F.sum("n_predicted"), F.lit(0))}
    rows = written(rows.observe(seen, *[c.alias(k) for k, c in counts.items()]), "run-rows")
    parts = [evaluate.metric_summary(rows.where(F.col(m).isNotNull()), m, by).withColumn("metric", F.lit(m)) for m in ("pct_missing", "accuracy", "type_score")]
    for m in table_eval.SCORES:  # of tables by their numbers: false ones weigh 1 in table_level and nothing elsewhere
        weight = "table_weight" if m == "table_level" else "n_truth"
        there = rows.where(F.col(m).isNotNull())
        sets = [evaluate.weighted_mean(there, m, weight, g).withColumns({"grouping": F.lit(g[0] if g else "all"), "value": F.col(g[0]).cast("string") if g else F.lit("all")}) for g in [*[[c] for c in by], []]]
        means = sets[0]
        for s in sets[1:]:
            means = means.unionByName(s, allowMissingColumns=True)
        spread = evaluate.metric_summary(there, m, by).drop("average")
        parts.append(spread.join(means.select("grouping", "value", F.round("mean", 3).alias("average")), ["grouping", "value"]).withColumn("metric", F.lit(m)))
    names = ["metric", "grouping", "value", "average", "sample_sd", "population_sd", "count"]
    summary = parts[0].select(*names)
    for p in parts[1:]:
        summary = summary.unionByName(p.select(*names))
    return Run(rows, summary, failures, dict(seen.get))
