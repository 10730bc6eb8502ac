"""Entries as a table: normalising, browsing, counting, updating, validating, identifying."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import numbered

TYPES = ("sop_step", "faq", "manual_section", "general")


def filled(*cols: str, default: str | None) -> Column:
    """The first of the columns that isn't blank, else the default."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) for c in cols], F.lit(default))


def normalize_metadata(df: DataFrame, company=("company",), topic=("topic",), source=("source_file",)) -> DataFrame:
    """company, topic and source_file from flat or nested columns, with their defaults, once and for all."""
    return df.withColumns({"company": filled(*company, default="NA"), "topic": filled(*topic, default="NA"), "source_file": filled(*source, default="unknown")})


def store_metadata(df: DataFrame, keep: list[str], lists: list[str] = [], nested: list[str] = [], id_col: str = "id") -> DataFrame:  # noqa: B006
    """Flat scalar columns: lists joined by ", ", nested values as JSON text."""
    return df.select(id_col, *keep, *[F.array_join(c, ", ").alias(c) for c in lists], *[F.to_json(c).alias(c) for c in nested])


def browse(df: DataFrame, limit: int = 50, type: str | None = None, company: str | None = None, topic: str | None = None, source: str | None = None, has_llm: bool | None = None, keyword: str | None = None, order: str = "id") -> DataFrame:
    """Rows that meet all given filters, the first `limit` by `order`, with the number of all that do (shown_of)."""
    same = lambda c, v: filled(c, default="NA") == v
    where = F.lit(True)
    if type:
        where &= F.col("type") == type
    if company:
        where &= same("company", company)
    if topic:
        where &= same("topic", topic)
    if source:
        where &= F.substring("source_file", 1, 40) == source[:40]
    if has_llm is not None:
        where &= (F.coalesce(F.trim("llm_type"), F.lit("")) != "") == has_llm
    if keyword:
        where &= F.contains(F.lower("text"), F.lit(keyword.lower())) | F.contains(F.lower("title"), F.lit(keyword.lower()))
    rows = df.where(where)
    # the number is one row beside at most `limit`; it runs with the query, not while the plan is made
    return rows.orderBy(order).limit(limit).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).cast("int").alias("shown_of"))))


def select_unclassified(df: DataFrame, company: str | None = None, topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows without llm_type, one row with the numbers selected and skipped)."""
    rows = df
    for c, v in (("company", company), ("topic", topic)):
        if v:
            rows = rows.where(filled(c, default="NA") == v)
    has = F.coalesce(F.trim("llm_type"), F.lit("")) != ""
    return rows.where(~has), rows.agg(F.count_if(~has).alias("selected"), F.count_if(has).alias("skipped"))


def facet_counts(df: DataFrame, facets: list[str], default: str = "NA") -> DataFrame:
    """(facet, value, n) of each column by itself, in one pass."""
    cols = [filled(c, default=default).alias(c) for c in facets]
    rows = df.select(*cols)
    sets = rows.groupingSets([[c] for c in facets], *facets).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    which = [(1 << len(facets)) - 1 - (1 << (len(facets) - 1 - i)) for i in range(len(facets))]
    facet = F.coalesce(*[F.when(F.col("g") == w, F.lit(c)) for c, w in zip(facets, which)])
    value = F.coalesce(*[F.when(F.col("g") == w, F.col(c)) for c, w in zip(facets, which)])
    return sets.select(facet.alias("facet"), value.alias("value"), "n")


def top_values(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k largest values of each facet, ties by value."""
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def store_analysis(df: DataFrame) -> DataFrame:
    """Numbers and shares of classified and unclassified entries; an empty store has null shares."""
    has = F.coalesce(F.trim("llm_type"), F.lit("")) != ""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.count_if(has).alias("classified"), F.count_if(~has).alias("unclassified"), F.round(F.try_divide(100 * F.count_if(has), n), 6).alias("pct_classified"))


def metadata_keys(df: DataFrame, column: str = "metadata", limit: int = 3) -> DataFrame:
    return df.select(F.array_sort(F.map_keys(column)).alias("keys")).limit(limit)


def batch_summary(df: DataFrame, error: str = "error", entries: str = "n_entries") -> DataFrame:
    return df.agg(F.count_if(F.col(error).isNull()).alias("ok"), F.count_if(F.col(error).isNotNull()).alias("failed"), F.coalesce(F.sum(entries), F.lit(0)).alias("entries"))


def run_summary(df: DataFrame) -> DataFrame:
    """Of an enrichment run (type, llm_type): processed, failed, changed."""
    return df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("llm_type").isNull()).alias("failed"), F.count_if(F.col("llm_type").isNotNull() & (F.col("llm_type") != F.col("type"))).alias("changed"))


def type_comparison(df: DataFrame, rule: str = "type", llm: str = "llm_type") -> DataFrame:
    a = df.where(F.col(rule).isNotNull()).groupBy(F.col(rule).alias("type")).agg(F.count(F.lit(1)).alias("n_rule"))
    b = df.where(F.col(llm).isNotNull()).groupBy(F.col(llm).alias("type")).agg(F.count(F.lit(1)).alias("n_llm"))
    return a.join(b, "type", "full_outer").fillna(0, ["n_rule", "n_llm"])


def parse_answer(c: Column) -> Column:
    """struct(type, keywords, confidence) of a model's answer, code fences and surrounding talk taken off; null if malformed."""
    body = F.regexp_extract(F.regexp_replace(c, "```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.from_json(body, "type string, keywords array<string>, confidence double")


def apply_results(entries: DataFrame, results: DataFrame, on: str = "id") -> DataFrame:
    """Entries with llm_type, llm_confidence and type taken from results by key (the last by seq of several), and changed."""
    order = "seq" if "seq" in results.columns else "llm_type"
    last = results.groupBy(on).agg(F.max_by(F.struct("llm_type", "llm_confidence"), order).alias("_r"))
    rows = entries.drop("llm_type", "llm_confidence").join(last, on, "left")
    new = F.coalesce(F.col("_r.llm_type"), F.col("type"))
    return rows.withColumns({"changed": new != F.col("type"), "llm_type": F.col("_r.llm_type"), "llm_confidence": F.col("_r.llm_confidence"), "type": new}).drop("_r")


def llm_batches(df: DataFrame, size: int = 5, id_col: str = "id") -> DataFrame:
    """(batch, ids, items) of `size` entries each, in order of id."""
    rows = df.select(F.col(id_col).alias("id"), F.struct(F.col(id_col).alias("id"), F.substring("title", 1, 100).alias("title"), F.substring("content", 1, 300).alias("content")).alias("item"))
    rows = numbered(rows, "id").withColumn("batch", F.floor(F.col("number") / size))
    return rows.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["id"]).alias("ids"), F.array_sort(F.collect_list("item")).alias("items"))


def prompts(batches: DataFrame) -> DataFrame:
    """(batch, ids, prompt): what a model is asked about each of llm_batches()."""
    item = lambda x, i: F.concat(F.lit("Entry "), i.cast("string"), F.lit("\nTitle: "), F.coalesce(x["title"], F.lit("")), F.lit("\nContent: "), F.coalesce(x["content"], F.lit("")))
    head = F.lit(f"Give each entry one type of {', '.join(TYPES)}, keywords and a confidence, as a JSON list in the order of the entries.\n\n")
    return batches.select("batch", "ids", F.concat(head, F.array_join(F.transform("items", item), "\n\n")).alias("prompt"))


def ask(asked: DataFrame, call: Callable[[list[str]], list[str]]) -> DataFrame:
    """(batch, ids, answer): call takes the prompts of an Arrow batch and gives as many answers; it runs on the executors, and what it
    raises fails the task."""
    kind = asked.schema["ids"].dataType.simpleString()

    def run(parts):
        for p in parts:
            got = list(call(p["prompt"].tolist()))
            if len(got) != len(p):
                raise ValueError(f"{len(p)} prompts gave {len(got)} answers")
            yield p[["batch", "ids"]].assign(answer=got)

    return asked.mapInPandas(run, f"batch long, ids {kind}, answer string")


def batch_results(answers: DataFrame) -> DataFrame:
    """(id, llm_type, llm_confidence) from (batch, ids, answer): the answers of a batch are matched with its ids by their place; what
    is no JSON list, and places beyond the ids, count for nothing."""
    body = F.regexp_extract(F.regexp_replace("answer", "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    rows = answers.select("ids", F.posexplode(F.from_json(body, "array<struct<type:string,confidence:double>>")).alias("i", "x"))
    return rows.where(F.col("i") < F.size("ids")).select(F.get("ids", F.col("i")).alias("id"), F.col("x.type").alias("llm_type"), F.col("x.confidence").alias("llm_confidence"))


def filter_types(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, kind: str = "type") -> DataFrame:
    """Elements of the included types, or without the excluded ones; exactly one list is given."""
    if (include is None) == (exclude is None):
        raise ValueError("give either include or exclude")
    return df.where(F.col(kind).isin(*include) if include is not None else ~F.col(kind).isin(*exclude))


def random_ids(df: DataFrame, out: str = "id") -> DataFrame:
    """df with a random UUID a row. Drawn anew whenever the plan runs: write the result before the ids are used twice."""
    return df.withColumn(out, F.uuid())


def delete_where(df: DataFrame, company: str | None = None, topic: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that would go) of a delete by company and topic ("NA": blank too)."""
    gone = F.lit(company is not None or topic is not None)
    for c, v in (("company", company), ("topic", topic)):
        if v is not None:
            gone = gone & (filled(c, default="NA") == v)
    return df.where(~gone), df.where(gone)


def delete_ids(df: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    return df.join(ids.select(on), on, "left_anti")


def upsert(df: DataFrame, new: DataFrame, on: str = "id") -> DataFrame:
    """Rows of df whose key isn't in new, and all of new."""
    return df.join(new.select(on), on, "left_anti").unionByName(new, allowMissingColumns=True)


def filter_list(df: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed; an empty list is an error."""
    if not names.limit(1).count():
        raise ValueError("the filter list is empty")
    return df.join(names.select(on), on, "left_semi")


def merge(bases: list[DataFrame]) -> DataFrame:
    out = bases[0]
    for b in bases[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def option_list(df: DataFrame, column: str, defaults: list[str] = [], stored: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """Defaults, stored and present values, once each; NA first, then by name."""
    spark = df.sparkSession
    parts = [df.select(filled(column, default="NA").alias("value")), spark.createDataFrame([(d,) for d in defaults], "value string")]
    if stored is not None:
        parts.append(stored.select(F.col(stored.columns[0]).alias("value")))
    return merge(parts).where("value is not null").distinct().orderBy(F.col("value") != "NA", "value")


def violations(df: DataFrame) -> DataFrame:
    """(id, violation): required fields missing or blank, an unknown type, a negative page."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    tests = [F.when(blank(c), F.lit(f"missing {c}")) for c in ("id", "type", "title", "content", "source_file")]
    tests += [F.when(~blank("type") & ~F.col("type").isin(*TYPES), F.lit("unknown type")), F.when(F.col("source_page") < 0, F.lit("negative page"))]
    return df.select("id", F.explode(F.array_compact(F.array(*tests))).alias("violation"))


def hash_ids(df: DataFrame, doc: str, seq: str, filename: str, text: str, page: str, parent: str | None = None) -> DataFrame:
    """df with element_id: the first 32 hex digits of sha256(filename + text + page + place on the page); null parts read None.
    With a parent column (seq numbers), parent_id is its element's id."""
    place = F.row_number().over(Window.partitionBy(doc, page).orderBy(seq)) - 1
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    rows = df.withColumn("_place", place).withColumn("element_id", F.substring(F.sha2(F.concat(part(filename), part(text), part(page), F.col("_place").cast("string")), 256), 1, 32)).drop("_place")
    if parent:
        ids = rows.select(F.col(doc), F.col(seq).alias(parent), F.col("element_id").alias("parent_id"))
        rows = rows.join(ids, [doc, parent], "left")
    return rows


def stamp(df: DataFrame, **values) -> DataFrame:
    """df with constant metadata columns (filename, filetype, url, ...)."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def clean_corpus(df: DataFrame, steps: list, text: str = "text", out: str = "cleaned") -> DataFrame:
    """df with the text cleaned by steps: names of functions.text.STEPS, or functions from Column to Column."""
    c = F.col(text)
    for s in steps:
        c = (T.STEPS[s] if isinstance(s, str) else s)(c)
    return df.withColumn(out, c)


def clean_report(df: DataFrame, steps: list[str], text: str = "text", by: str = "source") -> DataFrame:
    """(by, step, n_changed, chars_removed): what each step did to what the steps before it left."""
    stages, c = [], F.col(text)
    for s in steps:
        after = T.STEPS[s](c)
        stages.append(F.struct(F.lit(s).alias("step"), (after != c).cast("long").alias("changed"), (F.length(c) - F.length(after)).cast("long").alias("removed")))
        c = after
    rows = df.select(F.col(by), F.explode(F.array(*stages)).alias("x"))
    return rows.groupBy(by, "x.step").agg(F.sum("x.changed").alias("n_changed"), F.sum("x.removed").alias("chars_removed"))


# Patterns of entities.
ENTITIES = {
    "email": r"[a-z0-9.+_-]+@[a-z0-9.+_-]+\.[a-z]+",
    "ip": r"\b(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}\b",
    "ipv6": r"\b[a-z0-9]{4}::[a-z0-9]{4}:[a-z0-9]{4}:[a-z0-9]{4}:[a-z0-9]{4}%?[0-9]*",
    "phone": r"\+?[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
    "datetime": r"[A-Za-z]{3}, [0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}",
    "mapi_id": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+;",
    "host": r"\b[a-zA-Z0-9-]+\.[a-zA-Z]+\.[a-zA-Z]+\b",
    "image_url": r"https?://[A-Za-z0-9$_@.&+!*(),%/-]+\.(?:jpg|jpeg|png|gif|bmp|heic)",
}


def entities(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, kind, value) for each entity found; e-mail addresses in lower case."""
    t = F.col(text)

    def of(kind: str, pattern: str) -> Column:
        if kind == "email":  # tried where its first run of characters starts, or where the match before ended: all other starts fail alike
            pattern = r"(?:(?<![a-z0-9.+_-])|\G)" + pattern.replace("+@", "++@", 1)
        hits = F.regexp_extract_all(F.lower(t) if kind == "email" else t, F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = [of(k, p) for k, p in ENTITIES.items()]
    return df.select(id_col, F.explode(F.concat(*found)).alias("x")).select(id_col, "x.kind", "x.value")
