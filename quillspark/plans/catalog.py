"""The registered queries of the document engine and their SQL (DuckDB), over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, entries, evaluate, language, registry, search, segment
from ..sources import files
from ..sources.scratch import shared_path, written
from ..streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Companies of the test corpus by source, in order of priority.
SOURCE_RULES = [("src11", "Cisco"), ("src1", "HP"), ("src2", "Dell"), ("src3", "Sony"), ("src0", "Samsung")]
#: Titles that bring every classification rule into play, by id.
PREFIXES = ["To ", "Step: ", "How to ", "What is ", "Overview ", "FAQ ", ""]
#: Bodies likewise.
LISTS = ["1. a\n2. b\n3. c\n", "1. a\n", ""]


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_pick(values: list[str], key: str) -> str:
    return f"([{', '.join(_quoted(v) for v in values)}])[({key}) % {len(values)} + 1]"


def _sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _sql_any(c: str, words) -> str:
    return "(" + " or ".join(f"contains({c}, {_quoted(w)})" for w in words) + ")"


def _sql_rules(c: str, rules, default: str) -> str:
    return "case " + " ".join(f"when contains({c}, {_quoted(p)}) then {_quoted(v)}" for p, v in rules) + f" else {default} end"


def _sql_type(title: str, body: str) -> str:
    t = _sql_strip(f"lower(regexp_replace({title}, '\\*+', '', 'g'))")
    steps = f"len(regexp_extract_all(lower({body}), '(?:^|\\n)[\\s*•\\-]*\\d+\\.'))"
    return f"""case when starts_with({t}, 'to ') and {steps} >= 1 then 'sop_step'
      when {_sql_any(t, ("step", "procedure", "process", "instruction"))} then 'sop_step' when {steps} >= 3 then 'sop_step'
      when contains({t}, 'how to') then case when {steps} >= 1 then 'sop_step' else 'faq' end
      when {_sql_any(t, ("?", "what is", "what are", "what does", "why ", "when ", "q:", "q&a", "faq", "frequently asked"))} then 'faq'
      when {_sql_any(t, ("chapter", "section", "overview", "introduction", "specification"))} then 'manual_section' else 'general' end"""


_TITLE = f"{_sql_pick(PREFIXES, 'doc_id')} || left(text, 50)"
_BODY = f"{_sql_pick(LISTS, 'doc_id // 7')} || text"
_LINES = r"(select doc_id, lang, source, unnest(a) as t, unnest(range(len(a))) as seq from (select doc_id, lang, source, string_split(text, chr(10)) as a from documents))"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as entries: id, title, content, source_file, company, topic."""
    d = read(spark, sf_dir, "documents")
    title = F.concat(_pick(PREFIXES, F.col("doc_id")), F.substring("text", 1, 50))
    content = F.concat(_pick(LISTS, F.floor(F.col("doc_id") / 7)), "text")
    return classify.infer_company(d.select("doc_id", title.alias("title"), content.alias("content"), "text", F.col("source").alias("source_file"), F.col("lang").alias("topic"), "n_chars"), "source_file", rules=SOURCE_RULES)


@query(f"""with p as (select doc_id, source, seq, {_sql_strip("t")} as t from {_LINES}),
q as (select source, case when length(t) > 50 then left(t, 50) || '...' else t end as title0, t, doc_id, seq from p where length(t) >= 15),
r as (select {_sql_rules("source", SOURCE_RULES, "'Unknown'")} as company, {_sql_type(_sql_pick(PREFIXES, "doc_id + seq") + " || title0", "t")} as type from q)
select coalesce(company, 'all') as company, coalesce(type, 'all') as type, count(*) as n from r group by grouping sets ((company, type), (company), (type))""")
def kb_type_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as entries: how many of each type has each company (and each of both by itself)?"""
    d = read(spark, sf_dir, "documents")
    p = segment.split_paragraphs(d.select(F.struct("doc_id", "source").alias("k"), "text"), "k", by="\n")
    rows = classify.infer_company(p.select("k.doc_id", "k.source", "seq", "title", "text"), "source", rules=SOURCE_RULES)
    rows = rows.withColumn("type", classify.knowledge_type(F.concat(_pick(PREFIXES, F.col("doc_id") + F.col("seq")), "title"), F.col("text")))
    out = rows.groupingSets([["company", "type"], ["company"], ["type"]], "company", "type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce("company", F.lit("all")).alias("company"), F.coalesce("type", F.lit("all")).alias("type"), "n")


@query("""select case when grouping(lang) = 0 then 'lang' else 'source' end as facet, case when grouping(lang) = 0 then lang else source end as value, count(*) as n
from (select coalesce(nullif(trim(lang), ''), 'NA') as lang, coalesce(nullif(trim(source), ''), 'NA') as source from documents) group by grouping sets ((lang), (source))""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.facet_counts(read(spark, sf_dir, "documents"), ["lang", "source"])


@query("""select facet, value, n, rank from (select *, row_number() over (partition by facet order by n desc, value) as rank from (select case when grouping(lang) = 0 then 'lang' else 'source' end as facet, coalesce(lang, source) as value, count(*) as n
from documents where contains(lower(text), 'the') group by grouping sets ((lang), (source)))) where rank <= 5""")
def dashboard_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest values of each facet among the texts that hold a word."""
    return entries.top_values(entries.facet_counts(search.keyword_search(read(spark, sf_dir, "documents"), "The", "text"), ["lang", "source"]), 5)


@query(f"""with e as (select doc_id, {_TITLE} as title, text, lang, {_sql_rules("source", SOURCE_RULES, "'Unknown'")} as company from documents),
f as (select * from e where company = 'HP' and lang = 'en' and (contains(lower(text), 'the') or contains(lower(title), 'the')))
select doc_id, title, (select count(*) from f) as shown_of from f order by doc_id limit 50""")
def browse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.browse(_titled(spark, sf_dir), 50, company="HP", topic="en", keyword="the", order="doc_id").select("doc_id", "title", "shown_of")


@query("""with s as (select doc_id, '[Title] ' || left(text, 20) || chr(10) || '[Content] ' || text || chr(10) || '[Keywords] ' || lang || ', ' || source as store_text, text from documents)
select doc_id, store_text, left(regexp_replace(regexp_replace(string_split(substr(store_text, strpos(store_text, '[Content] ') + 10), '[Keywords]')[1], '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'), 800) as display_text,
left(text, 60) || '...' as display_title from s""".replace("\\\\", "\\"))
def store_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("store_text", T.store_text(F.substring("text", 1, 20), F.col("text"), F.array("lang", "source")))
    return d.select("doc_id", "store_text", T.display_text(F.col("store_text")).alias("display_text"), T.display_title(F.lit(""), F.col("text")).alias("display_title"))


@query(f"select doc_id, {_sql_type(_TITLE, _BODY)} as type from documents")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).select("doc_id", classify.knowledge_type(F.col("title"), F.col("content")).alias("type"))


@query(f"""select doc_id, case when {_sql_any("t", ("how", "what", "why", "when", "where", "can", "is", "do"))} then 'faq' when {_sql_any("b", ("step", "procedure", "follow", "first", "then", "next"))} then 'sop_step'
when {_sql_any("t", ("chapter", "section", "introduction", "overview"))} then 'manual_section' else 'general' end as type,
case when {_sql_any("t", ("how", "what", "why", "when", "where", "can", "is", "do", "chapter", "section", "introduction", "overview"))} or {_sql_any("b", ("step", "procedure", "follow", "first", "then", "next"))} then 0.6::double else 0.5::double end as confidence
from (select doc_id, lower({_TITLE}) as t, lower({_BODY}) as b from documents)""")
def classify_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).select("doc_id", classify.words_type(F.col("title"), F.col("content")).alias("x")).select("doc_id", "x.*")


@query(f"""with e as (select case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then lang else null end as company, {_sql_rules("source", SOURCE_RULES, "null")} as guess from documents),
a as (select coalesce(nullif(company, ''), 'Unassigned') as company, count(*) as n_before from e group by 1), b as (select coalesce(nullif(company, ''), guess, 'Unassigned') as company, count(*) as n_after from e group by 1)
select coalesce(a.company, b.company) as company, coalesce(n_before, 0) as n_before, coalesce(n_after, 0) as n_after from a full join b on a.company = b.company""")
def company_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank companies filled from the source, numbers before and after."""
    d = read(spark, sf_dir, "documents")
    own = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    e = classify.infer_company(d.withColumn("company", own), "source", "guess", SOURCE_RULES, None)
    e = e.select(entries.filled("company", default="Unassigned").alias("before"), entries.filled("company", "guess", default="Unassigned").alias("after"))
    a, b = (e.groupBy(F.col(c).alias("company")).agg(F.count(F.lit(1)).alias(f"n_{c}")) for c in ("before", "after"))
    return a.join(b, "company", "full_outer").fillna(0)


@query(f"""select doc_id, {_sql_rules("lower(source)", [(n.lower(), n) for n in classify.KNOWN_COMPANIES], "null")} as by_name, {_sql_rules("lower(left(text, 1000))", [(n.lower(), n) for n in classify.KNOWN_COMPANIES], "null")} as company,
{_sql_rules("lower(url_like)", [(w, t) for t, ws in classify.TOPIC_RULES.items() for w in ws], "null")} as topic from (select *, left(text, 30) || '.txt' as url_like from documents)""")
def detect_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company by file name or text, topic by file name."""
    d = read(spark, sf_dir, "documents").withColumn("url_like", F.concat(F.substring("text", 1, 30), F.lit(".txt"))).withColumn("blank", F.lit(""))
    d = classify.detect_company(d, "source", "blank", "by_name")
    return classify.detect_topic(classify.detect_company(d, "source", "text"), "url_like").select("doc_id", "by_name", "company", "topic")


_LLM = "case when l.quality = 1 and l.toxic = 0 then 'faq' when l.quality = 1 then 'general' when l.quality = 0 then 'sop_step' end"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "faq").when(F.col("quality") == 1, "general").otherwise("sop_step")
    return read(spark, sf_dir, "labels").select("doc_id", kind.alias("llm_type"), (F.lit(0.5) + F.col("quality") * 0.25).alias("llm_confidence"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).withColumn("type", classify.knowledge_type(F.col("title"), F.col("content"))).join(_answers(spark, sf_dir), "doc_id", "left")


_CLASSIFIED = f"(select d.doc_id, d.lang, d.source, d.text, {_sql_type(_TITLE.replace('doc_id', 'd.doc_id'), _BODY.replace('doc_id', 'd.doc_id'))} as type, {_LLM} as llm_type from documents d left join labels l on d.doc_id = l.doc_id)"


@query(f"""with e as {_CLASSIFIED}, a as (select type, count(*) as n_rule from e group by 1), b as (select llm_type as type, count(*) as n_llm from e where llm_type is not null group by 1)
select coalesce(a.type, b.type) as type, coalesce(n_rule, 0) as n_rule, coalesce(n_llm, 0) as n_llm from a full join b on a.type = b.type""")
def type_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.type_comparison(_classified(spark, sf_dir))


@query(f"select doc_id, coalesce(llm_type, type) as type, llm_type, coalesce(llm_type, type) <> type as changed from {_CLASSIFIED}")
def llm_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _classified(spark, sf_dir).drop("llm_type", "llm_confidence")
    return entries.apply_results(e, _answers(spark, sf_dir), "doc_id").select("doc_id", "type", "llm_type", "changed")


@query("""select l.doc_id, case when l.quality = 1 then 'faq' else 'general' end as type, ['a', 'b'] [l.quality + 1] as keyword, 0.5 + l.toxic as confidence from labels l""")
def parse_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers as text (fenced every other time) parsed into columns."""
    plain = F.to_json(F.struct(F.when(F.col("quality") == 1, "faq").otherwise("general").alias("type"), F.array(F.when(F.col("quality") == 1, "b").otherwise("a")).alias("keywords"), (F.lit(0.5) + F.col("toxic")).alias("confidence")))
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), plain, F.lit("\n```"))).otherwise(plain)
    rows = read(spark, sf_dir, "labels").select("doc_id", entries.parse_answer(raw).alias("x"))
    return rows.select("doc_id", "x.type", F.col("x.keywords")[0].alias("keyword"), "x.confidence")


@query(f"""with e as {_CLASSIFIED} select (select count(*) from e where llm_type is null and lang = 'en') as selected, (select count(*) from e where llm_type is not null and lang = 'en') as skipped""")
def unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.select_unclassified(_classified(spark, sf_dir), topic="en")[1]


@query(f"""select count(*) as total, count(llm_type) as classified, count(*) - count(llm_type) as unclassified, round(100.0 * count(llm_type) / count(*), 6) as pct_classified,
count(*) as processed, count(*) - count(llm_type) as failed, count(case when llm_type <> type then 1 end) as changed from {_CLASSIFIED}""")
def store_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _classified(spark, sf_dir)
    return entries.store_analysis(e).crossJoin(entries.run_summary(e))  # one row each


@query("""select batch, min(doc_id) as first_id, max(doc_id) as last_id, count(*) as n, max(length(left(text, 300))) as longest from (select doc_id, text, (row_number() over (order by doc_id) - 1) // 5 as batch from documents) group by batch""")
def llm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 50).alias("title"), F.col("text").alias("content"))
    b = entries.llm_batches(d, 5, "doc_id")
    return b.select("batch", F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id"), F.size("ids").cast("long").alias("n"), F.array_max(F.transform("items", lambda x: F.length(x["content"]))).cast("long").alias("longest"))


@query(f"""select doc_id from (select doc_id, lang, {_sql_rules("source", SOURCE_RULES, "'Unknown'")} as company from documents) where not (company = 'HP' and lang = 'en')""")
def delete_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after a delete by company and topic."""
    return entries.delete_where(_titled(spark, sf_dir), "HP", "en")[0].select("doc_id")


@query("""select doc_id, 'old' as origin, n_chars from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'new', quality::bigint from labels""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "documents").select("doc_id", F.lit("old").alias("origin"), "n_chars")
    new = read(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("origin"), F.col("quality").cast("long").alias("n_chars"))
    return entries.upsert(old, new, "doc_id")


@query("select doc_id from documents where doc_id in (select doc_id from labels where quality = 0)")
def filter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.filter_list(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("quality = 0"), "doc_id").select("doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.delete_ids(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id")


@query("select value from (select distinct coalesce(nullif(trim(source), ''), 'NA') as value from documents union select 'NA' union select 'HP' union select distinct role from conversations)")
def option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.option_list(read(spark, sf_dir, "documents"), "source", ["NA", "HP"], read(spark, sf_dir, "conversations").select("role"))


_CLEAN_SQL = "regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F]', '', 'g'), '[\\n ]', ' ', 'g')"


@query("""with a as (select doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as t from documents), b as (select doc_id, translate(t, '-', ' ') as t from a),
c as (select doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as t from b), d as (select doc_id, regexp_replace(regexp_replace(t, '\\n', ' ', 'g'), ' {2,}', ' ', 'g') as t from c),
e as (select doc_id, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as t from d) select doc_id, regexp_replace(t, '[.,:;]+$', '') as cleaned from e""")
def clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.clean_corpus(read(spark, sf_dir, "documents"), ["non_ascii", "dashes", "whitespace", "trailing_punctuation", "quotes"]).select("doc_id", "cleaned")


@query("""with s as (select source, text as a, lower(text) as b, regexp_replace(lower(text), '[^\\x00-\\x7F]', '', 'g') as c, regexp_replace(regexp_replace(lower(text), '[^\\x00-\\x7F]', '', 'g'), '\\pP', '', 'g') as d from documents)
select source, 'lower' as step, sum((a <> b)::int)::bigint as n_changed, sum(length(a) - length(b))::bigint as chars_removed from s group by 1 union all
select source, 'non_ascii', sum((b <> c)::int)::bigint, sum(length(b) - length(c))::bigint from s group by 1 union all select source, 'punctuation', sum((c <> d)::int)::bigint, sum(length(c) - length(d))::bigint from s group by 1""")
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.clean_report(read(spark, sf_dir, "documents"), ["lower", "non_ascii", "punctuation"])


def _sql_entity(kind: str, c: str = "text") -> str:
    return f"select doc_id, '{kind}' as kind, unnest(regexp_extract_all({c}, '{entries.ENTITIES[kind]}')) as value from documents"


@query(f"select kind, value, count(*) as n, count(distinct doc_id) as n_docs from ({' union all '.join(_sql_entity(k, 'lower(text)' if k == 'email' else 'text') for k in entries.ENTITIES)}) group by 1, 2")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = entries.entities(read(spark, sf_dir, "documents"), "doc_id")
    return found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def _sql_page(inner: str) -> str:
    for tag in files.DROPPED:
        inner = f"regexp_replace({inner}, '<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'gis')"
    return inner


@query(f"""with a as (select page_id, regexp_replace({_sql_page("html")}, '<(link|meta|input|hr)\\b[^>]*>', ' ', 'gis') as t from pages),
b as (select page_id, coalesce(nullif(regexp_extract(t, '<main\\b[^>]*>(.*)</main>', 1, 'is'), ''), t) as t from a), c as (select page_id, coalesce(nullif(regexp_extract(t, '<body\\b[^>]*>(.*)</body>', 1, 'is'), ''), t) as t from b),
d as (select page_id, regexp_extract_all(t, '<(?:h[1-6]|li|pre|table|p)\\b[^>]*>.*?</(?:h[1-6]|li|pre|table|p)>|<img\\b[^>]*>', 0, 'is') as x from c),
e as (select page_id, unnest(x) as b, unnest(range(len(x))) as seq from d), f as (select *, lower(regexp_extract(b, '^<([A-Za-z0-9]+)', 1)) as tag from e),
g as (select page_id, seq::int as seq, case when tag in ('h1','h2','h3','h4','h5','h6') then 'Title' when tag = 'li' then 'ListItem' when tag = 'pre' then 'CodeSnippet' when tag = 'table' then 'Table' when tag = 'img' then 'Image' else 'NarrativeText' end as type,
case when tag in ('h1','h2','h3','h4','h5','h6') then substr(tag, 2, 1)::int - 1 end as depth,
case when tag = 'img' then regexp_extract(b, 'alt="([^"]*)"', 1, 'i') when tag = 'pre' then regexp_replace(b, '<[^>]+>', ' ', 'g') else regexp_replace(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') end as text from f)
select * from g where type = 'Image' or length(text) >= 2""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.page_elements(read(spark, sf_dir, "pages"))


@query("""select page_id, seq::int as seq, href, regexp_extract(href, '^https?://([^/]+)', 1) as host from (select page_id, unnest(x) as href, unnest(range(len(x))) as seq from (select page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) as x from pages))""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.page_links(read(spark, sf_dir, "pages"))


@query()
def web_page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.web_page_entries(read(spark, sf_dir, "pages"))


_BULLET = "[" + "".join("\\" + c if c in "-*" else c for c in T.BULLETS) + "]"
_SENTENCES = "len(list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) >= 5))"
_CAPS = "list_filter(regexp_split_to_array(t, '\\s+'), lambda w: regexp_matches(w, '^[A-Za-z]'))"
_LOW_ALPHA = "(length(regexp_replace(t, '\\s', '', 'g')) > 0 and length(regexp_replace(t, '\\PL', '', 'g')) / length(regexp_replace(t, '\\s', '', 'g')) < 0.5)"


@query(f"""select doc_id, seq::int as seq, t as text, case when regexp_matches(t, '^{_BULLET}') then 'ListItem' when regexp_matches(t, '^[a-z0-9.+_-]+@[a-z0-9.+_-]+\\.[a-z]+$') then 'EmailAddress' when regexp_matches(t, '^\\d+(\\.|\\))\\s(.+)') then 'ListItem'
when not regexp_matches(t, '^\\d+$') and t <> '' and len(list_filter({_CAPS}, lambda w: regexp_matches(w, '^[A-Z]'))) / greatest(1, len({_CAPS})) <= 0.5 and not {_LOW_ALPHA} and {_SENTENCES} >= 2 then 'NarrativeText'
when t <> '' and len(string_split(t, ' ')) <= 12 and not {_LOW_ALPHA} and not regexp_matches(t, ',$') and not regexp_matches(t, '^\\d+$') and {_SENTENCES} <= 1 and not regexp_matches(t, '^[A-Z][A-Z ]*[^A-Za-z0-9\\s]$') then 'Title' else 'Text' end as type
from (select doc_id, seq, {_sql_strip("t")} as t from {_LINES}) where length(t) >= 1""")
def line_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = segment.split_paragraphs(read(spark, sf_dir, "documents"), "doc_id", by="\n", least=1)
    return p.select("doc_id", "seq", "text", T.element_type(F.col("text")).alias("type"))


@query("""select doc_id, k::int as chunk_seq, substr(text, k * 500 + 1, 500) as chunk from (select doc_id, text, unnest(range((length(text) + 499) // 500)) as k from documents where length(text) > 0)""")
def hard_cut_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.hard_cut(read(spark, sf_dir, "documents"), "doc_id")


_TURNS = f"(select conv_id, turn, role, {_sql_strip('''regexp_replace(text, '\\s+', ' ', 'g')''')} as t from conversations)"


@query(f"""with recursive e as (select conv_id, turn, t, row_number() over (partition by conv_id order by turn) as r from {_TURNS} where t <> ''),
f as (select conv_id, r, turn, t as now, 0 as g from e where r = 1 union all select f.conv_id, e.r, e.turn, case when length(f.now) + 2 + length(e.t) <= 4000 then f.now || chr(10) || chr(10) || e.t else e.t end, case when length(f.now) + 2 + length(e.t) <= 4000 then f.g else f.g + 1 end
from f join e on e.conv_id = f.conv_id and e.r = f.r + 1)
select conv_id, g::bigint as chunk_seq, arg_max(now, r) as text, count(*) as n_elements, min(turn) as first_seq, max(turn) as last_seq from f group by conv_id, g""")
def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = segment.chunk_basic(read(spark, sf_dir, "conversations"), "conv_id", "turn", kind="role", most=4000)
    return c.select("conv_id", F.col("chunk_seq").cast("long").alias("chunk_seq"), "text", F.col("n_elements").cast("long").alias("n_elements"), "first_seq", "last_seq")


@query()
def title_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as titles: chunks by section (tests hold the invariants)."""
    c = read(spark, sf_dir, "conversations").withColumn("type", F.when(F.col("role") == "user", "Title").otherwise("NarrativeText"))
    return registry.chunk(c, "by_title", "conv_id", "turn", most=1000, combine_under=300)


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.chunk_recursive(read(spark, sf_dir, "documents"), "doc_id")


@query("""select conv_id, turn, substr(sha256('c' || conv_id || text || (turn // 2) || (row_number() over (partition by conv_id, turn // 2 order by turn) - 1)), 1, 32) as element_id from conversations""")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("filename", F.concat(F.lit("c"), F.col("conv_id"))).withColumn("page", F.floor(F.col("turn") / 2))
    return entries.hash_ids(c, "conv_id", "turn", "filename", "text", "page").select("conv_id", "turn", "element_id")


@query("""select conv_id, turn, case when role <> 'user' then last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) end as parent_seq from conversations""")
def parents_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.parents_flat(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "user").select("conv_id", "turn", "parent_seq")


@query("""select conv_id, turn, case when role <> 'user' then last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) end as parent_seq from conversations""")
def parents_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The general walk over the same rows: users are titles, others may stand under them."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "Title").otherwise("Text").alias("type"), F.lit(0).alias("category_depth"))
    return segment.parents(c, "conv_id", "turn").select("conv_id", "turn", "parent_seq")


@query("""with p as (select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn) as parent from conversations)
select conv_id, parent, string_agg(turn, ',' order by turn) as turns from p group by 1, 2""")
def group_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("parent", F.when(F.col("role") == "user", F.col("turn")))
    return segment.group_by_parent(c, "conv_id", "turn", "parent").select("conv_id", "parent", F.array_join(F.col("seqs").cast("array<string>"), ",").alias("turns"))


@query("""select conv_id, arg_min(text, turn) as first_text, string_agg(role, ' ' order by turn) as roles, (select string_agg(r, ',' order by t) from (select role as r, min(turn) as t from conversations d where d.conv_id = c.conv_id group by 1)) as role_set from conversations c group by conv_id""")
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("first_text"), F.col("role").alias("roles"), F.array("role").alias("role_set"))
    out = segment.consolidate(c, ["conv_id"], "turn", first=["first_text"], strings=["roles"], unique=["role_set"])
    return out.withColumn("role_set", F.array_join("role_set", ","))


@query("""select conv_id, string_agg(t, ' ' order by turn) as text, count(*)::int as n_chunks from (select conv_id, turn, text as t from conversations) group by 1""")
def reconstruct_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("table_id"), F.col("turn").alias("chunk_index"), "text", F.lit("<tr>").alias("text_as_html"))
    return segment.reconstruct_tables(c).select(F.col("table_id").alias("conv_id"), "text", "n_chunks")


@query("""with a as (select conv_id, turn, string_agg(case when role = 'user' then '# ' else '' end || text, chr(10) order by turn) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) as t from conversations)
select conv_id, any_value(t) as text from a group by 1""")
def documents_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "Title").otherwise("Text").alias("type"), "text")
    return files.documents_text(c, "conv_id", "turn", markdown=True)


_MARKED = """(select doc_id, seq, case when seq % 5 = 2 then '## ' || t when seq % 7 = 3 then 'Chapter ' || seq || ' ' || left(t, 20) else t end as t from """ + _LINES + ")"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with some lines made headings."""
    mark = lambda t, i: F.when(i % 5 == 2, F.concat(F.lit("## "), t)).when(i % 7 == 3, F.concat(F.lit("Chapter "), i.cast("string"), F.lit(" "), F.substring(t, 1, 20))).otherwise(t)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


@query(f"""with l as (select *, regexp_matches(t, '^(#{{1,3}})\\s+(.+)') as h from {_MARKED}), s as (select *, sum(h::int) over (partition by doc_id order by seq) as section from l),
g as (select doc_id, section::bigint as section, {_sql_strip("regexp_extract(max(case when h then t end), '^(#{1,3})\\s+(.+)', 2)")} as title0, bool_or(h) as any_h, {_sql_strip("coalesce(string_agg(t, chr(10) order by seq) filter (not h), '')")} as body from s group by 1, 2)
select doc_id, section, case when any_h then 2 end as level, case when any_h then title0 end as title, body from g where any_h or body <> ''""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.markdown_headings(_marked(spark, sf_dir), "doc_id")


@query(f"""with l as (select doc_id, seq, t, regexp_matches(t, '^(#{{1,3}})\\s+(.+)') as m, sum(length(t) + 1) over (partition by doc_id order by seq) - length(t) - 1 as off from {_MARKED}),
h as (select *, {_sql_strip("t")} as s from l),
k as (select *, case when regexp_matches(s, '[A-Z]') and not regexp_matches(s, '[a-z]') and length(s) between 15 and 80 and contains(s, ' ') then not regexp_matches(upper(s), 'DRIVE|AVENUE|ROAD|STREET|BOULEVARD|SAN JOSE|USA|ZIP')
when regexp_matches(s, '(?i)^(chapter|section|part)\\s+\\d+[.:]?\\s*') then true when regexp_matches(s, '^\\d+(\\.\\d+)*\\s+[A-Z]') then true
when length(s) between 10 and 60 and not regexp_matches(s, '[.!?;:]$') and regexp_matches(s, '^\\p{{Lu}}') then len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: regexp_matches(w, '^\\pL+$'))) >= 3 and len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: regexp_matches(w, '^\\pL+$') and length(w) > 3 and regexp_matches(w, '^\\p{{Lu}}'))) >= 3 and not regexp_matches(upper(s), 'DRIVE|AVENUE|ROAD|STREET|BOULEVARD|SAN JOSE|USA|ZIP|POSTAL')
else (regexp_matches(s, '(?i)^to\\s+[A-Za-z0-9_]+') or regexp_matches(s, '(?i)^how\\s+to\\s+[A-Za-z0-9_]+')) and length(s) < 80 end as is_h from h where s <> ''),
p as (select doc_id, count(*) as n from k where is_h and (off >= 200 or regexp_matches(s, '(?i)^(chapter|section|part|appendix)\\s+\\d+')) group by 1), m as (select doc_id, sum(m::int) as m from l group by 1)
select m.doc_id, case when m.m >= 3 then 'markdown' when p.n >= 3 then 'plaintext' else 'paragraph' end as strategy from m left join p on m.doc_id = p.doc_id""")
def split_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_strategy(_marked(spark, sf_dir), "doc_id")


def _blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id")).alias("title"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query()
def packed_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.pack_paragraphs(_blank_lines(spark, sf_dir), "doc_id")


@query()
def smart_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.smart_split(_blank_lines(spark, sf_dir), "doc_id", "title")


@query()
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each extracted keyword."""
    d = read(spark, sf_dir, "documents").select("doc_id", classify.keywords(F.col("text")).alias("k"))
    return classify.keyword_index(d, "doc_id", "k")[1]


_NEAREST = "select vec_id, round(list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 6) as score from embeddings {w} order by score desc, vec_id limit 10"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return read(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


@query(_NEAREST.format(w=""))
def knn_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(read(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10)


@query(_NEAREST.format(w="where label = 3"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.knn(read(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10, where=F.col("label") == 3)


@query("""select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) desc, v.vec_id) as rank
from embeddings q, embeddings v where q.vec_id % 50 = 0 qualify rank <= 10""")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return search.knn_batch(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


def _asked(v: DataFrame) -> DataFrame:
    return v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query()
def knn_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of the approximate search against the exact one, and the largest share of all rows it scored exactly for a query."""
    v = read(spark, sf_dir, "embeddings")
    found = written(search.knn_probe(v, _asked(v), 10), "knn-found")
    share = found.agg(F.max("rescored").alias("most")).crossJoin(v.agg(F.count(F.lit(1)).alias("n"))).select(F.round(F.col("most") / F.col("n"), 6).alias("scored_exactly"))
    return search.recall(found, search.knn_batch(v, _asked(v), 10)).crossJoin(share)


@query("""select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as score
from embeddings q, embeddings v where q.vec_id % 50 = 0 qualify row_number() over (partition by q.vec_id order by score desc, v.vec_id) = 1""")
def knn_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of the approximate search for each query, which is the exact search's: a query's own cell comes first."""
    v = read(spark, sf_dir, "embeddings")
    return search.index_search(search.vector_index(v), v, _asked(v), 1, share=0.1).select("query_id", "vec_id", "score")


@query("select label, len(embedding) as dim, count(*) as n, count(case when abs(sqrt(list_inner_product(embedding::double[], embedding::double[])) - 1) <= 0.0001 then 1 end) as n_unit from embeddings group by 1, 2")
def vector_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_audit(read(spark, sf_dir, "embeddings"))


@query("select doc_id, lang from documents where contains(lower(text), 'license') or contains(lower(source), 'license')")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyword_search(read(spark, sf_dir, "documents"), "License", "text", "source").select("doc_id", "lang")


_SQL_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^\\PP''-]', '', 'g'), '\\s+'), lambda w: length(w) > 1)"


@query(f"""with w as (select doc_id, unnest({_SQL_WORDS.format(c="text")}) as word from documents) select word, count(distinct doc_id) as n_docs, count(*) as n from w group by 1""")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.vocabulary(read(spark, sf_dir, "documents"), "doc_id").where(F.length("word") > 1)


def _ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.clean_corpus(read(spark, sf_dir, "documents"), ["non_ascii"], out="text2").select("doc_id", F.col("text2").alias("text"))


@query()
def pct_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that cleaning to ASCII loses, single-character rule included (tests hold it against a plain version)."""
    return evaluate.percent_missing(_ascii(spark, sf_dir), read(spark, sf_dir, "documents"), "doc_id")


@query("""with a as (select conv_id, role as type, turn % 3 as depth, count(*) as o from conversations group by all), b as (select conv_id, case when turn = 0 then 'system' else role end as type, turn % 2 as depth, count(*) as s from conversations group by all),
j as (select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.type, b.type) as type, coalesce(o, 0) as o, coalesce(s, 0) as s from a full join b on a.conv_id = b.conv_id and a.type = b.type and a.depth = b.depth),
k as (select conv_id, type, sum(least(o, s)) as exact, sum(o - least(o, s)) as o, sum(s - least(o, s)) as s from j group by 1, 2) select conv_id, round(least(1.0, sum(exact + 0.5 * least(o, s)) / sum(exact + s)), 6)::double as score from k group by 1""")
def type_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    a = evaluate.type_frequency(c.withColumn("d", F.col("turn") % 3), "conv_id", "role", "d")
    b = evaluate.type_frequency(c.select("conv_id", F.when(F.col("turn") == 0, "system").otherwise(F.col("role")).alias("role"), (F.col("turn") % 2).alias("d")), "conv_id", "role", "d")
    return evaluate.type_match(a, b, "conv_id")


@query("select conv_id, role as type, turn % 3 as depth, count(*) as n from conversations group by all")
def type_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.type_frequency(read(spark, sf_dir, "conversations").withColumn("d", F.col("turn") % 3), "conv_id", "role", "d")


@query("""with r as (select d.lang, d.source, case when l.quality is not null then d.n_chars / 1000.0 end::double as v from documents d left join labels l on d.doc_id = l.doc_id)
select case when grouping(lang) = 0 then 'lang' when grouping(source) = 0 then 'source' else 'all' end as grouping, case when grouping(lang) = 0 then lang when grouping(source) = 0 then source else 'all' end as value, round(avg(v), 3) as average,
case when count(v) > 1 then round(stddev_samp(v), 3) end as sample_sd, case when count(v) > 1 then round(stddev_pop(v), 3) end as population_sd, count(*) as count from r group by grouping sets ((lang), (source), ())""")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = d.join(lab, "doc_id", "left").select("lang", "source", F.when(F.col("quality").isNotNull(), F.col("n_chars") / 1000.0).alias("v"))
    return evaluate.metric_summary(rows, "v", ["lang", "source"])


@query("""select d.source, round(sum(case when quality is not null then quality * (1.0 + toxic) end) / sum(case when quality is not null then 1.0 + toxic end), 6)::double as mean from documents d join labels l on d.doc_id = l.doc_id group by 1""")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("w", 1.0 + F.col("toxic"))
    return evaluate.weighted_mean(rows, "quality", "w", ["source"]).withColumn("mean", F.round("mean", 6))


_SQL_GRAMS = "select distinct {i}, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) as gram from (select {i}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from {t}) where len(w) >= 5"


@query(f"""with a as ({_SQL_GRAMS.format(i="doc_id", t="documents")}), b as ({_SQL_GRAMS.format(i="item_id", t="benchmark")}), n as (select item_id, count(*) as total from b group by 1)
select a.doc_id, b.item_id, count(*) as shared, round(count(*) / any_value(n.total), 6) as pct from a join b on a.gram = b.gram join n on n.item_id = b.item_id group by 1, 2""")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ngram_overlap(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id")


_SQL_NORM = "regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"""select item_id, levenshtein({_SQL_NORM}, {_SQL_NORM.replace("lower(text)", "text")})::int as distance, round(1.0 - least(1.0, levenshtein({_SQL_NORM}, {_SQL_NORM.replace("lower(text)", "text")}) / greatest(1, length({_SQL_NORM.replace("lower(text)", "text")}))), 6)::double as accuracy from benchmark""")
def edit_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("output"), F.col("text").alias("source"))
    return evaluate.edit_distance(pairs, "output", "source", (1, 1, 1)).select("item_id", "distance", "accuracy")


@query()
def edit_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read(spark, sf_dir, "benchmark").select("item_id", F.translate("text", "ae", "b").alias("output"), F.col("text").alias("source"))
    return evaluate.edit_distance(pairs, "output", "source").select("item_id", "distance", "accuracy")


_VIOLATIONS = [("doc_id % 5 = 0", "missing title"), ("doc_id % 7 = 0", "unknown type"), ("doc_id % 11 = 0", "negative page"), ("trim(coalesce(text, '')) = ''", "missing content")]


@query(" union all ".join(f"select doc_id::varchar as id, '{v}' as violation from documents where {w}" for w, v in _VIOLATIONS))
def validate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    e = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 7 == 0, "table_data").otherwise("general").alias("type"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("t").alias("title"), F.col("text").alias("content"), F.col("source").alias("source_file"), F.when(F.col("doc_id") % 11 == 0, -1).otherwise(1).alias("source_page"))
    return entries.violations(e)


@query("select doc_id as data_doc_id, lang as data_lang, source as data_meta_source, n_chars as data_meta_n_chars from documents")
def flat_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.struct("doc_id", "lang", F.struct("source", "n_chars").alias("meta")).alias("data"), F.lit(None).cast("string").alias("nothing"))
    return files.flat(d, drop_empty=True)


_EXTS = ["pdf", "docx", "CSV", "pptx", "jpeg", "eml", "md", "epub", "zip"]
_PATHS = f"(select doc_id, 'a/b/' || source || '.' || {_sql_pick(_EXTS, 'doc_id')} as path from documents)"


def _sql_ext(table: dict[str, list[str]], default: str) -> str:
    return "case " + " ".join(f"when ext in ({', '.join(_quoted(e) for e in v)}) then '{k}'" for k, v in table.items()) + f" else '{default}' end"


@query(f"""select doc_id, ext, {_sql_ext(files.CATEGORIES, "other")} as category, {_sql_ext(files.EXT_TOPIC, "Other")} as topic from (select doc_id, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as ext from {_PATHS})""")
def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/b/"), "source", F.lit("."), _pick(_EXTS, F.col("doc_id"))).alias("path"))
    return files.route_files(p).select("doc_id", "ext", "category", "topic")


@query(f"""select coalesce(category, 'total') as category, count(*) as n from (select {_sql_ext(files.CATEGORIES, "other")} as category from (select lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) as ext from {_PATHS})) group by grouping sets ((category), ())""")
def file_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_distribution(route_files(spark, sf_dir))


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    head = F.concat(F.lit("From: "), "lang", F.lit("@x.org\nTo: "), "source", F.lit("@y.org, all@y.org\nSubject: "), F.col("doc_id").cast("string"), F.lit("\nMessage-ID: <"), F.col("doc_id").cast("string"), F.lit("@z>\nDate: Fri, 26 Mar 2021 11:04:09 +1200\n\n"))
    return d.select("doc_id", F.concat(head, "text").alias("text"))


@query("""select doc_id, lang || '@x.org' as sent_from, source || '@y.org,all@y.org' as sent_to, doc_id::varchar as subject, doc_id || '@z' as message_id, '2021-03-25T23:04:09+00:00' as sent, text as body from documents""")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = files.messages(_mail(spark, sf_dir), "doc_id")
    return m.select("doc_id", "sent_from", F.array_join("sent_to", ",").alias("sent_to"), "subject", "message_id", "sent", "body")


@query("""select lang || '@x.org' as sent_from, t as sent_to, count(*) as n from (select lang, unnest([source || '@y.org', 'all@y.org']) as t from documents) group by 1, 2""")
def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.recipients(files.messages(_mail(spark, sf_dir), "doc_id"))


@query("select source as source_file, count(*)::int as total_entries, min(doc_id) as first_id from documents group by 1")
def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_file"), F.col("lang").alias("topic"))
    parts = files.envelopes(e, most=1000).select("source_file", "total_entries", F.col("entries")[0]["id"].alias("first_id"))
    return parts.groupBy("source_file").agg(F.sum("total_entries").cast("int").alias("total_entries"), F.min("first_id").alias("first_id"))


@query("""select doc_id, string_agg(line, chr(10) order by r) as text from (select source as doc_id, row_number() over (partition by source order by doc_id) as r, lang || ' | ' || n_chars as line from documents) where r <= 200 group by 1""")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("s"), "doc_id", "lang", "n_chars")
    return files.table_text(d, "doc_id", ["s"]).withColumnRenamed("s", "doc_id")


@query("""select doc_id, case when strpos(text, ' the ') > 0 then regexp_replace(left(text, strpos(text, ' the ') - 1), '\\s+$', '') end as before, case when strpos(text, ' the ') > 0 then regexp_replace(substr(text, strpos(text, ' the ') + 5), '^\\s+', '') end as after from documents""")
def text_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.text_before(F.col("text"), " the ").alias("before"), T.text_after(F.col("text"), " the ").alias("after"))


@query("""select doc_id, doc_id % 7 + 1 as section0, case when doc_id % 2 = 0 then (doc_id % 3)::varchar end as sub from documents""")
def ordered_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat((F.col("doc_id") % 7 + 1).cast("string"), F.lit("."), F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 3).cast("string")).otherwise(F.lit("")), F.lit(" "), "text")
    d = read(spark, sf_dir, "documents").select("doc_id", T.ordered_bullet_parts(n).alias("x"))
    return d.select("doc_id", F.col("x.section").cast("long").alias("section0"), "x.sub")


@query("""select doc_id, length(regexp_replace(text, '\\PL', '', 'g')) / greatest(1, length(text)) >= 0.8 as lettered, regexp_matches(text, '^!\\[.*?\\]\\(.*?\\)$') or (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 15 and not contains(text, '|')) as junk from documents""")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.mostly_letters(F.col("text"), 0.8).alias("lettered"), T.is_junk(F.col("text")).alias("junk"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as boxes on the page of their conversation."""
    x, y = (F.col("turn") % 3) * 40.0, (F.col("turn") % 2) * 30.0
    n = F.length("text") % 50
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.lit(1).alias("page"), F.col("turn").alias("ix"), x.alias("x1"), y.alias("y1"), (x + 30.0 + n).alias("x2"), (y + 20.0 + n).alias("y2"), "text")


_BOXES = "(select conv_id as doc, turn as ix, (turn % 3) * 40.0 as x1, (turn % 2) * 30.0 as y1, (turn % 3) * 40.0 + 30 + length(text) % 50 as x2, (turn % 2) * 30.0 + 20 + length(text) % 50 as y2 from conversations)"


@query(f"""select a.doc, a.ix as a, b.ix as b, round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)), 6)::double as share
from {_BOXES} a join {_BOXES} b on a.doc = b.doc and a.ix < b.ix where least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1)""")
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.box_overlaps(_boxes(spark, sf_dir), cell=50.0).select("doc", "a", "b", "share")


@query("""select conv_id, 0 as table_ix, 0 as "row", c::int as col, case when c = 0 then role else turn::varchar end as text, turn from conversations, (select unnest([0, 1]) as c)""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("text_as_html", F.concat(F.lit("<table><tr><th>"), "role", F.lit("</th><td><b>"), F.col("turn").cast("string"), F.lit("</b></td></tr></table>")))
    cells = evaluate.table_cells(c.select(F.struct("conv_id", "turn").alias("k"), "text_as_html"), "k")
    return cells.select("k.conv_id", "table_ix", "row", "col", "text", "k.turn")


@query("""select conv_id as doc, round(case when t.p = 0 and t.n = 0 then 1 else least(p, n) / greatest(1, p) end, 6)::double as precision, round(case when p = 0 and n = 0 then 1 else least(p, n) / greatest(1, n) end, 6)::double as recall from (select conv_id, count(case when role = 'user' then 1 end) as p, count(case when role = 'system' then 1 end) as n from conversations group by 1) t""")
def table_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.count_if(F.col("role") == "user").alias("n_predicted"), F.count_if(F.col("role") == "system").alias("n_truth"))
    return evaluate.table_detection(c.withColumn("n_matched", F.least("n_predicted", "n_truth")), "doc").select("doc", "precision", "recall")


@query()
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of turns, shifted by a hash, against themselves (tests hold the metric against a plain version)."""
    b = _boxes(spark, sf_dir).select(F.col("doc").alias("page"), (F.col("ix") % 2).alias("class"), "ix", "x1", "y1", "x2", "y2")
    shift = (F.pmod(F.xxhash64("page", "ix"), F.lit(20))).cast("double")
    p = b.withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift, "score": F.round(1 / (1 + shift), 6)})
    return evaluate.detection(p.drop("ix"), b.drop("ix"))


@query("""select conv_id, turn, '{"text":' || to_json(text) || ',"meta":{"id":' || turn || ',"role":"' || role || '"}}' as record from conversations""")
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("turn", "role", "text", "conv_id")
    k = c.withColumn("record", F.to_json(F.struct(*files.EXPORTS["prodigy"]("turn", ["role"]))))
    return k.select("conv_id", "turn", "record")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn % 2, length(text), turn) as place from conversations")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(1).alias("page"), F.length("text").alias("x"), (F.col("turn") % 2).alias("y"))
    return segment.reading_order(c, "conv_id", "page", "turn", "x", "y").select("conv_id", "turn", F.col("place").cast("long").alias("place"))


@query()
def language_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of each language by what the profiles of the other half of the corpus make of them."""
    d = read(spark, sf_dir, "documents")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = language.detect(d.where(~half), language.profiles(d.where(half)), "doc_id")
    return d.where(~half).join(found, "doc_id").groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


@query()
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tables of turns, in chunks with repeated headers."""
    row = F.concat(F.lit("<tr><td>"), F.col("turn").cast("string"), F.lit("</td><td>"), F.regexp_replace("text", "[<>]", ""), F.lit("</td></tr>"))
    t = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", row.alias("r")))), lambda x: x["r"]), "").alias("rows"))
    return segment.chunk_tables(t.select("conv_id", F.concat(F.lit("<table><tr><th>turn</th><th>text</th></tr>"), "rows", F.lit("</table>")).alias("text_as_html")), "conv_id", most=1000)


@query()
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as a stream of entries, counted by type."""
    schema = read(spark, sf_dir, "documents").schema
    import uuid

    name = "entries_" + uuid.uuid4().hex[:8]
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir))
    counts = ingest.running_counts(ingest.entries_of(stream.select(F.col("source").alias("source_file"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))), "type")
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """What a file stream can read for documents: the folder itself, or a pattern for the one file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return str(path) if fs.getFileStatus(path).isDirectory() else f"{sf_dir}/document[s].parquet"
