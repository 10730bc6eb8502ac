"""Registered queries of the text functions, each cleaning step and predicate over all documents, and their SQL.

The corpus has no ordered bullets, ligatures, state codes and the like: every query puts some at the front or the end of each
text, by its id, the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, entries, evaluate, segment
from .catalog import ORACLES, _pick, _quoted, _sql_pick, _sql_strip, query, read

_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')"


def _sql_regex(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _docs(spark: SparkSession, sf_dir: str, before: list[str] = [""], after: list[str] = [""], text: Column | None = None) -> DataFrame:  # noqa: B006
    """(doc_id, x): each text with a piece of each list put before and after it."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(_pick(before, F.col("doc_id")), F.col("text") if text is None else text, _pick(after, F.floor(F.col("doc_id") / 3))).alias("x"))


def _sql_docs(before: list[str] = [""], after: list[str] = [""], text: str = "text") -> str:  # noqa: B006
    return f"(select doc_id, {_sql_pick(before, 'doc_id')} || {text} || {_sql_pick(after, 'doc_id // 3')} as x from documents)"


def _sql_chain(c: str, steps) -> str:
    for a, b in steps:
        c = f"replace({c}, {_quoted(a)}, {_quoted(b)})"
    return c


_BULLETED = ["1.1 ", "a.b ", "2. ", " 12.3.4 ", "1..2 ", "", "300.1 "]


@query(f"""with s as (select *, regexp_extract(x, '^\\s*(\\S+)', 1) as w from {_sql_docs(_BULLETED)})
select doc_id, case when contains(w, '.') and not contains(w, '..') and length(split_part(w, '.', 1)) <= 2 then array_to_string(regexp_split_to_array({_sql_strip("x")}, '\\s+')[2:], ' ') else x end as cleaned from s""")
def ordered_bullet_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _BULLETED).select("doc_id", T.drop_ordered_bullet(F.col("x")).alias("cleaned"))


_BROKEN = ["".join(T.LIGATURES), "\x91a\x92 \x93b\x94", "it&apos;s", "â\x80\x99 â\x80“ â\x80™", "â\x80œa â\x80ť", "â\x80¦ â\x80x", "«a» ‘b’ „c“ 「d」", ""]


@query(f"""select doc_id, {_sql_chain("x", T.LIGATURES.items())} as ligatures, {_sql_chain("x", T.QUOTE_REPAIRS)} as repaired,
translate(x, {_quoted(T.DOUBLE_QUOTES + T.SINGLE_QUOTES)}, {_quoted('"' * len(T.DOUBLE_QUOTES) + "'" * len(T.SINGLE_QUOTES))}) as quotes from {_sql_docs(_BROKEN)}""")
def characters_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _docs(spark, sf_dir, _BROKEN).select("doc_id", T.expand_ligatures(x).alias("ligatures"), T.repair_quotes(x).alias("repaired"), T.standard_quotes(x).alias("quotes"))


_HEADED = ["Summary: ", "DESC ", "desc:: ", "", " summary "]
_ENDED = [" END", "end", "", " the end "]


@query(f"""select doc_id, {_sql_strip("regexp_replace(x, '(?i)^(?:summary|desc)[\\s:]*', '')")} as no_prefix, {_sql_strip("regexp_replace(x, '(?i)(?:end|fin)$', '')")} as no_postfix,
regexp_replace(x, '^(?:Summary|DESC)', '') as raw_prefix from {_sql_docs(_HEADED, _ENDED)}""")
def affixes_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _docs(spark, sf_dir, _HEADED, _ENDED).select("doc_id", T.drop_prefix(x, "summary|desc", True).alias("no_prefix"), T.drop_postfix(x, "end|fin", True).alias("no_postfix"), T.drop_prefix(x, "Summary|DESC", strip_after=False).alias("raw_prefix"))


def _broken_lines(text: Column) -> Column:
    made = lambda t, i: F.when(i % 5 == 3, F.concat(F.lit("- "), t)).when(i % 7 == 0, F.concat(F.lit("\n"), F.substring(t, 1, 12))).otherwise(t)
    return F.array_join(F.transform(F.split(text, "\n"), made), "\n")


_SQL_BROKEN_LINES = "array_to_string(list_transform(string_split(text, chr(10)), lambda t, i: case when (i - 1) % 5 = 3 then '- ' || t when (i - 1) % 7 = 0 then chr(10) || left(t, 12) else t end), chr(10))"
_SQL_JOINED = _sql_strip("regexp_replace({c}, '\\s*\\n\\s*', ' ', 'g')")
_SQL_REGROUPED = f"""select doc_id, string_agg(array_to_string(case when regexp_matches({_sql_strip("p")}, '^{T._CLASS}') then list_filter(list_transform(string_split(regexp_replace(p, '\\n(\\s*{T._CLASS})', chr(1) || '\\1', 'g'), chr(1)), lambda s: {_SQL_JOINED.format(c="s")}), lambda s: s <> '')
when len(list_filter(l, lambda s: len(string_split(s, ' ')) >= 5)) = 0 then l else [regexp_replace({_sql_strip("p")}, '\\s*\\n\\s*', ' ', 'g')] end, chr(10) || chr(10)), chr(10) || chr(10) order by k) as cleaned
from (select *, list_filter(list_transform(string_split(p, chr(10)), lambda s: {_sql_strip("s")}), lambda s: s <> '') as l from (select doc_id, unnest(a) as p, unnest(range(len(a))) as k
from (select doc_id, list_filter(regexp_split_to_array({_SQL_BROKEN_LINES}, '(?:\\s*\\n\\s*){{2,}}'), lambda p: {_sql_strip("p")} <> '') as a from documents))) group by 1"""


@query(f"select d.doc_id, coalesce(r.cleaned, '') as cleaned from documents d left join ({_SQL_REGROUPED}) r on d.doc_id = r.doc_id")
def paragraphs_regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.regroup_paragraphs(_broken_lines(F.col("text"))).alias("cleaned"))


@query("""with l as (select doc_id, text, string_split(text, chr(10)) as a from documents)
select doc_id, array_to_string(list_filter(a, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''), chr(10) || chr(10)) as cleaned from l
where len(list_filter(a[1:2000], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') = '')) / len(a[1:2000]) < 0.1""")
def lines_as_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus has few blank lines, so lines are paragraphs; the others are regrouped (see paragraphs_regrouped)."""
    lines = F.slice(F.split("text", r"\n"), 1, 2000)
    few = F.size(F.filter(lines, lambda x: T.strip(x) == "")) / F.size(lines) < 0.1
    return read(spark, sf_dir, "documents").where(few).select("doc_id", T.auto_regroup(F.col("text")).alias("cleaned"))


_MATH = ["#(x) ", "#e = 1 ", "#<a> ", "p#e ", "\\# ", "# (y) ", ""]


def _sql_math(c: str) -> str:
    for p, to in T.MU_PLACES:
        c = f"regexp_replace({c}, {_sql_regex(p)}, {_quoted(to.replace('{mu}', '$' + chr(92) * 2 + 'mu$').replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    return c


@query(f"select doc_id, {_sql_math('x')} as cleaned from {_sql_docs(_MATH)}")
def math_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _MATH).select("doc_id", T.repair_math(F.col("x")).alias("cleaned"))


@query("""select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g') as cleaned from pages""")
def tags_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("cleaned"))


_SNOW = "☃" * 400
_GARBLED = [_SNOW, "a\x01b\x07 ", "\x7f", ""]


@query(f"""select doc_id, case when length(regexp_replace(x, '[^\\x20-\\x7e\\n\\r\\t\\p{{L}}\\p{{N}}\\p{{P}}]', '', 'g')) / greatest(1, length(x)) < 0.6 then '' else regexp_replace(x, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') end as cleaned from {_sql_docs(_GARBLED)}""")
def garble_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _GARBLED).select("doc_id", T.without_garble(F.col("x")).alias("cleaned"))


_SCHOLAR = ["$$x$$ Abstract ", "\\frac{1} Section ", "", "1.2.3 lambda ", "$1$ ^2^ <AB, c "]


@query(f"""select doc_id, score, score >= 2 as academic from (select doc_id, ({" + ".join(f"regexp_matches(x, {_sql_regex('(?i)' + p)})::int" for p in T.ACADEMIC)})::int as score from {_sql_docs(_SCHOLAR, text=_ASCII)})""")
def academic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _docs(spark, sf_dir, _SCHOLAR, text=T.drop_non_ascii(F.col("text"))).select("doc_id", T.academic_score(x).alias("score"), T.is_academic(x).alias("academic"))


_LINES = ["Austin, TX 78701 ", "New Orleans, Louisiana 70112-1234 ", "Call us: ", "They were ", "x ", ""]
_CALLS = ["", " +1 512-555-1234", " (512) 555 1234 x12", " 12 34"]


@query(f"""select doc_id, regexp_matches({_sql_strip("x")}, {_sql_regex(T.CITY_STATE_ZIP)}) as address, regexp_matches({_sql_strip("x")}, {_sql_regex(T.PHONE_AT_END)}) as phone, regexp_matches(x, {_sql_regex(T.VERB)}) as verb,
len(list_intersect(regexp_split_to_array(regexp_replace(lower(x), '\\p{{P}}', '', 'g'), '\\s+'), ['they', 'license', 'austin'])) > 0 as known from {_sql_docs(_LINES, _CALLS, _ASCII)}""")
def text_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    d = _docs(spark, sf_dir, _LINES, _CALLS, T.drop_non_ascii(F.col("text")))
    return d.select("doc_id", T.is_city_state_zip(x).alias("address"), T.has_phone(x).alias("phone"), T.has_verb(x).alias("verb"), T.has_word_of(x, ["they", "license", "austin"]).alias("known"))


@query(f"""with p as (select doc_id, {_sql_pick(["x", "1. y", "* z"], "doc_id")} as t, (doc_id % 100)::double as top, (doc_id % 100 + 4)::double as bottom from documents)
select doc_id, case when bottom / 100 <= 0.07 then 'Header' when top / 100 >= 0.93 then 'Footer' end as part, case when bottom / 100 <= 0.07 then 'Header' when top / 100 >= 0.93 then 'Footer' when t = 'x' then 'Title' else 'ListItem' end as type from p""")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by their place on the page, then by their text."""
    top = (F.col("doc_id") % 100).cast("double")
    part = T.page_part(top, top + 4, F.lit(100.0))
    return read(spark, sf_dir, "documents").select("doc_id", part.alias("part"), T.element_type(_pick(["x", "1. y", "* z"], F.col("doc_id")), part).alias("type"))


_PROMOTED = ["1.2 Scope of it ", "**Bold title** ", "- 3) Item three ", "BIG CAPITAL WORDS\n1 ", "", "2.1.3   Deep one\n"]


@query(f"""with s as (select doc_id, x, left(x, 1000) as p from {_sql_docs(_PROMOTED)}),
u as (select *, {_sql_strip("regexp_extract(p, '^\\s*([A-Z][A-Z\\s]{5,60})', 1)")} as upper_ from s)
select doc_id, case when length(x) < 10 then '' else left(coalesce(
case when regexp_matches(p, '^\\s*\\d+(\\.\\d+){{1,2}}\\s+.{{3}}') then regexp_extract(p, '^\\s*(\\d+(\\.\\d+){{1,2}})\\s+(.{{3,100}})', 1) || ' ' || {_sql_strip("regexp_extract(p, '^\\s*(\\d+(\\.\\d+){1,2})\\s+(.{3,100})', 3)")} end,
nullif({_sql_strip("regexp_extract(p, '^\\s*\\*\\*([^*]{3,80})\\*\\*', 1)")}, ''),
case when regexp_matches(p, '^\\s*[-*]\\s*\\d+\\)\\s+.{{3}}') then regexp_extract(p, '^\\s*[-*]\\s*(\\d+)\\)\\s+(.{{3,100}})', 1) || ') ' || {_sql_strip("regexp_extract(p, '^\\s*[-*]\\s*(\\d+)\\)\\s+(.{3,100})', 2)")} end,
case when length(upper_) >= 5 and contains(upper_, ' ') then upper_ end, nullif({_sql_strip("regexp_extract(p, '^\\s*([^\\n]{10,120})', 1)")}, ''), ''), 100) end as heading from u""")
def headings_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _PROMOTED).select("doc_id", T.promoted_heading(F.col("x")).alias("heading"))


@query("""select doc_id, greatest(1, floor((doc_id % 97) / greatest(n_chars, 1) * 30))::int as page, case when length(source || '/' || left(text, 40)) > 40 then left(source || '/' || left(text, 40), 37) || '...' else source || '/' || left(text, 40) end as shown from documents""")
def pages_and_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", T.approx_page(F.col("doc_id") % 97, F.col("n_chars")).alias("page"), T.display_source(F.concat("source", F.lit("/"), F.substring("text", 1, 40))).alias("shown"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


_KEYED = ["They met. What is USB? Step 4: \"the red one\" and the Printer manual. HTTP ", "How to. Paper size: NASA USB USB NASA ESA CERN ", ""]


def _sql_keywords(docs: str) -> str:
    """(doc_id, k: its keywords) of (doc_id, x). Accented letters are letters at a word's edge for Spark, so they become _ for that test."""
    return f"""(with s as (select doc_id, regexp_replace(x, '[<>{{}}\\[\\]\\\\|]', ' ', 'g') as t from {docs}),
u as (select *, regexp_replace(t, '[À-ɏ]', '_', 'g') as v from s), c as (select doc_id, regexp_extract_all(v, '\\b[A-Z]{{3,}}\\b') as caps, list_filter(regexp_extract_all(t, '(?:^|\\n|\\.\\s|:\\s)([A-Z][a-zA-Z]{{2,}})', 1), lambda w: not list_contains({_sql_list(classify.STOPWORDS + classify.OPENERS)}, lower(w)))[1:4] as starts,
regexp_extract_all(v, '(?i)\\b(?:Step|Phase|Chapter|Section)\\s+\\d+\\b')[1:2] as steps, regexp_extract_all(t, '"([^"]{{3,30}})"', 1)[1:2] as quoted, list_transform(regexp_extract_all(v, '(?i)\\b(?:{"|".join(classify.DOMAIN_WORDS)})\\b'), lambda w: lower(w))[1:3] as domain from u),
e as (select doc_id, list_filter(list_transform(list_concat(list_filter(caps, lambda w, i: list_position(caps, w) = i)[1:4], starts, steps, quoted, domain), lambda w: trim(w)), lambda w: length(w) >= 3 and not list_contains({_sql_list(classify.STOPWORDS)}, lower(w))) as k from c)
select doc_id, list_filter(k, lambda w, i: list_position(list_transform(k, lambda v: lower(v)), lower(w)) = i)[1:8] as k from e)"""


@query(f"select doc_id, array_to_string(k, '|') as keywords from {_sql_keywords(_sql_docs(_KEYED, text=_ASCII))}")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each text, non-ASCII characters off (word boundaries differ there between the two engines)."""
    d = _docs(spark, sf_dir, _KEYED, text=T.drop_non_ascii(F.col("text")))
    return d.select("doc_id", F.array_join(classify.keywords(F.col("x")), "|").alias("keywords"))


@query("""select keyword, count(distinct doc_id) as n_docs from (select doc_id, unnest(list_distinct([lower(lang), lower(source)] || string_split(text, ' '))) as keyword from documents) group by 1""")
def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.concat(F.array(F.lower("lang"), F.lower("source")), F.split("text", " "))
    return classify.keyword_index(read(spark, sf_dir, "documents").withColumn("k", k), "doc_id", "k")[1]


_SQL_SPLIT_WORDS = f"list_filter(regexp_split_to_array(case when regexp_matches(p, '^{T._CLASS}') and not regexp_matches(substr(p, 2), '^{T._CLASS}') then {_sql_strip(f"regexp_replace(p, '^{T._CLASS}', '')")} else p end, '\\s+'), lambda x: x <> '')"
_SQL_COUNTED = "list_filter(w, lambda x, i: length(x) > 1 or (regexp_matches(x, '^[\\p{L}\\p{N}]$') and coalesce(length(w[i + 1]), 0) <> 1 and (i = 1 or length(w[i - 1]) <> 1)))"


def _sql_bag(text: str, table: str = "documents") -> str:
    """(doc_id, w: the words that count) of a table, the single-character rule included."""
    return f"(select doc_id, {_SQL_COUNTED} as w from (select doc_id, {_SQL_SPLIT_WORDS} as w from (select doc_id, regexp_replace(lower({text}), '[^\\PP''-]', '', 'g') as p from {table})))"


@query(f"select word, count(distinct doc_id) as n_docs, count(*) as n from (select doc_id, unnest(w) as word from {_sql_bag('text')}) group by 1")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.vocabulary(read(spark, sf_dir, "documents"), "doc_id")


def _sql_missing(output: str) -> str:
    return f"""with s as (select doc_id, unnest(w) as word from {_sql_bag("text")}), o as (select doc_id, unnest(w) as word from {_sql_bag(output)}),
a as (select doc_id, word, count(*) as n from s group by 1, 2), b as (select doc_id, word, count(*) as m from o group by 1, 2)
select d.doc_id, least(1.0, round(coalesce(sum(greatest(n - coalesce(m, 0), 0)) / nullif(sum(n), 0), 0), 3))::double as pct_missing from documents d left join a on a.doc_id = d.doc_id left join b on a.doc_id = b.doc_id and a.word = b.word group by 1"""


@query(_sql_missing("case when doc_id % 3 = 0 then left(text, n_chars // 2) else replace(text, 'the', 'a b') end"))
def words_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each text's words that a damaged copy lacks."""
    d = read(spark, sf_dir, "documents")
    damaged = F.when(F.col("doc_id") % 3 == 0, F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_chars") / 2).cast("int"))).otherwise(F.replace("text", F.lit("the"), F.lit("a b")))
    return evaluate.percent_missing(d.select("doc_id", damaged.alias("text")), d, "doc_id")


_CLEANERS = ["lower", lambda c: F.replace(c, F.lit("the "), F.lit("")), "whitespace"]


@query(f"""select doc_id, {_sql_strip("regexp_replace(regexp_replace(replace(lower(text), 'the ', ''), '[' || chr(160) || '\\n]', ' ', 'g'), ' {2,}', ' ', 'g')")} as cleaned from documents""")
def cleaned_by_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named steps and a function of the user's own."""
    return entries.clean_corpus(read(spark, sf_dir, "documents"), _CLEANERS).select("doc_id", "cleaned")


_SQL_PARTS = f"list_filter(list_transform(regexp_split_to_array({_SQL_BROKEN_LINES}, '\\n{{2,}}'), lambda p: {_sql_strip('p')}), lambda p: p <> '')"
_SQL_TABLE = "(contains({c}, '|') and contains({c}, chr(10)))"
_NO_TABLES = f"not {_SQL_TABLE.format(c='x.cur')} and not {_SQL_TABLE.format(c='a.cur')} and length(x.cur) <= 200"


def _sql_fold(source: str, joins: str, keep: str = "doc_id") -> str:
    """(keep, b: the blocks) of (keep, parts): an ordered fold as in segment._fold; joins speaks of a.cur (the block) and x.cur (the next)."""
    return f"""(select {keep}, list_append(f.out, f.cur) as b from (select {keep}, list_reduce(list_transform(parts, lambda s: {{'out': []::varchar[], 'cur': s}}),
lambda a, x: case when {joins} then {{'out': a.out, 'cur': a.cur || chr(10) || chr(10) || x.cur}} else {{'out': list_append(a.out, a.cur), 'cur': x.cur}} end) as f from {source} where len(parts) > 0))"""


def _sql_packed(parts: str) -> str:
    first = _sql_strip("string_split(t, chr(10))[1]")
    return f"""with cut as (select doc_id, {parts} as parts from documents), r as (select doc_id, len(b) as n, unnest(b) as t, unnest(range(len(b))) as block from {_sql_fold("cut", _NO_TABLES)})
select doc_id, block::int as block, case when length({first}) > 80 then left({first}, 80) || '...' else {first} end as title, left(t, 2000) as content, greatest(1, floor(block / greatest(n, 1) * 30))::int as page from r where length(t) >= 10"""


#: The parts of texts whose line feeds were doubled.
_SQL_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda p: {_sql_strip('p')}), lambda p: p <> '')"


@query(_sql_packed(_SQL_PARTS))
def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed into blocks (an ordered fold on both sides)."""
    d = read(spark, sf_dir, "documents").select("doc_id", _broken_lines(F.col("text")).alias("text"))
    return segment.pack_paragraphs(d, "doc_id")


_SQL_JUNK = f"(regexp_matches(p, '^!\\[.*?\\]\\(.*?\\)$') or (regexp_matches(p, '^\\*?\\*?(Figure|Table)\\s+\\d+.*?\\*?\\*$') and length(p) < 80) or (length(p) < 15 and not contains(p, '|')))"
_SPLIT_TITLES = ["To print ", "Step list ", "Doc "]


def _sql_smart(title: str, parts: str) -> str:
    solid = f"list_filter({parts}, lambda p: not {_SQL_JUNK})"
    return f"""with cut as (select doc_id, {title} as title, {solid} as parts from documents), s as (select doc_id, title, list_filter(b, lambda t: length(t) >= 20) as b from {_sql_fold("cut", _NO_TABLES + " and length(a.cur) <= 640", "doc_id, title")}),
r as (select doc_id, title, unnest(b) as content, unnest(range(len(b))) as part from s)
select doc_id, part::int as part, case when part > 0 then title || ' (cont. ' || part || ')' else title end as title, content from r"""


_SQL_STEP = "(starts_with(lower(title), 'to ') and regexp_matches(content, '(?:^|\\n)[\\s*•\\-]*\\d+\\.')) or (contains(lower(title), 'step') and regexp_matches(content, '(?:^|\\n)\\s*-\\s*\\d+\\.'))"


@query(f"select *, case when {_SQL_STEP} then 'sop_step' else 'general' end as type from ({_sql_smart(_sql_pick(_SPLIT_TITLES, 'doc_id') + ' || doc_id', _SQL_PARTS)})")
def smart_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split by size with junk dropped (an ordered fold on both sides)."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.concat(_pick(_SPLIT_TITLES, F.col("doc_id")), F.col("doc_id").cast("string")).alias("title"), F.lit("general").alias("kind"), _broken_lines(F.col("text")).alias("text"))
    return segment.smart_split(d, "doc_id", "title", kind="kind")


# SQL of queries that are registered elsewhere
ORACLES["pct_missing"] = _sql_missing(_ASCII)
ORACLES["packed_paragraphs"] = _sql_packed(_SQL_LINES)
ORACLES["smart_split"] = _sql_smart("'Doc ' || doc_id", _SQL_LINES)
ORACLES["keyword_index"] = f"select keyword, count(distinct doc_id) as n_docs from (select doc_id, unnest(list_distinct(k)) as keyword from {_sql_keywords('(select doc_id, text as x from documents)')}) group by 1"
