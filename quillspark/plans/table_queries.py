"""Registered queries of the readers and writers, of entries, chunks and evaluation, and their SQL.

Queries of readers write the given tables in the format in question to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, entries, evaluate, registry, search, segment
from ..sources import files, html
from ..sources.scratch import shared_path
from ..streaming import ingest
from .catalog import ORACLES, _pick, _quoted, _sql_pick, _sql_rules, _sql_strip, _sql_type, query, read


@query("select lang, 'text' as category, sum(octet_length(encode(text)) + 1)::bigint as n_bytes, sum(length(text) + 1)::bigint as n_chars from documents group by 1")
def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files in a folder for each language: found, routed, read and decoded."""
    path = shared_path(spark, "texts")
    read(spark, sf_dir, "documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").option("maxRecordsPerFile", 500).text(path)
    found = files.route_files(files.scan_corpus(spark, path, include=["txt"], exclude_dirs=["none"]))
    good, bad = files.read_text(found)
    rows = good.unionByName(bad.select("path", "length", F.lit("bad").alias("category"), F.lit("").alias("text")), allowMissingColumns=True)
    lang = F.regexp_extract("path", "lang=([^/]+)/", 1)
    return rows.groupBy(lang.alias("lang"), "category").agg(F.sum("length").alias("n_bytes"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("select doc_id, lang, source, n_chars, replace(text, chr(10), ' ') as line from documents")
def delimited_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "delimited")
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.replace("text", F.lit("\n"), F.lit(" ")).alias("line"))
    d.write.option("sep", ";").option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = files.read_delimited(spark, path)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), "line")


@query("select 'd' || doc_id as id, 'general' as type, lang as title, text as content, source as source_file from documents")
def kb_json_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "kb")
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("general").alias("type"), F.col("lang").alias("title"), F.col("text").alias("content"), F.col("source").alias("source_file"))
    files.write_kb_json(d, path, most=100)
    return files.read_kb_json(spark, path, multiline=False).select("id", "type", "title", "content", "source_file")


@query("select case when doc_id % 10 = 0 then null else doc_id end as doc_id, case when doc_id % 10 = 0 then null else lang end as lang, doc_id % 10 = 0 as malformed from documents")
def ndjson_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON, every tenth one cut short: rows and dead letters."""
    path = shared_path(spark, "ndjson")
    line = F.to_json(F.struct("doc_id", "lang", "text"))
    read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value")).write.text(path)
    rows, bad = files.read_ndjson(spark, path, "doc_id long, lang string")
    return rows.withColumn("malformed", F.lit(False)).unionByName(bad.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(True).alias("malformed")))


_KINDS = ["Title", "NarrativeText", "Nonsense", "ListItem"]


@query(f"select * from (select {_sql_pick(_KINDS, 'turn')} as type, 'e' || conv_id || '_' || turn as element_id, text, (turn % 3)::int as page_number, role as languages from conversations) where type <> 'Nonsense'")
def elements_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements written without null fields and read again; unknown types are left out."""
    path = shared_path(spark, "elements")
    c = read(spark, sf_dir, "conversations")
    meta = F.struct(F.array("role").alias("languages"), (F.col("turn") % 3).cast("int").alias("page_number"), F.lit(None).cast("string").alias("url"))
    files.write_elements(c.select(_pick(_KINDS, F.col("turn")).alias("type"), F.concat(F.lit("e"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("element_id"), "text", meta.alias("metadata")), path)
    rows = files.read_elements_json(spark, path, multiline=False)
    return rows.select("type", "element_id", "text", F.col("metadata.page_number").alias("page_number"), F.array_join("metadata.languages", ",").alias("languages"))


@query("select conv_id, turn, case when turn % 2 = 0 then round((turn * 7 + 3) / 16.0 + 0.03, 1) else round((turn * 7 + 3) / 16.0 + 0.003, 2) end::double as x from conversations")
def points_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("pixels", F.col("turn") % 2 == 0)
    x = (F.col("turn") * 7 + 3) / 16.0 + F.when(F.col("pixels"), 0.03).otherwise(0.003)
    p = files.rounded_points(F.array(F.struct(x.alias("x"), x.alias("y"))), F.col("pixels"))
    return c.select("conv_id", "turn", p[0]["x"].alias("x"))


@query(f"select doc_id, seq::int as seq, t as text from (select doc_id, unnest([source, {_sql_strip('text')}, lang]) as t, unnest([0, 1, 2]) as seq from (select doc_id, lang, source, regexp_replace(text, '[<>&]', ' ', 'g') as text from documents)) where t <> ''")
def xml_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = F.regexp_replace("text", "[<>&]", " ")

    def referred(c: str) -> Column:
        out = F.col(c)
        for x in "&<>" + files.XML_SPACE:
            out = F.replace(out, F.lit(x), F.lit(f"&#{ord(x)};"))
        return F.coalesce(out, F.lit(""))

    x = F.concat(F.lit("<?xml version='1.0'?>\n<doc><a> "), referred("source"), F.lit("</a><!-- no <b>text</b> -->\n<b><c>"), F.coalesce(safe, F.lit("")), F.lit("</c>"), referred("lang"), F.lit("</b></doc>"))
    return files.xml_leaves(read(spark, sf_dir, "documents").select("doc_id", x.alias("text")), "doc_id")


@query("select doc_id, lang, n_chars from documents")
def xml_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "xml")
    files.write_xml(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path, "row")
    return files.read_xml_leaves(spark, path, "row").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("n_chars").cast("long").alias("n_chars"))


@query("select source as connector, lang as filename, round(avg(n_chars), 3)::double as score from documents group by 1, 2")
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "report")
    rows = read(spark, sf_dir, "documents").groupBy(F.col("source").alias("connector"), F.col("lang").alias("filename")).agg(F.round(F.avg("n_chars"), 3).alias("score"))
    files.write_metric_report(rows, path)
    return spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("score", F.col("score").cast("double"))


@query("select doc_id, text, source as company from documents where source = 'src1' union all select doc_id, 'new', 'src1' from labels")
def store_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written, added to, and read by company."""
    path = shared_path(spark, "store")
    files.store_write(read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("company")), path)
    files.store_write(read(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("text"), F.lit("src1").alias("company")), path, "append")
    return spark.read.parquet(path).where("company = 'src1'").select("doc_id", "text", "company")


@query("select doc_id, quality from labels")
def store_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store cleared and then filled anew."""
    path = shared_path(spark, "store")
    old, new = read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("quality")), read(spark, sf_dir, "labels").select("doc_id", "quality")
    files.store_write(old, path, by=None)
    files.clear_store(spark, path, old.schema)
    files.store_write(new, path, "append", by=None)
    return spark.read.parquet(path)


_ID, _TXT = "'\"' || conv_id || '_' || turn || '\"'", "to_json(text)"
_SQL_SHAPES = {
    "baseplate": f"""'{{"data":{{"id":' || {_ID} || ',"text":' || {_TXT} || ',"role":"' || role || '"}},"metadata":{{"role":"' || role || '"}}}}'""",
    "weaviate": f"""'{{"text":' || {_TXT} || ',"category":"Text","role":"' || role || '"}}'""",
    "datasaur": f"""'{{"text":' || {_TXT} || ',"entities":[]}}'""",
    "labelbox": f"""'{{"externalId":' || {_ID} || ',"data":' || {_TXT} || ',"attachments":[]}}'""",
    "label_studio": f"""'{{"data":{{"text":' || {_TXT} || ',"ref_id":' || {_ID} || '}}}}'""",
    "argilla": f"""'{{"text":' || {_TXT} || ',"metadata":{{"role":"' || role || '"}}}}'""",
}


@query(" union all ".join(f"select '{k}' as shape, conv_id || '_' || turn as element_id, {v} as record from conversations" for k, v in _SQL_SHAPES.items()))
def export_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "conversations").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("element_id"), "text", "role", F.lit("Text").alias("type"))
    return entries.merge([files.export_records(e, k, meta=["role"]).select(F.lit(k).alias("shape"), "element_id", "record") for k in _SQL_SHAPES])


@query("""select doc_id as element_id, '{"text":' || to_json(text) || ',"meta":{"id":' || doc_id || case when l.quality is null then '' else ',"quality":' || l.quality end || '}}' as record from documents d left join labels l using (doc_id)""")
def export_with_side_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels joined to the elements they belong to."""
    e = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("element_id"), "text")
    return files.export_records(e, "prodigy", side=read(spark, sf_dir, "labels").select(F.col("doc_id").alias("element_id"), "quality"))


@query("""with e as (select 'c' || conv_id as filename, turn // 2 as page_number, role as type, turn::double as x1, 0.0::double as y1, turn + 2.0::double as x2, 3.0::double as y2 from conversations)
select dense_rank() over (order by filename, page_number)::bigint as image_id, dense_rank() over (order by type)::int as category_id, x1, x2 - x1 as width, y2 - y1 as height, (x2 - x1) * (y2 - y1) as area from e""")
def coco(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn").cast("double")
    e = read(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("filename"), F.floor(F.col("turn") / 2).alias("page_number"), F.col("role").alias("type"), t.alias("x1"), F.lit(0.0).alias("y1"), (t + 2.0).alias("x2"), F.lit(3.0).alias("y2"))
    a = files.to_coco(e)[2]
    return a.select("image_id", "category_id", F.col("bbox")[0].alias("x1"), F.col("bbox")[2].alias("width"), F.col("bbox")[3].alias("height"), "area")


@query("""select doc_id, coalesce(case when doc_id % 3 = 0 then source end, case when doc_id % 3 = 1 then lang end, 'NA') as company, lang as topic, case when doc_id % 2 = 0 then 'unknown' else source end as source_file from documents""")
def metadata_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat before nested before default; blanks count as missing."""
    k = F.col("doc_id") % 3
    flat = F.when(k == 0, F.concat(F.lit(" "), "source", F.lit(" "))).when(k == 1, F.lit("  "))
    d = read(spark, sf_dir, "documents").withColumns({"company": flat, "metadata": F.struct(F.when(k == 1, F.col("lang")).otherwise(F.lit("")).alias("company")), "topic": F.col("lang"), "source_file": F.when(F.col("doc_id") % 2 == 1, F.col("source"))})
    return entries.normalize_metadata(d, ("company", "metadata.company")).select("doc_id", "company", "topic", "source_file")


@query("""select doc_id as id, lang, lang || ', ' || source as keywords, '{"n":' || n_chars || ',"s":"' || source || '"}' as extra from documents""")
def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.array("lang", "source").alias("keywords"), F.struct(F.col("n_chars").alias("n"), F.col("source").alias("s")).alias("extra"))
    return entries.store_metadata(d, ["lang"], ["keywords"], ["extra"])


@query("select conv_id, turn, role in ('user', 'system') as included from conversations where role in ('user', 'system') or role <> 'user'")
def types_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    some, rest = entries.filter_types(c, include=["user", "system"], kind="role"), entries.filter_types(c, exclude=["user", "system"], kind="role")
    return some.withColumn("included", F.lit(True)).unionByName(rest.withColumn("included", F.lit(False))).select("conv_id", "turn", "included")


@query("select conv_id, turn from conversations where not (turn * 30 % 700 + 20 < 50 or turn * 30 % 700 > 640) and turn % 4 <> 3")
def furniture_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.col("turn") * 30 % 700
    b = read(spark, sf_dir, "conversations").select("conv_id", "turn", top.alias("top"), (top + 20).alias("bottom"), F.lit(700).alias("height"), F.when(F.col("turn") % 4 == 3, "Chapter one . . . . . 12").otherwise("a line... 5").alias("text"))
    return segment.drop_page_furniture(b, "top", "bottom", "height").select("conv_id", "turn")


_HEAD = f"Give each entry one type of {', '.join(entries.TYPES)}, keywords and a confidence, as a JSON list in the order of the entries."


@query(f"""with n as (select doc_id, left(text, 50) as title, left(text, 300) as content, row_number() over (order by doc_id) - 1 as r from documents)
select (r // 5)::bigint as batch, {_quoted(_HEAD)} || chr(10) || chr(10) || string_agg('Entry ' || (r % 5) || chr(10) || 'Title: ' || title || chr(10) || 'Content: ' || content, chr(10) || chr(10) order by r) as prompt from n group by 1""")
def llm_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 50).alias("title"), F.col("text").alias("content"))
    return entries.prompts(entries.llm_batches(d, 5, "doc_id")).select("batch", "prompt")


@query("""with n as (select doc_id, row_number() over (order by doc_id) - 1 as r from documents)
select doc_id as id, 'faq' as llm_type, (r % 5 / 4.0)::double as llm_confidence from n where r // 5 % 3 <> 2 and (r // 5 % 3 = 0 or r % 5 < 3)""")
def llm_batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to batches matched by place: whole ones, short ones and some that are no JSON."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("t").alias("title"), F.lit("c").alias("content"))
    asked = entries.prompts(entries.llm_batches(d, 5, "doc_id"))
    one = lambda i: F.concat(F.lit('{"type":"faq","confidence":'), (i / 4.0).cast("string"), F.lit("}"))
    some = lambda n: F.concat(F.lit("```json\n["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), ","), F.lit("]\n```"))
    answers = asked.withColumn("answer", F.when(F.col("batch") % 3 == 0, some(5)).when(F.col("batch") % 3 == 1, some(3)).otherwise(F.lit("no idea")))
    return entries.batch_results(answers)


_NAMES = ["sony_report", "notes", "hp_manual_x", "misc"]
_SQL_COMPANY = _sql_rules("lower(filename)", [(n.lower(), n) for n in classify.KNOWN_COMPANIES], "null")
_SQL_TOPIC = _sql_rules("lower(filename)", [(w, t) for t, ws in classify.TOPIC_RULES.items() for w in ws], "null")


@query(f"""with f as (select doc_id || '_' || {_sql_pick(_NAMES, "doc_id")} as filename, doc_id, lang, source from documents),
r as (select filename, coalesce(case when doc_id % 5 = 0 then source end, {_SQL_COMPANY}) as company, coalesce(case when doc_id % 5 = 0 then lang end, {_SQL_TOPIC}, 'Other') as topic from f) select * from r where company is not null""")
def labels_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a file: of its first labelled entry, else of its name, else the default; files without one are left out."""
    d = read(spark, sf_dir, "documents").withColumn("filename", F.concat_ws("_", F.col("doc_id").cast("string"), _pick(_NAMES, F.col("doc_id"))))
    fifth = F.col("doc_id") % 5 == 0
    first = d.where(fifth).select("filename", F.lit(0).alias("seq"), F.lit(" ").alias("company"), F.lit("").alias("topic"))
    second = d.where(fifth).select("filename", F.lit(1).alias("seq"), F.col("source").alias("company"), F.col("lang").alias("topic"))
    third = d.where(fifth).select("filename", F.lit(2).alias("seq"), F.lit("late").alias("company"), F.lit("late").alias("topic"))
    return classify.resolve_labels(d.select("filename"), first.unionByName(second).unionByName(third), topic="Other").select("filename", "company", "topic")


_SQL_CHUNKS = "(select doc_id, unnest(range(0, greatest(1, (length(text) + 399) // 400))) as chunk_seq, text from documents where length(text) > 0)"
_SQL_TAIL = _sql_strip("right(substr(text, (chunk_seq - 1) * 400 + 1, 400), 40)")


@query(f"""select doc_id, chunk_seq::int as chunk_seq, case when chunk_seq > 0 and {_SQL_TAIL} <> '' then {_SQL_TAIL} || ' ' else '' end || substr(text, chunk_seq * 400 + 1, 400) as chunk from {_SQL_CHUNKS}""")
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = segment.hard_cut(read(spark, sf_dir, "documents"), "doc_id", size=400)
    return segment.overlapped(c, "doc_id", 40, all_chunks=True, text="chunk")


@query("""select doc_id, k::int as piece, array_to_string(w[k * 100 + 1:k * 100 + 100], ' ') as text from (select doc_id, w, unnest(range(0, (len(w) + 99) // 100)) as k from (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from documents))""".replace("\\\\", "\\"))
def token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.cut_tokens(read(spark, sf_dir, "documents"), "doc_id", most=100)


_SQL_SQUEEZED = _sql_strip("regexp_replace(text, '\\s+', ' ', 'g')")


@query(f"""with s as (select conv_id, turn, {_SQL_SQUEEZED} as t, sum((role = 'user')::int) over (partition by conv_id order by turn) as section from conversations), c as (select conv_id, section, string_agg(t, chr(10) || chr(10) order by turn) as text from s where t <> '' group by 1, 2)
select conv_id, (row_number() over (partition by conv_id order by section) - 1)::int as chunk_seq, text from c""")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by title, wide enough that every section is one and none are combined."""
    c = read(spark, sf_dir, "conversations").withColumn("type", F.when(F.col("role") == "user", "Title").otherwise("NarrativeText"))
    out = registry.chunk(c, "by_title", "conv_id", "turn", most=1_000_000, combine_under=0)
    return out.select("conv_id", "chunk_seq", "text")


def _sql_last(s: str) -> str:
    """Place (from 0) of the last s in the first room + 1 characters of t, if over 0."""
    n, r = len(s), _quoted(s[::-1])
    place = f"length(left(t, room + 1)) - strpos(reverse(left(t, room + 1)), {r}) - {n} + 1"
    return f"case when strpos(reverse(left(t, room + 1)), {r}) > 0 and {place} > 0 then {place} end"


def _sql_cut(size: int, separators: list[str], overlap: int) -> str:
    """(doc_id, chunk_seq, chunk): texts cut piece by piece (see segment.cut_piece)."""
    tail = _sql_strip(f"right(piece, {overlap})")
    head, room = (f"{tail} || ' '", f"{size} - length({tail}) - 1") if overlap else ("''", str(size))
    return f"""with recursive r as (select doc_id, -1 as seq, ''::varchar as chunk, {_sql_strip("text")} as t, ''::varchar as head, {size}::bigint as room from documents
union all select doc_id, seq + 1, piece, {_sql_strip("substr(t, cut + 1)")}, {head}, {room} from (
select doc_id, seq, t, room, cut, case when length(t) <= room then head || t else {_sql_strip("head || left(t, cut)")} end as piece from (
select *, case when length(t) <= room then length(t) else coalesce({", ".join(map(_sql_last, separators))}, room) end as cut from r where t <> '')))
select doc_id, seq::int as chunk_seq, chunk from r where seq >= 0"""


@query(_sql_cut(300, [chr(10), " "], 0))
def separator_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut at lines, then words, then hard, without overlap."""
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(segment.cut_text(F.col("text"), 300)).alias("chunk_seq", "chunk"))


@query("select conv_id, turn // 4 as page, string_agg(turn, ',' order by turn) as turns from conversations where turn % 5 <> 4 group by 1, 2")
def grouped_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("page", F.when(F.col("turn") % 5 != 4, F.floor(F.col("turn") / 4)))
    return segment.group_by_page(c, "conv_id", "turn", "page").select("conv_id", "page", F.array_join(F.col("seqs").cast("array<string>"), ",").alias("turns"))


@query("""select conv_id, string_agg(case when turn = 0 then 'Who Says ' || role else role end, ' ' order by turn) as text, count(*)::int as n_chunks from conversations group by 1""")
def tables_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of tables put together; the header rows that later chunks carry are taken off."""
    html = F.concat(F.lit("<table><tr><th>Who</th><th>Says</th></tr><tr><td>"), "role", F.lit("</td></tr></table>"))
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("table_id"), F.col("turn").alias("chunk_index"), F.concat(F.lit("Who Says "), "role").alias("text"), html.alias("text_as_html"), (F.col("turn") > 0).cast("int").alias("num_carried_over_header_rows"))
    return segment.reconstruct_tables(c).select(F.col("table_id").alias("conv_id"), "text", "n_chunks")


@query("""with t as (select conv_id, role, min(turn) as first from conversations group by 1, 2), n as (select distinct conv_id, role, turn % 3 as v, min(turn) over (partition by conv_id, role, turn % 3) as first_at from conversations)
select conv_id, string_agg(role || '=' || vs, ';' order by role) as origins from (select conv_id, role, string_agg(v, ',' order by first_at) as vs from n group by 1, 2) group by 1""")
def consolidated_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of lists united key by key in order of appearance."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.create_map("role", F.array((F.col("turn") % 3).cast("string"))).alias("origins"))
    out = segment.consolidate(c, ["conv_id"], "turn", maps=["origins"])
    text = F.transform(F.array_sort(F.map_entries("origins")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return out.select("conv_id", F.array_join(text, ";").alias("origins"))


@query("select 'lang,source' as keys from documents limit 3")
def metadata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the first three entries' metadata (the report's own number)."""
    d = read(spark, sf_dir, "documents").withColumn("metadata", F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")))
    return entries.metadata_keys(d).select(F.array_join("keys", ",").alias("keys"))


@query("select count_if(doc_id % 7 <> 0)::bigint as ok, count_if(doc_id % 7 = 0)::bigint as failed, sum(case when doc_id % 7 <> 0 then n_chars end)::bigint as entries from documents")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("doc_id") % 7 == 0
    return entries.batch_summary(read(spark, sf_dir, "documents").select(F.when(bad, "broken").alias("error"), F.when(~bad, F.col("n_chars")).alias("n_entries")))


_SQL_CELLS = "(select conv_id as doc, turn % {k} as ix, turn // {k} as row, 0 as col, role || turn % 5 as text from conversations)"


@query(f"""with p as (select distinct doc, ix as p, text from {_SQL_CELLS.format(k=2)}), t as (select distinct doc, ix as t, text from {_SQL_CELLS.format(k=3)}), n as (select doc, t, count(*) as n from t group by 1, 2),
h as (select p.doc, p.p, t.t, count(*) as k from p join t on p.doc = t.doc and p.text = t.text group by 1, 2, 3), s as (select h.*, k / n as s from h join n on h.doc = n.doc and h.t = n.t)
select doc, p::int as p, t::int as t, round(s, 6) as similarity from (select *, row_number() over (partition by doc, p order by s desc, t) as r from s) where r = 1""")
def tables_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table found with the true table that shares most cells."""
    c = read(spark, sf_dir, "conversations")
    of = lambda k: c.select(F.col("conv_id").alias("doc"), (F.col("turn") % k).cast("int").alias("table_ix"), F.concat("role", (F.col("turn") % 5).cast("string")).alias("text"))
    return evaluate.align_tables(of(2), of(3), "doc")


_SQL_RATIO = "octet_length(encode(o)) / octet_length(encode(text))"
_SQL_PLAIN = _sql_strip("regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')")


@query(f"""with s as (select item_id, {_SQL_PLAIN} as text from benchmark), p as (select item_id, text, case item_id % 3 when 0 then left(text, 10) when 1 then left(text, length(text) - 3) else text || text || text end as o from s where text <> ''),
d as (select *, {_SQL_RATIO} > 0.5 and {_SQL_RATIO} < 2.0 as near, levenshtein({_sql_strip("o")}, text) as d from p)
select item_id, case when near then d end::int as distance, case when near then round(1.0 - least(1.0, d / length(text)), 6)::double else 0.01 end as accuracy from d""")
def edit_with_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are far too short or too long get the least accuracy and no distance."""
    b = read(spark, sf_dir, "benchmark").select("item_id", T.strip(F.regexp_replace(T.drop_non_ascii(F.col("text")), r"\s+", " ")).alias("source"))
    k = F.col("item_id") % 3
    out = F.when(k == 0, F.substring("source", 1, 10)).when(k == 1, F.substring(F.col("source"), F.lit(1), F.length("source") - 3)).otherwise(F.concat("source", "source", "source"))
    return evaluate.edit_distance(b.withColumn("output", out), "output", "source", (1, 1, 1)).select("item_id", "distance", "accuracy")


@query("select count(*) as n, count(*) as n_ids, count(*) as n_formed from documents")
def random_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = entries.random_ids(read(spark, sf_dir, "documents"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("n_formed"))


@query("""with e as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as place, substr(sha256('c' || conv_id || text || 'None' || (row_number() over (partition by conv_id order by turn) - 1)), 1, 32) as id from conversations)
select e.conv_id, e.turn, e.id as element_id, p.id as parent_id, 'text/plain' as filetype from e left join e p on p.conv_id = e.conv_id and p.turn = e.turn - 1""")
def hash_ids_with_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of elements without a page, the parents' among them, and constant metadata."""
    c = read(spark, sf_dir, "conversations").withColumns({"filename": F.concat(F.lit("c"), F.col("conv_id")), "page": F.lit(None).cast("int"), "parent": F.col("turn") - 1})
    return entries.stamp(entries.hash_ids(c, "conv_id", "turn", "filename", "text", "page", "parent"), filetype="text/plain").select("conv_id", "turn", "element_id", "parent_id", "filetype")


@query("""select host, count(*) as n, count(distinct page_id) as n_pages from (select page_id, regexp_extract(h, '^https?://([^/]+)', 1) as host from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as h from pages)) group by 1""")
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and pages for each host that pages point to."""
    return files.host_counts(files.page_links(read(spark, sf_dir, "pages")))


@query("""select page_id, k::int as seq, t as text from (select page_id, unnest(a) as t, unnest(range(len(a))) as k from (select page_id, regexp_extract_all('<b>' || page_id || '</b>' || html || '<em>x' || chr(10) || '</em>', '(?is)<(?:b|i|em|strong)>(.*?)</(?:b|i|em|strong)>', 1) as a from pages))""")
def emphasised(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<b>"), F.col("page_id").cast("string"), F.lit("</b>"), "html", F.lit("<em>x\n</em>"))
    return files.emphasis(read(spark, sf_dir, "pages").withColumn("html", html))


@query("select lang as label, 256 as dim, count(*) as n, count(*) as n_unit from documents group by 1")
def corpus_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of hashed words for all texts, checked for their length."""
    return search.vector_audit(search.embed(read(spark, sf_dir, "documents"), "text"), "lang").withColumnRenamed("lang", "label")


@query(f"select doc_id, 'Text' as type, {_sql_strip('text')} as text from documents where doc_id % 4 <> 3 union all select doc_id, 'Table', lang from documents where doc_id % 4 = 3")
def files_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of two categories, each given to the partitioner that a user registered for it."""
    registry.register_partitioner("text", lambda f: f.select("doc_id", F.lit("Text").alias("type"), T.strip(F.col("text")).alias("text")))
    registry.register_partitioner("excel", lambda f: f.select("doc_id", F.lit("Table").alias("type"), F.col("lang").alias("text")))
    d = read(spark, sf_dir, "documents").withColumn("path", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 3, ".xlsx").otherwise(".TXT")))
    return registry.partition(files.route_files(d))


@query(f"""select source_file, count(*) as n from (select distinct source as source_file, seq, p from (select source, unnest(a) as p, unnest(range(len(a))) as seq from (select source, list_transform(string_split(text, chr(10)), lambda s: {_sql_strip("s")}) as a from documents)) where length(p) >= 15) group by 1""")
def ingested_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts taken in as entries; what comes again in a second run is not stored again."""
    top = shared_path(spark, "ingest")
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    for _ in range(2):
        rows.write.mode("append").json(f"{top}/in")
        ingest.ingest(spark, f"{top}/in", f"{top}/store", f"{top}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{top}/store").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


_SQL_CASED = "(select conv_id as doc, turn as ix, (turn % 3) * 40.0 as x1, (turn % 2) * 30.0 as y1, (turn % 3) * 40.0 + 30 + length(text) % 50 as x2, (turn % 2) * 30.0 + 20 + length(text) % 50 as y2, case when turn % 5 = 4 then ' ' else left(text, 6 + turn % 3 * 9) end as text from conversations)"


def _sql_inside(p: str, q: str) -> str:
    return f"({q}.x1 >= {p}.x1 - 5 and {q}.y1 >= {p}.y1 - 5 and {q}.x2 <= {p}.x2 + 5 and {q}.y2 <= {p}.y2 + 5)"


@query(f"""with o as (select a.doc, a.ix as a, b.ix as b, a.text as s, b.text as t, {_sql_inside("a", "b")} or {_sql_inside("b", "a")} as nested,
(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)) as share
from {_SQL_CASED} a join {_SQL_CASED} b on a.doc = b.doc and a.ix < b.ix where least(a.x2, b.x2) > greatest(a.x1, b.x1) and least(a.y2, b.y2) > greatest(a.y1, b.y1))
select doc, a, b, case when nested then 'nested' when share < 0.1 then 'small' when {_sql_strip("s")} = '' or {_sql_strip("t")} = '' then 'empty text' when contains(s, t) or contains(t, s) then 'duplicate text'
when len(list_intersect(regexp_split_to_array(lower(s), '\\s+'), regexp_split_to_array(lower(t), '\\s+'))) > 0 then 'shared words' else 'none' end as case_ from o""")
def overlap_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the overlap of two boxes means, by their places and texts."""
    t = F.col("turn")
    n = F.length("text") % 50
    x, y = (t % 3) * 40.0, (t % 2) * 30.0
    text = F.when(t % 5 == 4, F.lit(" ")).otherwise(F.substring(F.col("text"), F.lit(1), (6 + t % 3 * 9).cast("int")))
    boxes = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.lit(1).alias("page"), t.alias("ix"), x.alias("x1"), y.alias("y1"), (x + 30.0 + n).alias("x2"), (y + 20.0 + n).alias("y2"), text.alias("text"))
    return evaluate.box_overlaps(boxes, cell=50.0).select("doc", "a", "b", F.col("case").alias("case_"))


_MARKED_KINDS = ["Title", "Table", "Image", "Formula", "ListItem", "Text"]


@query(f"""select conv_id, string_agg(case {_sql_pick(_MARKED_KINDS, "turn")} when 'Title' then '# ' || text when 'Table' then '<table>' || turn || '</table>' when 'Image' then '![' || text || '](u' || turn || ')' when 'Formula' then '$$' || text || '$$' when 'ListItem' then '- ' || text else text end, chr(10) order by turn) as text from conversations where text <> '' group by 1""")
def markdown_of_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn").cast("string")
    e = read(spark, sf_dir, "conversations").select("conv_id", "turn", _pick(_MARKED_KINDS, F.col("turn")).alias("type"), "text", F.concat(F.lit("<table>"), t, F.lit("</table>")).alias("text_as_html"), F.concat(F.lit("u"), t).alias("image_url"))
    return files.documents_text(e, "conv_id", "turn", markdown=True)


@query("""select doc_id, case when doc_id % 3 = 0 then 'no output' else 'no truth' end as error from documents where doc_id % 3 = 0 or doc_id % 7 = 1 and doc_id % 3 <> 0""")
def corpus_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that only one side of an evaluation has."""
    d = read(spark, sf_dir, "documents").select("doc_id")
    k = F.col("doc_id")
    return evaluate.unmatched(d.where(k % 3 != 0), d.where((k % 7 != 1) | (k % 3 == 0)), "doc_id")


@query(f"""with s as (select item_id, {_SQL_PLAIN} as text from benchmark), p as (select item_id, text, left(text, length(text) - item_id % 4) as o from s where text <> ''),
m as (select case when item_id % 2 = 0 then 'even' else 'odd' end as half, round(1.0 - least(1.0, levenshtein({_sql_strip("o")}, text) / length(text)), 6) as a from p)
select case when grouping(half) = 0 then 'half' else 'all' end as grouping, case when grouping(half) = 0 then half else 'all' end as value, round(avg(a), 3)::double as average, count(*) as count from m group by grouping sets ((half), ())""")
def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a corpus: texts with their ends cut off against the whole ones, summed up by a column."""
    b = read(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("half"), T.strip(F.regexp_replace(T.drop_non_ascii(F.col("text")), r"\s+", " ")).alias("text"))
    cut = b.select("item_id", F.substring(F.col("text"), F.lit(1), (F.length("text") - F.col("item_id") % 4).cast("int")).alias("text"))
    return evaluate.evaluate_corpus(cut, b, "item_id", ["half"], (1, 1, 1))[1].select("grouping", "value", "average", "count")


@query("""with c as (select conv_id as doc, count_if(role = 'user') / count(*) as r, count_if(role = 'system') / count(*) as c, count_if(turn % 2 = 0) / count(*) as x, 0.5 as y from conversations group by 1) select doc, round((c + r + (x + y) / 2) / 3, 6)::double as composite from c""")
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    rows = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(share(F.col("role") == "user").alias("row_accuracy"), share(F.col("role") == "system").alias("col_accuracy"), share(F.col("turn") % 2 == 0).alias("col_content"), F.lit(0.5).alias("row_content"))
    return rows.select("doc", evaluate.composite_structure().alias("composite"))


# SQL of queries that are registered elsewhere
ORACLES["recursive_chunks"] = _sql_cut(500, [chr(10) * 2, chr(10), " "], 50)
_SQL_TITLE50 = "case when length(t) > 50 then left(t, 50) || '...' else t end"
ORACLES["ingest_stream"] = f"select type, count(*) as count from (select {_sql_type(_SQL_TITLE50, 't')} as type from (select {_sql_strip('t')} as t from (select unnest(string_split(text, chr(10))) as t from documents)) where length(t) >= 15) group by 1"
ORACLES["web_page_entries"] = f"""with w as (select page_id, '## ' || any_value(url) || chr(10) || chr(10) || t as x from (select page_id, string_agg(text, chr(10) || chr(10) order by seq) as t from ({ORACLES["page_elements"]}) group by 1) join pages using (page_id) where length(t) >= 50 group by page_id, t),
p as (select page_id, unnest(a) as t, unnest(range(len(a))) as seq from (select page_id, list_transform(regexp_split_to_array(x, '\\n{{2,}}'), lambda s: {_sql_strip("s")}) as a from w))
select p.page_id, seq::int as seq, url as source_file, {_SQL_TITLE50} as title, t as content from p join pages on p.page_id = pages.page_id where length(t) >= 15"""
_SQL_CELL_TEXT = _sql_strip("regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')")
_SQL_TABLE_HEAD = "<tr><th>turn</th><th>text</th></tr>"
_SQL_ROW, _SQL_BARE = "'<tr><td>' || turn || '</td><td>' || t || '</td></tr>'", _SQL_CELL_TEXT.format(c="t")
# a row over the limit becomes a row a cell, and a text over it a row for each piece that ends before white space
ORACLES["table_chunks"] = f"""with t as (select conv_id, turn, regexp_replace(text, '[<>]', '', 'g') as t from conversations),
s as (select conv_id, turn, case when length({_SQL_CELL_TEXT.format(c=_SQL_ROW)}) <= 1000 then [{_SQL_ROW}] else ['<tr><td>' || turn || '</td></tr>'] || case when length({_SQL_BARE}) <= 1000 then ['<tr><td>' || t || '</td></tr>']
else list_transform(regexp_extract_all({_SQL_BARE}, '(\\S(?:.{{0,998}}\\S)?)(?:\\s|$)', 1), lambda p: '<tr><td>' || p || '</td></tr>') end end as rs from t), r as (select conv_id, flatten(list(rs order by turn)) as r from s group by 1),
f as (select conv_id, list_reduce(list_transform(r, lambda s: {{'out': []::varchar[], 'cur': s}}), lambda a, x: case when length({_SQL_CELL_TEXT.format(c="a.cur || x.cur")}) <= 1000 then {{'out': a.out, 'cur': a.cur || x.cur}} else {{'out': list_append(a.out, a.cur), 'cur': x.cur}} end) as f from r),
c as (select conv_id, unnest(b) as b, unnest(range(len(b))) as k from (select conv_id, list_append(f.out, f.cur) as b from f)), h as (select conv_id as table_id, k, '<table>{_SQL_TABLE_HEAD}' || b || '</table>' as h from c)
select table_id, k::int as chunk_index, h as text_as_html, {_SQL_CELL_TEXT.format(c="h")} as text, case when k > 0 then 1 else 0 end::int as num_carried_over_header_rows from h"""


def _sql_page_blocks() -> str:
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    groups = {"gone": html.DROPPED, "main": ["main"], "body": ["body"], "solid": ["table", "pre"], "list": ["ul", "ol"]}
    text = "string_agg(piece, '' order by pos)"
    for a, b in html.ENTITIES:
        text = f"replace({text}, {_quoted(a)}, {_quoted(b)})"
    return f"""with a as (select page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), {_quoted(html.NO_MARKUP)}, '', 'g'), {_quoted(html.TOKEN)}) as x from pages),
t as (select page_id, unnest(x) as token, unnest(range(len(x))) as pos from a),
u as (select *, lower(nullif(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1), '')) as tag from t),
v as (select *, case when tag is null or tag in ('br', 'img', 'hr', 'meta', 'link', 'input') or token like '%/>' then 0 when token like '</%' then -1 else 1 end as sign from u),
s as (select *, {", ".join(f"sum(case when tag in ({quoted(v)}) then sign else 0 end) over w as s_{k}" for k, v in groups.items())} from v window w as (partition by page_id order by pos rows unbounded preceding)),
m as (select *, {", ".join(f"s_{k} - least(0, min(s_{k}) over w) as d_{k}" for k in groups)} from s window w as (partition by page_id order by pos rows unbounded preceding)),
h as (select *, max(d_main) over (partition by page_id) > 0 as has_main, max(d_body) over (partition by page_id) > 0 as has_body from m),
i as (select * from h where case when has_main then d_main > 0 when has_body then d_body > 0 else true end and d_gone = 0),
e as (select *, coalesce(case when tag in ('table', 'pre') and d_solid = case when sign = 1 then 1 else 0 end then true when d_solid > 0 then false else tag in ({quoted([*html.BLOCKS, "img", *[x for x in html.DROPPED if x not in html.INLINE]])}) end, false)
or (d_solid = 0 and coalesce(lag(tag) over (partition by page_id order by pos) = 'img', false)) as edge from i),
p as (select *, sum(edge::int) over (partition by page_id order by pos rows unbounded preceding) as g, case when edge and tag is not null then '' when tag is null then token when tag = 'br' then chr(10) when tag in ({quoted(html.BLOCKS)}) then ' ' else '' end as piece from e),
b as (select page_id, min(pos) as pos, max(case when edge and sign = 1 then tag end) as opened, max(d_solid) as solid, max(d_list) as list, max(case when tag = 'img' and d_solid = 0 then regexp_extract(token, '\\salt="([^"]*)"', 1, 'i') end) as alt, {text} as x from p group by page_id, g),
k as (select *, case when alt is not null then 'Image' when solid > 0 and opened = 'table' then 'Table' when solid > 0 and opened = 'pre' then 'CodeSnippet' when regexp_matches(opened, '^h[1-6]$') then 'Title' when list > 0 then 'ListItem' else 'NarrativeText' end as type from b),
r as (select *, case type when 'Image' then alt when 'CodeSnippet' then regexp_replace(x, '^\\n|\\n$', '', 'g') else {_sql_strip("regexp_replace(x, '\\s+', ' ', 'g')")} end as text from k)
select page_id, (row_number() over (partition by page_id order by pos) - 1)::int as seq, type, (case type when 'Title' then substr(opened, 2, 1)::int - 1 when 'ListItem' then list - 1 end)::int as depth, text from r where type = 'Image' or length(text) >= 2"""


@query(_sql_page_blocks())
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of pages by the nesting of their tags."""
    return html.page_blocks(read(spark, sf_dir, "pages"))


@query(_sql_page_blocks().replace("from pages)", "from (select page_id, '<ul><li>' || html || '<table><tr><td>' || html || '</td></tr></table>' || replace(replace(html, '<p>', '<ol><li>'), '</p>', '</li></ol>') || '<pre>' || url as html from pages))"))
def page_blocks_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of pages put into lists and tables, and with a list for each paragraph, some of them never closed."""
    deep = F.concat(F.lit("<ul><li>"), "html", F.lit("<table><tr><td>"), "html", F.lit("</td></tr></table>"), F.replace(F.replace("html", F.lit("<p>"), F.lit("<ol><li>")), F.lit("</p>"), F.lit("</li></ol>")), F.lit("<pre>"), "url")
    return html.page_blocks(read(spark, sf_dir, "pages").select("page_id", deep.alias("html")))
