"""Registered queries of evaluation: tables and whole runs over a corpus, and their SQL.

Documents to score are made from the given tables: the truth is a document as it is, the output the same with faults by the number of
the document, whose scores follow from the fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus_run, evaluate, segment, table_eval
from ..sources import files
from .catalog import _BOXES, _boxes, _sql_strip, query, read

#: Scores of a table of two by two cells by its fault: none; columns swapped; one cell cut below the cutoff and one above; not found; made up.
_BY_FAULT = {"n_truth": (1, 1, 1, 1, 0), "n_predicted": (1, 1, 1, 0, 1), "precision": (1, 1, 1, 0, 0), "recall": (1, 1, 1, 0, 0), "f1": (1, 1, 1, 0, 0), "row_index": (1, 1, 1, 0, 0), "col_index": (1, 0, 1, 0, 0),
             "row_content": (1, 0.5, 0.5, 0, 0), "col_content": (1, 0.5, 0.5, 0, 0), "composite": (1, 0.5, 0.833333, 0, 0)}


def _sql_by_fault(name: str, fault: str) -> str:
    return f"case {fault} " + " ".join(f"when {i} then {v}" for i, v in enumerate(_BY_FAULT[name])) + f" end::{'bigint' if name.startswith('n_') else 'double'} as {name}"


def _table_cells(rows: DataFrame, fault: Column, key: Column, found: bool) -> DataFrame:
    """Cells of one table a row: hashes of the row's key, with the row's fault if it is the table found."""
    cell = lambda i: F.md5(F.concat(key, F.lit("-"), i.cast("string")))
    i = F.col("i")
    text = cell(i)
    if found:
        swapped = F.when(i % 2 == 0, i + 1).otherwise(i - 1)
        cut = F.when(i == 0, F.left(text, F.lit(20))).when(i == 3, F.left(text, F.lit(28))).otherwise(text)
        text = F.when(fault == 1, cell(swapped)).when(fault == 2, cut).otherwise(text)
    there = rows.where(fault != (3 if found else 4))
    return there.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumns({"table_ix": F.lit(0), "row": F.floor(i / 2).cast("int"), "col": (i % 2).cast("int"), "cell": text})


@query("select conv_id, turn, " + ", ".join(_sql_by_fault(n, "turn % 5") for n in _BY_FAULT) + " from conversations")
def tables_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each turn, found with the fault of its number, against the true one."""
    c = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("doc"))
    key = F.concat_ws("-", "doc.conv_id", "doc.turn")
    of = lambda found: _table_cells(c, F.col("doc.turn") % 5, key, found).select("doc", "table_ix", "row", "col", F.col("cell").alias("text"))
    return table_eval.evaluate_tables(of(True), of(False), "doc").select("doc.conv_id", "doc.turn", *_BY_FAULT)


def _run(spark: SparkSession, sf_dir: str) -> corpus_run.Run:
    """Items as documents of a title, a paragraph and, with an even number, a table. Found with the paragraph's end cut off, the title's
    type mistaken in each third, and a fault in the table."""
    k = F.col("item_id")
    b = read(spark, sf_dir, "benchmark").select("item_id", F.when(k % 4 < 2, "low").otherwise("high").alias("half"), T.strip(F.regexp_replace(T.drop_non_ascii(F.col("text")), r"\s+", " ")).alias("text")).where("text <> ''")
    tables = b.where(k % 2 == 0)
    fault = F.floor(k / 2) % 5
    html = lambda found: _table_cells(tables, fault, k.cast("string"), found).groupBy("item_id", "half").agg(F.array_sort(F.collect_list(F.struct("i", "cell"))).alias("c"))
    row = lambda i: F.concat(F.lit("<tr><td>"), F.get("c", F.lit(i))["cell"], F.lit("</td><td>"), F.get("c", F.lit(i + 1))["cell"], F.lit("</td></tr>"))

    def elements(found: bool) -> DataFrame:
        kind = F.when(F.lit(found) & (k % 3 == 0), "Text").otherwise("Title")
        body = F.substring("text", F.lit(1), (F.length("text") - k % 4).cast("int")) if found else F.col("text")
        nothing = F.lit(None).cast("string")
        parts = b.select("item_id", "half", F.explode(F.array(F.struct(F.lit(0).alias("seq"), kind.alias("type"), F.concat(F.lit("Item "), k.cast("string")).alias("text")), F.struct(F.lit(1).alias("seq"), F.lit("NarrativeText").alias("type"), body.alias("text")))).alias("e")).select("item_id", "half", "e.*", nothing.alias("text_as_html"))
        tabled = html(found).select("item_id", "half", F.lit(2).alias("seq"), F.lit("Table").alias("type"), F.lit("").alias("text"), F.concat(F.lit("<table>"), row(0), row(2), F.lit("</table>")).alias("text_as_html"))
        return parts.unionByName(tabled).withColumn("category_depth", F.lit(None).cast("int"))

    return corpus_run.run_corpus(elements(True), elements(False), "item_id", ["half"], weights=(1, 1, 1))


_SQL_ITEMS = f"""s as (select item_id, case when item_id % 4 < 2 then 'low' else 'high' end as half, item_id % 2 = 0 as tabled, (item_id // 2) % 5 as fault,
{_sql_strip("regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')")} as text from benchmark)"""


@query(f"""with {_SQL_ITEMS}, m as (select half, round(1.0 - least(1.0, levenshtein({_sql_strip("'Item ' || item_id || ' ' || left(text, length(text) - item_id % 4)")}, 'Item ' || item_id || ' ' || text) / length('Item ' || item_id || ' ' || text)), 6) as a from s where text <> '')
select case when grouping(half) = 0 then 'half' else 'all' end as grouping, case when grouping(half) = 0 then half else 'all' end as value, round(avg(a), 3)::double as average, round(stddev_samp(a), 3)::double as sample_sd, count(*) as count from m group by grouping sets ((half), ())""")
def run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text branch of a run over a corpus."""
    return _run(spark, sf_dir).summary.where("metric = 'accuracy'").select("grouping", "value", "average", "sample_sd", "count")


@query(f"""with {_SQL_ITEMS}, e as (select *, 2 + (tabled and fault <> 4)::int as n, 1 + (item_id % 3 <> 0)::int + (tabled and fault < 3)::int as hit from s where text <> ''), m as (select half, round(hit / n, 6) as a from e)
select case when grouping(half) = 0 then 'half' else 'all' end as grouping, case when grouping(half) = 0 then half else 'all' end as value, round(avg(a), 3)::double as average, round(stddev_samp(a), 3)::double as sample_sd, count(*) as count from m group by grouping sets ((half), ())""")
def run_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch of element types."""
    return _run(spark, sf_dir).summary.where("metric = 'type_score'").select("grouping", "value", "average", "sample_sd", "count")


@query(f"""with {_SQL_ITEMS}, m as (select half, {", ".join(_sql_by_fault(n, "fault") for n in ("n_truth", "f1", "col_index", "composite"))} from s where text <> '' and tabled),
u as (select half, n_truth, unnest(['f1', 'col_index', 'composite']) as metric, unnest([f1, col_index, composite]) as a from m)
select metric, case when grouping(half) = 0 then 'half' else 'all' end as grouping, case when grouping(half) = 0 then half else 'all' end as value, round(sum(a * n_truth) / sum(n_truth), 3)::double as average, count(*) as count from u group by grouping sets ((metric, half), (metric))""")
def run_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The branch of tables, weighted by how many there are."""
    return _run(spark, sf_dir).summary.where("metric in ('f1', 'col_index', 'composite')").select("metric", "grouping", "value", "average", "count")


@query(f"""with {_SQL_ITEMS} select count(*) as documents, count(*) as with_text, count(*) as with_types, count_if(tabled) as with_tables, count_if(tabled and fault <> 4) as true_tables, count_if(tabled and fault <> 3) as found_tables from s where text <> ''""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run has done, counted while its rows were written."""
    n = _run(spark, sf_dir).counts
    return spark.createDataFrame([tuple(n.values())], ", ".join(f"{k} long" for k in n))


_SQL_IOU = "(greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)))"


@query(f"""with recursive b as (select doc as page, ix % 2 as class, ix, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2, ((doc * 7 + ix * 11) % 40)::double as shift from {_BOXES}),
t as (select page, class, x1, y1, x2, y2, row_number() over (partition by page, class order by x1, x2, y1, y2) as place from b),
p as (select page, class, round(1 / (1 + shift), 6) as score, x1 + shift as x1, y1, x2 + shift as x2, y2 from b),
q as (select *, row_number() over (partition by page, class order by score desc, x1, x2, y1, y2) as rank from p),
i as (select p.*, t.place, {_SQL_IOU} / ((p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - {_SQL_IOU}) as iou from q p join t on p.page = t.page and p.class = t.class),
c as (select q.page, q.class, q.rank, q.score, coalesce(list(place order by iou desc, place) filter (iou > 0.5), []) as places from q left join i on q.page = i.page and q.class = i.class and q.rank = i.rank group by all),
m as (select page, class, 0::bigint as rank, 0.0::double as score, []::bigint[] as used, 0 as hit from c where rank = 1
union all select c.page, c.class, c.rank, c.score, case when len(list_filter(places, lambda x: not list_contains(used, x))) > 0 then list_append(used, list_filter(places, lambda x: not list_contains(used, x))[1]) else used end, (len(list_filter(places, lambda x: not list_contains(used, x))) > 0)::int
from m join c on m.page = c.page and m.class = c.class and c.rank = m.rank + 1),
n as (select class, count(*) as n_truth from t group by 1),
s as (select m.class, n_truth, sum(hit) over w as tp, row_number() over w as made, sum(hit) over (partition by m.class) as all_tp, count(*) over (partition by m.class) as all_made from m join n on m.class = n.class where rank > 0 window w as (partition by m.class order by score desc, m.page, rank rows unbounded preceding)),
g as (select class, k, coalesce(max(tp / made) filter (floor(tp / n_truth * 100 + 1e-9) >= k), 0) as best from s, (select unnest(range(101)) as k) group by 1, 2),
a as (select class, round(sum(best) / 101, 6) as ap from g group by 1)
select distinct s.class, n_truth, round(all_tp / all_made, 6) as "precision", round(all_tp / n_truth, 6) as recall, round(2 * (all_tp / all_made) * (all_tp / n_truth) / (all_tp / all_made + all_tp / n_truth + 1e-16), 6) as f1, ap from s join a on s.class = a.class""")
def detection_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of turns, shifted by their number, against the boxes as they are."""
    b = _boxes(spark, sf_dir).select(F.col("doc").alias("page"), (F.col("ix") % 2).alias("class"), "ix", "x1", "y1", "x2", "y2")
    shift = ((F.col("page") * 7 + F.col("ix") * 11) % 40).cast("double")
    p = b.withColumns({"score": F.round(1 / (1 + shift), 6), "x1": F.col("x1") + shift, "x2": F.col("x2") + shift})
    return evaluate.detection(p.drop("ix"), b.drop("ix"))


@query("""with a as (select item_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^\\x21-\\x7E]+', ' ', 'g'), ' +'), lambda w: w <> '') as x from benchmark),
b as (select item_id, x, list_transform(range(1, len(x) + 1), lambda i: case when i % (3 + item_id % 17) = 0 then 'zz' || i else x[i] end)[1 + item_id % 3:] as y from a where len(x) > 3),
w as (select item_id, unnest(x) as w, unnest(range(len(x))) as i from b), v as (select item_id, unnest(y) as w, unnest(range(len(y))) as j from b),
d as (select w.item_id, i, i - j as d, row_number() over (partition by w.item_id, i - j order by i) as r from w join v on w.item_id = v.item_id and w.w = v.w),
g as (select item_id, max(n) as longest from (select item_id, d, i - r, count(*) as n from d group by 1, 2, 3) group by 1),
s as (select b.item_id, case when len(x) < len(y) then x else y end as p, case when len(x) < len(y) then y else x end as q, least(coalesce(longest, 0), least(len(x), len(y)) - 1)::int as n from b left join g on b.item_id = g.item_id)
select item_id, n as shared_n, case when n = 0 then 0 else round(100 * len(list_intersect(list_distinct(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' '))), list_distinct(list_transform(range(1, len(q) - n + 2), lambda i: array_to_string(q[i:i + n - 1], ' '))))) / (len(p) - n + 1), 2) end::double as shared_pct from s""")
def shared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of words that an item shares with itself once each few words are replaced."""
    plain = F.filter(F.split(F.regexp_replace("text", r"[^\x21-\x7E]+", " "), " +"), lambda w: w != "")
    b = read(spark, sf_dir, "benchmark").select("item_id", plain.alias("x")).where(F.size("x") > 3)
    odd = F.transform("x", lambda w, i: F.when((i + 1) % (3 + F.col("item_id") % 17) == 0, F.concat(F.lit("zz"), (i + 1).cast("string"))).otherwise(w))
    pairs = b.select("item_id", F.array_join("x", " ").alias("a"), F.array_join(F.slice(odd, (F.col("item_id") % 3 + 1).cast("int"), F.size("x")), " ").alias("b"))
    return evaluate.largest_shared_n(pairs, "a", "b").select("item_id", "shared_n", "shared_pct")


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^\\x21-\\x7E]+', ' ', 'g'), ' +'), lambda x: x <> '') as w from documents),
k as (select doc_id, w, unnest(range(greatest(0, (len(w) + 39) // 40))) as k from w)
select doc_id, k::int as piece, array_to_string(w[k * 40 + 1:k * 40 + 40], ' ') as text from k""")
def measured_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut by a counter of one's own (here: words), at blanks."""
    t = T.strip(F.regexp_replace("text", r"[^\x21-\x7E]+", " "))
    pieces = segment.cut_text(t, 40, (" ",), measure=lambda x: len(x.split()))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("piece", "text"))


@query("""with t as (select conv_id, turn, case turn % 6 when 0 then 'x^2 + y_1 = ' || turn when 1 then 'plain ' || turn when 2 then 'a ≤ b × ' || turn when 3 then 'costs $' || turn when 4 then 'f(x) = ' || turn else 'the mean was calculated using the following words, which are long enough to be prose, x_1^' || turn end as f from conversations)
select conv_id, turn, case turn % 6 when 0 then '$$' || chr(10) || f || chr(10) || '$$' when 2 then '$$' || chr(10) || replace(replace(f, '≤', '\\leq{}'), '×', '\\times{}') || chr(10) || '$$' when 4 then '$$' || chr(10) || f || chr(10) || '$$' else f end as text from t""")
def formulas_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas in markdown where their signs speak for it."""
    k = F.col("turn").cast("string")
    kinds = ["x^2 + y_1 = ", "plain ", "a ≤ b × ", "costs $", "f(x) = ", "the mean was calculated using the following words, which are long enough to be prose, x_1^"]
    text = F.concat(F.element_at(F.array(*map(F.lit, kinds)), (F.col("turn") % 6 + 1).cast("int")), k)
    e = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("d"), F.lit(0).alias("seq"), F.lit("Formula").alias("type"), text.alias("text"))
    return files.documents_text(e, "d", "seq", markdown=True, formulas="auto").select("d.conv_id", "d.turn", "text")


@query("""with e as (select conv_id, turn, turn // 2 as page, role = 'user' as title, md5(conv_id || '-' || turn) as t from conversations),
b as (select *, title or page <> coalesce(lag(page) over (partition by conv_id order by turn), page) as starts from e),
s as (select *, sum(starts::int) over (partition by conv_id order by turn rows unbounded preceding) as section from b),
c as (select conv_id, section, min(turn) as turn, string_agg(t, chr(10) || chr(10) order by turn) as t from s group by 1, 2)
select conv_id, count(*) as n_sections, sum(length(t)) as n_chars from c group by 1""")
def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections begin at titles and at changes of page: how many there are, and their characters."""
    c = read(spark, sf_dir, "conversations")
    e = c.select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("page"), F.when(F.col("role") == "user", "Title").otherwise("Text").alias("type"), F.md5(F.concat_ws("-", "conv_id", "turn")).alias("text"))
    parts = segment.chunk_by_title(e, "conv_id", "turn", page="page", most=10_000, combine_under=0, multipage=False)
    return parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("text")).alias("n_chars"))


@query("""with e as (select conv_id, turn, role = 'user' as title, md5(conv_id || '-' || turn) as t from conversations),
s as (select *, sum(title::int) over (partition by conv_id order by turn rows unbounded preceding) as section from e),
c as (select conv_id, section, string_agg(t, chr(10) || chr(10) order by turn) as t from s group by 1, 2),
r as (select conv_id, t, row_number() over (partition by conv_id order by section) as k, count(*) over (partition by conv_id) as n from c),
f as (with recursive w as (select conv_id, k, n, t as text, 0 as chunk_seq, false as done from r where k = 1
union all select w.conv_id, r.k, r.n, case when length(w.text) < 100 and length(w.text) + length(r.t) + 2 <= 150 then w.text || chr(10) || chr(10) || r.t else r.t end, case when length(w.text) < 100 and length(w.text) + length(r.t) + 2 <= 150 then w.chunk_seq else w.chunk_seq + 1 end, false from w join r on w.conv_id = r.conv_id and r.k = w.k + 1) select * from w)
select conv_id, chunk_seq::int as chunk_seq, arg_max(text, k) as text from f group by 1, 2""")
def titles_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections under 100 characters joined while they stay within 150."""
    c = read(spark, sf_dir, "conversations")
    e = c.select("conv_id", "turn", F.when(F.col("role") == "user", "Title").otherwise("Text").alias("type"), F.md5(F.concat_ws("-", "conv_id", "turn")).alias("text"))
    joined = segment.chunk_by_title(e, "conv_id", "turn", most=150, combine_under=100)
    return joined.select("conv_id", "chunk_seq", "text")
