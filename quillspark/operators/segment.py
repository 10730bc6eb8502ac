"""Cutting texts into paragraphs, sections and chunks, and putting chunks together again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def split_paragraphs(df: DataFrame, id_col: str, text: str = "text", by: str = r"\n{2,}", least: int = 15) -> DataFrame:
    """(id, seq, title, text): stripped parts of at least `least` characters; the title is the first 50 characters and dots."""
    rows = df.select(id_col, F.posexplode(F.split(text, by)).alias("seq", "t")).withColumn("t", T.strip(F.col("t"))).where(F.length("t") >= least)
    return rows.select(id_col, "seq", title_of(F.col("t")).alias("title"), F.col("t").alias("text"))


def title_of(text: Column) -> Column:
    """The first 50 characters of a paragraph and dots."""
    return T.shortened(text, 50, 50)


def _lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(id_col, F.posexplode(F.split(text, r"\n")).alias("line", "t"))


def markdown_headings(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, section, level, title, body): a section for each #, ## or ### line; section 0 is what stands before the first."""
    heading = r"^(#{1,3})\s+(.+)"
    lines = _lines(df, id_col, text).withColumn("h", F.col("t").rlike(heading))
    section = F.sum(F.col("h").cast("int")).over(Window.partitionBy(id_col).orderBy("line"))
    rows = lines.withColumn("section", section).groupBy(id_col, "section").agg(F.array_sort(F.collect_list(F.struct("line", "h", "t"))).alias("x"))
    head = F.col("x")[0]
    level = F.when(head["h"], F.length(F.regexp_extract(head["t"], heading, 1)))
    body = F.transform(F.filter("x", lambda r: ~r["h"]), lambda r: r["t"])
    return rows.select(id_col, "section", level.alias("level"), F.when(head["h"], T.strip(F.regexp_extract(head["t"], heading, 2))).alias("title"), T.strip(F.array_join(body, "\n")).alias("body")).where("title is not null or body <> ''")


# Words of addresses, which are no headings.
_ADDRESS = ["DRIVE", "AVENUE", "ROAD", "STREET", "BOULEVARD", "SAN JOSE", "USA", "ZIP"]


def plain_heading(t: Column) -> Column:
    """Whether a stripped line is a heading. The rules exclude each other: a line of capitals that is an address isn't tried
    as anything else."""
    address = lambda words: F.upper(t).rlike("|".join(words))
    capitals = t.rlike("[A-Z]") & ~t.rlike("[a-z]") & F.length(t).between(15, 80) & F.contains(t, F.lit(" "))
    numbered = t.rlike(r"(?i)^(chapter|section|part)\s+\d+[.:]?\s*")
    dotted = t.rlike(r"^\d+(\.\d+)*\s+[A-Z]")
    short = F.length(t).between(10, 60) & ~t.rlike(r"[.!?;:]$") & t.rlike(r"^\p{Lu}")
    words = F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"^\p{L}+$"))
    titled = (F.size(words) >= 3) & (F.size(F.filter(words, lambda w: (F.length(w) > 3) & w.rlike(r"^\p{Lu}"))) >= 3) & ~address([*_ADDRESS, "POSTAL"])
    action = (t.rlike(r"(?i)^to\s+\w+") | t.rlike(r"(?i)^how\s+to\s+\w+")) & (F.length(t) < 80)
    return F.when(capitals, ~address(_ADDRESS)).when(numbered, True).when(dotted, True).when(short, titled).otherwise(action)


def plaintext_headings(df: DataFrame, id_col: str, text: str = "text", cover: int = 200) -> DataFrame:
    """(id, offset, title) of headings in plain text; within the first `cover` characters only numbered chapters count."""
    lines = _lines(df, id_col, text)
    end = F.sum(F.length("t") + 1).over(Window.partitionBy(id_col).orderBy("line"))
    rows = lines.withColumn("offset", end - F.length("t") - 1).withColumn("title", T.strip(F.col("t"))).where(F.col("title") != "")
    early = F.col("title").rlike(r"(?i)^(chapter|section|part|appendix)\s+\d+")
    return rows.where(plain_heading(F.col("title")) & ((F.col("offset") >= cover) | early)).select(id_col, "offset", "title")


def split_strategy(df: DataFrame, id_col: str, text: str = "text", least: int = 3) -> DataFrame:
    """(id, strategy): markdown with `least` markdown headings, else plaintext with as many plain ones, else paragraph."""
    plain = plaintext_headings(df, id_col, text).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    marks = F.size(F.filter(F.split(F.col(text), r"\n"), lambda t: t.rlike(r"^(#{1,3})\s+(.+)")))
    rows = df.select(id_col, marks.alias("m")).join(plain, id_col, "left")
    return rows.select(id_col, F.when(F.col("m") >= least, "markdown").when(F.col("n") >= least, "plaintext").otherwise("paragraph").alias("strategy"))


def split_by_strategy(df: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, strategy, seq, title, content): each text split the way split_strategy() names: at its markdown headings, at its plain
    ones, or into packed paragraphs."""
    told = split_strategy(df, id_col, text)
    of = lambda s: df.join(told.where(F.col("strategy") == s).select(id_col), id_col, "left_semi")
    marked = markdown_headings(of("markdown"), id_col, text).select(id_col, F.lit("markdown").alias("strategy"), F.col("section").cast("long").alias("seq"), "title", F.col("body").alias("content"))
    heads = plaintext_headings(of("plaintext"), id_col, text)
    nxt = F.lead("offset").over(Window.partitionBy(id_col).orderBy("offset"))
    heads = heads.withColumn("end", nxt).withColumn("seq", F.row_number().over(Window.partitionBy(id_col).orderBy("offset")).cast("long"))
    size = F.coalesce("end", F.length(text)) - F.col("offset")
    plain = heads.join(df.select(id_col, text), id_col).select(id_col, F.lit("plaintext").alias("strategy"), "seq", "title", T.strip(F.substring(F.col(text), (F.col("offset") + 1).cast("int"), size.cast("int"))).alias("content"))
    packed = pack_paragraphs(of("paragraph"), id_col, text).select(id_col, F.lit("paragraph").alias("strategy"), F.col("block").cast("long").alias("seq"), "title", "content")
    return marked.unionByName(plain).unionByName(packed)


#: Starts that are put into one array before it is handed on: adding to an array copies it.
_RUN = 256


def _starts(items: Column, joins: Callable[[Column, Column], Column], first: Callable[[Column], Column], more: Callable[[Column, Column], Column]) -> Column:
    """Places (from 0) where a new block starts, in one pass over items that carries a few numbers and no text: joins(block, next)
    says whether the next goes into the block, first(item) and more(block, next) are what is known of a block. Starts are
    gathered in runs, so the pass is near linear in the items."""
    places = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("any"), first(F.get(items, F.lit(0))).alias("now"), places.alias("run"), F.array().cast("array<array<int>>").alias("runs"))

    def step(acc: Column, x: Column) -> Column:
        new = ~(acc["any"] & joins(acc["now"], x))
        full = new & (F.size(acc["run"]) == _RUN)
        run = F.when(full, F.array(acc["i"])).when(new, F.array_append(acc["run"], acc["i"])).otherwise(acc["run"])
        runs = F.when(full, F.array_append(acc["runs"], acc["run"])).otherwise(acc["runs"])
        return F.struct((acc["i"] + 1).alias("i"), F.lit(True).alias("any"), F.when(new, first(x)).otherwise(more(acc["now"], x)).alias("now"), run.alias("run"), runs.alias("runs"))

    return F.aggregate(items, start, step, lambda acc: F.concat(F.flatten(acc["runs"]), acc["run"]))


def _blocks(items: str, starts: str) -> Column:
    """The items of each block; both are columns of their own, not expressions, so that neither is made anew for each block. To unfold the
    result use posexplode_outer: for posexplode Spark tests the array's size below the projections, with all expressions put in."""
    # item by item: a slice would unpack the whole array for each block
    return F.transform(starts, lambda s, k: F.transform(F.sequence(s, F.coalesce(F.get(starts, k + 1), F.size(items)) - 1), lambda i: F.get(items, i)))


def _merged(df: DataFrame, parts: Column, keep: int | None) -> DataFrame:
    """df with _blocks: paragraphs in order, one joined to the block before it if neither is a table, it has at most 200 characters and
    the block at most `keep`."""
    one = F.transform("_parts", lambda x: F.struct(F.length(x).alias("n"), F.contains(x, F.lit("|")).alias("bar"), _is_table(x).alias("table")))
    # a block of several is a table once one of them has a bar: the blank lines between them are lines
    joins = lambda now, x: ~x["table"] & ~now["table"] & (x["n"] <= 200) & (F.lit(True) if keep is None else now["n"] <= keep)
    more = lambda now, x: F.struct((now["n"] + x["n"] + 2).alias("n"), (now["bar"] | x["bar"]).alias("bar"), (now["bar"] | x["bar"]).alias("table"))
    rows = df.withColumn("_parts", parts).withColumn("_starts", _starts(one, joins, lambda x: F.struct(x["n"], x["bar"], x["table"]), more))
    return rows.withColumn("_blocks", F.transform(_blocks("_parts", "_starts"), lambda b: F.array_join(b, "\n\n"))).drop("_parts", "_starts")


def _is_table(t: Column) -> Column:
    return F.contains(t, F.lit("|")) & F.contains(t, F.lit("\n"))


def pack_paragraphs(df: DataFrame, id_col: str, text: str = "text", most: int = 2000, pages: int = 30) -> DataFrame:
    """(id, block, title, content, page): tables stand alone, a paragraph over 200 characters starts a block, shorter ones are
    added to it; blocks under 10 characters go."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), T.strip), lambda p: p != "")
    # what is told of a text stands in columns of its own before its blocks are unfolded: beside posexplode it would be made for each block
    rows = _merged(df.select(id_col, text), parts, None).select(id_col, F.size("_blocks").alias("n"), F.col("_blocks").alias("b"))
    rows = rows.select(id_col, "n", F.posexplode_outer("b").alias("block", "t")).where(F.length("t") >= 10)
    first = T.strip(F.element_at(F.split("t", r"\n"), 1))
    return rows.select(id_col, "block", T.shortened(first, 80, 80).alias("title"), F.substring("t", 1, most).alias("content"), T.approx_page(F.col("block"), F.col("n"), pages).alias("page"))


def smart_split(df: DataFrame, id_col: str, title: str, text: str = "text", size: int = 800, kind: str | None = None) -> DataFrame:
    """(id, part, title, content): junk paragraphs dropped, others merged until a table, a long one or 0.8 of the size;
    parts under 20 characters go; later parts are (cont. n). With a type column, type: sop_step for a part with numbered lines under a
    "To ..." title or with dashed numbers under a title with "step", else the given one. Parts of academic texts have their math
    repaired, and a promoted heading in place of a "Section n"."""
    parts = F.filter(F.transform(F.split(text, r"\n{2,}"), T.strip), lambda p: (p != "") & ~T.is_junk(p))
    blocks = F.filter("_blocks", lambda b: F.length(b) >= 20)
    rows = _merged(df, parts, int(0.8 * size)).select(id_col, F.col(title).alias("_title"), F.col(kind).alias("_kind") if kind else F.lit(None).cast("string").alias("_kind"), T.is_academic(F.col(text)).alias("_academic"), blocks.alias("_blocks"))
    # tells of the whole text, so it is made before the parts are unfolded: beside posexplode it would read the text again for each part
    rows = rows.select(id_col, "_title", "_kind", "_academic", F.posexplode_outer("_blocks").alias("part", "content")).where("part is not null")
    rows = rows.withColumn("content", F.when(F.col("_academic"), T.repair_math(F.col("content"))).otherwise(F.col("content")))
    promoted = T.promoted_heading(F.col("content"))
    rows = rows.withColumn("_title", F.when(F.col("_academic") & F.col("_title").rlike(r"^Section\s+\d+$") & (promoted != ""), promoted).otherwise(F.col("_title")))
    step = (F.lower("_title").startswith("to ") & F.col("content").rlike(r"(?:^|\n)[\s*•\-]*\d+\.")) | (F.contains(F.lower("_title"), F.lit("step")) & F.col("content").rlike(r"(?:^|\n)\s*-\s*\d+\."))
    more = [F.when(step, F.lit("sop_step")).otherwise(F.col("_kind")).alias("type")] if kind else []
    return rows.select(id_col, "part", *more, F.when(F.col("part") > 0, F.concat("_title", F.lit(" (cont. "), F.col("part").cast("string"), F.lit(")"))).otherwise(F.col("_title")).alias("title"), "content")


def hard_cut(df: DataFrame, id_col: str, text: str = "text", size: int = 500) -> DataFrame:
    """(id, chunk_seq, chunk): every `size` characters."""
    at = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return df.select(id_col, text, F.explode(at).alias("chunk_seq")).select(id_col, "chunk_seq", F.substring(F.col(text), F.col("chunk_seq") * size + 1, F.lit(size)).alias("chunk"))


def cut_piece(t: str, size: int, separators: tuple[str, ...], overlap: int) -> list[str]:
    """One text in pieces of at most `size` characters: cut at the right-most place of the first separator that leaves
    something, else hard; each piece starts with the `overlap` last characters of the one before and a space."""
    out, head = [], ""
    t = t.strip()
    while t:
        room = size - len(head)
        if len(t) <= room:
            out.append(head + t)
            break
        at = next((p for s in separators if (p := t.rfind(s, 0, room + 1)) > 0), room)
        piece = (head + t[:at]).strip()
        out.append(piece)
        t = t[at:].strip()
        head = piece[-overlap:].strip() + " " if overlap else ""
    return out


def cut_measured(t: str, most: int, measure: Callable[[str], int], separators: tuple[str, ...] = ("\n", " "), overlap: int = 0) -> list[str]:
    """One text in pieces that a counter gives at most `most` each: cut at the right-most place of the first separator that leaves
    something, else where the counter is reached. Each piece starts with about the last `overlap` units of the one before, from a word's
    start, and a space. The counter must not fall as a text grows: places are found by halving."""
    out, t = [], t.strip()
    while t:
        if measure(t) <= most:
            out.append(t)
            break
        low, high = 1, len(t)
        while low < high:  # the longest start that fits, a character at least
            mid = (low + high + 1) // 2
            low, high = (mid, high) if measure(t[:mid]) <= most else (low, mid - 1)
        at = next((p for s in separators if (p := t.rfind(s, 0, low + len(s))) > 0 and measure(t[:p].strip()) > 0), low)
        piece, rest = t[:at].strip(), t[at:].strip()
        out.append(piece)
        if overlap and rest:
            low, high = 0, len(piece)
            while low < high:  # the longest end within the overlap
                mid = (low + high) // 2
                low, high = (low, mid) if measure(piece[mid:]) <= overlap else (mid + 1, high)
            if low and not piece[low - 1].isspace():
                low = next((k for k in range(low, len(piece)) if piece[k].isspace()), len(piece))
            tail = piece[low:].strip()
            if tail and len(tail) + 1 + len(rest) < len(t):
                rest = f"{tail} {rest}"
        t = rest
    return out


#: Characters of texts whose pieces are held in Python at a time.
_HELD = 1 << 20


def cut_text(c: Column, size: int, separators: tuple[str, ...] = ("\n", " "), overlap: int = 0, measure: Callable[[str], int] | None = None, cut: Callable[[str, int], list[str]] | None = None) -> Column:
    """Array of pieces (see cut_piece, and cut_measured for a user's own counter), Arrow batch by Arrow batch: each cut depends on the one
    before. cut: a user's own function of a text and the size, instead."""
    if overlap + 1 >= size:
        raise ValueError("the overlap leaves no room")
    if cut is None:
        cut = (lambda t, n: cut_piece(t, n, separators, overlap)) if measure is None else (lambda t, n: cut_measured(t, n, measure, separators, overlap))

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            out, held = [], 0
            for x in t:
                out.append(list(cut(x, size)) if x else [])
                held += len(x) if x else 0
                if held > _HELD:  # pieces of a batch go on some texts at a time: a batch counts rows, whatever their length
                    yield pd.Series(out, dtype=object)
                    out, held = [], 0
            if out:
                yield pd.Series(out, dtype=object)

    return pieces(c)


def chunk_recursive(df: DataFrame, id_col: str, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_seq, chunk) by paragraphs, lines, words, then characters, with overlap."""
    return df.select(id_col, F.posexplode(cut_text(F.col(text), size, ("\n\n", "\n", " "), overlap)).alias("chunk_seq", "chunk"))


def chunk_basic(elements: DataFrame, doc: str, seq: str, text: str = "text", kind: str = "type", most: int = 500, new_after: int | None = None, within: tuple[str, ...] = (), size: Callable[[Column], Column] = F.length, measure: Callable[[str], int] | None = None, cut: Callable[[str, int], list[str]] | None = None) -> DataFrame:
    """(doc, chunk_seq, text, n_elements, first_seq, last_seq): elements in order, greedily joined by a blank line up to `most`
    (a chunk of `new_after` is closed); a table stands alone; an element over `most` is cut at separators. White space of
    elements is made single spaces, except in code. size counts characters, or tokens (see token_size); what it gives for joined elements
    must be the sum of theirs and of the blank line's. measure: the same counter for a Python text, with which an element over `most` is
    cut if size doesn't count characters (without it such elements stay whole); cut: a user's own cutting function instead."""
    soft = most if new_after is None else min(most, new_after)
    keys = [doc, *within]
    clean = F.when(F.col(kind) == "CodeSnippet", F.col(text)).otherwise(T.strip(F.regexp_replace(text, r"\s+", " ")))
    rows = elements.select(*keys, F.col(seq).alias("s"), F.col(kind).alias("k"), clean.alias("t")).where("t <> ''")
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "k", "t"))).alias("x"))
    glue = size(F.lit("\n\n"))
    items = F.transform("x", lambda x: F.struct(size(x["t"]).cast("long").alias("n"), ((x["k"] == "Table") | (size(x["t"]) > most)).alias("alone")))
    joins = lambda now, x: ~now["alone"] & ~x["alone"] & (now["n"] < soft) & (now["n"] + glue + x["n"] <= most)
    more = lambda now, x: F.struct((now["n"] + glue + x["n"]).alias("n"), F.lit(False).alias("alone"))
    started = grouped.withColumn("starts", _starts(items, joins, lambda x: F.struct(x["n"], x["alone"]), more))
    chunk = lambda b: F.struct(F.array_join(F.transform(b, lambda x: x["t"]), "\n\n").alias("t"), F.size(b).alias("n"), F.get(b, F.lit(0))["s"].cast("long").alias("a"), F.element_at(b, -1)["s"].cast("long").alias("b"))
    rows = started.select(*keys, F.posexplode_outer(F.transform(_blocks("x", "starts"), chunk)).alias("g", "c")).where("g is not null")
    over = (size(F.col("c.t")) > most) & F.lit(size is F.length or measure is not None or cut is not None)  # only these go through the cutting function
    whole = rows.where(~over).select(*keys, "g", "c", F.lit(0).alias("piece"), F.col("c.t").alias("text"))
    rows = whole.unionByName(rows.where(over).select(*keys, "g", "c", F.posexplode(cut_text(F.col("c.t"), most, measure=measure, cut=cut)).alias("piece", "text")))
    order = F.row_number().over(Window.partitionBy(doc).orderBy(*within, "g", "piece")) - 1
    return rows.select(doc, order.alias("chunk_seq"), "text", F.col("c.n").alias("n_elements"), F.col("c.a").alias("first_seq"), F.col("c.b").alias("last_seq"), (F.col("piece") > 0).alias("is_continuation"))


def overlapped(chunks: DataFrame, doc: str, overlap: int, all_chunks: bool = False, text: str = "text", seq: str = "chunk_seq", continuation: str = "is_continuation") -> DataFrame:
    """chunks with the last `overlap` characters of the chunk before (at most; white space off) and a space put in front: only where an
    over-long element was cut, or for all chunks. Cut the elements to most - overlap - 1 characters to stay within most."""
    before = F.lag(text).over(Window.partitionBy(doc).orderBy(seq))
    tail = T.strip(F.substring(before, F.greatest(F.lit(1), F.length(before) - overlap + 1), F.lit(overlap)))
    wanted = before.isNotNull() & (tail != "") & (F.lit(True) if all_chunks else F.col(continuation))
    return chunks.withColumn(text, F.when(wanted, F.concat(tail, F.lit(" "), F.col(text))).otherwise(F.col(text)))


def cut_tokens(df: DataFrame, id_col: str, text: str = "text", most: int = 512) -> DataFrame:
    """(id, piece, text): texts cut into runs of at most `most` words (as token_size() counts), joined by single spaces."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = df.select(id_col, words.alias("_w"))
    runs = F.when(F.size("_w") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / most).cast("int")), lambda k: F.array_join(F.transform(F.sequence(k * most, F.least(k * most + most, F.size("_w")) - 1), lambda i: F.get("_w", i)), " "))).otherwise(F.array().cast("array<string>"))
    return rows.select(id_col, F.posexplode(runs).alias("piece", "text"))


def token_size(c: Column) -> Column:
    """Words as tokens, for chunk_basic(size=...)."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def sections(elements: DataFrame, doc: str, seq: str, kind: str = "type", page: str | None = None, multipage: bool = True) -> DataFrame:
    """elements with `section`: a title starts one, and so does a change of page unless multipage (no page: as before)."""
    w = Window.partitionBy(doc).orderBy(seq)
    starts = F.col(kind) == "Title"
    if page and not multipage:
        before = F.last(page, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        starts = starts | (F.col(page).isNotNull() & before.isNotNull() & (F.col(page) != before))
    return elements.withColumn("section", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def chunk_by_title(elements: DataFrame, doc: str, seq: str, text: str = "text", kind: str = "type", page: str | None = None, most: int = 500, new_after: int | None = None, combine_under: int | None = None, multipage: bool = True) -> DataFrame:
    """chunk_basic within sections; then neighbours under `combine_under` characters (by default `most`) are joined while they
    fit."""
    under = most if combine_under is None else combine_under
    chunks = chunk_basic(sections(elements, doc, seq, kind, page, multipage), doc, seq, text, kind, most, new_after, ("section",))
    rows = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "text"))).alias("x"))
    joins = lambda now, x: (now["n"] < under) & (now["n"] + x["n"] + 2 <= most)
    sizes = F.transform("x", lambda c: F.struct(F.length(c["text"]).alias("n")))
    rows = rows.withColumn("starts", _starts(sizes, joins, lambda x: F.struct(x["n"]), lambda now, x: F.struct((now["n"] + x["n"] + 2).alias("n"))))
    return rows.select(doc, F.posexplode_outer(F.transform(_blocks("x", "starts"), lambda b: F.array_join(F.transform(b, lambda c: c["text"]), "\n\n"))).alias("chunk_seq", "text")).where("chunk_seq is not null")


def reconstruct_tables(chunks: DataFrame) -> DataFrame:
    """(table_id, text, n_chunks, text_as_html): chunks of a table by chunk_index (none last), joined by a space; html only if
    every chunk has it. Chunks (table_id, chunk_index, text, text_as_html) without a table are left out. Where chunks have
    num_carried_over_header_rows, the text of so many first rows is taken off the front of the chunk's."""
    if "num_carried_over_header_rows" in chunks.columns:
        trs = F.regexp_extract_all("text_as_html", F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))
        head = T.strip(F.regexp_replace(F.regexp_replace(F.array_join(F.slice(trs, 1, F.col("num_carried_over_header_rows")), " "), "<[^>]+>", " "), r"\s+", " "))
        carried = F.coalesce((F.col("num_carried_over_header_rows") > 0) & (F.size(trs) >= F.col("num_carried_over_header_rows")) & (head != "") & F.startswith(F.col("text"), head), F.lit(False))
        chunks = chunks.withColumn("text", F.when(carried, T.strip(F.substring(F.col("text"), F.length(head) + 1, F.length("text")))).otherwise(F.col("text")))
    order = F.struct(F.col("chunk_index").isNull().alias("late"), F.col("chunk_index").alias("i"), F.col("text").alias("t"), F.col("text_as_html").alias("h"))
    rows = chunks.where("table_id is not null").groupBy("table_id").agg(F.array_sort(F.collect_list(order)).alias("x"))
    html = F.when(F.forall("x", lambda c: c["h"].isNotNull()), F.array_join(F.transform("x", lambda c: c["h"]), ""))
    return rows.select("table_id", F.array_join(F.transform("x", lambda c: c["t"]), " ").alias("text"), F.size("x").alias("n_chunks"), html.alias("text_as_html"))


def consolidate(elements: DataFrame, by: list[str], seq: str, first: list[str] = [], strings: list[str] = [], lists: list[str] = [], unique: list[str] = [], maps: list[str] = []) -> DataFrame:  # noqa: B006
    """One row a group: first values that aren't null, strings joined by a space, lists joined, lists united in order, maps of lists
    with all their keys and, key by key, their lists united in order; columns not named are dropped."""
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(seq, F.col(c).alias("v"))))), lambda x: x["v"])
    out = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first]
    out += [F.array_join(of(c), " ").alias(c) for c in strings] + [F.flatten(of(c)).alias(c) for c in lists] + [F.array_distinct(F.flatten(of(c))).alias(c) for c in unique]
    # maps cannot be ordered, so their entries are: an array of them stands for each map
    pairs = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(seq, F.map_entries(c).alias("v"))))), lambda x: x["v"]))

    def united(c: str) -> Column:
        keys = F.array_sort(F.array_distinct(F.transform(pairs(c), lambda e: e["key"])))
        of_key = lambda k: F.transform(F.filter(pairs(c), lambda e: e["key"] == k), lambda e: e["value"])
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.array_distinct(F.flatten(of_key(k))).alias("value"))))

    out += [united(c).alias(c) for c in maps]
    return elements.groupBy(*by).agg(*out)


# Which types may stand under a title or a header of another type.
_BODY = ["Text", "UncategorizedText", "NarrativeText", "ListItem", "BulletedText", "Table", "FigureCaption", "CheckBox"]
HIERARCHY = {"Title": _BODY, "Header": ["Title", *_BODY]}


def parents(elements: DataFrame, doc: str, seq: str, kind: str = "type", depth: str = "category_depth", preset: str | None = None, rules: dict = HIERARCHY) -> DataFrame:
    """elements with parent_seq: the nearest open element of the same type and less depth, or one whose type may hold this
    type; elements that cannot hold it are closed. Rows with a preset parent keep it and are left out of the walk.

    A document's elements are walked in order; of the open ones only the chain of ancestors is kept."""
    cols = [doc, seq, kind, depth] + ([preset] if preset else [])
    narrow = elements.select(*[F.col(c) for c in cols])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        stack, out = [], []
        for row in pdf.itertuples(index=False):
            if preset and pd.notna(row[4]):
                out.append(row[4])
                continue
            d = 0 if pd.isna(row[3]) else row[3]
            found = None
            while stack:
                s, k, e = stack[-1]
                if (k == row[2] and e < d) or (k != row[2] and row[2] in rules.get(k, ())):
                    found = s
                    break
                stack.pop()
            out.append(found)
            stack.append((row[1], row[2], d))
        return pd.DataFrame({doc: pdf[doc], seq: pdf[seq], "parent_seq": pd.array(out, "Int64")})

    schema = f"{doc} {elements.schema[doc].dataType.simpleString()}, {seq} {elements.schema[seq].dataType.simpleString()}, parent_seq long"
    return elements.join(narrow.groupBy(doc).applyInPandas(walk, schema), [doc, seq], "left")


def parents_flat(elements: DataFrame, doc: str, seq: str, kind: str = "type", holder: str = "Title") -> DataFrame:
    """elements with parent_seq where all depths are equal: the last holder before; holders have none."""
    before = Window.partitionBy(doc).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn("parent_seq", F.when(F.col(kind) != holder, F.last(F.when(F.col(kind) == holder, F.col(seq)), ignorenulls=True).over(before)))


def group_by_parent(elements: DataFrame, doc: str, seq: str, parent: str, assign_orphans: bool = True) -> DataFrame:
    """(doc, parent, seqs): children of each parent in order; orphans join the group before them, or are groups of their own."""
    if assign_orphans:
        elements = elements.withColumn(parent, F.last(parent, ignorenulls=True).over(Window.partitionBy(doc).orderBy(seq)))
    return elements.groupBy(doc, parent).agg(F.array_sort(F.collect_list(seq)).alias("seqs"))


def group_by_page(elements: DataFrame, doc: str, seq: str, page: str) -> DataFrame:
    return elements.where(F.col(page).isNotNull()).groupBy(doc, page).agg(F.array_sort(F.collect_list(seq)).alias("seqs"))


def reading_order(elements: DataFrame, doc: str, page: str, seq: str, x: str, y: str) -> DataFrame:
    """elements with `place` by y, then x, on each page; the given order where a coordinate is missing on the page."""
    w = Window.partitionBy(doc, page)
    whole = F.count_if(F.col(x).isNull() | F.col(y).isNull()).over(w) == 0
    return elements.withColumn("_w", whole).withColumn("place", F.row_number().over(w.orderBy(F.when(F.col("_w"), F.col(y)), F.when(F.col("_w"), F.col(x)), seq))).drop("_w")


def drop_page_furniture(blocks: DataFrame, top: str, bottom: str, height: str, text: str = "text", header: float = 50, footer: float = 60) -> DataFrame:
    """Blocks outside the header and footer margins that are no dotted table-of-contents lines."""
    outside = (F.col(bottom) < header) | (F.col(top) > F.col(height) - footer)
    return blocks.where(~outside & ~F.col(text).rlike(r"(\. ?){4,}\d+"))


def chunk_tables(tables: DataFrame, id_col: str, html: str = "text_as_html", most: int = 500) -> DataFrame:
    """(table_id, chunk_index, text_as_html, text, num_carried_over_header_rows): rows of a table in chunks whose text stays
    within `most`; later chunks carry the header rows (leading rows with <th>). A row over `most` is split into rows of a cell each,
    and a cell over `most` into rows of a piece of its text each, cut at white space where there is some."""
    trs = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>.*?</tr>"), F.lit(0))
    plain = lambda r: T.strip(F.regexp_replace(F.regexp_replace(r, "<[^>]+>", " "), r"\s+", " "))
    rows = tables.select(F.col(id_col).alias("table_id"), trs.alias("r")).withColumn("heads", F.size(F.filter("r", lambda x, i: F.forall(F.slice(F.col("r"), 1, i + 1), lambda y: y.rlike("(?i)<th\\b")))))
    head = F.array_join(F.slice("r", 1, F.col("heads")), "")
    tr = lambda x: F.concat(F.lit("<tr>"), x, F.lit("</tr>"))
    fitting = rf"\S(?:.{{0,{max(0, most - 2)}}}\S)?(?=\s|$)|\S{{{most}}}"
    pieces = lambda c: F.transform(F.regexp_extract_all(plain(c), F.lit(fitting), F.lit(0)), lambda p: tr(F.concat(F.lit("<td>"), p, F.lit("</td>"))))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>.*?</t[dh]>"), F.lit(0))
    split = lambda r: F.flatten(F.transform(cells(r), lambda c: F.when(F.length(plain(c)) <= most, F.array(tr(c))).otherwise(pieces(c))))
    body = F.slice(F.col("r"), F.col("heads") + 1, F.size("r"))
    body = F.flatten(F.transform(body, lambda r: F.when(F.length(plain(r)) <= most, F.array(r)).otherwise(split(r))))
    rows = rows.select("table_id", "heads", head.alias("head"), body.alias("body"))
    long = lambda now, x: now["n"] + x["n"] + F.when((now["n"] > 0) & (x["n"] > 0), 1).otherwise(0)  # noqa: E731  a space between two texts
    sizes = F.transform("body", lambda r: F.struct(F.length(plain(r)).alias("n")))
    rows = rows.withColumn("starts", _starts(sizes, lambda now, x: long(now, x) <= most, lambda x: F.struct(x["n"]), lambda now, x: F.struct(long(now, x).alias("n"))))
    rows = rows.select("table_id", "heads", "head", F.posexplode_outer(F.transform(_blocks("body", "starts"), lambda b: F.array_join(b, ""))).alias("chunk_index", "b"))
    rows = rows.withColumns({"chunk_index": F.coalesce("chunk_index", F.lit(0)), "b": F.coalesce("b", F.lit(""))})
    whole = F.concat(F.lit("<table>"), "head", "b", F.lit("</table>"))
    return rows.select("table_id", "chunk_index", whole.alias("text_as_html"), plain(whole).alias("text"), F.when(F.col("chunk_index") > 0, F.col("heads")).otherwise(F.lit(0)).alias("num_carried_over_header_rows"))
