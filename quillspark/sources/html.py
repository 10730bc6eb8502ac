"""Elements of web pages by the nesting of their tags.

A page is cut into tags and texts in one pass; how deep a place lies in lists, tables, preformatted or dropped parts is a running sum over
its tags (an opening tag counts 1, a closing one -1; a closing tag without an opening one counts for nothing). All of it is windows over
the tags of a page: linear in the page but for the sort, and no tag is matched with its partner by a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .files import DROPPED

# Tags that begin and end a paragraph, those whose content is no markup, and entities.
BLOCKS = ["address", "article", "aside", "blockquote", "body", "caption", "center", "div", "fieldset", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
INLINE = ["del", "button", "label"]  # of those left out, the ones that stand within a paragraph
RAW = ["script", "style", "noscript", "template", "textarea", "title"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]

#: A tag with its quoted values, a text, or a lone <.
TOKEN = r"""</?[A-Za-z][^'">]*(?:"[^"]*"[^'">]*|'[^']*'[^'">]*)*>|[^<]+|<"""
#: What is taken out before: comments, declarations and content that is no markup.
NO_MARKUP = "(?is)<!--.*?-->|<![^>]*>|<\\?[^>]*>" + "".join(rf"|<{t}\b[^>]*>.*?</{t}\s*>" for t in RAW)


def page_tokens(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, token, tag, sign): tags in lower case with sign 1 (opening), -1 (closing) or 0 (neither closes: br, img, ...); texts have
    no tag."""
    cut = F.regexp_extract_all(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), NO_MARKUP, ""), F.lit(TOKEN), F.lit(0))
    rows = pages.select(id_col, F.posexplode(cut).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    void = tag.isin("br", "img", "hr", "meta", "link", "input", "") | F.endswith("token", F.lit("/>"))
    return rows.select(id_col, "pos", "token", F.when(tag != "", tag).alias("tag"), F.when(void, 0).when(F.startswith("token", F.lit("</")), -1).otherwise(1).alias("sign"))


def page_blocks(pages: DataFrame, id_col: str = "page_id", html: str = "html", drop: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, seq, type, depth, text) of each paragraph of pages, in order.

    Paragraphs lie between tags of BLOCKS. In a heading they are Title (depth: its level less 1), in a list ListItem (depth: the lists
    around it less 1), in pre CodeSnippet with its white space; a table is one Table with all that is in it, tables too; an image is
    Image with its alternative text; others are NarrativeText. Only what is in <main> counts, else in <body>, else all; parts of DROPPED, and
    of `drop`, are left out with all they hold. Texts under two characters go, but for images. A heading ends where another tag of BLOCKS
    begins, if it isn't closed."""
    page = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(id_col)
    groups = {"gone": [*DROPPED, *drop], "main": ["main"], "body": ["body"], "solid": ["table", "pre"], "list": ["ul", "ol"]}
    rows = page_tokens(pages, id_col, html)
    rows = rows.withColumns({f"s_{k}": F.sum(F.when(F.col("tag").isin(*v), F.col("sign")).otherwise(0)).over(page) for k, v in groups.items()})
    rows = rows.withColumns({f"m_{k}": F.min(f"s_{k}").over(page) for k in groups})
    rows = rows.withColumns({k: F.col(f"s_{k}") - F.least(F.lit(0), f"m_{k}") for k in groups}).drop(*[f"{p}_{k}" for p in "sm" for k in groups])
    rows = rows.withColumns({f"has_{k}": F.max(k).over(whole) > 0 for k in ("main", "body")})
    inside = F.when(F.col("has_main"), F.col("main") > 0).when(F.col("has_body"), F.col("body") > 0).otherwise(True) & (F.col("gone") == 0)
    own = Window.partitionBy(id_col).orderBy("pos")
    # a table or pre is one paragraph from its first tag to its last: tags of BLOCKS within it part nothing
    turns = F.col("tag").isin("table", "pre") & (F.col("solid") == F.when(F.col("sign") == 1, 1).otherwise(0))
    edge = F.when(turns, True).when(F.col("solid") > 0, False).otherwise(F.col("tag").isin(*BLOCKS, "img", *[x for x in groups["gone"] if x not in INLINE]))
    rows = rows.where(inside).withColumn("edge", F.coalesce(edge, F.lit(False)))
    loose = F.col("solid") == 0
    after_image = F.coalesce(F.lag("tag").over(own) == "img", F.lit(False))
    rows = rows.withColumn("edge", F.col("edge") | (after_image & loose))
    block = rows.withColumn("g", F.sum(F.col("edge").cast("int")).over(page))
    opened = F.when(F.col("edge") & (F.col("sign") == 1), F.col("tag"))
    alt = F.when((F.col("tag") == "img") & loose, F.regexp_extract("token", r'(?i)\salt="([^"]*)"', 1))
    piece = F.when(F.col("edge") & F.col("tag").isNotNull(), "").when(F.col("tag").isNull(), F.col("token")).when(F.col("tag") == "br", "\n").when(F.col("tag").isin(*BLOCKS), " ").otherwise("")
    out = block.groupBy(id_col, "g").agg(F.min("pos").alias("pos"), F.max(opened).alias("opened"), F.max("solid").alias("solid"), F.max("list").alias("list"), F.max(alt).alias("alt"), F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: x["t"]), "")
    for a, b in ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    solid = F.when(F.col("solid") > 0, F.col("opened"))
    kind = F.when(F.col("alt").isNotNull(), "Image").when(solid == "table", "Table").when(solid == "pre", "CodeSnippet").when(F.col("opened").rlike("^h[1-6]$"), "Title").when(F.col("list") > 0, "ListItem").otherwise("NarrativeText")
    plain = T.strip(F.regexp_replace(text, r"\s+", " "))
    out = out.select(id_col, "pos", kind.alias("type"), F.col("opened"), "list", F.when(F.col("alt").isNotNull(), F.col("alt")).when(kind == "CodeSnippet", F.regexp_replace(text, r"^\n|\n$", "")).otherwise(plain).alias("text"))
    out = out.where((F.col("type") == "Image") | (F.length("text") >= 2))
    depth = F.when(F.col("type") == "Title", F.substring("opened", 2, 1).cast("int") - 1).when(F.col("type") == "ListItem", F.col("list") - 1)
    return out.select(id_col, (F.row_number().over(own) - 1).alias("seq"), "type", depth.cast("int").alias("depth"), "text")
