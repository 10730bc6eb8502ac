"""Page elements against a parser that keeps a stack of open tags."""

import random
import re
from html.parser import HTMLParser

import pytest

from quillspark.sources import html as H
from quillspark.sources.files import DROPPED


class Plain(HTMLParser):
    """Walks a page with a stack; well-formed pages only."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.out, self.now, self.kept = [], [], [], []

    def flush(self):
        text, kinds = "".join(self.now), self.kept
        self.now, self.kept = [], []
        solid = next((t for t in kinds if t in ("pre", "table")), None)
        if solid == "pre":
            text, kind, depth = re.sub(r"^\n|\n$", "", text), "CodeSnippet", None
        else:
            text = re.sub(r"\s+", " ", text).strip()
            blocks = [t for t in kinds if t in H.BLOCKS]
            heads = [t for t in blocks[-1:] if re.fullmatch("h[1-6]", t)]
            lists = sum(t in ("ul", "ol") for t in kinds)
            kind, depth = ("Table", None) if solid else ("Title", int(heads[-1][1]) - 1) if heads else ("ListItem", lists - 1) if lists else ("NarrativeText", None)
        if len(text) >= 2:
            self.out.append((kind, depth, text))

    def gone(self):
        return bool(set(self.stack) & set(DROPPED))

    def edge(self):
        return "table" not in self.stack and "pre" not in self.stack and not self.gone()

    def handle_starttag(self, tag, attrs):
        if tag == "br" and not self.gone():
            self.now.append("\n")
        elif tag in ("br", "img"):
            if tag == "img" and self.edge():
                self.flush()
                self.out.append(("Image", None, dict(attrs).get("alt") or ""))
        else:
            if tag in H.BLOCKS and self.edge():
                self.flush()
            elif tag in H.BLOCKS and not self.gone():
                self.now.append(" ")
            self.stack.append(tag)

    def handle_endtag(self, tag):
        assert self.stack.pop() == tag
        if (tag in H.BLOCKS or tag in DROPPED and tag not in H.INLINE) and self.edge():
            self.flush()
        elif tag in H.BLOCKS and not self.gone():
            self.now.append(" ")

    def handle_data(self, data):
        if not self.gone():
            self.now.append(data)
            self.kept = list(self.stack)


def plain(page):
    p = Plain()
    p.feed(page)
    p.flush()
    return p.out


def run(spark, pages):
    rows = H.page_blocks(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    out = [[] for _ in pages]
    for r in sorted(rows, key=lambda r: (r.page_id, r.seq)):
        assert r.seq == len(out[r.page_id])
        out[r.page_id].append((r.type, r.depth, r.text))
    return out


def test_literal_cases(spark):
    cases = [
        ("<ul><li>one<ul><li>inner one</li><li>inner two</li></ul>tail of one</li><li>two</li></ul>", [("ListItem", 0, "one"), ("ListItem", 1, "inner one"), ("ListItem", 1, "inner two"), ("ListItem", 0, "tail of one"), ("ListItem", 0, "two")]),
        ("<table><tr><td>a<table><tr><td>in</td></tr></table></td><td>b</td></tr></table><p>after</p>", [("Table", None, "a in b"), ("NarrativeText", None, "after")]),
        ("<div>out<div>in <b>bold</b>er</div>rest</div>", [("NarrativeText", None, "out"), ("NarrativeText", None, "in bolder"), ("NarrativeText", None, "rest")]),
        ("<nav>menu<nav>inner</nav>still menu</nav><p>shown</p>", [("NarrativeText", None, "shown")]),
        ("<body>no<main><h2>Head</h2>yes</main>no</body>", [("Title", 1, "Head"), ("NarrativeText", None, "yes")]),
        ('<p title="a > b">x &lt;y&gt; &amp;amp;</p><script>if (a</b>) "</p>"</script><!-- <p>no</p> --><p>yes', [("NarrativeText", None, "x <y> &amp;"), ("NarrativeText", None, "yes")]),
        ("<pre>\n  a\n    <p>b</p>\n</pre>", [("CodeSnippet", None, "  a\n     b ")]),
        ('text<img src="x" alt="Alt"> more', [("NarrativeText", None, "text"), ("Image", None, "Alt"), ("NarrativeText", None, "more")]),
        ("</div></ul>stray <p>then<p>open ones<h3>and a head<p>end", [("NarrativeText", None, "stray"), ("NarrativeText", None, "then"), ("NarrativeText", None, "open ones"), ("Title", 2, "and a head"), ("NarrativeText", None, "end")]),
        ("5 < 6 and 7 > 6", [("NarrativeText", None, "5 < 6 and 7 > 6")]), ("", []), (None, []), ("<p> </p><p>.</p>", []),
    ]
    assert run(spark, [c for c, _ in cases]) == [w for _, w in cases]


@pytest.mark.parametrize("seed", range(3))
def test_nested_pages_equal_a_stack(spark, seed):
    rng = random.Random(seed)

    def part(depth):
        word = " ".join(rng.choice(["alpha", "be ta", "ga\nmma", "x", "é漢"]) for _ in range(rng.randint(1, 4)))
        if depth == 0:
            return word
        tag = rng.choice(["div", "p", "ul", "ol", "table", "section", "nav", "b", "span", "blockquote", "pre", "img", "br", "h2"])
        if tag in ("img", "br"):
            return word + (f'<img alt="{word[:3].strip()}">' if tag == "img" else "<br>")
        kids = "".join(part(rng.randint(0, depth - 1)) for _ in range(rng.randint(1, 3)))
        if tag in ("p", "h2"):
            kids = word + rng.choice(["", "<b>bold</b>", "<span>s<i>i</i></span>"])
        if tag in ("ul", "ol"):
            kids = "".join(f"<li>{part(rng.randint(0, depth - 1))}</li>" for _ in range(2))
        if tag == "table":
            kids = "".join("<tr>" + "".join(f"<td>{part(rng.randint(0, depth - 1))}</td>" for _ in range(2)) + "</tr>" for _ in range(2))
        return f"<{tag}>{kids}</{tag}>" + rng.choice(["", word])

    pages = ["<html><body>" + "".join(part(5) for _ in range(4)) + "</body></html>" for _ in range(40)]
    got = run(spark, pages)
    for g, p in zip(got, pages):
        assert g == plain(p), p


def test_a_long_page(spark):
    """A page of 200,000 tags, a thousand lists deep."""
    page = "<ul><li>in" * 1000 + "</li></ul>" * 1000 + "<p>text</p>" * 90_000
    rows = H.page_blocks(spark.createDataFrame([(1, page)], "page_id long, html string"))
    assert rows.count() == 91_000 and rows.agg({"depth": "max"}).first()[0] == 999
