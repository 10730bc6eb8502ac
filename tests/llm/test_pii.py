import hashlib
import math
import random
import re
from collections import Counter

from quillspark.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    x = [int(c) for c in d[::-1]]
    return sum(x[::2] + [sum(divmod(2 * y, 10)) for y in x[1::2]]) % 10 == 0


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TRICKY = [
    "a@b.cd@e.fg x", "a@b.c_d@x.yz", "..@a-.b-.c.", "a@@b.c d@e.f.", "a@b a@b. a@.b", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 1.2.3", "x\u0001y@z.com 4\u00011",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 4111111111111111-", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 4111 1111-1111 1111 9", "+1 (017) 555-7713 +1555 +44 20 7946 0958. +123456789012345678",
    "+1+2+3456789012 é😀a@b.io", "a" * 20000, "1 " * 20000, "a.b." * 5000 + "@x." + "y." * 5000 + "z", "9" * 30000, "+1" + " " * 20000, None, "",
]


def test_base_spans_equal_plain_regular_expressions(spark, docs):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text"))
    texts = dict(df.collect())
    for r in pii.detect(df).select("doc_id", pii.written_spans(pii.F.col("base")).alias("b")).collect():
        assert r.b == plain(texts[r.doc_id]), (r.doc_id, r.b)


def test_terms_that_disclose_are_found_and_replaced(spark):
    rows = [(i, f"line {x} of {x * 7} Wolfgang writes to boss@corp.com about {x}th") for i, x in enumerate(["red", "blue", "green", "grey"])]
    rows += [(i, f"line number {i} says nothing of it") for i in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.detect(df).collect()}
    assert any(s.v == "remove" and rows[0][1][s.s : s.e] == "Wolfgang" for s in spans[0])
    assert not any(rows[0][1][s.s : s.e] in ("line", "red") for s in spans[0]) and spans[10] == []
    texts = dict(pii.sanitise(df).select("doc_id", "text").collect())
    assert "Wolfgang" not in texts[0] and "<EMAIL>" in texts[0] and texts[10] == rows[4][1]


def test_copies_prove_nothing(spark):
    rows = [(i, "Wolfgang writes to boss@corp.com") for i in range(20)] + [(i, "other words") for i in range(20, 300)]
    assert all(len(r.spans) <= 1 for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_odd_rows(odd, empty):
    assert pii.detect(empty).count() == 0 and pii.detect(odd).count() == odd.count()
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd.collect()))


def test_query(spark):
    got = queries.op6_sanitise(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.base_sha256 == hashlib.sha256(",".join(x for x in r.spans.split(",") if not x.startswith("term")).encode()).hexdigest() for r in got)


def test_disclosure_equals_plain_counting(spark):
    """Different texts, whole contexts and near terms counted one by one; copies of a text change nothing."""
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(["red", "green", "blue", "stone", "river", "cloud", "table"]) for _ in range(n))
    texts = [f"{some(3)} anna {['x@y.org', 'b@c.de'][i % 2]} {['smith', 'jones'][i % 2]} {some(4)} {i}" for i in range(12)] + [some(9) for _ in range(20)]
    texts += texts[:5] + texts[14:22]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    different = sorted(set(texts))
    n_t, n_e, n_te, around = Counter(), Counter(), {}, {}
    for t in different:
        n_t.update(set(re.findall(r"[^\W\d_]{3,}", t.lower())))
        for m in re.finditer(r"[a-z]@[a-z]\.[a-z]+", t):
            n_e[m[0]] += 1
            for w in re.finditer(r"[^\W\d_]{3,}", t):
                gap = m.start() - w.end() if w.end() <= m.start() else w.start() - m.end() if w.start() >= m.end() else None
                if gap is not None and gap < pii.REACH:
                    n_te.setdefault((m[0], w[0].lower()), set()).add(t)
                    around.setdefault((m[0], w[0].lower()), set()).add(t[max(0, m.start() - pii.REACH) : m.end() + pii.REACH])
    N, want = len(different), {}
    for (e, w), ts in n_te.items():
        if len(around[e, w]) >= 3:
            share = math.log2(len(ts) * N / (n_t[w] * n_e[e])) / math.log2(N / n_e[e])
            if share >= 0.2:
                want[e, w] = round(share, 9)
    rows = pii._hashed(docs, "text")
    found = pii._found_table(rows)
    got = {(r.v, r.term): round(r.disclosure, 9) for r in pii.disclosing(docs, found, "text", 3, 0.2, 0.9).collect()}
    assert got == want and {("x@y.org", "smith"), ("b@c.de", "jones")} <= set(got)
