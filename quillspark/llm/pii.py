"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Patterns find the protected entities (e-mail and IP addresses, card and phone numbers). The corpus then tells which other terms
disclose them: for a term t near an entity e, pointwise mutual information log2(n(t,e) N / (n(t) n(e))) is what t reveals of
e, and log2(N / n(e)) all there is to reveal; their ratio is the disclosure. Terms over `remove` are removed and terms over
`generalise` are generalised, wherever they stand in a text with that entity. Terms are lower-cased maximal runs of three
letters or more; near means within REACH characters. N, n(t), n(e) and n(t, e) all count different texts, so copies of a text
change nothing, and a pair must stand in `support` different surroundings, so neither do copies of one passage.

Defined results. A null text is empty: no spans. Matches that fail their test (parts, digits, Luhn) are dropped without a
retry. Offsets are code points. Repeated rows each get their row; equal texts get equal spans. Spans of different kinds may
overlap; the sanitised text covers their union. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_join, written

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 48
_SPAN = "array<struct<k:int,s:int,e:int,v:string>>"
_TERM = r"\p{L}{3,}"
# A separator that stands between two characters of its run is first turned into \u0001, one for one, so that no pattern repeats
# a group (Java's matcher recurses for those) and offsets stay. A match can start only where its first run starts, or where the
# match before ended (\G): all other starts fail alike, and long runs would otherwise be scanned once for each character.
_DOTTED = (r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "[A-Za-z0-9._%+\u0001-]", "[A-Za-z0-9-]++\u0001[A-Za-z0-9\u0001-]++")
_EMAIL = f"(?:(?<!{_DOTTED[1]})|\\G){_DOTTED[1]}++@{_DOTTED[2]}"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_SPACED = r"(?<=[0-9])[\x20-](?=[0-9])"
_CARD = "[0-9][0-9\u0001]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def _found(text: Column, pattern: str, kind: int, hint: Column) -> Column:
    """Spans of all matches: the gaps between them give the offsets."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["0"])
        e = s + F.length(x["1"])
        return F.struct(e.alias("at"), F.array_append(acc["out"], F.struct(F.lit(kind).alias("k"), s.alias("s"), e.alias("e"), x["1"].alias("v"))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("0"), hits.alias("1"))
    return F.when(hint, F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e, v>> by kind (its place in KINDS), then start."""
    plain = F.translate(text, "\u0001", "\u0002")
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    some_digit = text.rlike("[0-9]")
    email = _found(F.regexp_replace(plain, _DOTTED[0], "\u0001"), _EMAIL, 0, F.contains(text, F.lit("@")))
    email = F.transform(email, lambda x: x.withField("v", F.translate(x["v"], "\u0001", ".")))
    ip = F.filter(_found(plain, _IP, 1, some_digit), lambda x: F.forall(F.split(x["v"], r"\."), lambda p: p.rlike(_PARTS)))
    card = F.transform(_found(F.regexp_replace(plain, _SPACED, "\u0001"), _CARD, 2, some_digit), lambda x: x.withField("v", F.replace(x["v"], F.lit("\u0001"), F.lit(""))))
    card = F.filter(card, lambda x: F.length(x["v"]).between(13, 19) & F.coalesce(F.call_function("luhn_check", x["v"]), F.lit(False)))
    phone = F.filter(_found(plain, _PHONE, 3, F.contains(text, F.lit("+"))), lambda x: F.length(digits(x["v"])).between(9, 15))
    phone = F.transform(phone, lambda x: x.withField("v", digits(x["v"])))
    return F.concat(email, ip, card, phone)


def _terms(texts: DataFrame) -> DataFrame:
    """(h, term, s, e): each term of texts (h, t) with its place."""
    cut = texts.select("h", F.posexplode(F.split("t", rf"(?<=\P{{L}})(?=\p{{L}})|(?<=\p{{L}})(?=\P{{L}})")).alias("i", "w"))
    end = F.sum(F.length("w")).over(Window.partitionBy("h").orderBy("i"))
    return cut.withColumn("e", end.cast("int")).where(F.col("w").rlike(f"^{_TERM}")).select("h", F.lower("w").alias("term"), (F.col("e") - F.length("w")).alias("s"), "e")


def _entities(found: DataFrame) -> DataFrame:
    """(h, k, v, s, e) of texts (h, base), different texts only."""
    return found.select("h", F.explode("base").alias("x")).select("h", "x.k", "x.v", "x.s", "x.e")


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text", support: int = 3, generalise: float = 0.75, remove: float = 0.9) -> DataFrame:
    """(k, v, term, disclosure, action) from all texts and from `found`, the different texts with entities: (h, t, base)."""
    spans = _entities(found)
    near = written(_near(found, spans), "pii-near")
    pairs = near.groupBy("k", "v", "term").agg(F.count_distinct("h").alias("n_te"), F.count_distinct("around").alias("n_around")).where(F.col("n_around") >= support)
    n_e = spans.groupBy("k", "v").agg(F.count_distinct("h").alias("n_e"))
    t = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    copies = written(t.groupBy("h").agg(F.count(F.lit(1)).alias("c")), "pii-copies")
    n = copies.count()
    # each of c equal texts counts for 1 / c of one
    rows = sized_join(t, copies.where("c > 1"), ["h"], max_rows=1_000_000).withColumn("share", 1 / F.coalesce("c", F.lit(1)))
    words = rows.select("share", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_TERM), F.lit(0)))).alias("term"))
    n_t = words.groupBy("term").agg(F.round(F.sum("share")).alias("n_t"))
    rows = pairs.join(n_e, ["k", "v"]).join(n_t, "term")
    bits = F.log2(F.lit(float(max(2, n))) / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * F.lit(float(max(2, n))) / (F.col("n_t") * F.col("n_e")))
    rows = rows.withColumn("disclosure", F.when(bits > 0, pmi / bits).otherwise(F.lit(0.0))).where(F.col("disclosure") >= generalise)
    return rows.select("k", "v", "term", "disclosure", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise").alias("action"))


def _near(found: DataFrame, spans: DataFrame) -> DataFrame:
    """(k, v, term, h, around): terms within REACH of an entity; around is the hash of its surroundings."""
    context = F.xxhash64(F.substring(F.col("t"), F.greatest(F.lit(1), F.col("x.s") - REACH + 1), F.col("x.e") - F.col("x.s") + 2 * REACH))
    rows = found.select("h", "t", F.explode("base").alias("x")).select("h", "x.k", "x.v", "x.s", "x.e", context.alias("around"))
    reach = rows.withColumn("cell", F.explode(F.sequence(F.floor((F.col("s") - REACH) / REACH), F.floor((F.col("e") + REACH) / REACH))))
    terms = _terms(found).withColumn("cell", F.floor(F.col("s") / REACH)).withColumnsRenamed({"s": "ts", "e": "te"})
    both = terms.join(reach, ["h", "cell"]).where("te <= s and s - te < %d or ts >= e and ts - e < %d" % (REACH, REACH))
    return both.select("k", "v", "term", "h", "around").distinct()


def term_spans(found: DataFrame, told: DataFrame) -> DataFrame:
    """(h, terms): spans of the disclosing terms of each text, by start; v is the action."""
    wanted = _entities(found).select("h", "k", "v").distinct().join(told, ["k", "v"]).groupBy("h", "term").agg(F.max("action").alias("v"))
    texts = found.join(wanted.select("h").distinct(), "h", "left_semi")
    at = _terms(texts).join(wanted, ["h", "term"])
    return at.groupBy("h").agg(F.array_sort(F.collect_list(F.struct(F.lit(4).alias("k"), "s", "e", "v"))).alias("terms"))


def _hashed(docs: DataFrame, text_col: str) -> DataFrame:
    """docs whole as _row, with t, base and, for texts with entities, h."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), t.alias("t")).withColumn("base", base_spans(F.col("t")))
    return rows.withColumn("h", F.when(F.size("base") > 0, F.md5("t")))


def _found_table(rows: DataFrame) -> DataFrame:
    return rows.where("h is not null").select("h", "t", "base").dropDuplicates(["h"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """(doc_id, base, spans) of every row: base entities, and these with the disclosing terms."""
    rows = _hashed(docs, text_col)
    kept = written(rows.select(F.col("_row")[id_col].cast("long").alias("doc_id"), "base", "h", F.when(F.col("h").isNotNull(), F.col("t")).alias("t")), "pii")
    found = written(_found_table(kept), "pii-texts")
    told = written(disclosing(docs, found, text_col, **limits), "pii-terms")
    spans = term_spans(found, told)
    out = kept.where("h is not null").join(spans, "h", "left").select("doc_id", "base", F.concat("base", F.coalesce("terms", F.array().cast(_SPAN))).alias("spans"))
    return kept.where("h is null").select("doc_id", "base", F.col("base").alias("spans")).unionByName(out)


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")


def replaced(text: Column, spans: Column) -> Column:
    """text with each span's kind in its place; removed terms leave nothing."""
    mark = lambda x: F.when(x["v"] == "remove", "").otherwise(F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), x["k"] + 1))
    mark_of = lambda x: F.when(x["k"] == 4, mark(x)).otherwise(F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), x["k"] + 1))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), mark_of(x).alias("m"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        free = x["s"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["m"])
        return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), F.when(free, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(ordered, start, step)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def sanitise(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """docs with all its columns and sanitised texts. Texts without an entity (null ones too) stay as they are."""
    rows = _hashed(docs, text_col)
    hit = written(rows.where("h is not null"), "pii-rows")
    found = written(_found_table(hit), "pii-texts")
    told = written(disclosing(docs, found, text_col, **limits), "pii-terms")
    spans = term_spans(found, told)
    out = hit.join(spans, "h", "left").withColumn("spans", F.concat("base", F.coalesce("terms", F.array().cast(_SPAN))))
    out = out.select(F.col("_row").withField(text_col, replaced(F.col("t"), F.col("spans"))).alias("_row")).select("_row.*")
    return rows.where("h is null").select("_row.*").unionByName(out)
