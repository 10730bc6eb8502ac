"""Types, companies, topics and keywords of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# File-name patterns and their company, in order; the first that occurs decides.
COMPANY_RULES = [("hp", "HP"), ("printer", "HP"), ("router", "NETGEAR"), ("netgear", "NETGEAR"), ("kb.netgear", "NETGEAR"), ("samsung", "Samsung"), ("galaxy", "Samsung"), ("apple", "Apple"), ("iphone", "Apple"), ("macbook", "Apple"), ("sony", "Sony"), ("playstation", "Sony"), ("dell", "Dell"), ("usermanual", "Generic"), ("manual", "Generic"), ("sample_manual", "Generic")]
# Company names looked for in file names and in the first 1000 characters, in order.
KNOWN_COMPANIES = [
    "HP", "Hewlett Packard", "Cisco", "Reliance", "Google", "Microsoft", "Apple", "Samsung", "HSBC", "IBM", "Intel", "NVIDIA", "AMD", "Dell", "Lenovo",
    "Oracle", "SAP", "Salesforce", "Adobe", "VMware", "McAfee", "Symantec", "Juniper", "Aruba", "Palo Alto", "Fortinet", "Check Point", "AWS", "Azure",
    "Tesla", "Toyota", "Ford", "General Motors", "Volkswagen", "BMW", "Mercedes", "JPMorgan", "Goldman Sachs", "Morgan Stanley", "Bank of America", "Citigroup",
    "Walmart", "Target", "Amazon", "Costco", "Home Depot", "Nestle", "Coca-Cola", "PepsiCo", "Unilever", "Procter Gamble", "Johnson Johnson", "Pfizer", "Merck",
    "Netflix", "Disney", "Warner", "Sony", "Meta", "Twitter", "LinkedIn", "Uber", "Airbnb", "Spotify", "Slack", "Zoom", "Atlassian", "Shopify", "Square",
]
# Topics and the words of a file name that name them, in order.
TOPIC_RULES = {
    "TechDocs": ["manual", "guide", "user guide", "reference", "documentation", "techdoc", "technical"],
    "Books": ["book", "textbook", "paper", "article", "journal"],
    "Academic": ["academic", "research", "thesis", "dissertation", "conference", "paper", "arxiv", "preprint"],
    "Government": ["government", "policy", "regulation", "law", "legislation", "bill", "official"],
    "Financial": ["financial", "bank", "investment", "stock", "market", "fund", "account", "finance"],
    "Office": ["office", "meeting", "email", "memo", "report", "presentation", "slide"],
    "Email": ["email", "mail", "message", "correspondence"],
    "Images": ["image", "photo", "picture", "scan", "graphic"],
    "Data": ["data", "database", "spreadsheet", "table", "csv", "excel"],
    "Demo": ["demo", "example", "sample", "tutorial"],
}
# Words that are no keywords, and words of the trade that are.
STOPWORDS = [
    "the", "and", "for", "are", "you", "your", "this", "that", "with", "from", "into", "onto", "over", "under", "through", "between", "among", "without",
    "within", "upon", "than", "but", "or", "so", "yet", "because", "while", "if", "when", "though", "although", "unless", "until", "since", "as",
]
# More words that open a sentence without being its subject.
OPENERS = [
    "which", "who", "whom", "whose", "what", "where", "why", "how", "is", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought", "used", "to", "of", "in", "on", "at", "by", "during",
    "before", "after", "above", "below", "again", "further", "then", "once", "here", "there", "all", "each", "few", "more", "most", "other", "some", "such",
    "no", "nor", "not", "only", "own", "same", "too", "very", "just", "these", "those", "i", "he", "she", "it", "we", "they",
]
DOMAIN_WORDS = [
    "printer", "scanner", "document", "network", "wireless", "usb", "wi-fi", "ethernet", "software", "driver", "settings", "paper", "cartridge",
    "ink", "toner", "control", "panel", "display", "button", "menu", "option", "feature", "function", "system", "device", "installation", "setup",
    "configuration", "connection", "interface", "memory", "storage", "data", "file", "folder", "image", "text", "table", "page", "format", "size",
    "quality", "speed", "performance", "support", "help", "guide", "manual", "troubleshoot", "error", "problem", "solution", "warning", "caution",
    "note",
]

_NUMBERED = r"(?:^|\n)[\s*•\-]*\d+\."


def knowledge_type(title: Column, content: Column) -> Column:
    """sop_step, faq, manual_section or general; the first rule that holds decides."""
    steps = F.size(F.regexp_extract_all(content, F.lit(_NUMBERED), F.lit(0)))
    # the title is put in order and the steps are counted once a text, not once for each word that is looked for
    return T.bound(F.struct(T.strip(F.lower(F.replace(title, F.lit("*"), F.lit("")))).alias("title"), steps.alias("steps")), _type_of)


def _type_of(x: Column) -> Column:
    t, steps = x["title"], x["steps"]
    return (
        F.when(t.startswith("to ") & (steps >= 1), "sop_step")
        .when(_any(t, ("step", "procedure", "process", "instruction")), "sop_step")
        .when(steps >= 3, "sop_step")
        .when(_any(t, ("how to",)), F.when(steps >= 1, "sop_step").otherwise("faq"))
        .when(_any(t, ("?", "what is", "what are", "what does", "why ", "when ", "q:", "q&a", "faq", "frequently asked")), "faq")
        .when(_any(t, ("chapter", "section", "overview", "introduction", "specification")), "manual_section")
        .otherwise("general")
    )


def _any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def words_type(title: Column, content: Column) -> Column:
    """struct(type, confidence) by substrings, for when no model answers."""
    t, body = F.lower(title), F.lower(content)
    of = lambda kind, p: F.struct(F.lit(kind).alias("type"), F.lit(p).alias("confidence"))
    return (
        F.when(_any(t, ("how", "what", "why", "when", "where", "can", "is", "do")), of("faq", 0.6))
        .when(_any(body, ("step", "procedure", "follow", "first", "then", "next")), of("sop_step", 0.6))
        .when(_any(t, ("chapter", "section", "introduction", "overview")), of("manual_section", 0.6))
        .otherwise(of("general", 0.5))
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(priority, pattern, value); patterns that occur twice keep their first place."""
    return spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(rules)], "priority int, pattern string, value string")


def first_match(df: DataFrame, text: Column, rules: DataFrame, out: str, default: str | None = None, most_rules: int = 10_000) -> DataFrame:
    """df with the value of the first rule whose pattern occurs in the text, else the default.

    Rule tables are small by nature; up to most_rules they become one expression (a scan of an array for each row, nothing
    joined or grouped). A larger table is refused rather than joined pair by pair."""
    found = rules.orderBy("priority").limit(most_rules + 1).collect()
    if len(found) > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    table = F.array(*[F.struct(F.lit(r.pattern).alias("p"), F.lit(r.value).alias("v")) for r in found]) if found else F.expr("array_repeat(named_struct('p', '', 'v', ''), 0)")
    hit = F.try_element_at(F.filter(table, lambda r: F.contains(text, r["p"])), F.lit(1))
    return df.withColumn(out, F.coalesce(hit["v"], F.lit(default)))


def infer_company(df: DataFrame, source: str, out: str = "company", rules=COMPANY_RULES, default: str | None = "Unknown") -> DataFrame:
    return first_match(df, F.lower(F.coalesce(F.col(source), F.lit(""))), rule_table(df.sparkSession, rules), out, default)


def detect_company(df: DataFrame, filename: str, content: str, out: str = "company", names=KNOWN_COMPANIES) -> DataFrame:
    """By file name first, then by the first 1000 characters."""
    rules = rule_table(df.sparkSession, [(n.lower(), n) for n in names])
    df = first_match(df, F.lower(F.coalesce(F.col(filename), F.lit(""))), rules, "_by_name")
    df = first_match(df, F.lower(F.substring(F.coalesce(F.col(content), F.lit("")), 1, 1000)), rules, "_by_text")
    return df.withColumn(out, F.coalesce("_by_name", "_by_text")).drop("_by_name", "_by_text")


def detect_topic(df: DataFrame, filename: str, out: str = "topic") -> DataFrame:
    return first_match(df, F.lower(F.coalesce(F.col(filename), F.lit(""))), rule_table(df.sparkSession, [(w, t) for t, ws in TOPIC_RULES.items() for w in ws]), out)


def resolve_labels(files: DataFrame, entries: DataFrame, company: str | None = None, topic: str | None = None) -> DataFrame:
    """files (filename) with company and topic: of the file's first labelled entry (filename, seq, company, topic), else by the
    file name, else the given default; files that still lack one are left out."""
    blank = lambda c: F.when(F.trim(c) != "", F.col(c))
    own = entries.groupBy("filename").agg(F.min_by(blank("company"), F.when(blank("company").isNotNull(), F.col("seq"))).alias("c0"), F.min_by(blank("topic"), F.when(blank("topic").isNotNull(), F.col("seq"))).alias("t0"))
    rows = detect_topic(detect_company(files.withColumn("_none", F.lit("")), "filename", "_none", "c1"), "filename", "t1").join(own, "filename", "left")
    rows = rows.withColumn("company", F.coalesce("c0", "c1", F.lit(company))).withColumn("topic", F.coalesce("t0", "t1", F.lit(topic)))
    return rows.drop("c0", "t0", "c1", "t1", "_none").where("company is not null and topic is not null")




def _by_first_letter(words: list[str]) -> str:
    """A pattern of the words that tries a letter for all words that begin with it."""
    of: dict[str, list[str]] = {}
    for w in words:
        of.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in of.items())


# Kinds of keywords in their order: the pattern and the group that holds the word, how many of a kind count, and whether
# they count once each, may open a sentence, and are put in lower case.
KEYWORD_KINDS = [
    (r"\b[A-Z]{3,}\b", 0, 4, "once"),
    (r"(?:^|\n|\.\s|:\s)([A-Z][a-zA-Z]{2,})", 1, 4, "no opening"),
    (r"(?i)\b(?:Step|Phase|Chapter|Section)\s+\d+\b", 0, 2, ""),
    ('"([^"]{3,30})"', 1, 2, ""),
    (r"(?i)\b(?:" + _by_first_letter(DOMAIN_WORDS) + r")\b", 0, 3, "lower"),
]
KEYWORD_BREAKS = r"[<>{}\[\]\\|]"


def keywords(text: Column, most: int = 8) -> Column:
    """Words of KEYWORD_KINDS, kind by kind and in order of appearance; equal words (case ignored) once; three characters at least."""
    stop, opening = F.array(*map(F.lit, STOPWORDS)), F.array(*map(F.lit, STOPWORDS + OPENERS))
    does = {"": lambda x: x, "once": F.array_distinct, "no opening": lambda x: F.filter(x, lambda w: ~F.array_contains(opening, F.lower(w))), "lower": lambda x: F.transform(x, F.lower)}

    def every(plain: Column) -> Column:
        kinds = [F.slice(does[how](F.regexp_extract_all(plain, F.lit(pattern), F.lit(group))), 1, n) for pattern, group, n, how in KEYWORD_KINDS]
        return F.filter(F.transform(F.concat(*kinds), lambda w: F.trim(w)), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, F.lower(w)))

    def once(found: Column) -> Column:
        return T.bound(F.transform(found, F.lower), lambda low: F.filter(found, lambda w, i: F.array_position(low, F.lower(w)) == i + 1))

    # the text's patterns are read once a text, not once for each word they give
    return F.slice(T.bound(T.bound(F.regexp_replace(text, KEYWORD_BREAKS, " "), every), once), 1, most)


def keyword_index(df: DataFrame, id_col: str, keywords_col: str) -> tuple[DataFrame, DataFrame]:
    """(entry by keyword, document frequency of each keyword)."""
    index = df.select(id_col, F.explode(F.array_distinct(keywords_col)).alias("keyword"))
    return index, index.groupBy("keyword").agg(F.count_distinct(id_col).alias("n_docs"))
