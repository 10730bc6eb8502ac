"""Column functions over one text: cleaning steps, predicates and element types. All run inside Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that open a bulleted line.
BULLETS = ["\u0095", "\u2022", "\u2023", "\u2043", "\u3164", "\u204c", "\u204d", "\u2219", "\u25cb", "\u25cf", "\u25d8", "\u25e6", "\u2619", "\u2765", "\u2767", "\u29be", "\u29bf", "\u002d", "\u2013", "\uf0b7", "*", "\u00b7"]
# Ligatures and what they stand for.
LIGATURES = {"æ": "ae", "Æ": "AE", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ʪ": "ls", "œ": "oe", "Œ": "OE", "ȹ": "qp", "ﬆ": "st", "ʦ": "ts"}
# Broken quotes and their repair, in the order they are applied (a rule can use up another's text).
QUOTE_REPAIRS = [
    ("\x91", "‘"), ("\x92", "’"), ("\x93", "“"), ("\x94", "”"), ("&apos;", "'"), ("â\x80\x99", "'"), ("â\x80“", "—"), ("â\x80”", "–"), ("â\x80˜", "‘"),
    ("â\x80¦", "…"), ("â\x80™", "’"), ("â\x80œ", "“"), ("â\x80?", "”"), ("â\x80ť", "”"), ("â\x80ś", "“"), ("â\x80¨", "—"), ("â\x80ł", "″"), ("â\x80Ž", ""),
    ("â\x80‚", ""), ("â\x80‰", ""), ("â\x80‹", ""), ("â\x80", ""),
]
# Code points read as a double or a single quote.
DOUBLE_QUOTES = "\u0022\u201c\u201d\u201e\u201f\u00ab\u00bb\u275d\u275e\u2e42\U0001f676\U0001f677\U0001f678\u2826\u2834\u301d\u301e\u301f\uff02"
SINGLE_QUOTES = "\u0027\u2018\u2019\u201a\u201b\u2039\u203a\u275b\u275c\u300c\u300d\u300e\u300f\ufe41\ufe42\ufe43\ufe44\uff07\uff62\uff63"
# Signs of an academic text, case ignored.
ACADEMIC = [r"\$\$.*?\$\$", r"\$\\mu\$", r"\\rho", r"\\frac\{", r"\\sum", r"\\int", r"\\sigma", r"\d+(\.\d+){2,}\s+", r"\b(Abstract|Introduction|Conclusion|References|Bibliography|Section|Chapter)\b", r"\b(FFP|FP|lambda|functional programming|metacomposition|cell|fetch)\b", r"<[A-Z]+,\s*[a-z]", r"\$\d+\$", r"\^\d+\^"]

# Names and codes of the states in an address line.
STATES = [
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware", "Florida", "Georgia", "Hawaii", "Idaho", "Illinois",
    "Indiana", "Iowa", "Kansas", "Kentucky", "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi", "Missouri", "Montana",
    "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico", "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon",
    "Pennsylvania", "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont", "Virginia", "Washington", "West Virginia",
    "Wisconsin", "Wyoming",
]
STATE_CODES = "AL|AK|AS|AZ|AR|CA|CO|CT|DE|DC|FM|FL|GA|GU|HI|ID|IL|IN|IA|KS|KY|LA|ME|MH|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|MP|OH|OK|OR|PW|PA|PR|RI|SC|SD|TN|TX|UT|VT|VI|VA|WA|WV|WI|WY"
#: An address line: up to five words, a comma, a state and a five-digit code.
CITY_STATE_ZIP = r"(?i)^(?:[a-z][a-z.-]{1,15} ?){1,5},\s?(?:" + "|".join(STATES) + "|" + STATE_CODES + r")(?:, |\s)?[0-9]{5}(?:-[0-9]{4})?\b"
# A phone number at the end of a text.
PHONE_AT_END = r"(?:\+?(\d{1,3}))?[-. (]*(\d{3})?[-. )]*(\d{3})[-. ]*(\d{4})(?: *x(\d+))?\s*$"
#: Verbs told by form: auxiliaries, and endings that few other words have (a part-of-speech tagger is not built).
VERB = r"(?i)\b(?:is|are|was|were|be|been|am|has|have|had|do|does|did|can|could|will|would|shall|should|may|might|must|[a-z]{2,}(?:ed|ing|ify|ize|ise))\b"

_CLASS = "[" + "".join("\\" + c if c in "-*" else c for c in BULLETS) + "]"


def strip(c: Column) -> Column:
    """White space of any kind off both ends (trim takes spaces only, unless told what to take)."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value made once: an expression that is named several times inside a lambda is otherwise made anew each time."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def drop_non_ascii(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def drop_bullet(c: Column) -> Column:
    """A leading bullet, if no second one follows it."""
    return F.when(c.rlike(f"^{_CLASS}(?!{_CLASS})"), strip(F.regexp_replace(c, f"^{_CLASS}", ""))).otherwise(c)


def drop_ordered_bullet(c: Column) -> Column:
    """A leading 1.1 or a.b; the rest is joined with single spaces. Empty text stays empty."""
    first = F.regexp_extract(c, r"^\s*(\S+)", 1)
    ordered = F.contains(first, F.lit(".")) & ~F.contains(first, F.lit("..")) & (F.length(F.substring_index(first, ".", 1)) <= 2)
    return F.when(ordered, F.array_join(F.slice(F.split(strip(c), r"\s+"), 2, 2**31 - 1), " ")).otherwise(c)


def expand_ligatures(c: Column) -> Column:
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def repair_quotes(c: Column) -> Column:
    for a, b in QUOTE_REPAIRS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def standard_quotes(c: Column) -> Column:
    return F.translate(c, DOUBLE_QUOTES + SINGLE_QUOTES, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES))


def drop_punctuation(c: Column, but: str = "") -> Column:
    """All punctuation but the given characters."""
    keep = "".join("\\" + x for x in but)
    return F.regexp_replace(c, rf"[\p{{P}}&&[^{keep}]]" if but else r"\p{P}", "")


def squeeze_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, "[\u00a0\n]", " "), " {2,}", " "))


def drop_dashes(c: Column) -> Column:
    return strip(F.translate(c, "-\u2013", "  "))


def drop_trailing_punctuation(c: Column) -> Column:
    return F.regexp_replace(strip(c), "[.,:;]+$", "")


def drop_prefix(c: Column, pattern: str, ignore_case: bool = False, strip_after: bool = True) -> Column:
    out = F.regexp_replace(c, f"{'(?i)' if ignore_case else ''}^(?:{pattern})[\\s:]*" if strip_after else f"^(?:{pattern})", "")
    return strip(out) if strip_after else out


def drop_postfix(c: Column, pattern: str, ignore_case: bool = False, strip_after: bool = True) -> Column:
    out = F.regexp_replace(c, f"{'(?i)' if ignore_case else ''}(?:{pattern})$", "")
    return strip(out) if strip_after else out


def strip_tags(c: Column) -> Column:
    """Scripts, styles and tags become a space each."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<script[^>]*>.*?</script>", " "), r"(?is)<style[^>]*>.*?</style>", " "), r"<[^>]+>", " ")


# Where a stray # stands for a mu, and what the place becomes, in the order the rules are applied. (Rules for #(x:y) and
# #(<...>) have nothing left to match once any #( is replaced.)
MU_PLACES = [(r"\\#", "{mu}"), (r"#\s*\(", "{mu}("), (r"(?i)#([a-z])\s*=", "{mu}$1 ="), (r"#\s*<", "{mu}<"), (r"(?i)(p)#([a-z])", "$1{mu}$2")]


def repair_math(c: Column) -> Column:
    """A stray # before a bracket or a variable is a mu."""
    for pattern, to in MU_PLACES:
        c = F.regexp_replace(c, pattern, to.replace("{mu}", r"\$\\mu\$"))
    return c


def regroup_paragraphs(c: Column) -> Column:
    """Lines of a paragraph joined; paragraphs (blank-line separated) whose lines all have under five words keep their lines;
    bulleted paragraphs keep a line for each bullet. Paragraphs are parted by a blank line."""

    def one(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, r"\n"), strip), lambda x: x != "")
        short = F.forall(lines, lambda x: F.size(F.split(x, " ")) < 5)
        bulleted = strip(p).rlike(f"^{_CLASS}")
        items = F.filter(F.transform(F.split(p, rf"\n(?=\s*{_CLASS})"), lambda x: strip(F.regexp_replace(x, r"\s*\n\s*", " "))), lambda x: x != "")
        return F.when(bulleted, items).when(short, lines).otherwise(F.array(F.regexp_replace(strip(p), r"\s*\n\s*", " ")))

    parts = F.filter(F.split(c, r"(?:\s*\n\s*){2,}"), lambda p: strip(p) != "")
    return F.array_join(F.flatten(F.transform(parts, one)), "\n\n")


def auto_regroup(c: Column, most_lines: int = 2000, threshold: float = 0.1, grouper: Callable[[Column], Column] = regroup_paragraphs) -> Column:
    """Texts with few blank lines have one paragraph a line; the others are regrouped, by the user's own function if one is given."""
    lines = F.slice(F.split(c, r"\n"), 1, most_lines)
    blank = F.size(F.filter(lines, lambda x: strip(x) == ""))
    apart = F.array_join(F.filter(F.split(c, r"\n"), lambda x: strip(x) != ""), "\n\n")
    return F.when(blank / F.size(lines) < threshold, apart).otherwise(grouper(c))


#: Cleaning steps by name, for clean_corpus().
STEPS: dict[str, Callable[[Column], Column]] = {
    "lower": F.lower,
    "non_ascii": drop_non_ascii,
    "bullet": drop_bullet,
    "ordered_bullet": drop_ordered_bullet,
    "ligatures": expand_ligatures,
    "unicode_quotes": repair_quotes,
    "quotes": standard_quotes,
    "punctuation": drop_punctuation,
    "whitespace": squeeze_spaces,
    "dashes": drop_dashes,
    "trailing_punctuation": drop_trailing_punctuation,
    "paragraphs": auto_regroup,
    "tags": strip_tags,
    "strip": strip,
}


def text_before(c: Column, pattern: str, n: int = 0) -> Column:
    """Text before the n-th match (from 0), white space off its end; null without such a match."""
    hits, gaps = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(0)), F.split(c, pattern, -1)
    parts = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.concat(F.when(i > 0, F.try_element_at(hits, i)).otherwise(F.lit("")), F.try_element_at(gaps, i + 1)))
    return F.when(F.size(hits) > n, F.regexp_replace(F.array_join(parts, ""), r"\s+$", ""))


def text_after(c: Column, pattern: str, n: int = 0) -> Column:
    """Text after the n-th match (from 0), white space off its start; null without such a match."""
    hits, gaps = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(0)), F.split(c, pattern, -1)
    at = F.sequence(F.lit(n + 1), F.size(hits))
    parts = F.transform(at, lambda i: F.concat(F.try_element_at(gaps, i + 1), F.coalesce(F.try_element_at(hits, i + 1), F.lit(""))))
    return F.when(F.size(hits) > n, F.regexp_replace(F.array_join(parts, ""), r"^\s+", ""))


def ordered_bullet_parts(c: Column) -> Column:
    """struct(section, sub, subsub) of a leading 1.2.3; all null where the first word is no ordered bullet."""
    first = F.regexp_extract(c, r"^\s*(\S+)", 1)
    parts = F.filter(F.split(first, r"\."), lambda x: x != "")
    ok = F.contains(first, F.lit(".")) & ~F.contains(first, F.lit("..")) & (F.length(F.substring_index(first, ".", 1)) <= 2)
    return F.struct(*[F.when(ok, F.try_element_at(parts, F.lit(i + 1))).alias(n) for i, n in enumerate(("section", "sub", "subsub"))])


def academic_score(c: Column) -> Column:
    out = F.lit(0)
    for p in ACADEMIC:
        out = out + c.rlike("(?i)" + p).cast("int")
    return out


def is_academic(c: Column) -> Column:
    return academic_score(c) >= 2


def is_junk(c: Column) -> Column:
    """Image references, short captions, and anything under 15 characters that is no table row."""

    def junk(p: Column) -> Column:
        caption = (F.length(p) < 80) & p.rlike(r"^\*?\*?(Figure|Table)\s+\d+.*?\*?\*$")
        return ((F.length(p) < 15) & ~F.contains(p, F.lit("|"))) | caption | p.rlike(r"^!\[.*?\]\(.*?\)$")

    return bound(strip(c), junk)


def _share(c: Column, kept: str, of: Column | None = None) -> Column:
    n = F.length(c) if of is None else of
    return F.length(F.regexp_replace(c, kept, "")) / F.greatest(F.lit(1), n)


def without_garble(c: Column, least: float = 0.6) -> Column:
    """Blank if under `least` of it is printable; else without control characters."""
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
    return F.when(_share(c, r"[^\x20-\x7e\n\r\t\p{L}\p{N}\p{P}]+") < least, F.lit("")).otherwise(F.regexp_replace(c, control, ""))


def mostly_letters(c: Column, least: float = 0.3) -> Column:
    return _share(c, r"\P{L}+") >= least


def under_non_alpha(c: Column, threshold: float = 0.5) -> Column:
    """Letters are under the threshold among what is not white space; false for blank text."""
    solid = F.length(F.regexp_replace(c, r"\s+", ""))
    return F.when(solid == 0, F.lit(False)).otherwise(_share(c, r"\P{L}+", solid) < threshold)


def is_numbered(c: Column) -> Column:
    return c.rlike(r"^\d+(\.|\))\s(.+)")


def is_bulleted(c: Column) -> Column:
    return c.rlike(f"^{_CLASS}")


def is_email(c: Column) -> Column:
    return c.rlike(r"^[a-z0-9.+_-]+@[a-z0-9.+_-]+\.[a-z]+$")


def sentence_count(c: Column, least_words: int = 5) -> Column:
    """Sentences of at least so many words."""
    return F.size(F.filter(F.split(strip(c), r"(?<=[.!?])\s+"), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= least_words))


def exceeds_cap_ratio(c: Column, threshold: float = 0.5) -> Column:
    # strings are ordered by their bytes, so two comparisons tell what a word begins with
    capital, small = lambda w: (w >= "A") & (w < "["), lambda w: (w >= "a") & (w < "{")
    share = lambda words: F.size(F.filter(words, capital)) / F.greatest(F.lit(1), F.size(words))
    return bound(F.filter(F.split(c, r"\s+"), lambda w: capital(w) | small(w)), share) > threshold


def is_title(c: Column, most_words: int = 12) -> Column:
    """Short, not all of digits, no trailing comma, at most one real sentence, enough letters."""
    t = strip(c)
    return (t != "") & (F.size(F.split(t, " ")) <= most_words) & ~under_non_alpha(t) & ~t.rlike(",$") & ~t.rlike(r"^\d+$") & (sentence_count(t) <= 1) & ~t.rlike(r"^[A-Z][A-Z ]*[^A-Za-z0-9\s]$")


def is_narrative(c: Column) -> Column:
    """Enough letters, not mostly capitalised, two real sentences (a part-of-speech test is not built)."""
    t = strip(c)
    return ~t.rlike(r"^\d+$") & (t != "") & ~exceeds_cap_ratio(t) & ~under_non_alpha(t) & (sentence_count(t) >= 2)


def is_city_state_zip(c: Column) -> Column:
    return strip(c).rlike(CITY_STATE_ZIP)


def has_phone(c: Column) -> Column:
    return strip(c).rlike(PHONE_AT_END)


def has_verb(c: Column) -> Column:
    return c.rlike(VERB)


def has_word_of(c: Column, words: list[str]) -> Column:
    """Whether one of the words (lower case) is in the text, punctuation off."""
    return F.arrays_overlap(F.split(drop_punctuation(F.lower(c)), r"\s+"), F.array(*map(F.lit, words)))


def page_part(top: Column, bottom: Column, height: Column, header: float = 0.07, footer: float = 0.93) -> Column:
    """Header or Footer for a block that lies in the margins of its page, else null."""
    return F.when(bottom / height <= header, "Header").when(top / height >= footer, "Footer")


def element_type(c: Column, part: Column | None = None) -> Column:
    """The type of a text block; the first test that holds decides. part: see page_part()."""
    first = F.when(F.lit(False), "") if part is None else F.when(part.isNotNull(), part)
    return first.when(is_bulleted(c), "ListItem").when(is_email(c), "EmailAddress").when(is_city_state_zip(c), "Address").when(is_numbered(c), "ListItem").when(is_narrative(c), "NarrativeText").when(is_title(c), "Title").otherwise("Text")


def store_text(title: Column, content: Column, keywords: Column) -> Column:
    part = lambda name, x: F.when(x != "", F.concat(F.lit(f"[{name}] "), x))
    return F.concat_ws("\n", part("Title", title), part("Content", content), part("Keywords", F.array_join(keywords, ", ")))


def display_text(c: Column, most: int = 800) -> Column:
    """What stands between [Content] and [Keywords]; else what follows a title line; tags off, cut at `most` characters."""
    content = F.element_at(F.split(F.substring(c, F.locate("[Content] ", c) + 10, 2**31 - 1), r"\[Keywords\]"), 1)
    titled = F.when(c.startswith("[Title] ") & F.contains(c, F.lit("\n")), F.substring(c, F.locate("\n", c) + 1, 2**31 - 1)).otherwise(c)
    return F.substring(strip(F.regexp_replace(F.when(F.contains(c, F.lit("[Content] ")), content).otherwise(titled), r"<[^>]+>", "")), 1, most)


def shortened(c: Column, most: int, to: int) -> Column:
    """Over `most` characters: the first `to` and three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, to), F.lit("..."))).otherwise(c)


def display_title(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(strip(title), F.lit("")) != "", title).otherwise(F.concat(F.substring(text, 1, 60), F.lit("...")))


def display_source(source: Column) -> Column:
    return shortened(source, 40, 37)


def approx_page(place: Column, total: Column, pages: int = 30) -> Column:
    return F.greatest(F.lit(1), F.floor(place / F.greatest(total, F.lit(1)) * pages)).cast("int")


# The patterns below are fixed values.
def promoted_heading(c: Column) -> Column:
    """A heading from the first 1000 characters, or the empty string."""
    p = F.substring(c, 1, 1000)
    some = lambda x: F.when(x != "", x)
    numbered = F.when(p.rlike(r"^\s*\d+(\.\d+){1,2}\s+.{3}"), F.concat_ws(" ", F.regexp_extract(p, r"^\s*(\d+(\.\d+){1,2})\s+(.{3,100})", 1), strip(F.regexp_extract(p, r"^\s*(\d+(\.\d+){1,2})\s+(.{3,100})", 3))))
    bold = some(strip(F.regexp_extract(p, r"^\s*\*\*([^*]{3,80})\*\*", 1)))
    item = F.when(p.rlike(r"^\s*[-*]\s*\d+\)\s+.{3}"), F.concat(F.regexp_extract(p, r"^\s*[-*]\s*(\d+)\)\s+(.{3,100})", 1), F.lit(") "), strip(F.regexp_extract(p, r"^\s*[-*]\s*(\d+)\)\s+(.{3,100})", 2))))
    upper = strip(F.regexp_extract(p, r"^\s*([A-Z][A-Z\s]{5,60})", 1))
    upper = F.when((F.length(upper) >= 5) & F.contains(upper, F.lit(" ")), upper)
    line = some(strip(F.regexp_extract(p, r"^\s*([^\n]{10,120})", 1)))
    return F.when(F.length(c) < 10, F.lit("")).otherwise(F.substring(F.coalesce(numbered, bold, item, upper, line, F.lit("")), 1, 100))


# Words of prose, signs of relations, and signs with their names in formulas.
FORMULA_PROSE = r"(?i)\b(was|were|using|calculated|where|respectively|determined|following)\b"
FORMULA_SIGNS = "[∈∉≤≥≠≈×÷∞∑∫√∂∇]"
FORMULA_NAMES = [("−", "-"), ("×", r"\times{}"), ("÷", r"\div{}"), ("∞", r"\infty{}"), ("∈", r"\in{}"), ("∉", r"\notin{}"), ("≤", r"\leq{}"), ("≥", r"\geq{}"), ("≈", r"\approx{}"), ("≠", r"\neq{}")]
# What speaks for a formula: a pattern, points a match, and the most points it gives.
FORMULA_POINTS = [
    (r"\\[a-zA-Z]+", 3, 3), (r"\^", 1, 1), (r"_(?:\{|[0-9A-Za-z])", 1, 1), (FORMULA_SIGNS, 2, 6), ("[¼½¾]", 1, 1),
    (r"(?<=[A-Za-z0-9)\]])\s*=\s*(?=[A-Za-z0-9(\\])", 1, 2), (r"(?<=[A-Za-z])\([^)]*\)\s*=\s*", 2, 2),
]


def formula_score(c: Column) -> Column:
    """How much a text looks like notation: points of FORMULA_POINTS."""
    score = F.lit(0)
    for pattern, each, most in FORMULA_POINTS:
        score = score + F.least(F.lit(most), each * F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))))
    return score


def formula_markdown(c: Column, style: str = "auto", names: bool = True) -> Column:
    """A formula in markdown: between $$ lines if its score says so (auto), always (display) or never (plain). Texts with a $ stay as they
    are; signs get their names only between $$."""
    if style not in ("auto", "display", "plain"):
        raise ValueError(style)
    raw = strip(c)
    body = raw
    for sign, name in FORMULA_NAMES if names else []:
        body = F.replace(body, F.lit(sign), F.lit(name))
    prose = (F.length(raw) >= 80) & raw.rlike(FORMULA_PROSE)
    wanted = {"plain": F.lit(False), "display": F.lit(True), "auto": formula_score(raw) >= F.when(prose, 3).otherwise(2)}[style]
    return F.when((raw == "") | F.contains(raw, F.lit("$")) | ~wanted, raw).otherwise(F.concat(F.lit("$$\n"), body, F.lit("\n$$")))
