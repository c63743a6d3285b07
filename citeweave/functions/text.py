"""Column functions on titles, authors, identifiers and sentences: all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOP_WORDS = ["a", "an", "the", "of", "and", "or", "for", "to", "in", "on", "with", "by"]
SURNAME_PREFIXES = ["van", "von", "de", "del", "della", "di", "da", "al", "el", "la", "le", "ben", "ibn", "mac", "mc", "o"]
NAME_SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]
VENUE_WORDS = r"\b(?:vol|volume|no|issue|pp|pages|proc|proceedings)\b"
TITLE_WORD = r"[a-zA-Z0-9]+(?:['\-][a-zA-Z0-9]+)*[?!]?"
PLAIN_WORD = r"[a-zA-Z0-9]+(?:['\-][a-zA-Z0-9]+)*"
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
ARXIV_PATTERNS = [
    r"(?i)arXiv[:\s]+(\d{4}\.\d{4,5}(?:v\d+)?)",
    r"(?i)arxiv\.org/abs/(\d{4}\.\d{4,5}(?:v\d+)?)",
    r"(?i)arXiv[:\s]+([a-z\-]+/\d{7}(?:v\d+)?)",
    r"\b(\d{4}\.\d{4,5}(?:v\d+)?)\b",
    r"(?i)\b([a-z\-]+/\d{7}(?:v\d+)?)\b",
]
def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def nonempty(c: Column) -> Column:
    """An empty string is no value."""
    return F.nullif(c, F.lit(""))


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


#: The names that HTML also knows without a semicolon, the longest first, from the standard's table.
BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


def drop_references(c: Column) -> Column:
    """A text whose HTML character references stand only for the ASCII characters among them; others are dropped.

    That is all that normalised titles and venues see of them. A name between & and ; is taken for a reference whether HTML knows it or not.
    """

    def one(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0)
        digits = F.regexp_extract(number, "([0-9a-fA-F]+);?$", 1)
        code = F.when(F.length(digits) > 7, F.lit(0)).when(number.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("int")).otherwise(digits.try_cast("int"))
        rest = F.substring(piece, F.length(number) + 1, F.length(piece))
        name = F.regexp_extract(piece, f"^(?:[A-Za-z][A-Za-z0-9]*;|{'|'.join(BARE)})", 0)
        return (
            F.when(number != "", F.concat(F.when(code.between(32, 126), F.char(code)).otherwise(""), rest)).when(name == "fjlig;", F.concat(F.lit("fj"), F.substring(piece, 7, F.length(piece))))
            .when(name != "", F.substring(piece, F.length(name) + 1, F.length(piece))).otherwise(F.concat(F.lit("&"), piece))
        )

    pieces = F.split(c, "&", -1)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(one(x))), "")).otherwise(c)


def normalize_title(c: Column, known: list[tuple[str, str]] | None = None) -> Column:
    """A title's ASCII letters and digits, lower case. known: the character references that its source writes, with their characters, in
    the order in which they are read; any other &, as of one that a cut title ends in, is text then. Without it all of HTML's are read."""
    text = _text(c)
    for reference, char in known or ():
        text = F.replace(text, F.lit(reference), F.lit(char))
    return F.regexp_replace(F.lower(drop_references(text) if known is None else text), "[^a-z0-9]+", "")


def normalize_venue(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(drop_references(_text(c))), VENUE_WORDS, " "), "[^a-z0-9]+", "")


def normalize_doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", ""), DOI_PREFIX, ""), "[.,;:]+$", ""))


def normalize_url(c: Column) -> Column:
    return F.lower(F.regexp_replace(normalize_space(c), "/+$", ""))


def normalize_text(c: Column) -> Column:
    return F.lower(normalize_space(c))


def title_words(c: Column, n: int) -> Column:
    """The first n significant words, or the first n of all if fewer than three are significant; as written."""
    words = F.regexp_extract_all(F.regexp_replace(_text(c), "[{}]", ""), F.lit(TITLE_WORD), F.lit(0))

    def significant(w: Column) -> Column:
        base = F.rtrim(w, F.lit("?!"))
        mixed = base.rlike("[a-zA-Z]") & base.rlike("[0-9]")
        return ~F.lower(base).isin(STOP_WORDS) & ((F.length(base) >= 3) | mixed)

    return let(words, lambda w: let(F.filter(w, significant), lambda some: F.slice(F.when(F.size(some) >= 3, some).otherwise(w), 1, n)))


def query_words(c: Column, n: int) -> Column:
    return F.transform(title_words(c, n), F.lower)


def plain_words(c: Column, n: int | None = 12) -> Column:
    """The first n words, or all of them."""
    words = F.regexp_extract_all(_text(c), F.lit(PLAIN_WORD), F.lit(0))
    return F.transform(words if n is None else F.slice(words, 1, n), F.lower)


def build_query_words(title: Column, raw: Column, n: int = 8) -> Column:
    """The title's words; the raw citation's where the title is blank."""
    return query_words(F.coalesce(nonempty(normalize_space(title)), normalize_space(raw)), n)


def extract_arxiv_id(c: Column) -> Column:
    """The first pattern that is found; a version suffix stays."""
    return F.coalesce(*(nonempty(F.regexp_extract(_text(c), p, 1)) for p in ARXIV_PATTERNS))


def extract_doi_in_link(c: Column) -> Column:
    """A catalog's link: its DOI, or an empty string."""
    stripped = F.regexp_replace(normalize_space(c), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    return normalize_doi(F.regexp_extract(stripped, r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1))


def extract_year(c: Column) -> Column:
    return F.regexp_extract(_text(c), r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int")


def year_of_text(c: Column) -> Column:
    """Digits only, else null."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def leading_int(c: Column) -> Column:
    """The digits a text begins with as a number, 0 without any."""
    return F.coalesce(F.regexp_extract(_text(c), r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


def split_authors(c: Column) -> Column:
    return F.filter(F.transform(F.split(_text(c), ";"), normalize_space), lambda x: x != "")


def parse_authors_loose(c: Column) -> Column:
    """Split at `;`, else at and or &, else at commas."""
    c = normalize_space(c)
    joined = F.when(c.contains(";"), c).when(F.lower(c).contains(" and "), F.regexp_replace(c, r"(?i)\s+(and|&)\s+", ";")).otherwise(F.replace(c, F.lit(","), F.lit(";")))
    return split_authors(joined)


def author_key(name: Column) -> Column:
    """First initial and surname, lower case. A name with a comma begins with the surname."""
    suffix = "(?i)( (?:" + "|".join(NAME_SUFFIXES) + r")\.*)+$"

    def comma(name: Column) -> Column:
        first = F.lower(F.substring(F.trim(F.regexp_replace(name, "^[^,]*,", "")), 1, 1))
        return F.trim(F.concat(first, F.lit(" "), F.lower(F.trim(F.substring_index(name, ",", 1)))))

    def surname(parts: Column) -> Column:
        n = F.size(parts)

        def prefix(back: int) -> Column:
            return F.rtrim(F.lower(F.get(parts, n - back)), F.lit(".")).isin(SURNAME_PREFIXES)

        take = F.when((n >= 3) & prefix(3), 3).when((n >= 2) & prefix(2), 2).otherwise(1)
        return let(take, lambda k: F.lower(F.array_join(F.slice(parts, n - k + 1, k), " ")))

    def key(name: Column) -> Column:
        plain = F.concat(F.lower(F.substring(name, 1, 1)), F.lit(" "), let(F.split(F.regexp_replace(name, suffix, ""), " "), surname))
        return F.when(name == "", "").when(name.contains(","), comma(name)).otherwise(plain)

    return let(normalize_space(name), key)


def _share(a: Column, b: Column) -> Column:
    return let(a, lambda x: F.when((F.size(x) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(x, b)) / F.size(x)))


def author_keys(names: Column) -> Column:
    """The distinct keys of names, sorted; none of a null."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(names, author_key), lambda k: k != ""))), F.array().cast("array<string>"))


def author_overlap(ref: Column, cand: Column) -> Column:
    """Share of the reference's author keys that the candidate has; 0 if either has none."""
    a, b = (F.array_distinct(F.filter(F.transform(x, author_key), lambda k: k != "")) for x in (ref, cand))
    return let(b, lambda y: _share(a, y))


def overlap_ratio(a: Column, b: Column) -> Column:
    """|A and B| / |A| of two word lists; 0 if either is empty."""
    return let(b, lambda y: _share(F.array_distinct(a), y))


def split_sentences(c: Column) -> Column:
    """No sentence has white space at its ends. The seams become line breaks, which a text of normal space has none of: split would compile a longer pattern for each row."""
    marked = F.regexp_replace(normalize_space(c), r"(?<=[.!?]) (?=[A-Z\[])|(?<=\]) (?=[A-Z])", "\n")
    return F.array_remove(F.split(marked, "\n"), "")


def split_sections(c: Column) -> Column:
    """(body, references) at the first heading line of a reference list."""
    heading = r"(?im)^\s*(?:references|bibliography|works cited)\s*$"
    at = F.regexp_instr(_text(c), F.lit(heading))
    whole = _text(c)
    return F.struct(
        F.trim(F.when(at > 0, F.substring(whole, F.lit(1), at - 1)).otherwise(whole)).alias("body"),
        F.trim(F.when(at > 0, F.substring(whole, at, F.length(whole))).otherwise("")).alias("refs"),
    )


def citation_ids(sentence: Column) -> Column:
    """Sorted distinct numbers of all markers such as [1, 3-5]."""
    inner = F.array_join(F.regexp_extract_all(_text(sentence), F.lit(r"\[([0-9,\-–—\s]+)\]"), F.lit(1)), ",")
    tokens = F.regexp_extract_all(F.translate(inner, "–—", "--"), F.lit(r"(?:^|(?<=,))\s*([0-9]+\s*(?:-\s*[0-9]+)?)\s*(?=,|\z)"), F.lit(1))

    def numbers(t: Column) -> Column:
        a, b = (F.substring_index(t, "-", k).try_cast("int") for k in (1, -1))
        b = F.coalesce(b, a)
        return F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(tokens, numbers))))


def marked_sentences(s: str) -> Column:
    """A generator of the places and sentences in a column of sentences, for posexplode's two names. Were the column itself exploded, Spark
    would first drop rows without any, and split every text anew for it."""
    return F.posexplode(F.array_remove(s, ""))


def citation_contexts(docs: DataFrame, key: str, body: str, known: DataFrame) -> DataFrame:
    """(key, citation_id, contexts) for the references in known (key, citation_id) that a text's sentences mark.

    A context is a sentence and the sentences before, itself and after it; contexts are in the text's order, and equal ones stand once.
    """
    rows = docs.select(key, split_sentences(F.col(body)).alias("s")).select(key, "s", marked_sentences("s").alias("p", "x")).where(F.contains("x", F.lit("[")))
    near = F.slice("s", F.greatest(F.col("p"), F.lit(1)), F.when(F.col("p") > 0, 3).otherwise(2))
    context = F.struct(F.col("x").alias("sentence"), near.alias("expanded_context"))
    rows = rows.select(key, F.explode(citation_ids(F.col("x"))).alias("citation_id"), "p", context.alias("c"))
    rows = rows.join(known.select(key, "citation_id").distinct(), [key, "citation_id"], "left_semi")
    found = rows.groupBy(key, "citation_id").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("a"))
    return found.select(key, "citation_id", F.array_distinct(F.transform("a", lambda v: v["c"])).alias("contexts"))


def run_tag(c: Column) -> Column:
    """A slug of a file name."""
    return F.regexp_replace(F.regexp_replace(F.lower(_text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def round_half_even(c: Column, digits: int) -> Column:
    """Rounds the binary value as written out, ties to even."""
    return F.call_function("format_number", c.cast("double"), F.lit("0." + "0" * digits)).cast("double")
