"""Reading reference lists: the section, its references, and title, authors, venue and identifiers of each. Order-dependent rules run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions import reference_rules as R
from citeweave.functions import text as T
from citeweave.session import ship


def one_space(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def n_words(text: str) -> int:
    return len(text.split())


def any_match(patterns: list[re.Pattern], text: str) -> bool:
    return any(p.match(text) for p in patterns)


def cut_at(text: str, ends: list[re.Pattern]) -> str:
    """Up to the first place where any of the ends begins; an end that begins with ? or ! leaves that mark. A last period goes."""
    places = [m.start() + (m[0][0] in "?!") for p in ends if (m := p.search(text))]
    return re.sub(r"\.\s*$", "", text[: min(places, default=len(text))].strip())


# -- the section --------------------------------------------------------------------------------
def join_hyphens(text: str) -> str:
    """Joins words that a line break split; a hyphen stays after a digit and before words such as `based`."""
    if "-" not in text:
        return text
    for pattern, phrase in R.KEPT_PHRASES:
        text = re.sub(pattern, phrase, text, flags=re.I)

    def joined(m: re.Match) -> str:
        keep = m[1].isdigit() or m[2].lower() in R.COMPOUND_SUFFIXES
        return f"{m[1]}{'-' if keep else ''}{m[2]}"

    return re.sub(r"(\w)- (\w+)", joined, re.sub(r"(\w)-\s+(\w+)", joined, text))


def without_headers(text: str) -> str:
    """Drops running headers: venue lines, with the title line before them, short author lines, lines in capitals and page numbers."""
    lines, kept = text.split("\n"), []
    for k, raw in enumerate(lines):
        line = raw.strip()
        if R.HEADER_VENUE.match(line):
            before = kept[-1].strip() if kept else ""
            is_title = len(before) > 20 and not re.match(r"\[\d+\]|\d+\.", before)
            if is_title and not (before.endswith(".") and k > 0 and "doi:" in lines[k - 1]):
                kept.pop()
            continue
        authors = len(line) < 100 and R.HEADER_AUTHORS.match(line)
        capitals = len(line) > 15 and n_words(line) >= 3 and R.HEADER_CAPITALS.match(line)
        if not (authors or capitals or R.PAGE_NUMBER.match(line)):
            kept.append(raw)
    return "\n".join(kept)


def references_section(text: str) -> str:
    """The text between a heading such as References and an appendix or the like; without a heading the last three tenths."""
    for header in R.SECTION_HEADERS:
        if m := re.search(header, text, re.I):
            rest = text[m.end() :]
            return without_headers(rest[: min((e.start() for p in R.SECTION_ENDS if (e := p.search(rest))), default=len(rest))])
    return without_headers(text[int(len(text) * R.LAST_SHARE) :])


# -- references ---------------------------------------------------------------------------------
def seams(text: str) -> Iterator[tuple[list[tuple[int, int]], int, bool, int]]:
    """By style, in the order in which styles are tried: where a reference ends and the next begins, how many such seams show
    the style, whether a reference stands before the first, and the length that references have to exceed."""
    yield [(m.start(), m.end()) for m in R.BRACKETED.finditer(text)], 3, False, 0
    yield [(m.start(), m.end()) for m in R.ALPHABETIC.finditer(text)], 3, False, 0
    numbered = list(R.NUMBERED.finditer(text))
    in_order = [int(m[1]) for m in numbered[:5]] == list(range(1, min(len(numbered), 5) + 1))
    yield [(m.start(), m.end()) for m in numbered] if in_order else [], 3, False, 0
    merged: list[re.Match] = []
    for m in sorted([*R.SURNAME_FIRST.finditer(text), *R.ORGANIZATION.finditer(text)], key=lambda m: m.start()):
        if not merged or m.start() - merged[-1].start() > 10:
            merged.append(m)
    yield [(m.end(1), m.start(2)) for m in merged], 3, True, 0
    at, starts = 0, []
    for line in text.split("\n"):
        if R.YEAR_IN_LINE.match(line):
            starts.append((at, at))
        at += len(line) + 1
    yield starts, 5, False, 20
    yield [(m.start() + m[0].index("\n") + 1, m.start(1)) for m in R.YEAR_LAST.finditer(text)], 5, True, 20
    yield [(m.end(1), m.start(2)) for m in R.INITIALS_FIRST.finditer(text)], 5, True, 20


def segments(text: str) -> list[str]:
    """The references of a section, by the first style that is found often enough, else by blank lines."""
    ends = [m.start() for p in R.LIST_ENDS if (m := p.search(text)) and m.start() > 500]
    if ends:
        text = text[: min(ends)].strip()
    for k, (cuts, least, lead, longer) in enumerate(seams(text)):
        if len(cuts) >= least:
            first = text[: cuts[0][0]].strip() if lead else ""
            if k == 5:  # what stands after the last period belongs to the year that follows
                first = first[: first.rfind(".") + 1] or first
            found = [first] if len(first) > 20 else []
            for (_, start), (end, _) in zip(cuts, [*cuts[1:], (len(text), 0)]):
                x = text[start:end].strip()
                if k in (4, 5):  # a page number may follow
                    x = re.sub(r"\n+\d+\s*$", "", x).strip()
                if len(x) > longer:
                    found.append(x)
            return found
    return [x.strip() for x in re.split(r"\n\s*\n", text) if len(x.strip()) > 20]


def doi_of(text: str) -> str | None:
    """The DOI of a link, else the first one; split ones are joined, closing marks and unbalanced brackets go."""
    for pattern, by in R.DOI_JOINS if "\n" in text else ():
        text = pattern.sub(by, text)
    m = next((m for p in R.DOIS if (m := p.search(text))), None)
    if not m:
        return None
    doi = m[1].rstrip(".,;:")
    for left, right in ("()", "[]", "{}"):
        while doi.endswith(right) and doi.count(right) > doi.count(left):
            doi = doi[:-1].rstrip(".,;:")
    return doi


def arxiv_of(text: str) -> str | None:
    for pattern, by in R.ARXIV_JOINS if "\n" in text else ():
        text = pattern.sub(by, text)
    return next((m[1] for p in R.ARXIV_IDS if (m := p.search(text))), None)


def is_bare_link(text: str) -> bool:
    """A link that is no citation: neither to a trusted site, nor beside a quoted title and a year."""
    return bool(R.LINK.search(text)) and not R.TRUSTED.search(text) and not (R.QUOTED_TITLE.search(text) and R.YEAR.search(text))


def sentences(text: str) -> list[str]:
    """Sentences of a reference; a period after an initial, an abbreviation, or before a digit ends none."""
    out, start = [], 0
    for m in re.finditer(r"\.\s+", text):
        at, after = m.start(), text[m.end() :]
        if at > 0:
            initial = text[at - 1].isupper() and (at == 1 or not text[at - 2].isalpha())
            word = re.search(r"[^\W\d_]*$", text[:at])[0] or text[at - 1]
            if initial and any_match(R.AUTHOR_FOLLOWS, after) or word.lower() in R.NO_SENTENCE_END or after[:1].isdigit():
                continue
        out.append(text[start:at].strip())
        start = m.end()
    return [*out, text[start:].strip()] if start < len(text) else out


# -- titles -------------------------------------------------------------------------------------
def prepared(ref: str) -> str:
    """A reference in a line, without its number, stray marks, review numbers and page back-references."""
    ref = one_space(join_hyphens(ref))
    ref = re.sub(r"^\d+\.\s*", "", re.sub(r"^\[\d+\]\s*", "", ref)).lstrip(". ")
    return one_space(re.sub(r"\s*↑\d+(?:,\s*\d+)*\s*", " ", re.sub(r"\bMR\s*\d{5,}", "", ref)))


def quoted_title(ref: str) -> str | None:
    """The text in quotes, with a subtitle after them."""
    if (m := R.QUOTED_TO_COMMA.search(ref)) and n_words(m[1]) >= 2:
        return m[1].strip() + ","
    for pattern in R.QUOTES:
        if not (m := pattern.search(ref)):
            continue
        inside, after = m[1].strip(), ref[m.end() :].strip()
        if inside.endswith(","):
            if n_words(inside) >= 2:
                return inside
            continue
        if after and n_words(inside) >= 2:
            more = after[1:].strip() if after[0] in ":-" else after if after[0].isupper() and not R.VENUE_STARTS.match(after) else ""
            end = min((e.start() for p in R.SUBTITLE_ENDS if (e := p.search(more))), default=len(more))
            more = re.sub(r"[.,;:]+$", "", more[:end].strip())
            if n_words(more) >= 2:
                return f"{inside}: {more}"
        if n_words(inside) >= 3:
            return inside
    return None


def after(find: re.Pattern, ends: list[re.Pattern], least: int, authors: bool = True) -> Callable[[str], str | None]:
    """A rule: the title is the group that a pattern finds, up to the first of the ends. authors: lists of authors may be titles."""

    def rule(ref: str) -> str | None:
        if m := find.search(ref):
            title = cut_at(m[1].strip(), ends)
            if n_words(title) >= least and (authors or not any_match(R.AUTHOR_LISTS, title)):
                return title
        return None

    return rule


def after_year(ref: str) -> str | None:
    """`Authors (Year) Title`, unless the year follows an issue in parentheses."""
    m = R.YEAR_IN_PARENTHESES.search(ref)
    if not m or re.search(r"\)\s*$", ref[: m.start()]):
        return None
    title = cut_at(ref[m.end() :], R.YEAR_IN_PARENTHESES_ENDS)
    return title if n_words(title) >= 3 else None


def before_venue(ref: str) -> str | None:
    """`Authors. Title. In Venue`: the second sentence before the venue, or what follows the last author's initials."""
    m = next((m for p in R.VENUE_MARKERS if (m := p.search(ref))), None)
    if not m:
        return None
    head = ref[: m.start()].strip()
    parts = sentences(head)
    if len(parts) >= 2:
        title = re.sub(r"\.\s*$", "", parts[1].strip())
        if n_words(title) >= 3 and not R.TWO_NAMES.match(title):
            return title
    ends = (head[m.start(1) :] for m in reversed(list(R.LAST_INITIALS.finditer(head))))
    title = re.sub(r"\.\s*$", "", next((x for x in ends if not R.NEXT_AUTHOR.match(x)), "").strip())
    return title if n_words(title) >= 3 and not R.SURNAME_INITIAL.match(title) else None


def before_journal(ref: str) -> str | None:
    """`Authors. Title. Journal, Volume`, or the last sentence before `Journal Year;Volume`."""
    for find, which in ((R.JOURNAL, 1), (R.JOURNAL_YEAR, -1)):
        if m := find.search(ref):
            parts = sentences(ref[: m.start()].strip())
            if len(parts) >= 2:
                title = parts[which].strip()
                title = title if which == 1 else re.sub(r"\.\s*$", "", title)
                if n_words(title) >= 3:
                    return title
    return None


def after_capital_authors(ref: str) -> str | None:
    """`SURNAME, F., AND SURNAME, G. Title`."""
    if not R.CAPITAL_AUTHORS.match(ref) or R.CAPITAL_AUTHORS_NOT.match(ref):
        return None
    return after(R.CAPITAL_AUTHORS_TITLE, R.CAPITAL_AUTHORS_ENDS, 3, False)(ref)


def is_name(part: str) -> bool:
    """Whether a part between commas is an author: with `and`, initials, or up to four name words."""
    words = part.split()
    by_word = len(words) <= 4 and all(R.NAME_WORD.match(w) or w.lower() in R.PARTICLES for w in words)
    return bool(R.AND_NAME.match(part) or R.INITIALS_NAME.match(part) or by_word)


def between_commas(ref: str) -> str | None:
    """`First Last, and First Last, Title, Journal Vol (Year)`."""
    m = next((m for p in R.COMMA_VENUES if (m := p.search(ref))), None)
    if not m:
        return None
    head = ref[: m.start()].strip()
    last = R.AND_AUTHOR.search(head)
    if last and last[1].split()[0].lower() not in R.NO_NAMES:
        title = re.sub(r",\s*$", "", last[2].strip())
        if n_words(title) >= 2 and not any_match(R.AUTHOR_LISTS, title):
            return title
    parts = [p.strip() for p in head.split(",")]
    first = next((k for k in range(1, len(parts)) if parts[k] and not is_name(parts[k])), None)
    if first is not None:
        title = re.sub(r",\s*$", "", ", ".join(parts[first:]))
        if n_words(title) >= 2:
            return title
    return None


def after_initials_list(ref: str) -> str | None:
    """`I. Surname, I. Surname, Title, Venue (Year)`."""
    if not R.INITIALS_LIST.match(ref):
        return None
    end = min((m.start() for p in R.INITIALS_LIST_VENUES if (m := p.search(ref))), default=0)
    if not end:
        return None
    parts = [p.strip() for p in ref[:end].strip().split(",")]
    first = next((k for k, p in enumerate(parts) if p and not R.INITIALS_AUTHOR.match(p)), 0)
    title = ", ".join(parts[first:]).strip().rstrip(",")
    return title if first and n_words(title) >= 3 else None


def after_capital_initials(ref: str) -> str | None:
    """`SURNAME I, SURNAME I, et al. Title`."""
    if not R.CAPITAL_INITIAL.match(ref):
        return None
    if m := R.ET_AL.search(ref):
        rest = ref[m.end() :].strip()
    else:
        parts = [p.strip() for p in ref.split(", ")]
        first = next((k for k, p in enumerate(parts) if not R.CAPITAL_NAME.match(p)), None)
        rest = "" if first is None else ", ".join(ref.split(", ")[first:]).strip()
    title = cut_at(rest, R.CAPITAL_INITIAL_ENDS)
    return title if n_words(title) >= 3 and not any_match(R.AUTHOR_LISTS, title) else None


def second_sentence(ref: str) -> str | None:
    """The second sentence, or the third if the second looks like more authors."""
    parts = sentences(ref)
    if len(parts) < 2:
        return None
    title = parts[1].strip()
    words = title.split()
    names = sum(bool(re.match(r"^[A-Z][a-z]+$", w)) for w in words)
    if words and names / len(words) > 0.7 and "and" in map(str.lower, words) and len(parts) >= 3:
        title = parts[2].strip()
    return title if n_words(title) >= 3 and not re.match(r"[Ii]n\s+", title) and not any_match(R.AUTHOR_LISTS, title) else None


#: The formats in the order in which they are tried, after quotes.
FORMATS = [
    after(R.INITIALS_COLON, R.INITIALS_COLON_ENDS, 2, False), after(R.NAME_COLON, R.NAME_COLON_ENDS, 2), after(R.ET_AL_FIRST, R.ET_AL_FIRST_ENDS, 2), after_year,
    after(R.YEAR_BETWEEN_PERIODS, R.YEAR_BETWEEN_PERIODS_ENDS, 3), before_venue, before_journal, after_capital_authors, between_commas, after_initials_list,
    after(R.AMPERSAND_YEAR, R.AMPERSAND_YEAR_ENDS, 3), after_capital_initials, second_sentence,
]


def found_title(ref: str) -> tuple[str, bool]:
    """(title, whether it stood in quotes) as the first format gives it; empty if none does."""
    ref = prepared(ref)
    if title := quoted_title(ref):
        return title, True
    return next((t for rule in FORMATS if (t := rule(ref))), ""), False


def clean_title(title: str, quoted: bool) -> str:
    """A title without what follows it: another sentence, a venue, volume, pages, link or date."""
    title = join_hyphens(title)
    for m in () if quoted else re.finditer(r"\.", title):
        at = m.start()
        last = re.search(r"[^. ]*$", title[:at])[0]
        next_two = title[at + 1 : at + 3]
        if (len(last) > 2 or len(last) == 2 and last.isupper()) and not next_two[:1].isalpha() and not (next_two[:1] == " " and next_two[1:].isdigit()):
            title = title[:at]
            break
    for p in R.MARK_ENDS:
        if m := p.search(title):
            title = title[: m.start() + 1]
    for p in R.TITLE_CUTS:
        title = p.sub("", title)
    return re.sub(r"[.,;:]+$", "", title.strip()).strip()


def title_of(ref: str) -> str:
    title, quoted = found_title(ref)
    if m := R.VENUE_AFTER_MARK.search(title):
        title = title[: m.start() + 1].strip()
    return clean_title(title, quoted)


# -- authors and venue --------------------------------------------------------------------------
def authors_of(ref: str) -> list[str] | None:
    """The authors, 15 at most; None where dashes stand for those of the reference before."""
    ref = one_space(ref)
    if R.SAME_AUTHORS.match(ref):
        return None
    quote, year = re.search(r"[\"\u201c\u201d]", ref), re.search(r"\s+\(\d{4}[a-z]?\)\s+", ref)
    between = re.search(r"\.\s*(?:19|20)\d{2}\.\s*", ref)
    if quote or year:
        end = (quote or year).start()
    elif between:
        end = between.start() + 1
    else:  # the first period that follows no initial
        periods = (m.start() for m in re.finditer(r"\. ", ref))
        end = next((p for p in periods if not (p > 0 and ref[p - 1].isupper() and (p == 1 or not ref[p - 2].isalpha()))), 0) or len(ref)
    part = re.sub(r"[.,;:]+$", "", ref[:end].strip()).strip()
    if "; " in part and re.search(r"[A-Z][a-z]+,\s+[A-Z]\.", part):
        names = [p.strip() for p in re.sub(r";\s+and\s+", "; ", part, flags=re.I).split(";")]
        return [p for p in names if len(p) > 2 and re.search(r"[A-Z]", p)][: R.MOST_AUTHORS]
    part = re.sub(r"\s*&\s*", ", ", re.sub(r",?\s+and\s+", ", ", part, flags=re.I))
    part = re.sub(r",?\s*et\s+al\.?", "", part, flags=re.I)

    def named(p: str) -> bool:
        lower = [w for w in p.split() if w[0].islower() and w not in R.LOWER_NAME_WORDS]
        return len(p) > 2 and not re.search(r"\d", p) and n_words(p) <= R.MOST_NAME_WORDS and len(lower) <= 1 and bool(re.search("[A-Z]", p) and re.search("[a-z]", p))

    return [p for p in (x.strip() for x in part.split(",")) if named(p)][: R.MOST_AUTHORS]


def tail_after(x: str, text: str) -> str | None:
    """What follows the first place in a line where x stands in any case. A pattern is compiled only where letters beyond ASCII need its rules."""
    if R.FOREIGN_LETTER.search(x) or R.FOREIGN_LETTER.search(text):
        m = re.search(re.escape(x) + r"(.*)$", text, re.I)
        return m[1] if m else None
    at = text.lower().find(x.lower())
    return None if at < 0 else text[at + len(x) :]


def venue_of(ref: str, title: str) -> str:
    """What follows the title, without leading marks, links, volume, pages and year; empty if that is the title again."""
    if not title:
        return ""
    ref, bare = one_space(ref), title.strip().strip("\"\u201c\u201d'")
    tail = ""
    for x in (title.strip(), bare, title.strip().rstrip(".,;:!?"), bare.rstrip(".,;:!?")):
        if x.strip() and (found := tail_after(x.strip(), ref)) is not None:
            tail = found
            break
    venue = tail.strip()
    for p in (*R.VENUE_LEADS, *R.VENUE_CUTS):
        venue = p.sub("", venue)
    venue = one_space(venue.strip(" ,.;:"))
    plain = lambda x: re.sub(r"[^a-z0-9]+", "", x.lower())
    return "" if plain(venue) == plain(title) or any_match(R.NO_REFERENCE, venue) else venue


def parse(text: str | None) -> list[dict]:
    """The references of a document's text: place (from 1, with gaps where references are left out), raw, title, authors, venue, doi, arxiv_id.

    Left out: bare links, titles of fewer than four words, venues alone, and what is no reference. Dashes in place of authors stand
    for those of the last reference that stays.
    """
    out, last = [], []
    for place, ref in enumerate(segments(references_section(text or "")), 1):
        doi, arxiv_id = doi_of(ref), arxiv_of(ref)
        ref = join_hyphens(re.sub(r"\n\d{1,4}\n", "\n", ref))
        if is_bare_link(ref):
            continue
        title = title_of(ref)
        if n_words(title) < 4 or any_match(R.VENUES_ONLY, title) or any_match(R.NO_REFERENCE, title):
            continue
        authors = authors_of(ref)
        authors = last if authors is None else authors
        last = authors or last
        raw = re.sub(r"^\d+\.\s*", "", re.sub(r"^\[\d+\]\s*", "", one_space(ref)))
        out.append({"place": place, "raw": raw, "title": title, "authors": authors, "venue": venue_of(ref, title), "doi": doi, "arxiv_id": arxiv_id})
    return out


# -- tables -------------------------------------------------------------------------------------
#: Rows that a task reads at most, of texts that take about a millisecond each.
ROWS_PER_TASK = 2048


def spread(rows: DataFrame, keys: tuple[str, ...] = (), most: int = ROWS_PER_TASK) -> DataFrame:
    """The rows dealt over tasks of `most`, evenly or by the hash of unique keys: a small file, or one of a few row groups, is otherwise read by a few tasks however many texts it gives."""
    return rows.repartition(max(1, -(-rows.count() // most)), *keys)


def per_text(f: Callable, schema: str) -> Callable:
    """A column function that maps every text of a batch; a null is null. The workers of the active session get this package."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf(schema)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def parse_references(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each reference of documents' texts: (key, citation_id, raw_citation, parsed_title, parsed_authors, parsed_year, parsed_venue, parsed_doi, parsed_url, parsed_arxiv_id).

    citation_id is the place in the list, with gaps; empty values are null; the url is that of the arXiv identifier.
    """
    rows = docs.select(key, F.inline(per_text(parse, "array<struct<place:int,raw:string,title:string,authors:array<string>,venue:string,doi:string,arxiv_id:string>>")(F.col(text))))
    clean = F.filter(F.transform("authors", lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(
        key, F.col("place").alias("citation_id"), T.nonempty(F.col("raw")).alias("raw_citation"), T.nonempty(F.col("title")).alias("parsed_title"), clean.alias("parsed_authors"),
        T.extract_year(F.col("raw")).alias("parsed_year"), T.nonempty(F.col("venue")).alias("parsed_venue"), T.nonempty(F.col("doi")).alias("parsed_doi"),
        F.concat(F.lit("https://arxiv.org/abs/"), T.nonempty(F.col("arxiv_id"))).alias("parsed_url"), T.nonempty(F.col("arxiv_id")).alias("parsed_arxiv_id"),
    )
