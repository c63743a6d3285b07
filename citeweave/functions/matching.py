"""Scores and field evaluators as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import text as T

ID_TYPES = ["arxiv_id_exact", "doi_exact"]
# Thresholds of the lexical search.
MIN_TITLE = 0.35
NEAR = {"title_score": 0.85, "author_score": 0.50, "lexical_score": 0.75}
WEAK = {"title_score": 0.75, "lexical_score": 0.65}


def year_support(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap.isNull(), 0.5).when(gap == 0, 1.0).when(gap <= 1, 0.7).when(gap <= 2, 0.3).otherwise(0.0)


def lexical_score(title: Column, author: Column, year: Column) -> Column:
    return 0.65 * title + 0.25 * author + 0.10 * year


def minimum_matches(words: Column) -> Column:
    return F.when(F.size(words) <= 2, 1).otherwise(2)


def near_perfect(c: str) -> Column:
    out = F.lit(True)
    for k, v in NEAR.items():
        out &= F.col(f"{c}.{k}") >= v
    return F.coalesce(out, F.lit(False))


def weak(c: str) -> Column:
    return F.col(c).isNull() | F.coalesce((F.col(f"{c}.title_score") < WEAK["title_score"]) | (F.col(f"{c}.lexical_score") < WEAK["lexical_score"]), F.lit(True))


def _result(label: Column, score: Column) -> Column:
    return F.struct(label.alias("label"), score.alias("score"))


def _cases(*cases: tuple[Column | None, str, float]) -> Column:
    out = None
    for test, name, value in cases:
        shown = _result(F.lit(name), F.lit(value))
        if test is None:
            return out.otherwise(shown)
        out = F.when(test, shown) if out is None else out.when(test, shown)
    raise ValueError("the last case needs no test")


def _both(a: Column, b: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of two normalised values, each computed once."""
    return T.let(F.struct(a.alias("x"), b.alias("y")), lambda v: body(v["x"], v["y"]))


def title_match(a: Column, b: Column) -> Column:
    overlap = T.overlap_ratio(T.plain_words(a), T.plain_words(b))
    return _both(
        T.normalize_title(a), T.normalize_title(b),
        lambda x, y: _cases(((x == "") | (y == ""), "unknown", 0.5), (x == y, "exact", 1.0), (overlap >= 0.75, "partial", 0.75), (None, "mismatch", 0.0)),
    )


def author_match(a: Column, b: Column) -> Column:
    missing = F.coalesce(F.size(a) == 0, F.lit(True)) | F.coalesce(F.size(b) == 0, F.lit(True))
    overlap = T.author_overlap(a, b)
    return T.let(overlap, lambda share: _cases((missing, "unknown", 0.5), (share >= 0.8, "exact", 1.0), (share > 0, "partial", 0.65), (None, "mismatch", 0.0)))


def year_match(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return _cases((gap.isNull(), "unknown", 0.5), (gap == 0, "exact", 1.0), (gap == 1, "partial", 0.65), (None, "mismatch", 0.0))


def venue_match(a: Column, b: Column) -> Column:
    overlap = T.overlap_ratio(T.plain_words(a), T.plain_words(b))
    return _both(
        T.normalize_venue(a), T.normalize_venue(b),
        lambda x, y: _cases(
            ((x == "") | (y == ""), "unknown", 0.5), (x == y, "exact", 1.0), (F.contains(x, y) | F.contains(y, x), "partial", 0.7),
            (overlap >= 0.5, "partial", 0.6), (None, "mismatch", 0.0),
        ),
    )


def doi_match(a: Column, b: Column) -> Column:
    return _both(T.normalize_doi(a), T.normalize_doi(b), lambda x, y: _cases(((x == "") | (y == ""), "unknown", 0.5), (x == y, "exact", 1.0), (None, "mismatch", 0.0)))


def url_match(a: Column, b: Column) -> Column:
    return _both(
        T.normalize_url(a), T.normalize_url(b),
        lambda x, y: _cases(((x == "") | (y == ""), "unknown", 0.5), (x == y, "exact", 1.0), (F.contains(x, y) | F.contains(y, x), "partial", 0.7), (None, "mismatch", 0.0)),
    )


def arxiv_match(a: Column, b: Column) -> Column:
    """Of two identifiers that are extracted already."""
    return _cases((a.isNull() | b.isNull(), "unknown", 0.5), (a == b, "exact", 1.0), (None, "mismatch", 0.0))


def bibliographic_score(t: Column, a: Column, y: Column, d: Column, u: Column, x: Column, match_type: Column) -> Column:
    score = T.round_half_even(0.40 * t + 0.25 * a + 0.15 * y + 0.10 * d + 0.05 * u + 0.05 * x, 4)
    floor = F.coalesce(match_type.isin(ID_TYPES), F.lit(False)) & (t > 0)
    return F.least(F.lit(1.0), F.when(floor, F.greatest(score, F.lit(0.92))).otherwise(score))


def overall_status(has_candidate: Column, match_type: Column, title: Column, author: Column, year: Column) -> Column:
    by_id = F.coalesce(match_type.isin(ID_TYPES), F.lit(False))
    return (
        F.when(~has_candidate, "hallucinated").when(by_id & (title != "mismatch"), "verified").when(title == "mismatch", "hallucinated")
        .when((title == "partial") | author.isin("partial", "mismatch") | year.isin("partial", "mismatch"), "partially_verified")
        .when(title == "exact", "verified").otherwise("partially_verified")
    )


def category(has_candidate: Column, match_type: Column, title: Column, author: Column, year: Column, score: Column) -> Column:
    """(category, subcategory, reasons)."""
    by_id = F.coalesce(match_type.isin(ID_TYPES), F.lit(False))
    a_off, y_off = author.isin("partial", "mismatch"), year.isin("partial", "mismatch")
    strong = (title == "exact") & ~a_off & ~y_off & (score >= 0.75)
    found = F.filter(F.array(F.when(title == "partial", "minor_title_mismatch"), F.when(a_off, "author_mismatch"), F.when(y_off, "year_mismatch")), lambda x: x.isNotNull())
    both = F.array(F.lit("author_mismatch"), F.lit("year_mismatch"))

    def row(cat: str, sub: str, reasons: Column | None = None) -> Column:
        return F.struct(F.lit(cat).alias("category"), F.lit(sub).alias("subcategory"), (F.array(F.lit(sub)) if reasons is None else reasons).alias("reasons"))

    return (
        F.when(~has_candidate, row("Not Verified", "no_candidate_found")).when(title == "mismatch", row("Not Verified", "title_mismatch"))
        .when(by_id, row("Verified", "exact_identifier_match")).when(strong, row("Verified", "strong_metadata_match"))
        .when(a_off | y_off, row("Partially Verified", "author/year mismatch", found))
        .when(title == "partial", row("Partially Verified", "minor_title_mismatch", found))
        .otherwise(row("Partially Verified", "author/year mismatch", both))
    )


def explanation(has_candidate: Column, source: Column, title: Column, author: Column, year: Column, doi: Column, arxiv: Column, status: Column) -> Column:
    parts = F.concat_ws(
        "; ", F.concat(F.lit("Selected candidate came from "), F.coalesce(T.nonempty(source), F.lit("unknown"))), F.concat(F.lit("title="), title),
        F.concat(F.lit("authors="), author), F.concat(F.lit("year="), year), F.when(doi != "unknown", F.concat(F.lit("doi="), doi)),
        F.when(arxiv != "unknown", F.concat(F.lit("arxiv_id="), arxiv)), F.concat(F.lit("overall_status="), status),
    )
    return F.when(~has_candidate, "No fused candidate was available for verification.").otherwise(F.concat(parts, F.lit(".")))


def combined_label(status: Column, label: Column, skipped: Column) -> Column:
    yes = label.isin("supported", "partially_supported")
    return (
        F.when((status == "verified") & yes, "strongly_supported_citation")
        .when((status == "verified") & (label == "unsupported"), "bibliographically_valid_but_semantically_unsupported")
        .when(status == "hallucinated", "likely_problematic")
        .when((status == "ambiguous") | skipped | label.isin("unclear", "unsupported"), "needs_manual_review")
        .when((status == "partially_verified") & yes, "promising_but_needs_review").otherwise("mixed_evidence")
    )


REVIEW_LABELS = ["needs_manual_review", "promising_but_needs_review", "bibliographically_valid_but_semantically_unsupported", "likely_problematic"]


def shown(label: Column) -> Column:
    """What a report shows of an author or year label."""
    return F.when(label == "exact", "match").when(label == "partial", "partial").otherwise("mismatch")
