"""Catalogs: upserts, postings and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import text as T


def upsert(rows: DataFrame, key: str, order: list, last_wins: bool) -> DataFrame:
    """One row for each key: the last or the first in order. Sums up before it shuffles."""
    pick = F.max_by if last_wins else F.min_by
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(pick(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def postings(records: DataFrame, n: int = 8) -> DataFrame:
    """(word, record_id, and db and year where records have them): the distinct lower-cased words of each title's first n significant ones. Empty ids have none."""
    words = F.array_distinct(T.query_words(F.col("title"), n))
    kept = [c for c in ("db", "year") if c in records.columns]
    return records.where("record_id != ''").select(F.explode(words).alias("word"), "record_id", *kept).distinct()


def stats(records: DataFrame) -> DataFrame:
    """Rows, and rows with a DOI, an abstract, a venue."""
    filled = [F.count_if(F.coalesce(F.col(c) != "", F.lit(False))).alias(f"with_{c}") for c in ("doi", "abstract", "venue")]
    return records.agg(F.count("*").alias("total"), *filled)


def candidates(records: DataFrame, db: str) -> DataFrame:
    """The common candidate columns from a catalog's rows; empty strings become nulls."""
    get = lambda c: T.nonempty(F.col(c)) if c in records.columns else F.lit(None).cast("string")
    authors = T.parse_authors_loose(F.col("authors")) if db == "arxiv" else T.split_authors(F.col("authors"))
    url = {"dblp": get("ee"), "openalex": F.coalesce(get("landing_page_url"), get("record_id"))}.get(db, get("url"))
    year = "publication_year" if db == "openalex" else "year"
    return records.select(
        F.lit(db).alias("db"), "record_id", get("title").alias("title"), T.normalize_title(F.col("title")).alias("title_normalized"), authors.alias("authors"),
        (get("abstract") if db == "arxiv" else F.lit(None).cast("string")).alias("abstract"), T.year_of_text(F.col(year)).alias("year"), get("venue").alias("venue"),
        T.nonempty(T.normalize_doi(get("doi"))).alias("doi"), url.alias("url"), get("oai_identifier").alias("oai_identifier"),
    )


def _first_of_same_key(c: DataFrame, r: DataFrame) -> DataFrame:
    """(kind_rank, k, c_year, c_keys, db, off, author, known, record_id): for each way in which citations ask for a key, a catalog's best record.

    c: kind_rank, k, c_year, c_keys (distinct author keys). r: kind_rank, k, db, record_id, r_year, r_keys. The best record has the same year (not off), then
    the most of the asked author keys (author: less their number), then an unknown year on either side, then the least id. All records
    count. Those that agree in what may be asked count as one, the least; so do citations. They meet by author key and, for the same year, by year; '' stands
    for any author or any year. A record that is met so may seem worse than it is, but is met again by the author and year that it shares.
    """
    any_or = lambda x: F.array_compact(F.array(F.lit(""), x.cast("string")))
    authors = lambda keys: F.explode(F.concat(F.array(F.lit("")), keys)).alias("author_key")
    same = ["kind_rank", "k", "author_key", "y"]
    first = r.select("kind_rank", "k", "db", "record_id", "r_year", "r_keys", authors(F.col("r_keys"))).select(
        "kind_rank", "k", "db", "record_id", "author_key", F.when(F.col("author_key") != "", F.col("r_keys")).otherwise(F.array().cast("array<string>")).alias("r_keys"),
        F.col("r_year").isNotNull().alias("has_year"), F.explode(any_or(F.col("r_year"))).alias("y"),
    ).groupBy(*same, "db", "r_keys", "has_year").agg(F.min("record_id").alias("record_id"))
    asked = c.select("kind_rank", "k", "c_year", "c_keys").distinct().select("*", authors(F.col("c_keys"))).select("*", F.explode(any_or(F.col("c_year"))).alias("y"))
    found = asked.join(first, same).select(
        "kind_rank", "k", "c_year", "c_keys", "db", (F.col("y") == "").alias("off"), (-F.size(F.array_intersect("c_keys", "r_keys"))).alias("author"),
        (F.col("c_year").isNotNull() & F.col("has_year")).alias("known"), "record_id",
    )
    return found.groupBy("kind_rank", "k", "c_year", "c_keys", "db").agg(F.min(F.struct("off", "author", "known", "record_id")).alias("m")).select("kind_rank", "k", "c_year", "c_keys", "db", "m.*")


def best_exact(citations: DataFrame, records: DataFrame) -> DataFrame:
    """(citation_id, db, record_id, match_type, confidence): the first catalog in db_priority with any hit, and in it id, DOI, title.

    citations: citation_id, db_priority, run_exact_match, arxiv_id, doi, title, authors, year, and title_normalized where it isn't
    normalize_title's with all of HTML's character references. records: candidate columns. All records with a citation's DOI or title are
    compared; as only the best one for each way of asking is joined to the citations, a title that many records have doesn't multiply with the citations that have it.
    """
    title = F.col("title_normalized") if "title_normalized" in citations.columns else T.normalize_title(F.col("title"))
    keys = lambda doi, title: F.inline(F.array(*(F.struct(F.lit(n).alias("kind_rank"), T.nonempty(x).alias("k")) for n, x in ((2, T.normalize_doi(doi)), (3, title)))))
    c = citations.where("run_exact_match").select("citation_id", "db_priority", F.col("year").alias("c_year"), T.author_keys(F.col("authors")).alias("c_keys"), keys(F.col("doi"), title)).where("k is not null")
    r = records.select("db", "record_id", F.col("year").alias("r_year"), T.author_keys(F.col("authors")).alias("r_keys"), keys(F.col("doi"), F.col("title_normalized"))).where("k is not null")
    best = _first_of_same_key(c, r).withColumnsRenamed({x: f"b_{x}" for x in ("kind_rank", "k", "c_keys", "c_year")})
    equal = [F.col(x) == F.col(f"b_{x}") for x in ("kind_rank", "k", "c_keys")]
    by_key = c.join(best, [*equal, F.col("c_year").eqNullSafe(F.col("b_c_year"))]).select("citation_id", "db_priority", "db", "kind_rank", "off", "record_id")
    ids = citations.where("run_exact_match").select("citation_id", "db_priority", "arxiv_id")
    by_id = ids.join(records.where("db = 'arxiv'").select("db", "record_id"), F.col("arxiv_id") == F.col("record_id"))
    every = by_key.unionByName(by_id.select("citation_id", "db_priority", "db", F.lit(1).alias("kind_rank"), F.lit(False).alias("off"), "record_id"))
    every = every.withColumn("db_rank", F.array_position("db_priority", F.col("db"))).where("db_rank > 0")
    kind, same_year = F.col("kind_rank"), ~F.col("off")
    every = every.select(
        "citation_id", "db_rank", "kind_rank", "off", "record_id", "db", F.when(kind == 1, "arxiv_id_exact").when(kind == 2, "doi_exact").when(same_year, "title_year_exact").otherwise("title_exact").alias("match_type"),
        F.when(kind < 3, 0.99).when(same_year, 0.93).otherwise(0.88).alias("confidence"),
    )
    order = F.struct("db_rank", "kind_rank", "off", "record_id")
    return every.groupBy("citation_id").agg(F.min_by(F.struct("db", "record_id", "match_type", "confidence"), order).alias("x")).select("citation_id", "x.*")


def exact_results(citations: DataFrame, best: DataFrame) -> DataFrame:
    """One row for each citation (citation_id, db_priority, run_exact_match, confidence of the route): whether and what the exact search found.

    A citation whose route asks for no exact search is `skipped` with the route's confidence; one without a match is `not_found`.
    """
    out = citations.select("citation_id", "db_priority", "run_exact_match", F.col("confidence").alias("route_")).join(best, "citation_id", "left")
    run, found = F.coalesce(F.col("run_exact_match"), F.lit(False)), F.col("match_type").isNotNull()
    return out.select(
        "citation_id", "db_priority", "run_exact_match", (run & found).alias("match_found"), F.when(~run, "skipped").when(found, F.col("match_type")).otherwise("not_found").alias("match_type"),
        F.when(run, F.col("db")).alias("matched_db"), F.when(run, F.col("record_id")).alias("record_id"), F.when(~run, F.col("route_")).when(found, F.col("confidence")).otherwise(0.0).alias("confidence"),
    )


def lexical_hits(citations: DataFrame, records: DataFrame | None, posted: DataFrame, fetch: int = 4) -> DataFrame:
    """(citation_id, db, record_id, matched_word_count): by citation and catalog the `fetch` records that share most title words.

    citations: citation_id, words, year (may be null). posted: postings with db and year. Ties go to the least record_id. Where two words
    have to be shared, one of them isn't the citation's most frequent word: records are found by the others, so the postings of the hottest
    words are never multiplied with the citations, and whether the records found have that word too is one equi join on word and record.
    """
    from citeweave.functions.matching import minimum_matches

    asked = citations.select("citation_id", F.col("year").alias("c_year"), minimum_matches(F.col("words")).alias("least"), F.explode(F.array_distinct("words")).alias("word"))
    often = posted.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("often"))
    asked = asked.join(often, "word")
    hottest = F.row_number().over(Window.partitionBy("citation_id").orderBy(F.desc("often"), "word"))
    asked = asked.withColumn("skip", (hottest == 1) & (F.col("least") > 1))
    near = F.col("c_year").isNull() | F.col("year").isNull() | F.col("year").between(F.col("c_year") - 1, F.col("c_year") + 1)
    found = asked.where("not skip").join(posted, "word").where(near).groupBy("citation_id", "least", "db", "record_id").agg(F.count("*").alias("n"))
    hot = asked.where("skip").select("citation_id", F.col("word").alias("hot"))
    also = posted.select(F.col("word").alias("hot"), "record_id", F.lit(1).alias("also"))
    found = found.join(hot, "citation_id", "left").join(also, ["hot", "record_id"], "left")
    found = found.withColumn("matched_word_count", F.col("n") + F.coalesce("also", F.lit(0))).where("matched_word_count >= least")
    rank = F.row_number().over(Window.partitionBy("citation_id", "db").orderBy(F.desc("matched_word_count"), "record_id"))
    return found.withColumn("fetch_rank", rank).where(F.col("fetch_rank") <= fetch).select("citation_id", "db", "record_id", "matched_word_count")


def lexical_scored(citations: DataFrame, records: DataFrame, hits: DataFrame, keep: int = 2) -> DataFrame:
    """Scores the hits, drops titles that overlap too little, and keeps the best `keep` by citation and catalog."""
    from citeweave.functions import matching as M

    c = citations.select("citation_id", F.col("words").alias("q"), F.col("authors").alias("c_authors"), F.col("year").alias("c_year"))
    rows = hits.join(c, "citation_id").join(records, ["db", "record_id"]).withColumn("cand", T.query_words(F.col("title"), 12))
    title = F.size(F.array_intersect("q", "cand")) / F.greatest(F.size(F.array_distinct("q")), F.lit(1))
    rows = rows.withColumn("t", title).where(F.col("t") >= M.MIN_TITLE)
    rows = rows.withColumn("a", T.author_overlap(F.col("c_authors"), F.col("authors"))).withColumn("y", M.year_support(F.col("c_year"), F.col("year")))
    rows = rows.select(
        "citation_id", "db", "record_id", "matched_word_count", F.array_join(F.array_sort(F.array_intersect("q", "cand")), " ").alias("matched_words"),
        *(T.round_half_even(F.col(k), 4).alias(n) for k, n in (("t", "title_score"), ("a", "author_score"), ("y", "year_score"))),
        T.round_half_even(M.lexical_score(F.col("t"), F.col("a"), F.col("y")), 4).alias("lexical_score"), (F.coalesce("abstract", F.lit("")) != "").alias("has_abstract"),
    )
    order = [F.desc("lexical_score"), F.desc("matched_word_count"), F.desc("has_abstract"), F.col("record_id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("citation_id", "db").orderBy(*order))).where(F.col("rank") <= keep)


def search_masks(scored: DataFrame) -> DataFrame:
    """(citation_id, near, weak) from ranked candidates: whether arxiv's first is near perfect, and whether the best of arxiv and dblp is weak or missing."""
    from citeweave.functions import matching as M

    fields = ["title_score", "author_score", "lexical_score"]
    best = lambda test, order: F.max_by(F.when(test, F.struct(*fields)), F.when(test, order))
    order = F.struct("lexical_score", -F.col("db_priority_rank"), "matched_word_count", "has_abstract", -F.col("rank"))
    return scored.groupBy("citation_id").agg(
        best(F.col("db") == "arxiv", -F.col("rank")).alias("arxiv_first"), best(F.col("db") != "openalex", order).alias("before"),
    ).select("citation_id", M.near_perfect("arxiv_first").alias("near"), M.weak("before").alias("weak"))


def ranked_catalogs(scored: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """Candidates with their catalog's rank, of the catalogs in a citation's db_priority where citations are given."""
    rows = scored.withColumn("db_priority_rank", F.expr("array_position(array('arxiv', 'dblp', 'openalex'), db)").cast("int"))
    if citations is None:
        return rows
    return rows.join(citations.select("citation_id", F.col("db_priority").alias("p_")), "citation_id").where(F.expr("array_contains(p_, db)")).drop("p_")


def cascade(scored: DataFrame, total: int = 10, citations: DataFrame | None = None) -> DataFrame:
    """The catalogs' candidates merged as if each were asked only while needed: arxiv, then dblp, then openalex.

    A near-perfect first candidate of arxiv ends the search; openalex counts only if nothing was found or the best so far is weak.
    All catalogs are searched at once, and masks take out what would not have been asked.
    """
    rows = ranked_catalogs(scored, citations)
    rows = rows.join(search_masks(rows), "citation_id").where("db = 'arxiv' or not near and (db = 'dblp' or weak)")
    by = [F.desc("lexical_score"), F.asc("db_priority_rank"), F.desc("matched_word_count"), F.desc("has_abstract"), F.asc("record_id")]
    rows = rows.withColumn("retrieval_rank", F.row_number().over(Window.partitionBy("citation_id").orderBy(*by)))
    return rows.where(F.col("retrieval_rank") <= total).drop("near", "weak", "rank")


def lexical_results(citations: DataFrame, exact: DataFrame, scored: DataFrame, merged: DataFrame) -> DataFrame:
    """One row for each citation (citation_id, db_priority, run_lexical_retrieval): whether the lexical search was skipped and why, and which catalogs it asked.

    exact: exact_results; scored and merged: lexical_scored and cascade of the citations that were searched.
    """
    masks = search_masks(ranked_catalogs(scored, citations))
    n = merged.groupBy("citation_id").agg(F.count("*").alias("candidate_count"))
    out = citations.select("citation_id", "db_priority", F.coalesce("run_lexical_retrieval", F.lit(False)).alias("run_lexical_retrieval"))
    out = out.join(exact.where("match_found").select("citation_id", F.col("match_type").alias("m_")), "citation_id", "left").join(masks, "citation_id", "left").join(n, "citation_id", "left")
    reason = F.when(~F.col("run_lexical_retrieval"), "router_disabled").when(F.col("m_").isNotNull(), F.concat(F.lit("exact_match_found:"), "m_"))
    has = lambda db: F.array_contains("db_priority", db)
    near, weak = F.coalesce("near", F.lit(False)), F.coalesce("weak", F.lit(True))
    asked = F.filter(F.array(F.when(has("arxiv"), "arxiv"), F.when(has("dblp") & ~near, "dblp"), F.when(has("openalex") & ~near & weak, "openalex")), lambda x: x.isNotNull())
    out = out.withColumn("skip_reason", reason).withColumn("skipped", F.col("skip_reason").isNotNull())
    return out.select(
        "citation_id", "db_priority", F.when(F.col("skipped"), F.array().cast("array<string>")).otherwise(asked).alias("effective_db_priority"), "run_lexical_retrieval", "skipped", "skip_reason",
        F.when(F.col("skipped"), 0).otherwise(F.coalesce("candidate_count", F.lit(0))).cast("long").alias("candidate_count"),
    )
