"""Fusion, verification, semantic judgment and reports over citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions import matching as M
from citeweave.functions import text as T

STATUSES = ["verified", "partially_verified", "ambiguous", "hallucinated"]
LABELS = ["supported", "partially_supported", "unclear", "unsupported", "skipped"]
CATEGORIES = ["Verified", "Partially Verified", "Not Verified"]


def fuse(citations: DataFrame, exact: DataFrame, lexical: DataFrame | None = None, searched: DataFrame | None = None) -> DataFrame:
    """One row for each citation: what was selected, its backups, and summaries of both searches.

    exact: best_exact's rows, or exact_results'. lexical: the cascade's; without it this is the first stage. searched:
    lexical_results' rows. An exact match wins over the best lexical candidate; its backups are the first two lexical candidates, those of
    a lexical one the next two.
    """
    has = lambda c: F.col(c) if c in exact.columns else F.lit(None)
    found = has("match_found") if "match_found" in exact.columns else F.lit(True)
    e = exact.select("citation_id", F.struct(
        F.col("db" if "db" in exact.columns else "matched_db").alias("db"), "record_id", "match_type", F.col("confidence").cast("double").alias("confidence"), found.alias("found"),
        has("run_exact_match").cast("boolean").alias("run"),
    ).alias("e"))
    keep = [c for c in ("db_priority",) if c in citations.columns]
    out = citations.select("citation_id", *keep).join(e, "citation_id", "left")
    if lexical is None:
        out = out.withColumn("l", F.lit(None).cast("array<struct<retrieval_rank:int,db:string,record_id:string,lexical_score:double>>")).withColumn("n", F.lit(0).cast("long"))
    else:
        ranked = F.struct(F.col("retrieval_rank").cast("int").alias("retrieval_rank"), "db", F.col("record_id").cast("string").alias("record_id"), F.col("lexical_score").cast("double").alias("lexical_score"))
        first = F.array_sort(F.collect_list(F.when(F.col("retrieval_rank") <= 3, ranked)))
        out = out.join(lexical.groupBy("citation_id").agg(first.alias("l"), F.count("*").alias("n")), "citation_id", "left")
    if searched is None:
        none = F.lit(None)
        out = out.withColumn("s", F.struct(none.cast("boolean").alias("run_lexical_retrieval"), none.cast("boolean").alias("skipped"), none.cast("string").alias("skip_reason"), F.array().cast("array<string>").alias("effective_db_priority")))
    else:
        out = out.join(searched.select("citation_id", F.struct("run_lexical_retrieval", "skipped", "skip_reason", "effective_db_priority").alias("s")), "citation_id", "left")
    count = F.coalesce("n", F.lit(0)).cast("long")
    is_e = F.coalesce(F.col("e.found"), F.lit(False))
    top, is_l = F.get("l", F.lit(0)), F.coalesce(F.size("l") > 0, F.lit(False))
    pick = lambda a, b: F.when(is_e, a).when(is_l, b)
    status = F.when(is_e & F.col("e.match_type").isin(M.ID_TYPES), "high_confidence_exact").when(is_e, "exact").when(is_l, "lexical").otherwise("no_candidate")
    backups = F.transform(F.slice("l", F.when(is_e, 1).otherwise(2), F.lit(2)), lambda x: F.struct(x["db"].alias("db"), x["record_id"].alias("record_id"), x["lexical_score"].alias("lexical_score")))
    return out.select(
        "citation_id", *keep, F.coalesce("s.effective_db_priority", F.array().cast("array<string>")).alias("effective_db_priority"),
        pick(F.lit("exact"), F.lit("lexical")).alias("selected_source"), pick(F.col("e.match_type"), F.lit("lexical_top_1")).alias("selected_match_type"),
        T.round_half_even(F.coalesce(pick(F.col("e.confidence"), top["lexical_score"]), F.lit(0.0)), 4).alias("selected_confidence"), status.alias("fusion_status"),
        pick(F.col("e.db"), top["db"]).alias("db"), pick(F.col("e.record_id").cast("string"), top["record_id"]).alias("record_id"), count.alias("candidate_count"),
        F.coalesce(backups, F.array().cast("array<struct<db:string,record_id:string,lexical_score:double>>")).alias("backup_candidates"),
        F.struct(F.col("e.run").alias("run_exact_match"), F.col("e.found").alias("match_found"), F.col("e.match_type").alias("match_type"), F.col("e.db").alias("matched_db"), F.col("e.confidence").alias("confidence")).alias("exact_summary"),
        F.struct(F.col("s.run_lexical_retrieval").alias("run_lexical_retrieval"), F.col("s.skipped").alias("skipped"), F.col("s.skip_reason").alias("skip_reason"), count.alias("candidate_count")).alias("lexical_summary"),
    )


def verify(pairs: DataFrame) -> DataFrame:
    """Labels, score, status, category and explanation of (citation, candidate) rows.

    Columns: citation_id, selected_source, selected_match_type, selected_confidence, p_title, p_authors, p_year, p_doi, p_url, p_arxiv,
    has_candidate, c_title, c_authors, c_year, c_doi, c_url, c_arxiv.
    """
    has = F.col("has_candidate")
    fields = {
        "title": M.title_match(F.col("p_title"), F.col("c_title")), "author": M.author_match(F.col("p_authors"), F.col("c_authors")),
        "year": M.year_match(F.col("p_year"), F.col("c_year")), "doi": M.doi_match(F.col("p_doi"), F.col("c_doi")),
        "url": M.url_match(F.col("p_url"), F.col("c_url")), "arxiv": M.arxiv_match(F.col("p_arxiv"), F.col("c_arxiv")),
    }
    out = pairs.withColumns({f"f_{k}": v for k, v in fields.items()})
    label = {k: F.when(has, F.col(f"f_{k}.label")).otherwise("unknown") for k in fields}
    score = M.bibliographic_score(*(F.col(f"f_{k}.score") for k in fields), F.col("selected_match_type"))
    out = out.select("*", *(v.alias(f"{k}_match") for k, v in label.items()), F.when(has, score).otherwise(0.0).alias("bibliographic_score"))
    three = [F.col(f"{k}_match") for k in ("title", "author", "year")]
    out = out.withColumn("overall_status", M.overall_status(has, F.col("selected_match_type"), *three))
    out = out.withColumn("cat", M.category(has, F.col("selected_match_type"), *three, F.col("bibliographic_score")))
    return out.select(
        "citation_id", "selected_source", "selected_match_type", *(f"{k}_match" for k in fields), "bibliographic_score", "overall_status",
        F.col("cat.category").alias("verification_category"), F.col("cat.subcategory").alias("verification_subcategory"),
        F.array_join("cat.reasons", ",").alias("verification_reasons"),
        F.when(has, F.greatest(F.coalesce("selected_confidence", F.lit(0.0)), F.col("bibliographic_score"))).otherwise(0.0).alias("overall_confidence"),
        M.explanation(has, F.col("selected_source"), *three, F.col("doi_match"), F.col("arxiv_match"), F.col("overall_status")).alias("explanation"),
    )


# -- semantic support ---------------------------------------------------------------------------
def context_lines(contexts: Column, most: int = 3) -> Column:
    """Distinct sentences, in order, of the first contexts."""
    lines = F.flatten(F.transform(F.slice(contexts, 1, most), lambda c: F.when(F.size(c["expanded_context"]) > 0, c["expanded_context"]).otherwise(F.array(c["sentence"]))))
    return F.array_distinct(F.filter(F.transform(lines, T.normalize_space), lambda x: x != ""))


def prompt(title: Column, abstract: Column, lines: Column) -> Column:
    """What a judge is asked about one citation."""
    listed = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.concat(F.lit("Does the abstract support the passage?\nPassage:\n"), listed, F.lit("\nTitle: "), T.normalize_space(title), F.lit("\nAbstract: "), T.normalize_space(abstract))


def parse_answer(answer: Column) -> Column:
    """(label, score, explanation) of a judge's JSON, or of the first {...} in its text; labels outside the domain are unclear."""
    schema = "support_label string, support_score string, explanation string"
    got = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), schema)
    label = F.lower(F.trim(got["support_label"]))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got["support_score"].try_cast("double"), F.lit(0.0))))
    return F.struct(
        F.when(label.isin(LABELS[:4]), label).otherwise("unclear").alias("label"), score.alias("score"),
        F.coalesce(T.nonempty(T.normalize_space(got["explanation"])), F.lit("No explanation returned.")).alias("explanation"),
    )


def overlap_judge(abstract: Column, lines: Column) -> Column:
    """The default judge: the share of the passage's distinct words that the abstract has."""
    ratio = T.overlap_ratio(T.plain_words(F.array_join(lines, " "), None), T.plain_words(abstract, None))
    label = F.when(ratio >= 0.6, "supported").when(ratio >= 0.35, "partially_supported").when(ratio >= 0.15, "unclear").otherwise("unsupported")
    return F.struct(label.alias("label"), T.round_half_even(ratio, 4).alias("score"))


def judge(rows: DataFrame, scorer: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(citation_id, skipped, skip_reason, support_label, support_score) of rows (citation_id, has_candidate, abstract, lines, title).

    A scorer gets prompts and gives JSON answers, batch by batch in Python; an answer that fails skips its row. Without one the
    default judge runs inside the JVM.
    """
    reason = F.when(~F.col("has_candidate"), "no_selected_candidate").when(F.coalesce(F.col("abstract"), F.lit("")) == "", "no_candidate_abstract").when(F.size("lines") == 0, "no_expanded_context")
    rows = rows.withColumn("skip_reason", reason)
    if scorer is None:
        rows = rows.withColumn("x", overlap_judge(F.col("abstract"), F.col("lines")))
    else:

        def alone(text: str) -> str:
            try:
                return str(scorer(pd.Series([text])).iloc[0])
            except Exception:
                return ""

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                out, asked = pd.Series([None] * len(batch), dtype=object), batch[batch.notna()]
                if len(asked):
                    try:
                        out[batch.notna()] = [str(x) for x in scorer(asked.reset_index(drop=True))]
                    except Exception:  # then a row's failure is that row's result
                        out[batch.notna()] = [alone(x) for x in asked]
                yield out

        ask = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)
        rows = rows.withColumn("answer", ask(F.when(F.col("skip_reason").isNull(), prompt(F.col("title"), F.col("abstract"), F.col("lines")))))
        rows = rows.withColumn("skip_reason", F.coalesce("skip_reason", F.when(~F.coalesce(F.col("answer").contains("{"), F.lit(False)), "semantic_error")))
        rows = rows.withColumn("x", parse_answer(F.col("answer")))
    skipped = F.col("skip_reason").isNotNull()
    return rows.select(
        "citation_id", skipped.alias("skipped"), "skip_reason", F.when(skipped, "unclear").otherwise(F.col("x.label")).alias("support_label"),
        F.when(skipped, 0.0).otherwise(F.col("x.score")).alias("support_score"),
    )


def judge_stages(stage1: DataFrame, rows: DataFrame) -> DataFrame:
    """First-stage results as they are, and second-stage results of the citations that those lack."""
    rest = judge(rows.join(stage1.select("citation_id"), "citation_id", "left_anti"))
    return stage1.withColumn("stage", F.lit("stage1")).unionByName(rest.withColumn("stage", F.lit("stage2")))


# -- reports ------------------------------------------------------------------------------------
def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, T.round_half_even(part / whole * 100, 2)).otherwise(0.0)


def counts_in_order(rows: DataFrame, domains: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(kind, value, count, percentage) for each kind's column and each value of its fixed domain, 0 if absent, in one pass; the percentage is of all rows."""
    cells = [(kind, column, v) for kind, (column, domain) in domains.items() for v in domain]
    one = rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == v).alias(f"n{i}") for i, (_, column, v) in enumerate(cells)))
    pairs = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("value"), F.col(f"n{i}").alias("count")) for i, (kind, _, v) in enumerate(cells)))
    return one.select("total", F.explode(pairs).alias("x")).select("x.kind", "x.value", "x.count", percent(F.col("x.count"), F.col("total")).alias("percentage"))


def label_counts(rows: DataFrame) -> DataFrame:
    """(combined_label, count, percentage) of the labels that occur."""
    counted = rows.groupBy("combined_label").agg(F.count("*").alias("count"))
    total = counted.agg(F.sum("count").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("combined_label", "count", percent(F.col("count"), F.col("total")).alias("percentage"))


def subcategory_counts(rows: DataFrame) -> DataFrame:
    """Rows by category and subcategory, a missing one being `unknown`."""
    return rows.groupBy("verification_category", F.coalesce(T.nonempty(F.col("verification_subcategory")), F.lit("unknown")).alias("verification_subcategory")).agg(F.count("*").alias("count"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: all citations, those to review, those with a lexical candidate and those without, and the semantic sums."""
    lexical = F.coalesce(F.col("selected_source") == "lexical", F.lit(False))
    yes = F.count_if(F.col("semantic_label").isin("supported", "partially_supported"))
    return rows.agg(
        F.count("*").alias("total_citations"), F.count_if("needs_review").alias("needs_review_count"), F.count_if(lexical).alias("lexically_verified_count"), F.count_if(~lexical).alias("not_lexically_verified_count"),
        yes.alias("supporting_count"), F.count_if(F.col("semantic_label") == "unsupported").alias("not_supporting_count"), yes.alias("semantically_verified_count"),
    )


def combine(verified: DataFrame, judged: DataFrame) -> DataFrame:
    """Verification with the semantic result, where there is one, and the combined label."""
    rows = verified.join(judged.select("citation_id", F.struct("skipped", "skip_reason", "support_label", "support_score").alias("s")), "citation_id", "left")
    skipped = F.coalesce(F.col("s.skipped"), F.lit(True))
    label = F.lower(F.trim(F.col("s.support_label")))
    rows = rows.withColumn("semantic_skipped", skipped).withColumn("semantic_label", F.when(skipped, "skipped").when(label.isin(LABELS[:4]), label).otherwise("unclear"))
    rows = rows.withColumn("semantic_score", F.coalesce("s.support_score", F.lit(0.0))).withColumn("semantic_skip_reason", F.col("s.skip_reason")).drop("s")
    rows = rows.withColumn("combined_label", M.combined_label(F.coalesce("overall_status", F.lit("ambiguous")), F.col("semantic_label"), F.col("semantic_skipped")))
    return rows.withColumn("needs_review", F.col("combined_label").isin(M.REVIEW_LABELS))


def crosstab(rows: DataFrame) -> DataFrame:
    """Status by label, every cell of both domains."""
    counted = rows.where(F.col("overall_status").isin(STATUSES)).groupBy("overall_status").agg(*(F.count_if(F.col("semantic_label") == v).alias(v) for v in LABELS))
    domain = rows.sparkSession.createDataFrame([(s,) for s in STATUSES], "overall_status string")
    return domain.join(counted, "overall_status", "left").select("overall_status", *(F.coalesce(v, F.lit(0)).alias(v) for v in LABELS))


def source_summary(rows: DataFrame) -> DataFrame:
    """By catalog: rows, mean bibliographic score (null as 0), mean semantic score of judged rows."""
    judged = ~F.col("semantic_skipped")
    return rows.groupBy(F.coalesce("db", F.lit("unknown")).alias("db")).agg(
        F.count("*").alias("count"), T.round_half_even(F.avg(F.coalesce("bibliographic_score", F.lit(0.0))), 4).alias("average_bibliographic_score"),
        T.round_half_even(F.coalesce(F.avg(F.when(judged, F.coalesce("semantic_score", F.lit(0.0)))), F.lit(0.0)), 4).alias("average_semantic_score"),
        *(F.count_if(F.col("overall_status") == v).alias(v) for v in STATUSES), *(F.count_if(F.col("semantic_label") == v).alias(f"semantic_{v}") for v in LABELS),
    )


def review_order() -> list[Column]:
    """Hallucinated first, then ambiguous, then unsupported, then by confidence; ties by citation_id."""
    off = lambda c, v: (~F.coalesce(F.col(c) == v, F.lit(False))).cast("int")
    return [off("overall_status", "hallucinated"), off("overall_status", "ambiguous"), off("semantic_label", "unsupported"), -F.coalesce("overall_confidence", F.lit(0.0)), F.col("citation_id")]


def semantic_summary(rows: DataFrame) -> DataFrame:
    """By stage: judged and skipped rows, and labels as shares of the judged."""
    judged = ~F.col("skipped")
    out = rows.groupBy("stage").agg(
        F.count("*").alias("total_records"), F.count_if(judged).alias("judged_records"), F.count_if("skipped").alias("skipped_records"),
        *(F.count_if(judged & (F.col("support_label") == v)).alias(f"n_{v}") for v in LABELS[:4]),
    )
    yes, whole = F.col("n_supported") + F.col("n_partially_supported"), F.col("judged_records")
    out = out.withColumn("supporting_count", yes).withColumn("supporting_percentage", percent(yes, whole))
    out = out.withColumn("not_supporting_count", F.col("n_unsupported")).withColumn("not_supporting_percentage", percent(F.col("n_unsupported"), whole))
    return out.select("*", *(percent(F.col(f"n_{v}"), whole).alias(f"p_{v}") for v in LABELS[:4]))


def by_citation(rows: DataFrame) -> DataFrame:
    """Results in the order in which they are written: by citation_id, a missing one first."""
    return rows.orderBy(F.coalesce("citation_id", F.lit(-1)))


def stage_metrics(parsed: DataFrame, exact: DataFrame, searched: DataFrame, rows: DataFrame) -> DataFrame:
    """(stage, metric): what each stage shows of itself, from parsed citations, exact_results, lexical_results and combined rows."""
    one = lambda df, *c: df.agg(*(F.count("*").alias("n"), *c))
    counts = one(parsed).select(F.col("n").alias("parsed"))
    for df in (
        one(exact, F.count_if("match_found").alias("exact")).withColumnRenamed("n", "exact_n"), one(searched, F.count_if(~F.col("skipped")).alias("lexical")).withColumnRenamed("n", "lexical_n"),
        one(rows, F.count_if(F.col("overall_status") == "verified").alias("verified"), F.count_if(~F.col("semantic_skipped")).alias("judged"), F.count_if("needs_review").alias("review")),
    ):
        counts = counts.crossJoin(F.broadcast(df))
    show = lambda stage, *parts: F.struct(F.lit(stage).alias("stage"), F.concat(*(F.col(x).cast("string") if x in counts.columns else F.lit(x) for x in parts)).alias("metric"))
    return counts.select(F.explode(F.array(
        show("parse", "parsed", " references found"), show("route", "parsed", " citations routed"), show("exact", "exact", "/", "exact_n", " exact matches"),
        show("lexical", "lexical", "/", "lexical_n", " citations retrieved"), show("verify", "verified", "/", "n", " verified"), show("semantic", "judged", "/", "n", " semantic judgments"),
        show("report", "review", " need review"),
    )).alias("x")).select("x.*")


def log_tail(lines: DataFrame, key: str, order: list[Column], most: int = 40) -> DataFrame:
    """The last lines of each log, as many as are shown."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return lines.withColumn("place", place).where(F.col("place") <= most).drop("place")
