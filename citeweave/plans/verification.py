"""The whole verification, a stage at a time; each stage's rows are a written table, as in a batch pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.operators import catalog as C
from citeweave.operators import report as R
from citeweave.operators.route import route
from citeweave.session import shared_folder

#: The stages in their order; each name is a key of what run_stages returns.
STAGES = ["route", "exact", "fuse_stage1", "lexical", "fuse_stage2", "verify", "semantic", "report"]


def run_stages(citations: DataFrame, records: DataFrame, posted: DataFrame | None = None, contexts: DataFrame | None = None, upto: str = "report", folder: str | None = None) -> dict[str, DataFrame]:
    """The relation of every stage up to one of STAGES, each written as Parquet under a folder (a new one in the shared folder by default) and read again.

    Later stages read what earlier ones found several times over, so without a table they would search again each time. citations: citation_id, title, authors, year, venue, raw, doi, url, arxiv_id. records: candidate columns. contexts: (citation_id, lines);
    without them the semantic stage skips all for want of a context.
    """
    last, spark = STAGES.index(upto), citations.sparkSession
    folder = folder or shared_folder(spark, "stages")

    def save(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    plan = route(*(F.col(c) for c in ("title", "venue", "raw", "doi", "arxiv_id", "url")))
    ids = F.coalesce(*(T.extract_arxiv_id(F.col(x)) for x in ("arxiv_id", "raw", "url")))
    c = save("citations", citations.withColumn("plan", plan).select(*(x for x in citations.columns if x != "arxiv_id"), ids.alias("arxiv_id"), "plan.*").withColumn("words", T.build_query_words(F.col("title"), F.col("raw"))))
    out = {"route": c.select("citation_id", "db_priority", "run_exact_match", "run_lexical_retrieval", "run_dense_retrieval", "confidence")}
    if last >= 1:
        out["exact"] = exact = save("exact", C.exact_results(c, C.best_exact(c, records)))
    if last >= 2:
        out["fuse_stage1"] = R.fuse(c, exact)
    if last >= 3:
        rest = save("rest", c.where("run_lexical_retrieval").join(exact.where("match_found").select("citation_id"), "citation_id", "left_anti"))
        scored = save("scored", C.lexical_scored(rest, records, C.lexical_hits(rest, records, C.postings(records) if posted is None else posted)))
        merged = save("candidates", C.cascade(scored, citations=rest))
        out["lexical"] = save("lexical", C.lexical_results(c, exact, scored, merged))
    if last >= 4:
        out["fuse_stage2"] = fused = save("fused", R.fuse(c, exact, merged, out["lexical"]))
    if last >= 5:
        oai = [T.extract_arxiv_id(F.col("oai_identifier"))] if "oai_identifier" in records.columns else []
        cand = records.select(
            "db", "record_id", *(F.col(x).alias(f"c_{x}") for x in ("title", "authors", "year", "doi", "url")), "abstract",
            F.coalesce(T.extract_arxiv_id(F.col("record_id")), T.extract_arxiv_id(F.col("url")), *oai).alias("c_arxiv"),
        )
        pairs = fused.join(cand, ["db", "record_id"], "left").withColumn("has_candidate", F.col("record_id").isNotNull())
        pairs = pairs.join(c.select("citation_id", *(F.col(x).alias(f"p_{x}") for x in ("title", "authors", "year", "doi", "url")), F.col("arxiv_id").alias("p_arxiv")), "citation_id")
        out["verify"] = save("verify", R.verify(pairs).join(fused.select("citation_id", "db"), "citation_id"))
    if last >= 6:
        lines = contexts.select("citation_id", "lines") if contexts is not None else c.select("citation_id", F.array().cast("array<string>").alias("lines"))
        asked = pairs.select("citation_id", "has_candidate", "abstract", F.col("p_title").alias("title")).join(lines, "citation_id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
        out["semantic"] = R.by_citation(save("semantic", R.judge(asked)))
    if last >= 7:
        out["report"] = R.combine(out["verify"], out["semantic"])
    return out


def verify_citations(citations: DataFrame, records: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """Routes, matches, retrieves, fuses and verifies citations against candidate records."""
    return run_stages(citations, records, posted, upto="verify")["verify"]
