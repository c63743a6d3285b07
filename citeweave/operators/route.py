"""Routing: which catalogs a citation is looked up in, and how."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import text as T

# Keywords by field.
ARXIV = ["arxiv", "arxiv preprint", "arxiv e-prints"]
NLP = ["acl", "emnlp", "naacl", "eacl", "coling", "tacl", "computational linguistics"]
CS = [
    "neurips", "nips", "icml", "iclr", "aaai", "ijcai", "kdd", "www", "sigir", "sigmod", "vldb", "cvpr", "iccv", "eccv", "usenix", "ndss", "oakland", "ccs",
    "transformer", "language model", "large language model", "neural", "machine learning", "deep learning", "security", "attack", "benchmark", "vision",
]
BIOMED = [
    "clinical", "medicine", "medical", "oncology", "genetics", "genome", "biology", "bioinformatics", "cell", "cancer", "protein", "patient", "pmid", "pmc",
    "disease", "therapy", "diagnosis", "biomarker",
]


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any word is a substring of the lower-cased text with single spaces; the text is normalised once."""
    return T.normalize_text(text).rlike("|".join(map(re.escape, words))) if words else F.lit(False)


def route(title: Column, venue: Column, raw: Column, doi: Column, arxiv_id: Column, url: Column, nlp=NLP, cs=CS, biomed=BIOMED) -> Column:
    """(db_priority, run_exact_match, run_lexical_retrieval, run_dense_retrieval, confidence): the first case that holds."""
    every = F.concat_ws(" ", venue, title, raw)
    arxiv_like = T.nonempty(arxiv_id).isNotNull() | F.coalesce(F.contains(F.lower(url), F.lit("arxiv.org")), F.lit(False)) | contains_any(F.concat_ws(" ", venue, raw), ARXIV)
    nlp_like = contains_any(every, nlp)
    cs_like = nlp_like | contains_any(every, cs)
    bio, has = contains_any(every, biomed), T.nonempty(doi).isNotNull()

    def plan(dbs: str, exact: Column, confidence: Column) -> Column:
        return F.struct(
            F.array(*map(F.lit, dbs.split())).alias("db_priority"), exact.alias("run_exact_match"), F.lit(True).alias("run_lexical_retrieval"),
            F.lit(True).alias("run_dense_retrieval"), confidence.alias("confidence"),
        )

    yes = F.lit(True)
    return (
        F.when(arxiv_like, plan("arxiv openalex dblp", yes, F.lit(0.95))).when(has & cs_like, plan("dblp openalex arxiv", yes, F.lit(0.90)))
        .when(has & bio, plan("openalex arxiv dblp", yes, F.lit(0.90))).when(cs_like, plan("dblp openalex arxiv", has, F.when(nlp_like, 0.82).otherwise(0.78)))
        .when(bio, plan("openalex arxiv dblp", has, F.lit(0.78))).otherwise(plan("openalex dblp arxiv", has, F.lit(0.55)))
    )
