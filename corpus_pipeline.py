"""The corpus pipeline: five operators, one after another, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeweave.llm.common import Scratch
from citeweave.llm.decontaminate import stage_decontaminate
from citeweave.llm.line_dedup import stage_line_dedup
from citeweave.llm.minhash import stage_near_dedup
from citeweave.llm.mixing import stage_mix
from citeweave.llm.quality_classifier import stage_quality

#: Each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality", stage_quality),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
]

#: Learned scores, hashed signatures and latent spaces have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again, and removed when the next one's are written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.finish(stage(spark, docs, sf_dir), name)
    return docs
