"""Mixing sources to target weights: capped water-filling, whole and fractional repetitions (native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import WORD, Scratch, maybe_broadcast, table


@dataclass(frozen=True)
class Settings:
    """Weights go to the sources in code point order (null last), over and over."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    budget: float = 1.5  # of all sizes
    epochs: float = 2.0  # of a source at most
    buckets: int = 1 << 14
    seed: int = 17


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, s: Settings) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so windows over all of them are small.

    The level is where sources with the least cap for their weight stand at their caps and the rest share what
    is left by weight: what resharing the excess until none is above its cap comes to.
    """
    weights = F.array(*map(F.lit, s.weights))
    ranked = sources.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(weights, F.pmod("i", F.lit(len(s.weights))))).withColumn("cap", s.epochs * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    before, all_rows = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = (
        ranked.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (s.budget * F.sum("source_size").over(all_rows) - F.col("full")) / F.col("rest"))
    )
    # the first source that the level does not lift to its cap sets the level of all that follow
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("i"), F.col("level")))).over(all_rows)
    return filled.withColumn("at", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("at")["level"] * F.col("weight")), F.col("cap")).alias("target")
    )


def mix(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and repeats of every row.

    A document is taken floor(target / source_size) whole times. The words still missing come from the source's
    documents in a seeded order, whole ones until the target is reached; the last of them gives only the words
    still missing, so a source's taken words equal its target rounded. The order hashes id and text: reruns agree, and
    rows that repeat each other are interchangeable. repeats is taken / size. A null or empty text has size 0 and
    taken 0; a null source is a source of its own; an empty table stays empty. A bucket of hashes, not a source,
    is the unit of ordering, so a source with a third of all rows is spread over many tasks.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    h = F.xxhash64("doc_id", "text", F.lit(s.seed))
    base = scratch.save(docs.select("doc_id", "source", size_of("text").alias("size"), h.alias("h")), "sizes")
    bucket = F.pmod(F.shiftrightunsigned("h", 20), F.lit(s.buckets)).alias("bucket")
    buckets = scratch.save(base.groupBy("source", bucket).agg(F.sum("size").alias("n")), "buckets")
    plan = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), s)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("quota", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    plan = plan.select(F.struct("source").alias("key"), "source_size", "target", "whole", "quota")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = buckets.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.struct("source").alias("key"), "bucket", "n", "before")
    # the bucket in which the quota ends; its documents alone are ordered
    last = plan.join(filled, "key").where("before < quota and quota < before + n").groupBy("key").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("last"))
    plan = scratch.save(plan.join(last, "key", "left"), "plan")
    # a row for each source: documents meet it without being dealt by source
    size = plan.agg(F.sum(F.lit(128) + F.coalesce(F.octet_length("key.source"), F.lit(0)))).first()[0] or 0
    plan = maybe_broadcast(plan, size)
    rows = base.select("*", bucket, F.struct("source").alias("key")).join(plan, "key")
    edge = F.col("bucket") == F.col("last.bucket")
    inner = Window.partitionBy("key").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.where(edge).withColumn("earlier", F.col("last.before") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    at_edge = at_edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("earlier"))))
    others = rows.where(~F.coalesce(edge, F.lit(False))).withColumn(
        "part", F.when(F.col("last").isNotNull(), F.col("bucket") < F.col("last.bucket")).otherwise(F.lit(None)).cast("int")
    )
    # without such a bucket the quota ends between two buckets: those that lie before it are taken
    ends = filled.join(plan.where("last is null"), "key").where("before + n <= quota").groupBy("key").agg(F.max("bucket").alias("end"))
    others = others.join(maybe_broadcast(ends, size), "key", "left").withColumn("part", F.col("size") * F.coalesce(F.col("part"), (F.col("bucket") <= F.col("end")).cast("int"), F.lit(0)))
    cols = ["doc_id", "source", "size", "h", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken")]
    out = others.select(*cols).unionAll(at_edge.select(*cols))
    return out.withColumn("repeats", F.coalesce(F.col("taken") / F.nullif("size", F.lit(0)), F.lit(0.0))).drop("h")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and repeats for every row of documents."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (the words that the mix takes) of every document."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")
