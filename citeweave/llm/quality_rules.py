"""Quality rules: counts on words and lines, and a hashed n-gram log-likelihood ratio (native)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import BLANKS, Scratch, maybe_broadcast, quantile, table


@dataclass(frozen=True)
class Settings:
    """A document is kept if its ratio reaches the score that trusted_loss of the trusted documents lie under, less slack."""

    buckets: int = 1 << 14
    trusted_loss: float = 0.005
    slack: float = 0.03


def words_of(text: str) -> Column:
    """The words of a whole text; a null has none."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def base_columns(words: str, text: str) -> dict[str, Column]:
    """The counts that the rules read, from the words and the text."""
    w, t = F.col(words), F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.translate(t, BLANKS, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def windows_of(words: str) -> Column:
    """(hash, position) of every 3-word window, sorted."""
    w = F.col(words)
    at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p"))))


def repeated_starts(sorted_windows: str) -> Column:
    """Positions, in order, of the windows whose hash a neighbour in the sorted list has too."""
    s = F.col(sorted_windows)
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    return F.sort_array(F.transform(again, lambda x: x["p"]))


def covered(starts: str) -> Column:
    """Words that lie in a window of three that begins at one of the positions."""
    q = F.col(starts)
    gaps = F.transform(q, lambda x, i: F.least(F.coalesce(F.get(q, i + 1) - x, F.lit(3)), F.lit(3)))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")


def gram_buckets(words: str, s: Settings) -> Column:
    """Buckets of all words and word pairs."""
    w = F.col(words)
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(s.buckets)).cast("int"))
    at = F.when(F.size(w) >= 2, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
    two = F.transform(at, lambda i: F.pmod(F.xxhash64(w[i - 1], w[i]), F.lit(s.buckets)).cast("int"))
    return F.concat(one, two)


def trusted_ids(scratch: Scratch, trusted: DataFrame) -> DataFrame:
    """The distinct ids of all trusted documents, broadcast where they are few."""
    ids = scratch.save(trusted.where("doc_id is not null").select("doc_id").distinct(), "trusted")
    return maybe_broadcast(ids, 64 * ids.count())


def log_ratios(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """One row with an array of log(target / raw) by bucket, of smoothed multinomials over all documents.

    The raw counts cover every document, the target counts every document whose id is in `ids`, which has each once.
    There are at most `buckets` counts, whatever the input.
    """
    flagged = docs.select("doc_id", "text").join(ids.withColumn("good", F.lit(True)), "doc_id", "left")
    grams = flagged.select("good", words_of("text").alias("w_")).select("good", F.explode(gram_buckets("w_", s)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    both = (
        docs.sparkSession.range(s.buckets).select(F.col("id").cast("int").alias("b"))
        .join(counts, "b", "left")
        .select("b", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "good")))
    )
    rows = F.array_sort(F.collect_list(F.struct("b", "raw", "good")))
    total = both.agg(rows.alias("r"), F.sum("raw").alias("n_raw"), F.sum("good").alias("n_good"))
    return total.select(
        F.when(
            F.col("n_good") == 0, F.transform("r", lambda x: F.lit(0.0))
        ).otherwise(
            F.transform("r", lambda x: F.log((x["good"] + 1) / (F.col("n_good") + s.buckets)) - F.log((x["raw"] + 1) / (F.col("n_raw") + s.buckets)))
        ).alias("ratios")
    )


def apply_rules(docs: DataFrame, trusted: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept to every row.

    llr is the mean log ratio of a document's words and word pairs; a text without words has 0. kept is false if
    base_failed, else llr >= the threshold. Without trusted documents every llr is 0 and all that pass the base
    are kept. A null text has no words. Every row gives one row; other columns may be null or clash (replaced).
    """
    scratch = Scratch(docs.sparkSession, "rules")
    ids = trusted_ids(scratch, trusted)
    ratios = scratch.save(log_ratios(docs, ids, s), "ratios")
    ratios.createOrReplaceTempView(view := f"ratios_{uuid.uuid4().hex}")
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    kept = [c for c in docs.columns if c.lower() not in new]
    lookup = F.expr(f"(select ratios from {view})")
    out = docs.select(*kept, words_of("text").alias("w_"))
    out = out.select("*", windows_of("w_").alias("s_"), gram_buckets("w_", s).alias("g_"), lookup.alias("r_"))
    total = F.aggregate("g_", F.lit(0.0), lambda a, b: a + F.col("r_")[b])
    out = out.select(*kept, "w_", repeated_starts("s_").alias("q_"), F.coalesce(total / F.nullif(F.size("g_"), F.lit(0)), F.lit(0.0)).alias("llr"))
    out = out.select(*kept, *(c.alias(k) for k, c in base_columns("w_", "text").items()), covered("q_").alias("n_repeat_words"), "llr")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold(scratch, docs, ids, view, s)))
    docs.sparkSession.catalog.dropTempView(view)  # the plan has it
    return out


def threshold(scratch: Scratch, docs: DataFrame, ids: DataFrame, view: str, s: Settings) -> float:
    """The exact trusted_loss quantile of the ratios of all trusted documents, less slack."""
    own = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select(words_of("text").alias("w_")).select(gram_buckets("w_", s).alias("g_"), F.expr(f"(select ratios from {view})").alias("r_"))
    # a filter on g_ would be pushed below and compute the words anew for each of them
    scores = own.select(F.when(F.size("g_") >= 50, F.aggregate("g_", F.lit(0.0), lambda a, b: a + F.col("r_")[b]) / F.size("g_")).alias("x"))
    found = quantile(scratch.save(scores, "scores"), s.trusted_loss)
    return float("-inf") if found is None else found - s.slack


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict for every row of documents; documents labelled as good are the trusted target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = apply_rules(docs, trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
