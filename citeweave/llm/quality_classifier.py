"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, around, by_group, held_out, maybe_broadcast, mix, table, word_hashes


@dataclass(frozen=True)
class Settings:
    """All labelled rows are learned from, in blocks of about rows_per_label of either label; pairs are drawn from a block in each epoch."""

    rows_per_label: int = 1500
    pairs: int = 40_000
    buckets: int = 256
    epochs: int = 6
    rate: float = 0.3
    l2: float = 1e-4
    seed: int = 5


#: Fixed: classes of bytes that features count.
CLASSES = [b"#*$%&<>", b"|", b"!", b".", b",", b"?;:", b"0123456789", b"\n", b" \t", b"=_/\\@", b"'\"()[]{}-"]
_CLASS_OF = np.full(256, len(CLASSES) + 2, np.uint8)  # bytes of other characters
_CLASS_OF[ord("a") : ord("z") + 1] = len(CLASSES)
_CLASS_OF[ord("A") : ord("Z") + 1] = len(CLASSES) + 1
for _i, _chars in enumerate(CLASSES):
    _CLASS_OF[list(_chars)] = _i
N_CLASSES = len(CLASSES) + 3
N_DENSE = N_CLASSES + 9


def features(text: str | None, s: Settings) -> np.ndarray:
    """Rates of byte classes, of repeats among words and lines, and of hashed class trigrams; a null is empty."""
    text = text or ""
    out = np.zeros(N_DENSE + s.buckets, np.float64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words, starts, ends = word_hashes(text)
    n = len(words)
    out[N_CLASSES] = len(b) ** 0.1
    if not n:
        out[N_CLASSES + 1] = 1
        return out
    kinds = _CLASS_OF[b]
    out[:N_CLASSES] = np.sqrt(np.bincount(kinds, minlength=N_CLASSES) / len(b))
    lines = [x for x in text.split("\n") if x.strip()]
    last, first = kinds[ends - 1], kinds[starts]
    windows = n - len(np.unique(words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7))) - 2 if n > 2 else 0
    out[N_CLASSES + 2 : N_DENSE] = (
        len(np.unique(words)) / n,
        (1 - len(set(lines)) / len(lines)) if lines else 0,
        max(0, windows) / n,
        np.mean(last == 0),
        np.mean(last == 2),
        np.mean((first == 1) & (ends - starts == 1)),
        min(np.mean(ends - starts) / 10, 3),
    )
    k = kinds.astype(np.uint64)
    grams = mix((k[:-2] * np.uint64(N_CLASSES) + k[1:-1]) * np.uint64(N_CLASSES) + k[2:] + np.uint64(1)) % np.uint64(s.buckets)
    if len(grams):
        out[N_DENSE:] = np.sqrt(np.bincount(grams.astype(np.int64), minlength=s.buckets) / len(grams))
    return out


@dataclass
class Model:
    settings: Settings
    weights: np.ndarray
    centre: np.ndarray
    cut: float  # the raw score at the quantile
    scale: float

    def score(self, text: str | None) -> float:
        raw = float((features(text, self.settings) - self.centre) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip((raw - self.cut) / self.scale, -30, 30))))


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> Model:
    """Logistic loss on the feature difference of (better, worse) pairs; the cut is the quantile at the share of label 0."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    centre = x.mean(axis=0) if len(x) else np.zeros(N_DENSE + s.buckets)
    w = np.zeros(N_DENSE + s.buckets)
    if not len(good) or not len(bad):  # nothing to compare: all score 0.5, or as the only label says
        return Model(s, w, centre, -1.0 if len(good) and not len(bad) else 1.0 if len(bad) else 0.0, 1.0)
    rng = np.random.default_rng(s.seed)
    sums = np.zeros_like(w)
    for _ in range(s.epochs):
        a, b = rng.choice(good, s.pairs), rng.choice(bad, s.pairs)
        for k in range(0, s.pairs, 64):
            d = x[a[k : k + 64]] - x[b[k : k + 64]]
            g = -(1 / (1 + np.exp(np.clip(d @ w, -30, 30)))) @ d / len(d) + s.l2 * w
            sums += g * g
            w -= s.rate * g / np.sqrt(sums + 1e-8)
    raw = np.sort((x - centre) @ w)
    at = min(max(len(bad), 1), len(raw) - 1)
    return Model(s, w, centre, float((raw[at - 1] + raw[at]) / 2), float(max(raw.std(), 1e-6) / 4))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from all labelled documents; their features stay with the executors, which send the driver a block's weights each.

    The rows are dealt into blocks by hash, each block learns from its own pairs, and the weights are the mean of the
    blocks'. Rows of the rarer label are in as many blocks as it takes for either label to come to as many rows. The cut is the
    exact quantile of all labelled documents' raw scores at the share of quality 0 among all labelled rows given, either
    label weighing as it does among these. Repeated rows count once.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    known = scratch.save(known, "known")
    n, share = known.agg(F.count("*"), F.avg(1.0 - F.col("quality"))).first()
    rows = docs.select("doc_id", "text").join(maybe_broadcast(known, 64 * n), "doc_id")

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "quality": batch.quality, "f": [features(x, s).tobytes() for x in batch.text]})

    rows = scratch.save(rows.mapInPandas(compute, "doc_id long, quality int, f binary").distinct(), "features")
    counts = rows.agg(F.count_if(F.col("quality") == 0), F.count_if(F.col("quality") == 1)).first()
    most = max(counts)
    if not min(counts):  # nothing to compare
        return fit(np.zeros((min(most, 1), N_DENSE + s.buckets)), np.array([int(counts[1] > 0)][:most]), s)
    blocks = -(-most // s.rows_per_label)
    copies = [min(blocks, round(most / c)) for c in counts]
    nth = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 0, copies[0]).otherwise(copies[1]) - 1)).alias("nth")
    dealt = rows.select("*", nth).select("doc_id", "quality", "f", F.pmod(F.xxhash64("doc_id", "f", F.lit(s.seed)) + F.col("nth"), F.lit(blocks)).cast("int").alias("block"))

    def learn(g: dict) -> list[tuple]:
        order = sorted(range(len(g["f"])), key=lambda k: (g["doc_id"][k], g["f"][k]))
        x = np.frombuffer(b"".join(g["f"][k] for k in order), float).reshape(len(order), -1)
        y = np.array([g["quality"][k] for k in order])
        m = fit(x, y, s)
        return [(g["block"][0], m.weights.tobytes(), m.centre.tobytes())] if 0 < y.sum() < len(y) else []

    learned = sorted(tuple(r) for r in by_group(dealt, ["block"], "doc_id", learn, "block int, w binary, c binary").collect())
    weights, centre = (np.mean([np.frombuffer(r[k]) for r in learned], axis=0) for k in (1, 2))

    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch.f), float).reshape(len(batch), -1)
                yield pd.DataFrame({"x": (x - centre) @ weights, "y": batch.quality})

    scores = scratch.save(rows.select("quality", "f").mapInPandas(raw, "x double, y int"), "scores")
    low, high = around(scores, (share / counts[0], (1 - share) / counts[1]), share - 1e-9)
    scale = max(scores.agg(F.stddev_pop("x")).first()[0], 1e-6) / 4
    for label in list(scratch.labels):
        scratch.drop(label)
    return Model(s, weights, centre, (low + high) / 2, float(f"{scale:.12g}"))  # sums of other partitions may differ in the last digits


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5) to every row; only the text is read for them.

    Null and empty texts are scored as texts without words. Any column may be null; repeated rows stay; existing
    columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(x) for x in texts], dtype=float)

    udf = F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    out = docs.select(*kept, udf("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    out = classify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", "predicted")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, with the columns they came with."""
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return classify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model).where("predicted = 1").select("row.*")
