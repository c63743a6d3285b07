"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import draw, held_out, maybe_broadcast, table

_LETTER = re.compile(r"[^\W\d_]")
_PIECE = 1 << 18
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """rows_per_language and sample_rows bound the training sample; with more languages than fill it at that, each gives fewer rows."""

    buckets: int = 1 << 15
    dims: int = 12
    orders: tuple[int, ...] = (2, 3, 4)
    rows_per_language: int = 400
    sample_rows: int = 16_000
    epochs: int = 30
    rate: float = 0.5
    seed: int = 11
    accepted_share: float = 0.99


def _codes(text: str, buckets: int, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of a whole lower-cased text, in pieces that share their borders."""
    text = " " + text.lower() + " "
    context = max(orders) - 1
    for at in range(0, len(text), _PIECE):
        from_ = max(0, at - context)
        points = np.frombuffer(text[from_ : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in orders:
            first = max(0, at - from_ - n + 1)  # the n-gram's last character lies in this piece
            if len(points) - n + 1 <= first:
                continue
            h = np.full(len(points) - n + 1 - first, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(n):
                h = (h ^ points[first + i : len(points) - n + 1 + i]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            yield (h * np.uint32(0x85EBCA6B) >> np.uint32(8)) % np.uint32(buckets)


def counts(text: str, s: Settings) -> np.ndarray:
    """Counts of all subword buckets of a whole text."""
    out = np.zeros(s.buckets, np.int64)
    for codes in _codes(text, s.buckets, s.orders):
        out += np.bincount(codes, minlength=s.buckets)
    return out


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    table: np.ndarray  # a bucket's embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its probability, and whether that reaches the calibrated threshold."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        total, n = np.zeros(len(self.languages)), 0
        for codes in _codes(text, self.settings.buckets, self.settings.orders):
            total += self.table[codes].sum(axis=0, dtype=np.float64)
            n += len(codes)
        logits = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], s: Settings) -> Model:
    """Trains on (language, buckets, counts) rows; a fifth of them sets temperature and threshold."""
    languages = sorted({lang for lang, _, _ in rows})
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 0.1, (s.buckets, s.dims)).astype(np.float32)
    w, b = np.zeros((s.dims, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    if len(languages) > 1:
        w = rng.normal(0, 0.3, w.shape).astype(np.float32)
    data = [(languages.index(lang), i, c / c.sum()) for lang, i, c in rows if len(i)]
    order = rng.permutation(len(data))
    tune, train = order[: len(data) // 5], order[len(data) // 5 :]
    for epoch in range(s.epochs if len(languages) > 1 else 0):
        rate = s.rate * (1 - epoch / s.epochs)
        for k in rng.permutation(train):
            y, i, c = data[k]
            weights = c.astype(np.float32)
            h = weights @ emb[i]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            b -= rate * p
            emb[i] -= (rate * len(i) ** 0.5) * np.outer(weights, back)
    folded = (emb @ w).astype(np.float32)
    logits = np.array([data[k][2] @ folded[data[k][1]] + b for k in tune]).reshape(len(tune), len(languages))
    y = np.array([data[k][0] for k in tune], int)

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    t = min((0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0), key=loss) if len(y) else 1.0
    threshold = 0.0
    if len(y):
        z = logits / t
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
        threshold = float(right[int((1 - s.accepted_share) * len(right))]) if len(right) else 0.0
    return Model(s, languages, folded, b.astype(np.float64), t, threshold)


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learns from at most rows_per_language distinct rows of every language: those with the least hash of id and text.

    Executors count the subwords of the whole sampled texts, so the driver gets a bounded table.
    """
    usable = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    usable = usable.withColumn("h", F.xxhash64("text"))
    chosen = draw(usable, "lang", ["doc_id", "h"], s.rows_per_language, s.sample_rows, s.seed)
    sample = usable.join(maybe_broadcast(chosen, 64 * s.sample_rows), ["doc_id", "lang", "h"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [counts(x, s) for x in batch.text]
            hit = [np.flatnonzero(c) for c in found]
            yield pd.DataFrame({"doc_id": batch.doc_id, "h": batch.h, "lang": batch.lang, "i": [i.astype(np.int32) for i in hit], "c": [c[i].astype(np.int32) for c, i in zip(found, hit)]})

    got = sample.mapInPandas(count, "doc_id long, h long, lang string, i array<int>, c array<int>").dropDuplicates(["lang", "doc_id", "h"]).toPandas()
    got = got.sort_values(["lang", "doc_id", "h"], kind="stable")
    rows = [(lang, np.array(i), np.array(c)) for lang, i, c in zip(got.lang, got.i, got.c)]
    return fit(rows, s)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (0 to 1) and accepted to every row; only the text is read for them.

    A null text, or one without a letter, gets `und`, 0.0 and false. Other texts always get the best learned
    language; accepted is false if its probability is under the calibrated threshold. Every row gives one row,
    repeated ones too; any column may be null; existing columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(x) for x in texts], columns=["lang_pred", "score", "accepted"])

    udf = F.pandas_udf(predict, "lang_pred string, score double, accepted boolean", F.PandasUDFType.SCALAR_ITER)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "accepted")]
    return docs.select(*kept, udf("text").alias("p_")).select(*kept, "p_.lang_pred", "p_.score", "p_.accepted")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out("doc_id")))
    out = identify(docs.select("doc_id", "text", held_out("doc_id").alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")
