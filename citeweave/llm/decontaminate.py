"""Benchmark decontamination: latent semantic retrieval, then longest common subsequences and answers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, maybe_broadcast, table, text_bytes, word_hashes


@dataclass(frozen=True)
class Settings:
    """A passage of the benchmark is two blocks of words; every block but the first and last lies in two passages. A stretch of a
    document is three, so that whatever stands in as many words as a passage, wherever it begins, is whole in one of them.

    A stretch and a passage are compared if they share as many distinct words as any two must of which one has `least` of the other's
    words: a little under `maybe`, as what stands between an item's words may reach beyond a stretch.
    They are candidates from a cosine of `cosine` in the latent space on, or where the document's has the share `covers` of the
    benchmark's length there; that share doesn't fall with the weight of what stands beside an item. Passages of whose squared length
    the space keeps less than `kept` are not judged by it: all that share the words go on to the next step.
    A document holds an item if their longest common subsequence covers `sure` of the item's words, or `maybe` of
    them and the item's last answer_words in a row.
    """

    block: int = 24
    buckets: int = 1 << 18
    rank: int = 128
    oversample: int = 16
    powers: int = 2
    least: float = 0.45
    cosine: float = 0.25
    covers: float = 0.35
    kept: float = 0.5
    cells: int = 2_000_000  # pairs of blocks and passages counted at once; bounds memory, not the result
    sure: float = 0.7
    maybe: float = 0.5
    answer_words: int = 5
    max_words: int = 1_000_000  # of the benchmark, which is broadcast with its index (some 200 MB then); a larger one is refused
    seed: int = 31


def _codes(words: np.ndarray, s: Settings) -> np.ndarray:
    return (words >> np.uint64(20)).astype(np.int64) % s.buckets


def distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted, each once; for short arrays sorting is cheaper than hashing."""
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def document_frequencies(docs: DataFrame, s: Settings) -> tuple[np.ndarray, int]:
    """In how many documents each bucket of words occurs, and how many documents have words; over all documents.

    Each task returns a row for each bucket it met, at most; the driver gets one for each bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(s.buckets, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                codes = distinct(_codes(word_hashes(text_bytes(text))[0], s))
                total[codes] += 1
                n += len(codes) > 0
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1).astype(np.int32)), pa.array(np.append(total[hit], n))], ["b", "n"])

    got = docs.select("text").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(s.buckets, np.int64)
    known = got[got.b >= 0]
    out[known.b.to_numpy()] = known.n.to_numpy()
    return out, int(got.n[got.b == -1].sum())


def weights_of(df: np.ndarray, n: int) -> np.ndarray:
    """The weight of each bucket of words; none is 0."""
    return (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)


def passages(words: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """(start, end) of the passages of an item: as long as two blocks, a block apart, the last one at its end."""
    size = 2 * s.block
    if len(words) <= size:
        return [(0, len(words))]
    starts = [*range(0, len(words) - size, s.block), len(words) - size]
    return [(x, x + size) for x in starts]


@dataclass
class Index:
    """The benchmark: its items, an inverted index of its passages' rarer words, and the latent space with the passages' unit vectors in it."""

    items: list[tuple[int, np.ndarray]]
    owner: np.ndarray  # the item of each passage
    need: np.ndarray  # indexed words that a passage must share with it
    starts: np.ndarray  # by bucket of words, where its postings begin
    posts: np.ndarray  # passages
    row: np.ndarray  # bucket to row of the basis, or -1
    basis: np.ndarray  # rows by rank, times the words' weights
    queries: np.ndarray  # passages by rank
    norms: np.ndarray  # the length of each passage there before it was made a unit vector
    judged: np.ndarray  # whether the space keeps enough of a passage to judge it


def indexed_words(codes: np.ndarray, df: np.ndarray, s: Settings) -> tuple[np.ndarray, int]:
    """The distinct words of a passage without its commonest ones, and how many of them any passage with `least` of its words has."""
    distinct, times = np.unique(codes, return_counts=True)
    order = np.argsort(-df[distinct], kind="stable")
    distinct, times = distinct[order], times[order]
    must = int(np.ceil(s.least * len(codes)))
    left_out = int(np.searchsorted(np.cumsum(times), must // 2, "right"))
    most = np.cumsum(np.sort(times[left_out:])[::-1])  # the words that occur most often make up the rest with the fewest
    return distinct[left_out:], int(np.searchsorted(most, must - int(times[:left_out].sum()))) + 1


def randomised_svd(rows: DataFrame, n_cols: int, rank: int, s: Settings) -> np.ndarray:
    """The leading right singular vectors (n_cols by rank) of the distributed matrix (cols, vals), by power iteration.

    The rows stay where they are; each pass sums the partitions' A^T (A X), which are n_cols by rank, a stretch of columns at a time.
    """
    rng = np.random.default_rng(s.seed)
    width, stretch = min(n_cols, rank + s.oversample), 4096
    x = np.linalg.qr(rng.normal(size=(n_cols, width)))[0]

    def project(x: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(x)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(shared.value)
            for batch in batches:
                for cols, vals in zip(batch.cols, batch.vals):
                    total[cols] += np.outer(vals, vals @ shared.value[cols])
            for at in range(0, n_cols, stretch):
                if total[at : at + stretch].any():
                    yield pd.DataFrame({"at": [at], "m": [total[at : at + stretch].tobytes()]})

        total = np.zeros_like(x)
        for r in rows.mapInPandas(run, "at int, m binary").toLocalIterator():  # one partition's sums at a time
            total[r.at : r.at + stretch] += np.frombuffer(r.m).reshape(-1, width)
        shared.destroy()
        return total

    for _ in range(s.powers):
        x = np.linalg.qr(project(x))[0]
    values, vectors = np.linalg.eigh(x.T @ project(x))
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-30)]
    return x @ vectors[:, order]


def tf_idf_rows(scratch: Scratch, benchmark: DataFrame, idf: np.ndarray, vocabulary: np.ndarray, s: Settings) -> DataFrame:
    """(cols, vals): the unit TF-IDF vectors of the benchmark's passages over its vocabulary."""
    shared = benchmark.sparkSession.sparkContext.broadcast((idf, vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, vocabulary = shared.value
        for batch in batches:
            words = [w for w in (word_hashes(x)[0] for x in batch.text) if len(w)]
            codes = [np.unique(_codes(w[a:b], s)) for w in words for a, b in passages(w, s)]
            yield pd.DataFrame({"cols": [np.searchsorted(vocabulary, c) for c in codes], "vals": [idf[c].astype(float) / np.linalg.norm(idf[c]) for c in codes]})

    rows = benchmark.select("text").repartition(max(1, -(-benchmark.count() // 256))).mapInPandas(run, "cols array<long>, vals array<double>")
    rows = scratch.save(rows, "passages")
    shared.unpersist()
    return rows


def index_of(scratch: Scratch, benchmark: DataFrame, df: np.ndarray, n: int, s: Settings) -> Index | None:
    """The index of a benchmark (item_id, text); none if it has no words."""
    items, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = word_hashes(r.text)[0]
        size += len(words)
        if size > s.max_words:
            raise ValueError(f"the benchmark has more than {s.max_words} words")
        if len(words):
            items.append((r.item_id, words))
    if not items:
        return None
    idf = weights_of(df, n)
    found = [(k, _codes(w[a:b], s)) for k, (_, w) in enumerate(items) for a, b in passages(w, s)]
    rare = [indexed_words(c, df, s) for _, c in found]
    word = np.concatenate([c for c, _ in rare])
    posts = np.repeat(np.arange(len(found), dtype=np.int32), [len(c) for c, _ in rare])[np.argsort(word, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=s.buckets))]).astype(np.int64)
    vocabulary = np.unique(np.concatenate([c for _, c in found]))
    row = np.full(s.buckets, -1, np.int32)
    row[vocabulary] = np.arange(len(vocabulary))
    basis = randomised_svd(tf_idf_rows(scratch, benchmark, idf, vocabulary, s), len(vocabulary), min(s.rank, len(found)), s)
    basis = (basis * idf[vocabulary][:, None]).astype(np.float32)
    queries = np.stack([basis[row[np.unique(c)]].sum(axis=0) for _, c in found])
    norms = np.linalg.norm(queries, axis=1)
    queries /= np.maximum(norms, 1e-12)[:, None]
    judged = norms**2 >= s.kept * np.array([np.sum(idf[np.unique(c)] ** 2) for _, c in found])
    return Index(items, np.array([k for k, _ in found]), np.array([m for _, m in rare]), starts, posts, row, basis, queries, norms, judged)


def candidates(words: np.ndarray, ix: Index, s: Settings) -> list[tuple[int, int, float]]:
    """(item, stretch's start, cosine) of the document's stretches and the benchmark's passages that are alike enough to be compared."""
    n_passages, width = len(ix.owner), 3 * s.block
    size = max(4, s.cells // n_passages) * s.block
    if len(words) > size + width:  # a part has the first blocks of the next one too
        starts = range(0, len(words) - 2 * s.block, size)
        return [(k, at + start, c) for at in starts for k, start, c in candidates(words[at : at + size + 2 * s.block], ix, s)]
    codes = _codes(words, s)
    n = max(1, -(-len(words) // s.block) - 2)  # stretches; words of block b lie in those from b - 2 to b
    known = np.flatnonzero(ix.starts[codes + 1] > ix.starts[codes])
    place = known // s.block * s.buckets + codes[known]
    place = distinct(np.concatenate([place - back * s.buckets for back in range(3)]))
    place = place[np.searchsorted(place, 0) : np.searchsorted(place, n * s.buckets)]
    stretch, code = place // s.buckets, place % s.buckets
    hits = ix.starts[code + 1] - ix.starts[code]
    nth = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
    met = np.repeat(stretch, hits) * n_passages + ix.posts[np.repeat(ix.starts[code], hits) + nth]
    shared = np.bincount(met, minlength=n * n_passages).reshape(n, n_passages)
    out, latent, at = [], None, -1
    for start, j in np.argwhere(shared >= ix.need).tolist():
        if start != at:
            at, rows = start, ix.row[distinct(codes[start * s.block : start * s.block + width])]
            latent = ix.basis[rows[rows >= 0]].sum(axis=0)
        product = float(latent @ ix.queries[j])
        cosine = product / max(float(np.linalg.norm(latent)), 1e-12)
        if not ix.judged[j] or cosine >= s.cosine or product >= s.covers * ix.norms[j]:
            out.append((int(ix.owner[j]), start * s.block, cosine))
    return out


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: one big integer has a bit for each word of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def holds(item: np.ndarray, words: np.ndarray, start: int, s: Settings) -> tuple[float, bool]:
    """Share of the item's words in the document's stretch round a candidate, and whether its answer is there.

    The stretch begins where most of the words that both have would put the item's first word.
    """
    low, high = max(0, start - len(item)), min(len(words), start + 3 * s.block + len(item))
    near = words[low:high]
    order = np.argsort(item, kind="stable")
    left, right = np.searchsorted(item[order], near), np.searchsorted(item[order], near, "right")
    hit = np.flatnonzero(right > left)
    if len(hit) < s.maybe * len(item):  # too few words for any order of them
        return 0.0, False
    once = np.flatnonzero(right == left + 1)  # words that the item has once
    if not len(once):
        once = hit
    offset = int(np.median(once - order[left[once]]))
    slack = 2 + len(item) // 6
    stretch = near[max(0, offset - slack) : max(0, offset + len(item) + slack)]
    share = lcs(item.tolist(), stretch.tolist()) / len(item)
    answer = item[-min(s.answer_words, len(item)) :]
    n = len(answer)
    there = any((stretch[k : k + n] == answer).all() for k in range(len(stretch) - n + 1))
    return share, there


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, h, item_id, cosine, share, answer) for every document and item that it holds; h hashes the text.

    Whole texts are searched. Null and empty texts hold nothing; null or empty items are held by none, and equal
    items each count. A null doc_id or item_id is borne; repeated rows give equal rows; empty tables have no leaks. Words are compared
    as they are. Memory is bounded by the benchmark, which is refused above max_words, and one document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    df, n = document_frequencies(docs, s)
    shared = spark.sparkContext.broadcast(index_of(scratch, benchmark, df, n, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            at, item, rest = [], [], []
            for place, text in enumerate(batch.column("text")):
                words = word_hashes(text_bytes(text))[0]
                best: dict[int, tuple[float, float, bool]] = {}
                for k, start, cosine in candidates(words, ix, s) if ix is not None and len(words) else ():
                    if best.get(k, (0, 0.0, False))[1] == 1:
                        continue
                    share, answer = holds(ix.items[k][1], words, start, s)
                    best[k] = max(best.get(k, (0.0, -1.0, False)), (cosine, share, answer), key=lambda x: (x[1], x[2], x[0]))
                for k, (cosine, share, answer) in best.items():
                    if share >= s.sure or share >= s.maybe and answer:
                        at.append(place)
                        item.append(ix.items[k][0])
                        rest.append((cosine, share, answer))
            at = pa.array(at, pa.int64())
            columns = [batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(item, pa.int64())]
            columns += [pa.array([x[c] for x in rest], t) for c, t in enumerate((pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "item_id", "cosine", "share", "answer"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, item_id long, cosine double, share double, answer boolean")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, share, answer, cosine for every document and benchmark item that it holds."""
    out = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "share", "answer", "cosine")


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with the columns they came with."""
    found = leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select("doc_id", "h").distinct()
    found = Scratch(spark, "leaks").save(found, "leaks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("d_"), F.xxhash64("text").alias("h_"))
    found = maybe_broadcast(found, 48 * found.count())
    return rows.join(found, rows["d_"].eqNullSafe(found["doc_id"]) & (rows["h_"] == found["h"]), "left_anti").select("row.*")
