"""MinHash near-dedup: DartMinHash signatures, banded candidates, exact word-shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import Forest, Scratch, block_links, by_group, connected_components, maybe_broadcast, mix, shingles, table, text_bytes, wanted_pairs, word_hashes

_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """A pair at the threshold shares no band with probability (1 - 0.8^rows)^bands, 5e-6 here.

    loose: estimated similarity from which documents are compared as one group; a pair at the threshold lies 14 deviations
    above it.
    """

    shingle: int = 5
    threshold: float = 0.8
    rows: int = 6
    bands: int = 40
    loose: float = 0.42
    block_docs: int = 512
    block_shingles: int = 1_000_000
    seed: int = 41

    @property
    def k(self) -> int:
        return self.rows * self.bands


def cells_of(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit cells that weighted elements fill, and how full each is; an element's first cell is named as itself."""
    cells = np.ceil(weights).astype(np.int64)
    at = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    names = np.repeat(elements, cells)
    more = at > 0
    names[more] = mix(names[more] + at[more].astype(np.uint64) * _GOLD)
    return names, np.minimum(np.repeat(weights, cells) - at, 1.0)


def darts(elements: list[np.ndarray], s: Settings, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """DartMinHash of many weighted sets: the rank of the earliest dart in each of k coordinates, by set.

    Over each unit cell of an element's weight lies a Poisson process of darts, seeded by the cell; a dart
    has a rank, a place within the cell and a coordinate, and counts if the cell is filled up to its place. Only darts up to the rank
    at which a set of that total weight expects k ln k + 2k of them are thrown, so a long document costs no more than a short one
    besides its hashing. Sets that then lack a coordinate throw on to twice the rank. An empty set has infinite ranks.
    """
    out = np.full((len(elements), s.k), np.inf)
    todo = [j for j, e in enumerate(elements) if len(e)]
    reach = s.k * (np.log(s.k) + 2)
    while todo:
        unit, full, owner, limit = [], [], [], []
        for j in todo:
            names, filled = cells_of(elements[j], weights[j]) if weights is not None else (elements[j], np.ones(len(elements[j])))
            unit.append(names)
            full.append(filled)
            owner.append(np.full(len(names), j))
            limit.append(np.full(len(names), reach / filled.sum()))
        unit, full, owner, limit = (np.concatenate(x) for x in (unit, full, owner, limit))
        whole = bool((full == 1).all())
        rank, step, flat = np.zeros(len(unit)), 0, out.reshape(-1)
        while len(unit):
            step += 1
            h = mix(unit + np.uint64((step * 0xD1B54A32D192ED03 + s.seed) & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            live = rank <= limit
            unit, owner, limit, rank, h = unit[live], owner[live], limit[live], rank[live], h[live]
            at = owner * s.k + (mix(h + _GOLD) % np.uint64(s.k)).astype(np.int64)
            if whole:
                np.minimum.at(flat, at, rank)
            else:
                full = full[live]
                hit = (mix(h ^ _GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < full
                np.minimum.at(flat, at[hit], rank[hit])
        todo = [j for j in todo if np.isinf(out[j]).any()]
        reach *= 2
    return out


def weighted_shingles(text: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a whole text, and how often each occurs."""
    found, counts = np.unique(shingles(word_hashes(text)[0], s.shingle), return_counts=True)
    return found, counts.astype(np.float64)


def band_keys(ranks: np.ndarray, s: Settings) -> np.ndarray:
    """A 64-bit key for each band."""
    bits = np.ascontiguousarray(ranks).view(np.uint64).reshape(len(ranks), s.bands, s.rows)
    key = np.arange(s.bands, dtype=np.uint64)[None, :] * _GOLD + np.uint64(s.seed)
    for r in range(s.rows):
        key = mix(key ^ bits[:, :, r]) + _GOLD
    return key.view(np.int64)


def sketch(ranks: np.ndarray) -> np.ndarray:
    """A byte for each coordinate, to estimate similarities with."""
    return (mix(np.ascontiguousarray(ranks).view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def text_key(text: str) -> list[Column]:
    """128 bits that stand for a whole text; null and empty texts are alike."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")]


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, h1, h2, n, bands, sketch): n is the number of shingles, 0 for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, sets, size = 0, [], 0
            for k, text in enumerate(batch.column("text")):
                sets.append(weighted_shingles(text_bytes(text), s))
                size += len(sets[-1][0])
                if size > 300_000 or k == len(batch) - 1:
                    yield signed(batch.slice(start, k + 1 - start), sets)
                    start, sets, size = k + 1, [], 0

    def signed(batch: pa.RecordBatch, sets: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ranks = darts([e for e, _ in sets], s, [w for _, w in sets])
        n = np.array([int(w.sum()) for _, w in sets], np.int64)
        some = np.where(n > 0, s.bands, 0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32))
        bands = pa.ListArray.from_arrays(offsets, pa.array(band_keys(ranks[n > 0], s).reshape(-1)))
        sketches = pa.array([x.tobytes() if k else b"" for x, k in zip(sketch(ranks), n.tolist())], pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(n), bands, sketches], ["doc_id", "h1", "h2", "n", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), *text_key("text"), "text").mapInArrow(run, "doc_id long, h1 long, h2 long, n long, bands array<long>, sketch binary")


def loose_links(pairs: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that connect whatever the rows (a, b, sa, sb) whose sketches agree often enough do.

    A text meets the representatives of all its bands. Of the links in a batch of texts a forest is left, so there are
    about as many links as texts, whatever the number of bands that a group of near copies shares.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(batch), s.k) for c in (batch.sa, batch.sb))
                yield batch.loc[(x == y).mean(axis=1) >= s.loose, ["a", "b"]]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, at = np.unique(batch[["a", "b"]].to_numpy(), return_inverse=True)
            forest = Forest(len(names))
            yield batch[[forest.join(x, y) for x, y in at.reshape(-1, 2).tolist()]]

    schema = "a long, b long"
    return pairs.mapInPandas(run, schema).repartition("b").sortWithinPartitions("b", "a").mapInPandas(thin, schema)


def bucket_links(members: DataFrame, sketches: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) in buckets of members (key, node, comp, linked) between components, by sketch and block by block.

    Members linked to their bucket's representative are one component already, so the others meet each other and
    them, but they don't meet among themselves.
    """
    n = F.count_if(~F.col("linked")), F.count_if("linked")
    sizes = members.groupBy("key").agg(*(F.ceil(x / s.block_docs).cast("int").alias(c) for x, c in zip(n, ("loose", "tight"))))
    place = F.when(F.col("linked"), F.col("loose") + F.pmod(F.xxhash64("node"), F.col("tight"))).otherwise(F.pmod(F.xxhash64("node"), F.col("loose"))).cast("int")
    placed = members.join(sizes.where("loose > 0"), "key").withColumn("block", place)
    last = F.when(F.col("linked"), F.col("loose")).otherwise(F.col("loose") + F.col("tight")) - 1
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last))).join(sketches, "node")
    dealt = placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "sketch")

    def work(g: dict) -> list[tuple[int, int]]:
        nodes, comp, block = g["node"], np.array(g["comp"]), np.array(g["block"])
        x = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(nodes), s.k)
        forest, out = Forest(len(nodes)), []
        for k in np.flatnonzero(block == g["i"][0]).tolist():
            other = comp != comp[k]
            other &= np.arange(len(nodes)) > k if g["i"][0] == g["j"][0] else block == g["j"][0]
            other = np.flatnonzero(other)
            for y in other[(x[other] == x[k]).mean(axis=1) >= s.loose].tolist():
                if forest.join(k, y):
                    out.append((nodes[k], nodes[y]))
        return out

    return by_group(dealt, ["key", "i", "j"], "node", work, "a long, b long")


def similar(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None, comp: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i, j), i < j, of sets of cells whose Jaccard similarity reaches the threshold, as wanted_pairs limits them."""
    size = np.array([len(x) for x in sets], np.float32)
    wanted = wanted_pairs(len(sets), side, comp)
    if len(sets) <= 6:  # small groups are many
        pairs = [(i, j, len(np.intersect1d(sets[i], sets[j], assume_unique=True))) for i, j in np.argwhere(wanted).tolist()]
        return np.array([(i, j) for i, j, c in pairs if c >= threshold * (size[i] + size[j] - c) - 1e-3], int).reshape(-1, 2)
    at = np.repeat(np.arange(len(sets)), size.astype(int))
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[col] > 1
    at, col = at[keep], np.unique(col[keep], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    at, col = at[order], col[order]
    cut = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + 4096, 4096))
    for k in range(len(cut) - 1):
        part = slice(cut[k], cut[k + 1])
        if cut[k + 1] > cut[k]:
            m = np.zeros((len(sets), 4096), np.float32)
            m[at[part], col[part] - k * 4096] = 1
            common += m @ m.T
    union = size[:, None] + size[None, :] - common
    # in whole numbers: common / union >= threshold
    return np.argwhere(wanted & (common >= threshold * union - 1e-3))


def group_links(scratch: Scratch, members: DataFrame, s: Settings, label: str) -> DataFrame:
    """Exact links (a, b) inside the groups of members (grp, node, n, cells), by block_links."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("docs"), F.sum("n").alias("total"), F.min("node").alias("rep")).where("docs > 1")
    blocks = F.greatest(F.ceil(F.col("docs") / s.block_docs), F.ceil(F.col("total") / s.block_shingles)).cast("int")

    def alike(g: dict, side: np.ndarray | None, comp: np.ndarray | None) -> list:
        return similar([np.asarray(x, np.int64) for x in g["cells"]], s.threshold, side, comp).tolist()

    return block_links(scratch, members, sizes.select("grp", blocks.alias("blocks"), "rep"), alike, label)


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, h1, h2, class_id, class_size) for every row: rows of one class are copies or linked near copies.

    Two texts are linked if the weighted Jaccard similarity of their 5-word shingles (of all their words, where they
    have fewer), each weighing as often as it occurs, is 0.8 or more; a class is a connected component of links. class_id is the least
    doc_id of the class, class_size its number of rows. Equal texts are one class whatever their number; a null or wordless text
    has no shingles and its rows, equal or not, are classes of their own with their own doc_id. Null doc_ids are borne: a class whose
    rows all have none has a null class_id. Repeated rows are copies of each other. An empty table has no rows.

    Copies collapse before anything is compared, so a group of copies of any size counts as one text. Members
    of a bucket meet its least one first, then all that aren't linked to it yet; those whose sketches are alike form groups,
    and each group is compared exactly in blocks.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.save(signatures(docs, s), "rows")
    texts = rows.where("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    texts = scratch.save(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    bands = texts.select("node", F.explode("bands").alias("key"))
    reps = scratch.save(bands.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("size")).where("size > 1"), "reps")
    stars = scratch.save(bands.join(reps, "key").where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    slim = texts.select("node", "sketch")
    pairs = stars.join(slim.selectExpr("node a", "sketch sa"), "a").join(slim.selectExpr("node b", "sketch sb"), "b")
    links = scratch.save(loose_links(pairs.select("a", "b", "sa", "sb"), s), "loose")
    first = connected_components(scratch, links, "first").withColumnRenamed("comp", "c")
    met = bands.join(reps.where("size > 2"), "key").join(first, "node", "left").select("key", "node", "rep", F.coalesce("c", "node").alias("comp"))
    met = met.join(first.select(F.col("node").alias("rep"), F.col("c").alias("rc")), "rep", "left")
    met = scratch.save(met.select("key", "node", "comp", (F.col("comp") == F.coalesce("rc", "rep")).alias("linked")), "met")
    again = scratch.save(bucket_links(met, slim, s), "again")
    stars_of = first.where("node != c").select(F.col("node").alias("a"), F.col("c").alias("b"))  # they connect what the links do
    groups = first if again.isEmpty() else connected_components(scratch, stars_of.unionAll(again), "groups").withColumnRenamed("comp", "c")
    wanted = scratch.save(texts.join(groups, "node").select(F.col("c").alias("grp"), "node", "n", "h1", "h2", "least"), "wanted")
    keys = maybe_broadcast(wanted.select("h1", "h2", "least", "node"), 64 * wanted.count())

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch.node, "cells": [cells_of(*weighted_shingles(x, s))[0].view(np.int64) for x in batch.text]})

    full = docs.select(F.col("doc_id").cast("long"), *text_key("text"), "text").join(keys, ["h1", "h2"]).where("doc_id <=> least")
    full = full.select("node", "text").mapInPandas(cells, "node long, cells array<long>").dropDuplicates(["node"])
    members = scratch.save(full.join(wanted.select("grp", "node", "n"), "node").select("grp", "node", "n", "cells"), "members")
    classes = connected_components(scratch, group_links(scratch, members, s, "blocks"), "classes")
    named = texts.select("node", "h1", "h2", "least", "copies").join(classes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    by_class = named.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    named = named.join(by_class, "comp").select("h1", "h2", "class_id", "class_size", F.lit(True).alias("known"))
    out = rows.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    out = out.select(
        "doc_id", "h1", "h2", F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("known"), F.col("class_size")).otherwise(F.lit(1)).alias("class_size"),
    )
    return scratch.finish(out, "found")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, class_size, kept (the one document of its class that stays) for every row of documents."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the least doc_id; repeated rows of it stay once.

    The rows that go are few beside those that stay, so documents are matched against them alone.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    key, stays = ["doc_id", "h1", "h2"], F.col("doc_id").eqNullSafe(F.col("class_id"))
    gone = found.where(~stays).select(*key).distinct()
    again = found.where(stays & (F.col("class_size") > 1)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    n_gone, n_again = gone.count(), again.count()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("d_"), *[c.alias(f"{n}_") for c, n in zip(text_key("text"), "xy")])

    def matched(keys: DataFrame, n: int, how: str) -> DataFrame:
        k = maybe_broadcast(keys, 64 * n)
        return rows.join(k, rows["d_"].eqNullSafe(k["doc_id"]) & (rows["x_"] == k["h1"]) & (rows["y_"] == k["h2"]), how)

    out = matched(gone.unionAll(again), n_gone + n_again, "left_anti").select("row.*")
    if not n_again:
        return out
    first = F.row_number().over(Window.partitionBy("d_", "x_", "y_").orderBy("row"))
    return out.unionAll(matched(again, n_again, "left_semi").withColumn("i_", first).where("i_ = 1").select("row.*"))
