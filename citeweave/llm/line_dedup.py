"""Line dedup: a segment-partition edit join finds lines within a few word edits of each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, _powers, block_links, connected_components, maybe_broadcast, mix, table, text_bytes, wanted_pairs, word_hashes

#: Bytes of texts worked on at once, and lines that a task remembers: both bound a worker's memory, not the result.
_GROUP_BYTES, _SEEN = 1_000_000, 200_000


@dataclass(frozen=True)
class Settings:
    """Lines of at least min_words count; shorter ones are left alone.

    Two lines are alike if at most d words have to be inserted, deleted or replaced, where d goes by the shorter
    one's words: (10, 1) and (20, 2) mean 0 below 10 words, 1 from 10 and 2 from 20.
    """

    min_words: int = 5
    steps: tuple[tuple[int, int], ...] = ((10, 1), (20, 2))
    block_lines: int = 512
    block_words: int = 500_000

    def distance(self, n: np.ndarray) -> np.ndarray:
        out = np.zeros_like(n)
        for least, d in self.steps:
            out[n >= least] = d
        return out


def segment(n: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of part i of lines of n words: parts differ by one word at most, the longer ones last."""
    base, more = n // parts, n % parts
    long_before = np.maximum(0, i - (parts - more))
    return i * base + long_before, base + (i >= parts - more)


def keys_of(sums: np.ndarray, start: np.ndarray, n: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, probe) of all lines that start at a word `start` and have n words.

    sums are prefix sums of a polynomial over the words' hashes, so any substring's hash is one subtraction. A line
    puts its d + 1 segments into the index under its length, and probes the index of its own and every length
    shorter by up to d, at the positions that a pair within d edits can't do without.
    """
    _, down = _powers(len(sums))

    def key(lines: np.ndarray, at: np.ndarray, size: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        first = start[lines] + at
        h = (sums[first + size] - sums[first]) * down[first]
        return mix(mix(h) ^ mix((length * 8 + i).astype(np.uint64)))

    found = []
    for d in sorted({d for _, d in s.steps}):
        for shorter in range(d + 1):
            length = n - shorter
            lines = np.flatnonzero((s.distance(length) == d) & (length >= s.min_words))
            if not len(lines):
                continue
            length = length[lines]
            for i in range(d + 1):
                at, size = segment(length, d + 1, i)
                low, high = max(-i, shorter - (d - i)), min(i, shorter + d - i)
                if shorter == 0:
                    found.append((lines, key(lines, at, size, length, i), np.zeros(len(lines), np.int8)))
                for shift in range(low, high + 1):
                    if shorter == 0 and shift == 0:
                        continue  # that is the line's own segment
                    ok = (at + shift >= 0) & (at + shift + size <= n[lines])
                    some = lines[ok]
                    found.append((some, key(some, (at + shift)[ok], size[ok], length[ok], i), np.ones(len(some), np.int8)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    return tuple(np.concatenate(x) for x in zip(*found))


def line_words(text: str | np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a whole text or its UTF-8 bytes, and for each line the first word and how many it has. Lines end at \\n."""
    b = text if isinstance(text, np.ndarray) else np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    words, starts, _ = word_hashes(b)
    breaks = np.flatnonzero(b == 10)
    ends = np.searchsorted(starts, np.append(breaks, len(b) + 1))
    first = np.concatenate([[0], ends[:-1]])
    return words, first, ends - first


def within(a: np.ndarray, b: np.ndarray, d: int) -> bool:
    """Whether d edits of words turn a into b: a banded bit-parallel automaton, after equal ends are cut off.

    Bit o + d of level e says that, after j words of b, j + o words of a can be matched with e edits.
    """
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > d:
        return False
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return max(len(a), len(b)) <= d
    full = (1 << (2 * d + 1)) - 1
    level = [(full >> (d - e)) & (full << d) & full for e in range(d + 1)]  # deletions before the first word
    for j, word in enumerate(b):
        equal = 0
        for o in range(-d, d + 1):
            if 0 <= j + o < len(a) and a[j + o] == word:
                equal |= 1 << (o + d)
        before = 0  # level e - 1 as it was and as it is
        now = 0
        for e in range(d + 1):
            old = level[e]
            # match keeps the offset, replacement too, insertion lowers it, deletion raises it
            now = ((old & equal) | before | (before >> 1) | (now << 1)) & full
            level[e], before = now, old
        if not any(level):
            return False
    bit = 1 << (len(a) - len(b) + d)
    return any(x & bit for x in level)


def spans(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of an Arrow batch's rows with about _GROUP_BYTES of text each."""
    start, size = 0, 0
    for k, x in enumerate(texts):
        size += x.as_buffer().size if x.is_valid else 0
        if size > _GROUP_BYTES:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow array of lists of these sizes, one after another."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def occurrences(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, h, line, node, more, n, own, probes) of every line that counts.

    node (63 bits) and more (64 bits) stand for the line's words; own and probes are its keys, given with the first of
    equal lines that a task meets, and again after a task has met _SEEN others, so that its memory is bounded.
    """
    names = ["doc_id", "h", "line", "node", "more", "n", "own", "probes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start, end in spans(batch["text"]):
                yield lines_of(batch.slice(start, end - start), seen)

    def lines_of(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
        if len(seen) > _SEEN:
            seen.clear()
        words, firsts, counts, owner, number, base = [], [], [], [], [], 0
        for k, text in enumerate(batch["text"]):
            w, first, n = line_words(text_bytes(text))
            keep = np.flatnonzero(n >= s.min_words)
            words.append(w)
            firsts.append(first[keep] + base)
            counts.append(n[keep])
            number.append(keep)
            owner.append(np.full(len(keep), k))
            base += len(w)
        words, first, n, owner, number = (np.concatenate(x) for x in (words, firsts, counts, owner, number))
        up, down = _powers(len(words) + 1)
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        h = (sums[first + n] - sums[first]) * down[first] + n.astype(np.uint64)
        other = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words + np.uint64(77)) * up[: len(words)], out=other[1:])
        more = mix((other[first + n] - other[first]) * down[first] + n.astype(np.uint64))
        node = (mix(h) >> np.uint64(1)).astype(np.int64)
        distinct, at = np.unique(node, return_index=True)
        new = np.sort(np.array([i for x, i in zip(distinct.tolist(), at.tolist()) if x not in seen], np.int64))
        seen.update(distinct.tolist())
        line, key, probe = keys_of(sums, first[new], n[new], s)
        order = np.argsort(line, kind="stable")
        line, key, probe = line[order], key[order], probe[order]
        columns = [batch["doc_id"].take(pa.array(owner)), batch["h"].take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(node), pa.array(more.view(np.int64)), pa.array(n.astype(np.int32))]
        for kind in (0, 1):
            sizes = np.zeros(len(node), np.int64)
            sizes[new] = np.bincount(line[probe == kind], minlength=len(new))
            columns.append(lists(key[probe == kind], sizes))
        return pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, line int, node long, more long, n int, own array<long>, probes array<long>")


def payload(docs: DataFrame, places: DataFrame, s: Settings) -> DataFrame:
    """(node, words) of the lines at places (doc_id, h, line, node); equal rows give a node again."""
    by_doc = places.groupBy("doc_id", "h").agg(F.collect_list("line").alias("lines"), F.collect_list("node").alias("nodes"))
    rows = docs.select(F.col("doc_id").cast("long").alias("d_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h_"), "text")
    by_doc = maybe_broadcast(by_doc, 96 * places.count())
    rows = rows.join(by_doc, rows["d_"].eqNullSafe(by_doc["doc_id"]) & (rows["h_"] == by_doc["h"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in spans(batch["text"]):
                nodes, sizes, found = [], [], [np.zeros(0, np.uint64)]
                for text, lines, ids in zip(*(batch[c].slice(start, end - start) for c in ("text", "lines", "nodes"))):
                    words, first, n = line_words(text_bytes(text))
                    at = lines.values.to_numpy()
                    nodes.append(ids.values.to_numpy())
                    sizes.append(n[at])
                    found.extend(words[first[k] : first[k] + n[k]] for k in at.tolist())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), lists(np.concatenate(found), np.concatenate(sizes))], ["node", "words"])

    return rows.select("text", "lines", "nodes").mapInArrow(run, "node long, words array<long>")


def pair_links(pairs: DataFrame, s: Settings) -> DataFrame:
    """(a, b) of pairs (a, b, wa, wb) within their distance."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.wa, batch.wb):
                d = int(s.distance(np.array([min(len(x), len(y))]))[0])
                keep.append(within(np.asarray(x), np.asarray(y), d))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def split_hot(members: DataFrame, s: Settings) -> DataFrame:
    """Members (grp, node, own, n, words) of hot groups, dealt into groups that share a rare word; no pair is lost.

    An edit costs a line one of its distinct words at most, so of the d + 1 words of a line that are rarest in
    its group, one is among the d + 1 rarest of every line within d edits.
    """
    words = members.select("grp", "node", "n", F.explode(F.array_distinct("words")).alias("word"))
    words = words.join(words.groupBy("grp", "word").agg(F.count("*").alias("lines")), ["grp", "word"])
    most = F.lit(1) + sum(F.when(F.col("n") >= n, F.lit(d - before)).otherwise(0) for (n, d), (_, before) in zip(s.steps, ((0, 0), *s.steps)))
    rarest = F.row_number().over(Window.partitionBy("grp", "node").orderBy("lines", "word"))
    chosen = words.withColumn("r", rarest).where((F.col("r") <= most) & (F.col("lines") > 1)).select("grp", "node", F.xxhash64("grp", "word").alias("part"))
    return members.join(chosen, ["grp", "node"]).select(F.col("part").alias("grp"), "node", "own", "n", "words")


def group_links(scratch: Scratch, members: DataFrame, s: Settings, label: str) -> DataFrame:
    """Links (a, b) of an own line and any other inside groups of (grp, node, own, n, words), by block_links."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("lines"), F.sum("n").alias("total"), F.min("node").alias("rep")).where("lines > 1")
    blocks = F.greatest(F.ceil(F.col("lines") / s.block_lines), F.ceil(F.col("total") / s.block_words)).cast("int")

    def alike(g: dict, side: np.ndarray | None, comp: np.ndarray | None) -> Iterator[tuple[int, int]]:
        words = [np.asarray(x) for x in g["words"]]
        n = np.array([len(x) for x in words])
        d = s.distance(np.minimum(n[:, None], n[None, :]))
        own = np.array(g["own"], bool)
        hit = wanted_pairs(len(n), side, comp) & (np.abs(n[:, None] - n[None, :]) <= d) & (own[:, None] | own[None, :])
        if len(n) > 12:  # an edit costs a line one of its distinct words at most
            common, size = common_words(words)
            hit &= np.maximum(size[:, None], size[None, :]) - common <= d
        for x, y in np.argwhere(hit).tolist():
            if within(words[x], words[y], int(d[x, y])):
                yield x, y

    return block_links(scratch, members, sizes.select("grp", blocks.alias("blocks"), "rep"), alike, label)


def common_words(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct words each two of the lines share, and how many each has."""
    distinct = [np.unique(x) for x in words]
    size = np.array([len(x) for x in distinct])
    owner = np.repeat(np.arange(len(words)), size)
    _, col, count = np.unique(np.concatenate(distinct), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    owner, col = owner[shared], np.unique(col[shared], return_inverse=True)[1]
    common = np.zeros((len(words), len(words)), np.float32)
    width = 1024
    for low in range(0, int(col.max()) + 1 if len(col) else 0, width):
        part = (col >= low) & (col < low + width)
        m = np.zeros((len(words), min(width, int(col.max()) + 1 - low)), np.float32)
        m[owner[part], col[part] - low] = 1
        common += m @ m.T
    return common, size


def useful_keys(lines: DataFrame) -> DataFrame:
    """(key) of the keys that an index line and another line have; a hot key is summed before it is shuffled."""
    every = key_rows(lines).groupBy("key").agg(F.min("probe").alias("kind"), F.min("node").alias("low"), F.max("node").alias("high"))
    return every.where("kind = 0 and low != high").select("key")


def key_rows(lines: DataFrame) -> DataFrame:
    """(key, node, probe) of all keys of the lines; probe is 0 for an index line."""
    own, probes = (lines.select(F.explode(c).alias("key"), "node", F.lit(k).alias("probe")) for k, c in enumerate(("own", "probes")))
    return own.unionAll(probes)


def repeated_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, h, lines, n_removed): for rows (doc_id, text hash h) the 0-based lines that an earlier line makes redundant.

    Lines that are equal word by word, or linked within the settings' distance, are one class (a connected
    component of links); of each class the first line stays, by doc_id (null first), text hash and line. Rows that agree in
    doc_id and text are treated alike. Equal lines collapse before anything is compared. The index lines of a key
    meet each other and all its probes, exactly and in blocks; a hot key is first split by its lines' rare words. An empty
    table has none.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.save(occurrences(docs, s), "lines")
    at = F.struct("doc_id", "h", "line")
    exact = scratch.save(lines.groupBy("node", "more").agg(F.min(at).alias("first"), F.count("*").alias("lines")), "exact")
    useful = scratch.save(useful_keys(lines), "useful")
    keyed = key_rows(lines).join(maybe_broadcast(useful, 32 * useful.count()), "key").groupBy("key", "node").agg((F.min("probe") == 0).alias("own"))
    keyed = scratch.save(keyed, "keyed")
    sizes = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("lines"), F.min("node").alias("a"), F.max("node").alias("b")), "sizes")
    places = exact.join(keyed.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("first").alias("first")).select("node", "first.*")
    words = scratch.save(payload(docs, scratch.save(places, "places"), s).dropDuplicates(["node"]), "words")
    pairs = sizes.where("lines = 2").select("a", "b").distinct()
    pairs = pairs.join(words.selectExpr("node a", "words wa"), "a").join(words.selectExpr("node b", "words wb"), "b")
    links = scratch.save(pair_links(pairs.select("a", "b", "wa", "wb"), s), "pairs")
    larger = keyed.join(sizes.where("lines > 2").select("key", "lines"), "key").join(words, "node")
    larger = larger.select(F.col("key").alias("grp"), "node", "own", F.size("words").alias("n"), "words", "lines")
    hot = F.col("lines") > s.block_lines
    links = links.unionAll(group_links(scratch, larger.where(~hot).drop("lines"), s, "warm"))
    if not sizes.where(hot).isEmpty():
        parts = scratch.save(split_hot(larger.where(hot).drop("lines"), s), "parts")
        links = links.unionAll(group_links(scratch, parts, s, "hot"))
    classes = connected_components(scratch, links, "classes")
    exact = exact.join(classes, "node", "left").withColumn("more_", F.when(F.col("comp").isNull(), F.col("more"))).withColumn("comp", F.coalesce("comp", "node"))
    firsts = exact.groupBy("comp", "more_").agg(F.min("first").alias("first"), F.sum("lines").alias("lines")).where("lines > 1").select(F.struct("comp", "more_").alias("k"), "first")
    redundant = exact.select("node", "more", F.struct("comp", "more_").alias("k")).join(firsts, "k").select("node", "more", "first")
    redundant = scratch.save(redundant, "redundant")
    redundant = maybe_broadcast(redundant, 96 * redundant.count())
    gone = lines.select("node", "more", "doc_id", "h", "line").join(redundant, ["node", "more"]).where(at != F.col("first"))
    by_doc = gone.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return scratch.finish(by_doc.withColumn("n_removed", F.size("lines").cast("long")), "gone")


def without(text: str | None, gone: np.ndarray | None) -> str | None:
    """A text without the lines of these numbers; null where there are none."""
    if gone is None:
        return None
    gone = set(gone.tolist())
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def dedup_lines(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Every row with its text without the lines that repeat an earlier one, plus n_removed.

    Other columns stay as they are; columns named n_removed are replaced. A row all of whose lines go keeps an
    empty text; null texts stay null; lines shorter than min_words stay. An empty table stays empty.
    """
    gone = repeated_lines(docs, s)
    size = gone.agg(F.sum(F.lit(64) + 4 * F.col("n_removed"))).first()[0] or 0
    gone = maybe_broadcast(gone.selectExpr("doc_id g_", "h gh_", "lines gone_", "n_removed gn_"), size)
    kept = [c for c in docs.columns if c.lower() != "n_removed"]
    rows = docs.select(F.struct(*kept).alias("row"), F.col("doc_id").cast("long").alias("d_"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h_"))
    rows = rows.join(gone, F.col("d_").eqNullSafe(F.col("g_")) & (F.col("h_") == F.col("gh_")), "left")

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, gone in batches:
            yield pd.Series([without(x, y) for x, y in zip(texts, gone)], dtype=object)

    cut = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)
    hit = F.col("gone_").isNotNull()
    rows = rows.withColumn("cut_", cut(F.when(hit, F.col("row.text")), "gone_"))  # texts that stay whole aren't sent
    text = F.when(hit, F.col("cut_")).otherwise(F.col("row.text"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept), F.coalesce("gn_", F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (before), n_removed, n_chars (after) for every row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    before = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    out = dedup_lines(docs.select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(before).alias("n_lines")))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that repeat an earlier one taken out; none goes."""
    return dedup_lines(docs).select(*docs.columns)
