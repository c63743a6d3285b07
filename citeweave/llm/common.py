"""Shared pieces: scratch tables in the shared folder, vectorised word hashes, graph components."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.session import ship

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"

_MUL1, _MUL2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_S33 = np.uint64(33)
_CHUNK = 1 << 20


# -- tables -------------------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python by bytes, so that long texts don't fill a worker; a value that the session sets stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a temporary one is set, in local mode alone: no other executor would see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="citeweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_TIDIED = [0.0]


def tidy(spark: SparkSession, seconds: float = 5.0) -> None:
    """Has the driver collect its garbage, so that Spark's cleaner drops the shuffle files and broadcasts of plans that are done, on all executors.

    Otherwise they stay until the driver's heap is full, which a driver of an operator of many small steps seldom is. What
    the driver's native code has freed goes back too.
    """
    if time.monotonic() - _TIDIED[0] > seconds:
        spark._jvm.java.lang.System.gc()
        trim(spark)
        _TIDIED[0] = time.monotonic()


def trim(spark: SparkSession) -> str | None:
    """Gives back the native memory that the driver's JVM has freed and that malloc keeps for each of its hundreds of threads; what the JVM says of it.

    Called by reflection, as the server's class is not open to py4j. None where a JVM has no such command.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    of, names = jvm.java.lang.Class.forName, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, name in enumerate(names):
        kinds[k] = of(name)
    try:
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        values[2], values[3] = array(jvm.java.lang.Object, 1), array(jvm.java.lang.String, 1)
        values[2][0], values[3][0] = array(jvm.java.lang.String, 0), names[3]
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return of("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, values)
    except Py4JError:
        return None


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        bound_batches(spark)
        self.spark, self.base, self.labels = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.base}/{label}"
        df.write.option("parquet.block.size", _ROW_GROUP).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(path)
        self.labels.append(label)
        tidy(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        """Removes a table that nothing reads any more."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{label}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        self.labels.remove(label)

    def finish(self, df: DataFrame, label: str) -> DataFrame:
        """Saves a result and removes all tables that it was made from."""
        before = list(self.labels)
        out = self.save(df, label)
        for x in before:
            self.drop(x)
        return out


#: Bytes that a task's Parquet writer gathers at most, and bytes of rows that are broadcast at most.
_ROW_GROUP, BROADCAST = 32 << 20, 16 << 20


def maybe_broadcast(df: DataFrame, size: int) -> DataFrame:
    """Hints a broadcast only if the counted bytes are within the bound; else Spark shuffles."""
    return F.broadcast(df) if size <= BROADCAST else df


def held_out(doc_id) -> Column:
    """crc32 of the id's text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def draw(rows: DataFrame, group: str, key: list[str], most: int, total: int, seed: int) -> DataFrame:
    """(group, *key) of distinct rows of every group: those with the least hash of key, `most` of each at most.

    With so many groups that they come to more than `total` rows, each gives fewer, but one at least. The distinct rows of a
    group, counted by a sketch, first bound the hash, so that the wanted rows and a margin of eight deviations and a tenth
    are expected under it. The window that ranks them thus gets as few rows of a hot group as of a small one, and rows
    that repeat don't count.
    """
    place = F.xxhash64(*key, F.lit(seed))
    sizes = rows.groupBy(group).agg(F.approx_count_distinct(place, 0.02).alias("n_"))
    groups = sizes.count()
    most = max(1, min(most, total // max(groups, 1)))
    u = place.cast("double") / 2.0**64 + 0.5
    near = rows.select(group, *key).join(maybe_broadcast(sizes, groups * 64), group).withColumn("u_", u)
    near = near.where(F.col("u_") * F.col("n_") < 1.1 * (most + 8 * most**0.5 + 16))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("u_", *key))
    return near.drop("n_").distinct().withColumn("r_", rank).where(F.col("r_") <= most).select(group, *key)


# -- order --------------------------------------------------------------------------------------
def around(values: DataFrame, weights: tuple[float, float], target: float, most: int = 20_000) -> tuple[float, float] | None:
    """Of all rows (x, y), y being 0 or 1, in their order: the x at which the sum of weights[y] reaches target, and the next row's x.

    Exact, over any number of rows: bins of x are counted, and the bin where target is reached is divided again, until at most
    `most` rows or equal ones are left. The last row has none after it and gives its own x; a null x doesn't count.
    """
    rows = values.where("x is not null")
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n:
        return None
    before, after, parts = 0.0, None, 4096
    while n > most and low < high:
        part = F.least(F.floor((F.col("x") - low) / (high - low) * parts), F.lit(parts - 1)).cast("int").alias("part")
        counted = rows.where(F.col("x").between(low, high)).groupBy(part)
        found = counted.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).orderBy("part").collect()
        for k, r in enumerate(found):
            here = r.n0 * weights[0] + r.n1 * weights[1]
            if before + here >= target or k == len(found) - 1:
                break
            before += here
        low, high, n, after = r.low, r.high, r.n0 + r.n1, found[k + 1].low if k + 1 < len(found) else after
    found = sorted(tuple(r) for r in rows.where(F.col("x").between(low, high)).groupBy("x", "y").count().collect())
    for k, (x, y, n) in enumerate(found):
        if before + n * weights[y] >= target or k == len(found) - 1:
            break
        before += n * weights[y]
    if n > 1 and before + (n - 1) * weights[y] >= target:
        return x, x
    following = found[k + 1][0] if k + 1 < len(found) else after
    return x, x if following is None else following


def quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of the column x, between two rows in proportion; none without values. Values are read more than once."""
    values = values.select("x", F.lit(1).alias("y")).where("x is not null")
    at = share * max(values.count() - 1, 0)
    found = around(values, (0.0, 1.0), int(at) + 1)
    return None if found is None else found[0] + (at - int(at)) * (found[1] - found[0])


# -- hashes -------------------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = x ^ (x >> _S33)
    x = x * _MUL1
    x = x ^ (x >> _S33)
    x = x * _MUL2
    return x ^ (x >> _S33)


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, _CHUNK)
        inverse = pow(_BASE, -1, 1 << 64)
        for i, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


_IS_WORD_BYTE = np.ones(256, bool)
_IS_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False


def _chunk_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _IS_WORD_BYTE[b]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _MUL1), starts, ends


def text_bytes(value: pa.Scalar) -> np.ndarray:
    """The UTF-8 bytes of an Arrow text, without a copy; none of a null."""
    return np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)


def word_hashes(text: str | np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a whole text or its UTF-8 bytes, and where they start and end in these."""
    b = text if isinstance(text, np.ndarray) else np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if len(b) <= _CHUNK:
        return _chunk_words(b)
    parts, at = [], 0
    while at < len(b):
        end = min(len(b), at + _CHUNK)
        while end < len(b):  # cut where white space is
            gap = np.flatnonzero(~_IS_WORD_BYTE[b[end : end + _CHUNK]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(b), end + _CHUNK)
        h, s, e = _chunk_words(b[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashes, sorted, of the word n-grams; a shorter text has one shingle of all its words."""
    return np.unique(shingles(words, n))


def shingles(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the word n-grams in their order."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = (out + words[i : len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15 + 2 * i)
        out ^= out >> np.uint64(29)
    return mix(out)


# -- groups -------------------------------------------------------------------------------------
class Forest:
    """Union-find over the positions of a group: only links between trees are kept."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        p, q = self.find(x), self.find(y)
        self.root[max(p, q)] = min(p, q)
        return p != q


def by_group(df: DataFrame, keys: list[str], order: str, work: Callable, schema: str) -> DataFrame:
    """work(rows of one group, as a dict of lists) gives rows of schema; many small groups share one Arrow batch.

    Groups arrive sorted, so a task holds one group at a time.
    """
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {n: [] for n in names}
        at, out = None, []
        for batch in batches:
            ids = list(zip(*(batch[k].tolist() for k in keys)))
            cols = {n: batch[n].tolist() for n in names}
            start = 0
            for k in range(len(ids) + 1):
                if k == len(ids) or ids[k] != at:
                    for n in names:
                        held[n].extend(cols[n][start:k])
                    start = k
                    if k < len(ids):
                        if at is not None:
                            out.extend(work(held))
                        at, held = ids[k], {n: [] for n in names}
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(",")])
                out = []
        if at is not None and (out := list(work(held))):
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(",")])

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def block_links(scratch: Scratch, members: DataFrame, sizes: DataFrame, alike: Callable, label: str) -> DataFrame:
    """Links (a, b) of all alike members of groups, as forests, without ever holding or pairing a whole large group.

    members: (grp, node, size, *payload), a node once a group; sizes: (grp, blocks, rep) of the groups with two members or
    more, rep being the least node. alike(rows, side, comp) gives position pairs among a dict of lists: all pairs, or
    those across `side` (an array of booleans) and of different `comp` where these are given.

    Members are dealt into blocks by hash. First each block is compared within itself and with the group's
    representative, so a group of copies of one thing becomes one component at a cost in proportion to its members. In the groups of more
    blocks, the members that are then in the representative's component needn't meet each other any more; the others,
    dealt anew, meet all. Pairs of blocks are tasks of bounded size, and a member is copied once for each block of such others.
    """
    payload = [c for c in members.columns if c not in ("grp", "node")]
    schema = "a long, b long, many boolean"

    def within(g: dict) -> list[tuple]:
        nodes = g["node"]
        if len(nodes) < 2:
            return []
        forest = Forest(len(nodes))
        return [(nodes[x], nodes[y], g["many"][0]) for x, y in alike(g, None, None) if forest.join(x, y)]

    many, sizes = F.col("blocks") > 1, scratch.save(sizes, f"{label}-sizes")
    placed = members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    own = placed.select("grp", "block", "node", many.alias("many"), *payload)
    rep = placed.where(many & (F.col("node") == F.col("rep"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rep = rep.where("other != block").select("grp", F.col("other").cast("int").alias("block"), "node", F.lit(True).alias("many"), *payload)
    hot = not sizes.where(many).isEmpty()
    first = by_group(own.unionAll(rep) if hot else own, ["grp", "block"], "node", within, schema)
    if not hot:
        return first.select("a", "b")
    first = scratch.save(first, f"{label}-first")
    comps = connected_components(scratch, first.where("many").select("a", "b"), f"{label}-comps")
    large = members.join(sizes.where(many), "grp").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    reps = large.where("node = rep").select("grp", F.col("comp").alias("rc"))
    large = large.join(reps, "grp").withColumn("tied", F.col("comp") == F.col("rc"))
    n = [F.count_if(x).alias(c) for x, c in ((F.col("tied"), "n_tied"), (~F.col("tied"), "n_loose"))]
    counted = large.groupBy("grp").agg(*n, F.first("blocks").alias("all")).where("n_loose > 0")
    # as many members in a block as before
    share = [F.greatest(F.lit(1), F.ceil(F.col(c) * F.col("all") / (F.col("n_tied") + F.col("n_loose")))).cast("int").alias(k) for c, k in (("n_tied", "tight"), ("n_loose", "loose"))]
    placed = large.drop("blocks").join(counted.select("grp", *share), "grp")
    place = F.when(F.col("tied"), F.col("loose") + F.pmod(F.xxhash64("node", F.lit(1)), F.col("tight"))).otherwise(F.pmod(F.xxhash64("node", F.lit(1)), F.col("loose"))).cast("int")
    last = F.when(F.col("tied"), F.col("loose")).otherwise(F.col("loose") + F.col("tight")) - 1
    placed = placed.withColumn("block", place).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = placed.select("grp", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"), "block", "node", "comp", *payload)

    def between(g: dict) -> list[tuple]:
        nodes, i, j = g["node"], g["i"][0], g["j"][0]
        if len(nodes) < 2:
            return []
        forest = Forest(len(nodes))
        side = None if i == j else np.array(g["block"]) != i
        return [(nodes[x], nodes[y]) for x, y in alike(g, side, np.array(g["comp"])) if forest.join(x, y)]

    second = scratch.save(by_group(dealt, ["grp", "i", "j"], "node", between, "a long, b long"), f"{label}-second")
    return first.select("a", "b").unionAll(second)


def wanted_pairs(n: int, side: np.ndarray | None, comp: np.ndarray | None) -> np.ndarray:
    """Which pairs (x, y), x before y, block_links asks for."""
    out = np.triu(np.ones((n, n), bool), 1)
    for x in (side, comp):
        if x is not None:
            out &= x[:, None] != x[None, :]
    return out


# -- components ---------------------------------------------------------------------------------
#: Edges that one task connects, 16 bytes each. Steps cost the driver tasks and plans whatever the number of edges: 1,750 tasks each with 211 partitions.
_AT_ONCE = 200_000


def connected_components(scratch: Scratch, edges: DataFrame, label: str) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the least node that it is connected with.

    Up to _AT_ONCE edges are connected by one task. With more, large-star and small-star steps alternate until what is
    left are stars; each result is a written table. A step keeps at most one row for each edge it got, and shuffles by
    node, so a hub is summed before it meets others.
    """
    edges = scratch.save(edges.where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{label}-0")
    if edges.count() <= _AT_ONCE:
        found = scratch.save(edges.coalesce(1).mapInPandas(connected_at_once, "node long, comp long"), f"{label}-found")
        scratch.drop(f"{label}-0")
        return found
    step = 0
    while not are_stars(edges):
        step += 1
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b a", "m b").where("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b a", "m b").unionAll(least.selectExpr("a", "m b"))
        edges = scratch.save(small.where("a != b").distinct(), f"{label}-{step}")
        scratch.drop(f"{label}-{step - 1}")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.selectExpr("a node", "b comp").unionAll(roots)


def connected_at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, comp) of all edges (a, b) of a task."""
    if edges := [batch[["a", "b"]].to_numpy() for batch in batches]:
        names, at = np.unique(np.concatenate(edges), return_inverse=True)
        forest = Forest(len(names))
        for x, y in at.reshape(-1, 2).tolist():
            forest.join(x, y)
        yield pd.DataFrame({"node": names, "comp": names[[forest.find(x) for x in range(len(names))]]})


def are_stars(edges: DataFrame) -> bool:
    """Whether every greater end a hangs on one b alone, and no b hangs on another."""
    ends = edges.selectExpr("a node", "1L up", "0L down").unionAll(edges.selectExpr("b node", "0L up", "1L down"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()
