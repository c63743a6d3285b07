"""Chat formatting: reply trees, ranked branches, one conversation for each chosen path (native)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import Scratch, table

HEAD, SEP, END = "### ", ": ", "</turn>\n"


@dataclass(frozen=True)
class Settings:
    """branches: the best paths of each tree that are formatted; masked: the role whose texts the loss covers."""

    branches: int = 1
    masked: str = "assistant"


# -- template -----------------------------------------------------------------------------------
def escape(text: Column) -> Column:
    """Doubles backslashes and breaks `###` and `</turn>` with one, so that neither occurs any more."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(F.regexp_replace(out, "#(?=##)", r"#\\"), "</turn>", r"<\\/turn>")


def escape_role(role: Column) -> Column:
    """As for texts; colons too, so that a header ends at its first `: `."""
    return F.regexp_replace(escape(role), ":", r"\\:")


def unescape(text: Column) -> Column:
    """Drops the backslash before any character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turns_of(formatted: Column) -> Column:
    """Reads the (role, text) turns back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    header = r"(?s)^### ((?:[^\\:]++|\\.)*+): "

    def one(x: Column) -> Column:
        role = F.regexp_extract(x, header, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, F.char_length(role) + len(HEAD) + len(SEP) + 1, F.char_length(x))).alias("text"))

    return F.transform(pieces, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")


# -- trees --------------------------------------------------------------------------------------
def root_paths(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """(leaf, node, up) for every leaf and every node on its way to the root, up steps away.

    nodes: (node, parent); a parent that is null or not a node makes a root. Self-joins double the reach each
    time, so a chain of n turns takes log2(n) of them, and the pairs made are the rows of the result. Nodes
    of a cycle have no root; paths into one end after as many steps as a power of two covers all nodes.
    """
    known = nodes.select(F.col("node").alias("parent")).distinct()
    jumps = scratch.save(nodes.select("node", "parent").join(known, "parent", "left_semi").select("node", F.col("parent").alias("to")), "jump-0")
    inner = jumps.select(F.col("to").alias("node")).distinct()
    paths = scratch.save(nodes.select("node").join(inner, "node", "left_anti").select(F.col("node").alias("leaf"), "node", F.lit(0).alias("up")), "path-0")
    step, most = 0, max(1, nodes.count())
    while (1 << step) <= most and not jumps.isEmpty():
        more = paths.join(jumps, "node").select("leaf", F.col("to").alias("node"), (F.col("up") + (1 << step)).alias("up"))
        step += 1
        paths = scratch.save(paths.unionAll(more), f"path-{step}")
        on = jumps.select(F.col("node").alias("to"), F.col("to").alias("next"))
        jumps = scratch.save(jumps.join(on, "to").select("node", F.col("next").alias("to")), f"jump-{step}")
    return paths


def chosen_paths(scratch: Scratch, nodes: DataFrame, s: Settings) -> DataFrame:
    """(leaf, node, up) of the best branches of each tree: the greatest mean score, then the least leaf.

    nodes: (node, parent, tree, score); a null score counts 0.
    """
    paths = root_paths(scratch, nodes)
    scored = paths.join(nodes.select("node", F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    branches = scored.groupBy("leaf").agg(F.avg("score").alias("mean")).join(nodes.select(F.col("node").alias("leaf"), F.struct("tree").alias("tree")), "leaf")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    best = branches.withColumn("rank", rank).where(F.col("rank") <= s.branches).select("leaf")
    return paths.join(best, "leaf", "left_semi")


def format_paths(paths: DataFrame, turns: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(leaf, tree, formatted, loss_spans) from paths (leaf, node, up) and turns (node, tree, role, text).

    loss_spans are code point ranges of formatted: one for each text of the masked role, in order, without the template.
    """
    body = paths.join(turns, "node").select(
        "leaf", "tree", "up", (F.coalesce("role", F.lit("")) == s.masked).alias("on"),
        F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("body"),
    )
    turn = F.struct((-F.col("up")).alias("o"), "head", "body", "on")
    rows = body.groupBy("leaf").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list(turn)).alias("t"))
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    rows = rows.withColumn("lengths", F.transform("t", lambda x: F.struct(F.char_length(x["head"]).alias("h"), F.char_length(x["body"]).alias("b"), x["on"].alias("on"))))
    ends = F.col("ends")
    rows = rows.select("leaf", "tree", formatted.alias("formatted"), "lengths", F.transform("lengths", lambda x: x["h"] + x["b"] + len(END)).alias("whole"))
    rows = rows.withColumn("ends", running_sums("whole"))
    spans = F.transform("lengths", lambda x, i: F.struct((F.get(ends, i) - len(END) - x["b"]).alias("start"), (F.get(ends, i) - len(END)).alias("stop"), x["on"].alias("on")))
    return rows.select("leaf", "tree", "formatted", F.transform(F.filter(spans, lambda x: x["on"]), lambda x: F.struct(x["start"].cast("long").alias("start"), x["stop"].cast("long").alias("stop"))).alias("loss_spans"))


def running_sums(lengths: str) -> Column:
    """Inclusive running sums of an array of ints, two levels deep, so that the cost is n to the power 1.5."""
    x, size = F.col(lengths), 64
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda b: total(F.slice(x, b * size + 1, F.lit(size))))
    return F.when(F.size(x) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(x, lambda _, i: total(F.slice(blocks, F.lit(1), F.floor(i / size).cast("int"))) + total(F.slice(x, F.floor(i / size).cast("int") * size + 1, i % size + 1)))
    )


# -- conversations ------------------------------------------------------------------------------
def turn_trees(conversations: DataFrame) -> DataFrame:
    """(node, parent, tree, role, text, score) from rows (conv_id, turn, role, text): each turn replies to the one before.

    Rows of a conversation go by turn (null last), then role and text, so ties and repeated rows have an order
    that reruns keep. A null conv_id is a conversation of its own. Null texts and roles are empty.
    """
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    pos = F.row_number().over(by)
    key = lambda p: F.struct(F.col("conv_id"), p.cast("int").alias("pos"))
    rows = conversations.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), pos.alias("pos"))
    return rows.select(
        key(F.col("pos")).alias("node"), F.when(F.col("pos") > 1, key(F.col("pos") - 1)).alias("parent"),
        F.col("conv_id").alias("tree"), "role", "text", F.lit(0.0).alias("score"),
    )


def format_trees(spark: SparkSession, nodes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(leaf, tree, formatted, loss_spans) for the best branches of reply trees (node, parent, tree, role, text, score).

    A tree whose nodes all lie on a cycle has neither root nor leaf and gives no row; an empty table gives none.
    """
    scratch = Scratch(spark, "chat")
    nodes = scratch.save(nodes, "nodes")
    best = chosen_paths(scratch, nodes.select("node", "parent", "tree", "score"), s)
    return format_paths(best, nodes.select("node", "tree", "role", "text"), s)


#: Fixed: the conversation that the job adds.
ADDED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from the formatted conversations."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = " union all ".join(f"select {c}L conv_id, {t}L turn, '{r}' role, r'{x}' text" for c, t, r, x in ADDED)
    out = format_trees(spark, turn_trees(given.unionAll(spark.sql(rows))))
    out = out.select("tree", "formatted", turns_of(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
