"""Chat formatting: root-to-leaf paths of reply trees as marked-up conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.words import let
from kindred.session import written

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    """Text in which no control string can occur; null gives the empty text."""
    doubled = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit("<|"), F.lit("<\\|"))


def escape_role(c: Column) -> Column:
    """Like ``escape``, on one line."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column) -> Column:
    """What ``escape`` or ``escape_role`` was given."""
    part = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def reply_paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """Members of the best root-to-leaf paths of each reply tree.

    ``nodes`` has ``tree``, ``node``, ``parent`` (null at a root) and ``score``.
    Self-joins double the reach of each node's link to its ancestors, so a path
    of n turns takes log2(n) rounds. The ``keep`` paths with the highest sum of
    scores are chosen in each tree, ties by the smaller leaf. Returns ``tree``,
    ``leaf``, ``node``, ``depth`` (0 at the root) and ``path_rank``.

    Several roots in a tree are allowed. Null trees form one tree. Nodes that
    name a missing parent count as roots; paths that run into a cycle never
    reach a root and are left out.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = nodes.select("tree", F.col("node").alias("to"))
    up = _link(nodes.filter("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("to")), ids, "to", "to", ["l.tree", "l.node", "l.to"])
    up = written(up, "chat-up")
    parents = up.select("tree", F.col("to").alias("node")).distinct()
    leaves = nodes.alias("l").join(
        parents.alias("r"), F.col("l.tree").eqNullSafe(F.col("r.tree")) & (F.col("l.node") == F.col("r.node")), "left_anti"
    )
    paths = written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("height")), "chat-paths")
    roots = _without(nodes.select("tree", "node"), up.select("tree", "node"))
    most, reach = nodes.count(), 1
    while reach <= most and not up.isEmpty():
        longer = _link(paths, up, "node", "node", ["l.tree", "l.leaf", "r.to AS node", f"l.height + {reach} AS height"])
        paths = written(paths.unionByName(longer), "chat-paths")
        up = written(_link(up, up, "to", "node", ["l.tree", "l.node", "r.to"]), "chat-up")
        reach *= 2
    scored = _link(paths, nodes, "node", "node", ["l.tree", "l.leaf", "l.node", "l.height", "r.score"])
    ends = _link(paths, roots, "node", "node", ["l.tree", "l.leaf"]).distinct()
    totals = scored.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("height").alias("length"))
    totals = _link(totals, ends, "leaf", "leaf", ["l.*"])
    best = Window.partitionBy("tree").orderBy(F.desc("total"), "leaf")
    chosen = totals.withColumn("path_rank", F.row_number().over(best)).filter(F.col("path_rank") <= keep)
    return _link(
        paths, chosen, "leaf", "leaf", ["l.tree", "l.leaf", "l.node", "r.length - l.height AS depth", "r.path_rank"]
    )


def _link(left: DataFrame, right: DataFrame, this: str, that: str, out: list[str]) -> DataFrame:
    same = F.col("l.tree").eqNullSafe(F.col("r.tree")) & (F.col(f"l.{this}") == F.col(f"r.{that}"))
    return left.alias("l").join(right.alias("r"), same).selectExpr(*out)


def _without(left: DataFrame, right: DataFrame) -> DataFrame:
    same = F.col("l.tree").eqNullSafe(F.col("r.tree")) & (F.col("l.node") == F.col("r.node"))
    return left.alias("l").join(right.alias("r"), same, "left_anti")


def format_paths(paths: DataFrame, turns: DataFrame) -> DataFrame:
    """One marked-up text for each path.

    ``turns`` has ``tree``, ``node``, ``role`` and ``text``. Returns ``tree``,
    ``leaf``, ``path_rank``, ``formatted`` and ``loss_spans``: start and length,
    in code points, of what assistants say, as it stands in ``formatted``.
    """
    said = _link(
        paths, turns, "node", "node", ["l.tree", "l.leaf", "l.path_rank", "l.depth", "r.role", "r.text"]
    )
    said = said.select(
        "tree", "leaf", "path_rank", "depth", (F.coalesce("role", F.lit("")) == "assistant").alias("learn"),
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    so_far = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    long = F.length("head") + F.length("body") + len(END)
    start = (F.coalesce(F.sum(long).over(so_far), F.lit(0)) + F.length("head")).alias("start")
    placed = said.select("*", start).groupBy("tree", "leaf", "path_rank").agg(
        F.array_sort(F.collect_list(F.struct("depth", "start", F.length("body").alias("long"), "learn", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("t")
    )
    return placed.select(
        "tree", "leaf", "path_rank",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["long"].alias("long"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted text was made of."""
    each = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)
    body = lambda x: F.substr(x, F.instr(x, "\n") + 1, F.length(x) - F.instr(x, "\n") - len(END))
    return F.transform(
        each, lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(body(x)).alias("text"))
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """Texts under the loss mask, one after the other."""
    return let(formatted, lambda whole: F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(whole, (s["start"] + 1).cast("int"), s["long"]))), ""
    ))


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Reply trees of plain conversations: each turn answers the one before it.

    ``rows`` has ``conv_id``, ``turn``, ``role`` and ``text``; turns of the same
    number stand in the order of role and text, null turns come last.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.select(F.col("conv_id").alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return written(placed.withColumn("parent", parent).withColumn("score", F.lit(0.0)), "chat-turns")
