"""Chat formatting over reply trees.

Messages point to the message they answer. Paths from root to leaf are found by iterative self-joins that
double their reach: after round k every message knows its ancestor 2^k steps up, the length and the score
of the way there, so a thread of n messages takes log2(n) joins on unique keys. Leaves are ranked by the
score of their whole branch, the best of each tree are followed back up the same jumps, and every
chosen path becomes one conversation.

Template: ``<s>``, then per message ``[INST]role[/INST]text</s>``. Wherever a role or text holds a control string,
perhaps with backslashes after its first character, one more backslash goes there; reading back takes
one away. So no text can close a turn, and every text comes back as it was. The loss mask covers the
texts of the assistant and nothing else, as ``(start, length)`` in code points.

DataFrame functions only. Defined results: null roles and texts are empty; a null tree is a tree of its own; a
message whose parent is not there is a root; messages on or under a cycle lie on no path. Repeated node
ids within a tree are refused by nobody and give repeated paths. Ties of score go to the longer branch, then
the lower node. Other columns are not carried along. A conversation is one text and so one row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelwise.llm.common import stage

OPEN, CLOSE, HEAD, BODY = "<s>", "</s>", "[INST]", "[/INST]"
LEARNED = "assistant"
_MARK = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def best_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """``(tree, leaf, place, node, depth)`` of the best branches of every tree.

    ``nodes`` is a written table ``(tree, node, parent, score)`` with no nulls in ``tree`` and ``node``.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    reach = nodes.join(known, ["tree", "parent"], "left").select(
        "tree",
        "node",
        F.when(F.col("known"), F.col("parent")).alias("up"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
        F.lit(1).alias("depth"),
    )
    reach = stage(reach)
    # Messages that have reached their root take no more part; a round is as large as what is still on its way.
    ended, moving = [reach.where("up IS NULL")], reach.where("up IS NOT NULL")
    jumps = [moving.select("tree", "node", "up")]
    for _ in range(max(1, nodes.count()).bit_length() + 1):
        if not moving.limit(1).count():
            break
        above = functools.reduce(DataFrame.unionByName, [*ended, moving]).select(
            "tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("score").alias("more"), F.col("depth").alias("steps")
        )
        far = stage(
            moving.join(above, ["tree", "up"]).select(
                "tree", "node", F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("steps")).alias("depth")
            )
        )
        ended.append(far.where("up IS NULL"))
        moving = far.where("up IS NOT NULL")
        jumps.append(moving.select("tree", "node", "up"))
    # What still has a way to go after that many doublings goes round in a circle.
    ended = functools.reduce(DataFrame.unionByName, ended).select("tree", "node", "score", "depth")
    inner = nodes.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = ended.join(inner, ["tree", "node"], "left_anti")
    order = W.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "node")
    ranked = leaves.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_tree)
    path = stage(ranked.select("tree", F.col("node").alias("leaf"), "place", "node"))
    for jump in jumps:
        further = path.join(jump, ["tree", "node"]).select("tree", "leaf", "place", F.col("up").alias("node"))
        path = stage(path.union(further)) if jump is not jumps[-1] else path
    return path.join(ended.select("tree", "node", "depth"), ["tree", "node"])


def format_paths(messages: DataFrame) -> DataFrame:
    """``(path, formatted, loss)`` from ``(path, depth, role, text)``; ``loss`` is a list of spans."""
    role = F.coalesce("role", F.lit(""))
    turns = messages.select("path", "depth", role.alias("role"), escape(F.col("text")).alias("text"))
    turns = turns.withColumn("head", F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(BODY)))
    turns = turns.withColumn("turn", F.concat("head", "text", F.lit(CLOSE)))
    before = W.partitionBy("path").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    begin = F.lit(len(OPEN)) + F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.char_length("head")
    spans = turns.withColumn(
        "span", F.when(F.col("role") == LEARNED, F.struct(begin.cast("long").alias("start"), F.char_length("text").cast("long").alias("length")))
    )
    whole = spans.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "span"))).alias("turns"))
    return whole.select(
        "path",
        F.concat(F.lit(OPEN), F.array_join(F.col("turns.turn"), "")).alias("formatted"),
        F.array_compact(F.col("turns.span")).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """``(role, text)`` of every turn of a formatted conversation."""
    parts = F.split(F.substring(formatted, len(OPEN) + 1, 2_147_483_647), CLOSE)
    turns = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    form = r"(?s)^\[INST\](.*?)\[/INST\](.*)$"
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, form, 1)).alias("role"), unescape(F.regexp_extract(t, form, 2)).alias("text")
        ),
    )


def masked(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped, span after span."""
    part = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(loss, part), "")


def thread(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A written table ``(tree, key, node, parent, score, role, text)`` of plain threads: each turn answers the one before."""
    order = W.partitionBy(tree).orderBy(F.col(turn).asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    key = F.coalesce(F.concat(F.lit("#"), F.col(tree).cast("string")), F.lit("none"))
    numbered = rows.select(F.col(tree).alias("key"), key.alias("tree"), F.row_number().over(order).alias("node"), "role", "text")
    return stage(
        numbered.select(
            "tree", "key", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
        )
    )


def format_trees(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """One conversation for each of the best branches: ``(path, formatted, loss)``; ``path`` is ``(key, place)``."""
    paths = best_paths(nodes.select("tree", "node", "parent", "score"), per_tree)
    messages = paths.join(nodes.select("tree", "node", "key", "role", "text"), ["tree", "node"])
    return format_paths(messages.select(F.struct("key", "place").alias("path"), "depth", "role", "text"))
