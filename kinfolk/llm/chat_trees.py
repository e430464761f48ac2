"""Chat formatting over reply trees: root-to-leaf paths by iterative self-joins, branches ranked by score.

Native: DataFrame operations only. Pointers to ancestors double with every self-join, so a tree of depth d takes about
log2(d) joins; the same pointers, from the longest to the shortest, then list the ancestors of each chosen leaf.

Defined results: null roles and texts are empty; a node whose parent is null, missing or itself is a root; nodes on a
cycle have no root and so belong to no path; of nodes with one id the first by (role, text) stays; branches with equal
scores rank by smaller leaf id; rows with a null tree or node id belong to no
conversation and are left out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfolk.runtime import stored

#: Fixed strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Ancestors up to 2^40 away; deeper pointers are on a cycle.
MAX_DOUBLINGS = 40


def escape(text: Column) -> Column:
    """Backslashes double, then '<|' becomes '<\\|': no control string is left, and '<', one backslash, '|' has one origin."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As escape(); a newline, which ends the role, becomes '<\\_'."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\_"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\_"), F.lit("\n")))


def reply_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Rows of the top branches of each tree: tree, leaf, rank, depth (from 0 at the root), role, text.

    nodes: tree, node, parent (long), role, text, score (double). A branch's score is the sum over its nodes.
    """
    once = nodes.filter(F.col("tree").isNotNull() & F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("x"))
    base = stored(once.select("tree", "node", "x.parent", "x.role", "x.text", "x.score"), "nodes")
    ids = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = base.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), "score").join(ids, ["tree", "parent"], "left")
    hop = stored(up.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("to"), "score", F.lit(1).cast("long").alias("depth")), "hop")
    hops = []
    # a node's 2^k-th ancestor, with score and count of the nodes before it; only nodes deeper than that join again
    done = [hop.filter(F.col("to").isNull())]
    open_ = hop.filter(F.col("to").isNotNull())
    for _ in range(MAX_DOUBLINGS):
        if open_.isEmpty():
            break
        hops.append(open_.select("tree", "node", "to"))
        known = reduce(DataFrame.unionByName, [*done, open_])
        far = known.select("tree", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        moved = open_.join(far, ["tree", "to"]).select("tree", "node", F.col("to2").alias("to"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"))
        moved = stored(moved, "hop")
        done.append(moved.filter(F.col("to").isNull()))
        open_ = moved.filter(F.col("to").isNotNull())
    rooted = reduce(DataFrame.unionByName, done)
    leaves = rooted
    if hops:
        leaves = rooted.join(hops[0].select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti")
    if top == 1:
        best = leaves.groupBy("tree").agg(F.max(F.struct("score", (-F.col("node")).alias("neg"), "depth")).alias("b")).select("tree", (-F.col("b.neg")).alias("leaf"), F.lit(1).alias("rank"), F.col("b.depth").alias("length"))
    else:
        order = W.partitionBy("tree").orderBy(F.desc("score"), "node")
        best = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("tree", F.col("node").alias("leaf"), "rank", F.col("depth").alias("length"))
    path = best.select("tree", "leaf", "rank", F.col("leaf").alias("node"), (F.col("length") - 1).alias("depth"))
    for k in range(len(hops) - 1, -1, -1):
        step = path.join(hops[k], ["tree", "node"]).select("tree", "leaf", "rank", F.col("to").alias("node"), (F.col("depth") - 2**k).alias("depth"))
        path = stored(path.unionByName(step), "path")
    return path.join(base.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "leaf", "rank", "depth", "role", "text")


def format_paths(paths: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One conversation per path: tree, leaf, rank, n_turns, formatted, loss_spans (start from 0 and length, in code points).

    A turn is START role newline text END newline, role and text escaped; the loss mask is the texts of learn_role.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    turns = paths.select("tree", "leaf", "rank", "depth", head.alias("head"), body.alias("body"), (F.col("role") == learn_role).alias("learn"))
    turns = turns.withColumn("size", F.length("head") + F.length("body") + len(END) + 1)
    before = W.partitionBy("tree", "leaf", "rank").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END + "\n")).alias("turn"), "learn", (F.col("at") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    rows = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return rows.select(
        "tree",
        "leaf",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - (len(END) + 1))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, joined in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chains(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Plain conversations as reply trees: each row answers the one before it."""
    order = W.partitionBy(conv).orderBy(F.col(turn).asc_nulls_last(), "role", "text")
    return rows.select(F.col(conv).alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text").select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )
