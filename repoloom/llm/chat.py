"""Reply trees formatted as conversations.

Messages form trees by parent. Iterative self-joins enumerate root-to-leaf
paths by doubling: round k joins the table of 2^k-th ancestors with itself,
and walking the rounds back spreads each leaf over its ancestors, so a chain
of n replies takes log2 n joins each way. Branches are ranked by the sum of
their scores; each chosen path becomes one conversation.

The template is ``<s>`` and, per turn, ``<|role|>text</s>``. Control strings
(also the bracketed instruction marks of other templates) inside roles and
texts are broken by a backslash after their first character, and backslashes
doubled, so ``unescape`` restores any text. Loss spans cover assistant texts,
as (turn, start, length) in code points of that turn's block.

Defined cases: null text and null role are empty. A parent that is missing
makes its child a root. Messages in a reply cycle, or under one, lie on no
root-to-leaf path and give none. Null tree ids are one tree. Messages
without a node id give none. Rows repeating a
node id of a tree count once (the least by parent, role, text). Equal scores
rank longer paths first, then the smaller leaf. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from repoloom.runtime import stage

#: Control strings, each to be broken after its first character.
CONTROL = r"<(?=/?s>)|<(?=\|)|\|(?=>)|\[(?=/?INST\])"
BEGIN, OPEN, CLOSE, END = "<s>", "<|", "|>", "</s>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], int]:
    """Tables of 2^k-th ancestors, k = 0, 1, …, of ``tree, node, parent``; the last is the longest jump there is."""
    most = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump, found = stage(
        nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")),
        "reply-links", n=F.count(F.lit(1)))
    jumps = []
    while found["n"] and 1 << len(jumps) <= 2 * most:
        jumps.append(jump)
        jump, found = stage(
            jump.alias("a").join(jump.alias("b"), F.expr("a.tree = b.tree and a.up = b.node")).selectExpr("a.tree", "a.node", "b.up"),
            "reply-links", n=F.count(F.lit(1)))
    return jumps, most


def paths(nodes: DataFrame) -> DataFrame:
    """``tree, leaf, node, up``: every node of each leaf's path, ``up`` steps above the leaf."""
    jumps, most = ancestors(nodes)
    parents = nodes.select("tree", F.col("parent").alias("node"))
    leaves = nodes.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    if jumps and 1 << (len(jumps) - 1) >= most:  # whatever can jump over as many nodes as there are hangs off a cycle
        endless = jumps[-1].select("tree", "node")
        path = path.join(endless, ["tree", "node"], "left_anti")
    for k in range(len(jumps) - 1, -1, -1):
        more = path.join(jumps[k].withColumnRenamed("up", "_to"), ["tree", "node"]).select(
            "tree", "leaf", F.col("_to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        path, _ = stage(path.unionByName(more), "reply-paths")
    return path


def format_conversations(
    messages: DataFrame, tree_col: str = "tree_id", node_col: str = "node_id", parent_col: str = "parent_id",
    role_col: str = "role", text_col: str = "text", score_col: str | None = None, top: int = 1,
) -> DataFrame:
    """One row per chosen path: the tree id, ``leaf, rank, score, n_turns, formatted, loss_spans``.

    ``top`` is the number of best branches per tree (a large number: all).
    """
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    text_key = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("null"))
    rows = messages.select(
        text_key.alias("tree"), F.col(tree_col).alias("_id"), F.col(node_col).alias("node"), F.col(parent_col).alias("parent"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), score.alias("score"))
    rows = rows.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score", "_id")).alias("m")).select("tree", "node", "m.*")
    rows, _ = stage(rows, "messages")
    path = paths(rows.select("tree", "node", "parent"))
    on_path = path.join(rows.drop("parent"), ["tree", "node"])
    branch = (
        on_path.groupBy("tree", "leaf")
        .agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_turns"))
        .withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), F.desc("n_turns"), "leaf")))
        .filter(F.col("rank") <= top)
    )
    turns = (
        on_path.join(branch.select("tree", "leaf"), ["tree", "leaf"], "left_semi").groupBy("tree", "leaf")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"), F.first("_id").alias("_id"))
    )
    head = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))
    blocks = F.transform("turns", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END)))
    spans = F.filter(
        F.transform("turns", lambda t, i: F.when(
            t["role"] == "assistant",
            F.struct(i.alias("turn"), F.length(head(t)).alias("start"), F.length(escape(t["text"])).alias("length")))),
        lambda s: s.isNotNull())
    return turns.join(branch, ["tree", "leaf"]).select(
        F.col("_id").alias(tree_col), "leaf", "rank", "score", "n_turns",
        F.concat(F.lit(BEGIN), F.array_join(blocks, "")).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, text_col: str = "formatted", spans_col: str = "loss_spans") -> DataFrame:
    """Adds ``turns`` (role and text of each block) and ``loss_text``, both taken from the formatted text alone."""
    body = F.expr(f"substring({text_col}, {len(BEGIN) + 1})")
    cut = F.split(body, END)
    blocks = F.slice(cut, 1, F.size(cut) - 1)
    part = lambda b: F.split(F.substring(b, len(OPEN) + 1, 2147483647), r"\|>")
    turns = F.transform("_blocks", lambda b: F.struct(unescape(part(b)[0]).alias("role"), unescape(part(b)[1]).alias("text")))
    loss = F.transform(spans_col, lambda s: unescape(F.get(F.col("_blocks"), s["turn"]).substr(s["start"] + 1, s["length"])))
    return formatted.withColumn("_blocks", blocks).withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, "")).drop("_blocks")
