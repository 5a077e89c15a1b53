"""Chats from reply trees: root-to-leaf paths by iterative self-joins, ranked by score, each chosen path one conversation.

``root_paths`` doubles its reach with each self-join: after k rounds every leaf knows its 2**k nearest ancestors, so deep
threads take few rounds and only ids move; scores pick the paths and texts are joined to the chosen ones alone.

The template wraps each turn as ``<|im_start|>role LF text <|im_end|> LF``. Inside texts ``<|`` becomes ``<\\|``, and ``<\\|``
one backslash more, so control strings can't be forged and the escape is undone exactly. Role names get their backslashes,
line feeds and ``<`` escaped.

Defined cases: null texts and roles count as empty; a message whose parent is missing is a root; a path that runs into a
cycle has no root and is left out; ties of the score go to the smaller leaf id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revgrain.llm.common import written
from revgrain.session import cut_lineage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    for plain, safe in (("\\", "\\s"), ("\n", "\\n"), ("<", "\\l")):
        role = F.replace(role, F.lit(plain), F.lit(safe))
    return role


def unescape_role(role: Column) -> Column:
    for plain, safe in (("<", "\\l"), ("\n", "\\n"), ("\\", "\\s")):
        role = F.replace(role, F.lit(safe), F.lit(plain))
    return role


def root_paths(messages: DataFrame) -> DataFrame:
    """Rows (tree, leaf, node, above) for every root-to-leaf path; ``above`` counts the steps from the leaf up.

    ``messages`` has (tree, node, parent); nodes are unique within a tree.
    """
    nodes = cut_lineage(messages.select("tree", "node", "parent"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = nodes.filter("parent is not null").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up"))
    jump = cut_lineage(jump)
    parents = jump.select("tree", F.col("up").alias("node")).distinct()
    reach = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    step, most = 1, nodes.count()
    while step < max(most, 1) and not jump.isEmpty():
        further = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + step).alias("above"))
        reach = cut_lineage(reach.unionByName(further))
        onward = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("top"))
        jump = cut_lineage(jump.join(onward, ["tree", "up"]).select("tree", "node", F.col("top").alias("up")))
        step *= 2
    if jump.isEmpty():
        return reach
    # What still has ancestors beyond every node of the table runs in a cycle.
    endless = reach.join(jump, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return reach.join(endless, ["tree", "leaf"], "left_anti")


def choose_paths(paths: DataFrame, scores: DataFrame, best: int | None = 1) -> DataFrame:
    """The ``best`` branches of each tree by mean score (null: 0), all of them with None: (tree, leaf, rank)."""
    scored = paths.join(scores.select("tree", "node", "score"), ["tree", "node"])
    branch = scored.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    ranked = branch.withColumn("rank", rank).select("tree", "leaf", "rank")
    return ranked if best is None else ranked.filter(F.col("rank") <= best)


def format_paths(messages: DataFrame, best: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations: (tree, leaf, rank, formatted, loss), ``loss`` the spans of ``loss_role`` texts in code points.

    ``messages`` has (tree, node, parent, role, text, score).
    """
    paths = root_paths(messages)
    chosen = choose_paths(paths, messages, best)
    steps = paths.join(chosen, ["tree", "leaf"]).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit("\n"))
    turns = steps.select(
        "tree", "leaf", "rank", "above", (role == loss_role).alias("learn"), F.length(head).alias("head"), F.length(escape(text)).alias("body"),
        F.concat(head, escape(text), F.lit(CLOSE + "\n")).alias("turn"),
    )
    upto = Window.partitionBy("tree", "leaf", "rank").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("start", F.sum(F.length("turn")).over(upto) - F.length("turn") + F.col("head"))
    span = F.when(F.col("learn"), F.struct("start", (F.col("start") + F.col("body")).alias("end")))
    whole = placed.groupBy("tree", "leaf", "rank").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("at"), "turn"))).alias("turns"), F.array_sort(F.collect_list(span)).alias("loss"),
    )
    return whole.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), "loss")


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x, i: i > 0)
    return F.transform(parts, lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substring(x, F.locate("\n", x) + 1, F.length(x) - F.locate("\n", x) - len(CLOSE) - 1)).alias("text"),
    ))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order, unescaped."""
    return F.transform(loss, lambda x: unescape(F.substring(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))


def threads(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it, by turn, then role and text."""
    nth = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    # A struct compares equal when both ids are null, so rows without an id form one conversation.
    plain = rows.select(F.struct(F.col(tree).alias("id")).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    numbered = plain.withColumn("node", nth.cast("long"))
    return numbered.select("tree", "node", F.nullif(F.col("node") - 1, F.lit(0)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def write_chats(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """The formatted conversations written to the shared folder and read again."""
    return written(format_paths(written(messages, "chat-messages"), best), "chats")
