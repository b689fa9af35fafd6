"""Chat formatting of reply trees.

Messages with a parent form trees. Root-to-leaf paths are enumerated by iterative self-joins with doubling steps:
after round k a leaf knows its 2**k nearest ancestors, so the number of joins grows with the logarithm of the
depth. Branches are ranked by the sum of their scores and each chosen path becomes one conversation.

Template: every turn is ``<|turn|>`` role, line feed, text, ``<|end|>``, line feed. Inside roles and texts a backslash
is doubled and every control string gets a backslash after its first character, so that no control string is left
and the original comes back by dropping single backslashes; a line feed in a role is written after a backslash.
The loss mask covers the texts of assistant turns, as [start, end) code points of the output. Work grows with the length
of a conversation; its path is one row, so it has to fit in a task's memory.

Defined cases: null roles and texts are empty; a null conversation is one conversation; a parent that is not there
makes a root; of several rows with one node id the smallest (role, text)
stays (rows of one turn in a linear conversation are turns of their own, by role and text); tied branches go to the smallest
leaf; other columns do not matter; an empty table gives no rows. A cycle has no leaf and so no path; a leaf cannot
lead into one, since every node has one parent and the walk stops at a node seen before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, let

BEGIN, END = "<|turn|>", "<|end|>"
#: Strings that chat templates treat as control tokens.
CONTROL = (BEGIN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: More doublings than any tree of 2**32 levels needs.
MAX_ROUNDS = 32


def escaped(text: Column) -> Column:
    """Text without control strings; see ``unescaped``."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain_parents(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: every row answers the row before it. Ties in turn are ordered by role and text."""
    r = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    node = F.row_number().over(Window.partitionBy("conv").orderBy("_turn", "role", "text")).cast("long")
    return r.withColumn("node", node).select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(c, leaf, anc, dist): every node on the path from a leaf up to its root, the leaf itself at 0.

    ``nodes`` has c (no nulls), node, parent.
    """
    known = nodes.select("c", F.col("node").alias("parent"))
    linked = nodes.select("c", "node", "parent").join(known, ["c", "parent"], "left_semi")
    leaves = nodes.select("c", "node").join(linked.select("c", F.col("parent").alias("node")), ["c", "node"], "left_anti")
    walk = cut(leaves.select("c", F.col("node").alias("leaf"), F.col("node").alias("anc"), F.lit(0).cast("long").alias("dist")))
    up = cut(linked.select("c", "node", F.col("parent").alias("to")))
    step = 1
    for _ in range(MAX_ROUNDS):
        if up.isEmpty():
            return walk
        more = walk.join(up.withColumnRenamed("node", "anc"), ["c", "anc"]).select("c", "leaf", F.col("to").alias("anc"), (F.col("dist") + step).alias("dist"))
        more = more.join(walk.select("c", "leaf", "anc"), ["c", "leaf", "anc"], "left_anti")
        walk = cut(walk.unionByName(more))
        up = cut(up.join(up.select("c", F.col("node").alias("to"), F.col("to").alias("far")), ["c", "to"]).select("c", "node", F.col("far").alias("to")).where(F.col("node") != F.col("to")))
        step *= 2
    raise RuntimeError("a path is longer than 2**32 turns")


def chosen_paths(tree: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, leaf, dist, role, text) of the best ``branches`` paths of each conversation."""
    c = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null"))
    one = F.min(F.struct("role", "text", "conv", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    nodes = cut(tree.withColumn("c", c).groupBy("c", "node").agg(one.alias("m")).select("c", "node", "m.*"))
    walk = leaf_paths(nodes)
    on_path = walk.join(nodes.select("c", F.col("node").alias("anc"), "score", "role", "text", "conv"), ["c", "anc"])
    ranked = on_path.groupBy("c", "leaf").agg(F.sum("score").alias("total"))
    if branches == 1:
        best = ranked.groupBy("c").agg(F.min(F.struct((-F.col("total")).alias("t"), "leaf")).alias("b")).select("c", F.col("b.leaf").alias("leaf"))
    else:
        place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("total"), "leaf"))
        best = ranked.withColumn("place", place).where(F.col("place") <= branches).select("c", "leaf")
    return on_path.join(best, ["c", "leaf"]).select("conv", "leaf", "dist", "role", "text")


def formatted(paths: DataFrame) -> DataFrame:
    """(conv, leaf, formatted, loss): one row for each path.

    loss is an array of (start, end, turn, offset): a range of code points of the output, the number of its turn and
    where the range starts in that turn. Starts are sums over the turns before, taken before turns are gathered.
    """
    head = F.concat(F.lit(BEGIN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turns = paths.select("conv", "leaf", "dist", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("learn"))
    size = F.length("head") + F.length("body") + len(END) + 1
    before = Window.partitionBy("conv", "leaf").orderBy(F.desc("dist"))
    up_to = before.rowsBetween(Window.unboundedPreceding, 0)
    turns = turns.withColumns({"start": F.sum(size).over(up_to) - size + F.length("head"), "turn": F.row_number().over(before) - 1})
    span = F.struct("start", (F.col("start") + F.length("body")).alias("end"), "turn", F.length("head").alias("offset"))
    piece = F.struct("turn", F.concat("head", "body", F.lit(END + "\n")).alias("text"), F.when(F.col("learn"), span).alias("span"))
    g = turns.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"])
    return g.select("conv", "leaf", F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("formatted"), loss.alias("loss"))


def parts(text: Column) -> Column:
    """The turns of a formatted conversation without their ends. A turn holds no end mark but its own."""
    return F.split(text, r"<\|end\|>\n")


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    pattern = r"(?s)^<\|turn\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    turns = F.filter(parts(text), lambda p: p != "")
    return F.transform(turns, lambda p: F.struct(unescaped(F.regexp_extract(p, pattern, 1)).alias("role"), unescaped(F.regexp_extract(p, pattern, 2)).alias("text")))


def masked_text(text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped; every turn is cut once."""
    cut_out = lambda turns: F.transform(loss, lambda s: unescaped(F.substring(F.get(turns, s["turn"]), s["offset"] + 1, (s["end"] - s["start"]).cast("int"))))
    return F.array_join(let(parts(text), cut_out), "")
