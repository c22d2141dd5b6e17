"""Chat formatting from reply trees, with DataFrame functions only.

Messages form trees by parent_id.  Iterative self-joins by doubling give each message its jump to the ancestor 2^k
above it, so a path of n messages takes about log2(n) rounds and not n; leaves are ranked by the mean score of their
path, and each chosen root-to-leaf path becomes one conversation.

Template: <|role|>, a line break, the text, <|end|>, a line break.  Control strings inside texts are escaped and come
back exactly: a backslash becomes \\0, the "<" or "[" that begins a control string \\1 or \\2, and in roles "|" \\3.

Defined cases: null role or text counts as empty; a message whose parent is missing is a root; messages of a cycle, or
below one, have no root and are in no conversation; rows that tie are ordered by role, then text; messages without a
tree_id are in no tree (digests takes those without a conv_id as one conversation); an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumetry.llm.common import written

END = "<|end|>\n"
#: What begins a control string.  Fixed values of common chat templates.
_ANGLE = r"<(?=\||/?s>|</?SYS>>)"
_SQUARE = r"\[(?=/?INST\])"
#: Parts into which a tree's leaves are dealt before they are ranked.
_SALTS = 32


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\0"))
    out = F.regexp_replace(out, F.lit(_ANGLE), F.lit(r"\\1"))
    return F.regexp_replace(out, F.lit(_SQUARE), F.lit(r"\\2"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("|"), F.lit("\\3"))


def unescaped(text: Column) -> Column:
    """Each backslash of an escaped text begins one code, so the codes can be undone one after another, \\0 last."""
    for code, plain in (("\\3", "|"), ("\\2", "["), ("\\1", "<"), ("\\0", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def jump_tables(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables k of (tree_id, node, up): up is 2^k above node.  And (node, score, n) of each node's path from its root."""
    nodes = messages.select("tree_id", F.col("msg_id").alias("node"), "parent_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    there = nodes.select("tree_id", F.col("node").alias("parent_id"), F.col("node").alias("up"))
    level = nodes.join(there, ["tree_id", "parent_id"], "left").select("tree_id", "node", "up", "total", F.lit(1).cast("long").alias("n"))
    level = written(level, "jumps")
    rounds = max(1, int(level.count()).bit_length())  # more only if there is a cycle
    out: list[DataFrame] = []
    for _ in range(rounds):
        jumps = level.where("up is not null")
        if jumps.isEmpty():
            break
        out.append(jumps.select("tree_id", "node", "up"))
        above = level.select("tree_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("n").alias("n2"))
        # only messages that haven't met their root are joined, so that short trees don't pay for the rounds of long ones
        moved = level.where("up is not null").join(above, ["tree_id", "up"])
        moved = moved.select("tree_id", "node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("n") + F.col("n2")).alias("n"))
        level = written(moved.unionByName(level.where("up is null")), "jumps")
    rooted = level.where("up is null").select("tree_id", "node", (F.col("total") / F.col("n")).alias("score"), "n")
    return out, rooted


def ranked_leaves(messages: DataFrame, rooted: DataFrame, top: int) -> DataFrame:
    """The `top` leaves of each tree by path score, ties by leaf.  Ranked in parts first: a hot tree isn't one task."""
    parents = messages.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node")).distinct()
    leaves = rooted.join(parents, ["tree_id", "node"], "left_anti")
    order = [F.desc("score"), F.asc("node")]
    leaves = leaves.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)))
    part = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree_id", "salt").orderBy(*order))).where(F.col("branch") <= top)
    return part.withColumn("branch", F.row_number().over(Window.partitionBy("tree_id").orderBy(*order))).where(F.col("branch") <= top).select("tree_id", F.col("node").alias("leaf"), "branch", "score")


def paths(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """A row for each message of each chosen path: tree_id, leaf, branch, score, node, above (distance from the leaf)."""
    at = chosen.select("*", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        both = at.join(jumps[k], ["tree_id", "node"], "left")
        here, there = F.struct("node", "above"), F.struct(F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        at = both.withColumn("x", F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there)))).select("tree_id", "leaf", "branch", "score", "x.node", "x.above")
    return at


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """messages: tree_id, msg_id, parent_id, role, text, score.  One row for each chosen branch: tree_id, leaf, branch,
    score, formatted, and mask, per turn the characters before its text, those of its text, and whether they count
    for the loss (assistant turns)."""
    messages = messages.where("tree_id is not null and msg_id is not null")
    jumps, rooted = jump_tables(messages)
    path = paths(ranked_leaves(messages, rooted, top), jumps)
    texts = messages.select("tree_id", F.col("msg_id").alias("node"), F.concat(F.lit("<|"), escaped_role(F.col("role")), F.lit("|>\n")).alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    turn = F.struct((-F.col("above")).alias("k"), "head", "body", "loss")
    grouped = path.join(texts, ["tree_id", "node"]).groupBy("tree_id", "leaf", "branch", "score").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    mask = F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("before"), F.length(t["body"]).alias("length"), t["loss"].alias("loss")))
    return grouped.select("tree_id", "leaf", "branch", "score", formatted.alias("formatted"), mask.alias("mask"))


def _pieces(formatted: Column) -> Column:
    """A formatted conversation's turns, split at the end marks."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def turns(formatted: Column) -> Column:
    """Read back: an array of (role, text)."""

    def one(p: Column) -> Column:
        role = F.substring_index(p, "|>\n", 1)
        text = F.substring(p, F.length(role) + 4, F.length(p))
        return F.struct(unescaped(F.substring(role, F.lit(3), F.length(role))).alias("role"), unescaped(text).alias("text"))

    return F.transform(_pieces(formatted), one)


def loss_texts(formatted: Column, mask: Column) -> Column:
    """Read back: what the mask marks, unescaped, an array with an empty string for turns that don't count."""
    return F.zip_with(_pieces(formatted), mask, lambda p, m: F.when(m["loss"], unescaped(F.substring(p, m["before"] + 1, m["length"]))).otherwise(""))


def threads(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees of one branch: each row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.where("conv_id is not null").withColumn("msg_id", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").alias("tree_id"), "msg_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def digests(rows: DataFrame) -> DataFrame:
    """Of conversations (conv_id, turn, role, text).  Rows without a conv_id are one conversation, under a null."""
    named = rows.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    out = format_conversations(written(threads(named), "threads"))
    back, loss = turns(F.col("formatted")), F.array_join(loss_texts(F.col("formatted"), F.col("mask")), "")
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.expr("cast(nullif(tree_id, 'none') as bigint)").alias("conv_id"),
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
