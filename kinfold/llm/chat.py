"""Chat formatting over reply trees, with built-in functions only.

Self-joins on ancestor pointers whose reach doubles each time list the path
from every leaf to its root.  Branches are ranked by the sum of their messages'
scores, and each chosen path becomes one conversation: a text in which markers
bound the turns, with the spans on which a model is trained.

Template: each turn is ``[turn]role\\ntext[/turn]``.  In texts and roles a
backslash becomes ``\\s``, ``<`` becomes ``\\l`` and ``[`` becomes ``\\b`` (and, in
roles, a line feed ``\\n``), so that no marker or control string of a known
template can occur inside a text, and each can be read back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import checkpoint

OPEN, CLOSE = "[turn]", "[/turn]"
#: Escapes in the order in which they are applied; read back in reverse.
ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, pairs=ESCAPES) -> Column:
    for a, b in reversed(pairs):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def chain_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (conv, msg, parent, role, text, score) of linear conversations: each row answers the one before.

    Rows are ordered by turn, rows of one turn by role and text; null roles and
    texts count as empty ones.  Repeated rows are turns of their own.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    return rows.select("conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, msg, up): every message on the path from each leaf to its root, ``up`` steps above the leaf.

    A message whose parent is null or absent is a root.  Messages of a cycle have
    no leaf below them and are left out.  A null conv is a conversation of its own.
    """
    ids = messages.select("conv", "msg", "parent")
    known = ids.select(F.col("conv").alias("c"), F.col("msg").alias("m")).distinct()
    jump = ids.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("m"))).select(
        F.col("conv"), F.col("msg").alias("from"), F.col("parent").alias("to")
    )
    parents = jump.select(F.col("conv").alias("c"), F.col("to").alias("m")).distinct()
    leaves = ids.join(parents, F.col("conv").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m")), "left_anti")
    found = checkpoint(leaves.select("conv", F.col("msg").alias("leaf"), "msg", F.lit(0).alias("up")))
    jump, reach = checkpoint(jump), 1
    while True:
        step = jump.select(F.col("conv").alias("c"), "from", "to")
        more = found.join(step, F.col("conv").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("from"))).select(
            "conv", "leaf", F.col("to").alias("msg"), (F.col("up") + reach).alias("up")
        )
        more = checkpoint(more)
        if more.isEmpty():
            return found
        found = found.union(more)
        left, right = jump.alias("x"), step.alias("y")
        jump = checkpoint(
            left.join(right, F.col("x.conv").eqNullSafe(F.col("y.c")) & (F.col("x.to") == F.col("y.from"))).select("x.conv", "x.from", "y.to")
        )
        reach *= 2


def format_trees(messages: DataFrame, best: int = 1, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv, leaf, rank, formatted, mask): the ``best`` branches of each conversation, best first.

    messages holds (conv, msg, parent, role, text, score); msg is unique in its
    conversation.  Branches rank by the sum of their scores, longer ones before
    shorter ones among equals, then by the smallest leaf.  mask lists the spans
    (start, end; code points, end exclusive) of the texts of trained roles,
    without their markers.  No messages give no rows.
    """
    marked = messages.select(
        "conv", "msg", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit("")), ROLE_ESCAPES), F.lit("\n")).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role").isin(*trained_roles), F.lit(False)).alias("trained"),
    )
    p = paths(messages).select(F.col("conv").alias("c"), "leaf", F.col("msg").alias("m"), "up")
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m"))
    ranked = p.join(marked.select("conv", "msg", "score"), on).groupBy("conv", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n"))
    by = Window.partitionBy("conv").orderBy(F.desc("score"), F.desc("n"), "leaf")
    chosen = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= best).select(F.col("conv").alias("cc"), F.col("leaf").alias("ll"), "rank")
    rows = p.join(chosen, F.col("c").eqNullSafe(F.col("cc")) & (F.col("leaf") == F.col("ll"))).join(marked, on)
    turns = rows.groupBy("conv", "leaf", "rank").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "trained"))).alias("turns")
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("mask"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["body"])
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct((b + len(CLOSE)).alias("at"), F.when(x["trained"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    return turns.select(
        "conv", "leaf", "rank",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("turns", start, add, lambda acc: acc["mask"]).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were before formatting."""
    body = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))
    parts = F.split(body, r"\[/turn\]\[turn\]", -1)

    def cut(x: Column) -> Column:
        at = F.instr(x, "\n")
        return F.struct(
            unescape(F.substring(x, F.lit(1), at - 1), ROLE_ESCAPES).alias("role"), unescape(F.substring(x, at + 1, F.length(x))).alias("text")
        )

    return F.transform(parts, cut)


def read_mask(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, as they were before formatting."""
    return F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"])))
