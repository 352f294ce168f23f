"""Reply trees to chat transcripts.

A message has an id, its parent's id, a role, a text and a score. Iterative self-joins double a pointer to each
message's ancestors, so that a tree of depth d takes log2(d) joins: they give every message its root, depth and summed
score, and every leaf is the end of one root-to-leaf path. A tree's paths are ranked by mean score, then by length,
then by the leaf's id, and the chosen ones are unrolled along the same pointers and formatted as one conversation each.

The template marks turns with control strings. A backslash goes before each backslash, ``<`` and ``#`` of a text (and
``:`` of a role), so a text never forms a control string and reading back is exact.

Defined results: a null text is empty; a null role is ``user``; a message whose parent is absent is a root, and so is
each message with a null parent; messages on a cycle have no root and are left out, and so are those of no tree (null
tree or message id); repeated ids keep their first row by role and text; the turns of linear conversations without an
id form one conversation whose id is null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lasting, temporary, written

OPEN, CLOSE = "### {role}: ", " </turn>\n"
#: The role whose texts are trained on.
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """The text with a backslash before each backslash, ``<`` and ``#``."""
    return F.regexp_replace(text, r"([\\<#])", r"\\$1")


def from_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as messages: each turn replies to the one before it; ties go by role, then text.

    Every row is a message of its own, rows that repeat a turn included; its id is its place in the conversation.
    """
    order = Window.partitionBy("tree_id").orderBy("at", "role", "text")
    base = rows.select(
        F.col(conv).alias("tree_id"), F.col(turn).alias("at"), F.coalesce("role", F.lit("user")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = base.withColumn("message_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return placed.select("tree_id", "message_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def ranked(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree_id, id of the leaf, depth, path_score, rank) of each tree's ``best`` root-to-leaf paths, all for None."""
    parents = nodes.select("tree_id", F.col("parent_id").alias("id")).where("id is not null").distinct()
    leaves = nodes.where("rooted").join(parents, ["tree_id", "id"], "left_anti")
    leaves = leaves.select("tree_id", "id", "depth", (F.col("total") / F.col("depth")).alias("path_score"))
    order = Window.partitionBy("tree_id").orderBy(F.desc("path_score"), F.desc("depth"), "id")
    out = leaves.withColumn("rank", F.row_number().over(order))
    return out if best is None else out.where(F.col("rank") <= best)


def doubled(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes with depth, summed score and whether a root is above them, and the ancestor 2^k steps up for each k.

    Round k joins the table with itself: a node's pointer 2^k up moves to its ancestor's pointer. It ends when no
    pointer is left, or when no node found its root in a round while some still look, which only cycles do.
    """
    first = Window.partitionBy("tree_id", "message_id").orderBy(F.col("parent_id").asc_nulls_first(), "role", "text")
    messages = messages.where("tree_id is not null and message_id is not null")
    slim = messages.select("tree_id", F.col("message_id").alias("id"), "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"),
                           F.row_number().over(first).alias("n")).where("n = 1")
    known = slim.select("tree_id", F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    slim = slim.join(known, ["tree_id", "parent_id"], "left").select(
        "tree_id", "id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), "score"
    )
    base, jumps = written(slim, "chat-nodes")[0], []
    # total and steps cover the node and what lies between it and its pointer, the pointer left out
    state = base.select("tree_id", "id", "parent_id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("steps"),
                        F.col("score").alias("total"))
    left, before = state.where("up is not null").count(), None
    while left and left != before:
        jumps.append(state.where("up is not null").select("tree_id", "id", "up"))
        above = state.select("tree_id", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("s2"), F.col("total").alias("t2"))
        # only what still looks for its root is joined, so rounds after the first few touch the deep trees alone
        moved = state.where("up is not null").join(above, ["tree_id", "up"]).select(
            "tree_id", "id", "parent_id", F.col("up2").alias("up"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("total") + F.col("t2")).alias("total")
        )
        state, _ = written(state.where("up is null").unionByName(moved), "chat-jump")
        before, left = left, state.where("up is not null").count()
    nodes = state.select("tree_id", "id", "parent_id", F.col("steps").alias("depth"), "total", F.col("up").isNull().alias("rooted"))
    return nodes, jumps


def unroll(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """The turns of the chosen paths: tree_id, rank, leaf_id, at (from 1), role, text."""
    nodes, jumps = doubled(messages)
    chosen = ranked(nodes, best)
    # Each distance is a sum of distinct powers of two, so going through the jumps once meets every ancestor once.
    on_path = chosen.select("tree_id", "rank", F.col("id").alias("leaf_id"), "id")
    for up in reversed(jumps):
        higher = on_path.join(up, ["tree_id", "id"]).select("tree_id", "rank", "leaf_id", F.col("up").alias("id"))
        on_path, _ = written(on_path.unionByName(higher), "chat-path")  # used twice a round: written, not planned anew
    one = Window.partitionBy("tree_id", "id").orderBy(F.col("parent_id").asc_nulls_first(), "role", "text")
    texts = messages.select("tree_id", F.col("message_id").alias("id"), "parent_id", F.coalesce("role", F.lit("user")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n", "parent_id")
    return (
        on_path.join(nodes.select("tree_id", "id", F.col("depth").alias("at")), ["tree_id", "id"])
        .join(texts, ["tree_id", "id"])
        .select("tree_id", "rank", "leaf_id", "at", "role", "text")
    )


def format_paths(turns: DataFrame) -> DataFrame:
    """One row a path: tree_id, rank, formatted, and the loss mask as spans (code points) of the formatted text.

    A conversation is one string by definition, so its turns meet in one row; no other grouping is made.
    """
    open_, close = OPEN.split("{role}")
    head = F.concat(F.lit(open_), F.regexp_replace(escape(F.col("role")), ":", r"\\:"), F.lit(close))
    body = escape(F.col("text"))
    sized = turns.select(
        "tree_id", "rank",
        F.struct("at", F.concat(head, body, F.lit(CLOSE)).alias("s"), F.length(head).alias("h"), F.length(body).alias("b"),
                 (F.col("role") == TRAINED).alias("loss")).alias("t"),
    )
    grouped = sized.groupBy("tree_id", "rank").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    spans = (
        "aggregate(ts, named_struct('at', 0L, 'out', cast(array() as array<struct<start:bigint,stop:bigint>>)), (a, t) -> "
        "named_struct('at', a.at + length(t.s), 'out', if(t.loss, concat(a.out, array(named_struct("
        "'start', a.at + t.h, 'stop', a.at + t.h + t.b))), a.out)), a -> a.out)"
    )
    return grouped.select(
        "tree_id", "rank", F.expr("array_join(transform(ts, t -> t.s), '')").alias("formatted"), F.expr(spans).alias("loss")
    )


#: A turn of a formatted text: its role, and its escaped text with the blank that follows it.
TURN = r"(?s)### ((?:[^\\<#:]|\\.)*+): ((?:[^\\<#]|\\.)*+)</turn>\n"


def read_back(formatted: DataFrame) -> DataFrame:
    """The input with ``turns``, an array of (role, text), and ``trained``, the text under the loss mask."""
    import re

    turn, plain = re.compile(TURN), re.compile(r"(?s)\\(.)")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            turns, trained = [], []
            for text, loss in zip(pdf["formatted"], pdf["loss"], strict=True):
                found, at = [], 0
                for m in turn.finditer(text):
                    if m.start() != at:
                        break
                    found.append({"role": plain.sub(r"\1", m[1]), "text": plain.sub(r"\1", m[2][:-1])})
                    at = m.end()
                if at != len(text):
                    raise ValueError(f"no turn at character {at} of a formatted conversation")
                turns.append(found)
                trained.append("".join(plain.sub(r"\1", text[s["start"] : s["stop"]]) for s in loss))
            yield pdf[["key", "formatted"]].assign(turns=turns, trained=trained)

    keyed = formatted.select(F.to_json(F.struct("tree_id", "rank")).alias("key"), "formatted", "loss")
    out = keyed.mapInPandas(read, "key string, formatted string, turns array<struct<role:string,text:string>>, trained string")
    kinds = ", ".join(f"{c} {formatted.schema[c].dataType.simpleString()}" for c in ("tree_id", "rank"))
    return out.select(F.from_json("key", kinds).alias("k"), "*").select("k.*", "formatted", "turns", "trained")


def conversations(rows: DataFrame, best: int | None = 1) -> DataFrame:
    """Linear conversations formatted, written, and read back from what was written."""
    spark = rows.sparkSession
    with temporary(spark):
        # A null id groups and joins like any other inside a struct.
        messages, _ = written(from_turns(rows.withColumn("conv_id", F.struct(F.col("conv_id").alias("id")))), "chat-messages")
        formatted, _ = lasting(format_paths(unroll(messages, best)), "chat-formatted")
    return read_back(formatted).withColumn("tree_id", F.col("tree_id")["id"])


def digest(rows: DataFrame) -> DataFrame:
    """Digests of what is read back from each formatted conversation."""
    turns = F.expr("array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), '')")
    return conversations(rows).select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
