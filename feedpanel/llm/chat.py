"""Conversations from reply trees: paths, branches by score, a reversible chat format with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedpanel.session import materialize

START, END = "<|im_start|>", "<|im_end|>"


# --- trees ----------------------------------------------------------------------
def paths(messages: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)`` for every node of every root-to-leaf path of ``messages(tree, node, parent)``.

    ``up`` is the node's distance from the leaf. Every round joins the pointers of all nodes with themselves, which
    doubles their reach, and lets each path found so far reach as much further up; so the number of rounds is the
    logarithm of the greatest depth, and the rows grow with the length of the paths only. Every round stores what is
    found as one table, so the plan of the result is the same at any depth. A node whose parent is null or
    missing is a root. Nodes on a cycle, and what answers them, have no root and are left out.
    """
    nodes = messages.select("tree", "node", "parent")
    known = messages.select("tree", F.col("node").alias("parent")).distinct()
    hop = materialize(nodes.join(known, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("to")))
    inner = hop.select("tree", F.col("to").alias("node"))
    found = materialize(nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")))
    roots = nodes.join(hop, ["tree", "node"], "left_anti").select("tree", "node")
    largest, reach = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0, 1
    while True:
        further = found.join(hop, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"))
        further = materialize(further.filter(F.col("up") < largest))  # only a path into a cycle is longer
        if further.isEmpty():
            break
        found = materialize(found.unionAll(further))
        reach *= 2
        onward = hop.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        hop = materialize(hop.join(onward, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")))
    rooted = found.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return materialize(found.join(rooted, ["tree", "leaf"], "left_semi"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """The paths of the ``branches`` best leaves of every tree, with their ``rank``.

    A branch's score is the mean of its messages' ``score`` (null counts as 0); equal ones rank by length, the longer
    first, then by leaf. Only the best leaves of a task are sent on, so a tree of many branches does not meet in one task.
    """
    along = paths(messages)
    scored = along.join(messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    leaves = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("length"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("length"), "leaf"))
    chosen = leaves.withColumn("rank", rank).filter(F.col("rank") <= branches).select("tree", "leaf", "rank")
    return along.join(chosen, ["tree", "leaf"])


# --- format -----------------------------------------------------------------------
def escaped(text: Column) -> Column:
    """Backslashes are doubled, and one parts the first two characters of a control string."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _role(role: Column) -> Column:
    """A role ends at the first line break, so its own ones are written as \\n."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


_ROLE_MARK = re.compile(r"\\(.)", re.S)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn, read back; start and end are those of the escaped text."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line + 1)
        role = _ROLE_MARK.sub(lambda m: "\n" if m[1] == "n" else m[1], formatted[at + len(START) : line])
        turns.append((role, unescaped(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``(tree, rank, formatted, loss)``: the chosen paths of ``messages(tree, node, parent, role, text, score)``.

    A turn is START, role, line break, text, END, line break. ``loss`` lists (start, end) of the assistants' texts in code
    points of ``formatted``, to which a model's loss is restricted. Control strings inside texts and roles are escaped, so
    ``read_turns`` gives back every turn as it was. Null texts and roles are empty.
    """
    turns = best_paths(messages, branches).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    piece = F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    turns = turns.select("tree", "rank", "up", piece.alias("head"), body.alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("answer"))
    turn = F.struct((-F.col("up")).alias("order"), "head", "body", "answer")
    lists = turns.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    tail = END + "\n"
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        mask = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(tail)).alias("at"), F.when(t["answer"], F.concat(a["loss"], mask)).otherwise(a["loss"]).alias("loss"))

    return lists.select("tree", "rank", whole.alias("formatted"), F.aggregate("turns", none, step, lambda a: a["loss"]).alias("loss"))


def chain(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of linear conversations: every row answers the one before it.

    Rows follow by turn, null first, then role and text, so ties and repeated rows are turns of their own, in a fixed order.
    """
    order = Window.partitionBy(id_col).orderBy(turn_col, role_col, text_col)
    node = F.row_number().over(order)
    return turns.select(
        F.col(id_col).alias("tree"), node.alias("node"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.lit(0.0).alias("score")
    ).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", "score")


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for conv, text, loss in zip(frame["tree"], frame["formatted"], frame["loss"], strict=True):
            turns = read_turns(text)
            whole = "".join(f"{role}\n{body}\n" for role, body, _, _ in turns)
            spans = [(int(s["start"]), int(s["end"])) for s in loss]
            learned = "".join(unescaped(text[a:b]) for a, b in spans)
            rows.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
        yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def conversation_report(turns: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations of ``turns(conv_id, turn, role, text)``.

    A null conv_id is one conversation. Other columns are ignored; an empty table gives an empty result.
    """
    key = turns.select(F.struct(F.col("conv_id").alias("conv_id")).alias("conv"), "turn", "role", "text")
    made = formatted(materialize(chain(key, "conv"))).select(F.col("tree.conv_id").alias("tree"), "formatted", "loss")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return made.mapInPandas(
        _digests, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
