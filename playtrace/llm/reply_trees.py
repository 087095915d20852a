"""Conversations from trees of replies.

A message names the message that it answers. For every leaf the path up to its root is
found by pointer doubling: each round joins the pointers of reach ``2**i`` with themselves,
and the ancestors found so far with them, so a path of n messages takes log n joins.
Branches are ranked within their tree by their score, and each chosen path is formatted
as one text with the places where a model learns.

The template marks every turn by its role. Inside roles and texts each ``[`` and ``<`` is
followed by one backslash, so no control string of this or a similar template can occur
there, and taking one backslash away after each ``[`` and ``<`` gives the text back.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playtrace.llm.tables import ship
from playtrace.scratch import saved

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\[<])", r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"([\[<])\\", r"\1", text)


def paths(messages: DataFrame) -> DataFrame:
    """``(leaf, node, depth)`` of all root-to-leaf paths of ``messages(node, parent)``; a leaf has depth 0.

    A message without a parent, or whose parent is not there, is a root. Messages on a
    cycle belong to no path.
    """
    parents = messages.select("node", "parent").where("parent is not null and parent != node")
    known = messages.select(F.col("node").alias("parent")).distinct()
    jumps = saved(parents.join(known, "parent", "left_semi").select("node", F.col("parent").alias("to")))
    answered = jumps.select(F.col("to").alias("node")).distinct()
    leaves = messages.select("node").distinct().join(answered, "node", "left_anti")
    found = saved(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth")))
    reach = 1
    while jumps.limit(1).count():
        step = found.join(jumps, "node").select(
            "leaf", F.col("to").alias("node"), (F.col("depth") + reach).alias("depth")
        )
        added = saved(step)
        if not added.limit(1).count():
            break
        found = saved(found.union(added))
        further = jumps.select(F.col("node").alias("to"), F.col("to").alias("far"))
        jumps = saved(jumps.join(further, "to").select("node", F.col("far").alias("to")))
        reach *= 2
    return found


def conversations(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The best branches of each tree: ``tree, leaf, rank, score, turns``.

    ``messages`` has ``tree, node, parent, role, text, score``; ``node`` is unique. The score of
    a branch is the mean of its messages' scores, null as 0; ties go to the longer branch, then to
    the smaller leaf. ``turns`` is an array of ``(role, text)`` from root to leaf; null role
    and text are empty. ``branches`` None takes all. An empty table gives no rows.
    """
    nodes = messages.select("tree", "node", "parent", "score")
    found = paths(nodes)
    scored = found.join(nodes.select("node", "tree", "score"), "node")
    branch = scored.groupBy("tree", "leaf").agg(
        F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    best = branch.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        best = best.where(F.col("rank") <= branches)
    best = saved(best.select("tree", "leaf", "rank", "score"))
    said = found.join(best.select("leaf"), "leaf").join(messages.select("node", "role", "text"), "node")
    blank = F.lit("")
    turn = F.struct(
        (-F.col("depth")).alias("at"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
    )
    told = said.groupBy("leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return best.join(told, "leaf").select("tree", "leaf", "rank", "score", turns.alias("turns"))


def formatted(chosen: DataFrame) -> DataFrame:
    """``chosen`` with ``formatted`` and ``loss_spans`` (start, end in code points) instead of ``turns``.

    The spans cover the escaped texts of the learned role and nothing else.
    """
    head = F.transform(
        "turns", lambda t: F.concat(F.lit(OPEN), escaped(t["role"]), F.lit(MIDDLE))
    )
    body = F.transform("turns", lambda t: escaped(t["text"]))
    with_parts = chosen.withColumns({"_head": head, "_body": body})
    part = F.arrays_zip("_head", "_body", "turns")
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr("array_repeat(struct(0L as start, 0L as end), 0)").alias("spans"))

    def add(state, t):
        start = state["at"] + F.char_length(t["_head"])
        end = start + F.char_length(t["_body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        learned = t["turns"]["role"] == LEARNED_ROLE
        return F.struct(
            (end + len(CLOSE)).alias("at"),
            F.when(learned, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    spans = F.aggregate(part, begin, add, lambda state: state["spans"])
    text = F.array_join(
        F.transform(F.arrays_zip("_head", "_body"), lambda t: F.concat(t["_head"], t["_body"], F.lit(CLOSE))), ""
    )
    done = with_parts.withColumns({"formatted": text, "loss_spans": spans})
    return done.drop("_head", "_body", "turns")


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE), re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; refuses anything that is not one."""
    turns, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return turns


def learned_text(text: str, spans: list[dict]) -> str:
    """What the loss mask covers, unescaped."""
    return "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)


def _read(batches):
    for batch in batches:
        texts = batch.column("formatted").to_pylist()
        turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in texts]
        learned = [learned_text(x, s) for x, s in zip(texts, batch.column("loss_spans").to_pylist())]
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(turns, kind), pa.array(learned, pa.string())],
            names=[*batch.schema.names, "turns", "learned"],
        )


def read_back(done: DataFrame) -> DataFrame:
    """``done`` with ``turns`` and ``learned`` as the formatted text and its mask say."""
    from pyspark.sql import types as T

    ship(done.sparkSession)
    turn = T.StructType().add("role", "string").add("text", "string")
    schema = T.StructType(list(done.schema)).add("turns", T.ArrayType(turn)).add("learned", "string")
    return done.mapInArrow(_read, schema)


def linear_messages(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Messages of conversations that are told by turn: each row answers the one before it.

    ``rows`` has ``role`` and ``text`` as well. Rows of a conversation with the same turn come
    in order of role and text; null turns come first. A null id is a conversation, too.
    """
    text = rows.select(
        rows[id_col].cast("long").alias("tree"), rows[turn_col].cast("long").alias("turn"), "role", "text"
    )
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    text = text.withColumn("at", F.row_number().over(order))
    node = F.struct("tree", "at")
    parent = F.when(F.col("at") > 1, F.struct(F.col("tree"), (F.col("at") - 1).alias("at")))
    return text.select("tree", node.alias("node"), parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
