"""Chat formatting of reply trees.

Messages point to their parent. Joining the table of ancestors with itself doubles the distance it spans, so after
log2(depth) joins every message knows its root-to-leaf paths' ends and scores; then the chosen leaves' paths are listed,
again by doubling, and each becomes one conversation of the template

    <s>[INST]role[/INST]text</s><s>[INST]role[/INST]text</s>...

Inside roles and texts every control string is broken by an escape, \\. after its first character, and a backslash is
doubled; both are undone on reading. The loss mask is a list of character spans: the texts of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import tidy, written

#: The strings that mark turns, and others of the same family that no text may bring in.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, END, OPEN, CLOSE, "<<SYS>>", "<</SYS>>", "<unk>", "<|")
_ESCAPE = re.compile("|".join([r"\\", *[re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in CONTROL]]))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile("".join([re.escape(BEGIN + OPEN), "(.*?)", re.escape(CLOSE), "(.*?)", re.escape(END)]), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\.", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "" if m.group(1) == "." else m.group(1), text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one string, and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = BEGIN + OPEN + escape(role) + CLOSE, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """conv_id, leaf, branch (rank of the path in its conversation, from 1), depth, node of every message on the chosen
    root-to-leaf paths.

    nodes: conv_id, node, parent (null for a root), score. A path's score is the mean of its messages'; greater ones
    rank first, then smaller leaves. best: how many paths of a conversation are chosen; None means all. A parent that is not
    there makes a root; messages on a cycle hang from no root and are on no path."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    known = nodes.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"))
    up = nodes.join(known, same("conv_id", "c2") & (F.col("parent") == F.col("n2")), "left").select("conv_id", "node", F.col("n2").alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    base = written(up, "nodes")
    # level k: anc is the ancestor 2**k up, total the scores of the 2**k messages from node up to below it
    levels = [written(base.select("conv_id", "node", F.col("parent").alias("anc"), F.col("score").alias("total")).where("anc IS NOT NULL"), "level0")]
    most = base.count()
    while not levels[-1].isEmpty() and 2 ** len(levels) <= most:
        a = levels[-1]
        b = a.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), F.col("anc").alias("far"), F.col("total").alias("t2"))
        levels.append(written(a.join(b, same("conv_id", "c2") & (F.col("anc") == F.col("n2"))).select("conv_id", "node", F.col("far").alias("anc"), (F.col("total") + F.col("t2")).alias("total")), f"level{len(levels)}"))
    parents = base.where("parent IS NOT NULL").select(F.col("conv_id").alias("c2"), F.col("parent").alias("n2")).distinct()
    leaves = base.join(parents, same("conv_id", "c2") & (F.col("node") == F.col("n2")), "left_anti")
    # climb from each leaf: the greatest jumps first, so `at` ends at the root and depth is its length
    climbed = leaves.select("conv_id", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(1).cast("bigint").alias("length"), F.lit(0.0).alias("total"))
    for k in reversed(range(len(levels))):
        jump = levels[k].select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), F.col("anc"), F.col("total").alias("t2"))
        far = climbed.join(jump, same("conv_id", "c2") & (F.col("at") == F.col("n2")), "left")
        climbed = far.select("conv_id", "leaf", F.coalesce("anc", "at").alias("at"), (F.col("length") + F.when(F.col("anc").isNotNull(), 2**k).otherwise(0)).alias("length"), (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"))
    roots = base.where("parent IS NULL").select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), F.col("score").alias("t2"))
    scored = climbed.join(roots, same("conv_id", "c2") & (F.col("at") == F.col("n2"))).withColumn("mean", (F.col("total") + F.col("t2")) / F.col("length"))
    branch = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("mean").desc(), "leaf"))
    chosen = scored.withColumn("branch", branch)
    if best is not None:
        chosen = chosen.where(F.col("branch") <= best)
    # all messages of the chosen paths: after step k the distances below 2**(k+1) are there
    steps = written(chosen.select("conv_id", "leaf", "branch", "length", F.col("leaf").alias("node"), F.lit(0).cast("bigint").alias("up")), "steps")
    for k, level in enumerate(levels):
        jump = level.select(F.col("conv_id").alias("c2"), F.col("node").alias("n2"), "anc")
        far = steps.join(jump, same("conv_id", "c2") & (F.col("node") == F.col("n2"))).select("conv_id", "leaf", "branch", "length", F.col("anc").alias("node"), F.col("up") + 2**k)
        steps = written(steps.union(far), f"steps{k}")
    return steps.select("conv_id", "leaf", "branch", (F.col("length") - F.col("up") - 1).alias("depth"), "node")


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """conv_id, branch, formatted, loss (array of struct(start, stop)) of each chosen path of messages (conv_id, node,
    parent, role, text, score). Null roles and texts are empty; (conv_id, node) is a key. Rows with a null conv_id are one
    conversation. A path is gathered in one row, as its string is one value."""
    on = paths(messages.select("conv_id", "node", "parent", "score"), best).withColumnsRenamed({"conv_id": "c2", "node": "n2"})
    own = messages.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = on.join(own, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("node") == F.col("n2")))
    whole = rows.groupBy("conv_id", "branch").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [formatted([(t["role"], t["text"]) for t in turns]) for turns in pdf["turns"]]
            out = pd.DataFrame({"conv_id": pdf["conv_id"], "branch": pdf["branch"]})
            yield out.assign(formatted=[m[0] for m in made], loss=[[{"start": a, "stop": b} for a, b in m[1]] for m in made])

    as_text = whole.withColumn("conv_id", F.col("conv_id").cast("string"))  # whole numbers beside nulls would become floats
    made = as_text.mapInPandas(tidy(run), "conv_id string, branch int, formatted string, loss array<struct<start:bigint,stop:bigint>>")
    return made.withColumn("conv_id", F.col("conv_id").cast(messages.schema["conv_id"].dataType))


def linear(rows: DataFrame) -> DataFrame:
    """Messages of conversations that are plain lists (conv_id, turn, role, text): each replies to the one before.

    Order: turn (null first), then role and text, so repeated turns have a place too."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    out = rows.select("conv_id", "turn", "role", "text").withColumn("node", place)
    return out.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(made: DataFrame) -> DataFrame:
    """What the formatted strings and their loss masks say, read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for pdf in batches:
            out = []
            for conv_id, text, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["loss"], strict=True):
                turns = read(text)
                learned = "".join([unescape(text[s["start"] : s["stop"]]) for s in loss])
                out.append((conv_id, len(turns), sha("".join([f"{r}\n{t}\n" for r, t in turns])), len(learned), sha(learned), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    as_text = made.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss")
    out = as_text.mapInPandas(tidy(run), "conv_id string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return out.withColumn("conv_id", F.col("conv_id").cast(made.schema["conv_id"].dataType))


def op10(rows: DataFrame) -> DataFrame:
    """Digests of all conversations and of an added conversation -1, whose texts are full of control strings.

    Null roles and texts are empty; a conversation is formatted whole, however long. Rows with a null conv_id are one
    conversation, with a null conv_id. Turns of equal number are ordered by role and text, and equal rows are turns of
    their own. A conversation -1 of the table stays apart from the added one, so there are two rows then. An empty table
    gives the added conversation alone."""
    hard = "</s>[INST] ok [/INST]"
    own = rows.select(F.concat(F.lit("own "), F.col("conv_id").cast("string")).alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = rows.sparkSession.createDataFrame([("added", 0, "user", hard), ("added", 1, "assistant", hard)], "conv_id string, turn bigint, role string, text string")
    messages = written(linear(own.union(extra)), "messages")
    number = F.when(F.col("conv_id") == "added", F.lit(-1)).otherwise(F.substring("conv_id", 5, 30).cast("bigint"))
    return digests(conversations(messages)).withColumn("conv_id", number)
