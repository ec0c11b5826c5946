"""Reply trees as conversations.

Messages name their parent. Self-joins that double their reach at each round
(ancestors 1, 2, 4, ... steps up) give every message its root, depth and the
score of its path; leaves are ranked in their tree, and the chosen leaves gather
their ancestors in as many rounds. Each chosen path is then one formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotloom.session import cut

#: The template: a turn is OPEN role NEWLINE text CLOSE; escapes stand for the control strings inside roles and texts.
OPEN, ROLE_END, CLOSE = "### ", ":\n", "\n</turn>\n"
#: What a text may not hold, and what stands for it. The escape sign comes first.
ESCAPES = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t"))
_PLAIN = {short[1]: plain for plain, short in ESCAPES} | {"n": "\n"}


def escape(text: str) -> str:
    for plain, short in ESCAPES:
        text = text.replace(plain, short)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


def format_turns(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the code-point ranges under the loss mask: the texts of ``loss_role``."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = OPEN + escape(role).replace("\n", "\\n") + ROLE_END, escape(text)
        if role == loss_role:
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: the inverse of format_turns()."""
    turns = []
    for part in formatted.split(CLOSE)[:-1]:
        head, _, body = part.partition(ROLE_END)
        turns.append((unescape(head[len(OPEN) :]), unescape(body)))
    return turns


def linear_messages(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversation rows as messages of a tree: (tree, node, parent, role, text, score).

    Rows of a conversation are numbered by turn, then role and text, so that
    repeated rows and ties are turns of their own; each replies to the one before.
    A null conversation is one of its own kind; a null text is empty.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _doubled(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Each node's depth and path score, and the tables of ancestors 1, 2, 4, ... steps up."""
    links = cut(nodes.select("tree", "node", "parent", F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum")))
    jumps, most = [], links.count().bit_length() + 1  # no path is longer than all messages
    while links.where("parent is not null").limit(1).count():
        jumps.append(links.where("parent is not null").select("tree", "node", "parent"))
        if len(jumps) > most:
            raise ValueError("a reply cycle: no root above some message")
        up = links.select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("parent").alias("next"), F.col("steps").alias("more"), F.col("sum").alias("above"))
        # Messages that have reached their root are not joined again.
        going = links.where("parent is not null").join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")))
        going = going.select("tree", "node", F.col("next").alias("parent"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("sum") + F.col("above")).alias("sum"))
        links = cut(links.where("parent is null").unionByName(going))
    return links, jumps


def reply_paths(messages: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """Root-to-leaf paths: (tree, leaf, path_rank, depth, node), a row for each message of a chosen path.

    Leaves of a tree are ranked by the mean score of their path, then by depth
    (longer first), then by the smaller node. ``paths_per_tree`` None keeps all.
    A parent that is missing makes its replies roots; a reply cycle is an error.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p")).distinct()
    nodes = nodes.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p")), "left")
    nodes = cut(nodes.select("tree", "node", F.col("p").alias("parent"), "score"))
    totals, jumps = _doubled(nodes)
    parents = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = totals.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    order = Window.partitionBy("tree").orderBy((F.col("sum") / F.col("steps")).desc(), F.col("steps").desc(), "node")
    ranked = leaves.withColumn("path_rank", F.row_number().over(order))
    if paths_per_tree is not None:
        ranked = ranked.where(F.col("path_rank") <= paths_per_tree)
    found = cut(ranked.select("tree", F.col("node").alias("leaf"), "path_rank", F.col("steps").alias("depth"), "node"))
    for jump in jumps:
        up = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("parent").alias("a"))
        higher = found.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        step = F.lit(1 << jumps.index(jump)).cast("long")
        found = cut(found.unionByName(higher.select("tree", "leaf", "path_rank", (F.col("depth") - step).alias("depth"), F.col("a").alias("node"))))
    return found


_FORMATTED = "tree long, leaf long, path_rank int, formatted string, loss array<struct<begin: long, end: long>>"


def format_paths(messages: DataFrame, paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One text per chosen path: (tree, leaf, path_rank, formatted, loss), loss as code-point ranges."""
    texts = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("tree", "leaf", "path_rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                text, mask = format_turns([(t["role"], t["text"]) for t in row.column(3)[0].as_py()], loss_role)
                loss = pa.array([[{"begin": a, "end": b} for a, b in mask]], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), row.column(2), pa.array([text]), loss], ["tree", "leaf", "path_rank", "formatted", "loss"])

    return grouped.mapInArrow(run, _FORMATTED)


def format_conversations(messages: DataFrame, paths_per_tree: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """The best path(s) of every reply tree as formatted conversations.

    ``messages``: (tree, node, parent, role, text, score), nodes unique in a tree.
    A null role or text is empty, a null score zero; an empty table gives none.
    Other columns are ignored.
    """
    messages = cut(messages.select("tree", "node", "parent", "role", "text", "score"))
    return format_paths(messages, reply_paths(messages, paths_per_tree), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests from formatted texts: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                turns = parse_turns(text)
                whole, masked = hashlib.sha256(), hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                chars = 0
                for span in loss:
                    said = unescape(text[span["begin"] : span["end"]])
                    chars += len(said)
                    masked.update(said.encode("utf-8", "surrogatepass"))
                row = (tree, len(turns), whole.hexdigest(), chars, masked.hexdigest(), len(text))
                yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=kinds)

    names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in names])
    return formatted.select("tree", "formatted", "loss").mapInArrow(run, "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
