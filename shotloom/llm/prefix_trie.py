"""The trie of conversation prefixes, from adaptive radix trees over turn ids.

A turn's id is fixed in width and big-endian: 16 bytes of a digest of role and text,
then the text's length in code points. A conversation's key is its ids one after the
other, so that each node of the trie is a byte depth that the id's width divides.

Equal keys are counted first, with their conversation ids in blocks. The distinct keys
are then dealt by ranges, sized by their bytes; each task builds a radix tree of its
range and walks it. A node that no other range can touch is finished there. Those on
the path to a range's first or last key are summed across ranges by the digest of
their prefix; what neighbouring ranges both counted is taken off by comparing the last
key of one with the first of the next, one row a range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.memory import map_batches
from shotloom.llm.radix_tree import RadixTree, shared_bytes
from shotloom.session import broadcast_if_small, written

#: Width of a turn id: digest and length.
DIGEST, WIDTH = 16, 20
#: Bytes of keys that a range is meant to hold; its tree takes some ten times as much.
RANGE_BYTES = 16 << 20
#: Conversation ids are joined in blocks of this many consecutive numbers.
BLOCK = 4096
#: Rows of shared prefixes that are broadcast at most; more are joined by a shuffle.
SHARED_AT_ONCE = 200_000
NOTHING = hashlib.sha256().hexdigest()

_NODE = "path binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, with_copies long, once long, ends string"
_ROW = "kind int, part long, first_key binary, last_key binary, " + _NODE
_NAMES = [field.split()[0] for field in _ROW.split(", ")]
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
_TYPES = [_KINDS[field.split()[1]] for field in _ROW.split(", ")]
#: Kinds of rows that a task returns: a finished node, a node of a range's border, the range's first and last key.
FINISHED, BORDER, RANGE = 0, 1, 2


def turn_id(role: Column, text: Column) -> Column:
    """The fixed-width id of a turn: digest of role and text, then code points of the text."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.concat(F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * DIGEST), F.lpad(F.hex(F.char_length(text)), 2 * (WIDTH - DIGEST), "0")))


def turn_lists(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, ids (of its turns in order).

    ``turns``: conv_id, turn, role, text. Turns go by number, null first; equal numbers
    by turn id. Null roles and texts are empty. Rows without a conv_id are none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ids = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), turn_id(role, text).alias("id")).alias("said"))
    return ids.groupBy("conv_id").agg(F.sort_array(F.collect_list("said"))["id"].alias("ids"))


def rebuild(lists: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like another: the first h turns of conversation c - c % every, then their own after h.

    h is crc32(c as text) % most; % keeps the sign of c. A conversation that is absent
    gives no turns.
    """
    lists = written(lists, "turn-lists")
    heads = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head_id"), F.slice("ids", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = lists.withColumns({"h": h, "head_id": F.col("conv_id") - F.col("conv_id") % every})
    first = F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast("array<binary>"))
    return own.join(heads, "head_id", "left").select("conv_id", F.concat(first, F.slice("ids", F.col("h") + 1, F.size("ids"))).alias("ids"))


def distinct_keys(lists: DataFrame) -> DataFrame:
    """Blocks of each distinct key: key, block, n_convs, conv_id (least), ids (joined by commas, ascending)."""
    key = F.unhex(F.array_join(F.transform("ids", F.hex), ""))
    rows = lists.select(key.alias("key"), F.floor(F.col("conv_id") / BLOCK).alias("block"), "conv_id")
    blocks = rows.groupBy("key", "block").agg(F.sort_array(F.collect_list("conv_id")).alias("of"))
    return blocks.select("key", "block", F.size("of").cast("long").alias("n_convs"), F.col("of")[0].alias("conv_id"), F.array_join(F.col("of").cast("array<string>"), ",").alias("ids"))


class Frame:
    """An open node of the walk: sums of what lies below, and the rows of its finished children."""

    __slots__ = ("border", "children", "conv_id", "digest", "ends", "leaves", "n_convs", "once", "rows", "size", "with_copies")

    def __init__(self, digest, size: int, border: bool) -> None:
        self.digest, self.size, self.border = digest, size, border
        self.conv_id, self.ends, self.rows = None, None, []
        self.n_convs = self.children = self.leaves = self.with_copies = self.once = 0

    def take(self, conv_id: int, n_convs: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n_convs


class Walk:
    """Turns the bytes of a radix tree, node by node, into rows of the turn-aligned prefixes."""

    def __init__(self, part: int) -> None:
        self.part, self.out, self.key = part, [], bytearray()
        self.open = [Frame(hashlib.sha256(), 0, True)]
        self.began = False

    def step(self, depth: int, path: bytes, value: tuple | None) -> None:
        while (len(self.open) - 1) * WIDTH > depth:
            self._close(False)
        del self.key[depth:]
        self.key += path
        for at in range((len(self.open) - 1) * WIDTH, len(self.key) // WIDTH * WIDTH, WIDTH):
            digest = self.open[-1].digest.copy()
            digest.update(self.key[at : at + WIDTH])
            self.open.append(Frame(digest, int.from_bytes(self.key[at + DIGEST : at + WIDTH], "big"), not self.began))
        if value is not None:
            n_convs, conv_id, ends = value
            self.open[-1].take(conv_id, n_convs)
            self.open[-1].ends = ends
            self.began = True

    def finish(self) -> None:
        while self.open:
            self._close(True)

    def _close(self, border: bool) -> None:
        frame = self.open.pop()
        above = self.open[-1] if self.open else None
        border = border or frame.border
        frame.leaves += not frame.children
        frame.with_copies += frame.n_convs * frame.size
        frame.once += frame.size
        path = frame.digest.digest()
        for row in frame.rows:  # the children, whose parent's least member is known now
            row[8], row[5] = (None, path) if border else (frame.conv_id, None)
        self.out += frame.rows
        if above is not None:
            above.take(frame.conv_id, frame.n_convs)
            above.children += 1
            above.leaves += frame.leaves
            above.with_copies += frame.with_copies
            above.once += frame.once
        row = [BORDER if border else FINISHED, self.part, None, None, path if border else None, above.digest.digest() if above and border else None, len(self.open)]
        row += [frame.conv_id, None, frame.n_convs, frame.children, frame.leaves, frame.with_copies, frame.once, frame.ends]
        if not border and above.border:
            row[5] = above.digest.digest()
        (self.out if border or above.border else above.rows).append(row)


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _range_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one range from its blocks, sorted by key and block."""
    tree, first, last = RadixTree(), None, None
    digest, n_convs, least = hashlib.sha256(), 0, None
    for batch in batches:
        for key, count, conv_id, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if key != last:
                if last is not None:
                    tree.set(last, (n_convs, least, digest.hexdigest()))
                digest, n_convs, least = hashlib.sha256(), 0, conv_id
                first, last = key if first is None else first, key
            digest.update((b"," if n_convs else b"") + ids.encode())
            n_convs, least = n_convs + count, min(least, conv_id)
    if last is None:
        return
    tree.set(last, (n_convs, least, digest.hexdigest()))
    part = TaskContext.get().partitionId()
    walk = Walk(part)
    for depth, path, value in tree.walk():
        walk.step(depth, path, value)
        if len(walk.out) >= 4096:
            yield _batch(walk.out)
            walk.out = []
    walk.finish()
    yield _batch(walk.out)
    yield _batch([[RANGE, part, first, last] + [None] * 11])


def _twice_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What two neighbouring ranges both counted, as rows to add, from the last key of one and the first of the next."""
    for batch in batches:
        for part, last, first in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            shared = shared_bytes(last, first) // WIDTH
            sizes = [0] + [int.from_bytes(first[at * WIDTH + DIGEST : at * WIDTH + WIDTH], "big") for at in range(shared)]
            left, digest, rows = sum(sizes), hashlib.sha256(), []
            ended = len(last) == shared * WIDTH
            for depth, size in enumerate(sizes):
                if depth:
                    digest.update(first[(depth - 1) * WIDTH : depth * WIDTH])
                rows.append([BORDER, part, None, None, digest.digest(), None, depth, None, None, 0, -(depth < shared), -ended, 0, -left, None])
                left -= size
            yield _batch(rows)


def prefix_nodes(lists: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``lists`` (conv_id, ids as of ``turn_lists``), one row a distinct prefix.

    Returns conv_id (least member), depth, parent_conv_id (the parent's; null at the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (of the members
    that end there, ascending, joined by commas). Ties can't arise, as equal keys are
    one node; a conversation without turns is a member of the root alone; no
    conversations give no rows, not even a root.

    Keys, not texts, are shuffled. A conversation's key (20 bytes a turn) passes through
    one task as a whole, and the ids of equal conversations through one task's digest,
    block by block; neither is held for more than one conversation or block.
    """
    keys = written(distinct_keys(lists), "keys")
    size = keys.agg(F.sum(F.octet_length("key") + 64)).first()[0]
    if size is None:
        return keys.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    ranges = keys.repartitionByRange(1 + size // RANGE_BYTES, "key").sortWithinPartitions("key", "block")
    rows = written(map_batches(ranges.select("key", "n_convs", "conv_id", "ids"), _range_rows, _ROW), "range-nodes")
    border = _merged_border(rows)
    finished = rows.where(f"kind = {FINISHED}")
    known = border.select(F.col("path").alias("parent"), F.col("conv_id").alias("above"))
    known = broadcast_if_small(known, SHARED_AT_ONCE)
    hanging = finished.where("parent is not null").join(known, "parent").withColumn("parent_conv_id", F.col("above"))
    bordering = border.join(known, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("with_copies") - F.col("once")).alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")]
    out = finished.where("parent is null").select(*columns)
    return out.unionAll(hanging.select(*columns)).unionAll(bordering.select(*columns))


def _merged_border(rows: DataFrame) -> DataFrame:
    """The nodes on the borders of ranges, each once: sums of its parts less what two ranges counted."""
    ends = rows.where(f"kind = {RANGE}").select("part", "first_key", "last_key")
    pairs = ends.withColumn("next_key", F.lead("first_key").over(Window.orderBy("part"))).where("next_key is not null")  # one row a range
    taken = map_batches(pairs.select("part", "last_key", "next_key"), _twice_counted, _ROW)
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "with_copies", "once")]
    parts = rows.where(f"kind = {BORDER}").unionByName(taken)
    return written(parts.groupBy("path").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")), "border-nodes")


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM t),
c AS (SELECT DISTINCT conv_id FROM t),
step AS (WITH RECURSIVE s(b, k, v) AS (SELECT range, 0, range FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM s WHERE k < 8)
  SELECT b, v FROM s WHERE k = 8),
hash AS (WITH RECURSIVE s(conv_id, k, v) AS (SELECT conv_id, 0, 4294967295::BIGINT FROM c
    UNION ALL SELECT s.conv_id, s.k + 1, xor(s.v >> 8, step.v) FROM s JOIN step
      ON step.b = xor(s.v & 255, ascii(substr(s.conv_id::VARCHAR, s.k + 1, 1))::BIGINT) WHERE s.k < length(s.conv_id::VARCHAR))
  SELECT conv_id, xor(v, 4294967295) % 6 AS h FROM s WHERE k = length(conv_id::VARCHAR)),
b AS (SELECT hash.conv_id, p.pos, p.id, length(p.text) AS size FROM hash JOIN p ON p.conv_id = hash.conv_id - hash.conv_id % 100 AND p.pos <= hash.h
  UNION ALL SELECT hash.conv_id, p.pos, p.id, length(p.text) FROM hash JOIN p ON p.conv_id = hash.conv_id AND p.pos > hash.h),
r AS (SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM b),
whole AS (SELECT c.conv_id, coalesce(list(r.id ORDER BY r.d) FILTER (r.id IS NOT NULL), []) AS ids FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, 0 AS d, '' AS node, NULL AS above, 0 AS size, len(ids) = 0 AS ends FROM whole
  UNION ALL SELECT conv_id, d, sha256(array_to_string(ids[1:d], '')), CASE WHEN d > 1 THEN sha256(array_to_string(ids[1:d - 1], '')) ELSE '' END, size, len(ids) = d
    FROM whole JOIN r USING (conv_id)),
n AS (SELECT d, node, min(above) AS above, min(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY d, node),
k AS (SELECT above AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, node)),
s AS (SELECT up.d, up.node, sum((f.n_convs - 1) * f.size) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
  FROM f JOIN m low ON low.conv_id = f.conv_id AND low.d = f.d JOIN m up ON up.conv_id = low.conv_id AND up.d <= low.d GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (d, node) LEFT JOIN n a ON a.d = f.d - 1 AND a.node = f.above
"""
