"""Order-dependent folds over keys that are larger than a task.

Rows are dealt by ranges of key and order, so that a key may span tasks. Each task
says what state its last key leaves behind. That needs the state which the range
before it left, unless the key begins in the range or some row *forgets*: after it the
state is the same whatever came before (two points so far apart that the second
starts anew). Ranges that lack their entry state are asked again when the one before
has been answered; only one small row a range is looked at on the driver. Then every
range folds its rows from its true entry state.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from shotloom.session import written


class Fold(Protocol):
    """Steps over the rows of a key in order; a state is None before the first row."""

    def step(self, state: Any, row: tuple) -> tuple[Any, Any]:
        """The next state, and what is finished by it or None."""

    def last(self, state: Any) -> Any:
        """What is finished when the key ends, or None."""

    def forgets(self, before: tuple, row: tuple) -> bool:
        """Whether the state after ``row`` is the same for all states that ``before`` can have left."""


class MinGap:
    """Points (at, score, id) at least ``gap`` apart: a nearer one replaces the last kept if its score is higher."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def step(self, state, row):
        if state is None or row[0] - state[0] >= self.gap:
            return row, state
        return (row, None) if row[1] > state[1] else (state, None)

    def last(self, state):
        return state

    def forgets(self, before, row):
        return row[0] - before[0] >= self.gap


class MergeNear:
    """Points (at, reason) that join the last anchor within ``within``; a strong one moves it, a fixed one stands alone."""

    def __init__(self, within: int, strong: str, fixed: tuple[str, ...]) -> None:
        self.within, self.strong, self.fixed = within, strong, fixed

    def step(self, state, row):
        at, why = row
        if state is None or why in self.fixed or state[2] or at - state[0] > self.within:
            return (at, (why,), why in self.fixed), self.last(state)
        return (at if why == self.strong else state[0], tuple(sorted({*state[1], why})), False), None

    def last(self, state):
        return None if state is None else (state[0], "+".join(state[1]))

    def forgets(self, before, row):
        return row[1] in self.fixed or row[0] - before[0] > self.within


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, key, row) of rows sorted by part, key and order."""
    for batch in batches:
        for part, key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield part, key, tuple(row)


def _exit_states(fold: Fold, entry: dict[int, Any] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, first key, last key, known, state): the state that each part leaves; ``entry`` holds the states known so far."""
    part = first = key = before = state = None
    known = False
    for now, name, row in _parts(batches):
        if now != part:
            if part is not None:
                yield part, first, key, known, state
            part, first, key, before = now, name, name, None
            known = entry is not None and part in entry
            state = entry[part] if known else None
        elif name != key:
            key, before, state, known = name, None, None, True
        if before is not None and not known and fold.forgets(before, row):
            known, state = True, None
        if known:
            state = fold.step(state, row)[0]
        before = row
    if part is not None:
        yield part, first, key, known, state


def _entry_states(parts: DataFrame, fold: Fold, sorted_parts: Callable[[DataFrame], DataFrame]) -> tuple[dict[int, Any], dict[int, Any], set[int]]:
    """State with which each part begins a key of the part before, the last key of each part that the next one continues, and the parts of one key."""

    def ask(some: DataFrame, entry: dict[int, Any] | None) -> dict[int, tuple]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [(part, pickle.dumps((first, last, known, state))) for part, first, last, known, state in _exit_states(fold, entry, batches)]
            columns = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["part", "told"])

        rows = sorted_parts(some).mapInArrow(run, "part long, told binary").collect()  # one small row a part
        return {r.part: pickle.loads(r.told) for r in rows}

    told = ask(parts, None)
    while True:
        entry, open_parts, before = {}, {}, None
        for part in sorted(told):
            first, _, known, _ = told[part]
            goes_on = before is not None and told[before][1] == first
            if goes_on and told[before][2]:
                entry[part] = told[before][3]
            if not known and (not goes_on or part in entry):
                open_parts[part] = entry.get(part)
            before = part
        if not open_parts:
            break
        told |= ask(parts.where(F.col("part").isin(*open_parts)), open_parts)
    order = sorted(told)
    return entry, {p: told[p][1] for p, q in zip(order, order[1:], strict=False) if told[p][1] == told[q][0]}, {p for p in order if told[p][0] == told[p][1]}


def spanning_fold(rows: DataFrame, key: str, order: list[tuple[str, bool]], columns: list[str], fold: Fold, out_schema: str, n_ranges: int | None = None) -> DataFrame:
    """What ``fold`` finishes for each key, numbered from 1: key, number, and the columns of ``out_schema``.

    ``order``: (column, descending) of the rows of a key; it has to be total for one
    result. ``columns``: what the fold gets of a row. Null keys are one key; no rows
    give none. A task holds one state and one batch, the driver one state a range.
    """
    kinds = dict(rows.dtypes)
    by = [F.desc(c) if down else F.asc(c) for c, down in order]
    needed = list(dict.fromkeys([key, *columns, *(c for c, _ in order)]))
    n_ranges = n_ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*needed).repartitionByRange(n_ranges, F.asc(key), *by)
    parts = written(dealt.withColumn("part", F.spark_partition_id().cast("long")), "ranges")

    def sorted_parts(some: DataFrame) -> DataFrame:
        return some.repartition("part").sortWithinPartitions("part", F.asc(key), *by).select("part", key, *columns)

    entry, continued, single = _entry_states(parts, fold, sorted_parts)
    schema = StructType.fromDDL(f"part long, {key} {kinds[key]}, number long, head boolean, tail boolean, {out_schema}")
    fields = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        part = name = state = None
        number, head, tail, began = 0, False, False, False

        def finished(done: tuple | None) -> None:
            nonlocal number
            if done is not None:
                number += 1
                out.append((part, name, number, head, tail, *done))

        def table() -> pa.RecordBatch:
            held = list(zip(*out, strict=True)) or [[]] * len(fields)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(held, fields, strict=True)], [n for n, _ in fields])

        for now, own, row in _parts(batches):
            if not began or now != part or own != name:
                if began and not tail or now == part:
                    finished(fold.last(state))
                head = (not began or now != part) and now in entry
                state = entry[now] if head else None
                part, name, number, began = now, own, 0, True
                tail = part in continued and continued[part] == name
            state, done = fold.step(state, row)
            finished(done)
            if len(out) >= 1000:
                yield table()
        if began and not tail:
            finished(fold.last(state))
        yield table()

    folded = written(sorted_parts(parts).mapInArrow(run, schema), "folded")
    counts = folded.groupBy("part").agg(F.count_if("tail").alias("tail")).collect() if continued else []  # one row a range
    shifts, carried, of = [], 0, {r.part: r for r in counts}
    for part in sorted({*entry, *continued}):
        if part not in entry:
            carried = 0
        elif carried:
            shifts.append((part, carried))
        r = of.get(part)
        carried = (carried if part in single else 0) + (r.tail if r and part in continued else 0)
    names = [n for n, _ in fields[5:]]
    if not shifts:
        return folded.select(key, "number", *names)
    moved = F.broadcast(rows.sparkSession.createDataFrame(shifts, "part long, shift long"))  # at most a row a range
    shifted = folded.join(moved, "part", "left").withColumn("number", F.col("number") + F.when(F.col("head"), F.coalesce("shift", F.lit(0))).otherwise(0))
    return shifted.select(key, "number", *names)


def scene_points(points: DataFrame, spans: DataFrame, key: str, at: str, score: str, row_id: str, duration: str, gap_ms: int) -> DataFrame:
    """Points at least ``gap_ms`` from both ends of their video and from each other: key, number, at, score and id.

    ``spans``: key and duration. A nearer point replaces the last kept if its score is
    higher; of one time the higher score comes first, then the smaller id. No kept
    point can lie too near to the end, as none so near takes part. Points of no video
    and nulls in time or score take no part.
    """
    inside = points.join(spans.select(key, duration), key).where((F.col(at) >= gap_ms) & (F.col(at) <= F.col(duration) - gap_ms) & F.col(score).isNotNull())
    kinds = dict(points.dtypes)
    out = f"{at} {kinds[at]}, {score} {kinds[score]}, {row_id} {kinds[row_id]}"
    return spanning_fold(inside, key, [(at, False), (score, True), (row_id, False)], [at, score, row_id], MinGap(gap_ms), out)


def near_anchors(points: DataFrame, key: str, at: str, reason: str, within_ms: int = 600, strong: str = "scene_change", fixed: tuple[str, ...] = ("source_end", "source_start")) -> DataFrame:
    """As ``folds.merge_near``, for keys of any size: key, anchor_no from 0, at_ms, reasons."""
    rows = points.where(F.col(at).isNotNull() & F.col(reason).isNotNull()).withColumn(at, F.col(at).cast("long"))
    out = spanning_fold(rows, key, [(at, False), (reason, False)], [at, reason], MergeNear(within_ms, strong, fixed), "at_ms long, reasons string")
    return out.select(key, (F.col("number") - 1).alias("anchor_no"), "at_ms", "reasons")
