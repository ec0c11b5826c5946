"""Folds over the ordered rows of a key, where a row's fate depends on the one before.

Keys are videos or users with a bounded number of rows, each one Arrow table;
only near_duplicates() streams its rows and needs no such bound.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def min_gap(rows: DataFrame, key: str, at: str, score: str, row_id: str, gap_ms: int) -> DataFrame:
    """Points at least ``gap_ms`` apart: a nearer one replaces the last kept if its score is higher.

    Returns key, point_no, row_id, at, score. Order: time, then id.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(at, "ascending"), (row_id, "ascending")])
        times, scores = table[at].to_pylist(), table[score].to_pylist()
        kept: list[int] = []
        for k, (t, s) in enumerate(zip(times, scores, strict=True)):
            if not kept or t - times[kept[-1]] >= gap_ms:
                kept.append(k)
            elif s > scores[kept[-1]]:
                kept[-1] = k
        return table.take(pa.array(kept, pa.int64())).append_column("point_no", pa.array(range(1, len(kept) + 1), pa.int64())).select([key, "point_no", row_id, at, score])

    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, point_no long, {row_id} {kinds[row_id]}, {at} {kinds[at]}, {score} {kinds[score]}"
    return rows.select(key, row_id, at, score).groupBy(key).applyInArrow(run, schema)


def near_duplicates(rows: DataFrame, key: str, row_id: str, hash_col: str, threshold: int = 4, lookback: int = 3) -> DataFrame:
    """Each row kept, or dropped as a near copy of one of the last ``lookback`` kept ones.

    Returns key, row_id, kept, near_id and distance: for dropped rows the latest
    kept row within ``threshold`` bits, else null. A row without a hash is kept
    and never compared. A key's rows pass in order through one task that holds
    only the last kept hashes, so a key may have any number of rows.
    """
    kinds = dict(rows.dtypes)
    absent = object()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = absent, deque(maxlen=lookback)
        for batch in batches:
            kept, near, far = [], [], []
            for name, one, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != current:
                    current = name
                    recent.clear()
                found = () if h is None else ((i, ((g ^ h) & 0xFFFFFFFFFFFFFFFF).bit_count()) for i, g in recent)
                hit = next((x for x in found if x[1] <= threshold), None)
                kept.append(hit is None)
                near.append(hit and hit[0])
                far.append(hit and hit[1])
                if hit is None and h is not None:
                    recent.appendleft((one, h))
            columns = [batch.column(0), batch.column(1), pa.array(kept, pa.bool_()), pa.array(near, batch.column(1).type), pa.array(far, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, row_id, "kept", "near_id", "distance"])

    ordered = rows.select(key, row_id, hash_col).repartition(key).sortWithinPartitions(key, row_id)
    return ordered.mapInArrow(run, f"{key} {kinds[key]}, {row_id} {kinds[row_id]}, kept boolean, near_id {kinds[row_id]}, distance int")


def merge_near(points: DataFrame, key: str, at: str, reason: str, within_ms: int = 600, strong: str = "scene_change", fixed: tuple[str, ...] = ("source_end", "source_start")) -> DataFrame:
    """Anchors of a key: a point near the last anchor joins it, and a strong one moves it to its own time.

    Fixed points stand alone: nothing joins them and they join nothing. Order:
    time, then reason. Returns key, anchor_no from 0, at_ms and reasons (sorted,
    joined by +).
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(at, "ascending"), (reason, "ascending")])
        anchors: list[tuple[int, set[str]]] = []
        for t, why in zip(table[at].to_pylist(), table[reason].to_pylist(), strict=True):
            last, reasons = anchors[-1] if anchors else (None, set())
            if last is not None and why not in fixed and not reasons & set(fixed) and abs(t - last) <= within_ms:
                anchors[-1] = (t if why == strong else last, reasons | {why})
            else:
                anchors.append((t, {why}))
        n = len(anchors)
        return pa.table({key: table[key].slice(0, n), "anchor_no": pa.array(range(n), pa.int64()), "at_ms": pa.array([t for t, _ in anchors], pa.int64()), "reasons": ["+".join(sorted(r)) for _, r in anchors]})

    return points.select(key, at, reason).groupBy(key).applyInArrow(run, f"{key} {dict(points.dtypes)[key]}, anchor_no long, at_ms long, reasons string")


def pick_frames(frames: DataFrame, keys: list[str], row_id: str, count: int) -> DataFrame:
    """Of the frames inside each segment the nearest to ``count`` even targets, each frame taken once.

    ``frames``: keys, row_id, frame_ms, start_ms, end_ms. Up to ``count`` frames all
    stay. Ties go to the earlier frame, then the smaller id. Returns keys, row_id,
    frame_ms.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame_ms", "ascending"), (row_id, "ascending")])
        times = table["frame_ms"].to_numpy()
        if table.num_rows > count:
            start, end = table["start_ms"][0].as_py(), table["end_ms"][0].as_py()
            free = np.ones(len(times), dtype=bool)
            for k in range(count):
                target = start + round((k + 1) * (end - start) / (count + 1))
                free[np.argmin(np.where(free, np.abs(times - target), np.iinfo(np.int64).max))] = False
            table = table.take(pa.array(np.flatnonzero(~free)))
        return table.select([*keys, row_id, "frame_ms"])

    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, row_id, "frame_ms"))
    inside = frames.where("frame_ms >= start_ms and frame_ms < end_ms")
    return inside.select(*keys, row_id, "frame_ms", "start_ms", "end_ms").groupBy(*keys).applyInArrow(run, schema)
