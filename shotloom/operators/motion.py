"""Shift search over pairs of grey frames: which move of one explains the other best.

A pair's score at a shift is the median, over the tiles of the inner picture, of the
mean absolute difference, by 255. All shifts are one strided view of a block of
frames, so that a block is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that are compared in one array operation.
BLOCK = 64


class FrameGeometry:
    """Size of a frame, its margins, its tiles and the reach of shifts, in pixels."""

    def __init__(self, width: int = 64, height: int = 36, margin_x: int = 8, margin_y: int = 6, tile_width: int = 8, tile_height: int = 6, reach: int = 3) -> None:
        if min(width - 2 * margin_x, height - 2 * margin_y) <= 0:
            raise ValueError("margins leave no picture")
        self.width, self.height, self.margin_x, self.margin_y = width, height, margin_x, margin_y
        self.tile_width, self.tile_height, self.reach = tile_width, tile_height, reach

    @property
    def shifts(self) -> list[tuple[int, int]]:
        """(dx, dy) by rows, as they are tried."""
        around = range(-self.reach, self.reach + 1)
        return [(dx, dy) for dy in around for dx in around]


def difference_scores(left: np.ndarray, right: np.ndarray, at: FrameGeometry) -> np.ndarray:
    """Scores (pairs, shifts) of frames (pairs, height, width); a pixel moved from outside the inner picture counts nowhere."""
    reach = at.reach
    inner = (slice(None), slice(at.margin_y, at.height - at.margin_y), slice(at.margin_x, at.width - at.margin_x))
    here = right[inner].astype(np.int32)
    shape = here.shape[1:]
    ones = np.pad(np.ones((1, *shape), dtype=np.int32), ((0, 0), (reach, reach), (reach, reach)))
    moved = np.pad(left[inner].astype(np.int32), ((0, 0), (reach, reach), (reach, reach)))
    views = [np.lib.stride_tricks.sliding_window_view(a, shape, axis=(1, 2))[:, ::-1, ::-1] for a in (moved, ones)]
    apart = np.abs(views[0] - here[:, None, None]) * views[1]
    tiles = [np.add.reduceat(np.add.reduceat(a, range(0, shape[0], at.tile_height), axis=3), range(0, shape[1], at.tile_width), axis=4) for a in (apart, views[1])]
    n = (2 * reach + 1) ** 2
    totals, counts = tiles[0].reshape(len(left), n, -1), tiles[1].reshape(n, -1)
    scores = np.zeros((len(left), n))
    for k in range(n):
        seen = counts[k] > 0
        if seen.any():
            scores[:, k] = np.median(totals[:, k, seen] / counts[k, seen], axis=1) / 255.0
    return scores


def best_shifts(variants: np.ndarray, scales: list[float], right: np.ndarray, at: FrameGeometry) -> list[tuple]:
    """(dx, dy, scale, identity, improvement) of each pair; ``variants``: (pairs, scales, height, width) of the left frame.

    The unmoved frame at scale 1 stands until a shift scores strictly less, tried by
    scale, then by dy, then by dx.
    """
    scores = np.stack([difference_scores(variants[:, k], right, at) for k in range(len(scales))], axis=1)
    unmoved = at.shifts.index((0, 0))
    identity = scores[:, scales.index(1.0), unmoved]
    flat = scores.reshape(len(right), -1)
    first = flat.argmin(axis=1)
    out = []
    for row, k in enumerate(first.tolist()):
        best, own = float(flat[row, k]), float(identity[row])
        scale, shift = divmod(k, len(at.shifts))
        (dx, dy), scale = (at.shifts[shift], scales[scale]) if best < own else ((0, 0), 1.0)
        out.append((dx / at.width, dy / at.height, scale - 1.0, own, max(0.0, min(1.0, (own - min(best, own)) / max(own, 1e-6)))))
    return out


def pair_measures(pairs: DataFrame, keys: list[str], left: str, right: str, at: FrameGeometry | None = None, scales: tuple[float, ...] = (1.0,)) -> DataFrame:
    """``pairs`` with dx, dy (shares of the frame), scale (less one), identity and improvement of each pair of frames.

    ``left``: one grey frame for each of ``scales``, which hold 1.0, one after the
    other in an array of whole numbers from 0 to 255 (resampling is the caller's);
    ``right``: one frame. A pair with a null or an array of another length, or with a
    null or a number outside in it, has null measures. Keys keep their values,
    repeated rows are measured each, an empty table gives none. Nothing is shuffled.
    """
    at = at or FrameGeometry()
    kept = list(scales)
    if 1.0 not in kept:
        raise ValueError("scales have to hold 1.0")
    size, numbers = at.width * at.height, pairs.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                frames = [part.column(k).to_pylist() for k in (part.num_columns - 2, part.num_columns - 1)]
                good = [k for k, (a, b) in enumerate(zip(*frames, strict=True)) if a and b and len(a) == size * len(kept) and len(b) == size]
                rows: list[tuple] = [(None,) * 5] * part.num_rows
                if good:
                    a = np.array([frames[0][k] for k in good], dtype=np.int32).reshape(-1, len(kept), at.height, at.width)
                    b = np.array([frames[1][k] for k in good], dtype=np.int32).reshape(-1, at.height, at.width)
                    for k, measures in zip(good, best_shifts(a, kept, b, at), strict=True):
                        rows[k] = measures
                columns = [pa.array(c, pa.float64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *columns], [*part.schema.names[:-2], *names])

    names = ["dx", "dy", "scale", "identity", "improvement"]
    fit = lambda c: F.when(F.forall(c, lambda v: F.coalesce((v >= 0) & (v <= 255), F.lit(False))), F.col(c).cast("array<int>"))
    given = pairs.select(*keys, fit(left).alias("_left"), fit(right).alias("_right"))
    schema = numbers
    for name in names:
        schema = schema.add(name, "double")
    return given.mapInArrow(run, schema)


def consecutive(frames: DataFrame, key: str, order: str, pixels: str) -> DataFrame:
    """Each frame and the next of its key: key, order, left, right."""
    following = F.lead(pixels).over(Window.partitionBy(key).orderBy(order))
    return frames.select(key, order, F.col(pixels).alias("left"), following.alias("right")).where("right is not null")

