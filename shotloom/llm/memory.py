"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a batch to and from Python, where the session has Spark's own 10,000. Texts of
#: a few KB then pass in MBs instead of tens of MB for each buffer on the way.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Give freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` over batches; what its task has freed goes back when the task ends."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of at most BATCH_ROWS rows, unless the session was set otherwise."""
    if df.sparkSession.conf.get(_ROWS) == "10000":
        df.sparkSession.conf.set(_ROWS, BATCH_ROWS)
    return df.mapInArrow(tidy(run), schema)
