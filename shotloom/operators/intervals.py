"""Half-open millisecond intervals: building, splitting, merging grids, joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges_from_points(points: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """Adjacent points of a key as ranges [start_ms, end_ms), numbered from 1; empty ranges are left out.

    Columns of the point that begins a range stay.
    """
    order = Window.partitionBy(key).orderBy(at, *ties)
    out = points.withColumn("end_ms", F.lead(at).over(order)).withColumnRenamed(at, "start_ms").where("end_ms > start_ms")
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("start_ms", *ties)))


def split_long(ranges: DataFrame, max_ms: int) -> DataFrame:
    """Ranges longer than ``max_ms`` as the fewest equal parts that are not, cut at half-even milliseconds."""
    length = F.col("end_ms") - F.col("start_ms")
    rows = ranges.withColumn("parts", F.greatest(F.lit(1), F.ceil(length / max_ms)).cast("long"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    cut = lambda k: (F.col("start_ms") + F.bround(length * k / F.col("parts"))).cast("long")
    return rows.withColumns({"part_start": cut(F.col("part")), "part_end": cut(F.col("part") + 1)}).drop("start_ms", "end_ms").withColumnsRenamed({"part_start": "start_ms", "part_end": "end_ms"})


def merge_points(points: DataFrame, key: str, at: str = "at_ms", reason: str = "reason", priority: str = "priority") -> DataFrame:
    """One row for each time of a key, with its reasons in the order of priority, and dense numbers from 1."""
    merged = points.groupBy(key, at).agg(F.sort_array(F.collect_set(F.struct(priority, reason))).alias("r"))
    merged = merged.withColumn("reasons", F.array_join(F.transform("r", lambda x: x[reason]), "+")).drop("r")
    return merged.withColumn("point_no", F.row_number().over(Window.partitionBy(key).orderBy(at)))


def grid(spans: DataFrame, key: str, step_ms: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(key, at_ms): every multiple of ``step_ms`` (a second at least) from start to end, both included."""
    step = max(1000, step_ms)
    first = F.ceil(F.col(start) / step) * step
    return spans.where(first <= F.col(end)).select(key, F.explode(F.sequence(first.cast("long"), F.col(end).cast("long"), F.lit(step).cast("long"))).alias("at_ms"))


def interior_points(ranges: DataFrame, key: str, n: int) -> DataFrame:
    """(key, at_ms): n points inside each range that part it evenly."""
    at = F.col("start_ms") + F.bround((F.col("end_ms") - F.col("start_ms")) * F.col("k") / (n + 1))
    return ranges.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")).select(key, at.cast("long").alias("at_ms"))


def keep_evenly(rows: DataFrame, key: str, number: str, most: int) -> DataFrame:
    """Of more than ``most`` numbered rows of a key, those whose numbers are spread evenly from first to last."""
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    # Row i of n stands at position p if i - 1 = bround(p * (n - 1) / (most - 1)) for some p.
    near = F.bround((F.col(number) - 1) * (most - 1) / (F.col("__n") - 1))
    hit = lambda p: F.bround(p * (F.col("__n") - 1) / (most - 1)) == F.col(number) - 1
    keep = (F.col("__n") <= most) | hit(near) | hit(near - 1) | hit(near + 1)
    return rows.withColumn("__n", total).where(keep).drop("__n")


def frame_times(ranges: DataFrame, per_ms: int, least: int, most: int) -> DataFrame:
    """Midpoints of equal parts of each range: as many as ``per_ms`` asks, within bounds; equal times keep the first."""
    length = F.col("end_ms") - F.col("start_ms")
    n = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(length / per_ms))).cast("int")
    rows = ranges.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_no"))
    at = F.col("start_ms") + F.bround(length * (F.col("frame_no") + 0.5) / F.col("n"))
    at = F.least(F.greatest(at.cast("long"), F.col("start_ms")), F.col("end_ms") - 1)
    return rows.withColumn("at_ms", at).drop("n")


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket_ms: int, closed: bool = False, left_cols: tuple[str, str] = ("l_start", "l_end"), right_cols: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Pairs of ranges of one key that overlap: an equi-join on time buckets, each pair met once.

    Both sides are dealt into the buckets that they touch; a pair is kept only in
    the later of its two first buckets, so nothing needs to be made distinct. With
    ``closed`` ranges that only touch count as overlapping.
    """
    (a, b), (c, d) = left_cols, right_cols

    def dealt(df: DataFrame, start: str, end: str, first: str) -> DataFrame:
        last = F.greatest(F.col(start), F.col(end) - (0 if closed else 1))
        number = lambda x: F.floor(x / bucket_ms)
        return df.select("*", number(F.col(start)).alias(first), F.explode(F.sequence(number(F.col(start)), number(last))).alias("__bucket"))

    pairs = dealt(left, a, b, "__l").join(dealt(right, c, d, "__r"), [key, "__bucket"])
    meet = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) if closed else (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    return pairs.where(meet & (F.col("__bucket") == F.greatest("__l", "__r"))).drop("__bucket", "__l", "__r")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, right_id: str) -> DataFrame:
    """For each left row the right row of its key that is nearest in time; of equals that of the smaller id.

    Two ordered passes over the union (last at or before, first at or after), not
    a join of all pairs. Adds near_id and near_ms, null where the key has none.
    """
    points = right.groupBy(key, at).agg(F.min(right_id).alias("__id"))
    marked = points.select(key, at, F.struct(F.col(at).alias("ms"), F.col("__id").alias("id")).alias("__p"), F.lit(0).alias("__kind"))
    both = left.withColumn("__kind", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "__kind")
    back = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("__kind"))
    both = both.withColumn("__before", F.last("__p", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("__after", F.last("__p", True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    cost = lambda p: F.when(F.col(p).isNotNull(), F.struct(F.abs(F.col(f"{p}.ms") - F.col(at)).alias("gap"), F.col(f"{p}.id").alias("id"), F.col(f"{p}.ms").alias("ms")))
    best = F.least(cost("__before"), cost("__after"))
    return both.where("__kind = 1").withColumn("__best", best).select(*left.columns, F.col("__best.id").alias("near_id"), F.col("__best.ms").alias("near_ms"))


def touching_min(points: DataFrame, ranges: DataFrame, key: str, at: str, value: str, bucket_ms: int, none: float = 0.0) -> DataFrame:
    """Smallest value of the ranges that hold or touch each point (both ends count); ``none`` without any."""
    left = points.withColumns({"l_start": F.col(at), "l_end": F.col(at)})
    met = overlap_join(left, ranges, key, bucket_ms, closed=True)
    least = met.groupBy(*points.columns).agg(F.min(value).alias("least"))
    return points.join(least, points.columns, "left").withColumn("least", F.coalesce("least", F.lit(none)))


def all_of(*conditions: Column) -> Column:
    """Conjunction of conditions; true without any."""
    out = F.lit(True)
    for c in conditions:
        out &= c
    return out
