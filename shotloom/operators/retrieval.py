"""Retrieval queries over segments and shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.scalars import ordered_distinct
from shotloom.operators.intervals import overlap_join


def page(rows: DataFrame, order: list[str | Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in the given order, with the number of all rows as ``total``."""
    total = rows.count()
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def filter_shots(shots: DataFrame, viewpoints: tuple[str, ...] = (), scales: tuple[str, ...] = (), motions: tuple[str, ...] = (), speeds: tuple[str, ...] = (), keywords: tuple[str, ...] = ()) -> DataFrame:
    """Shots that meet every given value. Motion and speed may be met by different camera movements."""
    tests = [F.array_contains("viewpoints", v) for v in viewpoints]
    tests += [(F.col("shot_scale.start") == v) | (F.col("shot_scale.end") == v) for v in scales]
    some = lambda field, v: F.exists("camera_motions", lambda m: m[field] == v)
    tests += [some("type", v) for v in motions] + [some("speed", v) for v in speeds]
    tests += [F.array_contains("cinematography_keywords", v) for v in keywords]
    for test in tests:
        shots = shots.where(test)
    return shots


def first_match(rows: DataFrame, column: str, value: object, order: str) -> DataFrame:
    """The first row with a value, in the given order; none if there is none."""
    return rows.where(F.col(column) == F.lit(value)).orderBy(order).limit(1)


def with_annotations(shots: DataFrame, annotations: DataFrame, line: str = "line_no") -> DataFrame:
    """Shots with their annotation; of several the last line counts, and a missing one is an error."""
    latest = annotations.groupBy("shot_id").agg(F.max_by(F.struct(*[c for c in annotations.columns if c not in ("shot_id", line)]), line).alias("a"))
    joined = shots.join(latest, "shot_id", "left")
    missing = F.when(F.col("a").isNull(), F.raise_error(F.concat(F.lit("no annotation for shot "), "shot_id")).cast("string"))
    return joined.where(missing.isNull()).select(*shots.columns, "a.*")


def transcript_slices(segments: DataFrame, spans: DataFrame, key: str, bucket_ms: int) -> DataFrame:
    """Per segment the spans that overlap it: number, how many cross its edges, text and ids in the order of the input.

    ``segments``: key, segment_no, start_ms, end_ms; ``spans``: key, span_id, pos,
    r_start, r_end, text, language. The language stands only if it is one.
    """
    left = segments.select(key, "segment_no", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    met = overlap_join(left, spans, key, bucket_ms)
    crosses = (F.col("r_start") < F.col("l_start")) | (F.col("r_end") > F.col("l_end"))
    out = met.groupBy(key, "segment_no").agg(
        F.count(F.lit(1)).alias("n_spans"),
        F.count_if(crosses).alias("n_clipped"),
        F.sort_array(F.collect_list(F.struct("pos", "span_id", "text"))).alias("s"),
        F.when(F.count_distinct("language") == 1, F.min("language")).alias("language"),
    )
    joined = lambda name, sep: F.array_join(F.transform("s", lambda x: x[name].cast("string")), sep)
    return out.select(key, "segment_no", "n_spans", "n_clipped", joined("text", " ").alias("text"), joined("span_id", ",").alias("span_ids"), "language")


def search_text(*parts: Column) -> Column:
    """Distinct non-empty texts in order, one a line; the parts are arrays of strings."""
    return F.array_join(ordered_distinct(F.concat(*parts)), "\n")


def best_by(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", most: int | None = 1) -> DataFrame:
    """The first rows of each key in an order, numbered; all of them if ``most`` is None."""
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if most is None else ranked.where(F.col(name) <= most)


def choose_by_preference(rows: DataFrame, key: str, label: str, preferences: tuple[str, ...], tie: str) -> DataFrame:
    """Per key the row whose label comes first in the preferences; other labels come last, ties by the smaller ``tie``."""
    place = F.coalesce(*(F.when(F.col(label) == p, F.lit(k)) for k, p in enumerate(preferences)), F.lit(len(preferences)))
    least = F.min(F.struct(place.alias("place"), F.col(tie), F.col(label))).alias("m")
    return rows.groupBy(key).agg(least).select(key, f"m.{tie}", f"m.{label}")


def agreeing_join(left: DataFrame, right: DataFrame, key: str, same: dict[str, str]) -> DataFrame:
    """Inner join whose rows say whether the given pairs of columns agree; nulls agree with nulls."""
    joined = left.join(right, key)
    agrees = F.lit(True)
    for a, b in same.items():
        agrees &= F.col(a).eqNullSafe(F.col(b))
    return joined.withColumn("agrees", agrees)


def annotation_references(annotations: DataFrame, shots: DataFrame, key: str, line: str = "line_no") -> DataFrame:
    """Annotations named by the line they stand on, with the seconds of their shot; an unknown shot is an error."""
    known = shots.select(key, "start_ms", "end_ms", F.lit(True).alias("__known"))
    joined = annotations.select(key, line).join(known, key, "left")
    error = F.raise_error(F.concat(F.lit("annotation of unknown shot "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("string")
    name = F.when(F.col("__known").isNull(), error).otherwise(F.format_string("cinematography_%04d", F.col(line).cast("long")))
    return joined.select(name.alias("annotation_id"), key, (F.col("start_ms") / 1000).alias("start_seconds"), (F.col("end_ms") / 1000).alias("end_seconds"))
