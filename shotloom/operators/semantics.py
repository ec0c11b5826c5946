"""Semantic segments: proposals with their evidence, annotation audits, candidate rows, guarded decisions, capped timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.operators.intervals import overlap_join


def flattened(rows: DataFrame, columns: list[str], nested: dict[str, str]) -> DataFrame:
    """A narrow projection in which fields of structs (name -> path) stand as columns of their own."""
    return rows.select(*columns, *(F.col(path).alias(name) for name, path in nested.items()))


def segment_proposals(proposals: DataFrame, anchors: DataFrame, frames: DataFrame, spans: DataFrame, key: str, bucket_ms: int) -> DataFrame:
    """Proposed segments with times from their anchors and the evidence inside them.

    ``proposals``: key, segment_no, start_anchor, end_anchor; ``anchors``: key,
    anchor_id, at_ms; ``frames``: key, frame_id, frame_ms; ``spans``: key, span_id,
    r_start, r_end. A frame lies in [start, end), a span overlaps it. ``problem``
    names an unknown anchor or an empty range; such segments have no evidence.
    """
    at = lambda side: anchors.select(key, F.col("anchor_id").alias(f"{side}_anchor"), F.col("at_ms").alias(f"{side}_ms"))
    rows = proposals.join(at("start"), [key, "start_anchor"], "left").join(at("end"), [key, "end_anchor"], "left")
    problem = F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "unknown_anchor").when(F.col("end_ms") <= F.col("start_ms"), "empty_range")
    rows = rows.withColumn("problem", problem)
    ranges = rows.where("problem is null").select(key, "segment_no", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"))
    points = frames.select(key, "frame_id", F.col("frame_ms").alias("r_start"), (F.col("frame_ms") + 1).alias("r_end"))
    seen = overlap_join(ranges, points, key, bucket_ms).groupBy(key, "segment_no").agg(F.count(F.lit(1)).alias("n_frames"), F.min("frame_id").alias("first_frame"))
    said = overlap_join(ranges, spans.select(key, "span_id", "r_start", "r_end"), key, bucket_ms).groupBy(key, "segment_no").agg(F.count(F.lit(1)).alias("n_spans"))
    out = rows.join(seen, [key, "segment_no"], "left").join(said, [key, "segment_no"], "left")
    zero = F.lit(0).cast("long")
    return out.select(key, "segment_no", "start_ms", "end_ms", F.coalesce("n_frames", zero).alias("n_frames"), "first_frame", F.coalesce("n_spans", zero).alias("n_spans"), "problem")


def annotation_audit(shots: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Rows (key, problem) of annotations against their shots: missing, unknown, duplicate, unknown_frame, motion_range.

    ``shots``: key, start_ms, end_ms, frame_ids; ``annotations``: key,
    evidence_frame_ids, motions (array of structs with start_ms and end_ms). A shot
    may have several problems.
    """
    own = annotations.select(key, F.col("evidence_frame_ids").alias("__frames"), F.col("motions").alias("__motions"), F.lit(1).alias("__one"))
    # Twice the same annotation is one row with a count, so that the join keeps one row a shot in the usual case.
    counted = own.groupBy(key).agg(F.sum("__one").alias("__n"), F.array_distinct(F.flatten(F.collect_list("__frames"))).alias("__frames"), F.flatten(F.collect_list("__motions")).alias("__motions"))
    both = shots.withColumn("__shot", F.lit(True)).join(counted, key, "full_outer")
    here = F.col("__shot").isNotNull() & F.col("__n").isNotNull()
    outside = F.exists("__motions", lambda m: (m["start_ms"] < F.col("start_ms")) | (m["end_ms"] > F.col("end_ms")))
    problems = F.array(
        F.when(F.col("__n").isNull(), "missing"),
        F.when(F.col("__shot").isNull(), "unknown"),
        F.when(F.col("__n") > 1, "duplicate"),
        F.when(here & (F.size(F.array_except("__frames", F.coalesce("frame_ids", F.array().cast(dict(shots.dtypes)["frame_ids"])))) > 0), "unknown_frame"),
        F.when(here & outside, "motion_range"),
    )
    return both.select(key, F.explode(F.array_compact(problems)).alias("problem"))


def candidate_rows(items: DataFrame, segments: DataFrame, job: str, segment: str, sources: str) -> DataFrame:
    """Segments of jobs widened by their batch item: candidate_segment_id, sorted distinct source ids, duration.

    ``items``: job and an array of structs (collection_session_id, work_group_id);
    ``segments``: job, segment, start_ms, end_ms. A segment without a positive
    range is an error.
    """
    listed = lambda name: F.array_join(F.transform(F.sort_array(F.array_distinct(F.array_compact(F.transform(sources, lambda s: s[name])))), lambda x: x.cast("string")), ",")
    own = items.select(job, listed("collection_session_id").alias("session_ids"), listed("work_group_id").alias("work_group_ids"))
    bad = F.coalesce((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), F.lit(True))
    error = F.raise_error(F.concat(F.lit("invalid range in job "), F.col(job).cast("string"))).cast("long")
    length = F.when(bad, error).otherwise(F.col("end_ms") - F.col("start_ms"))
    joined = segments.join(own, job)
    return joined.withColumns({"candidate_segment_id": F.concat_ws(":", F.col(job).cast("string"), F.col(segment).cast("string")), "duration_ms": length})


def with_decisions(ranges: DataFrame, decisions: DataFrame, on: str, default: str | None = "keep") -> DataFrame:
    """Ranges with the decision on the boundary that begins them; without one the default, or an error if that is None."""
    joined = ranges.join(decisions.select(on, F.col("decision").alias("__decision")), on, "left")
    error = F.raise_error(F.concat(F.lit("no decision for boundary "), F.col(on).cast("string"))).cast("string")
    return joined.withColumn("decision", F.coalesce("__decision", error if default is None else F.lit(default))).drop("__decision")


#: Fixed values of a model's answers.
DECISIONS = ("remove", "keep", "review")
RELATIONSHIPS = ("same_continuous_event", "same_topic_new_event", "different_topic", "insufficient_evidence", "model_disagreement")


def guarded_decisions(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The decision on each boundary between neighbours after two guards; the boundary is named by its left neighbour.

    ``rows``: key, ordinal, event, starts_mid_action, ends_mid_action, and decision
    and relationship as answered for the boundary after the row (null: no answer).
    A removal needs one continuous event, and neighbours that go on into each other
    or tell the same event; else it becomes a review. Returns key, ordinal,
    decision, relationship and review_reason (null if no guard spoke).
    """
    order = Window.partitionBy(key).orderBy(ordinal)
    told = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    goes_on = F.coalesce(F.col("ends_mid_action"), F.lit(False)) | F.coalesce(F.lead("starts_mid_action").over(order), F.lit(False)) | (told(F.col("event")) == told(F.lead("event").over(order)))
    rows = rows.withColumns({"__next": F.lead(ordinal).over(order), "__on": goes_on}).where("__next is not null")
    answered = F.col("decision").isNotNull() | F.col("relationship").isNotNull()
    known = F.coalesce(F.col("relationship").isin(*RELATIONSHIPS), F.lit(False))
    relationship = F.when(known, F.col("relationship")).otherwise("insufficient_evidence")
    first = F.when(known & F.col("decision").isin(*DECISIONS), F.col("decision")).otherwise("review")
    rows = rows.select(key, ordinal, "__on", answered.alias("__answered"), first.alias("__d"), relationship.alias("__r"))
    relation_guard = (F.col("__d") == "remove") & (F.col("__r") != "same_continuous_event")
    continuity_guard = (F.col("__d") == "remove") & (F.col("__r") == "same_continuous_event") & ~F.col("__on")
    reason = F.when(~F.col("__answered"), "missing_model_row").when(relation_guard, "relationship_guard").when(continuity_guard, "continuity_guard")
    return rows.select(
        key,
        ordinal,
        F.when(relation_guard | continuity_guard, "review").otherwise(F.col("__d")).alias("decision"),
        F.when(continuity_guard, "model_disagreement").otherwise(F.col("__r")).alias("relationship"),
        reason.alias("review_reason"),
    )


def anchored_segments(proposals: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Proposed segments with times and the first problem of each: unknown_anchor, gap, empty_range; the last row also short.

    ``proposals``: key, segment_no, start_anchor, end_anchor; ``anchors``: key,
    anchor_id, at_ms. Segments must chain from the first anchor to the last.
    """
    at = lambda side: anchors.select(key, F.col("anchor_id").alias(f"{side}_anchor"), F.col("at_ms").alias(f"{side}_ms"))
    ends = anchors.groupBy(key).agg(F.min_by("anchor_id", "at_ms").alias("__first"), F.max_by("anchor_id", "at_ms").alias("__last"))
    order = Window.partitionBy(key).orderBy("segment_no")
    rows = proposals.join(at("start"), [key, "start_anchor"], "left").join(at("end"), [key, "end_anchor"], "left").join(ends, key, "left")
    rows = rows.withColumns({"__want": F.coalesce(F.lag("end_anchor").over(order), "__first"), "__next": F.lead("segment_no").over(order)})
    problem = (
        F.when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "unknown_anchor")
        .when(F.col("start_anchor") != F.col("__want"), "gap")
        .when(F.col("end_ms") <= F.col("start_ms"), "empty_range")
        .when(F.col("__next").isNull() & (F.col("end_anchor") != F.col("__last")), "short")
    )
    return rows.select(key, "segment_no", F.format_string("segment_%04d", F.row_number().over(order)).alias("segment_id"), "start_ms", "end_ms", problem.alias("problem"))


def capped_scenes(scenes: DataFrame, spans: DataFrame, key: str, at: str, score: str, max_ms: int, most: int) -> DataFrame:
    """The scene cuts that a timeline of at most ``most`` segments may keep: the best scored, then the earliest.

    ``spans``: key, start_ms, end_ms. Where cutting at all scenes and then at
    ``max_ms`` makes too many segments, only as many scenes stay as the cuts that
    the length alone needs leave room for. A span that needs more than ``most``
    keeps no scene.
    """
    parts = lambda length: F.greatest(F.lit(1), F.ceil(length / max_ms)).cast("long")
    order = Window.partitionBy(key).orderBy(at)
    rows = scenes.join(spans.select(key, F.col("start_ms").alias("__a"), F.col("end_ms").alias("__b")), key).where((F.col(at) > F.col("__a")) & (F.col(at) < F.col("__b")))
    before = F.coalesce(F.lag(at).over(order), "__a")
    own = parts(F.col(at) - before) + F.when(F.lead(at).over(order).isNull(), parts(F.col("__b") - F.col(at))).otherwise(0)
    rows = rows.withColumn("__parts", own).withColumn("__n", F.sum("__parts").over(Window.partitionBy(key)))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), at))
    rows = rows.withColumn("__place", place)
    room = F.greatest(F.lit(0), most - parts(F.col("__b") - F.col("__a")))
    return rows.where((F.col("__n") <= most) | (F.col("__place") <= room)).select(*scenes.columns)


def named_boundaries(segments: DataFrame, key: str) -> DataFrame:
    """Gapless segments of a key with dense ordinals, their own ids and the ids of the boundaries that they share."""
    order = Window.partitionBy(key).orderBy("start_ms")
    rows = segments.withColumns({"ordinal": (F.row_number().over(order) - 1).cast("int"), "__last": F.lead("start_ms").over(order).isNull()})
    name = lambda no: F.format_string("boundary_%04d", no)
    return rows.select(
        key,
        "ordinal",
        F.format_string("candidate_%04d", F.col("ordinal") + 1).alias("candidate_segment_id"),
        "start_ms",
        "end_ms",
        F.when(F.col("ordinal") > 0, name(F.col("ordinal"))).alias("left_boundary_id"),
        F.when(~F.col("__last"), name(F.col("ordinal") + 1)).alias("right_boundary_id"),
    )


def lineage_records(manifests: DataFrame, candidates: DataFrame, units: DataFrame, unit: str, name: str = "lineage") -> DataFrame:
    """Per unit one struct of where it comes from: the columns of its manifest, its candidate and its own.

    ``candidates`` hold session_id, ``units`` candidate_id. Units of an unknown
    candidate or session are left out.
    """
    joined = units.join(candidates, "candidate_id").join(manifests, "session_id")
    fields = [*manifests.columns, *(c for c in candidates.columns if c != "session_id"), *(c for c in units.columns if c not in ("candidate_id", unit))]
    return joined.select(unit, F.struct(*fields).alias(name))
