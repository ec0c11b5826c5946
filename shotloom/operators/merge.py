"""Merge plans: adjacent ranges joined by boundary decisions, and their audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotloom.session import written


def merge_plan(ranges: DataFrame, key: str, boundary: str = "boundary_id", decision: str = "decision") -> DataFrame:
    """Final segments: a range joins the one before only if the boundary that begins it is decided 'remove'.

    A boundary under review parts like one that is kept and is listed with the
    segment on its left. Returns key, segment_no, start_ms, end_ms, n_ranges and
    review_ids (joined by commas, in order).
    """
    order = Window.partitionBy(key).orderBy("ordinal")
    parts = (F.lag("ordinal").over(order).isNull()) | (F.col(decision) != "remove")
    rows = ranges.withColumns({"__new": parts.cast("int"), "__review": F.lead(F.when(F.col(decision) == "review", F.col(boundary))).over(order)})
    rows = rows.withColumn("segment_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    review = F.sort_array(F.collect_list(F.when(F.col("__review").isNotNull(), F.struct("ordinal", "__review"))))
    out = rows.groupBy(key, "segment_no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_ranges"), review.alias("__r"))
    return out.withColumn("review_ids", F.array_join(F.transform("__r", lambda x: x["__review"].cast("string")), ",")).drop("__r")


def timeline_audit(segments: DataFrame, key: str, number: str = "segment_no") -> DataFrame:
    """Per key: segments, gaps or overlaps between neighbours, empty ones, missing numbers, and the span."""
    order = Window.partitionBy(key).orderBy("start_ms", number)
    rows = segments.withColumns({"__end": F.lag("end_ms").over(order), "__no": F.row_number().over(order)})
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.count_if(F.col("__end") != F.col("start_ms")).alias("n_breaks"),
        F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("n_empty"),
        F.count_if(F.col("__no") != F.col(number)).alias("n_misnumbered"),
        F.min("start_ms").alias("first_ms"),
        F.max("end_ms").alias("last_ms"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("covered_ms"),
    )


def merge_plan_problems(finals: DataFrame, candidates: DataFrame, decisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """What is wrong with merge plans: (job_id, ordinal, problem); the ordinal of the final segment, null for the whole plan.

    ``finals``: job_id, ordinal (from 0), start_ms, end_ms, candidate_ids, removed_ids,
    review_ids (arrays, in order); ``candidates``: job_id, ordinal, candidate_id, start_ms,
    end_ms, left_boundary, right_boundary (null at the ends); ``decisions``: job_id,
    boundary_id, decision; ``jobs``: job_id, duration_ms.

    Decisions: duplicate_decision, unknown_decision, missing_decision. Plan: no_segments,
    candidates (all of them, once and in order), removed_account and review_account (every
    removed or review boundary once and in order), end_of_timeline. Segments: ordinal, gap,
    beyond_duration, first_member, last_member (times are those of its candidates),
    not_adjacent, boundary_between, crosses_kept, removed_ids (just the crossed ones),
    review_unknown, review_place (only the boundary at its right end). A null breaks the
    rule that compares it. Lists are compared as rows by their position.
    """
    of = ["job_id", "ordinal"]
    whole = lambda rows, name, where=None: (rows if where is None else rows.where(where)).select("job_id", F.lit(None).cast("int").alias("ordinal"), F.lit(name).alias("problem"))
    one = lambda rows, name, where=None: (rows if where is None else rows.where(where)).select("job_id", F.col("ordinal").cast("int").alias("ordinal"), F.lit(name).alias("problem"))
    differ = lambda a, b: ~F.coalesce(a == b, F.lit(False))
    in_order = Window.partitionBy("job_id").orderBy("ordinal")
    finals, candidates, decisions = written(finals, "finals"), written(candidates, "candidates"), written(decisions, "decisions")

    inner = candidates.where("right_boundary is not null").select("job_id", F.col("right_boundary").alias("boundary_id"), F.col("ordinal").alias("at"))
    counted = decisions.groupBy("job_id", "boundary_id").agg(F.count(F.lit(1)).alias("n"), F.min("decision").alias("decision"))
    counted = written(counted, "counted")
    told = written(inner.join(counted, ["job_id", "boundary_id"], "full_outer"), "told")
    found = [whole(told, "duplicate_decision", "n > 1"), whole(told, "unknown_decision", "at is null"), whole(told, "missing_decision", "n is null")]

    found.append(whole(jobs.join(finals.select("job_id").distinct(), "job_id", "left_anti"), "no_segments"))
    ends = finals.join(jobs, "job_id").withColumns({"before": F.coalesce(F.lag("end_ms").over(in_order), F.lit(0)), "place": F.row_number().over(in_order) - 1, "next": F.lead("ordinal").over(in_order)})
    found += [
        one(ends, "ordinal", differ(F.col("ordinal"), F.col("place"))),
        one(ends, "gap", differ(F.col("start_ms"), F.col("before"))),
        one(ends, "beyond_duration", "end_ms > duration_ms"),
        whole(ends, "end_of_timeline", F.col("next").isNull() & differ(F.col("end_ms"), F.col("duration_ms"))),
    ]

    members = finals.select("job_id", "ordinal", F.posexplode("candidate_ids").alias("pos", "candidate_id"))
    numbered = members.select("job_id", "candidate_id", F.row_number().over(Window.partitionBy("job_id").orderBy("ordinal", "pos")).alias("no"))
    wanted = candidates.join(finals.select("job_id").distinct(), "job_id", "left_semi").select("job_id", F.col("candidate_id").alias("wanted"), F.row_number().over(in_order).alias("no"))
    found.append(whole(numbered.join(wanted, ["job_id", "no"], "full_outer"), "candidates", differ(F.col("candidate_id"), F.col("wanted"))))

    side = candidates.select("job_id", "candidate_id", F.col("start_ms").alias("c_start"), F.col("end_ms").alias("c_end"), "left_boundary", "right_boundary").dropDuplicates(["job_id", "candidate_id"])
    inside = Window.partitionBy(*of).orderBy("pos")
    met = members.join(side, ["job_id", "candidate_id"], "left")
    met = met.withColumns({"next_pos": F.lead("pos").over(inside), "next_start": F.lead("c_start").over(inside), "next_left": F.lead("left_boundary").over(inside)})
    met = written(met, "members")
    firsts = met.where("pos = 0").join(finals.select(*of, "start_ms"), of)
    lasts = met.where("next_pos is null").join(finals.select(*of, "end_ms", "review_ids"), of)
    edges = met.where("next_pos is not null")
    crossed = edges.join(counted.select("job_id", F.col("boundary_id").alias("right_boundary"), "decision"), ["job_id", "right_boundary"], "left")
    found += [
        one(firsts, "first_member", differ(F.col("start_ms"), F.col("c_start"))),
        one(lasts, "last_member", differ(F.col("end_ms"), F.col("c_end"))),
        one(edges, "not_adjacent", differ(F.col("c_end"), F.col("next_start"))),
        one(edges, "boundary_between", differ(F.col("right_boundary"), F.col("next_left"))),
        one(crossed, "crosses_kept", differ(F.col("decision"), F.lit("remove"))),
    ]
    listed = finals.select(*of, F.posexplode("removed_ids").alias("pos", "listed"))
    merged = edges.select(*of, "pos", F.col("right_boundary").alias("merged"))
    found.append(one(listed.join(merged, [*of, "pos"], "full_outer"), "removed_ids", differ(F.col("listed"), F.col("merged"))))
    review = finals.select(*of, F.explode("review_ids").alias("boundary_id"))
    known = review.join(counted.where("decision = 'review'").select("job_id", "boundary_id"), ["job_id", "boundary_id"], "left_anti")
    placed = lasts.select(*of, "right_boundary", F.explode("review_ids").alias("boundary_id"))
    found += [one(known, "review_unknown"), one(placed, "review_place", differ(F.col("boundary_id"), F.col("right_boundary")))]

    for decision, column in (("remove", "removed_ids"), ("review", "review_ids")):
        seen = finals.select("job_id", "ordinal", F.posexplode(column).alias("pos", "seen"))
        seen = seen.select("job_id", "seen", F.row_number().over(Window.partitionBy("job_id").orderBy("ordinal", "pos")).alias("no"))
        due = told.where((F.col("decision") == decision) & F.col("at").isNotNull()).join(finals.select("job_id").distinct(), "job_id", "left_semi")
        due = due.select("job_id", F.col("boundary_id").alias("due"), F.row_number().over(Window.partitionBy("job_id").orderBy("at")).alias("no"))
        name = "removed_account" if decision == "remove" else "review_account"
        found.append(whole(seen.join(due, ["job_id", "no"], "full_outer"), name, differ(F.col("seen"), F.col("due"))))
    return reduce(DataFrame.unionAll, found).distinct()


def chain_audit(rows: DataFrame, key: str, position: str, first: int = 0) -> DataFrame:
    """Per key: rows, whether positions begin at ``first``, and how many do not follow the one before."""
    before = F.lag(position).over(Window.partitionBy(key).orderBy(position))
    out = rows.withColumn("__before", before).groupBy(key)
    return out.agg(F.count(F.lit(1)).alias("n_rows"), (F.min(position) == first).alias("starts_right"), F.count_if(F.col(position) != F.col("__before") + 1).alias("n_breaks"))


def decision_audit(boundaries: DataFrame, decisions: DataFrame, on: str) -> DataFrame:
    """Rows (id, problem) for boundaries without a decision, decisions without a boundary and double decisions."""
    counted = decisions.groupBy(on).count()
    both = boundaries.select(on, F.lit(1).alias("known")).join(counted, on, "full_outer")
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("count").isNull(), "missing").when(F.col("count") > 1, "duplicate")
    return both.select(on, problem.alias("problem")).where("problem is not null")


def islands(rows: DataFrame, key: str, position: str, label: str) -> DataFrame:
    """Runs of equal labels in a key: run_no, label, first and last position, length."""
    order = Window.partitionBy(key).orderBy(position)
    new = (F.lag(label).over(order).isNull()) | (F.lag(label).over(order) != F.col(label))
    rows = rows.withColumn("__new", new.cast("int")).withColumn("run_no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "run_no", label).agg(F.min(position).alias("first_pos"), F.max(position).alias("last_pos"), F.count(F.lit(1)).alias("n_rows"))
