"""Contracts of input documents as problem rows: collection segments, query plans and work groups.

Documents are tables with a ``document`` column, so that any number of them is checked
at once. Every rule is a filter, a join or a count over keys; a null breaks the rule
that looks at it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.scalars import case_folded, inline_text, safe_id
from shotloom.operators.rounds import DEFAULT_BUDGET, MOST_BUDGET
from shotloom.session import tasks_for, written

_PLAN = ["document", "plan_no"]


def _blank(x: Column) -> Column:
    return F.coalesce(inline_text(x) == "", F.lit(True))


def _row(rows: DataFrame, problem: str, plan: Column | None = None, item: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return rows.select("document", (none if plan is None else plan).cast("long").alias("plan_no"), (none if item is None else item).cast("string").alias("item"), F.lit(problem).alias("problem"))


def _twice(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def named_segments(segments: DataFrame) -> DataFrame:
    """Segments (document, position from 1, segment_id, order, text) with the ids and orders that absent ones get."""
    made = F.format_string("seg_%03d", F.col("position"))
    return segments.withColumns({"segment_id": F.coalesce("segment_id", made), "order": F.when(F.coalesce("order", F.lit(0)) == 0, F.col("position")).otherwise(F.col("order"))})


def segment_problems(documents: DataFrame, segments: DataFrame) -> DataFrame:
    """(document, plan_no null, item, problem) of collection inputs: documents (document, full_script) and their segments.

    duplicate_segment_id, duplicate_order, unsafe_id, blank_text, no_segments, and as a
    warning script_mismatch: the script is not what its segments say one after the
    other, white space aside (held against each other by digests of a document's text).
    """
    rows = named_segments(segments)
    bare = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")
    said = rows.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("order", "position", bare(F.col("text")).alias("t")))).alias("s"))
    said = said.select("document", F.array_join(F.transform("s", lambda x: x["t"]), "").alias("said"))
    both = documents.join(said, "document", "left")
    return reduce(
        DataFrame.unionAll,
        [
            _row(_twice(rows, ["document", "segment_id"]), "duplicate_segment_id", item=F.col("segment_id")),
            _row(_twice(rows, ["document", "order"]), "duplicate_order", item=F.col("order")),
            _row(rows.where(~safe_id(F.col("segment_id"))), "unsafe_id", item=F.col("segment_id")),
            _row(rows.where(_blank(F.col("text"))), "blank_text", item=F.col("segment_id")),
            _row(both.where("said is null"), "no_segments"),
            _row(both.where(F.col("said").isNotNull() & (bare(F.col("full_script")) != F.col("said"))), "script_mismatch"),
        ],
    ).distinct()


def plan_problems(documents: DataFrame, segments: DataFrame, plans: DataFrame, facets: DataFrame, branches: DataFrame, queries: DataFrame) -> DataFrame:
    """(document, plan_no, item, problem) of query plans against the segments they are for.

    ``documents``: document, platform_scope (array); ``segments``: document, segment_id;
    ``plans``: document, plan_no, query_plan_id (null: qp_ and the segment), segment_id,
    visual_strategy; ``facets``: document, plan_no, facet_id, description; ``branches``:
    document, plan_no, platform, language; ``queries``: document, plan_no, platform,
    query_id, text, facet_ids (array), budget (null: 20).

    duplicate_scope; unknown_segment, several_plans, missing_plan; duplicate_plan_id,
    unsafe_id, blank_strategy; no_facets, duplicate_facet_id, duplicate_description,
    blank_description; duplicate_branch, missing_branch, branch_out_of_scope,
    blank_language, no_queries; duplicate_query_id (in a plan), duplicate_query_text (in a
    branch), blank_text, repeated_facet, unknown_facet, no_facet, budget, query_without_branch.
    """
    plans = written(plans.withColumn("plan_id", F.coalesce("query_plan_id", F.concat(F.lit("qp_"), "segment_id"))), "plans")
    named = lambda rows, c: rows.withColumn("folded", case_folded(inline_text(F.col(c))))
    plan_no = F.col("plan_no")
    known = segments.select("document", "segment_id").distinct()
    wanted = plans.select(*_PLAN).join(documents.select("document", F.explode(F.array_distinct("platform_scope")).alias("platform")), "document")
    held = branches.select(*_PLAN, "platform").distinct()
    facet_keys = facets.select(*_PLAN, "facet_id").distinct()
    named_facets = queries.select(*_PLAN, "query_id", F.explode(F.array_distinct("facet_ids")).alias("facet_id"))
    budget = F.coalesce("budget", F.lit(DEFAULT_BUDGET)).between(1, MOST_BUDGET)
    unsafe = [_row(rows.where(~safe_id(F.col(c))), "unsafe_id", plan_no, F.col(c)) for rows, c in ((plans, "plan_id"), (facets, "facet_id"), (queries, "query_id"))]
    found = [
        _row(documents.where(F.size(F.array_distinct("platform_scope")) != F.size("platform_scope")), "duplicate_scope"),
        _row(plans.join(known, ["document", "segment_id"], "left_anti"), "unknown_segment", plan_no, F.col("segment_id")),
        _row(_twice(plans, ["document", "segment_id"]), "several_plans", item=F.col("segment_id")),
        _row(known.join(plans, ["document", "segment_id"], "left_anti"), "missing_plan", item=F.col("segment_id")),
        _row(_twice(plans, ["document", "plan_id"]), "duplicate_plan_id", item=F.col("plan_id")),
        *unsafe,
        _row(plans.where(_blank(F.col("visual_strategy"))), "blank_strategy", plan_no),
        _row(plans.join(facets, _PLAN, "left_anti"), "no_facets", plan_no),
        _row(_twice(facets, [*_PLAN, "facet_id"]), "duplicate_facet_id", plan_no, F.col("facet_id")),
        _row(_twice(named(facets, "description").where("folded <> ''"), [*_PLAN, "folded"]), "duplicate_description", plan_no, F.col("folded")),
        _row(facets.where(_blank(F.col("description"))), "blank_description", plan_no, F.col("facet_id")),
        _row(_twice(branches, [*_PLAN, "platform"]), "duplicate_branch", plan_no, F.col("platform")),
        _row(wanted.join(held, [*_PLAN, "platform"], "left_anti"), "missing_branch", plan_no, F.col("platform")),
        _row(held.join(plans.select(*_PLAN), _PLAN, "left_semi").join(wanted, [*_PLAN, "platform"], "left_anti"), "branch_out_of_scope", plan_no, F.col("platform")),
        _row(branches.where(_blank(F.col("language"))), "blank_language", plan_no, F.col("platform")),
        _row(held.join(queries, [*_PLAN, "platform"], "left_anti"), "no_queries", plan_no, F.col("platform")),
        _row(queries.join(held, [*_PLAN, "platform"], "left_anti"), "query_without_branch", plan_no, F.col("query_id")),
        _row(_twice(queries, [*_PLAN, "query_id"]), "duplicate_query_id", plan_no, F.col("query_id")),
        _row(_twice(named(queries, "text").where("folded <> ''"), [*_PLAN, "platform", "folded"]), "duplicate_query_text", plan_no, F.concat_ws(":", "platform", "folded")),
        _row(queries.where(_blank(F.col("text"))), "blank_text", plan_no, F.col("query_id")),
        _row(queries.where(F.size(F.array_distinct("facet_ids")) != F.size("facet_ids")), "repeated_facet", plan_no, F.col("query_id")),
        _row(named_facets.join(facet_keys, [*_PLAN, "facet_id"], "left_anti"), "unknown_facet", plan_no, F.col("query_id")),
        _row(queries.where(F.coalesce(F.size("facet_ids") < 1, F.lit(True))), "no_facet", plan_no, F.col("query_id")),
        _row(queries.where(~budget), "budget", plan_no, F.col("query_id")),
    ]
    return reduce(DataFrame.unionAll, found).distinct()


def group_problems(groups: DataFrame, members: DataFrame, units: DataFrame) -> DataFrame:
    """(work_group_id, media_unit_id, problem): duplicate_group, unknown_unit, platform_mismatch, several_groups.

    ``groups``: work_group_id; ``members``: work_group_id, media_unit_id, platform;
    ``units``: media_unit_id, platform. A unit that a group lists twice is in several groups.
    """
    row = lambda rows, problem, group=True, unit=True: rows.select((F.col("work_group_id") if group else F.lit(None)).cast("string").alias("work_group_id"), (F.col("media_unit_id") if unit else F.lit(None)).cast("string").alias("media_unit_id"), F.lit(problem).alias("problem"))
    n = tasks_for(members.sparkSession, members.count())
    known = units.repartition(n, "media_unit_id").groupBy("media_unit_id").agg(F.min("platform").alias("unit_platform"), F.lit(True).alias("known"))
    met = members.repartition(n, "media_unit_id").join(known, "media_unit_id", "left")
    met = met.withColumn("several", F.count(F.lit(1)).over(Window.partitionBy("media_unit_id")) > 1)
    wrong = F.when(F.col("known").isNull(), "unknown_unit").when(~F.col("platform").eqNullSafe(F.col("unit_platform")), "platform_mismatch")
    told = met.withColumn("wrong", wrong).where("wrong is not null or several")
    told = told.select(F.explode(F.array(F.struct(F.col("work_group_id").cast("string").alias("work_group_id"), F.col("wrong").alias("problem")), F.struct(F.lit(None).cast("string").alias("work_group_id"), F.when(F.col("several"), "several_groups").alias("problem")))).alias("r"), "media_unit_id").where("r.problem is not null")
    return row(_twice(groups, ["work_group_id"]), "duplicate_group", unit=False).unionAll(told.select("r.work_group_id", F.col("media_unit_id").cast("string").alias("media_unit_id"), "r.problem")).distinct()


def best_streams(streams: DataFrame, key: str, position: str, url: str, edge: str, area: str | None = None, low_edge: int = 720) -> DataFrame:
    """Per key the addresses of the largest stream and of the largest up to ``low_edge``: high_url, low_url.

    Larger by edge, then by area if given, then by later position. Streams without an
    address of the web or a positive edge are passed over; a null says that none is left.
    """
    fit = streams.where(F.col(url).rlike("^https?://") & (F.col(edge) > 0))
    size = F.struct(edge, *([area] if area else []), position)
    return streams.select(key).distinct().join(fit.groupBy(key).agg(F.max_by(url, size).alias("high_url"), F.max_by(F.when(F.col(edge) <= low_edge, F.col(url)), F.when(F.col(edge) <= low_edge, size)).alias("low_url")), key, "left")


def shot_ranges(boundaries: DataFrame, spans: DataFrame, key: str, at: str, reasons: str, duration: str, cut: str = "scene_change") -> DataFrame:
    """Gapless shots from 0 to the duration, parted where ``cut`` is among a boundary's reasons: key, ordinal from 0, shot_id, start_ms, end_ms."""
    zero = spans.select(key, F.lit(0).cast("long").alias("start_ms"), F.col(duration).cast("long").alias("__duration"))
    cuts = boundaries.where(F.array_contains(reasons, cut)).join(spans.select(key, F.col(duration).cast("long").alias("__duration")), key).select(key, F.col(at).cast("long").alias("start_ms"), "__duration")
    order = Window.partitionBy(key).orderBy("start_ms")
    rows = zero.unionByName(cuts).withColumns({"ordinal": F.row_number().over(order) - 1, "end_ms": F.coalesce(F.lead("start_ms").over(order), F.col("__duration"))})
    return rows.select(key, "ordinal", F.format_string("shot_%04d", F.col("ordinal") + 1).alias("shot_id"), "start_ms", "end_ms")


def result_counts(candidates: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Per session: candidates_found, media_units_found, proxies_ready. ``units``: key, candidate, proxy (null if there is none)."""
    found = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("candidates_found"))
    made = units.groupBy(key).agg(F.count(F.lit(1)).alias("media_units_found"), F.count("proxy").alias("proxies_ready"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.join(made, key, "full_outer").select(key, zero("candidates_found"), zero("media_units_found"), zero("proxies_ready"))


def ordered_segments(asked: DataFrame, discoveries: DataFrame, key: str) -> DataFrame:
    """Segments of a session once each: those asked for in their order (key, place, segment_id), then the other discovered ones by name."""
    first = asked.groupBy(key, "segment_id").agg(F.min("place").alias("place"))
    other = discoveries.select(key, "segment_id").distinct().join(first, [key, "segment_id"], "left_anti").withColumn("place", F.lit(None).cast("long"))
    rows = first.withColumn("place", F.col("place").cast("long")).unionByName(other.select(key, "segment_id", "place"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("place"), "segment_id")).alias("place"), "segment_id")
