"""Search rounds of many plans: a judged round becomes the next one, or a list of problems.

Tables: ``plans`` (plan, platforms, facets, max_rounds, max_videos), ``rounds`` (plan,
round_number and its budget), ``asked`` (plan, round_number, query_key: what was
searched), ``decisions`` (plan, round_number, status, occupied, history, assessments,
gaps: what is said of the round), ``queries`` (plan, query_id, platform, language, text,
facet_ids, budget: what to search next). All checks are joins and partial aggregates by
plan; nothing is gathered beyond what one decision itself lists.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions.scalars import case_folded, collapse_spaces
from shotloom.sources.versions import VersionedTables

#: What a facet may be found to be (fixed values).
FACET_STATES = ("covered", "partial", "missing")
#: Results that a query asks for, if it does not say how many, and at most.
DEFAULT_BUDGET, MOST_BUDGET = 20, 100

ROUND = "plan string, round_number int, occupied long, remaining_rounds long, remaining_slots long, round_limit long"
ASKED = "plan string, round_number int, query_key string"
PROBLEM = "plan string, round_number int, problem string"


def query_key(platform: Column, text: Column) -> Column:
    """``platform:text``, the text case-folded with single spaces."""
    return F.concat(platform, F.lit(":"), case_folded(collapse_spaces(text)))


def _blank(x: Column) -> Column:
    return F.coalesce(collapse_spaces(x) == "", F.lit(True))


def _within(some: Column, all_of: Column) -> Column:
    """Whether a list is neither null nor empty and holds nothing beyond another."""
    return F.coalesce((F.size(some) > 0) & (F.size(F.array_except(some, all_of)) == 0), F.lit(False))


def _problem(rows: DataFrame, name: str, where: Column | None = None) -> DataFrame:
    rows = rows if where is None else rows.where(F.coalesce(where, F.lit(True)))
    return rows.select("plan", F.lit(name).alias("problem"))


def round_problems(plans: DataFrame, rounds: DataFrame, asked: DataFrame, decisions: DataFrame, queries: DataFrame) -> DataFrame:
    """(plan, problem) of the decisions that can't become a round, each kind once a plan.

    unknown_plan; status (only an insufficient round has a next one); round_number (not
    the plan's latest); history (the listed keys are not those that were asked);
    facet_assessment (each facet once, with a known state and a reason); gap (none, or
    one without a description or with no or unknown facets); no_queries; query (platform
    out of scope, blank text or language, no or unknown facets, budget out of range);
    repeated_query (asked before); duplicate_query (an id or a key twice);
    platform_without_query; languages (several on one platform); max_rounds, max_videos
    (nothing left). Nulls break the rule that looks at them. Several decisions on one
    plan are duplicate_decision.
    """
    latest = rounds.groupBy("plan").agg(F.max("round_number").alias("latest"))
    judged = decisions.join(plans, "plan", "left").join(latest, "plan", "left")
    known = judged.where("max_rounds is not null")
    assessed = F.transform("assessments", lambda a: a["facet_id"])
    sound = F.forall("assessments", lambda a: F.coalesce(a["status"].isin(*FACET_STATES), F.lit(False)) & ~_blank(a["reason"]))
    whole = F.coalesce(sound & (F.size("assessments") == F.size("facets")) & (F.size(F.array_except("facets", assessed)) == 0) & (F.size("facets") > 0), F.lit(False))
    gaps = F.coalesce((F.size("gaps") > 0) & F.forall("gaps", lambda g: g["gap_id"].isNotNull() & ~_blank(g["description"]) & _within(g["facet_ids"], F.col("facets"))), F.lit(False))
    found = [
        _problem(judged, "unknown_plan", F.col("max_rounds").isNull()),
        _problem(decisions.groupBy("plan").count().where("count > 1"), "duplicate_decision"),
        _problem(known, "status", F.col("status") != "insufficient"),
        _problem(known, "round_number", (F.col("round_number") < 1) | (F.col("round_number") != F.col("latest"))),
        _problem(known, "facet_assessment", ~whole),
        _problem(known, "gap", ~gaps),
        _problem(known, "max_rounds", F.col("max_rounds") - F.col("round_number") < 1),
        _problem(known, "max_videos", F.col("max_videos") - F.col("occupied") < 1),
    ]
    told = known.select("plan", F.explode("history").alias("told")).where(~_blank(F.col("told"))).select("plan", case_folded(collapse_spaces(F.col("told"))).alias("query_key"), F.lit(True).alias("told")).distinct()
    before = asked.join(known.select("plan"), "plan", "left_semi").select("plan", "query_key", F.lit(True).alias("asked")).distinct()
    found.append(_problem(told.join(before, ["plan", "query_key"], "full_outer"), "history", F.col("told").isNull() | F.col("asked").isNull()))
    next_ones = queries.join(known.select("plan", "platforms", "facets"), "plan").withColumn("query_key", query_key(F.col("platform"), F.col("text")))
    budget = F.coalesce("budget", F.lit(DEFAULT_BUDGET))
    in_scope = F.coalesce(F.array_contains("platforms", F.col("platform")), F.lit(False))
    fit = in_scope & F.col("query_id").isNotNull() & ~_blank(F.col("text")) & ~_blank(F.col("language")) & _within(F.col("facet_ids"), F.col("facets")) & budget.between(1, MOST_BUDGET)
    found += [
        _problem(known.join(queries.select("plan").distinct(), "plan", "left_anti"), "no_queries"),
        _problem(next_ones, "query", ~fit),
        _problem(next_ones.join(before, ["plan", "query_key"], "left_semi"), "repeated_query"),
        _problem(next_ones.groupBy("plan", "query_key").count().where("count > 1 and query_key is not null"), "duplicate_query"),
        _problem(next_ones.groupBy("plan", "query_id").count().where("count > 1 and query_id is not null"), "duplicate_query"),
    ]
    wanted = known.select("plan", F.explode("platforms").alias("platform"))
    found.append(_problem(wanted.join(queries.select("plan", "platform").distinct(), ["plan", "platform"], "left_anti"), "platform_without_query"))
    spoken = next_ones.groupBy("plan", "platform").agg(F.count_distinct(collapse_spaces(F.col("language"))).alias("n"))
    found.append(_problem(spoken, "languages", F.col("n") > 1))
    return reduce(DataFrame.unionAll, found).distinct()


def next_rounds(plans: DataFrame, decisions: DataFrame, problems: DataFrame) -> DataFrame:
    """The rounds that follow decisions without a problem; the open slots are shared evenly by the rounds left."""
    good = decisions.join(problems.select("plan").distinct(), "plan", "left_anti").join(plans, "plan")
    return _budgets(good.select("plan", (F.col("round_number") + 1).cast("int").alias("round_number"), F.col("occupied").cast("long").alias("occupied"), "max_rounds", "max_videos"))


def first_rounds(plans: DataFrame) -> DataFrame:
    """Round 1 of every plan that has a round and a slot at all."""
    return _budgets(plans.select("plan", F.lit(1).alias("round_number"), F.lit(0).cast("long").alias("occupied"), "max_rounds", "max_videos")).where("remaining_rounds > 0 and remaining_slots > 0")


def _budgets(rows: DataFrame) -> DataFrame:
    left, slots = (F.col("max_rounds") - F.col("round_number") + 1).cast("long"), (F.col("max_videos") - F.col("occupied")).cast("long")
    rows = rows.select("plan", "round_number", "occupied", left.alias("remaining_rounds"), slots.alias("remaining_slots"))
    return rows.withColumn("round_limit", F.ceil(F.col("remaining_slots") / F.col("remaining_rounds")).cast("long"))


def _asked(queries: DataFrame, rounds: DataFrame) -> DataFrame:
    keys = queries.select("plan", query_key(F.col("platform"), F.col("text")).alias("query_key")).distinct()
    return keys.join(rounds.select("plan", "round_number"), "plan").select("plan", "round_number", "query_key")


def run_rounds(tables: VersionedTables, plans: DataFrame, initial: DataFrame, decide: Callable[[int, VersionedTables], tuple[DataFrame, DataFrame]], most: int) -> int:
    """Rounds one after the other, at most ``most`` of them; the number of the last one.

    ``decide`` gives decisions and queries on a round from the tables as they stand. A
    round is one version of ``rounds``, ``asked`` and ``problems``: what is carried on is
    read back, so that no plan grows with the rounds, and a run that broke goes on after
    the last round that it committed. It ends when no plan has a next round.
    """
    spark = tables.spark
    for number in range(1, most + 1):
        version = tables.latest()
        if tables.commit_of(version)["notes"].get("round", 0) >= number:
            continue
        if number == 1:
            rounds, queries, problems = first_rounds(plans), initial, spark.createDataFrame([], PROBLEM)
        else:
            decisions, queries = decide(number - 1, tables)
            held = {name: tables.read(name, version) for name in ("rounds", "asked")}
            problems = round_problems(plans, held["rounds"], held["asked"], decisions, queries)
            rounds = next_rounds(plans, decisions, problems)
            problems = problems.select("plan", F.lit(number).alias("round_number"), "problem")
        tables.commit(version, append={"rounds": rounds, "asked": _asked(queries, rounds), "problems": problems}, notes={"round": number})
        if tables.read("rounds").where(F.col("round_number") == number).isEmpty():
            return number - 1
    return most
