"""Hand-over of jobs to an outside model: requests with bounded evidence, attempt chains, checked imports.

A request lists a prefix of a job's evidence; a result is held against the request
that it answers, and either becomes the job's result or counts as one of three
attempts. An import changes results, attempts and states in one version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.scalars import context_tier
from shotloom.session import tasks_for, written
from shotloom.sources.versions import VersionedTables

#: The first attempt and two repairs (fixed value).
MOST_ATTEMPTS = 3
#: How far times may be off, in milliseconds (fixed value).
TOLERANCE_MS = 50


def evidence_prefix(evidence: DataFrame, job: str, order: list[str], most: Column, cost: str | None = None, budget: Column | None = None) -> DataFrame:
    """A job's evidence in order, as far as it has at most ``most`` rows and costs at most ``budget``, with position and spent.

    The first row that does not fit ends the prefix, even if later ones would. Running
    sums of one pass over a job's rows, which are not held. A null cost is free, a
    null bound lets nothing through.
    """
    window = Window.partitionBy(job).orderBy(*order)
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.coalesce(F.col(cost), F.lit(0)) if cost else F.lit(0)
    rows = evidence.withColumns({"position": F.row_number().over(window), "spent": F.sum(own).over(running)})
    fits = (F.col("position") <= most) & (F.col("spent") <= budget if budget is not None else F.lit(True))
    broken = F.max(F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)).over(running)
    return rows.withColumn("__broken", broken).where("__broken = 0").drop("__broken")


def attempt_chains(attempts: DataFrame, attempt: str, prior: str, most: int = MOST_ATTEMPTS) -> DataFrame:
    """Each attempt with the first of its chain, its place in it (from 1) and what is wrong: null, too_long, missing_prior or endless.

    Links are followed by pointer doubling, each round twice as far, until more than
    ``most`` steps are behind. What still has a link then is endless: its chain is longer
    than was followed, or goes in circles; it has no first attempt and no place.
    """
    rows = written(attempts.select(F.col(attempt).alias("attempt"), F.col(prior).alias("up")), "attempts")
    n = tasks_for(rows.sparkSession, rows.count())
    known = rows.select(F.col("attempt").alias("at_id")).repartition(n, "at_id").distinct()
    steps = lambda up, missing: ["attempt", up.alias("up"), missing.alias("missing"), F.when(up.isNull(), 0).otherwise(1).alias("steps"), F.coalesce(up, "attempt").alias("first")]
    none = F.lit(None).cast("boolean")
    linked = rows.where("up is not null").repartition(n, "up").join(known, F.col("up") == F.col("at_id"), "left")
    hops = linked.select(*steps(F.when(F.col("at_id").isNotNull(), F.col("up")), F.when(F.col("at_id").isNull(), True))).unionByName(rows.where("up is null").select(*steps(F.col("up"), none)))
    reach = 1
    while reach <= most:
        hops = written(hops, "hops")
        far = hops.select(F.col("attempt").alias("at_id"), F.col("up").alias("next_up"), F.col("steps").alias("more"), F.col("first").alias("next_first"), F.col("missing").alias("next_missing"))
        further = hops.where("up is not null").repartition(n, "up").join(far.repartition(n, "at_id"), F.col("up") == F.col("at_id"), "left").select(
            "attempt",
            F.col("next_up").alias("up"),
            F.coalesce("missing", "next_missing").alias("missing"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.coalesce("next_first", "first").alias("first"),
        )
        hops = further.unionByName(hops.where("up is null"))
        reach *= 2
    place = (F.col("steps") + 1).cast("int")
    problem = F.when(F.col("up").isNotNull(), "endless").when(F.col("missing"), "missing_prior").when(place > most, "too_long")
    return hops.select("attempt", F.when(F.col("up").isNull(), F.col("first")).alias("first"), F.when(F.col("up").isNull(), place).alias("place"), problem.alias("problem"))


def next_attempts(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """What happens to each job that asks for a request: decision, attempt number, prior attempt and context tier.

    ``jobs``: job_id, context_tokens, slots, repair; ``attempts``: job_id, attempt_id,
    number. Decisions: prepared (a new request), awaiting (the last one stands),
    context_required, context_below_minimum, no_capacity, repair_exhausted.
    """
    last = attempts.groupBy("job_id").agg(F.max(F.struct("number", "attempt_id")).alias("last"))
    rows = jobs.join(last, "job_id", "left").withColumns({"tier": context_tier(F.col("context_tokens")), "n": F.coalesce("last.number", F.lit(0))})
    repair = F.coalesce("repair", F.lit(False))
    decision = F.when(F.col("context_tokens").isNull(), "context_required").when(F.col("slots") < 1, "no_capacity").when(F.col("tier").isNull(), "context_below_minimum")
    decision = decision.when((F.col("n") > 0) & ~repair, "awaiting").when(repair & ((F.col("n") == 0) | (F.col("n") >= MOST_ATTEMPTS)), "repair_exhausted").otherwise("prepared")
    number = F.when(decision == "prepared", F.col("n") + 1).otherwise(F.col("n")).cast("int")
    return rows.select("job_id", decision.alias("decision"), number.alias("number"), F.col("last.attempt_id").alias("prior_attempt_id"), "tier")


def result_problems(requests: DataFrame, results: DataFrame, segments: DataFrame, anchors: DataFrame, evidence: DataFrame, tolerance_ms: int = TOLERANCE_MS) -> DataFrame:
    """(job_id, segment_id, problem) of results that do not fit their requests; segment_id is null for a whole result.

    ``requests`` and ``results``: job_id, request_id, request_hash, context_hash,
    attempt_id (a request also duration_ms); ``segments``: job_id, ordinal, segment_id,
    start_ms, end_ms, start_anchor, end_anchor, refs; ``anchors``: job_id, anchor_id,
    at_ms; ``evidence``: job_id, evidence_id. Segments have to follow each other from 0 to
    the duration, start and end at the anchors they name, and refer to known evidence.
    """
    both = results.alias("r").join(requests.alias("q"), "job_id", "left")
    found = []
    for name in ("request_id", "request_hash", "context_hash", "attempt_id"):
        found.append(both.where(~F.col(f"r.{name}").eqNullSafe(F.col(f"q.{name}"))).select("job_id", F.lit(None).cast("string").alias("segment_id"), F.lit(f"{name}_mismatch").alias("problem")))
    said = segments.join(results.select("job_id"), "job_id", "left_semi")
    order = Window.partitionBy("job_id").orderBy("ordinal")
    away = lambda a, b: F.coalesce(F.abs(a - b) > tolerance_ms, F.lit(True))
    rows = said.withColumns({"before": F.coalesce(F.lag("end_ms").over(order), F.lit(0)), "same": F.row_number().over(Window.partitionBy("job_id", "segment_id").orderBy("ordinal"))})
    row = lambda rows, where, name: rows.where(where).select("job_id", "segment_id", F.lit(name).alias("problem"))
    found += [row(rows, F.col("same") > 1, "duplicate_segment_id"), row(rows, away(F.col("start_ms"), F.col("before")), "timeline_gap_or_overlap")]
    known = anchors.groupBy("job_id", F.col("anchor_id").alias("known_id")).agg(F.max("at_ms").alias("at_ms"))
    for end in ("start", "end"):
        met = said.join(known.withColumnRenamed("known_id", f"{end}_anchor"), ["job_id", f"{end}_anchor"], "left")
        found += [row(met, F.col("at_ms").isNull(), f"unknown_{end}_anchor"), row(met, F.abs(F.col("at_ms") - F.col(f"{end}_ms")) > tolerance_ms, f"{end}_anchor_time_mismatch")]
    refs = said.select("job_id", "segment_id", F.explode(F.array_distinct("refs")).alias("evidence_id"))
    found.append(row(refs.join(evidence.select("job_id", "evidence_id").distinct(), ["job_id", "evidence_id"], "left_anti"), F.lit(True), "unknown_evidence_ref").distinct())
    ends = said.groupBy("job_id").agg(F.max_by("end_ms", "ordinal").alias("last_ms"))
    spans = results.select("job_id").join(requests.select("job_id", "duration_ms"), "job_id").join(ends, "job_id", "left")
    found.append(spans.where(away(F.coalesce("last_ms", F.lit(0)), F.col("duration_ms"))).select("job_id", F.lit(None).cast("string").alias("segment_id"), F.lit("timeline_duration_mismatch").alias("problem")))
    return reduce(DataFrame.unionAll, found)


def import_results(tables: VersionedTables, results: DataFrame, segments: DataFrame, anchors: DataFrame, evidence: DataFrame, notes: dict | None = None) -> DataFrame:
    """Check ``results`` and commit what follows in one version: (job_id, status, attempts_used, n_problems).

    ``tables`` holds requests (as above), attempts (job_id, attempt_id, number,
    result_hash, n_problems), results (job_id, attempt_id, result_hash) and states
    (job_id, state). A sound result makes its job ready_to_resume; another one
    repair_required, or failed at the third attempt. A result whose attempt was
    imported before with the same hash is answered alike and changes nothing; another
    hash for a finished job is an error. A version that is no longer the latest
    raises StaleVersion and leaves all tables as they were.
    """
    version = tables.latest()
    requests, attempts, held, states = (tables.read(name, version) for name in ("requests", "attempts", "results", "states"))
    done = held.select("job_id", F.col("result_hash").alias("held_hash"))
    clash = results.join(done, "job_id").where("result_hash <> held_hash")
    if not clash.isEmpty():
        raise ValueError(f"job {clash.first().job_id} has another result")
    fresh = written(results.join(done, "job_id", "left_anti").join(requests.select("job_id"), "job_id", "left_semi"), "fresh")
    seen = attempts.where("result_hash is not null").select("job_id", F.col("attempt_id").alias("seen_id"), F.col("result_hash").alias("seen_hash"))
    problems = result_problems(requests, fresh, segments, anchors, evidence).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_problems"))
    last = attempts.groupBy("job_id").agg(F.max("number").alias("attempts_used"))
    judged = fresh.join(problems, "job_id", "left").join(last, "job_id", "left").withColumns({"n_problems": F.coalesce("n_problems", F.lit(0).cast("long")), "attempts_used": F.coalesce("attempts_used", F.lit(0))})
    status = F.when(F.col("n_problems") == 0, "ready_to_resume").when(F.col("attempts_used") < MOST_ATTEMPTS, "repair_required").otherwise("failed")
    judged = written(judged.withColumn("status", status), "judged")
    changed = judged.join(seen, (judged["job_id"] == seen["job_id"]) & judged["attempt_id"].eqNullSafe(seen["seen_id"]) & (judged["result_hash"] == seen["seen_hash"]), "left_anti")
    if not changed.isEmpty():
        new = changed.select("job_id", "attempt_id", F.col("result_hash").alias("new_hash"), F.col("n_problems").alias("new_problems"))
        marked = attempts.join(new, ["job_id", "attempt_id"], "left").withColumns({"result_hash": F.coalesce("new_hash", "result_hash"), "n_problems": F.coalesce("new_problems", "n_problems")}).select(*attempts.columns)
        state = F.when(F.col("status") == "ready_to_resume", "subagent_ready").when(F.col("status") == "failed", "failed")
        moved = states.join(changed.select("job_id", state.alias("new_state")), "job_id", "left").withColumn("state", F.coalesce("new_state", "state")).select(*states.columns)
        good = changed.where("n_problems = 0").select(*held.columns)
        tables.commit(version, replace={"attempts": marked, "states": moved}, append={"results": good}, notes=notes)
    answered = held.join(results.select("job_id", "result_hash"), ["job_id", "result_hash"], "left_semi").join(last, "job_id", "left")
    again = answered.select("job_id", F.lit("ready_to_resume").alias("status"), "attempts_used", F.lit(0).cast("long").alias("n_problems"))
    return judged.select("job_id", "status", "attempts_used", "n_problems").unionByName(again)
