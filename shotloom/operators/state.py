"""Durable state in batch: operation ledgers, fenced snapshots, leases, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ledger(operations: DataFrame, key: str, order: list[str], completed: Column) -> DataFrame:
    """Per operation key: attempts, and the first completed one, whose result any later attempt is given."""
    at = F.struct(*order)
    return operations.groupBy(key).agg(F.count(F.lit(1)).alias("n_attempts"), F.min(F.when(completed, at)).alias("first_completed"))


def fenced_latest(updates: DataFrame, key: str, attempt: str, order: list[str]) -> DataFrame:
    """Each update with ``stale``: whether a newer attempt had written before it arrived."""
    seen = F.max(attempt).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return updates.withColumn("stale", F.coalesce(F.col(attempt) < seen, F.lit(False)))


def changes(rows: DataFrame, key: str, order: list[str], *watched: str) -> DataFrame:
    """Rows at which a watched column differs from the row before, and each key's first row."""
    window = Window.partitionBy(key).orderBy(*order)
    same = F.lag(F.lit(True)).over(window).isNotNull()
    for c in watched:
        same &= F.lag(c).over(window).eqNullSafe(F.col(c))
    return rows.withColumn("__same", same).where(~F.col("__same")).drop("__same")


def lease_generations(beats: DataFrame, key: str, at: str, ttl: int, *ties: str) -> DataFrame:
    """Each heartbeat with its lease generation: one later than the lease's expiry begins the next."""
    window = Window.partitionBy(key).orderBy(at, *ties)
    before = F.lag(at).over(window)
    lost = (before.isNotNull() & (F.col(at) - before >= ttl)).cast("int")
    rows = beats.withColumn("__lost", lost)
    return rows.withColumn("generation", (F.sum("__lost").over(window.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("__lost")


def live_leases(leases: DataFrame, now: Column) -> DataFrame:
    return leases.where(F.col("expires_at") > now)


def admission(jobs: DataFrame, group: str, active: Column, job_id: str, limit: int) -> DataFrame:
    """Per group: active jobs, free places and the least id of an active one; ``active_ids`` lists them all."""
    out = jobs.groupBy(group).agg(F.count_if(active).alias("n_active"), F.min(F.when(active, F.col(job_id))).alias("first_active"))
    return out.withColumn("free", F.greatest(F.lit(0).cast("long"), F.lit(limit) - F.col("n_active")))


def active_ids(jobs: DataFrame, group: str, active: Column, job_id: str, most: int | None = None) -> DataFrame:
    """Active jobs in the order of their ids: group, place (from 1), id; the first ``most`` of each group, if given.

    One row a job instead of a list a group, so that a group may have any number.
    """
    place = F.row_number().over(Window.partitionBy(group).orderBy(job_id))
    rows = jobs.where(active).select(group, place.alias("place"), job_id)
    return rows.where(F.col("place") <= most) if most is not None else rows


def recover_interrupted(attempts: DataFrame, live: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Attempts whose owner holds no live lease any more are interrupted instead of running."""
    held = live.select(F.col(owner).alias("__owner")).distinct()
    joined = attempts.join(held, F.col(owner) == F.col("__owner"), "left")
    status = F.when((F.col("status") == "running") & F.col("__owner").isNull(), "interrupted").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("__owner")


def next_pending(stages: DataFrame, key: str, order: str, done: Column) -> DataFrame:
    """Per key the first stage in order that is not done; null if all are."""
    return stages.groupBy(key).agg(F.min(F.when(~done, F.col(order))).alias("next_stage"), F.count_if(done).alias("n_done"))
