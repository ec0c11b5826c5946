"""The source manifest: ordered upserts, sticky states, review gates and the nested view.

Arrivals carry an order column; what a row-by-row store would have done to its
state is computed in one pass over all arrivals of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that a later resolve does not reset; an approved unit is reset (fixed values).
STICKY = ("proxy_ready", "high_quality_ready", "rejected")
#: States that keep a unit from being understood (fixed values).
BLOCKED = ("manual_review_required", "duration_unknown", "rejected")
#: States from which a review may be decided (fixed values).
REVIEWABLE = ("manual_review_required", "duration_unknown", "approved", "rejected")


def upsert(arrivals: DataFrame, keys: list[str], order: list[str], latest: list[str], latest_known: list[str] = (), least: list[str] = ()) -> DataFrame:
    """State after all arrivals of a key: the last value, the last known value, or the least value of each column."""
    at = F.struct(*order)
    aggs = [F.max_by(c, at).alias(c) for c in latest]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in latest_known]
    aggs += [F.min(c).alias(c) for c in least]
    return arrivals.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_arrivals"))


def sticky_state(arrivals: DataFrame, key: str, order: list[str], state: str, sticky: tuple[str, ...] = STICKY) -> DataFrame:
    """Each arrival with the state held after it: once a sticky state is reached only another sticky one replaces it."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col(state).isin(*sticky), F.col(state)), True).over(before)
    return arrivals.withColumn("held", F.coalesce(held, F.col(state)))


def initial_status(seconds: Column, longest: float = 1200) -> Column:
    """State of a new unit by its duration."""
    return F.when(seconds.isNull(), "duration_unknown").when(seconds > longest, "manual_review_required").otherwise("discovered")


def eligible(proxy_ready: Column, status: Column, role: Column) -> Column:
    """Whether a unit goes on to understanding: proxy there, not blocked, and primary if it is in a group."""
    return proxy_ready & ~status.isin(*BLOCKED) & (role.isNull() | (role == "primary"))


def decide_review(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """Units with decided reviews applied where their state allows it; ``applied`` is null without a decision.

    ``decisions``: media_unit_id, approved, actor, decided_at; the last of a unit counts.
    """
    last = decisions.groupBy("media_unit_id").agg(F.max_by(F.struct("approved", "actor"), "decided_at").alias("d"))
    joined = units.join(last, "media_unit_id", "left")
    allowed = F.col("status").isin(*REVIEWABLE)
    status = F.when(F.col("d").isNotNull() & allowed, F.when(F.col("d.approved"), "approved").otherwise("rejected")).otherwise(F.col("status"))
    return joined.select(*[c for c in units.columns if c != "status"], status.alias("status"), F.when(F.col("d").isNotNull(), allowed).alias("applied"), F.col("d.actor").alias("review_actor"))


def manifest_order(platform: Column) -> Column:
    """Order of platforms in a published manifest: the last two share a place."""
    return F.when(platform == "bilibili", 1).when(platform == "douyin", 2).when(platform == "xiaohongshu", 3).otherwise(4)


def nested(candidates: DataFrame, discoveries: DataFrame, units: DataFrame, assets: DataFrame) -> DataFrame:
    """One row per candidate with its discoveries and units, units with their assets, all in order."""
    held = assets.groupBy("media_unit_id").agg(F.sort_array(F.collect_list(F.struct("quality", *[c for c in assets.columns if c not in ("media_unit_id", "quality")]))).alias("assets"))
    inner = units.join(held, "media_unit_id", "left")
    unit = F.struct(F.coalesce("part_index", F.lit(-1)).alias("__part"), "media_unit_id", *[c for c in units.columns if c not in ("media_unit_id", "candidate_id")], "assets")
    inner = inner.groupBy("candidate_id").agg(F.sort_array(F.collect_list(unit)).alias("media_units"))
    found = discoveries.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in discoveries.columns if c != "candidate_id"]))).alias("discoveries"))
    out = candidates.join(found, "candidate_id", "left").join(inner, "candidate_id", "left")
    return out.withColumn("media_units", F.transform("media_units", lambda u: u.dropFields("__part")))


def reviews(nested_rows: DataFrame) -> DataFrame:
    """Units of a nested manifest that wait for a review or a duration."""
    flat = nested_rows.select("candidate_id", F.explode("media_units").alias("u"))
    return flat.where(F.col("u.status").isin("manual_review_required", "duration_unknown")).select("candidate_id", "u.*")


def merge_artifacts(artifacts: list[DataFrame], key: str) -> DataFrame:
    """The rows of several artifacts as one table; equal rows of a key are one, rows that differ are a conflict.

    Returns the columns, of the least row of a key, with n_copies and conflict.
    """
    rows = artifacts[0]
    for other in artifacts[1:]:
        rows = rows.unionByName(other)
    whole = F.struct(*(c for c in rows.columns if c != key))
    out = rows.groupBy(key).agg(F.min(whole).alias("m"), F.count(F.lit(1)).alias("n_copies"), (~F.min(whole).eqNullSafe(F.max(whole))).alias("conflict"))
    return out.select(key, "m.*", "n_copies", "conflict")


def replace_groups(units: DataFrame, candidates: DataFrame, groups: DataFrame, candidate: str = "candidate_id", unit: str = "media_unit_id") -> DataFrame:
    """Units of known candidates with the groups of a new snapshot: those that it does not name have none any more.

    ``groups``: unit, work_group_id, role. A unit in two groups is an error.
    """
    counted = groups.groupBy(unit).agg(F.min(F.struct("work_group_id", "role")).alias("g"), F.count(F.lit(1)).alias("__n"))
    error = F.raise_error(F.concat(F.lit("more than one work group for "), F.col(unit).cast("string"))).cast("boolean")
    own = units.drop("work_group_id", "role").join(candidates.select(candidate), candidate)
    joined = own.join(counted, unit, "left").where(F.when(F.col("__n") > 1, error).otherwise(F.lit(True)))
    return joined.select(*own.columns, F.col("g.work_group_id").alias("work_group_id"), F.col("g.role").alias("role"))
