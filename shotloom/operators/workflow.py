"""Workflow tables: next actions, issue choice, frozen documents, lineage, coverage and recorded states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.scalars import PLATFORMS
from shotloom.operators.planning import selection_ceiling


def _listed(x: Column) -> Column:
    """Sorted distinct values, joined by commas."""
    return F.array_join(F.transform(F.sort_array(F.array_distinct(x)), lambda v: v.cast("string")), ",")


def in_state(snapshots: DataFrame, state: str, wanted: str | None = None) -> DataFrame:
    """Snapshots in a state, or all of them; the test reaches the scan."""
    return snapshots if wanted is None else snapshots.where(F.col(state) == wanted)


def unique_lookup(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The row with a value. None is an empty result; a second one is corruption and an error."""
    found = rows.where(F.col(column) == F.lit(value)).limit(2)
    n = F.count(F.lit(1)).over(Window.partitionBy(column))
    error = F.raise_error(F.lit(f"more than one row with {column} = {value}")).cast("boolean")
    return found.withColumn("__n", n).where(F.when(F.col("__n") > 1, error).otherwise(F.lit(True))).drop("__n")


def next_actions(units: DataFrame, key: str, proxy_ready: Column, eligible: Column, status: Column, grouped: Column, candidate: str, unit: str) -> DataFrame:
    """Per session its counts, the action it waits for and whether its fingerprints are stale.

    A session waits for a review if a unit waits and none can be processed, else
    for the systems outside; fingerprints are stale while a ready proxy has no group.
    """
    out = units.groupBy(key).agg(
        F.count_distinct(candidate).alias("candidates_found"),
        F.count(unit).alias("media_units_found"),
        F.count_if(proxy_ready).alias("proxies_ready"),
        F.coalesce(F.bool_or(proxy_ready & eligible), F.lit(False)).alias("__ready"),
        F.coalesce(F.bool_or(status.isin("manual_review_required", "duration_unknown")), F.lit(False)).alias("__waits"),
        F.coalesce(F.bool_or(proxy_ready & ~grouped), F.lit(False)).alias("needs_fingerprints"),
    )
    action = F.when(F.col("__waits") & ~F.col("__ready"), "manual_review_required").otherwise("integration_required")
    return out.withColumn("action", action).drop("__ready", "__waits")


def first_issue(issues: DataFrame, key: str, order: list[str], matches: Column, *columns: str) -> DataFrame:
    """Per key the first issue in order that meets the predicate; keys without one are left out."""
    least = F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("m")
    return issues.where(matches).groupBy(key).agg(least).select(key, *(F.col(f"m.{c}").alias(c) for c in columns))


def frozen_documents(jobs: DataFrame, documents: DataFrame, key: str, recorded: str, content: str) -> DataFrame:
    """Jobs with the document that they froze and its state: valid, mismatch (its SHA-256 is another) or missing."""
    joined = jobs.join(documents, key, "left")
    state = F.when(F.col(content).isNull(), "missing").when(F.sha2(F.col(content), 256) == F.col(recorded), "valid").otherwise("mismatch")
    return joined.withColumn("frozen_state", state)


def catalog_coverage(jobs: DataFrame, key: str, complete: Column, end: str) -> DataFrame:
    """Per key: jobs, complete ones, the end of what the complete ones cover, and complete or partial."""
    out = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("n_jobs"), F.count_if(complete).alias("n_complete"), F.max(F.when(complete, F.col(end))).alias("covered_end"))
    return out.withColumn("status", F.when(F.col("n_jobs") == F.col("n_complete"), "complete").otherwise("partial"))


def total_audit(pages: DataFrame, key: str, page: str, total: str, n_rows: str) -> DataFrame:
    """Per paged scan: its rows, whether every page told one total, and whether that many rows came."""
    out = pages.groupBy(key).agg(F.count(page).alias("n_pages"), F.sum(n_rows).alias("n_rows"), F.min(total).alias("__a"), F.max(total).alias("__b"))
    return out.withColumns({"stable": F.col("__a").eqNullSafe(F.col("__b")), "whole": (F.col("__a") == F.col("__b")) & (F.col("n_rows") == F.col("__a"))}).drop("__a", "__b")


def request_estimate(messages: DataFrame, key: str, text: list[str], is_image: Column, reserve: int = 1024, overhead: int = 256) -> DataFrame:
    """Upper bound of a request's tokens: UTF-8 bytes of its texts, a reserve for each image, and a fixed overhead.

    The texts of an image part are not counted.
    """
    size = F.lit(0)
    for c in text:
        size += F.coalesce(F.octet_length(c), F.lit(0))
    out = messages.groupBy(key).agg(F.coalesce(F.sum(F.when(~is_image, size)), F.lit(0)).cast("long").alias("text_bytes"), F.count_if(is_image).alias("n_images"))
    return out.withColumn("estimated_tokens", F.col("text_bytes") + F.col("n_images") * reserve + overhead)


def selection_requests(segments: DataFrame, catalogs: DataFrame, key: str, complete: Column, lineage: dict[str, str], n_facets: Column) -> DataFrame:
    """Segments with a complete catalog of their own lineage, each with the number of candidates it may ask for.

    ``lineage`` pairs columns of segments with columns of catalogs that must be equal.
    """
    done = catalogs.where(complete).select(F.col(key).alias("__key"), *(F.col(b).alias(f"__{b}") for b in lineage.values())).distinct()
    met = segments[key] == done["__key"]
    for a, b in lineage.items():
        met &= segments[a].eqNullSafe(done[f"__{b}"])
    return segments.join(done, met, "left_semi").withColumn("max_k", selection_ceiling(n_facets))


def scope_audit(branches: DataFrame, key: str, position: str, platform: str, scope: tuple[str, ...], known: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """Per plan its platforms in order, and whether they are the whole scope in the fixed order of ``known``."""
    want = ",".join(p for p in known if p in scope)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(position, platform))), lambda x: x[platform]), ",")
    return branches.groupBy(key).agg(listed.alias("platforms")).withColumn("covers", F.col("platforms") == want)


def record_states(updates: DataFrame, key: str, order: list[str], status: str, ids: str, final: tuple[str, ...]) -> DataFrame:
    """The state of each key after all updates, its revision, and the updates refused.

    The first terminal update stands: a later one is refused unless it says the
    same. A revision is a change of status or ids. Ids are sorted and distinct.
    """
    window = Window.partitionBy(key).orderBy(*order)
    rows = updates.withColumn("__ids", _listed(F.col(ids)))
    is_final = F.col(status).isin(*final)
    ended = F.first(F.when(is_final, F.struct(status, "__ids")), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"__ended": ended, "__now": F.struct(status, "__ids"), "__no": F.row_number().over(window)})
    taken = F.col("__ended").isNull()
    changed = taken & ~F.lag("__now").over(window).eqNullSafe(F.col("__now"))
    rows = rows.withColumn("__changed", changed)
    last = F.max_by(F.col("__now"), F.when(taken, F.col("__no"))).alias("m")
    out = rows.groupBy(key).agg(last, F.count_if("__changed").alias("revision"), F.count_if(~taken & (F.col("__now") != F.col("__ended"))).alias("n_refused"))
    return out.select(key, F.col(f"m.{status}").alias(status), F.col("m.__ids").alias("ids"), "revision", "n_refused")


def commit_results(operations: DataFrame, commits: DataFrame, key: str, attempt: str, result: str) -> DataFrame:
    """What each commit does: committed, replayed (the result was there), stale (a newer attempt runs) or unknown.

    ``operations``: key, latest_attempt, result (null while it runs).
    """
    held = operations.select(key, F.col("latest_attempt").alias("__latest"), F.col(result).alias("__result"), F.lit(True).alias("__known"))
    outcome = F.when(F.col("__known").isNull(), "unknown").when(F.col("__result").isNotNull(), "replayed").when(F.col(attempt) != F.col("__latest"), "stale").otherwise("committed")
    joined = commits.join(held, key, "left").withColumn("outcome", outcome)
    return joined.withColumn(result, F.when(F.col("outcome") == "replayed", F.col("__result")).when(F.col("outcome") == "committed", F.col(result))).drop("__latest", "__result", "__known")


def stage_order_audit(claims: DataFrame, key: str, position: str, began: str, completed: str) -> DataFrame:
    """Per key: stages, those that began before an earlier one was completed, and the first such position.

    Positions are whole numbers; stages of one position do not wait for each other.
    """
    before = F.max(F.coalesce(completed, F.lit(2**62))).over(Window.partitionBy(key).orderBy(position).rangeBetween(Window.unboundedPreceding, -1))
    early = F.col(began).isNotNull() & (F.col("__before") > F.col(began))
    rows = claims.withColumn("__before", before)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_stages"), F.count_if(early).alias("n_early"), F.min(F.when(early, F.col(position))).alias("first_early"))
