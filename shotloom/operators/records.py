"""Rows that freeze inputs and name things: workflows, export requests, model runs, readable paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.canonical import frozen_id, row_json
from shotloom.functions.scalars import safe_id, safe_identity, safe_title
from shotloom.session import tasks_for

#: Folders of a session's readable view, by quality (fixed values).
QUALITY_FOLDERS = {"low_proxy": "low-proxy", "high": "high-quality"}
USAGE = ("input_tokens", "output_tokens", "total_tokens")


def frozen_workflows(inputs: DataFrame, document: str, plans: str, settings: list[str]) -> DataFrame:
    """Workflows of frozen documents: workflow_id, both documents' SHA-256 and the settings.

    ``document`` and ``plans`` are canonical JSON texts, ``settings`` what belongs to the
    identity besides (max_rounds and max_videos among them). The id is ``vmw_`` and 20
    digits of the digest of all of it in canonical JSON: the same inputs give the same
    workflow. Limits below one, or null ones, are an error.
    """
    hashed = inputs.withColumns({"collection_input_sha256": F.sha2(document, 256), "initial_query_plans_sha256": F.sha2(plans, 256)})
    names = ["collection_input_sha256", "initial_query_plans_sha256", *settings]
    fit = F.coalesce((F.col("max_rounds") >= 1) & (F.col("max_videos") >= 1), F.lit(False))
    checked = F.when(fit, frozen_id(hashed, "vmw", *names)).otherwise(F.raise_error(F.lit("workflow limits must be positive")).cast("string"))
    return hashed.select(checked.alias("workflow_id"), F.lit(1).alias("state_version"), F.lit("active").alias("status"), *names)


def export_requests(assets: DataFrame, ranges: DataFrame) -> DataFrame:
    """Requests for clips of assets: asset_id, request_id, idempotency_key, clips (array in order) or what is wrong with them.

    ``assets``: asset_id, workflow_id, selection_id, source_sha256; ``ranges``: asset_id,
    position, clip_id, start_seconds, end_seconds. Ids come from the digest of workflow,
    selection, asset, its bytes' digest and the clips in canonical JSON. Problems: no_ranges,
    unsafe_id, duplicate_clip, not_a_number, not_half_open (from 0 on, end behind start).
    An asset with a problem has no ids. Ranges are dealt out once, by asset.
    """
    clip = F.struct("clip_id", "end_seconds", "start_seconds")
    own = F.count(F.lit(1)).over(Window.partitionBy("asset_id", "clip_id"))
    bad = F.when(~safe_id(F.col("clip_id")), "unsafe_id").when(own > 1, "duplicate_clip").when(F.col("start_seconds").isNull() | F.col("end_seconds").isNull() | F.isnan("start_seconds") | F.isnan("end_seconds"), "not_a_number").when((F.col("start_seconds") < 0) | (F.col("end_seconds") <= F.col("start_seconds")), "not_half_open")
    n = tasks_for(ranges.sparkSession, ranges.count())
    listed = ranges.repartition(n, "asset_id").withColumn("bad", bad).groupBy("asset_id").agg(F.array_sort(F.collect_set("bad")).alias("problems"), F.sort_array(F.collect_list(F.struct("position", clip.alias("clip")))).alias("c"))
    rows = assets.repartition(n, "asset_id").join(listed, "asset_id", "left").withColumn("ranges", F.transform("c", lambda x: x["clip"]))
    problems = F.when(F.col("c").isNull(), F.array(F.lit("no_ranges"))).when(~safe_id(F.col("asset_id")), F.array_sort(F.array_union("problems", F.array(F.lit("unsafe_id"))))).otherwise(F.col("problems"))
    rows = rows.withColumn("problems", problems)
    sound = F.size("problems") == 0
    rows = rows.withColumn("lineage", F.when(sound, F.sha2(row_json(rows, "workflow_id", "selection_id", "asset_id", "source_sha256", "ranges"), 256)))
    name = lambda prefix, n: F.concat(F.lit(prefix), F.substring("lineage", 1, n))
    return rows.select("asset_id", name("mc_", 12).alias("request_id"), name("idem_", 16).alias("idempotency_key"), F.when(sound, F.col("ranges")).alias("clips"), F.array_join("problems", ",").alias("problems"))


def model_runs(runs: DataFrame, attempts: DataFrame) -> DataFrame:
    """One audit row a model call: the run's columns, attempts, sums of usage (nothing said is zero), the last trace id, whether it was repaired, and the raw responses' artifact.

    ``runs``: model_run_id and what is recorded of it; ``attempts``: model_run_id,
    attempt_no, input_tokens, output_tokens, total_tokens, trace_id, response. The artifact
    is named by the digest of the responses' digests in order, so that raw rows stay where
    they are. A run without attempts has zeros and nulls.
    """
    told = F.nullif(F.col("trace_id"), F.lit(""))
    digests = F.transform(F.sort_array(F.collect_list(F.struct("attempt_no", F.sha2(F.coalesce("response", F.lit("")), 256).alias("d")))), lambda x: x["d"])
    sums = [F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c) for c in USAGE]
    kept = attempts.groupBy("model_run_id").agg(F.count(F.lit(1)).alias("n_attempts"), *sums, F.max_by(told, F.when(told.isNotNull(), F.col("attempt_no"))).alias("trace_id"), F.concat(F.lit("artifact_"), F.substring(F.sha2(F.array_join(digests, "\n"), 256), 1, 24)).alias("raw_response_artifact_id"))
    zero: dict[str, Column] = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_attempts", *USAGE)}
    return runs.join(kept, "model_run_id", "left").withColumns({**zero, "repair_attempted": F.coalesce(F.col("n_attempts") > 1, F.lit(False))})


def readable_paths(assets: DataFrame, title_length: int = 80, id_length: int = 10) -> DataFrame:
    """``assets`` with display_relative_path: materials/by-session, the session, a folder of the source, one of the quality, and a file of the unit.

    ``assets``: session_id, platform, source_title, source_id, unit_title, unit_id, quality,
    suffix. Names are titles and ids as file systems take them; a unit's id loses the
    platform before it. A session id of another form than ses_ and up to 80 of a small
    set, or an unknown quality, is an error.
    """
    safe = F.col("session_id").rlike(r"^ses_[A-Za-z0-9_-]{1,80}\z")
    session = F.when(F.coalesce(safe, F.lit(False)), F.col("session_id")).otherwise(F.raise_error(F.lit("not a session id")).cast("string"))
    folder = F.coalesce(*(F.when(F.col("quality") == name, place) for name, place in QUALITY_FOLDERS.items()), F.raise_error(F.lit("unknown quality")).cast("string"))
    own = F.regexp_replace("unit_id", F.concat(F.lit(r"^\Q"), F.col("platform"), F.lit(r"\E:")), F.lit(""))
    source = F.concat(safe_title(F.col("source_title"), title_length), F.lit("__"), F.col("platform"), F.lit("__"), safe_identity(F.col("source_id"), id_length))
    name = F.concat(safe_title(F.col("unit_title"), title_length), F.lit("__"), safe_identity(own, id_length), F.lower("suffix"))
    return assets.withColumn("display_relative_path", F.concat_ws("/", F.lit("materials/by-session"), session, source, folder, name))
