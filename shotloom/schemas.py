"""Schemas of the catalog's tables, and the constraints that audits check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "transcript_span_id string, start_ms long, end_ms long, text string, source string, confidence double, language string"
SEGMENT = """schema_version int, final_segment_id string, job_id string, source_video_id string, ordinal int, start_ms long, end_ms long, title string,
short_summary string, detailed_summary string, visual_summary string, topics array<string>, keywords array<string>, entities array<string>, people array<string>,
places array<string>, actions array<string>, objects array<string>, review_required boolean, confidence double, search_text string,
transcript struct<text: string, quality: string, language: string, source: string>, provenance struct<model_run_id: string, profile: string>"""
JOB = "job_id string, state string, current_stage string, attempt_id string, progress double, updated_at string, idempotency_key string"
EVENT = "schema_version int, event_id string, job_id string, type string, occurred_at string, data map<string, string>"
SHOT = "shot_id string, ordinal int, start_ms long, end_ms long"
ANNOTATION = """shot_id string, viewpoints array<string>, shot_scale struct<start: string, end: string>,
camera_motions array<struct<type: string, direction: string, speed: string, temporal_profile: string, start_ms: long, end_ms: long, confidence: double>>,
cinematography_keywords array<string>, evidence_frame_ids array<string>, confidence double"""
CANDIDATE = "candidate_id string, platform string, source_id string, canonical_url string, title string, author string, description string, published_at string, duration_seconds double, metadata map<string, string>, rank int"

#: Primary keys and references of the six manifest tables.
MANIFEST_KEYS = {
    "candidate_source": ["candidate_id"],
    "source_discovery": ["candidate_id", "query_plan_id", "query_id", "round_number"],
    "media_unit": ["media_unit_id"],
    "media_asset_ref": ["media_unit_id", "quality"],
    "work_group": ["work_group_id"],
    "work_group_member": ["media_unit_id"],
}
MANIFEST_REFERENCES = [
    ("source_discovery", "candidate_id", "candidate_source", "candidate_id"),
    ("media_unit", "candidate_id", "candidate_source", "candidate_id"),
    ("media_asset_ref", "media_unit_id", "media_unit", "media_unit_id"),
    ("work_group_member", "media_unit_id", "media_unit", "media_unit_id"),
    ("work_group_member", "work_group_id", "work_group", "work_group_id"),
]


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, problem, key) for keys that repeat and references to nothing, over the given manifest tables."""
    found = []
    for name, keys in MANIFEST_KEYS.items():
        if name in tables:
            again = tables[name].groupBy(*keys).count().where("count > 1")
            found.append(again.select(F.lit(name).alias("table"), F.lit("duplicate").alias("problem"), F.concat_ws(":", *keys).alias("key")))
    for child, column, parent, key in MANIFEST_REFERENCES:
        if child in tables and parent in tables:
            lost = tables[child].join(tables[parent].select(F.col(key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")
            found.append(lost.select(F.lit(child).alias("table"), F.lit("orphan").alias("problem"), F.col(column).cast("string").alias("key")))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out
