"""Workflow, semantics and scalar queries over the driver's tables: orders stand for jobs, customers for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotloom.functions import scalars
from shotloom.operators import folds, intervals, manifest, merge, retrieval, semantics, workflow
from shotloom.plans.timelines import DAY, HOUR, events, table


def jobs_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.in_state(table(spark, sf_dir, "orders"), "o_orderstatus", "P").select("o_orderkey", "o_custkey")


def job_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.unique_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 33)


def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "manual_review_required").otherwise("proxy_ready")
    return workflow.next_actions(units, "o_custkey", F.col("o_totalprice") > 200_000, F.col("o_orderstatus") != "F", status, ~F.col("o_orderpriority").startswith("5"), "o_orderdate", "o_orderkey")


def first_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.first_issue(events(spark, sf_dir), "user_id", ["ms", "event_id"], F.col("event_type") == "error", "event_id", "ms", "value")


def frozen_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    jobs = rows.select("c_custkey", F.sha2("c_name", 256).alias("recorded"))
    found = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    documents = rows.where("c_acctbal > 0").select("c_custkey", found.alias("config"))
    return workflow.frozen_documents(jobs, documents, "c_custkey", "recorded", "config").select("c_custkey", "frozen_state")


def catalog_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.catalog_coverage(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_linestatus") == "F", "l_linenumber")


def paging_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of five orders of a customer; the last page of customers that 11 divides tells another total."""
    window = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.count(F.lit(1)).over(window).alias("n"), F.floor((F.row_number().over(window.orderBy("o_orderkey")) - 1) / 5).alias("page"))
    told = F.col("n") + F.when((F.col("o_custkey") % 11 == 0) & (F.col("page") == 1), 1).otherwise(0)
    pages = rows.groupBy("o_custkey", "page").agg(F.max(told).alias("total"), F.count(F.lit(1)).alias("n_rows"))
    return workflow.total_audit(pages, "o_custkey", "page", "total", "n_rows")


def request_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.request_estimate(table(spark, sf_dir, "conversations"), "conv_id", ["role", "text"], F.col("role") == "system")


def selection_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return workflow.selection_requests(orders, lines, "o_orderkey", F.col("l_returnflag") == "R", {"o_orderstatus": "l_linestatus"}, (F.col("o_orderkey") % 8).cast("int"))


def scope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.scope_audit(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", ("assistant", "user"), ("system", "user", "assistant"))


def recorded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("ids", F.array("o_orderpriority", F.lit("3-MEDIUM")))
    return workflow.record_states(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", "ids", ("F",))


def committed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 0").select("o_orderkey", (F.col("o_orderkey") % 4 + 1).alias("latest_attempt"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("result"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_returnflag").alias("result"))
    return workflow.commit_results(held, asked, "o_orderkey", "l_linenumber", "result")


def stage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("long").alias("began"), F.when(F.col("l_linestatus") == "F", F.col("l_partkey").cast("long") + 100).alias("completed"))
    return workflow.stage_order_audit(rows, "l_orderkey", "l_linenumber", "began", "completed")


def compact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k long").alias("props"), F.struct("event_type", "value").alias("about"))
    return semantics.flattened(rows, ["event_id", "user_id"], {"props_k": "props.k", "event_type": "about.event_type"})


def _anchored(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Between neighbouring events of a kind one proposed segment, named by the two events."""
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    rows = events(spark, sf_dir).where(F.col("event_type") == kind)
    return rows.select("user_id", F.row_number().over(order).alias("segment_no"), F.col("event_id").alias("start_anchor"), F.lead("event_id").over(order).alias("end_anchor")).where("end_anchor is not null")


def proposed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    anchors = rows.where("event_id % 50 <> 0").select("user_id", F.col("event_id").alias("anchor_id"), F.col("ms").alias("at_ms"))
    frames = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("frame_id"), F.col("ms").alias("frame_ms"))
    spans = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("span_id"), F.col("ms").alias("r_start"), (F.col("ms") + HOUR).alias("r_end"))
    return semantics.segment_proposals(_anchored(spark, sf_dir, "purchase"), anchors, frames, spans, "user_id", DAY)


def annotation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("shot_id"), F.lit(1).alias("start_ms"), F.lit(4).alias("end_ms"), F.array(F.lit(1).cast("int")).alias("frame_ids"))
    number = F.col("l_linenumber").cast("int")
    motion = F.struct(number.alias("start_ms"), (number + F.floor(F.col("l_quantity") / 15).cast("int")).alias("end_ms"))
    own = table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    return semantics.annotation_audit(shots, own.select(F.col("l_orderkey").alias("shot_id"), F.array(number).alias("evidence_frame_ids"), F.array(motion).alias("motions")), "shot_id")


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.struct(F.col("l_suppkey").alias("collection_session_id"), F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("work_group_id"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.collect_list(source).alias("sources"))
    segments = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("segment_id"), F.lit(0).cast("long").alias("start_ms"), (F.col("o_custkey").cast("long") + 1).alias("end_ms"))
    return semantics.candidate_rows(items, segments, "job_id", "segment_id", "sources").select("job_id", "candidate_segment_id", "session_ids", "work_group_ids", "duration_ms")


def lenient_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge plan where only every other boundary has a decision; the rest are kept."""
    ranges = intervals.ranges_from_points(events(spark, sf_dir), "user_id", "ms", "event_id")
    decisions = events(spark, sf_dir).where("event_id % 2 = 0").select("event_id", F.when(F.col("event_type") == "error", "review").otherwise("remove").alias("decision"))
    return merge.merge_plan(semantics.with_decisions(ranges, decisions, "event_id"), "user_id", "event_id")


def guarded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.ranges_from_points(events(spark, sf_dir), "user_id", "ms", "event_id")
    decision = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 7 == 0, "join").otherwise("remove")
    relationship = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 3 == 0, "different_topic").otherwise("same_continuous_event")
    rows = rows.withColumns({"event": F.col("event_type"), "decision": decision, "relationship": relationship, "starts_mid_action": F.col("value") > 60, "ends_mid_action": F.col("value") < 2})
    return semantics.guarded_decisions(rows, "user_id", "ordinal")


def anchored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = events(spark, sf_dir).where("event_type in ('purchase', 'click')").select("user_id", F.col("event_id").alias("anchor_id"), (F.col("ms") * 100_000_000 + F.col("event_id")).alias("at_ms"))
    return semantics.anchored_segments(_anchored(spark, sf_dir, "purchase").where("start_anchor % 10 <> 0"), anchors, "user_id")


def capped_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of each user's span, at most 40 of at most a day, cut at the best scored purchases."""
    rows = events(spark, sf_dir)
    spans = rows.groupBy("user_id").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))
    scenes = rows.where("event_type = 'purchase'").groupBy("user_id", F.col("ms").alias("at_ms")).agg(F.max("value").alias("score"))
    kept = semantics.capped_scenes(scenes, spans, "user_id", "at_ms", "score", DAY, 40)
    points = kept.select("user_id", "at_ms").unionByName(spans.select("user_id", F.explode(F.array("start_ms", "end_ms")).alias("at_ms")))
    parts = intervals.split_long(intervals.ranges_from_points(points, "user_id", "at_ms"), DAY)
    return semantics.named_boundaries(parts, "user_id")


def shot_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with a purchase among their reasons begin shots."""
    hours = events(spark, sf_dir).groupBy("user_id", (F.floor(F.col("ms") / HOUR) * HOUR).alias("at_ms")).agg(F.collect_set("event_type").alias("reasons"))
    return intervals.ranges_from_points(hours.where(F.array_contains("reasons", "purchase")), "user_id", "at_ms").select("user_id", "ordinal", "start_ms", "end_ms")


def artifact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, dealt into three artifacts by line number."""
    lines = table(spark, sf_dir, "lineitem")
    parts = [lines.where(F.col("l_linenumber") % 3 == k).select("l_orderkey", "l_returnflag", "l_linestatus") for k in (0, 1, 2)]
    return manifest.merge_artifacts(parts, "l_orderkey")


def group_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    units = orders.select(F.col("o_orderkey").alias("media_unit_id"), F.col("o_custkey").alias("candidate_id"))
    candidates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"))
    groups = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("media_unit_id"), F.concat(F.lit("wg_"), F.col("o_custkey").cast("string")).alias("work_group_id"), F.lit("primary").alias("role"))
    return manifest.replace_groups(units, candidates, groups)


def escaped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", scalars.escape_html(F.col("text")).alias("escaped"))


def default_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    platform = F.element_at(F.array(F.lit("bilibili"), F.lit("douyin"), F.lit("xiaohongshu")), (F.col("event_id") % 3 + 1).cast("int"))
    known = F.when(F.col("event_type") == "error", F.create_map(F.lit("type"), F.col("event_type")))
    identity = scalars.default_identity(platform, F.col("user_id").cast("string"), F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), known)
    return table(spark, sf_dir, "events").select("event_id", F.to_json(identity).alias("identity"))


def stream_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(scalars.one_signature("l_returnflag", "l_linestatus", "l_tax").alias("joinable"))


def config_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.cache_key("o_orderstatus", "o_custkey", "o_orderpriority").alias("cache_key"))


def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = lambda c: F.when(F.col("p_partkey") % 3 != 0, c)
    name = F.concat(F.lit("gear_"), (F.col("p_partkey") * 37).cast("string"), F.lit("_x"), (F.col("p_size") * 20).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.stream_edge(known(F.col("p_size").cast("int") * 10), known((F.col("p_partkey") % 500).cast("int")), name).alias("edge"))


def conforming_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumns({"width": F.col("p_size") * 40, "height": F.col("p_size") * 30, "rotation": F.when(F.col("p_partkey") % 2 == 0, 90).otherwise(0), "even": F.col("p_partkey") % 4 == 0})
    return rows.select(
        "p_partkey",
        scalars.proxy_required(F.col("width"), F.col("height"), F.col("rotation")).alias("proxy_required"),
        scalars.matches_profile({"rotation": 0, "even": False}).alias("matches"),
        scalars.geometry_disposition(scalars.display_ratio(F.col("width") * 1.0, F.col("height") * 1.0, 4 / 3, F.col("rotation"))).alias("geometry"),
    )


def near_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are the strong points, clicks the others; within half an hour they are one anchor."""
    points = events(spark, sf_dir).where("event_type in ('purchase', 'click')").select("user_id", "ms", F.when(F.col("event_type") == "purchase", "scene_change").otherwise("periodic").alias("reason"))
    return folds.merge_near(points, "user_id", "ms", "reason", HOUR // 2)


def picked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of a user's events a week, the nearest to even targets."""
    rows = events(spark, sf_dir).withColumn("week", F.floor(F.col("ms") / (7 * DAY)))
    frames = rows.select("user_id", "week", "event_id", F.col("ms").alias("frame_ms"), (F.col("week") * 7 * DAY).alias("start_ms"), ((F.col("week") + 1) * 7 * DAY).alias("end_ms"))
    return folds.pick_frames(frames, ["user_id", "week"], "event_id", 3)


def lineage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("session_id"), "n_name")
    candidates = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("candidate_id"), "c_mktsegment")
    units = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("candidate_id"), "o_orderstatus")
    return semantics.lineage_records(sessions, candidates, units, "o_orderkey").select("o_orderkey", F.to_json("lineage").alias("lineage"))


def annotation_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines annotate their orders, whose customers' numbers stand for times."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line_no"))
    shots = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("start_ms"), (F.col("o_custkey") + 500).alias("end_ms"))
    return retrieval.annotation_references(lines.join(shots.select("o_orderkey"), "o_orderkey", "left_semi"), shots, "o_orderkey")


_NAMES = (
    lineage_records, annotation_references,
    jobs_in_state, job_by_key, next_actions, first_issue, frozen_configs, catalog_coverage, paging_audit, request_estimate, selection_requests,
    scope_audit, recorded_states, committed_results, stage_order, compact_events, proposed_segments, annotation_audit, candidate_rows,
    lenient_merge_plan, guarded_decisions, anchored_segments, capped_timeline, shot_timeline, artifact_merge, group_snapshot, escaped_turns,
    default_identities, stream_signatures, config_keys, stream_edges, conforming_parts, near_anchors, picked_frames,
)
QUERIES = {f.__name__: f for f in _NAMES}

_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM events)"
_R = _E + """, r0 AS (SELECT *, ms AS start_ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS end_ms FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id)::INT AS ordinal FROM r0 WHERE end_ms > start_ms)"""
_P = """p0 AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id)::INT AS segment_no, event_id AS start_anchor,
  lead(event_id) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS end_anchor FROM e WHERE event_type = 'purchase'),
p AS (SELECT * FROM p0 WHERE end_anchor IS NOT NULL)"""

ORACLE_SQL = {
    "lineage_records": """SELECT o_orderkey, '{"session_id":' || n_nationkey || ',"n_name":"' || n_name || '","candidate_id":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","o_orderstatus":"' || o_orderstatus || '"}' AS lineage
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "annotation_references": "SELECT printf('cinematography_%04d', l_linenumber) AS annotation_id, o_orderkey, o_custkey / 1000 AS start_seconds, (o_custkey + 500) / 1000 AS end_seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "jobs_in_state": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "job_by_key": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 33",
    "next_actions": """WITH u AS (SELECT *, o_totalprice > 200000 AS ready, o_orderpriority = '1-URGENT' AS waits FROM orders)
SELECT o_custkey, count(DISTINCT o_orderdate) AS candidates_found, count(*) AS media_units_found, count(*) FILTER (ready) AS proxies_ready,
  bool_or(ready AND o_orderpriority LIKE '5%') AS needs_fingerprints,
  CASE WHEN bool_or(waits) AND NOT bool_or(ready AND o_orderstatus <> 'F') THEN 'manual_review_required' ELSE 'integration_required' END AS action FROM u GROUP BY o_custkey""",
    "first_issue": f"WITH {_E} SELECT user_id, event_id, ms, value FROM e WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) = 1",
    "frozen_configs": "SELECT c_custkey, CASE WHEN NOT c_acctbal > 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'mismatch' ELSE 'valid' END AS frozen_state FROM customer",
    "catalog_coverage": """SELECT l_orderkey, count(*) AS n_jobs, count(*) FILTER (l_linestatus = 'F') AS n_complete, max(l_linenumber) FILTER (l_linestatus = 'F') AS covered_end,
  CASE WHEN bool_and(l_linestatus = 'F') THEN 'complete' ELSE 'partial' END AS status FROM lineitem GROUP BY l_orderkey""",
    "paging_audit": """SELECT o_custkey, ceil(count(*) / 5)::BIGINT AS n_pages, count(*)::BIGINT AS n_rows, NOT (o_custkey % 11 = 0 AND count(*) > 5) AS stable, NOT (o_custkey % 11 = 0 AND count(*) > 5) AS whole FROM orders GROUP BY o_custkey""",
    "request_estimate": """WITH t AS (SELECT conv_id, coalesce(sum(CASE WHEN role = 'system' THEN NULL ELSE coalesce(octet_length(encode(role)), 0) + coalesce(octet_length(encode(text)), 0) END), 0)::BIGINT AS text_bytes, count(*) FILTER (role = 'system') AS n_images FROM conversations GROUP BY conv_id)
SELECT *, text_bytes + n_images * 1024 + 256 AS estimated_tokens FROM t""",
    "selection_requests": "SELECT o_orderkey, o_orderstatus, least(12, 2 * (o_orderkey % 8) + 2)::INT AS max_k FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_linestatus = o_orderstatus)",
    "scope_audit": """WITH t AS (SELECT conv_id, coalesce(string_agg(role, ',' ORDER BY turn, role), '') AS platforms FROM conversations GROUP BY conv_id) SELECT *, platforms = 'user,assistant' AS covers FROM t""",
    "recorded_states": """WITH u AS (SELECT o_custkey, o_orderstatus AS s, CASE WHEN o_orderpriority = '3-MEDIUM' THEN '3-MEDIUM' ELSE least(o_orderpriority, '3-MEDIUM') || ',' || greatest(o_orderpriority, '3-MEDIUM') END AS ids,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS no FROM orders),
f AS (SELECT o_custkey, min(no) AS stop FROM u WHERE s = 'F' GROUP BY o_custkey),
v AS (SELECT u.*, stop IS NULL OR no <= stop AS taken, lag(s || '|' || ids) OVER (PARTITION BY o_custkey ORDER BY no) AS before FROM u LEFT JOIN f USING (o_custkey)),
m AS (SELECT o_custkey, max_by(s, no) FILTER (taken) AS o_orderstatus, max_by(ids, no) FILTER (taken) AS ids, count(*) FILTER (taken AND before IS DISTINCT FROM s || '|' || ids) AS revision FROM v GROUP BY o_custkey)
SELECT m.*, (SELECT count(*) FROM v WHERE v.o_custkey = m.o_custkey AND NOT taken AND s || '|' || v.ids <> m.o_orderstatus || '|' || m.ids) AS n_refused FROM m""",
    "committed_results": """WITH j AS (SELECT l_orderkey AS o_orderkey, l_linenumber, l_returnflag, o_orderpriority, CASE WHEN o_orderkey IS NULL OR l_orderkey % 9 = 0 THEN 'unknown' WHEN o_orderstatus = 'P' THEN 'replayed' WHEN l_linenumber <> l_orderkey % 4 + 1 THEN 'stale' ELSE 'committed' END AS outcome
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, l_linenumber, outcome, CASE outcome WHEN 'replayed' THEN o_orderpriority WHEN 'committed' THEN l_returnflag END AS result FROM j""",
    "stage_order": """WITH s AS (SELECT *, max(CASE WHEN l_linestatus = 'F' THEN l_partkey + 100 ELSE 4611686018427387904 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM lineitem)
SELECT l_orderkey, count(*) AS n_stages, count(*) FILTER (before > l_partkey) AS n_early, min(l_linenumber) FILTER (before > l_partkey) AS first_early FROM s GROUP BY l_orderkey""",
    "compact_events": "SELECT event_id, user_id, (props::JSON ->> 'k')::BIGINT AS props_k, event_type FROM events",
    "proposed_segments": f"""WITH {_E}, {_P}, q AS (SELECT p.*, a.ms AS start_ms, b.ms AS end_ms FROM p LEFT JOIN e a ON a.event_id = start_anchor AND start_anchor % 50 <> 0 LEFT JOIN e b ON b.event_id = end_anchor AND end_anchor % 50 <> 0),
f AS (SELECT q.user_id, segment_no, count(*) AS n_frames, min(event_id) AS first_frame FROM q JOIN e ON e.user_id = q.user_id AND event_type = 'click' AND ms >= start_ms AND ms < end_ms GROUP BY ALL),
s AS (SELECT q.user_id, segment_no, count(*) AS n_spans FROM q JOIN e ON e.user_id = q.user_id AND event_type = 'view' AND ms < end_ms AND ms + 3600000 > start_ms AND end_ms > start_ms GROUP BY ALL)
SELECT user_id, segment_no, start_ms, end_ms, coalesce(n_frames, 0) AS n_frames, first_frame, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN start_ms IS NULL OR end_ms IS NULL THEN 'unknown_anchor' WHEN end_ms <= start_ms THEN 'empty_range' END AS problem FROM q LEFT JOIN f USING (user_id, segment_no) LEFT JOIN s USING (user_id, segment_no)""",
    "annotation_audit": """WITH a AS (SELECT l_orderkey AS shot_id, count(*) AS n, max(l_linenumber) AS frame, max(l_linenumber + floor(l_quantity / 15)) AS last FROM lineitem WHERE l_quantity > 10 GROUP BY 1),
j AS (SELECT coalesce(a.shot_id, o_orderkey) AS shot_id, n, frame, last, o_orderkey FROM a FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = a.shot_id)
SELECT shot_id, 'missing' AS problem FROM j WHERE n IS NULL UNION ALL SELECT shot_id, 'unknown' FROM j WHERE o_orderkey IS NULL UNION ALL SELECT shot_id, 'duplicate' FROM j WHERE n > 1
UNION ALL SELECT shot_id, 'unknown_frame' FROM j WHERE o_orderkey IS NOT NULL AND frame > 1 UNION ALL SELECT shot_id, 'motion_range' FROM j WHERE o_orderkey IS NOT NULL AND last > 4""",
    "candidate_rows": """WITH i AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s, list_sort(list(DISTINCT l_partkey) FILTER (l_returnflag <> 'N')) AS w FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS job_id, o_orderkey || ':' || o_orderpriority AS candidate_segment_id, array_to_string(s, ',') AS session_ids, coalesce(array_to_string(w, ','), '') AS work_group_ids, o_custkey::BIGINT + 1 AS duration_ms FROM orders JOIN i ON o_orderkey = l_orderkey""",
    "lenient_merge_plan": f"""WITH {_R}, d AS (SELECT *, CASE WHEN event_id % 2 <> 0 THEN 'keep' WHEN event_type = 'error' THEN 'review' ELSE 'remove' END AS decision FROM r),
n AS (SELECT *, CASE WHEN lag(ordinal) OVER w IS NULL OR decision <> 'remove' THEN 1 ELSE 0 END AS new, lead(CASE WHEN decision = 'review' THEN event_id END) OVER w AS review FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ordinal)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ordinal)::INT AS segment_no FROM n)
SELECT user_id, segment_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_ranges, coalesce(string_agg(review, ',' ORDER BY ordinal), '') AS review_ids FROM g GROUP BY user_id, segment_no""",
    "guarded_decisions": f"""WITH {_R}, n AS (SELECT *, lead(ordinal) OVER w AS nxt, value < 2 OR lead(value > 60) OVER w OR event_type = lead(event_type) OVER w AS goes_on FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ordinal)),
c AS (SELECT user_id, ordinal, CASE WHEN event_id % 5 = 0 THEN 'silent' WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 3 = 0 THEN 'other' WHEN NOT goes_on THEN 'apart' ELSE 'one' END AS what, event_id % 3 = 0 AS topic FROM n WHERE nxt IS NOT NULL)
SELECT user_id, ordinal, CASE what WHEN 'one' THEN 'remove' ELSE 'review' END AS decision,
  CASE WHEN what = 'silent' THEN 'insufficient_evidence' WHEN what = 'apart' THEN 'model_disagreement' WHEN topic THEN 'different_topic' ELSE 'same_continuous_event' END AS relationship,
  CASE what WHEN 'silent' THEN 'missing_model_row' WHEN 'other' THEN 'relationship_guard' WHEN 'apart' THEN 'continuity_guard' END AS review_reason FROM c""",
    "anchored_segments": f"""WITH {_E}, {_P}, a AS (SELECT user_id, event_id, ms * 100000000 + event_id AS at_ms FROM e WHERE event_type IN ('purchase', 'click')),
z AS (SELECT user_id, min_by(event_id, at_ms) AS first, max_by(event_id, at_ms) AS last FROM a GROUP BY user_id),
q AS (SELECT p.*, x.at_ms AS start_ms, y.at_ms AS end_ms, first, last, coalesce(lag(end_anchor) OVER w, first) AS want, lead(segment_no) OVER w AS nxt, row_number() OVER w AS no
  FROM p LEFT JOIN a x ON x.event_id = start_anchor LEFT JOIN a y ON y.event_id = end_anchor LEFT JOIN z ON z.user_id = p.user_id WHERE start_anchor % 10 <> 0 WINDOW w AS (PARTITION BY p.user_id ORDER BY segment_no))
SELECT user_id, segment_no, printf('segment_%04d', no) AS segment_id, start_ms, end_ms, CASE WHEN start_anchor <> want THEN 'gap' WHEN end_ms <= start_ms THEN 'empty_range' WHEN nxt IS NULL AND end_anchor <> last THEN 'short' END AS problem FROM q""",
    "capped_timeline": f"""WITH {_E}, s AS (SELECT user_id, min(ms) AS a, max(ms) AS b FROM e GROUP BY user_id),
c AS (SELECT user_id, ms AS t, max(value) AS score, any_value(a) AS a, any_value(b) AS b FROM e JOIN s USING (user_id) WHERE event_type = 'purchase' AND ms > a AND ms < b GROUP BY user_id, ms),
x AS (SELECT user_id, t FROM c UNION SELECT user_id, unnest([a, b]) FROM s),
y AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM x),
n AS (SELECT user_id, sum(greatest(1, ceil((nxt - t) / 86400000))) AS n FROM y WHERE nxt IS NOT NULL GROUP BY user_id),
k AS (SELECT user_id, t FROM (SELECT c.*, n, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, t) AS place FROM c JOIN n USING (user_id)) WHERE n <= 40 OR place <= greatest(0, 40 - greatest(1, ceil((b - a) / 86400000)))),
g AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM (SELECT * FROM k UNION SELECT user_id, unnest([a, b]) FROM s)),
l AS (SELECT *, greatest(1, ceil((nxt - t) / 86400000))::BIGINT AS parts FROM g WHERE nxt > t), u AS (SELECT *, unnest(range(0, parts)) AS part FROM l),
v AS (SELECT user_id, t + round_even((nxt - t) * part / parts, 0)::BIGINT AS start_ms, t + round_even((nxt - t) * (part + 1) / parts, 0)::BIGINT AS end_ms FROM u),
o AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY start_ms) - 1)::INT AS ordinal, count(*) OVER (PARTITION BY user_id) AS m FROM v)
SELECT user_id, ordinal, printf('candidate_%04d', ordinal + 1) AS candidate_segment_id, start_ms, end_ms, CASE WHEN ordinal > 0 THEN printf('boundary_%04d', ordinal) END AS left_boundary_id, CASE WHEN ordinal + 1 < m THEN printf('boundary_%04d', ordinal + 1) END AS right_boundary_id FROM o""",
    "shot_timeline": f"""WITH {_E}, h AS (SELECT DISTINCT user_id, ms // 3600000 * 3600000 AS start_ms FROM e WHERE event_type = 'purchase'),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms) AS end_ms FROM h)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start_ms)::INT AS ordinal, start_ms, end_ms FROM n WHERE end_ms IS NOT NULL""",
    "artifact_merge": """SELECT l_orderkey, min(l_returnflag || '|' || l_linestatus).split('|')[1] AS l_returnflag, min(l_returnflag || '|' || l_linestatus).split('|')[2] AS l_linestatus, count(*) AS n_copies,
  count(DISTINCT l_returnflag || '|' || l_linestatus) > 1 AS conflict FROM lineitem GROUP BY l_orderkey""",
    "group_snapshot": """SELECT o_orderkey AS media_unit_id, o_custkey AS candidate_id, CASE WHEN o_orderstatus = 'F' THEN 'wg_' || o_custkey END AS work_group_id, CASE WHEN o_orderstatus = 'F' THEN 'primary' END AS role
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "escaped_turns": """SELECT conv_id, turn, role, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM conversations""",
    "default_identities": """SELECT event_id, CASE WHEN event_type = 'error' THEN '{"type":"error"}' WHEN event_id % 3 = 0 THEN '{"bvid":"' || user_id || '","cid":"' || event_id || '"}'
  WHEN event_id % 3 = 1 THEN '{"aweme_id":"' || user_id || '"}' ELSE '{"note_id":"' || user_id || '"}' END AS identity FROM events""",
    "stream_signatures": "SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus, l_tax)) = 1 AS joinable FROM lineitem GROUP BY l_orderkey",
    "config_keys": """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}')[:16] AS cache_key FROM orders""",
    "stream_edges": r"""WITH t AS (SELECT p_partkey, p_size * 10 AS w, p_partkey % 500 AS h, list_filter(string_split_regex('gear_' || p_partkey * 37 || '_x' || p_size * 20, '[^0-9]+'), lambda x: length(x) IN (3, 4)) AS told FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND w > 0 AND h > 0 THEN least(w, h) ELSE list_min(list_transform(told, lambda x: x::INT)) END::INT AS edge FROM t""",
    "conforming_parts": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * 30 > 1280 OR p_size * 40 > 720 ELSE p_size * 40 > 1280 OR p_size * 30 > 720 END AS proxy_required,
  p_partkey % 2 <> 0 AS matches, CASE WHEN p_size <= 0 THEN 'unknown' WHEN p_partkey % 2 = 0 THEN 'rejected' ELSE 'accepted' END AS geometry FROM part""",
}
