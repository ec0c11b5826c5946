"""Timeline queries over ``events`` (and embeddings): the event stream of a user stands for a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.functions import scalars
from shotloom.operators import folds, intervals, merge, retrieval

HOUR = 3_600_000
DAY = 24 * HOUR
#: 2024-01-01T00:00:00Z, the zero of the event clock, in epoch milliseconds.
ORIGIN = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", "event_id", "event_type", "value", (F.unix_millis(F.col("ts").cast("timestamp")) - ORIGIN).alias("ms"))


def boundary_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.ranges_from_points(events(spark, sf_dir), "user_id", "ms", "event_id")
    return rows.select("user_id", "ordinal", "start_ms", "end_ms")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.ranges_from_points(events(spark, sf_dir), "user_id", "ms", "event_id")
    decision = F.when(F.col("event_type").isin("view", "click"), "remove").when(F.col("event_type") == "error", "review").otherwise("keep")
    return rows.withColumn("decision", decision)


def merge_plan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_plan(_decided(spark, sf_dir), "user_id", "event_id")


def merge_plan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.timeline_audit(merge_plan_events(spark, sf_dir), "user_id")


def scene_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("minute", F.floor(F.col("ms") / 60_000))
    best = F.max(F.struct("value", (-F.col("event_id")).alias("before"))).alias("b")
    return rows.groupBy("user_id", "minute").agg(best).select("user_id", "minute", (-F.col("b.before")).alias("event_id"), F.col("b.value").alias("value"))


def min_gap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.min_gap(events(spark, sf_dir), "user_id", "ms", "value", "event_id", 6 * HOUR)


def max_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.split_long(boundary_timeline(spark, sf_dir), 12 * HOUR).select("user_id", "ordinal", "part", "start_ms", "end_ms")


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


def semantic_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    spans = _spans(rows)
    edges = spans.select("user_id", F.explode(F.array("start_ms", "end_ms")).alias("at_ms"), F.lit(0).alias("priority"), F.lit("edge").alias("reason"))
    cuts = rows.select("user_id", F.col("ms").alias("at_ms"), F.lit(1).alias("priority"), F.lit("boundary").alias("reason"))
    steps = intervals.grid(spans, "user_id", DAY).withColumns({"priority": F.lit(2), "reason": F.lit("interval")})
    return intervals.merge_points(edges.unionByName(cuts).unionByName(steps), "user_id").select("user_id", "point_no", "at_ms", "reasons")


def evidence_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    ranges = intervals.ranges_from_points(rows, "user_id", "ms", "event_id")
    marks = ranges.select("user_id", F.col("start_ms").alias("at_ms")).withColumns({"priority": F.lit(0), "reason": F.lit("boundary")})
    inner = intervals.interior_points(ranges, "user_id", 2).withColumns({"priority": F.lit(1), "reason": F.lit("interior")})
    steps = intervals.grid(_spans(rows), "user_id", DAY).withColumns({"priority": F.lit(2), "reason": F.lit("interval")})
    merged = intervals.merge_points(marks.unionByName(inner).unionByName(steps), "user_id")
    return intervals.keep_evenly(merged, "user_id", "point_no", 81).select("user_id", "point_no", "at_ms", "reasons")


def shot_frame_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = intervals.frame_times(boundary_timeline(spark, sf_dir), 6 * HOUR, 4, 9)
    kept = frames.groupBy("user_id", "ordinal", "at_ms").agg(F.min("frame_no").alias("frame_no"))
    return kept.select("user_id", "ordinal", "frame_no", "at_ms")


def _sign_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("shiftleft(1L, 0)")).otherwise(F.lit(0).cast("long")))
    # Horner's rule in two halves, so that no step overflows.
    half = lambda a, n: F.aggregate(F.slice(a, n, 32), F.lit(0).cast("long"), lambda s, x: s * 2 + x)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.alias("bits"))
    low = half(F.col("bits"), 33)
    return rows.select("vec_id", "label", F.shiftleft(half(F.col("bits"), 1), 32).bitwiseOR(low).alias("h"))


def near_duplicate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.near_duplicates(_sign_hash(spark, sf_dir), "label", "vec_id", "h", threshold=24, lookback=3)


def hamming_pairs(spark: SparkSession, sf_dir: str, most: int = 15) -> DataFrame:
    """Pairs of one label whose sign hashes differ in at most ``most`` bits.

    Of half as many bands as ``most`` + 1 one differs in at most one bit, so one
    side is dealt out with each bit of a band turned. At 15 bits that joins a
    quarter of a label's pairs; bands of 4 bits that must agree join all of them twice.
    """
    rows = _sign_hash(spark, sf_dir)
    bands = (most + 2) // 2
    width = 64 // bands
    band = F.array(*(F.shiftrightunsigned("h", k * width).bitwiseAND((1 << width) - 1) for k in range(bands)))
    dealt = rows.select("vec_id", "label", "h", F.posexplode(band).alias("band", "part"))
    turned = F.explode(F.array(F.col("part"), *(F.col("part").bitwiseXOR(1 << k) for k in range(width))))
    other = dealt.select(F.col("vec_id").alias("other_id"), "label", F.col("h").alias("other_h"), "band", turned.alias("part"))
    pairs = dealt.join(other, ["label", "band", "part"]).where("vec_id < other_id").withColumn("distance", scalars.hamming(F.col("h"), F.col("other_h")))
    return pairs.where(F.col("distance") <= most).select("label", "vec_id", "other_id", "distance").distinct()


def aligned_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash lists of even and odd vectors of each (label, block of 50 ids), compared under shifts."""
    rows = _sign_hash(spark, sf_dir).withColumn("block", F.floor(F.col("vec_id") / 50))
    lists = lambda odd: F.transform(F.sort_array(F.collect_list(F.when(F.col("vec_id") % 2 == odd, F.struct("vec_id", "h")))), lambda x: x["h"])
    both = rows.groupBy("label", "block").agg(lists(0).alias("a"), lists(1).alias("b"))
    return both.select("label", "block", scalars.aligned_similarity(F.col("a"), F.col("b")).alias("similarity"))


def _windows(rows: DataFrame, kind: str, length: int, prefix: str) -> DataFrame:
    own = rows.where(F.col("event_type") == kind)
    return own.select("user_id", F.col("event_id").alias(f"{prefix}_id"), F.col("ms").alias(f"{prefix}_start"), (F.col("ms") + length).alias(f"{prefix}_end"), F.col("value").alias(f"{prefix}_value"))


def overlap_join_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    pairs = intervals.overlap_join(_windows(rows, "error", HOUR // 2, "l"), _windows(rows, "purchase", HOUR, "r"), "user_id", HOUR)
    return pairs.select("user_id", "l_id", "r_id")


def transcript_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    spans = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("span_id"), F.struct("ms", "event_id").alias("pos"), F.col("ms").alias("r_start"), (F.col("ms") + 45 * 60_000).alias("r_end"), F.concat(F.lit("e"), F.col("event_id")).alias("text"), F.lit("en").alias("language"))
    return retrieval.transcript_slices(merge_plan_events(spark, sf_dir), spans, "user_id", 6 * HOUR)


def closed_touch_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    points = rows.where("event_type = 'purchase'").select("user_id", "event_id", "ms")
    return intervals.touching_min(points, _windows(rows, "click", 2 * HOUR, "r"), "user_id", "ms", "r_value", 2 * HOUR)


def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    left = rows.where("event_type = 'purchase'").select("user_id", "event_id", "ms")
    right = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), "ms")
    return intervals.nearest(left, right, "user_id", "ms", "view_id")


QUERIES = {f.__name__: f for f in (boundary_timeline, merge_plan_events, merge_plan_audit, scene_dedupe, min_gap_selection, max_gap_split, semantic_anchors, evidence_timestamps, shot_frame_plan, near_duplicate_frames, hamming_pairs, aligned_similarity, overlap_join_events, transcript_slice, closed_touch_min, nearest_event)}

_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM events)"
_R = _E + """, r0 AS (SELECT *, ms AS start_ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS end_ms FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id)::INTEGER AS ordinal FROM r0 WHERE end_ms > start_ms)"""
_M = _R + """, d AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'remove' WHEN event_type = 'error' THEN 'review' ELSE 'keep' END AS decision FROM r),
i AS (SELECT *, sum(CASE WHEN ordinal = 1 OR decision <> 'remove' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)::INTEGER AS segment_no,
  lead(CASE WHEN decision = 'review' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ordinal) AS review FROM d),
m AS (SELECT user_id, segment_no, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_ranges,
  coalesce(string_agg(review::VARCHAR, ',' ORDER BY ordinal) FILTER (review IS NOT NULL), '') AS review_ids FROM i GROUP BY user_id, segment_no)"""
_H = """h AS (SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS h FROM embeddings)"""

ORACLE_SQL = {
    "boundary_timeline": f"WITH {_R} SELECT user_id, ordinal, start_ms, end_ms FROM r",
    "merge_plan_events": f"WITH {_M} SELECT * FROM m",
    "merge_plan_audit": f"""WITH {_M}, w AS (SELECT *, lag(end_ms) OVER (PARTITION BY user_id ORDER BY start_ms, segment_no) AS before, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, segment_no) AS no FROM m)
SELECT user_id, count(*) AS n_segments, count(*) FILTER (before <> start_ms) AS n_breaks, count(*) FILTER (end_ms <= start_ms) AS n_empty,
  count(*) FILTER (no <> segment_no) AS n_misnumbered, min(start_ms) AS first_ms, max(end_ms) AS last_ms, sum(end_ms - start_ms)::BIGINT AS covered_ms FROM w GROUP BY user_id""",
    "scene_dedupe": f"""WITH {_E}, k AS (SELECT user_id, ms // 60000 AS minute, event_id, value, row_number() OVER (PARTITION BY user_id, ms // 60000 ORDER BY value DESC, event_id) AS n FROM e)
SELECT user_id, minute, event_id, value FROM k WHERE n = 1""",
    "min_gap_selection": f"""WITH RECURSIVE {_E}, o AS (SELECT user_id, event_id, ms, value, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM e),
w AS (SELECT user_id, n, 1::BIGINT AS point_no, event_id, ms, value FROM o WHERE n = 1
  UNION ALL SELECT w.user_id, o.n, CASE WHEN o.ms - w.ms >= 21600000 THEN point_no + 1 ELSE point_no END,
    CASE WHEN o.ms - w.ms >= 21600000 OR o.value > w.value THEN o.event_id ELSE w.event_id END,
    CASE WHEN o.ms - w.ms >= 21600000 OR o.value > w.value THEN o.ms ELSE w.ms END,
    CASE WHEN o.ms - w.ms >= 21600000 OR o.value > w.value THEN o.value ELSE w.value END
  FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1),
z AS (SELECT *, row_number() OVER (PARTITION BY user_id, point_no ORDER BY n DESC) AS k FROM w)
SELECT user_id, point_no, event_id, ms, value FROM z WHERE k = 1""",
    "max_gap_split": f"""WITH {_R}, p AS (SELECT user_id, ordinal, start_ms, end_ms, greatest(1, ceil((end_ms - start_ms) / 43200000))::BIGINT AS parts FROM r),
x AS (SELECT *, unnest(range(0, parts)) AS part FROM p)
SELECT user_id, ordinal, part, start_ms + round_even((end_ms - start_ms) * part / parts, 0)::BIGINT AS start_ms,
  start_ms + round_even((end_ms - start_ms) * (part + 1) / parts, 0)::BIGINT AS end_ms FROM x""",
    "semantic_anchors": f"""WITH {_E}, s AS (SELECT user_id, min(ms) AS a, max(ms) AS b FROM e GROUP BY user_id),
g AS (SELECT user_id, unnest([a, b]) AS at_ms, 0 AS p, 'edge' AS reason FROM s UNION SELECT user_id, ms, 1, 'boundary' FROM e
  UNION SELECT user_id, unnest(range((ceil(a / 86400000) * 86400000)::BIGINT, b + 1, 86400000)), 2, 'interval' FROM s),
k AS (SELECT user_id, at_ms, string_agg(reason, '+' ORDER BY p) AS reasons FROM g GROUP BY user_id, at_ms)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY at_ms)::INTEGER AS point_no, at_ms, reasons FROM k""",
    "evidence_timestamps": f"""WITH {_R}, s AS (SELECT user_id, min(ms) AS a, max(ms) AS b FROM e GROUP BY user_id),
g AS (SELECT user_id, start_ms AS at_ms, 0 AS p, 'boundary' AS reason FROM r
  UNION SELECT user_id, start_ms + round_even((end_ms - start_ms) * k / 3, 0)::BIGINT, 1, 'interior' FROM (SELECT *, unnest([1, 2]) AS k FROM r)
  UNION SELECT user_id, unnest(range((ceil(a / 86400000) * 86400000)::BIGINT, b + 1, 86400000)), 2, 'interval' FROM s),
k AS (SELECT user_id, at_ms, string_agg(reason, '+' ORDER BY p) AS reasons FROM g GROUP BY user_id, at_ms),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ms)::INTEGER AS point_no, count(*) OVER (PARTITION BY user_id) AS n FROM k),
u AS (SELECT DISTINCT user_id, n FROM n), pick AS (SELECT user_id, round_even(i * (n - 1) / 80, 0)::INTEGER + 1 AS point_no FROM (SELECT *, unnest(range(0, 81)) AS i FROM u WHERE n > 81))
SELECT user_id, point_no, at_ms, reasons FROM n WHERE n <= 81 OR (user_id, point_no) IN (SELECT (user_id, point_no) FROM pick)""",
    "shot_frame_plan": f"""WITH {_R}, n AS (SELECT *, least(9, greatest(4, ceil((end_ms - start_ms) / 21600000)))::INTEGER AS n FROM r), x AS (SELECT *, unnest(range(0, n))::INTEGER AS frame_no FROM n),
t AS (SELECT user_id, ordinal, frame_no, least(greatest(start_ms + round_even((end_ms - start_ms) * (frame_no + 0.5::DOUBLE) / n, 0)::BIGINT, start_ms), end_ms - 1) AS at_ms FROM x)
SELECT user_id, ordinal, min(frame_no) AS frame_no, at_ms FROM t GROUP BY user_id, ordinal, at_ms""",
    "near_duplicate_frames": f"""WITH RECURSIVE {_H}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM h),
w AS (SELECT label, vec_id, n, true AS kept, NULL::BIGINT AS near_id, NULL::INTEGER AS distance, [struct_pack(id := vec_id, h := h)] AS recent FROM o WHERE n = 1
  UNION ALL SELECT label, vec_id, n, best IS NULL, best.id, best.d, CASE WHEN best IS NULL THEN list_concat([struct_pack(id := vec_id, h := h)], recent)[1:3] ELSE recent END
  FROM (SELECT o.label, o.vec_id, o.n, o.h, w.recent, list_filter(list_transform(w.recent, lambda x: struct_pack(d := hamming(x.h, o.h)::INTEGER, id := x.id)), lambda x: x.d <= 24)[1] AS best
    FROM w JOIN o ON o.label = w.label AND o.n = w.n + 1))
SELECT label, vec_id, kept, near_id, distance FROM w""",
    "hamming_pairs": f"WITH {_H} SELECT a.label, a.vec_id, b.vec_id AS other_id, hamming(a.h, b.h)::INTEGER AS distance FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id WHERE hamming(a.h, b.h) <= 15",
    "aligned_similarity": f"""WITH {_H}, o AS (SELECT label, vec_id // 50 AS block, vec_id % 2 AS odd, h, row_number() OVER (PARTITION BY label, vec_id // 50, vec_id % 2 ORDER BY vec_id) AS i FROM h),
g AS (SELECT DISTINCT label, block FROM o), s AS (SELECT *, unnest(range(-4, 5)) AS shift FROM g),
p AS (SELECT s.label, s.block, s.shift, 1 - sum(hamming(a.h, b.h)) / (count(*) * 64) AS v FROM s JOIN o a ON a.label = s.label AND a.block = s.block AND a.odd = 0
  JOIN o b ON b.label = s.label AND b.block = s.block AND b.odd = 1 AND a.i - b.i = s.shift GROUP BY ALL)
SELECT label, block, coalesce(max(v), 0.0) AS similarity FROM g LEFT JOIN p USING (label, block) GROUP BY label, block""",
    "overlap_join_events": f"""WITH {_E} SELECT a.user_id, a.event_id AS l_id, b.event_id AS r_id FROM e a JOIN e b ON a.user_id = b.user_id
WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND a.ms < b.ms + 3600000 AND b.ms < a.ms + 1800000""",
    "transcript_slice": f"""WITH {_M}, c AS (SELECT *, ms AS a, ms + 2700000 AS b FROM e WHERE event_type = 'click')
SELECT m.user_id, segment_no, count(*) AS n_spans, count(*) FILTER (a < start_ms OR b > end_ms) AS n_clipped, string_agg('e' || event_id, ' ' ORDER BY ms, event_id) AS text,
  string_agg(event_id::VARCHAR, ',' ORDER BY ms, event_id) AS span_ids, 'en' AS language FROM m JOIN c ON m.user_id = c.user_id AND start_ms < b AND a < end_ms GROUP BY m.user_id, segment_no""",
    "closed_touch_min": f"""WITH {_E} SELECT p.user_id, p.event_id, p.ms, coalesce(min(c.value), 0.0) AS least FROM e p LEFT JOIN e c ON c.event_type = 'click' AND c.user_id = p.user_id AND p.ms BETWEEN c.ms AND c.ms + 7200000
WHERE p.event_type = 'purchase' GROUP BY p.user_id, p.event_id, p.ms""",
    "nearest_event": f"""WITH {_E}, k AS (SELECT p.user_id, p.event_id, p.ms, v.event_id AS near_id, v.ms AS near_ms, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(v.ms - p.ms), v.event_id) AS n
FROM e p LEFT JOIN e v ON v.user_id = p.user_id AND v.event_type = 'view' WHERE p.event_type = 'purchase') SELECT user_id, event_id, ms, near_id, near_ms FROM k WHERE n = 1""",
}
