"""Queries of frame motion, near titles, and of operators that walk rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotloom.functions import canonical, scalars
from shotloom.operators import entity, handover, intervals, merge, motion, planning, rounds, spanning
from shotloom.plans.timelines import DAY, HOUR, events, table
from shotloom.session import fresh_dir, tasks_for, written
from shotloom.sources import readers
from shotloom.streaming import leases


def frame_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey pictures of 8 by 8: which shift makes a label's vector most like the next one."""
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 320 + 128).cast("int"))))
    frames = table(spark, sf_dir, "embeddings").select("label", "vec_id", grey.alias("pixels"))
    pairs = motion.consecutive(frames, "label", "vec_id", "pixels")
    at = motion.FrameGeometry(8, 8, 1, 1, 3, 3, 2)
    found = motion.pair_measures(pairs, ["label", "vec_id"], "left", "right", at)
    return found.select("label", "vec_id", "dx", "dy", F.round("identity", 6).alias("identity"), F.round("improvement", 6).alias("improvement"))


def _part_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as units: the brand is the author, the type the platform, the size the duration."""
    return table(spark, sf_dir, "part")


def near_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts that the cross-post rule suspects of being one work, with the ratio of their titles."""
    classes = entity.crosspost_classes(_part_units(spark, sf_dir), "p_partkey", "p_type", "p_brand", "p_name", "p_size")
    pairs = entity.crosspost_pairs(classes)
    return pairs.select("l_first", "r_last", "l_n_units", "r_n_units", F.round("title_ratio", 6).alias("title_ratio"))


def near_title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that links of suspected pairs connect, and their roles."""
    groups = entity.crosspost_groups(_part_units(spark, sf_dir), "p_partkey", "p_type", "p_brand", "p_name", "p_size")
    return groups.select("group_id", F.col("node").alias("part_id"), "role", "fallback_order")


def _boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's ranges between events as candidates c<event>, each beginning at boundary b<event>."""
    rows = intervals.ranges_from_points(events(spark, sf_dir), "user_id", "ms", "event_id")
    order = Window.partitionBy("user_id").orderBy("ordinal")
    mark = F.concat(F.lit("b"), F.col("event_id"))
    left = F.when(F.col("ordinal") > 1, mark)
    decision = F.when(F.col("event_type").isin("view", "click"), "remove").when(F.col("event_type") == "error", "review").otherwise("keep")
    return rows.select("user_id", F.col("user_id").cast("string").alias("job_id"), "event_id", "event_type", "ordinal", "start_ms", "end_ms", F.concat(F.lit("c"), F.col("event_id")).alias("candidate_id"), left.alias("left_boundary"), F.lead(left).over(order).alias("right_boundary"), decision.alias("decision"))


def merge_plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge plans of all users, in which every second user has one fault (by user_id % 20), held against all rules."""
    rows = _boundaries(spark, sf_dir).withColumn("fault", F.col("user_id") % 20)
    order = Window.partitionBy("job_id").orderBy("ordinal")
    parts = (F.col("ordinal") == 1) | (F.col("decision") != "remove")
    grouped = rows.withColumn("no", (F.sum(parts.cast("int")).over(order) - 1).cast("int")).withColumn("next", F.lead("decision").over(order))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ordinal", c))), lambda x: x[c])
    inner = F.when((F.row_number().over(Window.partitionBy("job_id", "no").orderBy("ordinal")) > 1), F.col("left_boundary"))
    grouped = grouped.withColumns({"merged": inner, "review": F.when(F.col("next") == "review", F.col("right_boundary"))})
    plans = grouped.groupBy("job_id", "fault", "no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), listed("candidate_id").alias("candidate_ids"), F.filter(listed("merged"), lambda x: x.isNotNull()).alias("removed_ids"), F.filter(listed("review"), lambda x: x.isNotNull()).alias("review_ids"))
    at = lambda fault: (F.col("fault") == fault) & (F.col("no") == 1)
    none = F.array().cast("array<string>")
    finals = plans.where(F.col("fault") != 1).select(
        "job_id",
        F.when(at(2), 7000).otherwise(F.col("no")).alias("ordinal"),
        (F.col("start_ms") + F.when(at(3), 1).otherwise(0)).alias("start_ms"),
        (F.col("end_ms") - F.when(at(4), 1).otherwise(0)).alias("end_ms"),
        F.when(at(5), F.reverse("candidate_ids")).otherwise(F.col("candidate_ids")).alias("candidate_ids"),
        F.when(at(6), none).otherwise(F.col("removed_ids")).alias("removed_ids"),
        F.when(at(7), none).when(at(8), F.array(F.lit("b0"))).otherwise(F.col("review_ids")).alias("review_ids"),
    )
    decisions = rows.where("left_boundary is not null").select("job_id", "fault", F.col("left_boundary").alias("boundary_id"), F.when((F.col("fault") == 9) & (F.col("event_id") % 5 == 0), "keep").otherwise(F.col("decision")).alias("decision"))
    twice = decisions.where(F.col("fault") == 10).where(F.col("boundary_id").endswith("7"))
    decisions = decisions.where(~((F.col("fault") == 11) & F.col("boundary_id").endswith("7"))).unionAll(twice).unionAll(twice.withColumn("boundary_id", F.concat(F.col("boundary_id"), F.lit("x"))))
    spans = rows.groupBy("job_id", "fault").agg(F.max("end_ms").alias("end_ms")).select("job_id", (F.col("end_ms") + F.when(F.col("fault") == 12, 1).otherwise(0)).alias("duration_ms"))
    # plans begin at the user's first event, so that it stands for zero
    first = rows.groupBy("job_id").agg(F.min("start_ms").alias("zero"))
    moved = lambda df, *cs: df.join(first, "job_id").withColumns({c: F.col(c) - F.col("zero") for c in cs}).drop("zero")
    candidates = rows.select("job_id", "ordinal", "candidate_id", "start_ms", "end_ms", "left_boundary", "right_boundary")
    found = merge.merge_plan_problems(moved(finals, "start_ms", "end_ms"), moved(candidates, "start_ms", "end_ms"), decisions.drop("fault"), moved(spans, "duration_ms"))
    return found.select(F.col("job_id").cast("long").alias("user_id"), "ordinal", "problem")


def scene_point_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene points of users at least six hours from each other and from both ends."""
    rows = events(spark, sf_dir)
    first = rows.groupBy("user_id").agg(F.min("ms").alias("zero"), (F.max("ms") - F.min("ms")).alias("duration"))
    points = rows.join(first.select("user_id", "zero"), "user_id").select("user_id", "event_id", "value", (F.col("ms") - F.col("zero")).alias("at"))
    out = spanning.scene_points(points, first, "user_id", "at", "value", "event_id", "duration", 6 * HOUR)
    return out.select("user_id", F.col("number").alias("point_no"), "event_id", F.col("at").alias("at_ms"), "value")


def planned_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as plans: events of the first days were asked in two rounds, some of the rest are asked next; the next round or what is wrong."""
    rows = events(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "event_id")
    rows = rows.select(F.col("user_id").cast("string").alias("plan"), "user_id", "event_id", "event_type", "value", "ms", F.when(F.col("event_id") % 2 == 0, "youtube").otherwise("tiktok").alias("platform"), F.concat(F.lit("About "), F.col("k")).alias("text"))
    facets = F.array_sort(F.collect_set("event_type")).alias("facets")
    plans = rows.groupBy("plan", "user_id").agg(facets).select("plan", F.array(F.lit("youtube"), F.lit("tiktok")).alias("platforms"), "facets", (2 + F.col("user_id") % 4).cast("int").alias("max_rounds"), (F.col("user_id") % 30).alias("max_videos"))
    before = rows.where(F.col("ms") < 10 * DAY)
    asked = before.select("plan", F.when(F.col("ms") < 5 * DAY, 1).otherwise(2).alias("round_number"), rounds.query_key(F.col("platform"), F.col("text")).alias("query_key")).distinct()
    told = before.where(~((F.col("user_id") % 7 == 0) & (F.col("event_id") % 3 == 0))).groupBy("plan").agg(F.collect_set(F.concat("platform", F.lit(":ABOUT  "), F.substring("text", 7, 20))).alias("history"))
    judged = rows.groupBy("plan", "user_id").agg(facets, F.count_if(F.col("event_type") == "purchase").alias("occupied")).join(told, "plan", "left")
    said = F.transform(F.when(F.col("user_id") % 5 == 0, F.slice("facets", 2, 10)).otherwise(F.col("facets")), lambda f: F.struct(f.alias("facet_id"), F.lit("missing").alias("status"), F.lit("not shown").alias("reason")))
    gap = F.struct(F.lit("g").alias("gap_id"), F.lit("lacks").alias("description"), F.when(F.col("user_id") % 11 == 0, F.array(F.lit("none"))).otherwise(F.slice("facets", 1, 1)).alias("facet_ids"))
    decisions = judged.select("plan", F.lit(2).alias("round_number"), F.when(F.col("user_id") % 13 == 0, "covered").otherwise("insufficient").alias("status"), "occupied", F.coalesce("history", F.array().cast("array<string>")).alias("history"), said.alias("assessments"), F.array(gap).alias("gaps"))
    later = rows.where((F.col("ms") >= 10 * DAY) & (F.col("value") > 70))
    queries = later.select("plan", F.when((F.col("user_id") % 17 == 0), F.lit("q")).otherwise(F.col("event_id").cast("string")).alias("query_id"), "platform", F.when(F.col("value") > 97, "de").otherwise("en").alias("language"), "text", F.array("event_type").alias("facet_ids"), F.floor("value").cast("int").alias("budget"))
    known = spark.createDataFrame([(1,), (2,)], "round_number int")
    held = plans.crossJoin(F.broadcast(known)).select("plan", "round_number")  # two rounds of every plan
    problems = written(rounds.round_problems(plans, held, asked, decisions, queries), "problems")
    good = rounds.next_rounds(plans, decisions, problems)
    out = good.select("plan", F.lit("planned").alias("outcome"), "round_number", "remaining_rounds", "remaining_slots", "round_limit")
    bad = problems.select("plan", F.col("problem").alias("outcome"), *(F.lit(None).cast("long").alias(c) for c in ("round_number", "remaining_rounds", "remaining_slots", "round_limit")))
    return out.withColumn("round_number", F.col("round_number").cast("long")).unionByName(bad).withColumnRenamed("plan", "user_id").withColumn("user_id", F.col("user_id").cast("long"))


def handed_over_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' ranges as results of a job, held against anchors that are off or absent for some kinds of events."""
    rows = _boundaries(spark, sf_dir)
    following = F.lead("event_id").over(Window.partitionBy("job_id").orderBy("ordinal"))
    rows = rows.withColumns({"next_id": following, "zero": F.min("start_ms").over(Window.partitionBy("job_id"))})
    segments = rows.where("event_id % 41 <> 0").select("job_id", "ordinal", F.concat(F.lit("s"), F.col("event_id") % 1000).alias("segment_id"), (F.col("start_ms") - F.col("zero")).alias("start_ms"), (F.col("end_ms") - F.col("zero")).alias("end_ms"), F.col("event_id").cast("string").alias("start_anchor"), F.col("next_id").cast("string").alias("end_anchor"), F.array("event_type", F.lit("proxy")).alias("refs"))
    anchors = rows.where("event_type <> 'purchase'").select("job_id", F.col("event_id").cast("string").alias("anchor_id"), (F.col("start_ms") - F.col("zero") + F.when(F.col("event_type") == "error", 51).otherwise(50)).alias("at_ms"))
    evidence = rows.where("not (event_type = 'view' and user_id % 3 = 0)").select("job_id", F.col("event_type").alias("evidence_id")).unionAll(rows.select("job_id", F.lit("proxy")))
    jobs = rows.groupBy("job_id", "user_id", "zero").agg(F.max("end_ms").alias("end_ms"))
    request = [F.lit("r").alias("request_id"), F.lit("h").alias("request_hash"), F.lit("c").alias("context_hash"), F.lit("a").alias("attempt_id")]
    requests = jobs.select("job_id", *request, (F.col("end_ms") - F.col("zero")).alias("duration_ms"))
    results = jobs.select("job_id", *request[:2], F.when(F.col("user_id") % 9 == 0, "other").otherwise("c").alias("context_hash"), request[3])
    found = handover.result_problems(requests, results, segments, anchors, evidence)
    return found.select(F.col("job_id").cast("long").alias("user_id"), "segment_id", "problem")


def request_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its evidence: at most five of them, as long as they cost at most 100 together."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("cost"))
    out = handover.evidence_prefix(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "cost"], F.lit(5), "cost", F.lit(100))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "position", "spent")


def attempt_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as attempts, each on the one before unless its status is F; the chain's first and what is wrong with it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("before"), "o_orderstatus")
    chain = rows.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", F.col("before")).when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).alias("prior"))
    out = handover.attempt_chains(chain, "o_orderkey", "prior")
    return out.select(F.col("attempt").alias("o_orderkey"), F.col("first").alias("first_key"), "place", "problem")


def followed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a job's events, followed until an end was told twice."""
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "succeeded").otherwise("running")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("event_id"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return leases.followed(rows).select("job_id", "event", "seen", "state", "event_id")


def lease_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as heartbeats of a lease of twelve hours."""
    beats = events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("owner"), F.col("ms").alias("at_ms"))
    return leases.lease_events(beats, 12 * HOUR).withColumnsRenamed({"key": "user_id", "owner": "event_id"})


def canonical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of orders with a nested object, its digest and the id that it freezes."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.struct(F.col("o_orderstatus").alias("state"), F.array("o_orderpriority", F.lit('say "x"\n')).alias("notes")).alias("Body"))
    return rows.select("o_orderkey", canonical.row_json(rows).alias("document"), canonical.content_hash(rows).alias("content_hash"), canonical.frozen_id(rows, "vmw").alias("workflow_id"))


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events written as files of JSON lines, a blank line after each purchase, and read back in their order.

    A file holds the lines of many users, user after user, so that files grow in number with the events, not with the users.
    """
    rows = events(spark, sf_dir)
    text = F.concat(F.to_json(F.struct("user_id", "event_id")), F.when(F.col("event_type") == "purchase", "\n").otherwise(""))
    path = fresh_dir(spark, "lines")
    rows = rows.select("user_id", "event_id", text.alias("text")).repartition(tasks_for(spark, rows.count()), "user_id")
    rows.sortWithinPartitions("user_id", "event_id").select("text").write.text(path)
    read = readers.read_ordered_json_lines(spark, path, "user_id long, event_id long")
    own = Window.partitionBy("file", "user_id")
    return read.select("user_id", "event_id", *((F.col(c) - F.min(c).over(own) + 1).alias(c) for c in ("line_no", "ordinal")))


def admitted_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as plans that admit documents in turn; a length that one has taken is out of the others."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    out = planning.admit_in_order(rows, ["en", "de", "fr", "es"], "lang", "source", "n_chars", [F.desc("n_chars"), F.asc("doc_id")], 30)
    return out.select("lang", "source", "doc_id", "place")


def identity_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of works: addresses, ids, clocks and ratios, as far as they are in order."""
    rows = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    host = F.when(n % 4 == 0, "m.BiliBili.com").when(n % 4 == 1, "www.douyin.com:443").when(n % 4 == 2, "user@bilibili.com").otherwise("notbilibili.com")
    url = F.concat(F.when(n % 9 == 0, "http").otherwise("https"), F.lit("://"), host, F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("/video/BV1"), F.lpad(n.cast("string"), 9, "0"))), F.lit("?from=x#top"))
    size = F.concat((n % 40).cast("string"), F.when(n % 3 == 0, ":").otherwise("/"), (n % 30).cast("string"))
    name = F.concat(F.col("o_orderstatus"), F.when(n % 6 == 0, "/").otherwise("-"), n)
    work = F.concat(F.lit("https://x/"), F.when(n % 2 == 0, "video/").otherwise("user/"), n + 10_000_000)
    note = F.lpad(F.lower(F.hex(n)), 24, "a")
    return rows.select(
        "o_orderkey",
        scalars.source_url(url, "bilibili").alias("page_url"),
        scalars.work_id("bilibili", url).alias("video_id"),
        scalars.work_id("douyin", work).alias("work_id"),
        scalars.work_id("xiaohongshu", F.when(n % 2 == 0, note).otherwise(F.concat(F.lit("https://x/explore/"), F.upper(note), F.lit("?a")))).alias("note_id"),
        scalars.safe_id(name).alias("safe"),
        scalars.epoch_iso(n * 1000 - 5_000_000).alias("published_at"),
        scalars.ratio(size).alias("ratio"),
        scalars.rational(size).alias("rational"),
        scalars.span_ms(F.when(n % 2 == 0, n), n / 8000).alias("span_ms"),
        scalars.ms_seconds(n - 100).alias("seconds"),
    )


_NAMES = (frame_shifts, near_title_pairs, near_title_groups, merge_plan_check, scene_point_selection, planned_rounds, handed_over_results, request_evidence, attempt_chains, followed_jobs, lease_history, canonical_orders, ordered_lines, admitted_in_order, identity_scalars)
QUERIES = {f.__name__: f for f in _NAMES}

_SHIFTS = """v AS (SELECT label, vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 320 + 128)::INTEGER))) AS a FROM embeddings),
p AS (SELECT *, lead(a) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v),
g AS (SELECT x, y, dx, dy, (y - 1) // 3 * 2 + (x - 1) // 3 AS tile, (y - dy) * 8 + x - dx + 1 AS i, y * 8 + x + 1 AS j
  FROM range(1, 7) gx(x), range(1, 7) gy(y), range(-2, 3) sx(dx), range(-2, 3) sy(dy) WHERE x - dx BETWEEN 1 AND 6 AND y - dy BETWEEN 1 AND 6),
t AS (SELECT label, vec_id, dx, dy, tile, sum(abs(a[i] - b[j])) / count(*) AS m FROM p, g WHERE b IS NOT NULL GROUP BY ALL),
l AS (SELECT label, vec_id, dx, dy, list_sort(list(m)) AS m FROM t GROUP BY ALL),
s AS (SELECT label, vec_id, dx, dy, (m[(len(m) + 1) // 2] + m[len(m) // 2 + 1]) / 2 / 255 AS score FROM l),
o AS (SELECT *, max(score) FILTER (dx = 0 AND dy = 0) OVER (PARTITION BY vec_id) AS own, row_number() OVER (PARTITION BY vec_id ORDER BY score, dy, dx) AS k FROM s)
SELECT label, vec_id, CASE WHEN score < own THEN dx / 8 ELSE 0.0 END AS dx, CASE WHEN score < own THEN dy / 8 ELSE 0.0 END AS dy, round(own, 6) AS identity,
  round(greatest(0, least(1, (own - least(score, own)) / greatest(own, 1e-6))), 6) AS improvement FROM o WHERE k = 1"""

# The ratio of matching blocks by recursion: the longest common substring (the first of equals in the left,
# then in the right title), then what lies before and behind it.
_NEAR = r"""u AS (SELECT p_partkey AS unit, p_type AS platform, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS author, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS title, p_size::DOUBLE AS duration
  FROM part WHERE p_type IS NOT NULL AND p_size IS NOT NULL),
c AS (SELECT platform, author, title, duration, min(unit) AS first, max(unit) AS last, count(*) AS n FROM u WHERE author <> '' AND title <> '' GROUP BY ALL),
d AS (SELECT l.author, l.platform AS l_platform, l.title AS l_title, l.duration AS l_duration, l.first AS l_first, l.n AS l_n_units,
    r.platform AS r_platform, r.title AS r_title, r.duration AS r_duration, r.last AS r_last, r.n AS r_n_units FROM c l JOIN c r ON l.author = r.author
  WHERE l.platform <> r.platform AND l.first < r.last AND abs(l.duration - r.duration) <= greatest(2.0, 0.05 * greatest(l.duration, r.duration))),
b(l_title, r_title, a, b, size) AS (SELECT DISTINCT l_title, r_title, l_title, r_title, 0::BIGINT FROM d
  UNION ALL SELECT l_title, r_title, unnest([substr(a, 1, m.i - 1), substr(a, m.i + m.n)]), unnest([substr(b, 1, m.j - 1), substr(b, m.j + m.n)]), unnest([m.n, 0]) FROM (
    SELECT *, list_sort(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda n:
      {'k': -n, 'i': i, 'j': instr(b, substr(a, i, n)), 'n': n}))), lambda x: x.j > 0))[1] AS m FROM b WHERE a <> '' AND b <> '') WHERE m IS NOT NULL),
q AS (SELECT l_title, r_title, 2.0 * sum(size) / (length(l_title) + length(r_title)) AS title_ratio FROM b GROUP BY l_title, r_title),
e AS (SELECT d.*, title_ratio FROM d JOIN q USING (l_title, r_title) WHERE title_ratio >= 0.72)"""

_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM events)"
_C = _E + """, r0 AS (SELECT *, ms AS start_ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS end_ms FROM e),
r1 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id)::INTEGER AS ordinal FROM r0 WHERE end_ms > start_ms),
r2 AS (SELECT *, CASE WHEN ordinal > 1 THEN 'b' || event_id END AS left_boundary, 'c' || event_id AS candidate_id, CASE WHEN event_type IN ('view', 'click') THEN 'remove' WHEN event_type = 'error' THEN 'review' ELSE 'keep' END AS decision FROM r1),
c AS (SELECT *, lead(left_boundary) OVER (PARTITION BY user_id ORDER BY ordinal) AS right_boundary FROM r2)"""


def _turn(lang: str, before: tuple[str, ...]) -> str:
    """One plan's round robin as a common table expression, without what the plans before it have taken."""
    taken = "".join(f" AND n_chars NOT IN (SELECT n_chars FROM {name})" for name in before)
    return f"""{lang}_t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS turn FROM documents WHERE lang = '{lang}'{taken}),
{lang} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY turn, source)::INTEGER AS place FROM {lang}_t) WHERE place <= 30)"""


ORACLE_SQL = {
    "frame_shifts": f"WITH {_SHIFTS}",
    "near_title_pairs": f"WITH RECURSIVE {_NEAR} SELECT l_first, r_last, l_n_units, r_n_units, round(title_ratio, 6) AS title_ratio FROM e",
    "near_title_groups": f"""WITH RECURSIVE {_NEAR},
w AS (SELECT l.unit AS src, r.unit AS dst FROM e JOIN u l ON l.author = e.author AND l.platform = l_platform AND l.title = l_title AND l.duration = l_duration
  JOIN u r ON r.author = e.author AND r.platform = r_platform AND r.title = r_title AND r.duration = r_duration WHERE l.unit < r.unit),
z AS (SELECT src, dst FROM w UNION SELECT dst, src FROM w),
h(node, root) AS (SELECT DISTINCT src, src FROM z UNION SELECT z.dst, h.root FROM h JOIN z ON z.src = h.node AND h.root < z.dst),
k AS (SELECT node, min(root) AS comp FROM h GROUP BY node),
n AS (SELECT comp, 'work_' || substr(sha256(string_agg(node::VARCHAR, chr(0) ORDER BY node)), 1, 24) AS group_id FROM k GROUP BY comp),
r AS (SELECT k.*, n.group_id, (row_number() OVER (PARTITION BY k.comp ORDER BY node) - 1)::INTEGER AS fallback_order FROM k JOIN n USING (comp))
SELECT group_id, node AS part_id, CASE WHEN fallback_order = 0 THEN 'primary' ELSE 'fallback' END AS role, fallback_order FROM r""",
    "scene_point_selection": f"""WITH RECURSIVE {_E}, z AS (SELECT user_id, min(ms) AS zero, max(ms) - min(ms) AS d FROM e GROUP BY user_id),
o AS (SELECT user_id, event_id, value, ms - zero AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, value DESC, event_id) AS n FROM e JOIN z USING (user_id)
  WHERE ms - zero BETWEEN 21600000 AND d - 21600000),
w AS (SELECT user_id, n, 1::BIGINT AS point_no, event_id, at_ms, value FROM o WHERE n = 1
  UNION ALL SELECT w.user_id, o.n, CASE WHEN o.at_ms - w.at_ms >= 21600000 THEN point_no + 1 ELSE point_no END,
    CASE WHEN o.at_ms - w.at_ms >= 21600000 OR o.value > w.value THEN o.event_id ELSE w.event_id END,
    CASE WHEN o.at_ms - w.at_ms >= 21600000 OR o.value > w.value THEN o.at_ms ELSE w.at_ms END,
    CASE WHEN o.at_ms - w.at_ms >= 21600000 OR o.value > w.value THEN o.value ELSE w.value END
  FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, point_no ORDER BY n DESC) AS k FROM w) SELECT user_id, point_no, event_id, at_ms, value FROM k WHERE k = 1""",
    "merge_plan_check": f"""WITH {_C}, d0 AS (SELECT *, user_id % 20 AS fault FROM c),
g AS (SELECT *, sum(CASE WHEN ordinal = 1 OR decision <> 'remove' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ordinal)::INTEGER - 1 AS no, lead(decision) OVER (PARTITION BY user_id ORDER BY ordinal) AS next FROM d0),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id, no ORDER BY ordinal) AS k FROM g),
p AS (SELECT user_id, fault, no, min(start_ms) AS a, max(end_ms) AS b, list(candidate_id ORDER BY ordinal) AS cs, coalesce(list(left_boundary ORDER BY ordinal) FILTER (k > 1), []) AS rs,
    coalesce(list(right_boundary ORDER BY ordinal) FILTER (next = 'review'), []) AS vs FROM h GROUP BY ALL),
f AS (SELECT user_id, CASE WHEN fault = 2 AND no = 1 THEN 7000 ELSE no END AS ordinal, a + CASE WHEN fault = 3 AND no = 1 THEN 1 ELSE 0 END AS a, b - CASE WHEN fault = 4 AND no = 1 THEN 1 ELSE 0 END AS b,
    CASE WHEN fault = 5 AND no = 1 THEN list_reverse(cs) ELSE cs END AS cs, CASE WHEN fault = 6 AND no = 1 THEN [] ELSE rs END AS rs,
    CASE WHEN fault = 7 AND no = 1 THEN [] WHEN fault = 8 AND no = 1 THEN ['b0'] ELSE vs END AS vs FROM p WHERE fault <> 1),
dd AS (SELECT user_id, fault, left_boundary AS id, CASE WHEN fault = 9 AND event_id % 5 = 0 THEN 'keep' ELSE decision END AS decision FROM d0 WHERE left_boundary IS NOT NULL),
dt AS (SELECT user_id, id, decision FROM dd WHERE NOT (fault = 11 AND id LIKE '%7') UNION ALL SELECT user_id, id, decision FROM dd WHERE fault = 10 AND id LIKE '%7'
  UNION ALL SELECT user_id, id || 'x', decision FROM dd WHERE fault = 10 AND id LIKE '%7'),
dn AS (SELECT user_id, id, count(*) AS n, min(decision) AS decision FROM dt GROUP BY ALL),
i AS (SELECT user_id, right_boundary AS id, ordinal AS at_ms FROM c WHERE right_boundary IS NOT NULL),
t AS (SELECT coalesce(i.user_id, dn.user_id) AS user_id, coalesce(i.id, dn.id) AS id, n, decision, at_ms FROM i FULL JOIN dn ON i.user_id = dn.user_id AND i.id = dn.id),
s AS (SELECT user_id, min(start_ms) AS zero, max(end_ms) + CASE WHEN user_id % 20 = 12 THEN 1 ELSE 0 END AS z FROM c GROUP BY user_id),
o AS (SELECT f.*, s.z, lag(b, 1, s.zero) OVER w AS before, row_number() OVER w - 1 AS place, lead(ordinal) OVER w AS next FROM f JOIN s USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY ordinal)),
m0 AS (SELECT user_id, ordinal, unnest(cs) AS candidate_id, generate_subscripts(cs, 1) AS pos FROM f),
m AS (SELECT m0.*, c.start_ms AS ca, c.end_ms AS cb, c.right_boundary AS r, lead(pos) OVER w AS np, lead(c.start_ms) OVER w AS na, lead(c.left_boundary) OVER w AS nl
  FROM m0 LEFT JOIN c ON c.user_id = m0.user_id AND c.candidate_id = m0.candidate_id WINDOW w AS (PARTITION BY m0.user_id, m0.ordinal ORDER BY pos)),
ed AS (SELECT m.*, dn.decision FROM m LEFT JOIN dn ON dn.user_id = m.user_id AND dn.id = m.r WHERE np IS NOT NULL),
l AS (SELECT user_id, ordinal, unnest(rs) AS id, generate_subscripts(rs, 1) AS pos FROM f), v AS (SELECT user_id, ordinal, unnest(vs) AS id, generate_subscripts(vs, 1) AS pos FROM f),
x AS (SELECT user_id, candidate_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ordinal, pos) AS no, 'candidates' AS kind FROM m0
  UNION ALL SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ordinal, pos), 'removed_account' FROM l UNION ALL SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY ordinal, pos), 'review_account' FROM v),
y AS (SELECT user_id, candidate_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ordinal) AS no, 'candidates' AS kind FROM c
  UNION ALL SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY at_ms), 'removed_account' FROM t WHERE decision = 'remove' AND at_ms IS NOT NULL
  UNION ALL SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY at_ms), 'review_account' FROM t WHERE decision = 'review' AND at_ms IS NOT NULL),
yy AS (SELECT * FROM y WHERE user_id IN (SELECT user_id FROM f)),
q AS (SELECT user_id, NULL::INTEGER AS ordinal, 'duplicate_decision' AS problem FROM t WHERE n > 1 UNION SELECT user_id, NULL, 'unknown_decision' FROM t WHERE at_ms IS NULL UNION SELECT user_id, NULL, 'missing_decision' FROM t WHERE n IS NULL
  UNION SELECT user_id, NULL, 'no_segments' FROM s WHERE user_id NOT IN (SELECT user_id FROM f)
  UNION SELECT user_id, ordinal, 'ordinal' FROM o WHERE ordinal <> place UNION SELECT user_id, ordinal, 'gap' FROM o WHERE a <> before UNION SELECT user_id, ordinal, 'beyond_duration' FROM o WHERE b > z
  UNION SELECT user_id, NULL, 'end_of_timeline' FROM o WHERE next IS NULL AND b <> z
  UNION SELECT coalesce(x.user_id, yy.user_id), NULL, coalesce(x.kind, yy.kind) FROM x FULL JOIN yy ON x.user_id = yy.user_id AND x.no = yy.no AND x.kind = yy.kind WHERE x.id IS DISTINCT FROM yy.id
  UNION SELECT m.user_id, m.ordinal, 'first_member' FROM m JOIN f USING (user_id, ordinal) WHERE pos = 1 AND a IS DISTINCT FROM ca
  UNION SELECT m.user_id, m.ordinal, 'last_member' FROM m JOIN f USING (user_id, ordinal) WHERE np IS NULL AND b IS DISTINCT FROM cb
  UNION SELECT user_id, ordinal, 'not_adjacent' FROM ed WHERE cb IS DISTINCT FROM na UNION SELECT user_id, ordinal, 'boundary_between' FROM ed WHERE r IS NULL OR r IS DISTINCT FROM nl
  UNION SELECT user_id, ordinal, 'crosses_kept' FROM ed WHERE decision IS DISTINCT FROM 'remove'
  UNION SELECT coalesce(l.user_id, e2.user_id), coalesce(l.ordinal, e2.ordinal), 'removed_ids' FROM l FULL JOIN ed e2 ON l.user_id = e2.user_id AND l.ordinal = e2.ordinal AND l.pos = e2.pos WHERE l.id IS DISTINCT FROM e2.r
  UNION SELECT v.user_id, v.ordinal, 'review_unknown' FROM v LEFT JOIN dn ON dn.user_id = v.user_id AND dn.id = v.id AND dn.decision = 'review' WHERE dn.id IS NULL
  UNION SELECT v.user_id, v.ordinal, 'review_place' FROM v JOIN m ON m.user_id = v.user_id AND m.ordinal = v.ordinal AND m.np IS NULL WHERE v.id IS DISTINCT FROM m.r)
SELECT user_id, ordinal, problem FROM q""",
    "planned_rounds": f"""WITH {_E}, r AS (SELECT e.*, CASE WHEN event_id % 2 = 0 THEN 'youtube' ELSE 'tiktok' END AS platform, 'about ' || (props::JSON ->> 'k') AS body FROM e JOIN events USING (event_id)),
p AS (SELECT r.user_id, list_sort(list(DISTINCT r.event_type)) AS facets, 2 + r.user_id % 4 AS most, r.user_id % 30 AS videos, count(*) FILTER (r.event_type = 'purchase') AS occupied FROM r GROUP BY r.user_id),
a AS (SELECT DISTINCT r.user_id, platform || ':' || body AS k FROM r WHERE r.ms < 864000000), h AS (SELECT DISTINCT r.user_id, platform || ':' || body AS k FROM r WHERE r.ms < 864000000 AND NOT (r.user_id % 7 = 0 AND event_id % 3 = 0)),
n AS (SELECT r.user_id, CASE WHEN r.user_id % 17 = 0 THEN 'q' ELSE event_id::VARCHAR END AS id, platform, platform || ':' || body AS k, CASE WHEN r.value > 97 THEN 'de' ELSE 'en' END AS lang, floor(r.value) AS budget FROM r WHERE r.ms >= 864000000 AND r.value > 70),
q AS (SELECT user_id, 'status' AS outcome FROM p WHERE user_id % 13 = 0 UNION SELECT user_id, 'facet_assessment' FROM p WHERE user_id % 5 = 0 UNION SELECT user_id, 'gap' FROM p WHERE user_id % 11 = 0
  UNION SELECT user_id, 'max_rounds' FROM p WHERE most - 2 < 1 UNION SELECT user_id, 'max_videos' FROM p WHERE videos - occupied < 1
  UNION SELECT user_id, 'history' FROM (FROM a EXCEPT FROM h) UNION SELECT user_id, 'no_queries' FROM p WHERE user_id NOT IN (SELECT user_id FROM n)
  UNION SELECT user_id, 'query' FROM n WHERE budget NOT BETWEEN 1 AND 100 UNION SELECT user_id, 'repeated_query' FROM n SEMI JOIN a USING (user_id, k)
  UNION SELECT user_id, 'duplicate_query' FROM n GROUP BY user_id, k HAVING count(*) > 1 UNION SELECT user_id, 'duplicate_query' FROM n GROUP BY user_id, id HAVING count(*) > 1
  UNION SELECT user_id, 'platform_without_query' FROM (SELECT user_id, unnest(['youtube', 'tiktok']) AS platform FROM p EXCEPT SELECT user_id, platform FROM n)
  UNION SELECT user_id, 'languages' FROM n GROUP BY user_id, platform HAVING count(DISTINCT lang) > 1)
SELECT user_id, outcome, NULL::BIGINT AS round_number, NULL::BIGINT AS remaining_rounds, NULL::BIGINT AS remaining_slots, NULL::BIGINT AS round_limit FROM q
UNION ALL SELECT user_id, 'planned', 3, most - 2, videos - occupied, ceil((videos - occupied) / (most - 2))::BIGINT FROM p WHERE user_id NOT IN (SELECT user_id FROM q)""",
    "handed_over_results": f"""WITH {_C}, z AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ordinal) AS next_id, min(start_ms) OVER (PARTITION BY user_id) AS zero, max(end_ms) OVER (PARTITION BY user_id) AS last FROM c),
s AS (SELECT user_id, ordinal, 's' || event_id % 1000 AS segment_id, start_ms - zero AS a, end_ms - zero AS b, event_id AS sa, next_id AS ea, event_type FROM z WHERE event_id % 41 <> 0),
k AS (SELECT user_id, event_id, start_ms - zero + CASE WHEN event_type = 'error' THEN 51 ELSE 50 END AS at_ms FROM z WHERE event_type <> 'purchase'),
w AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY user_id ORDER BY ordinal) AS before, row_number() OVER (PARTITION BY user_id, segment_id ORDER BY ordinal) AS same FROM s),
u AS (SELECT user_id, max(last - zero) AS d FROM z GROUP BY user_id), l AS (SELECT user_id, arg_max(b, ordinal) AS b FROM s GROUP BY user_id)
SELECT user_id, NULL AS segment_id, 'context_hash_mismatch' AS problem FROM u WHERE user_id % 9 = 0
UNION ALL SELECT user_id, segment_id, 'duplicate_segment_id' FROM w WHERE same > 1 UNION ALL SELECT user_id, segment_id, 'timeline_gap_or_overlap' FROM w WHERE abs(a - before) > 50
UNION ALL SELECT s.user_id, segment_id, CASE WHEN at_ms IS NULL THEN 'unknown_start_anchor' ELSE 'start_anchor_time_mismatch' END FROM s LEFT JOIN k ON k.user_id = s.user_id AND k.event_id = sa WHERE at_ms IS NULL OR abs(at_ms - a) > 50
UNION ALL SELECT s.user_id, segment_id, CASE WHEN at_ms IS NULL THEN 'unknown_end_anchor' ELSE 'end_anchor_time_mismatch' END FROM s LEFT JOIN k ON k.user_id = s.user_id AND k.event_id = ea WHERE at_ms IS NULL OR abs(at_ms - b) > 50
UNION ALL (SELECT DISTINCT user_id, segment_id, 'unknown_evidence_ref' FROM s WHERE event_type = 'view' AND user_id % 3 = 0)
UNION ALL SELECT u.user_id, NULL, 'timeline_duration_mismatch' FROM u LEFT JOIN l USING (user_id) WHERE abs(coalesce(l.b, 0) - d) > 50""",
    "request_evidence": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (row_number() OVER w)::INTEGER AS position, (sum(l_quantity::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)) SELECT * FROM l WHERE position <= 5 AND spent <= 100""",
    "attempt_chains": """WITH RECURSIVE o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) WHEN 'P' THEN -o_orderkey END AS up FROM orders),
w AS (SELECT id, id AS at_ms, up, 1 AS place FROM o UNION ALL SELECT w.id, o.id, o.up, place + 1 FROM w JOIN o ON o.id = w.up WHERE place < 6),
d AS (SELECT id, at_ms AS first_key, place::INTEGER AS place, CASE WHEN up IS NOT NULL THEN 'missing_prior' WHEN place > 3 THEN 'too_long' END AS problem FROM w WHERE (up IS NULL OR up < 0) AND place <= 4)
SELECT o.id AS o_orderkey, first_key, place, CASE WHEN d.id IS NULL THEN 'endless' ELSE problem END AS problem FROM o LEFT JOIN d USING (id)""",
    "followed_jobs": """WITH o AS (SELECT o_custkey AS job_id, o_orderkey AS event_id, o_orderdate AS at_ms, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'succeeded' ELSE 'running' END AS state FROM orders),
s AS (SELECT *, (count(*) FILTER (state <> 'running') OVER (PARTITION BY job_id ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING))::INTEGER AS seen FROM o),
b AS (SELECT *, lag(seen, 1, 0) OVER (PARTITION BY job_id ORDER BY at_ms, event_id) AS before FROM s)
SELECT job_id, CASE WHEN seen >= 2 THEN 'closed' ELSE 'told' END AS event, seen, state, event_id FROM b WHERE before < 2""",
    "lease_history": f"""WITH {_E}, b AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) >= 43200000, true) AS fresh FROM e)
SELECT user_id, CASE WHEN fresh THEN 'acquired' ELSE 'renewed' END AS event, (count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING))::INTEGER AS generation, event_id, ms AS at_ms, ms + 43200000 AS expires_ms FROM b""",
    "canonical_orders": r"""WITH d AS (SELECT o_orderkey, '{"Body":{"notes":["' || o_orderpriority || '","say \"x\"\n"],"state":"' || o_orderstatus || '"},"o_orderkey":' || o_orderkey || ',"o_totalprice":' || o_totalprice || '}' AS document FROM orders)
SELECT o_orderkey, document, 'sha256:' || sha256(document) AS content_hash, 'vmw_' || substr(sha256(document), 1, 20) AS workflow_id FROM d""",
    "ordered_lines": f"""WITH {_E} SELECT user_id, event_id, row_number() OVER w + count(*) FILTER (event_type = 'purchase') OVER (w ROWS UNBOUNDED PRECEDING) - CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS line_no,
  (row_number() OVER w)::INTEGER AS ordinal FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "admitted_in_order": "WITH " + ", ".join(_turn(lang, ("en", "de", "fr", "es")[:k]) for k, lang in enumerate(("en", "de", "fr", "es"))) + " " + " UNION ALL ".join(f"SELECT lang, source, doc_id, place FROM {lang}" for lang in ("en", "de", "fr", "es")),
    "identity_scalars": r"""WITH n AS (SELECT o_orderkey AS n, o_orderstatus FROM orders),
h AS (SELECT *, CASE n % 4 WHEN 0 THEN 'm.bilibili.com' WHEN 1 THEN 'www.douyin.com:443' WHEN 2 THEN 'user@bilibili.com' ELSE 'notbilibili.com' END AS host, CASE WHEN n % 5 = 0 THEN '' ELSE '/video/BV1' || lpad(n::VARCHAR, 9, '0') END AS path, n % 40 AS a, n % 30 AS b,
  lpad(lower(to_hex(n)), 24, 'a') AS note FROM n)
SELECT n AS o_orderkey, CASE WHEN n % 9 <> 0 AND n % 4 = 0 THEN 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END END AS page_url, CASE WHEN path <> '' THEN 'BV1' || lpad(n::VARCHAR, 9, '0') END AS video_id,
  CASE WHEN n % 2 = 0 THEN (n + 10000000)::VARCHAR END AS work_id, note AS note_id, n % 6 <> 0 AS safe,
  CASE WHEN n * 1000 > 5000000 THEN strftime(make_timestamp((n * 1000 - 5000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS published_at, CASE WHEN a > 0 AND b > 0 THEN a::DOUBLE / b END AS ratio,
  CASE WHEN n % 3 <> 0 AND b <> 0 THEN a::DOUBLE / b END AS rational, CASE WHEN n % 2 = 0 THEN n ELSE round_even(n / 8000 * 1000, 0)::BIGINT END AS span_ms, CASE WHEN n >= 100 THEN (n - 100) / 1000 END AS seconds FROM h""",
}
