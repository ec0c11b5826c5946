"""Queries of input contracts, work-group checks, media variants, shots and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.operators import contracts, manifest, records, retrieval, state
from shotloom.plans.timelines import DAY, HOUR, events, table


def segment_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents of supplier names; some ids, orders and scripts are made wrong."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("document"), F.col("s_suppkey").alias("position"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("s"), F.col("s_suppkey") % 10)).when(F.col("s_suppkey") % 19 == 0, "no good").alias("segment_id"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_suppkey") % 4 + 1).alias("order"), F.when(F.col("s_suppkey") % 17 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("s_name"))).alias("text"))
    named = contracts.named_segments(rows).groupBy("document").agg(F.sort_array(F.collect_list(F.struct("order", "position", "text"))).alias("s"))
    script = F.array_join(F.transform("s", lambda x: x["text"]), "\n")
    documents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document")).join(named, "document", "left").select("document", F.when(F.col("document") % 4 == 1, F.concat(script, F.lit("!"))).otherwise(script).alias("full_script"))
    return contracts.segment_problems(documents, rows).drop("plan_no")


def plan_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents, customers as query plans, their orders as queries; some of each are made wrong."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("document"), F.col("c_custkey").alias("plan_no"), "c_mktsegment")
    k = F.col("plan_no")
    documents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("document"), F.when(F.col("n_nationkey") == 3, F.array(F.lit("youtube"), F.lit("youtube"))).otherwise(F.array(F.lit("youtube"), F.lit("tiktok"))).alias("platform_scope"))
    segments = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("document"), F.concat(F.lit("s"), F.col("s_suppkey") % 50).alias("segment_id"))
    plans = rows.select("document", "plan_no", F.when(k % 6 == 0, F.concat(F.lit("p"), k % 100)).when(k % 53 == 0, "p p").alias("query_plan_id"), F.concat(F.lit("s"), k % 60).alias("segment_id"), F.when(k % 23 == 0, " ").otherwise(F.col("c_mktsegment")).alias("visual_strategy"))
    facet = lambda n: F.struct(F.when(k % 29 == 0, "f1").otherwise(f"f{n}").alias("facet_id"), F.when(k % 31 == 0, "Same" if n == 1 else " SAME ").when(k % 61 == 0, "").otherwise(F.lit(f"facet {n}")).alias("description"))
    facets = rows.where(k % 67 != 0).select("document", "plan_no", F.explode(F.array(facet(1), facet(2))).alias("f")).select("document", "plan_no", "f.*")
    second = F.when(k % 37 == 0, "youtube").when(k % 39 == 0, "bilibili").otherwise("tiktok")
    branches = rows.select("document", "plan_no", F.explode(F.when(k % 41 == 0, F.array(F.lit("youtube"))).otherwise(F.array(F.lit("youtube"), second))).alias("platform"), F.when(k % 71 == 0, "").otherwise("en").alias("language"))
    orders = table(spark, sf_dir, "orders").join(rows, F.col("o_custkey") == k)
    n = F.col("o_orderkey")
    named = F.when(n % 43 == 0, F.array(F.lit("f1"), F.lit("f1"))).when(n % 47 == 0, F.array(F.lit("f9"))).when(n % 59 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("f1")))
    queries = orders.select("document", "plan_no", F.when(n % 2 == 0, "youtube").otherwise("tiktok").alias("platform"), F.concat(F.lit("q"), n % 500).alias("query_id"), F.when(n % 73 == 0, " ").otherwise(F.concat(F.lit("Find "), n % 20)).alias("text"), named.alias("facet_ids"), (n % 105).cast("int").alias("budget"))
    return contracts.plan_problems(documents, segments, plans, facets, branches, queries)


def group_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units of work groups of a customer; some members are unknown, on another platform or in two groups."""
    orders = table(spark, sf_dir, "orders")
    units = orders.where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("media_unit_id"), F.col("o_orderstatus").alias("platform"))
    members = orders.select(F.concat(F.lit("g"), F.col("o_custkey")).alias("work_group_id"), F.col("o_orderkey").alias("media_unit_id"), F.when(F.col("o_orderkey") % 70 == 0, "X").otherwise(F.col("o_orderstatus")).alias("platform"))
    members = members.unionAll(members.where("media_unit_id % 90 = 0").withColumn("work_group_id", F.lit("g0")))
    groups = table(spark, sf_dir, "customer").select(F.concat(F.lit("g"), F.col("c_custkey") - F.when(F.col("c_custkey") % 30 == 0, 1).otherwise(0)).alias("work_group_id"))
    return contracts.group_problems(groups, members, units)


def stream_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as streams: the address of the largest one, and of the largest with an edge of 30 at most."""
    n = F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.concat(F.when(n % 7 == 0, "ftp").otherwise("https"), F.lit("://x/"), n, F.lit("/"), "l_suppkey").alias("url"), F.col("l_quantity").cast("int").alias("edge"), F.floor("l_discount").cast("int").alias("area"))
    return contracts.best_streams(lines, "l_orderkey", "position", "url", "edge", "area", 30)


def scene_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days as boundaries with the kinds of their events as reasons; purchases cut shots."""
    rows = events(spark, sf_dir)
    spans = rows.groupBy("user_id").agg((F.floor(F.max("ms") / DAY) * DAY + DAY).alias("duration"))
    days = rows.where(F.col("ms") >= HOUR).groupBy("user_id", ((F.floor(F.col("ms") / HOUR)) * HOUR).alias("at_ms")).agg(F.collect_set("event_type").alias("reasons"))
    return contracts.shot_ranges(days, spans, "user_id", "at_ms", "reasons", "duration", "purchase")


def session_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sessions: customers as candidates, their orders as units, of which open ones have no proxy."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    units = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).select("c_nationkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey")).alias("proxy"))
    return contracts.result_counts(customers, units, "c_nationkey")


def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as sessions: supplier balances order the segments asked for, customers' market segments are discovered."""
    asked = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("session"), F.col("s_suppkey").alias("place"), F.when(F.col("s_suppkey") % 2 == 0, "MACHINERY").otherwise(F.concat(F.lit("s"), F.col("s_suppkey") % 3)).alias("segment_id"))
    found = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("session"), F.col("c_mktsegment").alias("segment_id"))
    return contracts.ordered_segments(asked, found, "session")


def annotated_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their last order as annotation."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shot_id"), F.col("o_orderkey").alias("line_no"), "o_orderstatus", "o_totalprice")
    shots = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("shot_id"), "c_mktsegment").join(orders.select("shot_id").distinct(), "shot_id", "left_semi")
    return retrieval.with_annotations(shots, orders)


def one_annotated_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer 33 with its last order."""
    return retrieval.first_match(annotated_shots(spark, sf_dir), "shot_id", 34, "shot_id")


def waiting_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer, nested and taken apart again: those that wait for a review."""
    status = F.when(F.col("o_totalprice") > 450_000, "manual_review_required").when(F.col("o_totalprice") < 5_000, "duration_unknown").otherwise("discovered")
    unit = F.struct("o_orderkey", status.alias("status"))
    nested = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.collect_list(unit).alias("media_units"))
    return manifest.reviews(nested)


def decided_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as units under review; the last line of an order decides, where the state allows it."""
    status = F.when(F.col("o_orderstatus") == "F", "manual_review_required").when(F.col("o_orderstatus") == "P", "proxy_ready").otherwise("discovered")
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("media_unit_id"), status.alias("status"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("media_unit_id"), (F.col("l_returnflag") == "A").alias("approved"), F.col("l_suppkey").cast("string").alias("actor"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("decided_at"))
    return manifest.decide_review(units, lines)


def active_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five open orders of each customer, by key."""
    return state.active_ids(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "O", "o_orderkey", 5)


def frozen_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as workflows: their name and balance are the frozen documents."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit('{"balance":'), F.col("c_acctbal").cast("string"), F.lit("}")).alias("plans"), F.col("c_mktsegment").alias("profile"), (1 + F.col("c_custkey") % 5).cast("int").alias("max_rounds"), (1 + F.col("c_custkey") % 40).alias("max_videos"))
    out = records.frozen_workflows(rows, "c_name", "plans", ["profile", "max_rounds", "max_videos"])
    return out.select("workflow_id", "collection_input_sha256", "max_rounds", "max_videos")


def export_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assets, their lines as clips; some of them twice, backwards or badly named."""
    assets = table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), F.col("o_orderkey")).alias("asset_id"), F.lit("w").alias("workflow_id"), F.col("o_custkey").cast("string").alias("selection_id"), F.sha2("o_orderstatus", 256).alias("source_sha256"))
    n = F.col("l_partkey")
    clip = F.when(n % 71 == 0, " x").otherwise(F.concat(F.lit("c"), F.col("l_linenumber"), F.lit("-"), n % 50))
    position = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    start = (F.col("l_quantity") - F.when(n % 59 == 0, 100).otherwise(0)).cast("double")
    ranges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), F.col("l_orderkey")).alias("asset_id"), position.alias("position"), clip.alias("clip_id"), start.alias("start_seconds"), (F.col("l_quantity") + F.when(n % 61 == 0, 0.0).otherwise(1.5)).alias("end_seconds"))
    out = records.export_requests(assets, ranges)
    return out.select("asset_id", "request_id", "idempotency_key", F.coalesce(F.size("clips"), F.lit(-1)).alias("n_clips"), "problems")


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as model calls, their turns as attempts."""
    turns = table(spark, sf_dir, "conversations")
    runs = turns.select(F.col("conv_id").alias("model_run_id")).distinct()
    size = F.char_length("text").cast("long")
    attempts = turns.select(F.col("conv_id").alias("model_run_id"), F.col("turn").alias("attempt_no"), size.alias("input_tokens"), F.when(F.col("turn") % 3 != 0, size * 2).alias("output_tokens"), F.lit(None).cast("long").alias("total_tokens"), F.when(F.col("role") == "user", F.concat(F.lit("t"), "turn")).otherwise("").alias("trace_id"), F.col("text").alias("response"))
    return records.model_runs(runs, attempts)


def readable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as assets of a session a brand."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("ses_"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-")).alias("session_id"), F.lower("p_type").alias("platform"), F.col("p_name").alias("source_title"), F.concat(F.lit("s/"), F.col("p_partkey")).alias("source_id"), F.concat("p_name", F.lit(": "), F.col("p_size")).alias("unit_title"), F.concat(F.lower("p_type"), F.lit(":u"), F.col("p_partkey")).alias("unit_id"), F.when(F.col("p_size") > 25, "high").otherwise("low_proxy").alias("quality"), F.lit(".MP4").alias("suffix"))
    return records.readable_paths(rows).select("p_partkey", "display_relative_path")


_NAMES = (segment_contract, plan_contract, group_contract, stream_choice, scene_shots, session_results, session_segments, annotated_shots, one_annotated_shot, waiting_reviews, decided_reviews, active_places, frozen_workflows, export_requests, model_runs, readable_paths)
QUERIES = {f.__name__: f for f in _NAMES}

ORACLE_SQL = {
    "segment_contract": r"""WITH s AS (SELECT s_nationkey AS document, s_suppkey AS pos, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 's' || s_suppkey % 10 WHEN s_suppkey % 19 = 0 THEN 'no good' END, printf('seg_%03d', s_suppkey)) AS id,
    CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 4 + 1 ELSE s_suppkey END AS ord, CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE s_name END AS t FROM supplier),
n AS (SELECT n_nationkey AS document, count(pos) AS n FROM nation LEFT JOIN s ON document = n_nationkey GROUP BY 1)
SELECT document, id AS item, 'duplicate_segment_id' AS problem FROM s GROUP BY document, id HAVING count(*) > 1 UNION ALL SELECT document, ord::VARCHAR, 'duplicate_order' FROM s GROUP BY document, ord HAVING count(*) > 1
UNION (SELECT document, id, 'unsafe_id' FROM s WHERE id = 'no good') UNION (SELECT document, id, 'blank_text' FROM s WHERE t = '')
UNION ALL SELECT document, NULL, 'no_segments' FROM n WHERE n = 0 UNION ALL SELECT document, NULL, 'script_mismatch' FROM n WHERE n > 0 AND document % 4 = 1""",
    "plan_contract": r"""WITH c AS (SELECT c_nationkey AS document, c_custkey AS k FROM customer),
p AS (SELECT *, coalesce(CASE WHEN k % 6 = 0 THEN 'p' || k % 100 WHEN k % 53 = 0 THEN 'p p' END, 'qp_s' || k % 60) AS id, 's' || k % 60 AS seg FROM c),
s AS (SELECT DISTINCT s_nationkey AS document, 's' || s_suppkey % 50 AS seg FROM supplier),
f AS (SELECT document, k, CASE WHEN k % 29 = 0 THEN 'f1' ELSE 'f' || n END AS id, CASE WHEN k % 31 = 0 THEN 'same' WHEN k % 61 = 0 THEN '' ELSE 'facet ' || n END AS d FROM c, range(1, 3) r(n) WHERE k % 67 <> 0),
b AS (SELECT document, k, unnest(CASE WHEN k % 41 = 0 THEN ['youtube'] ELSE ['youtube', CASE WHEN k % 37 = 0 THEN 'youtube' WHEN k % 39 = 0 THEN 'bilibili' ELSE 'tiktok' END] END) AS platform FROM c),
w AS (SELECT document, k, unnest(CASE WHEN document = 3 THEN ['youtube'] ELSE ['youtube', 'tiktok'] END) AS platform FROM c WHERE document IN (SELECT n_nationkey FROM nation)),
q AS (SELECT document, k, o_orderkey AS n, CASE WHEN o_orderkey % 2 = 0 THEN 'youtube' ELSE 'tiktok' END AS platform, 'q' || o_orderkey % 500 AS id, CASE WHEN o_orderkey % 73 = 0 THEN '' ELSE 'find ' || o_orderkey % 20 END AS t,
    CASE WHEN o_orderkey % 43 = 0 THEN ['f1', 'f1'] WHEN o_orderkey % 47 = 0 THEN ['f9'] WHEN o_orderkey % 59 = 0 THEN [] ELSE ['f1'] END AS fs, o_orderkey % 105 AS budget FROM orders JOIN c ON o_custkey = k)
SELECT n_nationkey AS document, NULL::BIGINT AS plan_no, NULL AS item, 'duplicate_scope' AS problem FROM nation WHERE n_nationkey = 3
UNION SELECT document, k, seg, 'unknown_segment' FROM p ANTI JOIN s USING (document, seg) UNION SELECT document, NULL, seg, 'several_plans' FROM p GROUP BY document, seg HAVING count(*) > 1
UNION SELECT document, NULL, seg, 'missing_plan' FROM s ANTI JOIN p USING (document, seg) UNION SELECT document, NULL, id, 'duplicate_plan_id' FROM p GROUP BY document, id HAVING count(*) > 1
UNION SELECT document, k, id, 'unsafe_id' FROM p WHERE id = 'p p' UNION SELECT document, k, NULL, 'blank_strategy' FROM p WHERE k % 23 = 0 UNION SELECT document, k, NULL, 'no_facets' FROM p WHERE k % 67 = 0
UNION SELECT document, k, id, 'duplicate_facet_id' FROM f GROUP BY document, k, id HAVING count(*) > 1 UNION SELECT document, k, d, 'duplicate_description' FROM f WHERE d <> '' GROUP BY document, k, d HAVING count(*) > 1
UNION SELECT document, k, id, 'blank_description' FROM f WHERE d = '' UNION SELECT document, k, platform, 'duplicate_branch' FROM b GROUP BY document, k, platform HAVING count(*) > 1
UNION SELECT document, k, platform, 'missing_branch' FROM w ANTI JOIN b USING (document, k, platform) UNION SELECT document, k, platform, 'branch_out_of_scope' FROM b ANTI JOIN w USING (document, k, platform)
UNION SELECT document, k, platform, 'blank_language' FROM b WHERE k % 71 = 0 UNION SELECT document, k, platform, 'no_queries' FROM b ANTI JOIN q USING (document, k, platform)
UNION SELECT document, k, id, 'query_without_branch' FROM q ANTI JOIN b USING (document, k, platform) UNION SELECT document, k, id, 'duplicate_query_id' FROM q GROUP BY document, k, id HAVING count(*) > 1
UNION SELECT document, k, platform || ':' || t, 'duplicate_query_text' FROM q WHERE t <> '' GROUP BY document, k, platform, t HAVING count(*) > 1 UNION SELECT document, k, id, 'blank_text' FROM q WHERE t = ''
UNION SELECT document, k, id, 'repeated_facet' FROM q WHERE len(fs) = 2 UNION SELECT q.document, q.k, q.id, 'unknown_facet' FROM (SELECT *, unnest(fs) AS f FROM q) q LEFT JOIN f ON f.document = q.document AND f.k = q.k AND f.id = q.f WHERE f.id IS NULL
UNION SELECT document, k, id, 'no_facet' FROM q WHERE len(fs) = 0 UNION SELECT document, k, id, 'budget' FROM q WHERE budget NOT BETWEEN 1 AND 100""",
    "group_contract": """WITH m AS (SELECT 'g' || o_custkey AS g, o_orderkey AS u, CASE WHEN o_orderkey % 70 = 0 THEN 'X' ELSE o_orderstatus END AS p, o_orderstatus AS s FROM orders
  UNION ALL SELECT 'g0', o_orderkey, CASE WHEN o_orderkey % 70 = 0 THEN 'X' ELSE o_orderstatus END, o_orderstatus FROM orders WHERE o_orderkey % 90 = 0), g AS (SELECT 'g' || (c_custkey - CASE WHEN c_custkey % 30 = 0 THEN 1 ELSE 0 END) AS g FROM customer)
SELECT g AS work_group_id, NULL AS media_unit_id, 'duplicate_group' AS problem FROM g GROUP BY g HAVING count(*) > 1 UNION SELECT g, u::VARCHAR, 'unknown_unit' FROM m WHERE u % 50 = 0
UNION SELECT g, u::VARCHAR, 'platform_mismatch' FROM m WHERE u % 50 <> 0 AND p <> s UNION SELECT NULL, u::VARCHAR, 'several_groups' FROM m GROUP BY u HAVING count(*) > 1""",
    "stream_choice": """WITH l AS (SELECT l_orderkey, 'https://x/' || l_partkey || '/' || l_suppkey AS url, l_quantity::INTEGER AS edge, (floor(l_quantity)::INTEGER, floor(l_discount)::INTEGER, l_linenumber, l_partkey, l_suppkey) AS size, l_partkey % 7 <> 0 AND l_quantity::INTEGER > 0 AS fit FROM lineitem)
SELECT l_orderkey, arg_max(url, size) FILTER (fit) AS high_url, arg_max(url, size) FILTER (fit AND edge <= 30) AS low_url FROM l GROUP BY l_orderkey""",
    "scene_shots": """WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM events), s AS (SELECT user_id, (max(ms) // 86400000 + 1) * 86400000 AS d FROM e GROUP BY user_id),
c AS (SELECT user_id, 0::BIGINT AS start_ms FROM s UNION ALL SELECT DISTINCT user_id, ms // 3600000 * 3600000 FROM e WHERE event_type = 'purchase' AND ms >= 3600000),
o AS (SELECT user_id, (row_number() OVER w - 1)::INTEGER AS ordinal, start_ms, lead(start_ms) OVER w AS next FROM c WINDOW w AS (PARTITION BY user_id ORDER BY start_ms))
SELECT user_id, ordinal, printf('shot_%04d', ordinal + 1) AS shot_id, start_ms, coalesce(next, d) AS end_ms FROM o JOIN s USING (user_id)""",
    "session_results": """WITH c AS (SELECT c_nationkey, count(*) AS candidates_found FROM customer GROUP BY 1), u AS (SELECT c_nationkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'O') AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_nationkey, candidates_found, coalesce(n, 0) AS media_units_found, coalesce(p, 0) AS proxies_ready FROM c LEFT JOIN u USING (c_nationkey)""",
    "session_segments": """WITH a AS (SELECT s_nationkey AS session, CASE WHEN s_suppkey % 2 = 0 THEN 'MACHINERY' ELSE 's' || s_suppkey % 3 END AS segment_id, min(s_suppkey) AS p FROM supplier GROUP BY 1, 2),
r AS (FROM a UNION ALL SELECT DISTINCT c_nationkey, c_mktsegment, NULL::BIGINT FROM customer WHERE (c_nationkey, c_mktsegment) NOT IN (SELECT (session, segment_id) FROM a))
SELECT session, (row_number() OVER (PARTITION BY session ORDER BY p NULLS LAST, segment_id))::INTEGER AS place, segment_id FROM r""",
    "annotated_shots": "SELECT c_custkey AS shot_id, c_mktsegment, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2",
    "one_annotated_shot": "SELECT c_custkey AS shot_id, c_mktsegment, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 34 GROUP BY 1, 2",
    "waiting_reviews": "SELECT o_custkey AS candidate_id, o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'manual_review_required' ELSE 'duration_unknown' END AS status FROM orders WHERE o_totalprice > 450000 OR o_totalprice < 5000",
    "decided_reviews": """WITH d AS (SELECT l_orderkey AS k, arg_max(l_returnflag = 'A', (l_linenumber, l_partkey, l_suppkey)) AS yes, arg_max(l_suppkey, (l_linenumber, l_partkey, l_suppkey))::VARCHAR AS actor FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
u AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'manual_review_required' WHEN 'P' THEN 'proxy_ready' ELSE 'discovered' END AS status FROM orders),
j AS (SELECT u.*, yes, actor, @REVIEWABLE@ AS allowed FROM u LEFT JOIN d USING (k))
SELECT k AS media_unit_id, CASE WHEN yes IS NOT NULL AND allowed THEN CASE WHEN yes THEN 'approved' ELSE 'rejected' END ELSE status END AS status, CASE WHEN yes IS NOT NULL THEN allowed END AS applied, actor AS review_actor FROM j""".replace("@REVIEWABLE@", "status IN (" + ", ".join(f"'{s}'" for s in manifest.REVIEWABLE) + ")"),
    "active_places": "SELECT * FROM (SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS place, o_orderkey FROM orders WHERE o_orderstatus = 'O') WHERE place <= 5",
    "frozen_workflows": r"""WITH c AS (SELECT c_mktsegment, 1 + c_custkey % 5 AS r, 1 + c_custkey % 40 AS v, sha256(c_name) AS a, sha256('{"balance":' || c_acctbal || '}') AS b FROM customer)
SELECT 'vmw_' || substr(sha256('{"collection_input_sha256":"' || a || '","initial_query_plans_sha256":"' || b || '","max_rounds":' || r || ',"max_videos":' || v || ',"profile":"' || c_mktsegment || '"}'), 1, 20) AS workflow_id,
  a AS collection_input_sha256, r::INTEGER AS max_rounds, v AS max_videos FROM c""",
    "export_requests": r"""WITH l AS (SELECT 'a' || l_orderkey AS asset_id, (l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos, CASE WHEN l_partkey % 71 = 0 THEN ' x' ELSE 'c' || l_linenumber || '-' || l_partkey % 50 END AS clip,
    (l_quantity - CASE WHEN l_partkey % 59 = 0 THEN 100 ELSE 0 END)::DOUBLE AS s, (l_quantity + CASE WHEN l_partkey % 61 = 0 THEN 0.0 ELSE 1.5 END)::DOUBLE AS e FROM lineitem),
m AS (SELECT *, count(*) OVER (PARTITION BY asset_id, clip) AS n FROM l), k AS (SELECT *, CASE WHEN clip = ' x' THEN 'unsafe_id' WHEN n > 1 THEN 'duplicate_clip' WHEN s < 0 OR e <= s THEN 'not_half_open' END AS bad FROM m),
g AS (SELECT asset_id, coalesce(string_agg(DISTINCT bad, ',' ORDER BY bad), '') AS problems, count(*) AS n, string_agg('{"clip_id":"' || clip || '","end_seconds":' || e || ',"start_seconds":' || s || '}', ',' ORDER BY pos) AS rs FROM k GROUP BY asset_id),
o AS (SELECT 'a' || o_orderkey AS asset_id, o_custkey, sha256(o_orderstatus) AS h FROM orders),
j AS (SELECT o.asset_id, coalesce(problems, 'no_ranges') AS problems, n, sha256('{"asset_id":"' || o.asset_id || '","ranges":[' || rs || '],"selection_id":"' || o_custkey || '","source_sha256":"' || h || '","workflow_id":"w"}') AS lineage FROM o LEFT JOIN g USING (asset_id))
SELECT asset_id, CASE WHEN problems = '' THEN 'mc_' || substr(lineage, 1, 12) END AS request_id, CASE WHEN problems = '' THEN 'idem_' || substr(lineage, 1, 16) END AS idempotency_key, CASE WHEN problems = '' THEN n ELSE -1 END::INTEGER AS n_clips, problems FROM j""",
    "model_runs": r"""SELECT conv_id AS model_run_id, count(*) AS n_attempts, sum(length(text))::BIGINT AS input_tokens, coalesce(sum(length(text) * 2) FILTER (turn % 3 <> 0), 0)::BIGINT AS output_tokens, 0::BIGINT AS total_tokens,
  arg_max('t' || turn, turn) FILTER (role = 'user') AS trace_id, 'artifact_' || substr(sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY turn, sha256(coalesce(text, '')))), 1, 24) AS raw_response_artifact_id, count(*) > 1 AS repair_attempted FROM conversations GROUP BY conv_id""",
    "readable_paths": r"""WITH p AS (SELECT p_partkey, p_name, p_name || '_ ' || p_size AS t, p_name || ': ' || p_size AS u, lower(p_type) AS f, 'ses_' || regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') AS s, p_size, 's/' || p_partkey AS i, 'u' || p_partkey AS v FROM part)
SELECT p_partkey, 'materials/by-session/' || s || '/' || p_name || '__' || f || '__' || substr(replace(i, '/', '_'), 1, 10) || '--' || substr(sha256(i), 1, 8) || '/' || CASE WHEN p_size > 25 THEN 'high-quality' ELSE 'low-proxy' END || '/' ||
  t || '--' || substr(sha256(u), 1, 8) || '__' || substr(v, 1, 10) || '--' || substr(sha256(v), 1, 8) || '.mp4' AS display_relative_path FROM p""",
}
