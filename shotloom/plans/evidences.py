"""Evidence, probe, audit and file-name queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.functions import scalars
from shotloom.operators import evidence
from shotloom.plans.timelines import events, table


def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.contact_sheets(events(spark, sf_dir), "user_id", "ms", "event_id")


def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    kinds = {f"{kind}_ids": (rows.where(F.col("event_type") == kind), "event_id", "ms") for kind in ("click", "purchase", "error")}
    return evidence.evidence_windows(rows.groupBy("user_id").agg(F.max("ms").alias("duration_ms")), kinds, "user_id", "duration_ms")


def motion_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("day", F.floor(F.col("ms") / 86_400_000))
    moves = rows.withColumns({"dx": (F.col("event_id") % 7 - 3) / 500, "dy": (F.col("event_id") % 5 - 1) / 500, "ds": F.lit(0.0), "shot": F.concat_ws(":", F.col("user_id").cast("string"), F.col("day").cast("string"))})
    return evidence.motion_summaries(moves, "shot", ["ms", "event_id"], "dx", "dy", "ds", ["value"]).drop("median_ds")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe for each order: its lines are the streams."""
    kind = F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("subtitle")), (F.col("l_partkey") % 3 + 1).cast("int"))
    stream = F.struct(
        kind.alias("codec_type"),
        F.when(F.col("l_suppkey") % 2 == 0, "subrip").otherwise("dvd_subtitle").alias("codec_name"),
        F.col("l_partkey").cast("int").alias("width"),
        F.col("l_suppkey").cast("int").alias("height"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".25")).alias("duration"),
        F.struct(F.when(F.col("l_returnflag") == "R", "zh").otherwise("en").alias("language")).alias("tags"),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), stream.alias("s")))).alias("x"))
    content = F.to_json(F.struct(F.struct(F.when(F.col("l_orderkey") % 2 == 0, "61.0005").alias("duration")).alias("format"), F.transform("x", lambda v: v["s"]).alias("streams")))
    return rows.select("l_orderkey", content.alias("content"))


def probe_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.probe_facts(_probes(spark, sf_dir), "l_orderkey", "content")


def subtitle_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.choose_stream(_probes(spark, sf_dir), "l_orderkey", "content", ("zh", "en"))


def registered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.register_sources(table(spark, sf_dir, "pages"), F.encode(F.coalesce("html", F.lit("")), "utf-8"), "page_id")


def asset_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    declared = F.when(F.col("doc_id") % 5 == 0, "00").when(F.col("doc_id") % 5 == 1, F.upper(F.sha2(text, 256)))
    return evidence.asset_imports(table(spark, sf_dir, "documents"), "doc_id", F.encode(text, "utf-8"), declared, F.when(F.col("doc_id") % 3 == 0, F.octet_length(text) + 1), F.lit("txt"))


def range_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return evidence.range_audit(rows.select("l_orderkey", (F.col("l_quantity") - 3).alias("start_s"), (F.col("l_quantity") - 3 + F.col("l_suppkey") % 20 - 2).alias("end_s")), "l_orderkey", "start_s", "end_s")


def invalidated_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    orders = table(spark, sf_dir, "orders")
    retries = orders.where("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderpriority").alias("from_stage"))
    return evidence.invalidated(orders.select("o_custkey", "o_orderkey", "o_orderpriority"), retries, "o_custkey", "o_orderpriority", stages).select("o_custkey", "o_orderkey", "valid")


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.html_report(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role", "text"])


def fingerprint_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = scalars.unpack_words(F.unhex(F.sha2("c_name", 256)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(words).alias("pos", "word"))


def difference_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: (F.col("p_partkey") * (k * k + 7) + k * F.col("p_size")) % 251)
    return table(spark, sf_dir, "part").select("p_partkey", scalars.difference_hash(pixels).alias("dhash"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, of which some are not fit for files."""
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(": "), "p_brand", F.lit("?"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("con."), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))


def safe_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("p_partkey", scalars.safe_title(F.col("title"), 24).alias("name"))


def safe_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("p_partkey", scalars.safe_identity(F.col("title")).alias("name"))


_NAMES = (
    contact_sheets, evidence_windows, motion_summaries, probe_facts, subtitle_streams, registered_sources, asset_imports, range_audit,
    invalidated_stages, html_rows, fingerprint_words, difference_hashes, safe_titles, safe_identities,
)
QUERIES = {f.__name__: f for f in _NAMES}

_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM events)"
_S = """s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS pos, l_partkey % 3 AS kind, l_partkey AS w, l_suppkey AS h,
  l_suppkey % 2 = 0 AS readable, CASE WHEN l_returnflag = 'R' THEN 'zh' ELSE 'en' END AS language FROM lineitem)"""
_T = """t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ': ' || p_brand || '?' WHEN 1 THEN 'con.' || p_name ELSE p_name END AS title FROM part)"""

ORACLE_SQL = {
    "contact_sheets": f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS no FROM e)
SELECT user_id, printf('sheet_%04d', no // 9 + 1) AS sheet_id, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS n_cells, string_agg(event_id, ',' ORDER BY no) AS frame_ids FROM n GROUP BY user_id, no // 9""",
    "evidence_windows": f"""WITH {_E} SELECT user_id, 'window_0001' AS window_id, 0::BIGINT AS start_ms, max(ms) AS end_ms, coalesce(string_agg(event_id, ',' ORDER BY ms, event_id) FILTER (event_type = 'click'), '') AS click_ids,
  coalesce(string_agg(event_id, ',' ORDER BY ms, event_id) FILTER (event_type = 'purchase'), '') AS purchase_ids, coalesce(string_agg(event_id, ',' ORDER BY ms, event_id) FILTER (event_type = 'error'), '') AS error_ids FROM e GROUP BY user_id""",
    "motion_summaries": f"""WITH {_E}, m AS (SELECT *, user_id || ':' || ms // 86400000 AS shot, (event_id % 7 - 3) / 500 AS dx, (event_id % 5 - 1) / 500 AS dy FROM e),
v AS (SELECT *, sqrt(dx * dx + dy * dy) AS raw, lag(dx) OVER w AS px, lag(dy) OVER w AS py, row_number() OVER w AS no, count(*) OVER (PARTITION BY shot) AS n FROM m WINDOW w AS (PARTITION BY shot ORDER BY ms, event_id)),
x AS (SELECT *, raw >= 0.005 AND sqrt(px * px + py * py) >= 0.005 AND dx * px + dy * py < 0 AS turn, no <= greatest(1, n // 2) AS early, round(raw, 6) AS speed FROM v),
g AS (SELECT shot, count(*) AS n_pairs, median(dx) AS median_dx, median(dy) AS median_dy, median(value) AS median_value, count(*) FILTER (turn) AS n_turns, greatest(0.002, median(speed) * 0.2) AS least, avg(speed) FILTER (NOT early) - avg(speed) FILTER (early) AS d FROM x GROUP BY shot)
SELECT shot, n_pairs, median_dx, median_dy, median_value, n_turns, CASE WHEN n_pairs < 2 THEN 'unknown' WHEN n_turns > 0 THEN 'variable' WHEN d > least THEN 'accelerating' WHEN -d > least THEN 'decelerating' ELSE 'constant' END AS profile FROM g""",
    "probe_facts": f"""WITH {_S} SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 61000 ELSE max(h) * 1000 + 250 END::BIGINT AS duration_ms, min_by(w, pos) FILTER (kind = 0)::INT AS width, min_by(h, pos) FILTER (kind = 0)::INT AS height,
  count(*) FILTER (kind = 1)::INT AS n_audio, count(*) FILTER (kind = 2)::INT AS n_subtitles FROM s GROUP BY l_orderkey""",
    "subtitle_streams": f"""WITH {_S} SELECT l_orderkey, pos::INT AS stream, language FROM s WHERE kind = 2 AND readable QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY language DESC, pos) = 1""",
    "registered_sources": "SELECT sha256(coalesce(html, '')) AS content_sha256, min(page_id) AS first_seen, count(*) AS n_copies, 'video_' || sha256(coalesce(html, ''))[:24] AS source_id FROM pages GROUP BY sha256(coalesce(html, ''))",
    "asset_imports": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
SELECT doc_id, 'assets/' || h[:2] || '/' || h || '.txt' AS path, n::BIGINT AS n_bytes, CASE WHEN doc_id % 5 = 0 THEN 'hash_mismatch' WHEN doc_id % 3 = 0 THEN 'size_mismatch' ELSE 'verified' END AS state FROM d""",
    "range_audit": """WITH g AS (SELECT l_orderkey, count(*) > 1 AS dup, bool_or(l_quantity < 3) AS neg, bool_or(l_suppkey % 20 <= 2) AS emp FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'duplicate' AS problem FROM g WHERE dup UNION ALL SELECT l_orderkey, 'negative_start' FROM g WHERE neg UNION ALL SELECT l_orderkey, 'not_half_open' FROM g WHERE emp""",
    "invalidated_stages": "SELECT o_custkey, o_orderkey, NOT coalesce(o_orderpriority >= min(o_orderpriority) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey), false) AS valid FROM orders",
    "html_rows": """SELECT conv_id, '<tr><td>' || coalesce(turn::VARCHAR, '') || '</td><td>' || coalesce(role, '') || '</td><td>' ||
  replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td></tr>' AS html FROM conversations""",
    "fingerprint_words": """WITH h AS (SELECT c_custkey, sha256(c_name) AS h, unnest(range(0, 8)) AS pos FROM customer)
SELECT c_custkey, pos::INT AS pos, ('0x' || h[pos * 8 + 7:pos * 8 + 8] || h[pos * 8 + 5:pos * 8 + 6] || h[pos * 8 + 3:pos * 8 + 4] || h[pos * 8 + 1:pos * 8 + 2])::BIGINT AS word FROM h""",
    "difference_hashes": """WITH k AS (SELECT p_partkey, p_size, unnest(range(0, 64)) AS k FROM part), i AS (SELECT *, k // 8 * 9 + k % 8 AS i FROM k),
b AS (SELECT p_partkey, k, (p_partkey * (i * i + 7) + i * p_size) % 251 > (p_partkey * ((i + 1) * (i + 1) + 7) + (i + 1) * p_size) % 251 AS up FROM i)
SELECT p_partkey, (sum(CASE WHEN up AND k > 0 THEN 1::HUGEINT << (63 - k)::INT ELSE 0 END) - max(CASE WHEN up AND k = 0 THEN 9223372036854775808::HUGEINT ELSE 0 END))::BIGINT AS dhash FROM b GROUP BY p_partkey""",
    "safe_titles": f"""WITH {_T}, c AS (SELECT *, CASE p_partkey % 3 WHEN 0 THEN rtrim(replace(replace(title, ':', '_'), '?', '_'), ' .') WHEN 1 THEN '_' || title ELSE title END AS name FROM t)
SELECT p_partkey, CASE WHEN name <> title OR length(name) > 24 THEN rtrim(name[:14], ' .') || '--' || sha256(title)[:8] ELSE name END AS name FROM c""",
    "safe_identities": f"""WITH {_T} SELECT p_partkey, rtrim(trim(regexp_replace(title, '[^0-9A-Za-z_.-]', '_', 'g'), ' ._')[:10], ' ._') || '--' || sha256(title)[:8] AS name FROM t""",
}
