"""Queries of readers and sinks: texts and files are made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.functions import scalars
from shotloom.plans.timelines import events, table
from shotloom.session import fresh_dir
from shotloom.sources import readers, writers


def _joined(rows: DataFrame, key: str, order: list[str], piece: Column, between: str) -> DataFrame:
    """(key, content): the pieces of a key in order."""
    listed = F.sort_array(F.collect_list(F.struct(*order, piece.alias("piece"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["piece"]), between).alias("content"))


def subtitle_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a subtitle text, with tags, returns and blocks without words, parsed again."""
    rows = events(spark, sf_dir)
    time = lambda ms: F.replace(scalars.clock_text(ms), F.lit("."), F.lit(","))
    words = F.when(F.col("event_type") == "error", "<i></i>").otherwise(F.concat(F.lit("<b>"), "event_type", F.lit("</b>\r\n  {\\an8}of "), F.col("event_id")))
    block = F.concat(F.col("event_id"), F.lit("\r\n"), time(F.col("ms")), F.lit(" --> "), time(F.col("ms") + 1500), F.lit("\r\n"), words)
    texts = _joined(rows, "user_id", ["ms", "event_id"], block, "\r\n\r\n")
    return readers.parse_subtitles(texts, "user_id", "content").select("user_id", "span_no", "start_ms", "end_ms", "text")


def speech_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recognised speech: clicks say nothing."""
    rows = events(spark, sf_dir).select("user_id", "event_id", (F.col("ms") / 1000).alias("start"), (F.col("ms") / 1000 + F.col("value")).alias("end"), F.when(F.col("event_type") == "click", " \t").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"))
    return readers.asr_spans(rows, "user_id", "event_id").select("user_id", "span_no", "start_ms", "end_ms", "text")


def span_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a JSON list of spans, in two shapes and with some that end before they start."""
    rows = events(spark, sf_dir)
    odd = F.col("user_id") % 2 == 1
    name = lambda short, long: F.when(odd, short).otherwise(long)
    end = F.col("ms") / 1000 + F.when(F.col("event_type") == "error", 0).otherwise(2)
    piece = F.concat(F.lit('{"'), name("start", "start_sec"), F.lit('": '), (F.col("ms") / 1000).cast("decimal(20,3)"), F.lit(', "'), name("end", "end_sec"), F.lit('": '), end.cast("decimal(20,3)"), F.lit(', "text": " '), "event_type", F.lit(' "}'))
    texts = _joined(rows, "user_id", ["event_id"], piece, ", ").select("user_id", F.when(odd, F.concat(F.lit("["), "content", F.lit("]"))).otherwise(F.concat(F.lit('{"segments": ['), "content", F.lit("]}"))).alias("content"))
    return readers.lenient_spans(texts, "user_id", "content")


def detector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a detector's log: a line with the time, one with the score, and other lines between them."""
    rows = events(spark, sf_dir)
    seconds = (F.floor(F.col("ms") / 60_000) * 60).cast("string")
    lines = rows.select("user_id", "event_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat(F.lit("frame:1 pts:9 pts_time:"), seconds).alias("line")), F.struct(F.lit(1).alias("n"), F.lit("size=7").alias("line")), F.struct(F.lit(2).alias("n"), F.concat(F.lit("lavfi.scene_score="), F.col("value")).alias("line")))).alias("x"))
    lines = lines.select("user_id", F.struct("event_id", "x.n").alias("at"), "x.line")
    return readers.scene_points(lines, "user_id", "at", "line")


def lenient_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON replies: plain, in a fence, with words around them, or broken."""
    body = F.concat(F.lit('{"key": '), "o_orderkey", F.lit(', "state": "'), "o_orderstatus", F.lit('"}'))
    n = F.col("o_orderkey") % 4
    reply = F.when(n == 0, body).when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), body, F.lit(" - done"))).otherwise(F.concat(F.lit("{"), body))
    got = readers.lenient_json(F.col("reply"), "key long, state string")
    return table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply")).select("o_orderkey", got.alias("r")).select("o_orderkey", "r.key", "r.state")


def strict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON texts, some with a key twice or cut off."""
    n = F.col("o_orderkey")
    body = F.when(n % 11 == 0, '{"a": {"b": 1, "b": 2}}').when(n % 13 == 0, '{"a": 1').when(n % 17 == 0, None).otherwise(F.concat(F.lit('{"a": 1, "b": '), n, F.lit("}")))
    return readers.duplicate_keys(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("t")), "o_orderkey", "t")


def _search(spark: SparkSession, sf_dir: str, piece: Column, around: tuple[str, str]) -> DataFrame:
    texts = _joined(table(spark, sf_dir, "part"), "p_brand", ["p_partkey"], piece, ",")
    return texts.select("p_brand", F.concat(F.lit(around[0]), "content", F.lit(around[1])).alias("content"))


def video_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as a search payload of videos with clocks or numbers as durations and marked titles."""
    k = F.col("p_partkey")
    clock = F.when(k % 2 == 0, F.concat(F.lit('"'), F.col("p_size"), F.lit(":05"), F.lit('"'))).otherwise(F.concat(F.col("p_size"), F.lit(".5")))
    piece = F.concat(F.lit('{"bvid": "BV'), F.lpad(k.cast("string"), 10, "0"), F.lit('", "title": "<em>'), F.replace("p_name", F.lit(" "), F.lit("</em> &amp;  ")), F.lit('", "author": "'), "p_type", F.lit('", "duration": '), clock, F.lit(', "arcurl": "https://v/'), k, F.lit('", "pubdate": '), k, F.lit("}"))
    return readers.search_candidates(_search(spark, sf_dir, piece, ('{"data": {"result": [', "]}}")), "bilibili", "p_brand", "content", 30)


def clip_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as a search payload of clips, of which some have no author and are passed over."""
    k = F.col("p_partkey")
    author = F.when(k % 5 == 0, "").otherwise(F.lower("p_type"))
    piece = F.concat(F.lit('{"id": "'), k, F.lit('", "desc": "'), F.when(k % 7 == 0, "").otherwise(F.col("p_name")), F.lit('", "author": {"unique_id": "'), author, F.lit('"}, "video": {"duration": '), "p_size", F.lit("}}"))
    return readers.search_candidates(_search(spark, sf_dir, piece, ('{"item_list": [', "]}")), "tiktok", "p_brand", "content", 20)


def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as pages of one work."""
    k = F.col("p_partkey")
    piece = F.concat(F.lit('{"cid": '), k, F.lit(', "page": '), "p_size", F.lit(', "part": "'), "p_name", F.lit('", "duration": '), "p_size", F.lit(".0}"))
    texts = _search(spark, sf_dir, piece, ("", "")).select("p_brand", F.concat(F.lit('{"data": {"bvid": "'), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit('", "pages": ['), "content", F.lit("]}}")).alias("content"))
    return readers.page_units(texts, "p_brand", "content")


def artifact_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as artifacts of one kind."""
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return writers.artifact_records(files, "document")


def json_line_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as JSON lines with a schema version, and read again."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("note"), F.lit(1).alias("schema_version"))
    path = fresh_dir(spark, "lines")
    writers.write_json_lines(rows, path)
    return readers.read_json_lines(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double, note string, schema_version int", (1,))


def job_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' snapshots, a folder each, written once and then read again with the folder's name."""
    path = fresh_dir(spark, "jobs")
    rows = table(spark, sf_dir, "nation").select(F.format_string("job_%03d", F.col("n_nationkey").cast("int")).alias("job"), F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    rows.repartition("job").write.partitionBy("job").text(path)
    read = spark.read.schema("n_nationkey long, n_name string").option("mode", "FAILFAST").json(path)
    written = writers.write_once(read.select("n_nationkey", "n_name"), f"{path}-once") and not writers.write_once(read.select("n_nationkey", "n_name"), f"{path}-once")
    return spark.read.parquet(f"{path}-once").withColumn("written_once", F.lit(written))


_NAMES = (subtitle_spans, speech_spans, span_lists, detector_points, lenient_replies, strict_documents, video_search, clip_search, page_parts, artifact_lineage, json_line_tables, job_folders)
QUERIES = {f.__name__: f for f in _NAMES}

_E = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM events)"

ORACLE_SQL = {
    "subtitle_spans": f"WITH {_E} SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id))::INTEGER AS span_no, ms AS start_ms, ms + 1500 AS end_ms, event_type || ' of ' || event_id AS text FROM e WHERE event_type <> 'error'",
    "speech_spans": f"""WITH {_E} SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS span_no, round_even(ms / 1000 * 1000, 0)::BIGINT AS start_ms, round_even((ms / 1000 + value) * 1000, 0)::BIGINT AS end_ms,
  event_type AS text FROM e WHERE event_type <> 'click'""",
    "span_lists": f"WITH {_E}, n AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS span_no FROM e) SELECT user_id, span_no, ms AS start_ms, ms + 2000 AS end_ms, event_type AS text FROM n WHERE event_type <> 'error'",
    "detector_points": f"WITH {_E} SELECT user_id, ms // 60000 * 60000 AS timestamp_ms, max(value) AS score FROM e GROUP BY ALL",
    "lenient_replies": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey END AS key, CASE WHEN o_orderkey % 4 < 3 THEN o_orderstatus END AS state FROM orders",
    "strict_documents": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'duplicate_key' ELSE 'invalid_json' END AS problem FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0",
    "video_search": """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INTEGER AS rank, 'BV' || lpad(p_partkey::VARCHAR, 10, '0') AS id FROM part)
SELECT p_brand, rank, 'bilibili:' || id AS candidate_id, id AS source_id, replace(p_name, ' ', ' & ') AS title, p_type AS author, CASE WHEN p_partkey % 2 = 0 THEN p_size * 60 + 5 ELSE p_size + 0.5 END::DOUBLE AS duration_seconds,
  'https://v/' || p_partkey AS url, CASE WHEN p_partkey > 0 THEN strftime(make_timestamp(p_partkey * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS published_at FROM p WHERE rank <= 30""",
    "clip_search": """WITH p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INTEGER AS rank, p_partkey::VARCHAR AS id, lower(p_type) AS author FROM part WHERE p_partkey % 5 <> 0)
SELECT p_brand, rank, 'tiktok:' || id AS candidate_id, id AS source_id, CASE WHEN p_partkey % 7 = 0 THEN id ELSE p_name END AS title, author, p_size::DOUBLE AS duration_seconds, 'https://www.tiktok.com/@' || author || '/video/' || id AS url, NULL::VARCHAR AS published_at FROM p WHERE rank <= 20""",
    "page_parts": "SELECT p_brand, replace(p_brand, '#', '') || ':p' || p_size || ':cid' || p_partkey AS media_unit_id, p_size AS part_index, p_name AS title, p_size::DOUBLE AS duration_seconds FROM part",
    "artifact_lineage": """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT 'artifact_' || substr(sha256('{"content_hash":"' || h || '","kind":"document"}'), 1, 24) AS artifact_id, 'document' AS kind, 'docs/' || doc_id || '.txt' AS path, h AS content_hash, 1 AS schema_version FROM d""",
    "json_line_tables": "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS note, 1 AS schema_version FROM orders",
    "job_folders": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, true AS written_once FROM nation",
}
