"""Readers of the catalog's formats: versioned JSON and JSON lines, subtitles, detector logs, search payloads."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotloom.functions.scalars import clean_html, collapse_spaces, epoch_iso, json_clock, strip_spaces, subtitle_ms
from shotloom.session import broadcast_if_small, written

_HEAD = "__line"


def _guarded(rows: DataFrame, versions: tuple[int, ...]) -> DataFrame:
    """The same rows; one of an unsupported schema version is an error."""
    bad = ~F.coalesce(F.col("schema_version").isin(*versions), F.lit(False))
    error = F.raise_error(F.concat(F.lit("unsupported schema_version: "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null"))))
    return rows.withColumn("schema_version", F.when(bad, error.cast("int")).otherwise(F.col("schema_version")))


def read_json(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] | None = None) -> DataFrame:
    """One object per file; anything that does not fit the schema is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return _guarded(rows, versions) if versions else rows


def read_json_lines(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] | None = None, missing_ok: bool = False) -> DataFrame:
    """One object per line, blank lines skipped; with ``missing_ok`` a path that is not there is an empty table."""
    try:
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if missing_ok and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
    return _guarded(rows, versions) if versions else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in their order: file, line_no (from 1 in each file, blank lines count) and line.

    A split's lines come in order but do not know how many lie before their split, so
    the lines of each split are counted and the counts summed up over a file's splits;
    what is joined is one row a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = written(lines.withColumn("at", F.monotonically_increasing_id()), "lines")
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    line_no = F.col("at") - F.col("first") + F.col("before") + 1
    return lines.join(broadcast_if_small(written(splits, "splits")), ["file", "block"]).select("file", line_no.alias("line_no"), F.col("value").alias("line"))


def read_ordered_json_lines(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] | None = None) -> DataFrame:
    """As ``read_json_lines``, with file, line_no and ordinal (dense, from 1 in each file, over the lines that are not blank)."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    rows = lines.select("file", "line_no", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "line_no", "r.*")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("file").orderBy("line_no")))
    return _guarded(rows, versions) if versions else rows


def read_jobs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All job snapshots under ``root``/*/job.json by the folder's name, in ``folder``; one that does not fit is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{root.rstrip('/')}/*/job.json")
    return rows.withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).orderBy("folder")


def parse_subtitles(files: DataFrame, key: str, content: str, source: str = "subtitle") -> DataFrame:
    """Spans of subtitle texts: blocks parted by blank lines, numbered over those with a timing line and words.

    Returns key, span_no (from 1), start_ms, end_ms, text, source. Tags go, lines
    of a block are joined by a space.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(content), "^﻿", ""), r"\r\n?", "\n")
    blocks = files.select(key, F.posexplode(F.split(text, r"\n[ \t]*\n+")).alias("pos", "block"))
    timing = r"(\d+:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{3})"
    body = collapse_spaces(F.regexp_replace(F.regexp_extract("block", rf"(?s){timing}[^\n]*\n?(.*)$", 3), r"<[^>]*>|\{[^}]*\}", ""))
    start, end = subtitle_ms(F.regexp_extract("block", timing, 1)), subtitle_ms(F.regexp_extract("block", timing, 2))
    spans = blocks.select(key, "pos", start.alias("start_ms"), end.alias("end_ms"), body.alias("text")).where("start_ms is not null and text <> ''")
    return _dense(spans, key, "pos", "span_no").select(key, "span_no", "start_ms", "end_ms", "text", F.lit(source).alias("source"))


def _dense(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))


def asr_spans(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Recognised speech (start, end in seconds, text) as spans: blank texts go, numbers are dense, no confidence."""
    kept = rows.withColumn("text", strip_spaces(F.col("text"))).where("text <> ''")
    ms = lambda c: F.bround(F.col(c) * 1000).cast("long")
    return _dense(kept, key, order, "span_no").select(key, "span_no", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "text", F.lit(None).cast("double").alias("confidence"))


def lenient_spans(files: DataFrame, key: str, content: str) -> DataFrame:
    """Spans of JSON texts that are a list or hold one as ``segments``; numbers are the places in the input, bad rows go."""
    item = "array<struct<start: double, start_sec: double, end: double, end_sec: double, text: string>>"
    # An object would be taken for a list of itself.
    listed = F.when(F.col(content).rlike(r"^\s*\["), F.from_json(content, item)).otherwise(F.from_json(content, f"segments {item}")["segments"])
    rows = files.select(key, F.posexplode(listed).alias("pos", "s"))
    ms = lambda a, b: F.bround(F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}")) * 1000).cast("long")
    rows = rows.select(key, (F.col("pos") + 1).alias("span_no"), ms("start", "start_sec").alias("start_ms"), ms("end", "end_sec").alias("end_ms"), strip_spaces(F.col("s.text")).alias("text"))
    return rows.where("end_ms > start_ms and text <> ''")


def scene_points(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Detector log lines as (key, timestamp_ms, score): a time line and the score line after it; the best score of a time."""
    from pyspark.sql import Window

    time = F.regexp_extract(line, r"pts_time:\s*([0-9.]+)", 1).try_cast("double")
    score = F.regexp_extract(line, r"scene_score=\s*([0-9.]+)", 1).try_cast("double")
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(key, order, time.alias("t"), score.alias("score")).withColumn("t", F.last("t", True).over(window)).where("score is not null and t is not null")
    return rows.groupBy(key, F.bround(F.col("t") * 1000).cast("long").alias("timestamp_ms")).agg(F.max("score").alias("score"))


def lenient_json(x: Column, schema: str) -> Column:
    """A JSON object in a reply: without code fences, else the outermost braces; null if there is none."""
    bare = F.regexp_replace(x, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    parsed = lambda c: F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema))
    return F.coalesce(parsed(bare), parsed(F.regexp_extract(x, r"(?s)(\{.*\})", 1)))


def duplicate_keys(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, problem): JSON texts that do not parse or in which an object names a key twice."""

    def problem(text: str | None) -> str | None:
        def pairs(items: list[tuple[str, object]]) -> dict:
            if len({k for k, _ in items}) < len(items):
                raise KeyError("duplicate key")
            return dict(items)

        try:
            json.loads(text or "", object_pairs_hook=pairs)
        except KeyError:
            return "duplicate_key"
        except (ValueError, RecursionError):
            return "invalid_json"
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([problem(x.as_py()) for x in batch.column(1)], pa.string())], [key, "problem"])

    kinds = dict(rows.dtypes)
    return rows.select(key, content).mapInArrow(run, f"{key} {kinds[key]}, problem string").where("problem is not null")


#: Where each platform's search payload has its records and their fields (fixed values of the public payload shapes).
_AWEME = "struct<aweme_id: string, desc: string, author: struct<nickname: string>, video: struct<duration: double>, create_time: long>"
_NOTE = "note_id: string, display_title: string, title: string, user: struct<nickname: string>, video: struct<duration: double>, time: long"
_CLIP = "id: string, aweme_id: string, author: struct<unique_id: string, uniqueId: string>, desc: string, title: string, video: struct<duration: double>"
_ENTRY = "id: string, title: string, uploader: string, duration: double, webpage_url: string, timestamp: long"
_AWEMES = f"array<struct<aweme_info: {_AWEME}, aweme_detail: {_AWEME}, aweme_mix_info: {_AWEME}, {_AWEME[7:-1]}>>"
_CLIPS = f"array<struct<item: struct<{_CLIP}>, {_CLIP}>>"
#: Per platform: shapes of the payload as (schema, path of the records), the first that fits is read.
_SHAPES = {
    "bilibili": [("data struct<result: array<struct<bvid: string, title: string, author: string, duration: variant, arcurl: string, pubdate: long>>>", "data.result")],
    "douyin": [(f"data {_AWEMES}", "data"), (f"data struct<data: {_AWEMES}>", "data.data"), (f"data struct<items: {_AWEMES}>", "data.items")],
    "xiaohongshu": [(f"{where}items array<struct<id: string, note_card: struct<{_NOTE}>, {_NOTE}>>{end}", path) for where, end, path in (("data struct<", ">", "data.items"), ("", "", "items"))],
    "youtube": [(f"entries array<struct<{_ENTRY}>>", "entries")],
    "tiktok": [(f"{name} {_CLIPS}", name) for name in ("item_list", "items", "data")],
}


#: The form of the platforms' own ids (fixed values); another id is as good as none.
SOURCE_IDS = {"bilibili": r"^(?i:BV[0-9A-Za-z]{10})\z", "douyin": r"^\d{10,24}\z", "xiaohongshu": r"^[0-9a-f]{24}\z"}


def _record(platform: str) -> dict[str, Column]:
    """Fields of a candidate in a record ``r`` of the platform."""
    r = F.col("r")
    if platform == "bilibili":
        return {"source_id": r["bvid"], "title": r["title"], "author": r["author"], "seconds": json_clock(F.to_json(r["duration"])), "url": r["arcurl"], "published": r["pubdate"]}
    if platform == "youtube":
        return {"source_id": r["id"], "title": r["title"], "author": r["uploader"], "seconds": r["duration"], "url": r["webpage_url"], "published": r["timestamp"]}
    if platform == "douyin":
        first = lambda get: F.when(r["aweme_info"].isNotNull(), get(r["aweme_info"])).when(r["aweme_detail"].isNotNull(), get(r["aweme_detail"])).when(r["aweme_mix_info"].isNotNull(), get(r["aweme_mix_info"])).otherwise(get(r))
        return {"source_id": first(lambda x: x["aweme_id"]), "title": first(lambda x: x["desc"]), "author": first(lambda x: x["author"]["nickname"]), "seconds": first(lambda x: x["video"]["duration"]) / 1000, "published": first(lambda x: x["create_time"])}
    if platform == "xiaohongshu":
        first = lambda get: F.when(r["note_card"].isNotNull(), get(r["note_card"])).otherwise(get(r))
        return {"source_id": F.lower(F.coalesce(r["id"], r["note_id"], first(lambda x: x["note_id"]))), "title": first(lambda x: F.coalesce(x["display_title"], x["title"])), "author": first(lambda x: x["user"]["nickname"]), "seconds": first(lambda x: x["video"]["duration"]) / 1000, "published": first(lambda x: x["time"])}
    first = lambda get: strip_spaces(F.when(r["item"].isNotNull(), get(r["item"])).otherwise(get(r)))
    some = lambda *xs: F.coalesce(*(F.nullif(x, F.lit("")) for x in xs))
    source_id = first(lambda x: some(x["id"], x["aweme_id"]))
    seconds = F.when(r["item"].isNotNull(), r["item"]["video"]["duration"]).otherwise(r["video"]["duration"])
    return {"source_id": source_id, "title": F.coalesce(first(lambda x: some(x["desc"], x["title"])), source_id), "author": first(lambda x: some(x["author"]["unique_id"], x["author"]["uniqueId"])), "seconds": seconds}


def search_candidates(payloads: DataFrame, platform: str, key: str, content: str, limit: int = 20) -> DataFrame:
    """Candidates of search payloads: accepted records ranked densely in their order, ``limit`` at most.

    For tiktok a record without id or author is passed over. Elsewhere a record
    without an id is an error, for bilibili and youtube also one without a title;
    douyin and xiaohongshu works without one are titled by their id. Only records
    up to the last one ranked are looked at. A payload of none of the known
    shapes has no candidates.
    Returns key, rank, candidate_id, source_id, title, author, duration_seconds, url, published_at.
    """
    get = _record(platform)
    listed = F.coalesce(*(F.from_json(content, schema)[path] if "." not in path else F.from_json(content, schema)[path.split(".")[0]][path.split(".")[1]] for schema, path in _SHAPES[platform]))
    parsed = payloads.select(key, listed.alias("p")).select(key, F.posexplode("p").alias("pos", "r"))
    field = lambda name, kind: get[name].cast(kind) if name in get else F.lit(None).cast(kind)
    seconds, published = field("seconds", "double"), field("published", "long")
    title = F.nullif(clean_html(field("title", "string")), F.lit(""))
    url = field("url", "string")
    rows = parsed.select(key, "pos", F.nullif(field("source_id", "string"), F.lit("")).alias("source_id"), title.alias("title"), F.nullif(field("author", "string"), F.lit("")).alias("author"), F.when(seconds >= 0, seconds).alias("duration_seconds"), url.alias("url"), epoch_iso(published).alias("published_at"))
    if platform == "tiktok":
        rows = rows.where("source_id is not null and author is not null")
    rows = _dense(rows, key, "pos", "rank").where(F.col("rank") <= limit)
    if platform in ("douyin", "xiaohongshu"):
        rows = rows.withColumn("title", F.coalesce("title", F.concat(F.lit({"douyin": "抖音作品 ", "xiaohongshu": "小红书笔记 "}[platform]), "source_id")))
    if platform in SOURCE_IDS:
        formed = F.col("source_id").rlike(SOURCE_IDS[platform])
        rows = rows.withColumn("source_id", F.when(formed, F.col("source_id")))
    needed = {"douyin": ["source_id"], "xiaohongshu": ["source_id"], "tiktok": []}.get(platform, ["source_id", "title"])
    for name in needed:
        missing = F.raise_error(F.concat(F.lit(f"{platform} record without {name} in "), F.col(key).cast("string"))).cast("string")
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), missing).otherwise(F.col(name)))
    pages = {"douyin": ["https://www.douyin.com/video/"], "xiaohongshu": ["https://www.xiaohongshu.com/explore/"], "tiktok": ["https://www.tiktok.com/@", "author", "/video/"]}
    if platform in pages:
        rows = rows.withColumn("url", F.concat(*(F.col(x) if x == "author" else F.lit(x) for x in pages[platform]), "source_id"))
    return rows.select(key, "rank", F.concat(F.lit(f"{platform}:"), "source_id").alias("candidate_id"), "source_id", "title", "author", "duration_seconds", "url", "published_at")


def search_exhausted(payloads: DataFrame, platform: str, key: str, content: str, limit: int = 20) -> DataFrame:
    """(key, exhausted): whether a search has no more results.

    douyin and xiaohongshu say so themselves, with false or zero; bilibili gives the
    number of all results; for youtube and tiktok a payload with fewer than ``limit``
    candidates is the last.
    """
    said = {"douyin": "$.has_more", "xiaohongshu": "$.data.has_more"}
    if platform in said:
        return payloads.select(key, F.coalesce(F.get_json_object(content, said[platform]).isin("0", "0.0", "false"), F.lit(False)).alias("exhausted"))
    counted = search_candidates(payloads, platform, key, content, limit).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = F.get_json_object(content, "$.data.numResults").try_cast("long") if platform == "bilibili" else F.lit(None).cast("long")
    n = F.coalesce("n", F.lit(0))
    end = F.coalesce(F.col("total") <= n, F.lit(False)) if platform == "bilibili" else n < limit
    return payloads.select(key, total.alias("total")).distinct().join(counted, key, "left").select(key, end.alias("exhausted"))


def page_units(payloads: DataFrame, key: str, content: str) -> DataFrame:
    """Media units of a source with several pages: one each, named by source, page and part."""
    schema = "data struct<bvid: string, pages: array<struct<cid: long, page: int, part: string, duration: double>>>"
    rows = payloads.select(key, F.from_json(content, schema)["data"].alias("d")).select(key, F.col("d.bvid").alias("source_id"), F.explode("d.pages").alias("p"))
    unit = F.concat(F.col("source_id"), F.lit(":p"), F.col("p.page"), F.lit(":cid"), F.col("p.cid"))
    return rows.select(key, unit.alias("media_unit_id"), F.col("p.page").alias("part_index"), F.col("p.part").alias("title"), F.col("p.duration").alias("duration_seconds"))


def torn_files(spark: SparkSession, path: str) -> DataFrame:
    """(file) of line files whose last line has no newline: its lines, each with a newline, are longer than the file."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.octet_length("value").alias("n"))
    return lines.groupBy("file").agg(F.sum(F.col("n") + 1).alias("told"), F.max("size").alias("size")).where("told > size").select("file")


def read_event_log(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] | None = None) -> DataFrame:
    """Append-only JSON lines; a torn last line is an error, as is a line that does not fit the schema."""
    torn = torn_files(spark, path).limit(1).collect()
    if torn:
        raise ValueError(f"incomplete event line in {torn[0].file}")
    return read_json_lines(spark, path, schema, versions)


def list_sessions(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Sessions of all folders ``root``/ses_*/session.json with a valid name, the latest first."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(f"{root.rstrip('/')}/ses_*/session.json")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.where(folder.rlike("^ses_[A-Za-z0-9_-]{1,80}$")).orderBy(F.desc("created_at"), F.desc("session_id"))


def session_views(sessions: DataFrame, segments: DataFrame, warnings: DataFrame) -> DataFrame:
    """Sessions with their segments and warnings as arrays in order, and whether the frozen plan has its SHA-256.

    ``sessions``: session_id, plan (binary), plan_sha256; ``segments`` and
    ``warnings``: session_id, position, and columns of their own.
    """

    def listed(rows: DataFrame, name: str) -> DataFrame:
        own = F.struct("position", *(c for c in rows.columns if c not in ("session_id", "position")))
        return rows.groupBy("session_id").agg(F.sort_array(F.collect_list(own)).alias(name))

    out = sessions.withColumn("plan_valid", F.sha2("plan", 256).eqNullSafe(F.lower("plan_sha256")))
    for rows, name in ((segments, "segments"), (warnings, "warnings")):
        got = listed(rows, name)
        out = out.join(got, "session_id", "left").withColumn(name, F.coalesce(name, F.array().cast(got.schema[name].dataType)))
    return out


def load_contracts(spark: SparkSession, collection: str, plans: str, segment_schema: str, plan_schema: str) -> tuple[DataFrame, DataFrame]:
    """The segments of a collection input and their query plans; each segment must have one plan and each plan one segment.

    Both files hold one object; what does not fit the schemas is an error, as is
    a broken reference.
    """
    segments = read_json(spark, collection, f"segments array<struct<{segment_schema}>>").selectExpr("inline(segments)")
    planned = read_json(spark, plans, f"plans array<struct<{plan_schema}>>").selectExpr("inline(plans)")
    count = lambda rows, name: rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias(name))
    both = count(segments, "a").join(count(planned, "b"), "segment_id", "full_outer")
    broken = both.where("a is distinct from 1 or b is distinct from 1").limit(1).collect()
    if broken:
        raise ValueError(f"segment {broken[0].segment_id!r} does not stand once in both documents")
    return segments, planned


#: What is read of an external evidence package.
EVIDENCE = "frames array<struct<frame_id: string, timestamp_ms: long, path: string>>, transcript array<struct<start_ms: long, end_ms: long, text: string>>"


def evidence_packages(files: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """Frames and transcript spans of evidence packages (JSON text), numbered in order, with the SHA-256 of their package.

    A missing list or field, and a span without a positive length, is an error.
    """
    rows = files.select(key, F.sha2(content, 256).alias("package_sha256"), F.from_json(content, EVIDENCE, {"mode": "FAILFAST"}).alias("p"))

    def listed(name: str, bad: Column) -> DataFrame:
        error = F.raise_error(F.concat(F.lit(f"incomplete {name} in package "), F.col(key).cast("string")))
        whole = F.when(F.col(f"p.{name}").isNull(), error.cast(dict(rows.select(f"p.{name}").dtypes)[name])).otherwise(F.col(f"p.{name}"))
        out = rows.select(key, "package_sha256", F.posexplode(whole).alias("position", "x")).select(key, "package_sha256", "position", "x.*")
        return out.withColumn("position", F.when(F.coalesce(bad, F.lit(True)), error.cast("int")).otherwise(F.col("position")))

    frames = listed("frames", F.col("frame_id").isNull() | (F.col("timestamp_ms") < 0) | F.col("path").isNull())
    return frames, listed("transcript", F.col("text").isNull() | (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")))


def extracted_frames(files: DataFrame, key: str, content: str, prefix: str = "frame") -> DataFrame:
    """Frames of an extractor's list ({"frames": [{"timestamp_sec", "file"}]} as JSON text): key, frame_id, timestamp_seconds, relative_path.

    Frames are named by the prefix, _0001 and so on in their order. No frames, a frame without a
    file name or with a time that is not a number are an error.
    """
    rows = files.select(key, F.from_json(content, "frames array<struct<timestamp_sec: string, file: string>>", {"mode": "FAILFAST"})["frames"].alias("f"))
    error = F.raise_error(F.concat(F.lit("no timestamped frames in "), F.col(key).cast("string")))
    whole = F.when(F.size(F.coalesce("f", F.array().cast(dict(rows.dtypes)["f"]))) > 0, F.col("f")).otherwise(error.cast(dict(rows.dtypes)["f"]))
    out = rows.select(key, F.posexplode(whole).alias("pos", "x"))
    seconds = F.col("x.timestamp_sec").try_cast("double")
    sound = F.coalesce(seconds.isNotNull() & (F.col("x.file") != ""), F.lit(False))
    name = F.when(sound, F.format_string(f"{prefix}_%04d", F.col("pos") + 1)).otherwise(error.cast("string"))
    return out.select(key, name.alias("frame_id"), seconds.alias("timestamp_seconds"), F.concat(F.lit("frames/"), F.col("x.file")).alias("relative_path"))


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The rows of one version of a table, which no later version changes."""
    return spark.read.parquet(f"{root.rstrip('/')}/version={version}")
