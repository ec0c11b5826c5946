"""Evidence of a video: contact sheets, model windows, motion summaries, probes, registered sources, range and asset audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.scalars import escape_html

#: What is read of a media probe.
PROBE = "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string, width: int, height: int, duration: string, tags: map<string, string>>>"


def contact_sheets(frames: DataFrame, key: str, at: str, frame_id: str, rows: int = 3, columns: int = 3) -> DataFrame:
    """Frames in time order, dealt into sheets of rows x columns cells: sheet_id, its cells' ids in order, and its time range."""
    size = rows * columns
    place = F.row_number().over(Window.partitionBy(key).orderBy(at, frame_id)) - 1
    dealt = frames.withColumns({"__sheet": (F.floor(place / size) + 1).cast("int"), "__cell": (place % size).cast("int")})
    cells = F.sort_array(F.collect_list(F.struct("__cell", frame_id)))
    out = dealt.groupBy(key, "__sheet").agg(cells.alias("__c"), F.min(at).alias("first_ms"), F.max(at).alias("last_ms"), F.count(F.lit(1)).alias("n_cells"))
    ids = F.array_join(F.transform("__c", lambda c: c[frame_id].cast("string")), ",")
    return out.select(key, F.format_string("sheet_%04d", "__sheet").alias("sheet_id"), "first_ms", "last_ms", "n_cells", ids.alias("frame_ids"))


def evidence_windows(videos: DataFrame, parts: dict[str, tuple[DataFrame, str, str]], key: str, end: str) -> DataFrame:
    """One window of full length a video, with the ids of each kind of evidence in order, joined by commas.

    ``parts``: name -> (rows, id column, order column); a kind without rows is empty.
    """
    out = videos.select(key, F.lit("window_0001").alias("window_id"), F.lit(0).cast("long").alias("start_ms"), F.col(end).alias("end_ms"))
    for name, (rows, row_id, order) in parts.items():
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, row_id))), lambda x: x[row_id].cast("string")), ",")
        out = out.join(rows.groupBy(key).agg(listed.alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def motion_summaries(pairs: DataFrame, key: str, order: list[str], dx: str, dy: str, scale: str, others: list[str] = ()) -> DataFrame:
    """Per shot the medians of its frame pairs' measures, turns of direction and the shape of the speed over time.

    A turn is a negative product of neighbouring vectors of which both are fast
    (0.005). The shape is variable with any turn, else it compares the mean speed
    of the first half with the rest; one pair alone is unknown.
    """
    window = Window.partitionBy(key).orderBy(*order)
    speed = F.round(F.hypot(dx, dy) + F.abs(scale), 6)
    raw = F.hypot(dx, dy) + F.abs(scale)
    rows = pairs.withColumns({"__speed": speed, "__raw": raw, "__no": F.row_number().over(window), "__n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    product = F.lit(0.0)
    for c in (dx, dy, scale):
        product += F.col(c) * F.lag(c).over(window)
    turn = (F.col("__raw") >= 0.005) & (F.lag("__raw").over(window) >= 0.005) & (product < 0)
    rows = rows.withColumns({"__turn": F.coalesce(turn, F.lit(False)), "__early": F.col("__no") <= F.greatest(F.lit(1), F.floor(F.col("__n") / 2))})
    medians = [F.median(c).alias(f"median_{c}") for c in (dx, dy, scale, *others)]
    early, late = F.avg(F.when(F.col("__early"), F.col("__speed"))), F.avg(F.when(~F.col("__early"), F.col("__speed")))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_pairs"), *medians, F.count_if("__turn").alias("n_turns"), F.median("__speed").alias("__m"), (late - early).alias("__d"))
    least = F.greatest(F.lit(0.002), F.col("__m") * 0.2)
    shape = F.when(F.col("n_pairs") < 2, "unknown").when(F.col("n_turns") > 0, "variable").when(F.col("__d") > least, "accelerating").when(-F.col("__d") > least, "decelerating").otherwise("constant")
    return out.withColumn("profile", shape).drop("__m", "__d")


def probe_facts(probes: DataFrame, key: str, content: str) -> DataFrame:
    """Facts of media probes (JSON text): duration_ms, size of the first video stream, numbers of audio and subtitle streams.

    The duration is the container's, else the longest stream's. A probe without a
    video stream has no size.
    """
    rows = probes.withColumn("__p", F.from_json(content, PROBE, {"mode": "FAILFAST"}))
    kind = lambda name: F.filter("__p.streams", lambda s: s["codec_type"] == name)
    video = F.try_element_at(kind("video"), F.lit(1))
    longest = F.array_max(F.transform("__p.streams", lambda s: s["duration"].try_cast("double")))
    seconds = F.coalesce(F.col("__p.format.duration").try_cast("double"), longest)
    count = lambda name: F.greatest(F.lit(0), F.size(kind(name)))
    return rows.select(key, F.bround(seconds * 1000).cast("long").alias("duration_ms"), video["width"].alias("width"), video["height"].alias("height"), count("audio").alias("n_audio"), count("subtitle").alias("n_subtitles"))


def choose_stream(probes: DataFrame, key: str, content: str, languages: tuple[str, ...], codecs: tuple[str, ...] = ("subrip", "ass", "webvtt", "mov_text")) -> DataFrame:
    """Per probe the text stream to read: the first of the preferred languages, else the first; none without text streams."""
    rows = probes.select(key, F.posexplode(F.from_json(content, PROBE, {"mode": "FAILFAST"})["streams"]).alias("stream", "s"))
    text = rows.where((F.col("s.codec_type") == "subtitle") & F.col("s.codec_name").isin(*codecs)).withColumn("language", F.col("s.tags")["language"])
    place = F.coalesce(*(F.when(F.col("language") == x, F.lit(k)) for k, x in enumerate(languages)), F.lit(len(languages)))
    least = F.min(F.struct(place.alias("place"), "stream", "language")).alias("m")
    return text.groupBy(key).agg(least).select(key, "m.stream", "m.language")


def register_sources(files: DataFrame, content: Column, order: str) -> DataFrame:
    """One row for each content: source_id (``video_`` and 24 digits of its SHA-256), its first row and the number of copies."""
    rows = files.select(F.sha2(content, 256).alias("content_sha256"), F.col(order))
    out = rows.groupBy("content_sha256").agg(F.min(order).alias("first_seen"), F.count(F.lit(1)).alias("n_copies"))
    return out.withColumn("source_id", F.concat(F.lit("video_"), F.substring("content_sha256", 1, 24)))


def asset_imports(fetched: DataFrame, asset_id: str, content: Column, declared_sha256: Column, declared_bytes: Column, extension: Column) -> DataFrame:
    """Where fetched content belongs (``assets/<two digits>/<sha256>.<extension>``) and whether it is as declared; null declares nothing."""
    digest, size = F.sha2(content, 256), F.octet_length(content)
    state = F.when(~F.coalesce(F.lower(declared_sha256) == digest, F.lit(True)), "hash_mismatch").when(~F.coalesce(declared_bytes == size, F.lit(True)), "size_mismatch").otherwise("verified")
    path = F.concat(F.lit("assets/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit("."), extension)
    return fetched.select(asset_id, path.alias("path"), size.cast("long").alias("n_bytes"), state.alias("state"))


def range_audit(ranges: DataFrame, clip: str, start: str, end: str) -> DataFrame:
    """Rows (clip, problem) of export ranges: duplicate, negative_start or not_half_open; a null bound is missing_bound."""
    out = ranges.groupBy(clip).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col(start).isNull() | F.col(end).isNull()).alias("null"),
        F.bool_or(F.col(start) < 0).alias("negative"),
        F.bool_or(F.col(end) <= F.col(start)).alias("empty"),
    )
    problems = F.array(F.when(F.col("n") > 1, "duplicate"), F.when(F.col("null"), "missing_bound"), F.when(F.col("negative"), "negative_start"), F.when(F.col("empty"), "not_half_open"))
    return out.select(clip, F.explode(F.array_compact(problems)).alias("problem"))


def invalidated(checkpoints: DataFrame, retries: DataFrame, key: str, stage: str, stages: tuple[str, ...]) -> DataFrame:
    """Checkpoints with ``valid``: false from the stage on that a retry of the key names; an unknown stage invalidates none.

    ``retries``: key, from_stage; of several the earliest stage counts.
    """
    number = lambda c: F.nullif(F.array_position(F.array(*(F.lit(s) for s in stages)), c), F.lit(0))
    first = retries.groupBy(key).agg(F.min(number(F.col("from_stage"))).alias("__from"))
    joined = checkpoints.join(first, key, "left")
    return joined.withColumn("valid", ~F.coalesce(number(F.col(stage)) >= F.col("__from"), F.lit(False))).drop("__from")


def html_report(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each row as a table row of HTML, values escaped; null is empty."""
    cells = F.concat(*(F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns))
    return rows.select(key, F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("html"))
