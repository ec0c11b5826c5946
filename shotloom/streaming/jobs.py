"""Job events as streams: current states with attempt fencing, change feeds and the operation ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shotloom.schemas import EVENT
from shotloom.sources.versions import VersionedTables

#: States that end a job (fixed values).
TERMINAL = ("succeeded", "failed", "cancelled", "interrupted")


def event_stream(spark: SparkSession, path: str, late: str = "1 hour", files_at_once: int = 100) -> DataFrame:
    """Events of JSON-lines files as they come, with event time and a watermark."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).json(path)
    return rows.withColumn("at", F.to_timestamp("occurred_at")).withWatermark("at", late)


def first_operations(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Each event once: repeats within the watermark are dropped, state for older ones is freed."""
    return events.dropDuplicatesWithinWatermark([key])


def counts_by_window(events: DataFrame, length: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by type in windows of event time; a window closes when the watermark has passed it."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    return events.groupBy(window, "type").count().select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "count")


def states_of(events: DataFrame) -> DataFrame:
    """Batch: the latest state of each job; updates of an attempt older than one already seen do not count.

    Events carry state, stage and attempt in ``data``; attempts are numbers.
    """
    rows = events.select("job_id", F.to_timestamp("occurred_at").alias("at"), "event_id", F.col("data")["state"].alias("state"), F.col("data")["stage"].alias("stage"), F.col("data")["attempt"].cast("int").alias("attempt"))
    rows = rows.where("state is not null")
    return rows.groupBy("job_id").agg(F.max(F.struct("attempt", "at", "event_id", "state", "stage")).alias("s")).select("job_id", "s.attempt", "s.at", "s.event_id", "s.state", "s.stage")


def merge_states(held: DataFrame, new: DataFrame) -> DataFrame:
    """Held and new states of jobs, the later attempt and time of each."""
    both = held.unionByName(new)
    return both.groupBy("job_id").agg(F.max(F.struct("attempt", "at", "event_id", "state", "stage")).alias("s")).select("job_id", "s.attempt", "s.at", "s.event_id", "s.state", "s.stage")


def keep_states(events: DataFrame, root: str, checkpoint: str, n_buckets: int = 64, keep: int = 10) -> StreamingQuery:
    """Fold a stream of events into the versioned table ``states`` under ``root``, until what is there is done.

    Jobs are dealt into buckets by a hash; a batch reads and rewrites the buckets of its
    own jobs only. A version notes the batch that it holds, so that a batch that is
    run again changes nothing. Versions before the last ``keep`` are deleted.
    """

    def fold(batch: DataFrame, number: int) -> None:
        tables = VersionedTables(batch.sparkSession, root)
        version = tables.latest()
        if tables.commit_of(version)["notes"].get("batch", -1) >= number:
            return
        bucket = F.pmod(F.xxhash64("job_id"), F.lit(n_buckets)).cast("int")
        new = states_of(batch).persist()
        try:
            touched = sorted(r.bucket for r in new.select(bucket.alias("bucket")).distinct().collect())  # at most n_buckets
            held = tables.read("states", version, touched)
            merged = new if held is None else merge_states(held, new)
            tables.commit(version, buckets={"states": (merged.withColumn("bucket", bucket), "bucket", touched)}, notes={"batch": number})
        finally:
            new.unpersist()
        if number % keep == keep - 1:
            tables.vacuum(keep)

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_states(spark: SparkSession, root: str) -> DataFrame | None:
    """The states that ``keep_states`` has committed last; None before the first batch."""
    return VersionedTables(spark, root).read("states")


def state_changes(events: DataFrame) -> DataFrame:
    """Batch: events at which a job's (state, stage) differs from before, up to and with its first terminal state."""
    from pyspark.sql import Window

    order = Window.partitionBy("job_id").orderBy("at", "event_id")
    rows = events.select("job_id", "event_id", F.to_timestamp("occurred_at").alias("at"), F.col("data")["state"].alias("state"), F.col("data")["stage"].alias("stage")).where("state is not null")
    now, before = F.struct("state", "stage"), F.lag(F.struct("state", "stage")).over(order)
    ended = F.coalesce(F.max(F.col("state").isin(*TERMINAL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"__new": ~now.eqNullSafe(before), "__ended": ended})
    return rows.where("__new and __ended = 0").select("job_id", "event_id", "at", "state", "stage")
