"""Leases and jobs as streams with state and timers.

Heartbeats renew a lease; one that is not renewed in time expires by a timer of event
time, and the next heartbeat begins a new generation. Jobs are followed until their
terminal state has been seen twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shotloom.streaming.jobs import TERMINAL

LEASE_ROW = "key string, event string, generation int, owner string, at_ms long, expires_ms long"
FOLLOW_ROW = "job_id string, event string, seen int, state string, at_ms long, event_id string"


class LeaseProcessor(StatefulProcessor):
    """Acquired, renewed, refused and expired leases of a key.

    The holder's heartbeat renews; another owner's is refused while the lease lives. A
    heartbeat at or after the expiry begins the next generation, whoever sends it. Rows
    of a batch go by time, then owner. One that is older than the newest heartbeat of
    its key is late and answered as such.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "generation int, owner string, last_ms long, expires_ms long, expired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        said = pd.concat(list(rows)).sort_values(["at_ms", "owner"], kind="stable")
        held = self.lease.get() if self.lease.exists() else (0, None, -(1 << 62), -(1 << 62), True)
        out, before = [], held[3]
        for at, owner in zip(said["at_ms"].tolist(), said["owner"].tolist(), strict=True):
            generation, holder, last, expires, expired = held
            event = "late" if at < last else "acquired" if at >= expires else "renewed" if owner == holder else "refused"
            if event == "acquired" and generation and not expired:
                out.append((key[0], "expired", generation, holder, expires, expires))
            if event == "acquired":
                held = (generation + 1, owner, at, at + self.ttl_ms, False)
            elif event == "renewed":
                held = (generation, holder, at, at + self.ttl_ms, False)
            elif event == "refused":
                held = (generation, holder, at, expires, False)
            out.append((key[0], event, held[0], owner, at, held[3]))
        self.lease.update(held)
        if held[3] != before:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(held[3])
        yield pd.DataFrame(out, columns=[f.split()[0] for f in LEASE_ROW.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        generation, holder, last, expires, expired = self.lease.get()
        if not expired and expires <= expiredTimerInfo.getExpiryTimeInMs():
            self.lease.update((generation, holder, last, expires, True))
            yield pd.DataFrame([(key[0], "expired", generation, holder, expires, expires)], columns=[f.split()[0] for f in LEASE_ROW.split(", ")])

    def close(self) -> None:
        pass


def leases(beats: DataFrame, ttl_ms: int = 30_000) -> DataFrame:
    """Lease events of a stream of heartbeats (key, owner, at: event time with a watermark): LEASE_ROW.

    State is a row a key. Expiry comes with the watermark, so that a key that falls
    silent expires as soon as others move the time on. Needs a state store that keeps
    timers (RocksDB).
    """
    rows = beats.select(F.col("key").cast("string").alias("key"), "owner", "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=LeaseProcessor(ttl_ms), outputStructType=LEASE_ROW, outputMode="Append", timeMode="EventTime")


def lease_events(beats: DataFrame, ttl_ms: int = 30_000) -> DataFrame:
    """Batch: the generations of one owner's heartbeats (key, owner, at_ms): acquired and renewed as ``leases`` gives them."""
    order = Window.partitionBy("key").orderBy("at_ms", "owner")
    fresh = F.coalesce(F.col("at_ms") - F.lag("at_ms").over(order) >= ttl_ms, F.lit(True))
    rows = beats.withColumn("fresh", fresh)
    generation = F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    event = F.when(F.col("fresh"), "acquired").otherwise("renewed")
    return rows.select("key", event.alias("event"), generation.alias("generation"), "owner", "at_ms", (F.col("at_ms") + ttl_ms).alias("expires_ms"))


class FollowProcessor(StatefulProcessor):
    """A job's events until its terminal state has been seen twice; what comes after is not told.

    A worker that ends a job and one that finds it ended both say so; after the second
    word there is nothing to wait for, and the job is closed. Repeats of an event id
    do not count.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getListState("ends", "event_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        said = pd.concat(list(rows)).sort_values(["at_ms", "event_id"], kind="stable")
        seen = [r[0] for r in self.ends.get()] if self.ends.exists() else []
        out = []
        for at, event_id, state in zip(said["at_ms"].tolist(), said["event_id"].tolist(), said["state"].tolist(), strict=True):
            if len(seen) >= 2 or event_id in seen:
                continue
            if state in TERMINAL:
                seen.append(event_id)
            out.append((key[0], "closed" if len(seen) >= 2 else "told", len(seen), state, at, event_id))
        if seen:
            self.ends.put([(e,) for e in seen])
        yield pd.DataFrame(out, columns=[f.split()[0] for f in FOLLOW_ROW.split(", ")])

    def close(self) -> None:
        pass


def follow_jobs(events: DataFrame) -> DataFrame:
    """The events of each job (job_id, event_id, at, state) up to and with its second terminal one, as a stream: FOLLOW_ROW."""
    rows = events.where("state is not null").select("job_id", "event_id", "state", "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=FollowProcessor(), outputStructType=FOLLOW_ROW, outputMode="Append", timeMode="None")


def followed(events: DataFrame) -> DataFrame:
    """Batch: as ``follow_jobs`` over all events at once; repeats of an event id count once."""
    first = events.where("state is not null").groupBy("job_id", "event_id").agg(F.min(F.struct("at", "state")).alias("e"))
    order = Window.partitionBy("job_id").orderBy("at_ms", "event_id")
    rows = first.select("job_id", "event_id", "e.state", F.unix_millis("e.at").alias("at_ms"))
    seen = F.sum(F.col("state").isin(*TERMINAL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("seen", seen).withColumn("before", F.coalesce(F.lag("seen").over(order), F.lit(0))).where("before < 2")
    return rows.select("job_id", F.when(F.col("seen") >= 2, "closed").otherwise("told").alias("event"), "seen", "state", "at_ms", "event_id")
