"""Structured Streaming: windows over events, verdicts on what is new, and idempotent sinks.

Each flow takes a streaming or a batch DataFrame of events (event_id, ts, user_id,
event_type, value): the plan is the same, and batch is what tests compare with.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The event files of a folder as a stream, so many a micro-batch."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def dated(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows that have a time; those without one are for a sink of their own (undated)."""
    return events.where(F.col(ts).isNotNull())


def undated(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.where(F.col(ts).isNull())


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and values by type in tumbling or sliding windows; rows later than the watermark are dropped by streams."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return dated(events).withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Each user's visits: runs of events no further apart than gap."""
    return dated(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count(F.lit(1)).alias("n")
    ).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """The first of each key while the watermark remembers it."""
    return dated(events).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


VERDICTS = "user_id long, event_id long, verdict string"


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Verdicts(StatefulProcessor):
    """The last content of a key and its time, until an event-time timer ends it."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "content string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        frame = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        content, at = self.last.get() if self.last.exists() else (None, None)
        before, out = at, []
        for event, new, ms in zip(frame["event_id"], frame["event_type"], frame["ts"].astype("datetime64[ms]").astype("int64"), strict=True):
            known = at is not None and ms - at <= self.ttl_ms
            out.append((key[0], event, "new" if not known else "duplicate" if new == content else "changed"))
            content, at = new, int(ms) if at is None else max(at, int(ms))
        if before is not None:
            self.handle.deleteTimer(before + self.ttl_ms)
        self.last.update((content, at))
        self.handle.registerTimer(at + self.ttl_ms)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "verdict"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64"), "verdict": pd.Series(dtype="object")})

    def close(self) -> None:
        pass


def verdicts(events: DataFrame, ttl: timedelta = timedelta(days=7), late: str = "1 day") -> DataFrame:
    """For each event of a stream whether its user is new, or its type changed or repeated.

    A user's last event is remembered for ttl of event time (in milliseconds); after that the user is new again, and
    a timer takes the state away once the watermark has passed, so that it holds the users of the last
    ttl + late only.  Rows of a user in one micro-batch are taken in the order of their time; a row that comes
    later than others but within the watermark is compared with what was last seen; events without a time
    or a user's key: the first have a way of their own (undated), the second are one user.  The
    state store is RocksDB, which this sets for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return dated(events).withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(
        _Verdicts(int(ttl / timedelta(milliseconds=1))), VERDICTS, "append", "EventTime"
    )


def verdicts_of_batch(events: DataFrame, ttl: timedelta = timedelta(days=7)) -> DataFrame:
    """The same over a table, as a window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    age = ms - F.lag(ms).over(w)
    known = F.coalesce(age <= int(ttl / timedelta(milliseconds=1)), F.lit(False))
    verdict = F.when(~known, "new").when(F.lag("event_type").over(w).eqNullSafe(F.col("event_type")), "duplicate").otherwise("changed")
    return dated(events).select("user_id", "event_id", verdict.alias("verdict"))


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off all that is there, into Parquet under path; a batch written twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
