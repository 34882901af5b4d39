"""Live sessions, alerts, trends and ingest over a file stream of click events.

State is keyed and small (an open window or session per key), lives in the
checkpoint folder, and survives restarts and lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from campuspulse.session import run_dir


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; new files join as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def click_stream(raw: DataFrame) -> DataFrame:
    """The click-stream columns of the raw event table; watermarks need a zoned timestamp."""
    return raw.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("resource_id"), F.col("value").alias("seconds"),
    )


def live_sessions(events: DataFrame, gap: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Closed sessions per student. Late events beyond the delay are dropped.

    Spark merges sessions inside each task first where
    ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` is on,
    which keeps a very active student's events out of the shuffle.
    """
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count("*").alias("n_events"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
        .select("user_id", "started_at", "ended_at", "n_events")
    )


def inactivity_alerts(events: DataFrame, idle: str = "72 hours", delay: str = "2 hours") -> DataFrame:
    """One row whenever a student has been silent for ``idle``.

    A silence is a session with that gap: the engine closes it by event time, so
    no timer code is needed.
    """
    return live_sessions(events, idle, delay).select(
        "user_id", F.col("ended_at").alias("last_seen"), F.col("n_events").alias("events_before")
    )


def trending(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Sliding view counts per resource.

    Events are counted in tumbling windows of one slide first; only those counts, not the events, enter several windows.
    """
    slides = events.withWatermark("ts", delay).groupBy(F.window("ts", slide).alias("s"), "resource_id").agg(F.count("*").alias("n"))
    return (
        slides.groupBy(F.window("s", length, slide).alias("w"), "resource_id")
        .agg(F.sum("n").alias("views"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "resource_id", "views")
    )


def hourly_feed(events: DataFrame, members: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling hourly counts per course for the heatmap, reduced to (user, hour) before they meet the static roster."""
    per_user = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour").alias("s"), "user_id").agg(F.count("*").alias("n"))
    return (
        per_user.join(members.select("user_id", "course_id"), "user_id")
        .groupBy(F.window("s", "1 hour").alias("w"), "course_id")
        .agg(F.sum("n").alias("cnt"))
        .select("course_id", F.col("w.start").alias("hour"), "cnt")
    )


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "2 hours") -> DataFrame:
    """Each event once, however often its file or row is delivered within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, out: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """Process everything that has arrived and stop; the checkpoint makes reruns pick up where this ended."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(out)
    query.awaitTermination()


def collect_available(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream into a fresh table of the shared folder and read that table."""
    spark = stream.sparkSession
    base = run_dir(spark, label)
    run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _distinct_hours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(user_id, hour, ts): the latest event of each user and hour of a batch of rows."""
    for batch in batches:
        rows = pa.table({"user_id": batch["user_id"], "hour": batch["hour"], "ts": batch["ts"]})
        yield from rows.group_by(["user_id", "hour"]).aggregate([("ts", "max")]).rename_columns(["user_id", "hour", "ts"]).to_batches()


HOURS_PER_BLOCK = 1024


class ActivityState(StatefulProcessor):
    """Distinct active hours and last event of a student, and a timer for silence.

    State is one bitmap per ``HOURS_PER_BLOCK`` hours that hold activity, one row of totals and one timer: every access is a call to the
    state server, so a batch makes two or three per student and block, not two per hour. A row goes out whenever new events change the totals and
    when the timer fires.
    """

    def __init__(self, min_hours: int, idle_hours: float):
        self.min_hours, self.idle = min_hours, int(idle_hours * 3_600_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("blocks", "block long", "seen binary")
        self.total = handle.getValueState("total", "active long, last long")

    def _row(self, key, active: int, last: int, inactive: int) -> pd.DataFrame:
        return pd.DataFrame({
            "user_id": [key[0]], "active_hours": [active], "last_us": [last], "alert_few_hours": [int(active < self.min_hours)], "alert_inactive": [inactive]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.total.exists()
        active, last = self.total.get() if known else (0, -(1 << 62))
        blocks: dict[int, int] = {}
        for part in rows:
            for hour in part["hour"].unique().tolist():
                block, bit = divmod(hour, HOURS_PER_BLOCK)
                blocks[block] = blocks.get(block, 0) | 1 << bit
            last = max(last, int(part["us"].max()))
        for block, seen in blocks.items():
            before = int.from_bytes(self.hours.getValue((block,))[0], "little") if known and self.hours.containsKey((block,)) else 0
            if seen & ~before:
                active += (seen & ~before).bit_count()
                self.hours.updateValue((block,), ((seen | before).to_bytes(HOURS_PER_BLOCK // 8, "little"),))
        self.total.update((active, last))
        for timer in list(self.handle.listTimers()) if known else []:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + self.idle)
        yield self._row(key, active, last, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        active, last = self.total.get()
        yield self._row(key, active, last, 1)

    def close(self) -> None:
        pass


def activity_scores(events: DataFrame, min_hours: int = 10, idle_hours: float = 72.0, delay: str = "2 hours") -> DataFrame:
    """Live alert rows of each student: active hours, last event, too few hours, silent for ``idle_hours`` of event time.

    Rows are reduced to (student, hour) inside each task before they are shuffled, so a very active account sends one row per hour and
    task. A batch touches the state of its own students only. Needs ``keyed_state``.
    """
    hours = events.where("ts is not null and user_id is not null").select("user_id", F.floor(F.unix_micros("ts") / 3_600_000_000).alias("hour"), "ts")
    kinds = dict(hours.dtypes)
    reduced = hours.mapInArrow(_distinct_hours, f"user_id {kinds['user_id']}, hour long, ts timestamp")
    keyed = reduced.withWatermark("ts", delay).select("user_id", "hour", F.unix_micros("ts").alias("us"), "ts").groupBy("user_id")
    out = keyed.transformWithStateInPandas(
        ActivityState(min_hours, idle_hours), f"user_id {kinds['user_id']}, active_hours long, last_us long, alert_few_hours int, alert_inactive int", "Append", "EventTime")
    return out.select("user_id", "active_hours", F.timestamp_micros("last_us").alias("last_ts"), "alert_few_hours", "alert_inactive")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in the store that keyed state with timers needs."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def rescore_alerts(events: DataFrame, alerts: str, checkpoint: str, min_hours: int = 10, idle_hours: float = 72.0) -> None:
    """Re-score the students of everything that has arrived; a rerun with the same checkpoint goes on where this ended."""
    with keyed_state(events.sparkSession):
        run_available(activity_scores(events, min_hours, idle_hours), alerts, checkpoint)


def latest_alerts(spark: SparkSession, alerts: str) -> DataFrame:
    """The newest alert row of each student: hours and last event only grow, and a timer's row follows its events' row."""
    row = F.struct("active_hours", "last_ts", "alert_inactive", "alert_few_hours")
    return spark.read.parquet(alerts).groupBy("user_id").agg(F.max(row).alias("r")).select("user_id", "r.*")
