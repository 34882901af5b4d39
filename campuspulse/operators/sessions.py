"""Gaps between events and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campuspulse.functions.exprs import SESSION_GAP_HOURS, hours_between
from campuspulse.operators.activity import KEYS
from campuspulse.operators.ranks import lag_in_chunks

SESSION_COLUMNS = [
    "session_count", "session_gap_min", "session_gap_max", "session_gap_mean",
    "session_gap_std", "session_regularity", "sessions_per_week",
]


def event_gaps(events: DataFrame, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """Hours since the same student's previous event, one row per event.

    Lagging a whole student in one task would break on a very active account, so
    the lag runs minute by minute and the first event of a minute takes the last
    event of the active minute before it.
    """
    lagged = lag_in_chunks(events, [key], ["ts", order], "ts", F.date_trunc("minute", "ts"), "_prev")
    return lagged.withColumn("gap_hours", hours_between(F.col("ts"), F.col("_prev"))).drop("_prev")


def with_bucket_gaps(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Gap in hours between a bucket's first event and the previous bucket's last one."""
    w = Window.partitionBy(*keys).orderBy("hour")
    return buckets.withColumn("gap", hours_between(F.col("first_ts"), F.lag("last_ts").over(w)))


def regularity(mean: Column, std: Column) -> Column:
    raw = F.try_divide(std, mean)
    return F.when(mean > 0, F.least(F.greatest(1 - raw, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def session_features(
    buckets: DataFrame,
    weeks: Column | float,
    keys: list[str] | None = None,
    gap_hours: float = SESSION_GAP_HOURS,
) -> DataFrame:
    """Seven regularity features per student; fewer than two events give zeros.

    ``buckets`` is the hourly table, or ``gap_buckets`` for another threshold.
    """
    keys = keys or KEYS
    weeks = weeks if isinstance(weeks, Column) else F.lit(float(weeks))
    gaps = with_bucket_gaps(buckets, keys)
    inter = F.when(F.col("gap") >= gap_hours, F.col("gap"))
    zero = F.lit(0.0)
    stats = gaps.groupBy(*keys).agg(
        F.sum("cnt").alias("_n"),
        F.count(inter).alias("_inter"),
        F.min(inter).alias("_min"),
        F.max(inter).alias("_max"),
        F.avg(inter).alias("_mean"),
        F.stddev_pop(inter).alias("_std"),
    )
    count = F.when(F.col("_n") >= 2, F.col("_inter") + 1).otherwise(0)
    mean, std = F.coalesce("_mean", zero), F.coalesce("_std", zero)
    return stats.select(
        *keys,
        count.alias("session_count"),
        F.coalesce("_min", zero).alias("session_gap_min"),
        F.coalesce("_max", zero).alias("session_gap_max"),
        mean.alias("session_gap_mean"),
        std.alias("session_gap_std"),
        regularity(mean, std).alias("session_regularity"),
        F.coalesce(F.try_divide(count.cast("double"), weeks), zero).alias("sessions_per_week"),
    )


def sessions(buckets: DataFrame, keys: list[str] | None = None, gap_hours: float = SESSION_GAP_HOURS) -> DataFrame:
    """One row per session: start, end, event count."""
    keys = keys or KEYS
    running = Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("gap").isNull() | (F.col("gap") >= gap_hours), 1).otherwise(0)
    return (
        with_bucket_gaps(buckets, keys)
        .withColumn("session_no", F.sum(opens).over(running))
        .groupBy(*keys, "session_no")
        .agg(
            F.min("first_ts").alias("started_at"),
            F.max("last_ts").alias("ended_at"),
            F.sum("cnt").alias("n_events"),
        )
    )


def raw_gap_features(hours: DataFrame, keys: list[str] | None = None, min_gap: float = 0.5) -> DataFrame:
    """Gaps between active hours longer than ``min_gap``: mean, population std, span."""
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy("hour")
    gap = hours_between(F.col("hour"), F.lag("hour").over(w))
    long_gap = F.when(F.col("_gap") > min_gap, F.col("_gap"))
    return (
        hours.withColumn("_gap", gap)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.avg(long_gap), F.lit(0.0)).alias("avg_gap_hours"),
            F.coalesce(F.stddev_pop(long_gap), F.lit(0.0)).alias("gap_std_hours"),
            F.floor(hours_between(F.max("hour"), F.min("hour")) / 24).alias("activity_span_days"),
        )
    )
