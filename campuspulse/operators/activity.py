"""Hourly pre-aggregation: the one shuffle that touches raw events.

Raw events are reduced to (student, hour) rows before anything else happens.
The partial aggregate runs on the map side, so an account holding a third of all
events sends at most one row per active hour and task, and everything
downstream works on at most 8,760 rows per student and year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campuspulse.functions.exprs import SESSION_GAP_HOURS, micros_between, to_local

KEYS = ["course_id", "user_id"]


def expand_counts(events: DataFrame) -> DataFrame:
    """One row per counted view. Weighted aggregates are cheaper and are used everywhere else."""
    return (
        events.where("cnt > 0")
        .withColumn("ts", F.explode(F.array_repeat("ts", F.col("cnt").cast("int"))))
        .withColumn("cnt", F.lit(1))
    )


def hourly(events: DataFrame, keys: list[str] | None = None, tz: str | None = None, **extra) -> DataFrame:
    """(keys, hour, first_ts, last_ts, cnt, ...extra aggregates) from event rows.

    ``tz`` converts UTC instants to that wall clock first. ``extra`` maps an output
    name to an aggregate column.
    """
    keys = keys or ["user_id"]
    rows = events.where("ts is not null and cnt > 0")
    if tz:
        rows = rows.withColumn("ts", to_local(F.col("ts"), tz))
    return rows.groupBy(*keys, F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sum("cnt").alias("cnt"),
        *[agg.alias(name) for name, agg in extra.items()],
    )


def gap_buckets(events: DataFrame, keys: list[str] | None = None, gap_hours: float = SESSION_GAP_HOURS) -> DataFrame:
    """Events reduced to buckets as wide as the session gap.

    Two events of one bucket lie less than ``gap_hours`` apart, so every session
    boundary falls between buckets and the reduction loses none of them.
    """
    keys = keys or ["user_id"]
    width = int(gap_hours * 3_600_000_000)
    bucket = F.floor(F.unix_micros("ts") / F.lit(width)).alias("hour")
    return (
        events.where("ts is not null and cnt > 0")
        .groupBy(*keys, bucket)
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("cnt").alias("cnt"))
    )


def total_span_days(first=None, last=None):
    first = F.min("first_ts") if first is None else first
    last = F.max("last_ts") if last is None else last
    return F.floor(micros_between(last, first) / F.lit(86_400_000_000.0))


def daily_activity(events: DataFrame, members: DataFrame, participation_kinds: tuple[str, ...]) -> DataFrame:
    """Views and participations per course and day; reduced to (student, day) before the join."""
    part = F.when(F.col("kind").isin(*participation_kinds), F.col("cnt")).otherwise(0)
    per_student = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sum("cnt").alias("views"), F.sum(part).alias("participations")
    )
    return (
        per_student.join(members.select("user_id", "course_id"), "user_id")
        .groupBy("course_id", "day")
        .agg(F.sum("views").alias("views"), F.sum("participations").alias("participations"))
    )
