"""Frames most registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campuspulse.functions.exprs import days_since
from campuspulse.operators import access, activity, frames
from campuspulse.sources import tables

MODULE_START = "1995-01-01 00:00:00"


def members(spark, d) -> DataFrame:
    return tables.enrollments(spark, d)


def user_hours(spark, d) -> DataFrame:
    """(user_id, hour, first_ts, last_ts, cnt, parts, seconds): the pre-aggregated click stream.

    Unused measures are pruned from the aggregate by the optimizer.
    """
    part = F.when(F.col("kind").isin(*tables.PARTICIPATION_KINDS), F.col("cnt")).otherwise(0)
    return activity.hourly(tables.activity(spark, d), parts=F.sum(part), seconds=F.sum("seconds"))


def hours(spark, d) -> DataFrame:
    """Hourly rows with the student's course, reduced before the join."""
    return user_hours(spark, d).join(members(spark, d).select("user_id", "course_id"), "user_id")


def dated_hours(spark, d) -> DataFrame:
    """Hourly rows that also carry the course window."""
    windows = tables.courses(spark, d).select("course_id", "start_at", "end_at")
    roster = members(spark, d).select("user_id", "course_id").join(windows, "course_id")
    return user_hours(spark, d).join(roster, "user_id")


def profile(spark, d) -> DataFrame:
    return frames.activity_profile(dated_hours(spark, d))


def user_totals(spark, d) -> DataFrame:
    """Views, participations and activity seconds per user."""
    part = F.col("kind").isin(*tables.PARTICIPATION_KINDS)
    return tables.activity(spark, d).groupBy("user_id").agg(
        F.sum("cnt").alias("page_views"),
        F.sum(F.when(part, F.col("cnt")).otherwise(0)).alias("participations"),
        F.sum("seconds").alias("total_activity_time"),
    )


def summaries(spark, d) -> DataFrame:
    """The same per (course, user)."""
    return user_totals(spark, d).join(members(spark, d).select("user_id", "course_id"), "user_id")


def completion(spark, d) -> DataFrame:
    start = F.lit(MODULE_START).cast("timestamp")
    return access.module_completion(tables.module_progress(spark, d), start)


def engagement(spark, d) -> DataFrame:
    """The full student feature table: one scan of the events, one of the module progress."""
    start = F.lit(MODULE_START).cast("timestamp")
    first = F.min("completed_at")
    modules = tables.module_progress_by_user(spark, d).groupBy("user_id").agg(
        F.coalesce(days_since(first, start), F.lit(0)).alias("first_module_day")
    )
    return frames.student_engagement_features(
        members(spark, d).select("course_id", "user_id", "final_score"), profile(spark, d), modules
    )


def basics(spark, d) -> DataFrame:
    """Activity basics per (course, user) with the final score."""
    roster = members(spark, d).select("user_id", "course_id", "final_score")
    return frames.activity_basics(user_hours(spark, d).join(roster, "user_id"), ("final_score",))


def all_students(spark, d) -> DataFrame:
    """Every enrolled student with score and basic activity features; zero, and no dominant time, where nothing was seen."""
    roster = members(spark, d).select("user_id", "course_id", "final_score")
    seen = basics(spark, d).drop("final_score", "first_activity_at", "last_activity_at")
    kinds = dict(seen.dtypes)
    joined = roster.join(seen, ["course_id", "user_id"], "left")
    filled = {c: F.coalesce(F.col(c), F.lit("none" if k == "string" else 0).cast(k)) for c, k in kinds.items() if c not in ("course_id", "user_id")}
    return joined.withColumns(filled)
