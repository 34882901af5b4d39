"""Scalar column expressions. Everything here stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS_MARK = 57.0
SESSION_GAP_HOURS = 1.0

# Slot order decides ties of the dominant time of day.
SLOTS = ("morning", "afternoon", "evening", "night")
DAY_TYPES = ("weekday", "weekend")


def parse_ts(text: Column) -> Column:
    """ISO timestamp with Z or numeric offset, or a plain date-time; bad text gives null."""
    return F.try_to_timestamp(text)


def to_local(ts: Column, tz: str) -> Column:
    """Wall-clock time in ``tz`` of a UTC instant."""
    return F.from_utc_timestamp(ts, tz)


def slot_of_day(ts: Column, evening_end: int = 24) -> Column:
    """Time-of-day slot. ``evening_end`` 24 leaves night 0-6, 22 makes night 22-6."""
    hour = F.hour(ts)
    return (
        F.when((hour >= 6) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 18), "afternoon")
        .when((hour >= 18) & (hour < evening_end), "evening")
        .otherwise("night")
    )


def day_type(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, "weekend").otherwise("weekday")


def day_block(ts: Column) -> Column:
    """One of eight blocks such as ``weekday_morning``."""
    return F.concat_ws("_", day_type(ts), slot_of_day(ts))


def hour_of_week(ts: Column) -> Column:
    """0-167, Monday midnight is 0."""
    return F.weekday(ts) * 24 + F.hour(ts)


def iso_week(ts: Column) -> Column:
    """ISO week number without the year."""
    return F.weekofyear(ts)


def micros_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def hours_between(later: Column, earlier: Column) -> Column:
    return micros_between(later, earlier) / F.lit(3_600_000_000.0)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days, floored towards minus infinity."""
    return F.floor(micros_between(later, earlier) / F.lit(86_400_000_000.0))


def days_since(later: Column, earlier: Column) -> Column:
    """Whole days, never below zero."""
    return F.greatest(F.lit(0).cast("long"), floor_days(later, earlier))


def course_id_from_url(url: Column) -> Column:
    return F.regexp_extract(url, r"/courses/(\d+)", 1).try_cast("long")


def url_in_course(url: Column, course_id: Column) -> Column:
    """Loose substring test; ``/courses/86`` also matches ``/courses/860``."""
    return F.contains(url, F.concat(F.lit("/courses/"), course_id.cast("string")))


def is_resource_url(url: Column) -> Column:
    return url.rlike(r"/(files|pages)/")


def failed(score: Column, nulls: str = "keep") -> Column:
    """1 below the pass mark. ``nulls``: keep (null), fail (counts as zero)."""
    if nulls not in ("keep", "fail"):
        raise ValueError(nulls)
    base = F.coalesce(score, F.lit(0.0)) if nulls == "fail" else score
    return F.when(base < PASS_MARK, 1).when(base.isNotNull(), 0)


def outcome(score: Column) -> Column:
    """Passed or Failed; a missing score has no outcome."""
    return F.when(score >= PASS_MARK, "Passed").when(score.isNotNull(), "Failed")


def valid_grade(score: Column) -> Column:
    return (score > 0) & (score <= 100)


def non_completer(score: Column) -> Column:
    return score == 0


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Zero when the denominator is zero or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def ratio_or_null(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), F.nullif(bottom, F.lit(0)).cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def role_of(enrollment_type: Column) -> Column:
    return (
        F.when(F.contains(enrollment_type, F.lit("Teacher")), "teacher")
        .when(F.contains(enrollment_type, F.lit("Ta")), "ta")
        .otherwise("other")
    )


def course_window(start: Column, end: Column, created: Column, as_of: Column) -> tuple[Column, Column]:
    """Start falls back to creation, then 120 days before ``as_of``; end to ``as_of``."""
    return (
        F.coalesce(start, created, as_of - F.expr("INTERVAL 120 DAYS")),
        F.coalesce(end, as_of),
    )


def course_days(start: Column, end: Column) -> Column:
    days = floor_days(end, start)
    return F.when(days > 0, days).otherwise(F.lit(120).cast("long"))


def course_weeks(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1.0), F.coalesce(floor_days(end, start) / 7.0, F.lit(15.0)))


def name_matches(name: Column, pattern: str) -> Column:
    return F.contains(F.lower(name), F.lit(pattern.lower()))


def shorten(text: Column, width: int = 30) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def engagement_composite(pv_level: Column, part_level: Column, late_pct: Column, missing_pct: Column) -> Column:
    zero = F.lit(0.0)
    return 25.0 * (
        pv_level * 0.3
        + part_level * 0.3
        + (1 - F.coalesce(late_pct, zero)) * 0.2
        + (1 - F.coalesce(missing_pct, zero)) * 0.2
    )


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def direction(r: Column) -> Column:
    return F.when(r > 0, "increases failure").otherwise("decreases failure")


def submission_status(submitted_at: Column, due_at: Column) -> Column:
    return (
        F.when(due_at.isNull(), "floating")
        .when(submitted_at.isNull(), "missing")
        .when(submitted_at <= due_at, "on_time")
        .otherwise("late")
    )


def risk_level(probability: Column) -> Column:
    """Right-closed bins; a probability of exactly zero has no level."""
    return (
        F.when((probability > 0) & (probability <= 0.3), "Low")
        .when((probability > 0.3) & (probability <= 0.5), "Medium")
        .when((probability > 0.5) & (probability <= 0.7), "High")
        .when((probability > 0.7) & (probability <= 1.0), "Critical")
    )


def seconds_to_minutes(s: Column) -> Column:
    return s / 60.0


def seconds_to_hours(s: Column) -> Column:
    return s / 3600.0


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; adding zero turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(name), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def flatten_struct(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Lift the fields of a struct column to the top level."""
    fields = df.schema[column].dataType.names
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, *[F.col(f"{column}.{f}").alias(f"{prefix}{f}") for f in fields])


def available(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted column names that exist, in the wanted order."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def feature_columns(df: DataFrame) -> list[str]:
    """Feature columns: not ids, targets or normalised copies."""
    skip = {"course_id", "user_id", "user_role", "final_score", "failed"}
    return [c for c in df.columns if c not in skip and not c.endswith("_norm")]
