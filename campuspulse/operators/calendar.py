"""Time-of-day, day-type and hour-of-week features from the hourly table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campuspulse.functions.exprs import DAY_TYPES, SLOTS, day_block, hour_of_week, hours_between, iso_week, safe_ratio, slot_of_day
from campuspulse.operators.activity import KEYS

WEEK_SLOTS = 168
BLOCKS = [f"{d}_{s}" for d in DAY_TYPES for s in SLOTS]


def cnt_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("cnt")).otherwise(0))


def time_of_day(hours: DataFrame, evening_end: int = 24, keys: list[str] | None = None) -> DataFrame:
    """Views per slot, dominant slot and slot flags. Every tied slot keeps its flag."""
    keys = keys or KEYS
    slotted = hours.withColumn("_slot", slot_of_day(F.col("hour"), evening_end))
    counts = slotted.groupBy(*keys).agg(
        *[cnt_if(F.col("_slot") == s).alias(f"{s}_activity") for s in SLOTS],
        F.count("*").alias("unique_active_hours"),
    )
    return with_dominant(counts)


def dominant_slot(columns: dict[str, Column]) -> Column:
    """Name of the largest slot; the first in slot order wins ties; 'none' without activity."""
    best = F.greatest(*columns.values())
    name = F.when(best <= 0, "none")
    for slot, value in columns.items():
        name = name.when(value == best, slot)
    return name


def with_dominant(df: DataFrame) -> DataFrame:
    cols = {s: F.col(f"{s}_activity") for s in SLOTS}
    best = F.greatest(*cols.values())
    total = sum(list(cols.values())[1:], cols["morning"])
    dominant = dominant_slot(cols)

    def tops(slot):
        return F.when((best > 0) & (cols[slot] == best), 1).otherwise(0)

    def strong(slot):
        return F.when((F.col("dominant_time") == slot) & (cols[slot] > 0.4 * total), 1).otherwise(0)

    return df.withColumn("dominant_time", dominant).withColumns(
        {
            "is_morning_studier": tops("morning"),
            "is_evening_studier": tops("evening"),
            "strong_morning": strong("morning"),
            "strong_evening": strong("evening"),
        }
    )


def time_shares(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of views per slot, night 0-6."""
    keys = keys or KEYS
    slot = slot_of_day(F.col("hour"))
    return hours.groupBy(*keys).agg(
        *[safe_ratio(cnt_if(slot == s), F.sum("cnt")).alias(f"{s}_share") for s in SLOTS]
    )


def block_shares(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Share of views in each of the eight day-type x slot blocks."""
    keys = keys or KEYS
    marked = hours.withColumn("_block", day_block(F.col("hour")))
    return marked.groupBy(*keys).agg(
        *[safe_ratio(cnt_if(F.col("_block") == b), F.sum("cnt")).alias(f"{b}_pct") for b in BLOCKS]
    )


def week_block_shares() -> dict[str, Column]:
    """Per-week shares whose spread over the weeks measures consistency."""
    total = F.sum("cnt")
    return {
        "weekday_morning": safe_ratio(cnt_if(F.col("_block") == "weekday_morning"), total),
        "weekday_afternoon": safe_ratio(cnt_if(F.col("_block") == "weekday_afternoon"), total),
        "weekend_total": safe_ratio(cnt_if(F.startswith(F.col("_block"), F.lit("weekend"))), total),
    }


def block_weekly_sd(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Population std of weekly block shares; zero with fewer than two active weeks."""
    keys = keys or KEYS
    shares = week_block_shares()
    weekly = (
        hours.withColumn("_block", day_block(F.col("hour")))
        .groupBy(*keys, iso_week(F.col("hour")).alias("week"))
        .agg(*[c.alias(n) for n, c in shares.items()])
    )
    return weekly.groupBy(*keys).agg(
        *[F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias(f"{n}_sd") for n in shares]
    )


def hour_heatmap(hours: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Views per (course, weekday, hour); Monday is 0."""
    return hours.groupBy(
        *(by or ["course_id"]), F.weekday("hour").alias("dow"), F.hour("hour").alias("hour_of_day")
    ).agg(F.sum("cnt").alias("cnt"))


def heatmap_matrix(heatmap: DataFrame) -> DataFrame:
    """Long heatmap as one row per (course, hour) with a column per weekday."""
    return (
        heatmap.groupBy("course_id", "hour_of_day")
        .pivot("dow", list(range(7)))
        .agg(F.sum("cnt"))
        .select(
            "course_id", "hour_of_day",
            *[F.coalesce(F.col(str(d)), F.lit(0)).alias(f"dow_{d}") for d in range(7)],
        )
    )


def dct_terms(n_coefs: int = 12) -> list[Column]:
    """Weighted sums of the orthonormal DCT-II basis over the 168 hours of the week."""
    slot = hour_of_week(F.col("hour"))
    terms = []
    for k in range(n_coefs):
        scale = math.sqrt((1 if k == 0 else 2) / WEEK_SLOTS)
        angle = F.lit(math.pi * k / (2 * WEEK_SLOTS)) * (2 * slot + 1)
        terms.append(F.sum(F.col("cnt") * F.cos(angle) * F.lit(scale)))
    return terms


def dct_rhythm(hours: DataFrame, n_coefs: int = 12, keys: list[str] | None = None) -> DataFrame:
    """First DCT coefficients of the student's weekly activity profile."""
    return hours.groupBy(*(keys or KEYS)).agg(
        *[(t / F.sum("cnt")).alias(f"dct_coef_{k}") for k, t in enumerate(dct_terms(n_coefs))]
    )


def time_concentration(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of squared shares over the 24 hours of the day."""
    keys = keys or KEYS
    by_hour = hours.groupBy(*keys, F.hour("hour").alias("h")).agg(F.sum("cnt").alias("c"))
    return by_hour.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("c").cast("double") * F.col("c")), F.pow(F.sum("c"), F.lit(2))).alias("time_concentration"),
        F.count_if(F.col("c") > 0).alias("unique_hours_of_day"),
    )


def active_hours(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The three readings of 'unique active hours' and the activity span in days.

    Hour buckets and map keys coincide once events are hourly rows; hours of the
    day is the third reading.
    """
    keys = keys or KEYS
    by_hour = hours.groupBy(*keys, F.hour("hour").alias("h")).agg(
        F.count("*").alias("buckets"), F.min("first_ts").alias("a"), F.max("last_ts").alias("b")
    )
    return by_hour.groupBy(*keys).agg(
        F.sum("buckets").alias("hour_buckets"),
        F.sum("buckets").alias("map_keys"),
        F.count("*").alias("hours_of_day"),
        F.floor(hours_between(F.max("b"), F.min("a")) / 24).alias("activity_span_days"),
    )
