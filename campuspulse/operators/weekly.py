"""Weekly series, trajectory and workload features.

The weekly table has at most 53 rows per student, so its windows are bounded
whatever the volume of events behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campuspulse.functions.exprs import iso_week, safe_ratio
from campuspulse.operators.activity import KEYS


def weekly_counts(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return hours.groupBy(*(keys or KEYS), iso_week(F.col("hour")).alias("week")).agg(F.sum("cnt").alias("cnt"))


def weekly_series(weekly: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Observed weeks with dense index ``x``, series length ``n`` and differences.

    Weeks without activity are absent, not zero.
    """
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy("week")
    whole = Window.partitionBy(*keys)
    return (
        weekly.withColumn("x", F.row_number().over(w) - 1)
        .withColumn("n", F.count("*").over(whole))
        .withColumn("mean_cnt", F.avg("cnt").over(whole))
        .withColumn("diff", F.col("cnt") - F.lag("cnt").over(w))
        .withColumn("prev_diff", F.lag("diff").over(w))
    )


def acceleration(x: Column, y: Column) -> Column:
    """Twice the leading coefficient of the least-squares parabola, from power sums."""
    x, y = x.cast("double"), y.cast("double")
    n = F.count(x).cast("double")
    s1, s2, s3, s4 = F.sum(x), F.sum(x * x), F.sum(x * x * x), F.sum(x * x * x * x)
    sy, sxy, sx2y = F.sum(y), F.sum(x * y), F.sum(x * x * y)
    xx, xy = s2 - s1 * s1 / n, sxy - s1 * sy / n
    xx2, x2x2 = s3 - s1 * s2 / n, s4 - s2 * s2 / n
    x2y = sx2y - s2 * sy / n
    return 2 * F.try_divide(x2y * xx - xy * xx2, xx * x2x2 - xx2 * xx2)


def trajectory_aggs() -> dict[str, Column]:
    """Aggregates over a weekly series giving the trajectory features."""
    x, n, cnt = F.col("x"), F.col("n"), F.col("cnt")
    size = F.count("*")
    zero = F.lit(0.0)
    late = F.sum(F.when(x >= n - 2, cnt))
    prior = F.avg(F.when(x < n - 2, cnt))
    return {
        "engagement_velocity": F.when(size >= 2, F.regr_slope(cnt, x)).otherwise(zero),
        "engagement_acceleration": F.when(size >= 3, acceleration(x, cnt)).otherwise(zero),
        "weekly_cv": F.when(size >= 2, F.try_divide(F.stddev_pop(cnt), F.avg(cnt))).otherwise(zero),
        "trend_reversals": F.count_if(F.col("diff") * F.col("prev_diff") < 0),
        "early_engagement_ratio": F.when(
            size >= 2, safe_ratio(F.sum(F.when(x < 3, cnt)), F.sum(cnt))
        ).otherwise(zero),
        "late_surge": F.when(size >= 4, F.coalesce(F.try_divide(late.cast("double"), 2 * prior), zero)).otherwise(zero),
    }


def workload_aggs() -> dict[str, Column]:
    """Aggregates giving peak and slope features. Peak tiers exclude each other."""
    cnt, mean, diff = F.col("cnt"), F.col("mean_cnt"), F.col("diff")
    size = F.count("*")

    def guarded(value: Column, default) -> Column:
        return F.when(size >= 2, F.coalesce(value, default)).otherwise(default)

    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    tier3 = F.count_if(cnt > 2.0 * mean)
    tier2 = F.count_if((cnt > 1.5 * mean) & (cnt <= 2.0 * mean))
    tier1 = F.count_if((cnt > 1.25 * mean) & (cnt <= 1.5 * mean))
    return {
        "peak_count_type1": guarded(tier1, none),
        "peak_count_type2": guarded(tier2, none),
        "peak_count_type3": guarded(tier3, none),
        "peak_ratio": guarded(safe_ratio(tier3, tier1), zero),
        "max_positive_slope": guarded(F.max(diff), none),
        "max_negative_slope": guarded(F.min(diff), none),
        "slope_std": guarded(F.stddev_pop(diff), zero),
        "positive_slope_sum": guarded(F.sum(F.when(diff > 0, diff)), none),
        "negative_slope_sum": guarded(F.sum(F.when(diff < 0, diff)), none),
        "weekly_range": guarded(F.max(cnt) - F.min(cnt), none),
    }


def trajectory_features(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return series.groupBy(*(keys or KEYS)).agg(*[c.alias(n) for n, c in trajectory_aggs().items()])


def workload_features(series: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return series.groupBy(*(keys or KEYS)).agg(*[c.alias(n) for n, c in workload_aggs().items()])


def weekly_decline(series: DataFrame, drop: float = 0.5) -> DataFrame:
    """Weeks whose activity fell by at least ``drop`` against the previous observed week."""
    previous = F.col("cnt") - F.col("diff")
    return series.where(F.col("diff") <= -drop * previous).select(
        *KEYS, "week", previous.alias("previous_cnt"), "cnt"
    )
