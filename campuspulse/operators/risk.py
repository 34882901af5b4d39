"""Rule-based risk scores, alerts and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campuspulse.functions.exprs import hours_between, risk_level, safe_ratio
from campuspulse.operators.courses import minmax
from campuspulse.operators.ranks import attach_row, percentiles

# Weights of the risk score.
WEIGHTS = {"unique_active_hours": -0.36, "total_activity_time": -0.36, "avg_gap_hours": 0.35, "gap_std_hours": 0.29}


def _weighted(parts: dict[str, Column]) -> Column:
    total = None
    for name, part in parts.items():
        term = F.lit(WEIGHTS[name]) * part
        total = term if total is None else total + term
    return total


def risk_score_z(df: DataFrame) -> DataFrame:
    """Weighted sum of standard scores (sample deviation) over all students."""
    moments = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in WEIGHTS], *[F.stddev_samp(c).alias(f"_s_{c}") for c in WEIGHTS]
    )
    parts = {c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in WEIGHTS}
    return attach_row(df, moments).select(*df.columns, _weighted(parts).alias("risk_score"))


def risk_score_minmax(df: DataFrame) -> DataFrame:
    """Weighted sum of min-max scaled features, itself rescaled to 0-100."""
    bounds = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in WEIGHTS], *[F.max(c).alias(f"_hi_{c}") for c in WEIGHTS])
    parts = {c: minmax(c, f"_lo_{c}", f"_hi_{c}") for c in WEIGHTS}
    raw = attach_row(df, bounds).select(*df.columns, _weighted(parts).alias("_raw"))
    ends = raw.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    return attach_row(raw, ends).select(*df.columns, (minmax("_raw", "_lo", "_hi") * 100).alias("risk_score"))


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...] = (25, 50, 75), score: str = "risk_score") -> DataFrame:
    """Flagged students, recall and precision at each threshold from one aggregate."""
    s, failed = F.col(score), F.col("failed") == 1
    aggs = [F.count("*").alias("_all"), F.count_if(failed).alias("_failed")]
    rows = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(s >= t).alias(f"_f{i}"), F.count_if((s >= t) & failed).alias(f"_t{i}")]
        rows.append(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_f{i}").alias("n_flagged"), F.col(f"_t{i}").alias("_tp")))
    return df.agg(*aggs).select("_all", "_failed", F.inline(F.array(*rows))).select(
        "threshold", "n_flagged",
        (safe_ratio(F.col("n_flagged"), F.col("_all")) * 100).alias("pct_flagged"),
        (safe_ratio(F.col("_tp"), F.col("_failed")) * 100).alias("recall"),
        (safe_ratio(F.col("_tp"), F.col("n_flagged")) * 100).alias("precision"),
    )


# Fixed values: (feature, risky side, quartile).
ALERT_FEATURES = [
    ("unique_active_hours", "low", 0.25), ("total_activity_time", "low", 0.25),
    ("avg_gap_hours", "high", 0.75), ("gap_std_hours", "high", 0.75),
]


def alert_thresholds(df: DataFrame) -> DataFrame:
    """Quartile threshold of each indicator with failure rates inside and outside it."""
    rows, aggs, cuts = [], [], None
    for f, side, p in ALERT_FEATURES:
        q = percentiles(df, [], f, {f"_q_{f}": p})
        cuts = q if cuts is None else attach_row(cuts, q)
        risky = F.col(f) < F.col(f"_q_{f}") if side == "low" else F.col(f) > F.col(f"_q_{f}")
        aggs += [
            F.max(f"_q_{f}").alias(f"_t_{f}"), F.avg(F.when(risky, F.col("failed"))).alias(f"_r_{f}"),
            F.avg(F.when(~risky, F.col("failed"))).alias(f"_n_{f}"),
        ]
        rows.append(F.struct(
            F.lit(f).alias("feature"), F.lit(side).alias("side"), F.col(f"_t_{f}").alias("threshold"),
            (F.col(f"_r_{f}") * 100).alias("fail_rate_at_risk"), (F.col(f"_n_{f}") * 100).alias("fail_rate_normal"),
        ))
    return attach_row(df, cuts).agg(*aggs).select(F.inline(F.array(*rows)))


def risk_factors(df: DataFrame) -> DataFrame:
    """Four risk flags, their number and the level it stands for."""
    views = percentiles(df, [], "page_views", {"_qv": 0.25})
    time = percentiles(df, [], "total_activity_time", {"_qt": 0.25})
    flags = {
        "risk_evening": F.col("is_evening_studier") == 1,
        "risk_late_access": F.col("early_access_score") < 0.3,
        "risk_low_views": F.col("page_views") < F.col("_qv"),
        "risk_low_time": F.col("total_activity_time") < F.col("_qt"),
    }
    out = attach_row(attach_row(df, views), time).withColumns({k: F.when(v, 1).otherwise(0) for k, v in flags.items()})
    count = F.col("risk_evening") + F.col("risk_late_access") + F.col("risk_low_views") + F.col("risk_low_time")
    n = F.col("risk_count")
    level = F.when(n >= 3, "Critical").when(n == 2, "High").when(n == 1, "Medium").otherwise("Low")
    return out.withColumn("risk_count", count).withColumn("risk_level", level).drop("_qv", "_qt")


def activity_alerts(df: DataFrame, as_of: Column) -> DataFrame:
    """Alert flags per student. 5 days, 10 minutes, 72 hours, 10 active hours.

    Needs first_module_day, total_activity_time (s), session_gap_mean (h),
    unique_active_hours and last_ts.
    """
    first = F.col("first_module_day")
    idle = hours_between(as_of, F.col("last_ts"))
    return df.withColumns({
        "alert_no_module": F.when(first.isNull() | (first > 5), 1).otherwise(0),
        "alert_low_time": F.when(F.coalesce("total_activity_time", F.lit(0.0)) < 600, 1).otherwise(0),
        "alert_long_gap": F.when(F.col("session_gap_mean") > 72, 1).otherwise(0),
        "alert_few_hours": F.when(F.coalesce("unique_active_hours", F.lit(0)) < 10, 1).otherwise(0),
        "alert_inactive": F.when(F.col("last_ts").isNull() | (idle > 72), 1).otherwise(0),
    })


def inactive_students(last_seen: DataFrame, as_of: Column, hours: float = 72.0) -> DataFrame:
    return last_seen.withColumn("idle_hours", hours_between(as_of, F.col("last_ts"))).where(F.col("idle_hours") > hours)


def risk_report(df: DataFrame, probability: str = "probability") -> DataFrame:
    """Students by falling risk with their level."""
    return df.withColumn("risk_level", risk_level(F.col(probability))).orderBy(F.desc(probability), "course_id", "user_id")


def catch_rate(report: DataFrame) -> DataFrame:
    """Share of failing students that carry a High or Critical level."""
    flagged = F.col("risk_level").isin("High", "Critical")
    failed = F.col("failed") == 1
    return report.agg(
        F.count_if(failed).alias("n_failed"), F.count_if(flagged & failed).alias("n_caught"),
        (safe_ratio(F.count_if(flagged & failed), F.count_if(failed)) * 100).alias("catch_rate"),
        F.count_if(flagged).alias("n_flagged"),
    )
