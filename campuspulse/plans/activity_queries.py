"""Sessions, calendar, weekly and access queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from campuspulse.functions import exprs
from campuspulse.functions import features as names
from campuspulse.functions.exprs import round_doubles
from campuspulse.operators import access, activity, calendar, frames, sessions, weekly
from campuspulse.plans import inputs
from campuspulse.plans.registry import add_cte, big, query, rnd
from campuspulse.session import materialise
from campuspulse.sources import tables

WEEKS = 30 / 7


# --- sessions -------------------------------------------------------------------

@query("session_gaps", "gaps", f"SELECT event_id, user_id, {rnd('gap', 'gap_hours')} FROM gaps")
def session_gaps(spark, d):
    gaps = sessions.event_gaps(tables.activity(spark, d))
    return gaps.select("event_id", "user_id", "gap_hours")


SESSION_SQL = f"""
    SELECT course_id, user_id, {big('CASE WHEN n >= 2 THEN inter + 1 ELSE 0 END', 'session_count')},
           {rnd('coalesce(gmin, 0)', 'session_gap_min')}, {rnd('coalesce(gmax, 0)', 'session_gap_max')},
           {rnd('gmean', 'session_gap_mean')}, {rnd('gstd', 'session_gap_std')},
           {rnd('CASE WHEN gmean > 0 THEN greatest(0, least(1, 1 - gstd / gmean)) ELSE 0 END', 'session_regularity')},
           {rnd('CASE WHEN n >= 2 THEN inter + 1 ELSE 0 END / (30 / 7.0)', 'sessions_per_week')}
    FROM sess"""


@query("session_features", "sess", SESSION_SQL)
def session_features(spark, d):
    return sessions.session_features(inputs.hours(spark, d), WEEKS)


@query(
    "sessions_by_gap", "act",
    """SELECT course_id, user_id, CAST(sum(CASE WHEN g IS NULL OR g >= 6 * 3600000000 THEN 1 ELSE 0 END) AS BIGINT) AS n_sessions,
              max(g) / 3600000000.0 >= 24 AS paused_a_day
       FROM (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS g FROM act)
       GROUP BY ALL""",
)
def sessions_by_gap(spark, d):
    """Six-hour session gap, from buckets as wide as the gap."""
    buckets = activity.gap_buckets(tables.activity(spark, d), gap_hours=6.0)
    keyed = buckets.join(inputs.members(spark, d).select("user_id", "course_id"), "user_id")
    gaps = sessions.with_bucket_gaps(keyed, activity.KEYS)
    opens = F.col("gap").isNull() | (F.col("gap") >= 6)
    return gaps.groupBy(*activity.KEYS).agg(
        F.count_if(opens).alias("n_sessions"), (F.max("gap") >= 24).alias("paused_a_day")
    )


@query(
    "session_list", "gaps",
    """SELECT course_id, user_id, CAST(no AS BIGINT) AS session_no, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_events
       FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM gaps)
       GROUP BY ALL""",
)
def session_list(spark, d):
    return sessions.sessions(inputs.hours(spark, d))


@query(
    "raw_gap_features", "rawgap",
    f"SELECT course_id, user_id, {rnd('avg_gap_hours')}, {rnd('gap_std_hours')}, activity_span_days FROM rawgap",
)
def raw_gap_features(spark, d):
    return sessions.raw_gap_features(inputs.hours(spark, d))


# --- calendar -------------------------------------------------------------------

def _tod_sql(evening_last: int) -> str:
    night = f"hour(ts) > {evening_last} OR hour(ts) < 6"
    return f"""
    WITH t AS (SELECT course_id, user_id,
        count(*) FILTER (hour(ts) BETWEEN 6 AND 11) AS m, count(*) FILTER (hour(ts) BETWEEN 12 AND 17) AS a,
        count(*) FILTER (hour(ts) BETWEEN 18 AND {evening_last}) AS e, count(*) FILTER ({night}) AS n,
        count(DISTINCT date_trunc('hour', ts)) AS unique_active_hours, count(*) AS c FROM act GROUP BY ALL),
    u AS (SELECT *, CASE WHEN m >= greatest(a, e, n) THEN 'morning' WHEN a >= greatest(e, n) THEN 'afternoon'
                         WHEN e >= n THEN 'evening' ELSE 'night' END AS dominant_time FROM t)
    SELECT course_id, user_id, m AS morning_activity, a AS afternoon_activity, e AS evening_activity, n AS night_activity,
           unique_active_hours, dominant_time,
           CASE WHEN m = greatest(m, a, e, n) THEN 1 ELSE 0 END AS is_morning_studier,
           CASE WHEN e = greatest(m, a, e, n) THEN 1 ELSE 0 END AS is_evening_studier,
           CASE WHEN dominant_time = 'morning' AND m > 0.4 * c THEN 1 ELSE 0 END AS strong_morning,
           CASE WHEN dominant_time = 'evening' AND e > 0.4 * c THEN 1 ELSE 0 END AS strong_evening
    FROM u"""


def _nested(sql: str) -> str:
    return f"SELECT * FROM ({sql})"


@query("time_of_day_a", "act", _nested(_tod_sql(21)))
def time_of_day_a(spark, d):
    return calendar.time_of_day(inputs.hours(spark, d), evening_end=22)


@query("time_of_day_b", "act", _nested(_tod_sql(23)))
def time_of_day_b(spark, d):
    return calendar.time_of_day(inputs.hours(spark, d), evening_end=24)


@query(
    "time_of_day_local", "act",
    """SELECT course_id, user_id,
              count(*) FILTER (hour(ts - INTERVAL 3 HOUR) BETWEEN 6 AND 11) AS morning_activity,
              count(*) FILTER (hour(ts - INTERVAL 3 HOUR) BETWEEN 12 AND 17) AS afternoon_activity,
              count(*) FILTER (hour(ts - INTERVAL 3 HOUR) >= 18) AS evening_activity,
              count(*) FILTER (hour(ts - INTERVAL 3 HOUR) < 6) AS night_activity
       FROM act GROUP BY ALL""",
)
def time_of_day_local(spark, d):
    """Slots on the Santiago wall clock; its January offset is three hours."""
    local = activity.hourly(tables.activity(spark, d), tz="America/Santiago")
    keyed = local.join(inputs.members(spark, d).select("user_id", "course_id"), "user_id")
    return calendar.time_of_day(keyed).select(*activity.KEYS, *[f"{s}_activity" for s in exprs.SLOTS])


@query(
    "time_shares", "act",
    "SELECT course_id, user_id, "
    + ", ".join(
        rnd(f"count(*) FILTER (hour(ts) BETWEEN {a} AND {b}) / count(*)", f"{s}_share")
        for s, a, b in (("morning", 6, 11), ("afternoon", 12, 17), ("evening", 18, 23), ("night", 0, 5))
    )
    + " FROM act GROUP BY ALL",
)
def time_shares(spark, d):
    return calendar.time_shares(inputs.hours(spark, d))


SLOT_RANGES = (("morning", 6, 11), ("afternoon", 12, 17), ("evening", 18, 23), ("night", 0, 5))


def _block(day: str, low: int, high: int) -> str:
    days = "isodow(ts) >= 6" if day == "weekend" else "isodow(ts) < 6"
    return f"{days} AND hour(ts) BETWEEN {low} AND {high}"


BLOCK_SQL = ", ".join(
    rnd(f"count(*) FILTER ({_block(day, a, b)}) / count(*)", f"{day}_{s}_pct")
    for day in ("weekday", "weekend") for s, a, b in SLOT_RANGES
)


@query("block_shares", "act", f"SELECT course_id, user_id, {BLOCK_SQL} FROM act GROUP BY ALL")
def block_shares(spark, d):
    return calendar.block_shares(inputs.hours(spark, d))


add_cte(
    "blockweek",
    f"""SELECT course_id, user_id, week(ts) AS week,
           count(*) FILTER ({_block('weekday', 6, 11)}) / count(*) AS wm,
           count(*) FILTER ({_block('weekday', 12, 17)}) / count(*) AS wa,
           count(*) FILTER (isodow(ts) >= 6) / count(*) AS we FROM act GROUP BY ALL""",
    ["act"],
)
BLOCK_SD_SQL = (
    f"{rnd('stddev_pop(wm)', 'weekday_morning_sd')}, {rnd('stddev_pop(wa)', 'weekday_afternoon_sd')}, "
    f"{rnd('stddev_pop(we)', 'weekend_total_sd')}"
)


@query("block_weekly_sd", "blockweek", f"SELECT course_id, user_id, {BLOCK_SD_SQL} FROM blockweek GROUP BY ALL")
def block_weekly_sd(spark, d):
    return calendar.block_weekly_sd(inputs.hours(spark, d))


@query(
    "hour_heatmap", "act",
    "SELECT course_id, CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hour_of_day, count(*) AS cnt FROM act GROUP BY ALL",
)
def hour_heatmap(spark, d):
    return calendar.hour_heatmap(inputs.hours(spark, d))


@query(
    "hour_matrix", "act",
    "SELECT course_id, CAST(hour(ts) AS INTEGER) AS hour_of_day, "
    + ", ".join(f"count(*) FILTER (isodow(ts) = {i + 1}) AS dow_{i}" for i in range(7))
    + " FROM act GROUP BY ALL",
)
def hour_matrix(spark, d):
    return calendar.heatmap_matrix(calendar.hour_heatmap(inputs.hours(spark, d)))


def _dct(k: int) -> str:
    scale = f"sqrt({1 if k == 0 else 2} / 168.0)"
    return rnd(f"sum(cos(pi() * {k} * (2 * ((isodow(ts) - 1) * 24 + hour(ts)) + 1) / 336) * {scale}) / count(*)", f"dct_coef_{k}")


DCT_SQL = ", ".join(_dct(k) for k in range(12))


@query("dct_rhythm", "act", f"SELECT course_id, user_id, {DCT_SQL} FROM act GROUP BY ALL")
def dct_rhythm(spark, d):
    return calendar.dct_rhythm(inputs.hours(spark, d))


@query(
    "time_concentration", "act",
    f"""SELECT course_id, user_id, {rnd('sum(c * c) / (sum(c) * sum(c))', 'time_concentration')}, count(*) AS unique_hours_of_day
        FROM (SELECT course_id, user_id, hour(ts) AS h, count(*) AS c FROM act GROUP BY ALL) GROUP BY ALL""",
)
def time_concentration(spark, d):
    return calendar.time_concentration(inputs.hours(spark, d))


@query(
    "active_hours_abc", "act",
    """SELECT course_id, user_id, count(DISTINCT date_trunc('hour', ts)) AS hour_buckets,
              count(DISTINCT date_trunc('hour', ts)) AS map_keys, count(DISTINCT hour(ts)) AS hours_of_day,
              date_diff('microsecond', min(ts), max(ts)) // 86400000000 AS activity_span_days
       FROM act GROUP BY ALL""",
)
def active_hours_abc(spark, d):
    return calendar.active_hours(inputs.hours(spark, d))


# --- weekly ---------------------------------------------------------------------

@query("weekly_series", "series", "SELECT course_id, user_id, CAST(week AS INTEGER) AS week, CAST(x AS INTEGER) AS x, n, cnt, CAST(diff AS DOUBLE) AS diff FROM series")
def weekly_series(spark, d):
    s = weekly.weekly_series(weekly.weekly_counts(inputs.hours(spark, d)))
    return s.select(*activity.KEYS, "week", "x", "n", "cnt", F.col("diff").cast("double").alias("diff"))


# Acceleration by the determinant of the normal equations, another route to the same parabola.
ACCEL_SQL = """CASE WHEN count(*) >= 3 THEN 2.0 * (
    sum(x*x*cnt) * (count(*) * sum(x*x) - sum(x) * sum(x)) - sum(x*cnt) * (count(*) * sum(x*x*x) - sum(x) * sum(x*x))
    + sum(cnt) * (sum(x) * sum(x*x*x) - sum(x*x) * sum(x*x)))
  / (sum(x*x*x*x) * (count(*) * sum(x*x) - sum(x) * sum(x)) - sum(x*x*x) * (count(*) * sum(x*x*x) - sum(x) * sum(x*x))
    + sum(x*x) * (sum(x) * sum(x*x*x) - sum(x*x) * sum(x*x))) ELSE 0 END"""
TRAJECTORY_SQL = ", ".join([
    rnd("CASE WHEN count(*) >= 2 THEN regr_slope(cnt, x) ELSE 0 END", "engagement_velocity"),
    rnd(ACCEL_SQL, "engagement_acceleration"),
    rnd("CASE WHEN count(*) >= 2 THEN stddev_pop(cnt) / avg(cnt) ELSE 0 END", "weekly_cv"),
    "count(*) FILTER (diff * prev_diff < 0) AS trend_reversals",
    rnd("CASE WHEN count(*) >= 2 THEN sum(cnt) FILTER (x < 3) / sum(cnt) ELSE 0 END", "early_engagement_ratio"),
    rnd("CASE WHEN count(*) >= 4 THEN sum(cnt) FILTER (x >= n - 2) / (2 * avg(cnt) FILTER (x < n - 2)) ELSE 0 END", "late_surge"),
])
T1, T2, T3 = (
    "count(*) FILTER (cnt > 1.25 * mean_cnt AND cnt <= 1.5 * mean_cnt)",
    "count(*) FILTER (cnt > 1.5 * mean_cnt AND cnt <= 2 * mean_cnt)",
    "count(*) FILTER (cnt > 2 * mean_cnt)",
)
WORKLOAD_SQL = ", ".join([
    f"{T1} AS peak_count_type1", f"{T2} AS peak_count_type2", f"{T3} AS peak_count_type3",
    rnd(f"CASE WHEN {T1} > 0 THEN {T3} / {T1} ELSE 0 END", "peak_ratio"),
    big("coalesce(max(diff), 0)", "max_positive_slope"), big("coalesce(min(diff), 0)", "max_negative_slope"),
    rnd("coalesce(stddev_pop(diff), 0)", "slope_std"),
    big("coalesce(sum(diff) FILTER (diff > 0), 0)", "positive_slope_sum"),
    big("coalesce(sum(diff) FILTER (diff < 0), 0)", "negative_slope_sum"),
    big("max(cnt) - min(cnt)", "weekly_range"),
])


@query("trajectory_features", "series2", f"SELECT course_id, user_id, {TRAJECTORY_SQL} FROM series2 GROUP BY ALL")
def trajectory_features(spark, d):
    return weekly.trajectory_features(weekly.weekly_series(weekly.weekly_counts(inputs.hours(spark, d))))


@query("workload_features", "series2", f"SELECT course_id, user_id, {WORKLOAD_SQL} FROM series2 GROUP BY ALL")
def workload_features(spark, d):
    return weekly.workload_features(weekly.weekly_series(weekly.weekly_counts(inputs.hours(spark, d))))


@query(
    "weekly_decline", "series",
    "SELECT course_id, user_id, CAST(week AS INTEGER) AS week, cnt - diff AS previous_cnt, cnt FROM series WHERE cnt <= 0.5 * (cnt - diff)",
)
def weekly_decline(spark, d):
    return weekly.weekly_decline(weekly.weekly_series(weekly.weekly_counts(inputs.hours(spark, d))))


# --- access ---------------------------------------------------------------------

@query(
    "first_access", "act",
    """SELECT course_id, user_id, min(ts) AS first_activity_at,
              greatest(0, date_diff('microsecond', TIMESTAMP '2024-01-01', min(ts)) // 86400000000) AS first_access_day
       FROM act GROUP BY ALL""",
)
def first_access(spark, d):
    return access.first_access(inputs.dated_hours(spark, d), F.col("start_at"))


ACCESS_SQL = """CASE WHEN count(*) FILTER (rn <= 5) >= 5 THEN exp(avg(ln(greatest(0.001, least(1.0,
    (date_diff('microsecond', TIMESTAMP '2024-01-01', ts) // 86400000000) / 30.0)))) FILTER (rn <= 5)) ELSE 0 END"""


@query(
    "access_time_pct", "act",
    f"SELECT user_id, {rnd(ACCESS_SQL, 'access_time_pct')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM act) GROUP BY ALL",
)
def access_time_pct(spark, d):
    start, end = (F.lit(t).cast("timestamp") for t in (tables.COURSE_START, tables.COURSE_END))
    return access.access_time_pct(tables.activity(spark, d), start, end, keys=["user_id"])


@query(
    "module_rank", "ranked",
    f"SELECT course_id, user_id, module_id, state, CAST(rk AS DOUBLE) AS completion_rank, completers AS completers_in_module, {rnd('norm_rank', 'completion_rank_normalized')} FROM ranked",
)
def module_rank(spark, d):
    ranked = access.module_ranks(materialise(tables.module_progress(spark, d)))
    return ranked.select(
        "course_id", "user_id", "module_id", "state", F.col("completion_rank").cast("double").alias("completion_rank"),
        "completers_in_module", "completion_rank_normalized",
    )


@query(
    "module_summary", "ranked",
    "SELECT course_id, module_id, count(*) AS completers, CAST(max(rk) AS BIGINT) AS max_rank FROM ranked WHERE state = 'completed' GROUP BY ALL",
)
def module_summary(spark, d):
    return access.module_summary(access.module_ranks(materialise(tables.module_progress(spark, d))))


@query(
    "module_completion", "modt",
    f"""SELECT course_id, user_id, modules_completed, modules_total, {rnd('modules_completed / modules_total', 'module_completion_rate')},
               first_done AS first_module_completed_at, last_done AS last_module_completed_at,
               coalesce(date_diff('microsecond', first_done, last_done) // 86400000000, 0) AS module_completion_span_days
        FROM modt""",
)
def module_completion(spark, d):
    return access.module_completion(tables.module_progress(spark, d))


EARLY_SQL = f"""
    SELECT course_id, user_id, first_done AS first_module_completed_at,
           CASE WHEN first_done IS NULL THEN timed + 1 ELSE rn END AS early_access_rank,
           {rnd("CASE WHEN first_done IS NULL THEN 0 WHEN timed > 1 THEN 1 - (rn - 1) / (timed - 1) ELSE 0.5 END", 'early_access_score')}
    FROM (SELECT course_id, user_id, first_done, count(first_done) OVER (PARTITION BY course_id) AS timed,
                 row_number() OVER (PARTITION BY course_id ORDER BY first_done NULLS LAST, user_id) AS rn
          FROM modt RIGHT JOIN enr USING (course_id, user_id))"""


@query("early_access_score", "modt", EARLY_SQL)
def early_access_score(spark, d):
    done = inputs.completion(spark, d).select(*activity.KEYS, "first_module_completed_at")
    students = inputs.members(spark, d).select(*activity.KEYS).join(done, activity.KEYS, "left")
    return access.early_access_rank(materialise(students))


@query(
    "module_timing", "modt tod totals rawgap",
    f"""SELECT e.course_id, e.user_id, e.final_score, {rnd('coalesce(modules_completed / modules_total, 0)', 'module_completion_pct')},
               {rnd('coalesce(avg_completion_rank, 0.5)', 'avg_completion_rank')}, {rnd('1 - coalesce(avg_completion_rank, 0.5)', 'early_access_score')},
               coalesce(page_views, 0) AS total_page_views, coalesce(dominant_time, 'none') AS dominant_time_of_day, coalesce(activity_span_days, 0) AS activity_span_days
        FROM enr e LEFT JOIN modt m ON m.user_id = e.user_id LEFT JOIN tod t ON t.user_id = e.user_id LEFT JOIN totals a ON a.user_id = e.user_id
        LEFT JOIN rawgap g ON g.user_id = e.user_id""",
)
def module_timing(spark, d):
    """Module timing, activity and grade per enrolled student."""
    timing = access.module_timing(access.module_ranks(materialise(tables.module_progress(spark, d))))
    seen = inputs.basics(spark, d).select(*activity.KEYS, "page_views", "dominant_time", "activity_span_days")
    half = F.lit(0.5)
    return (
        inputs.members(spark, d).select(*activity.KEYS, "final_score")
        .join(timing, activity.KEYS, "left").join(seen, activity.KEYS, "left")
        .select(
            *activity.KEYS, "final_score",
            F.coalesce("module_completion_pct", F.lit(0.0)).alias("module_completion_pct"),
            F.coalesce("avg_completion_rank", half).alias("avg_completion_rank"),
            F.coalesce("early_access_score", half).alias("early_access_score"),
            F.coalesce("page_views", F.lit(0)).alias("total_page_views"),
            F.coalesce("dominant_time", F.lit("none")).alias("dominant_time_of_day"),
            F.coalesce("activity_span_days", F.lit(0)).alias("activity_span_days"),
        )
    )


add_cte("early", EARLY_SQL, ["modt", "enr"])

# --- full feature tables ----------------------------------------------------------

add_cte("bshare", f"SELECT user_id, {BLOCK_SQL}, {DCT_SQL}, count(DISTINCT date_trunc('hour', ts)) AS unique_active_hours,"
        " date_diff('microsecond', min(ts), max(ts)) // 86400000000 AS activity_span_days,"
        " greatest(0, date_diff('microsecond', TIMESTAMP '2024-01-01', min(ts)) // 86400000000) AS first_access_day FROM act GROUP BY ALL", ["act"])
add_cte("bsd", f"SELECT user_id, {BLOCK_SD_SQL} FROM blockweek GROUP BY ALL", ["blockweek"])
add_cte("traj", f"SELECT user_id, {TRAJECTORY_SQL}, {WORKLOAD_SQL} FROM series2 GROUP BY ALL", ["series2"])
add_cte("sessf", f"SELECT * EXCLUDE (course_id) FROM ({SESSION_SQL})", ["sess"])
add_cte("accp", f"SELECT user_id, {rnd(ACCESS_SQL, 'access_time_pct')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM act) GROUP BY ALL", ["act"])
add_cte("fmod",
        # greatest() skips nulls in DuckDB, so a student without any completion is kept null explicitly.
        "SELECT user_id, CASE WHEN min(completed_at) IS NOT NULL THEN greatest(0, date_diff('microsecond', TIMESTAMP '1995-01-01', min(completed_at)) // 86400000000) END AS first_module_day FROM prog GROUP BY ALL", ["prog"])
add_cte("eng", """
    SELECT e.course_id, e.user_id, 'student' AS user_role, final_score, CASE WHEN final_score < 57 THEN 1 ELSE 0 END AS failed,
           """ + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in (
        ["session_count", "session_gap_min", "session_gap_max", "session_gap_mean", "session_gap_std", "session_regularity", "sessions_per_week"]
        + [f"{day}_{s}_pct" for day in ("weekday", "weekend") for s, _, _ in SLOT_RANGES]
        + ["weekday_morning_sd", "weekday_afternoon_sd", "weekend_total_sd"] + [f"dct_coef_{k}" for k in range(12)]
        + ["engagement_velocity", "engagement_acceleration", "weekly_cv", "trend_reversals", "early_engagement_ratio", "late_surge",
           "peak_count_type1", "peak_count_type2", "peak_count_type3", "peak_ratio", "max_positive_slope", "max_negative_slope",
           "slope_std", "positive_slope_sum", "negative_slope_sum", "weekly_range", "first_access_day"]
    )
) + """, CASE WHEN page_views > 0 THEN coalesce(first_module_day, 0) ELSE 0 END AS first_module_day, CAST(0 AS DOUBLE) AS first_assignment_day, coalesce(access_time_pct, 0) AS access_time_pct,
           coalesce(page_views, 0) AS total_page_views, coalesce(participations, 0) AS total_participations,
           coalesce(activity_span_days, 0) AS activity_span_days, coalesce(unique_active_hours, 0) AS unique_active_hours
    FROM enr e LEFT JOIN sessf USING (user_id) LEFT JOIN bshare USING (user_id) LEFT JOIN bsd USING (user_id) LEFT JOIN traj USING (user_id)
    LEFT JOIN accp USING (user_id) LEFT JOIN fmod USING (user_id) LEFT JOIN (SELECT user_id, page_views, participations FROM totals) USING (user_id)""",
    ["enr", "sessf", "bshare", "bsd", "traj", "accp", "fmod", "totals"])


@query("engagement_features", "eng", "SELECT * FROM eng")
def engagement_features(spark, d):
    return inputs.engagement(spark, d)


_Z = ", ".join(
    rnd(f"CASE WHEN stddev_samp({c}) OVER p > 0 THEN ({c} - avg({c}) OVER p) / stddev_samp({c}) OVER p ELSE 0 END", f"{c}_norm") for c in names.NORMALISED
)


@query("zscore_in_course", "eng", f"SELECT course_id, user_id, {_Z} FROM eng WINDOW p AS (PARTITION BY course_id)")
def zscore_in_course(spark, d):
    """All normalised features, from the feature table at its six digits."""
    table = round_doubles(inputs.engagement(spark, d).select(*activity.KEYS, *names.NORMALISED), 6)
    z = frames.zscore_within(materialise(table), names.NORMALISED)
    return z.select(*activity.KEYS, *[f"{c}_norm" for c in names.NORMALISED])


EW_COUNTS = [
    "page_views", "participations", "on_time", "late", "missing", "modules_completed", "modules_total", "morning_activity",
    "afternoon_activity", "evening_activity", "night_activity", "unique_active_hours",
]


@query(
    "early_warning_features", "tod tard modt totals rawgap early",
    f"""SELECT e.course_id, e.user_id, e.current_score, e.final_score, CASE WHEN coalesce(e.final_score, 0) < 57 THEN 1 ELSE 0 END AS failed,
        {', '.join(f'coalesce({c if c != "unique_active_hours" else "t.unique_active_hours"}, 0) AS {c}' for c in EW_COUNTS)},
        {rnd('coalesce(total_activity_time, 0)', 'total_activity_time')},
        {', '.join(rnd(f'CASE WHEN on_time + late + missing > 0 THEN {c} / (on_time + late + missing) ELSE 0 END', f'{c}_rate') for c in ('on_time', 'late', 'missing'))},
        {rnd('coalesce(modules_completed / modules_total, 0)', 'module_completion_rate')}, first_done AS first_module_completed_at, last_done AS last_module_completed_at,
        coalesce(date_diff('microsecond', first_done, last_done) // 86400000000, 0) AS module_completion_span_days,
        coalesce(dominant_time, 'none') AS dominant_time, coalesce(CASE WHEN morning_activity = best THEN 1 ELSE 0 END, 0) AS is_morning_studier,
        coalesce(CASE WHEN evening_activity = best THEN 1 ELSE 0 END, 0) AS is_evening_studier,
        first_ts AS first_activity_at, last_ts AS last_activity_at, coalesce(activity_span_days, 0) AS activity_span_days,
        CAST(date_diff('microsecond', TIMESTAMP '2024-01-01', first_ts) // 86400000000 AS DOUBLE) AS days_to_first_activity,
        early_access_rank, early_access_score
        FROM enr e LEFT JOIN tod t ON t.user_id = e.user_id LEFT JOIN tard x ON x.user_id = e.user_id LEFT JOIN modt m ON m.user_id = e.user_id
        LEFT JOIN totals a ON a.user_id = e.user_id LEFT JOIN rawgap g ON g.user_id = e.user_id
        LEFT JOIN (SELECT user_id, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM hourly GROUP BY ALL) h ON h.user_id = e.user_id
        LEFT JOIN (SELECT user_id, early_access_rank, early_access_score FROM early) r ON r.user_id = e.user_id""",
)
def early_warning_features(spark, d):
    """Enrolment, activity, tardiness, module, time-of-day and early-access features per student."""
    table = frames.early_warning_frame(
        inputs.members(spark, d), inputs.basics(spark, d).drop("final_score"), tables.tardiness(spark, d),
        inputs.completion(spark, d), F.lit(tables.COURSE_START).cast("timestamp"),
    )
    ranked = access.early_access_rank(materialise(table))
    return ranked.select(
        *activity.KEYS, "current_score", "final_score", "failed", *EW_COUNTS, "total_activity_time", "on_time_rate", "late_rate",
        "missing_rate", "module_completion_rate", "first_module_completed_at", "last_module_completed_at", "module_completion_span_days",
        "dominant_time", "is_morning_studier", "is_evening_studier", "first_activity_at", "last_activity_at", "activity_span_days",
        F.col("days_to_first_activity").cast("double").alias("days_to_first_activity"), "early_access_rank", "early_access_score",
    )


@query(
    "time_features", "rawgap act",
    f"""SELECT course_id, user_id, {', '.join(rnd(f'{s} / c', f'{s}_activity') for s in ('morning', 'afternoon', 'evening', 'night'))}, hod AS unique_active_hours,
               {rnd('avg_gap_hours')}, {rnd('gap_std_hours')}, activity_span_days, {rnd('conc', 'time_concentration')}
        FROM rawgap JOIN (SELECT user_id, sum(n) AS c, count(*) AS hod, sum(n * n) / (sum(n) * sum(n)) AS conc, coalesce(sum(n) FILTER (h BETWEEN 6 AND 11), 0) AS morning,
             coalesce(sum(n) FILTER (h BETWEEN 12 AND 17), 0) AS afternoon, coalesce(sum(n) FILTER (h >= 18), 0) AS evening, coalesce(sum(n) FILTER (h < 6), 0) AS night
             FROM (SELECT user_id, hour(ts) AS h, count(*) AS n FROM act GROUP BY ALL) GROUP BY user_id) USING (user_id)""",
)
def time_features(spark, d):
    return frames.time_features(inputs.hours(spark, d))


STAFF_FEATURES = [f for f in names.ALL_FEATURES if f not in ("first_module_day", "first_assignment_day")]


@query(
    "instructor_features", "eng",
    f"""SELECT course_id, user_id, CASE WHEN program IN ('BUILDING') THEN 'teacher' ELSE 'ta' END AS user_role, {', '.join(STAFF_FEATURES)}
        FROM eng JOIN (SELECT user_id, program FROM enr WHERE program IN ('BUILDING', 'MACHINERY')) USING (user_id)""",
)
def instructor_features(spark, d):
    """Teacher and TA rows: the activity profile of page views inside their course window, zero without views."""
    kind = F.when(F.col("program") == "BUILDING", "TeacherEnrollment").when(F.col("program") == "MACHINERY", "TaEnrollment")
    roster = inputs.members(spark, d).withColumn("type", kind)
    staff = frames.staff_roster(roster)
    table = frames.instructor_features(tables.activity(spark, d), staff, tables.courses(spark, d), tables.PARTICIPATION_KINDS)
    return table.select(*activity.KEYS, "user_role", *STAFF_FEATURES)
