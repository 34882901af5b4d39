"""Student-level frames composed from the finer operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campuspulse.functions import features as names
from campuspulse.functions.exprs import (
    SLOTS,
    course_weeks,
    day_block,
    days_since,
    engagement_composite,
    failed,
    floor_days,
    hours_between,
    iso_week,
    ratio_or_null,
    role_of,
    safe_ratio,
    slot_of_day,
)
from campuspulse.operators.access import hourly_access_terms
from campuspulse.operators.activity import KEYS, hourly
from campuspulse.operators.calendar import BLOCKS, cnt_if, dct_terms, week_block_shares, with_dominant
from campuspulse.operators.ranks import attach_row, positions
from campuspulse.operators.sessions import regularity
from campuspulse.operators.weekly import trajectory_aggs, workload_aggs, weekly_series

def zero() -> Column:
    return F.lit(0.0)


def time_features(hours: DataFrame) -> DataFrame:
    """Slot shares, active hours of the day, concentration and raw gaps per student.

    Hours of the day fold first, so the last step sees at most 24 rows per student.
    """
    w = Window.partitionBy(*KEYS).orderBy("hour")
    gap = hours_between(F.col("hour"), F.lag("hour").over(w))
    long_gap = F.when(F.col("_gap") > 0.5, F.col("_gap"))
    by_hour = (
        hours.withColumn("_gap", gap)
        .groupBy(*KEYS, F.hour("hour").alias("_h"))
        .agg(
            F.sum("cnt").alias("cnt"), F.min("hour").alias("_first"), F.max("hour").alias("_last"),
            F.count(long_gap).alias("_n"), F.sum(long_gap).alias("_s"), F.sum(long_gap * long_gap).alias("_q"),
        )
    )
    total, n = F.sum("cnt"), F.sum("_n")
    mean = F.coalesce(F.try_divide(F.sum("_s"), n), zero())
    var = F.coalesce(F.try_divide(F.sum("_q"), n), zero()) - mean * mean
    h = F.col("_h")
    slots = {"morning": (6, 11), "afternoon": (12, 17), "evening": (18, 23), "night": (0, 5)}
    return by_hour.groupBy(*KEYS).agg(
        *[safe_ratio(cnt_if(h.between(*r)), total).alias(f"{s}_activity") for s, r in slots.items()],
        F.count("*").alias("unique_active_hours"),
        F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias("_sq"), total.alias("_total"),
        mean.alias("avg_gap_hours"),
        F.when(n > 1, F.sqrt(F.greatest(var, zero()))).otherwise(zero()).alias("gap_std_hours"),
        F.floor(hours_between(F.max("_last"), F.min("_first")) / 24).alias("activity_span_days"),
    ).withColumn("time_concentration", F.col("_sq") / (F.col("_total") * F.col("_total"))).drop("_sq", "_total")


def keys_of(df: DataFrame) -> list[str]:
    """(course_id, user_id), or user_id alone for frames that carry no course."""
    return [k for k in KEYS if k in df.columns]


def activity_basics(hours: DataFrame, carry: tuple[str, ...] = (), evening_end: int = 22) -> DataFrame:
    """Views, participations, seconds, gaps between active hours, slots and span per student.

    One aggregate over hourly rows with ``parts`` and ``seconds``; ``carry`` names
    columns that are constant per student.
    """
    w = Window.partitionBy(*KEYS).orderBy("hour")
    rows = hours.withColumn("_gap", hours_between(F.col("hour"), F.lag("hour").over(w))).withColumn(
        "_slot", slot_of_day(F.col("hour"), evening_end)
    )
    long_gap = F.when(F.col("_gap") > 0.5, F.col("_gap"))
    counts = rows.groupBy(*KEYS, *carry).agg(
        F.sum("cnt").alias("page_views"),
        F.sum("parts").alias("participations"),
        F.sum("seconds").alias("total_activity_time"),
        F.min("first_ts").alias("first_activity_at"),
        F.max("last_ts").alias("last_activity_at"),
        F.count("*").alias("unique_active_hours"),
        F.coalesce(F.avg(long_gap), zero()).alias("avg_gap_hours"),
        F.coalesce(F.stddev_pop(long_gap), zero()).alias("gap_std_hours"),
        F.floor(hours_between(F.max("hour"), F.min("hour")) / 24).alias("activity_span_days"),
        *[cnt_if(F.col("_slot") == s).alias(f"{s}_activity") for s in SLOTS],
    )
    return with_dominant(counts)


def activity_profile(hours: DataFrame, gap_hours: float = 1.0) -> DataFrame:
    """All activity features in one pass over hourly rows partitioned by student.

    ``hours`` carries (course_id, user_id, hour, first_ts, last_ts, cnt, start_at,
    end_at) and is hash-partitioned by student after its join with enrolments.
    Hour rows fold into week rows, week rows into one row per student; both steps
    and all windows reuse that partitioning, so no further shuffle is added.
    """
    totals = [c for c in ("parts", "seconds") if c in hours.columns]
    w = Window.partitionBy(*KEYS).orderBy("hour")
    weight, log_share = hourly_access_terms(F.col("start_at"), F.col("end_at"), KEYS)
    rows = (
        hours.withColumn("_gap", hours_between(F.col("first_ts"), F.lag("last_ts").over(w)))
        .withColumn("_w", weight)
        .withColumn("_wlog", log_share)
        .withColumn("_block", day_block(F.col("hour")))
    )
    inter = F.when(F.col("_gap") >= gap_hours, F.col("_gap"))
    share = week_block_shares()
    weeks = rows.groupBy(*KEYS, iso_week(F.col("hour")).alias("week")).agg(
        F.sum("cnt").alias("cnt"),
        F.count("*").alias("h_n"),
        F.min("first_ts").alias("h_first"),
        F.max("last_ts").alias("h_last"),
        F.min("start_at").alias("start_at"),
        F.min("end_at").alias("end_at"),
        F.count(inter).alias("g_n"),
        F.min(inter).alias("g_min"),
        F.max(inter).alias("g_max"),
        F.sum(inter).alias("g_sum"),
        (F.var_pop(inter) * F.count(inter)).alias("g_m2"),
        F.sum("_w").alias("a_n"),
        F.sum("_wlog").alias("a_log"),
        *[F.sum(x).alias(x) for x in totals],
        *[cnt_if(F.col("_block") == b).alias(f"b_{b}") for b in BLOCKS],
        *[c.alias(f"s_{n}") for n, c in share.items()],
        *[c.alias(f"d_{k}") for k, c in enumerate(dct_terms())],
    )
    series = weekly_series(weeks)
    n, g_n = F.sum("cnt"), F.sum("g_n")
    gap_mean = F.coalesce(F.try_divide(F.sum("g_sum"), g_n), zero())
    # Pooled variance: within-week sums of squares plus the weeks' mean offsets.
    between = F.sum(F.try_divide(F.col("g_sum") * F.col("g_sum"), F.col("g_n"))) - F.try_divide(
        F.sum("g_sum") * F.sum("g_sum"), g_n
    )
    gap_var = F.try_divide(F.sum("g_m2") + F.greatest(between, zero()), g_n)
    gap_std = F.when(g_n > 1, F.sqrt(F.greatest(gap_var, zero()))).otherwise(zero())
    weeks_long = course_weeks(F.min("start_at"), F.min("end_at"))
    count = F.when(n >= 2, g_n + 1).otherwise(0)
    return series.groupBy(*KEYS).agg(
        n.alias("total_page_views"),
        *([F.sum("parts").alias("total_participations")] if "parts" in totals else []),
        count.alias("session_count"),
        F.coalesce(F.min("g_min"), zero()).alias("session_gap_min"),
        F.coalesce(F.max("g_max"), zero()).alias("session_gap_max"),
        gap_mean.alias("session_gap_mean"),
        gap_std.alias("session_gap_std"),
        regularity(gap_mean, gap_std).alias("session_regularity"),
        (count / weeks_long).alias("sessions_per_week"),
        *[safe_ratio(F.sum(f"b_{b}"), n).alias(f"{b}_pct") for b in BLOCKS],
        *[F.coalesce(F.stddev_pop(f"s_{s}"), zero()).alias(f"{s}_sd") for s in share],
        *[F.coalesce(F.try_divide(F.sum(f"d_{k}"), n), zero()).alias(f"dct_coef_{k}") for k in range(12)],
        *[c.alias(name) for name, c in trajectory_aggs().items()],
        *[c.alias(name) for name, c in workload_aggs().items()],
        days_since(F.min("h_first"), F.min("start_at")).alias("first_access_day"),
        F.when(F.sum("a_n") >= 5, F.exp(F.sum("a_log") / F.sum("a_n"))).otherwise(zero()).alias("access_time_pct"),
        F.floor(hours_between(F.max("h_last"), F.min("h_first")) / 24).alias("activity_span_days"),
        F.sum("h_n").alias("unique_active_hours"),
    )


def student_engagement_features(
    members: DataFrame, profile: DataFrame, modules: DataFrame, null_score: str = "keep"
) -> DataFrame:
    """The full student feature row: ids, target and 54 features, zero where nothing was seen.

    ``modules`` has first_module_day per student.
    """
    joined = members.join(profile, KEYS, "left").join(modules, keys_of(modules), "left")
    kinds = dict(joined.dtypes)
    # First assignment access is part of the row but is never observed.
    seen = F.coalesce(F.col("total_page_views"), F.lit(0)) > 0
    columns = [
        F.lit(0.0).alias(f) if f == "first_assignment_day"
        # Access days exist only where a click was seen.
        else F.when(seen, F.coalesce(F.col(f), F.lit(0).cast(kinds[f]))).otherwise(F.lit(0).cast(kinds[f])).alias(f) if f == "first_module_day"
        else F.coalesce(F.col(f), F.lit(0).cast(kinds[f])).alias(f)
        for f in names.ALL_FEATURES
    ]
    return joined.select(
        *KEYS, F.lit("student").alias("user_role"), "final_score",
        failed(F.col("final_score"), null_score).alias("failed"), *columns,
    )


def zscore_within(
    df: DataFrame, columns: list[str], by: list[str] | None = None, sample: bool = True, suffix: str = "_norm"
) -> DataFrame:
    """Standardise columns within groups (``by=[]``: over all rows); zero where there is no spread.

    ``sample`` chooses the n-1 deviation; otherwise population, and a group of one
    row keeps its values. Group moments are aggregated and joined back instead of
    windowed, so one large course is never gathered in one task.
    """
    by = ["course_id"] if by is None else by
    std = F.stddev_samp if sample else F.stddev_pop
    stats = df.groupBy(*by).agg(
        F.count("*").alias("_rows"),
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[std(c).alias(f"_s_{c}") for c in columns],
    )

    def scaled(c: str) -> Column:
        centred = F.col(c) - F.col(f"_m_{c}")
        z = F.when(F.col(f"_s_{c}") > 0, centred / F.nullif(F.col(f"_s_{c}"), zero())).otherwise(zero())
        return z if sample else F.when(F.col("_rows") > 1, z).otherwise(F.col(c).cast("double"))

    joined = df.join(stats, by) if by else attach_row(df, stats)
    return joined.select(*df.columns, *[scaled(c).alias(f"{c}{suffix}") for c in columns])


def submission_stats(subs: DataFrame, keys: list[str] | None = None, variant: str = "population") -> DataFrame:
    """Submission counts and score statistics.

    population: ``num_submissions`` counts submitted rows, std is population with 0
    below two scores, the first score is that of the lowest assignment.
    sample: ``num_submissions`` counts scores, std is the sample deviation (null below
    two), the first score is the earliest submitted.
    """
    keys = keys or KEYS
    score, has = F.col("score"), F.col("score").isNotNull()
    if variant == "population":
        number = F.count("submitted_at")
        std = F.coalesce(F.stddev_pop("score"), zero())
        order = F.struct("assignment_id", "submitted_at", "submission_id")
    elif variant == "sample":
        number = F.count("score")
        std = F.stddev_samp("score")
        order = F.struct("submitted_at", "submission_id")
    else:
        raise ValueError(variant)
    return subs.groupBy(*keys).agg(
        number.alias("num_submissions"),
        F.count_if(F.col("workflow_state") == "graded").alias("num_graded"),
        F.count("score").alias("num_scores"),
        F.avg("score").alias("avg_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        std.alias("score_std"),
        F.min_by("score", F.when(has, order)).alias("first_score"),
    )


def submission_flags(subs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Late, missing and excused counts next to the score statistics."""
    return subs.groupBy(*(keys or KEYS)).agg(
        F.count("*").alias("submission_count"),
        F.avg("score").alias("score_mean"),
        F.stddev_samp("score").alias("score_std"),
        F.max("score").alias("score_max"),
        F.min("score").alias("score_min"),
        F.count_if(F.col("late")).alias("late_count"),
        F.count_if(F.col("missing")).alias("missing_count"),
        F.count_if(F.col("excused")).alias("excused_count"),
    )


def exam_pivot(subs: DataFrame, exams: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """exam_1_score .. exam_n_score by ascending exam id within the course.

    ``exams`` is the (course_id, assignment_id) list of exams: a handful per course.
    Submissions shrink to one score per (student, assignment) before any join.
    """
    order = Window.partitionBy("course_id").orderBy("assignment_id")
    numbered = exams.withColumn("exam_no", F.row_number().over(order)).where(F.col("exam_no") <= top)
    first = F.min_by("score", F.struct("submitted_at", "submission_id"))
    scores = subs.where("score is not null").groupBy("user_id", "assignment_id").agg(first.alias("score"))
    return (
        scores.join(members.select(*KEYS), "user_id")
        .join(numbered, ["course_id", "assignment_id"])
        .groupBy(*KEYS)
        .agg(*[F.max(F.when(F.col("exam_no") == i, F.col("score"))).alias(f"exam_{i}_score") for i in range(1, top + 1)])
    )


def tardiness_rates(df: DataFrame) -> DataFrame:
    """on_time / late / missing shares, zero without required work."""
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("on_time", "late", "missing")}
    total = counts["on_time"] + counts["late"] + counts["missing"]
    return df.withColumns({f"{c}_rate": safe_ratio(v, total) for c, v in counts.items()})


def max_norm_engagement(df: DataFrame) -> DataFrame:
    """Half page views plus half participations, each over the course maximum."""
    tops = df.groupBy("course_id").agg(F.max("page_views").alias("_pv"), F.max("participations").alias("_pt"))

    def share(c: str, top: str) -> Column:
        ceiling = F.when(F.col(top) > 0, F.col(top)).otherwise(1)
        return F.coalesce(F.col(c), F.lit(0)) / ceiling

    return (
        df.join(tops, "course_id")
        .withColumn("activity_engagement", share("page_views", "_pv") * 0.5 + share("participations", "_pt") * 0.5)
        .drop("_pv", "_pt")
    )


def course_student_frame(
    members: DataFrame, summaries: DataFrame, tardiness: DataFrame, sub_stats: DataFrame, n_assignments: DataFrame,
    exams: DataFrame | None = None,
) -> DataFrame:
    """Scores, activity, tardiness and submission features per enrolled student."""
    seen = members.join(summaries, keys_of(summaries), "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("page_views", "participations")}
    )
    # Course maxima need the activity counts only, so they are taken before the wider joins.
    df = max_norm_engagement(seen).join(tardiness, keys_of(tardiness), "left").join(sub_stats, keys_of(sub_stats), "left")
    if exams is not None:
        df = df.join(exams, KEYS, "left")
    filled = [
        c for c in ("page_views", "participations", "total_activity_time", "on_time", "late", "missing",
                    "num_submissions", "num_graded", "num_scores") if c in df.columns
    ]
    df = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in filled})
    df = df.join(n_assignments, "course_id", "left").withColumn(
        "submission_rate", F.col("num_submissions") / F.greatest(F.coalesce("n_assignments", F.lit(1)), F.lit(1))
    )
    return tardiness_rates(df.drop("n_assignments"))


def grade_prediction_frame(members: DataFrame, summaries: DataFrame, flags: DataFrame) -> DataFrame:
    """Enrolments joined with summaries and submission flags, plus the composite score."""
    df = members.join(summaries, keys_of(summaries)).join(flags, keys_of(flags), "left")
    df = df.withColumn("late_pct", ratio_or_null(F.col("late_count"), F.col("submission_count"))).withColumn(
        "missing_pct", ratio_or_null(F.col("missing_count"), F.col("submission_count"))
    )
    return df.withColumn(
        "engagement_score",
        engagement_composite(
            F.col("page_views_level"), F.col("participations_level"), F.col("late_pct"), F.col("missing_pct")
        ),
    )


def activity_level(df: DataFrame, by: str = "course_id", value: str = "page_views") -> DataFrame:
    """Thirds of the classmates by activity: 1-3, 0 without activity.

    Follows ``ntile(3)`` with ties by user_id, built on sliced positions.
    """
    seen = df.where(F.col(value) > 0)
    # 64 slices per doubling of the count keep the order and stay few at any size.
    placed = positions(
        seen, [by], [value, "user_id"], [F.floor(64 * F.log2(F.col(value))), None]
    )
    sizes = seen.groupBy(by).agg(F.count("*").alias("_n"))
    base, extra = F.floor(F.col("_n") / 3), F.col("_n") % 3
    cut = (base + 1) * extra
    pos = F.col("position")
    tile = F.when(pos <= cut, F.floor((pos - 1) / (base + 1)) + 1).otherwise(
        extra + F.floor((pos - 1 - cut) / F.greatest(base, F.lit(1))) + 1
    )
    levels = placed.join(sizes, by).select(by, "user_id", tile.alias(f"{value}_level"))
    return df.join(levels, [by, "user_id"], "left").withColumn(
        f"{value}_level", F.coalesce(F.col(f"{value}_level"), F.lit(0))
    )


def early_warning_frame(
    members: DataFrame, basics: DataFrame, tardiness: DataFrame, completion: DataFrame, start: Column
) -> DataFrame:
    """Enrolment, activity, tardiness, modules and time of day; a missing score counts as failed.

    Days to the first activity stay null where nothing was seen.
    """
    df = (
        members.join(basics, keys_of(basics), "left")
        .join(tardiness, keys_of(tardiness), "left")
        .join(completion, keys_of(completion), "left")
        .withColumn("failed", failed(F.col("final_score"), "fail"))
        .withColumn("dominant_time", F.coalesce("dominant_time", F.lit("none")))
    )
    days = floor_days(F.col("first_activity_at"), start)
    kinds = dict(df.dtypes)
    zeros = [
        c for c, k in kinds.items()
        if k in ("int", "bigint", "double") and c not in (*KEYS, "account_id", "final_score", "current_score", "failed")
    ]
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) for c in zeros})
    return tardiness_rates(filled).withColumn("days_to_first_activity", days)


def staff_roster(enrollments: DataFrame) -> DataFrame:
    """Teacher and TA enrolments as one roster with their role."""
    return enrollments.where(F.contains("type", F.lit("Teacher")) | F.contains("type", F.lit("Ta"))).withColumn(
        "user_role", role_of(F.col("type"))
    )


def _windows(roster: DataFrame, courses: DataFrame) -> DataFrame:
    return roster.select(*KEYS).join(courses.select("course_id", "start_at", "end_at"), "course_id").where("start_at <= end_at")


def hours_in_window(events: DataFrame, roster: DataFrame, courses: DataFrame, **extra) -> DataFrame:
    """Hourly rows (as ``hourly`` by course and user) of events between the start and end of the user's course, inclusive.

    Events are folded to hours before they meet the roster. An hour that lies inside the window as a whole passes as it is; only the
    hours that a start or an end cuts, at most two for a course and user, go back to their events.
    """
    met = hourly(events, **extra).join(_windows(roster, courses), "user_id")
    inside = (F.col("first_ts") >= F.col("start_at")) & (F.col("last_ts") <= F.col("end_at"))
    touched = (F.col("last_ts") >= F.col("start_at")) & (F.col("first_ts") <= F.col("end_at"))
    columns = [*KEYS, "hour", "first_ts", "last_ts", "cnt", *extra]
    cut = met.where(touched & ~inside).select(*KEYS, F.col("hour").alias("_hour"), "start_at", "end_at")
    again = events.withColumn("_hour", F.date_trunc("hour", "ts")).join(cut, ["user_id", "_hour"]).where(F.col("ts").between(F.col("start_at"), F.col("end_at")))
    return met.where(inside).select(*columns).unionByName(hourly(again, keys=KEYS, **extra).select(*columns))


def heavy_users(events: DataFrame, share: float) -> DataFrame:
    """(user_id, n) of users that may hold at least ``share`` of all events: a frequent-item sketch, then their exact counts.

    The sketch keeps at most 1 / share items, which bounds what reaches the driver.
    """
    items = events.select("user_id").freqItems(["user_id"], share).first()[0]
    some = events.where(F.col("user_id").isin([i for i in items if i is not None])) if items else events.limit(0)
    return some.groupBy("user_id").agg(F.count("*").alias("n"))


def in_course_window(events: DataFrame, roster: DataFrame, courses: DataFrame) -> DataFrame:
    """Events of rostered users between the start and end of their course (inclusive), row by row; ``hours_in_window`` moves far less.

    A user with more events than a task's even share is dealt to tasks in proportion; all others are joined by id alone.
    """
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = events.count()
    even = max(1.0, total / tasks)
    # At most one row per task: a user heavier than the even share.
    salts = {r.user_id: math.ceil(r.n / even) for r in heavy_users(events, min(1.0, max(1e-4, 1 / tasks))).collect() if r.n > even}
    bounds = _windows(roster, courses)
    if salts:
        number = _salts_of(salts)
        events = events.withColumn("_salt", F.pmod(F.xxhash64("ts"), number).cast("int"))
        bounds = bounds.withColumn("_salt", F.explode(F.sequence(F.lit(0), number - 1)))
        met = events.join(bounds, ["user_id", "_salt"]).drop("_salt")
    else:
        met = events.join(bounds, "user_id")
    return met.where(F.col("ts").between(F.col("start_at"), F.col("end_at")))


def _salts_of(salts: dict[int, int]) -> Column:
    mapped = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
    return F.coalesce(F.try_element_at(mapped, F.col("user_id")), F.lit(1))


def instructor_features(views: DataFrame, staff: DataFrame, courses: DataFrame, participation_kinds: tuple[str, ...] = ()) -> DataFrame:
    """The student activity profile of page views inside the course window computed for staff, with their role; zero where nothing was seen."""
    parts = F.when(F.col("kind").isin(*participation_kinds), F.col("cnt")).otherwise(0)
    hours = hours_in_window(views, staff, courses, parts=F.sum(parts)).join(courses.select("course_id", "start_at", "end_at"), "course_id")
    joined = staff.select(*KEYS, "user_role").join(activity_profile(hours), KEYS, "left")
    kinds = dict(joined.dtypes)
    return joined.select(*KEYS, "user_role", *[F.coalesce(F.col(c), F.lit(0).cast(kinds[c])).alias(c) for c in joined.columns[3:]])
