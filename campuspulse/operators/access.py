"""First access, module completion and early-access ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campuspulse.functions.exprs import clip, course_days, days_since, floor_days
from campuspulse.operators.activity import KEYS
from campuspulse.operators.ranks import count_below, positions


def first_access(hours: DataFrame, start: Column, keys: list[str] | None = None) -> DataFrame:
    return hours.groupBy(*(keys or KEYS)).agg(
        F.min("first_ts").alias("first_activity_at"),
        days_since(F.min("first_ts"), F.min(start)).alias("first_access_day"),
    )


def access_time_pct(
    events: DataFrame, start: Column, end: Column, keys: list[str] | None = None, order: str = "event_id", first_n: int = 5
) -> DataFrame:
    """Geometric mean of the first ``first_n`` access times over the course duration.

    The row_number filter lets Spark keep only the first rows of each student
    before the shuffle, so a very active account costs no more than any other.
    """
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy("ts", order)
    share = clip(floor_days(F.col("ts"), start) / course_days(start, end), 0.001, 1.0)
    return (
        events.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= first_n)
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"), F.exp(F.avg(F.log(share))).alias("_g"))
        .select(*keys, F.when(F.col("_n") >= first_n, F.col("_g")).otherwise(0.0).alias("access_time_pct"))
    )


def hourly_access_terms(start: Column, end: Column, keys: list[str], first_n: int = 5) -> tuple[Column, Column]:
    """The same mean from hourly rows, each hour weighted by its share of the first views.

    Returns (weight, weight * log share) per row; exact when the course starts on the hour.
    """
    before = F.coalesce(
        F.sum("cnt").over(
            Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    weight = F.greatest(F.lit(0), F.least(F.col("cnt"), F.lit(first_n) - before))
    share = clip(floor_days(F.col("first_ts"), start) / course_days(start, end), 0.001, 1.0)
    return weight, weight * F.log(share)


def known_modules(progress: DataFrame, modules: DataFrame) -> DataFrame:
    """Progress rows whose module belongs to the course."""
    return progress.join(modules.select("course_id", "module_id"), ["course_id", "module_id"], "left_semi")


def with_module_names(progress: DataFrame, modules: DataFrame) -> DataFrame:
    """Module names looked up by (course, module); 'Unknown' where there is none."""
    names = modules.select("course_id", "module_id", "module_name")
    return progress.join(names, ["course_id", "module_id"], "left").withColumn(
        "module_name", F.coalesce("module_name", F.lit("Unknown"))
    )


def module_completion(progress: DataFrame, start: Column | None = None) -> DataFrame:
    """Completion rate and timing per student."""
    done = F.col("state") == "completed"
    at = F.when(done, F.col("completed_at"))
    columns = [
        F.count_if(done).alias("modules_completed"),
        F.count("*").alias("modules_total"),
        (F.count_if(done) / F.count("*")).alias("module_completion_rate"),
        F.min(at).alias("first_module_completed_at"),
        F.max(at).alias("last_module_completed_at"),
        F.coalesce(floor_days(F.max(at), F.min(at)), F.lit(0)).alias("module_completion_span_days"),
    ]
    if start is not None:
        columns.append(
            F.coalesce(days_since(F.min("completed_at"), F.min(start)), F.lit(0)).alias("first_module_day")
        )
    return progress.groupBy(*KEYS).agg(*columns)


def module_ranks(progress: DataFrame, module_keys: list[str] | None = None) -> DataFrame:
    """Min-rank of completion within the module and its normalised form.

    All non-null completion times are ranked, the divisor counts completed states.
    Ranks come from counts of distinct completion times, so a module shared by a
    third of all students is not sorted in one task.
    """
    module_keys = module_keys or ["course_id", "module_id"]
    below = count_below(
        progress.where("completed_at is not null"), module_keys, "completed_at",
        coarse=F.date_trunc("day", "completed_at"),
    ).select(*module_keys, "completed_at", (F.col("n_below") + 1).alias("completion_rank"))
    completers = progress.groupBy(*module_keys).agg(
        F.count_if(F.col("state") == "completed").alias("completers_in_module")
    )
    many = F.col("completers_in_module") > 1
    norm = F.when(
        many, (F.col("completion_rank") - 1) / F.nullif(F.col("completers_in_module") - 1, F.lit(0))
    ).otherwise(0.5)
    return (
        progress.join(below, [*module_keys, "completed_at"], "left")
        .join(completers, module_keys)
        .withColumn("completion_rank_normalized", norm)
    )


def module_timing(ranked: DataFrame) -> DataFrame:
    """Per student: completion share, average normalised rank and early-access score."""
    done = F.col("state") == "completed"
    avg_rank = F.coalesce(F.avg(F.when(done, F.col("completion_rank_normalized"))), F.lit(0.5))
    return ranked.groupBy(*KEYS).agg(
        (F.count_if(done) / F.count("*")).alias("module_completion_pct"),
        avg_rank.alias("avg_completion_rank"),
        (1 - avg_rank).alias("early_access_score"),
    )


def module_summary(ranked: DataFrame) -> DataFrame:
    """Completers and worst rank per module, completed rows only."""
    return (
        ranked.where("state = 'completed'")
        .groupBy("course_id", "module_id")
        .agg(F.count("*").alias("completers"), F.max("completion_rank").alias("max_rank"))
    )


def early_access_rank(students: DataFrame, first_done: str = "first_module_completed_at") -> DataFrame:
    """Position of each student by first completion within the course, and its score.

    Ties go by user_id. Students without a completion follow all others and score 0.
    """
    timed = students.where(F.col(first_done).isNotNull())
    placed = positions(
        timed, ["course_id"], [first_done, "user_id"],
        coarse=[F.date_trunc("day", first_done), None],
    )
    sizes = students.groupBy("course_id").agg(F.count(first_done).alias("_timed"))
    rank = F.col("position")
    score = F.when(
        rank.isNotNull(),
        F.when(F.col("_timed") > 1, 1 - (rank - 1) / F.nullif(F.col("_timed") - 1, F.lit(0))).otherwise(0.5),
    ).otherwise(0.0)
    return (
        students.join(placed.select(*KEYS, "position"), KEYS, "left")
        .join(sizes, "course_id")
        .withColumn("early_access_rank", F.coalesce(rank, F.col("_timed") + 1))
        .withColumn("early_access_score", score)
        .drop("position", "_timed")
    )
