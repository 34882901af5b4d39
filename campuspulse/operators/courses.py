"""Course- and department-level aggregates and rule-based course labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campuspulse.functions.exprs import PASS_MARK, safe_ratio, submission_status, valid_grade
from campuspulse.operators.activity import KEYS
from campuspulse.operators.ranks import attach_row, percentiles

RESOURCE_KINDS = ["modules", "assignments", "quizzes", "pages", "files", "discussions"]


def grade_stats(members: DataFrame, by: str = "course_id", score: str = "final_score") -> DataFrame:
    """n, mean, deviations, range, fail and pass rate per course."""
    s = F.col(score)
    fail = F.avg(F.when(s < PASS_MARK, 1.0).when(s.isNotNull(), 0.0))
    return members.groupBy(by).agg(
        F.count(score).alias("n"),
        F.avg(score).alias("grade_mean"),
        F.stddev_samp(score).alias("grade_std"),
        F.stddev_pop(score).alias("grade_std_pop"),
        F.min(score).alias("grade_min"),
        F.max(score).alias("grade_max"),
        fail.alias("fail_rate"),
        (1 - fail).alias("pass_rate"),
    )


def pass_rate(members: DataFrame, minimum: int = 5) -> DataFrame:
    return grade_stats(members).where(F.col("n") >= minimum).select(
        "course_id", (F.col("pass_rate") * 100).alias("pass_rate"), F.col("n").alias("total")
    )


def class_diversity(members: DataFrame, min_n: int = 10, min_std: float = 5.0) -> DataFrame:
    """Pass/fail mix of each course with enough students and spread."""
    rate = F.col("pass_rate")
    tag = (
        F.when((rate == 0) | (rate == 1), "LOW DIVERSITY")
        .when((rate < 0.2) | (rate > 0.8), "MODERATE")
        .otherwise("GOOD")
    )
    gated = quality_gate(members, min_n, min_std)
    return gated.select("course_id", "n", "pass_rate", tag.alias("class_diversity"))


def quality_gate(members: DataFrame, min_n: int = 15, min_std: float = 5.0, strict: bool = False) -> DataFrame:
    """Courses with enough graded students and enough spread (population std)."""
    std = F.col("grade_std_pop")
    return grade_stats(members).where((F.col("n") >= min_n) & ((std > min_std) if strict else (std >= min_std)))


def good_courses_only(students: DataFrame, diversity: DataFrame) -> DataFrame:
    """Students of courses whose diversity tag is GOOD."""
    return students.join(diversity.where("class_diversity = 'GOOD'"), "course_id", "left_semi")


def grade_audit(members: DataFrame, graded: DataFrame, score: str = "current_score") -> DataFrame:
    """Where a course's grades live: students, graded students and graded submissions."""
    per_course = members.groupBy("course_id").agg(
        F.count("*").alias("students"), F.count(score).alias("with_grades"),
        F.avg(score).alias("grade_mean"), F.stddev_pop(score).alias("grade_std"),
    )
    subs = graded.groupBy("course_id").agg(F.sum("num_scores").alias("graded_subs"))
    return per_course.join(subs, "course_id", "left").select(
        "course_id", "students", "with_grades", F.coalesce("graded_subs", F.lit(0)).alias("graded_subs"),
        "grade_mean", "grade_std",
        F.when(F.col("with_grades") > 0, "CANVAS").otherwise("EXTERNAL/NONE").alias("grade_source"),
    )


def course_potential(members: DataFrame, n_assignments: DataFrame) -> DataFrame:
    """HIGH / MEDIUM / LOW / LOW-VAR / SKIP from graded students, spread and assignments."""
    graded = grade_stats(members.where(F.col("final_score") > 0))
    everyone = members.select("course_id").distinct()
    df = everyone.join(graded, "course_id", "left").join(n_assignments, "course_id", "left")
    n_assign = F.coalesce("n_assignments", F.lit(0))
    has = F.coalesce(F.col("n") >= 10, F.lit(False))
    varied = has & (F.col("grade_std_pop") > 10)
    rec = (
        F.when(varied & (n_assign >= 5) & F.col("pass_rate").between(0.2, 0.8), "HIGH")
        .when(varied & (n_assign >= 3), "MEDIUM")
        .when(varied, "LOW")
        .when(has, "LOW-VAR")
        .otherwise("SKIP")
    )
    return df.select("course_id", has.alias("has_grades"), n_assign.alias("n_assignments"), rec.alias("recommendation"))


def course_filter(courses: DataFrame, term: int, fallback: int, min_students: int = 15) -> DataFrame:
    """Courses of a term with enough students; another term if that one has none."""
    big = courses.where(F.col("total_students") >= min_students)
    has_term = big.agg((F.count_if(F.col("enrollment_term_id") == term) > 0).alias("_has"))
    return attach_row(big, has_term).where(
        F.col("enrollment_term_id") == F.when(F.col("_has"), term).otherwise(fallback)
    ).drop("_has")


def _points(column: str, *steps: tuple[int, int]) -> Column:
    """Points of the first threshold reached, highest threshold first."""
    expr = None
    for at_least, points in steps:
        expr = F.when(F.col(column) >= at_least, points) if expr is None else expr.when(F.col(column) >= at_least, points)
    return expr.otherwise(0)


def design_quality(resources: DataFrame) -> DataFrame:
    """Instructional design points and their three levels. Thresholds and labels."""
    points = (
        _points("modules", (10, 3), (5, 2), (1, 1))
        + _points("assignments", (15, 3), (8, 2), (3, 1))
        + _points("quizzes", (10, 3), (5, 2), (1, 1))
        + _points("pages", (5, 1))
        + _points("discussions", (3, 1))
    )
    level = F.when(F.col("design_points") >= 8, "Excelente").when(F.col("design_points") >= 4, "Bueno").otherwise("Básico")
    score = F.when(F.col("design_points") >= 8, 3).when(F.col("design_points") >= 4, 2).otherwise(1)
    return resources.withColumn("design_points", points).withColumn("design_quality", level).withColumn("design_score", score)


def readiness(resources: DataFrame) -> DataFrame:
    """Analytics readiness 0-100 and its level. Thresholds."""
    score = F.least(
        F.lit(100),
        _points("modules", (5, 25), (3, 15))
        + _points("assignments", (10, 25), (5, 15))
        + _points("pages", (20, 20), (10, 10))
        + _points("files", (10, 15), (5, 8))
        + _points("quizzes", (3, 15), (1, 8)),
    )
    level = F.when(F.col("readiness_score") >= 70, "high").when(F.col("readiness_score") >= 40, "medium").otherwise("low")
    return resources.withColumn("readiness_score", score).withColumn("readiness_level", level)


def design_complexity(resources: DataFrame) -> DataFrame:
    total = F.col("total_resources")
    return resources.withColumn(
        "complexity", F.when(total > 500, "complex").when(total >= 100, "moderate").otherwise("simple")
    )


def high_potential(resources: DataFrame, min_resources: int = 50) -> DataFrame:
    return resources.where((F.col("total_resources") >= min_resources) & (F.col("students") > 0))


def quadrants(resources: DataFrame) -> DataFrame:
    """Median split of resources by median split of students."""
    med_r = percentiles(resources, [], "total_resources", {"_mr": 0.5})
    med_s = percentiles(resources, [], "students", {"_ms": 0.5})
    rich, busy = F.col("total_resources") > F.col("_mr"), F.col("students") > F.col("_ms")
    label = (
        F.when(rich & busy, "high potential")
        .when(busy, "needs content")
        .when(rich, "low reach")
        .otherwise("low potential")
    )
    return attach_row(attach_row(resources, med_r), med_s).withColumn("quadrant", label).drop("_mr", "_ms")


def minmax(column: str, low: str, high: str) -> Column:
    """Min-max scaling with the guard that keeps a constant column at zero."""
    return (F.col(column) - F.col(low)) / (F.col(high) - F.col(low) + 0.001)


def minmax_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column scaled by its own global range."""
    bounds = df.agg(
        *[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]
    )
    scaled = attach_row(df, bounds)
    return scaled.select(
        *df.columns, *[minmax(c, f"_lo_{c}", f"_hi_{c}").alias(f"{c}_scaled") for c in columns]
    )


def resource_totals(resources: DataFrame) -> DataFrame:
    """Total and average per resource category, in long form."""
    kinds = RESOURCE_KINDS
    wide = resources.agg(*[F.sum(k).alias(f"t_{k}") for k in kinds], *[F.avg(k).alias(f"a_{k}") for k in kinds])
    rows = F.array(*[
        F.struct(F.lit(k).alias("category"), F.col(f"t_{k}").alias("total"), F.col(f"a_{k}").alias("average")) for k in kinds
    ])
    return wide.select(F.inline(rows))


def course_engagement(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """Activity per course and its engagement level. Level thresholds."""
    df = members.join(summaries, KEYS, "left")
    views, parts = F.coalesce(F.col("page_views"), F.lit(0)), F.coalesce(F.col("participations"), F.lit(0))
    time = F.coalesce(F.col("total_activity_time"), F.lit(0.0))
    level = (
        F.when((F.col("avg_page_views") > 500) & (F.col("avg_participations") > 5), "High")
        .when((F.col("avg_page_views") > 200) | (F.col("avg_participations") > 2), "Medium")
        .otherwise("Low")
    )
    return (
        df.groupBy("course_id")
        .agg(
            F.count("*").alias("students"),
            (F.avg(time) / 3600).alias("avg_activity_time_hrs"),
            (F.sum(time) / 3600).alias("total_activity_time_hrs"),
            F.avg(views).alias("avg_page_views"),
            F.sum(views).alias("total_page_views"),
            F.avg(parts).alias("avg_participations"),
            F.sum(parts).alias("total_participations"),
            F.count_if(views > 0).alias("students_with_activity"),
            (F.count_if(views > 0) / F.count("*")).alias("activity_rate"),
        )
        .withColumn("engagement_level", level)
    )


def course_activity_comparison(members: DataFrame, summaries: DataFrame, by: str = "course_id") -> DataFrame:
    """Total views, average per student, coverage."""
    df = members.join(summaries, KEYS, "left")
    views = F.coalesce(F.col("page_views"), F.lit(0))
    return df.groupBy(by).agg(
        F.sum(views).alias("total_views"),
        F.avg(views).alias("avg_views_per_student"),
        safe_ratio(F.count_if(views > 0), F.count("*")).alias("coverage"),
    )


def course_coverage(members: DataFrame) -> DataFrame:
    """Sample size, grade range and failure rate per course with any grade above zero."""
    s = F.col("final_score")
    return (
        members.groupBy("course_id")
        .agg(
            F.count("*").alias("students"), F.count_if(s > 0).alias("with_grades"),
            F.min(F.when(s > 0, s)).alias("grade_low"), F.max(F.when(s > 0, s)).alias("grade_high"),
            F.avg(F.when(s > 0, F.when(s < PASS_MARK, 1.0).otherwise(0.0))).alias("fail_rate"),
        )
        .where("with_grades > 0")
    )


def summary_totals(members: DataFrame, subs: DataFrame, assignments: DataFrame) -> DataFrame:
    """One row of totals across courses."""
    a = members.agg(
        F.count_distinct("course_id").alias("courses"), F.count("*").alias("students"),
        F.avg("final_score").alias("grade_mean"), F.count_if(F.col("final_score") < PASS_MARK).alias("failed"),
    )
    b = subs.agg(F.count("*").alias("submissions"))
    c = assignments.agg(F.count("*").alias("assignments"))
    return attach_row(attach_row(a, b), c)


def activity_by_category(events: DataFrame) -> DataFrame:
    """Views by day and, separately, by category: two grouping sets over one scan."""
    daily = events.groupBy(F.to_date("ts").alias("day"), F.col("kind").alias("category")).agg(F.sum("cnt").alias("views"))
    return (
        daily.groupingSets([[F.col("day")], [F.col("category")]], "day", "category")
        .agg(F.sum("views").alias("views"))
        .select(F.col("day").cast("string").alias("day"), "category", "views")
    )


def dept_stats(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """Students, programmes and views per course and account, with subtotals and a grand total."""
    return (
        members.join(summaries, KEYS, "left")
        .rollup("course_id", "account_id")
        .agg(
            F.count("*").alias("students"), F.count_distinct("program").alias("programs"),
            F.sum(F.coalesce("page_views", F.lit(0))).alias("views"),
        )
        .select(
            F.coalesce(F.col("course_id").cast("string"), F.lit("all")).alias("course"),
            F.coalesce(F.col("account_id").cast("string"), F.lit("all")).alias("account"),
            "students", "programs", "views",
        )
    )


def assignment_stats(subs: DataFrame, by: list[str]) -> DataFrame:
    """Score range and quartiles with submission-status shares per assignment."""
    status = submission_status(F.col("submitted_at"), F.col("due_at"))
    counts = (
        subs.withColumn("_st", status)
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"),
            *[
                safe_ratio(F.count_if(F.col("_st") == s), F.count("*")).alias(f"{s}_share")
                for s in ("on_time", "late", "missing", "floating")
            ],
        )
    )
    quartiles = percentiles(
        subs, by, "score", {"first_quartile": 0.25, "median": 0.5, "third_quartile": 0.75}, F.floor("score")
    )
    return counts.join(quartiles, by, "left")


def grade_distribution(members: DataFrame, score: str = "final_score") -> DataFrame:
    """Students per integer score and course."""
    return members.where(F.col(score).isNotNull()).groupBy("course_id", F.round(score).cast("int").alias("score")).agg(
        F.count("*").alias("n")
    )


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over the column's own range; the last bin is closed.

    A constant column gets a range of one around its value.
    """
    low, high = F.min(column).cast("double"), F.max(column).cast("double")
    pad = F.when(low == high, 0.5).otherwise(0.0)
    bounds = df.agg((low - pad).alias("_lo"), (high + pad).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("_lo")) / width))
    return (
        attach_row(df.where(F.col(column).isNotNull()), bounds)
        .groupBy(*(by or []), b.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def box_stats(members: DataFrame, minimum: int = 5, score: str = "final_score", by: str = "course_id") -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per course."""
    q = percentiles(members, [by], score, {"q1": 0.25, "median": 0.5, "q3": 0.75}, F.floor(score))
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    s = F.col(score)
    return (
        members.where(s.isNotNull()).join(q, by)
        .groupBy(by, "q1", "median", "q3")
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(s >= low, s)).alias("whisker_low"), F.max(F.when(s <= high, s)).alias("whisker_high"),
            F.count_if((s < low) | (s > high)).alias("outliers"),
        )
        .where(F.col("n") >= minimum)
    )


def recent_students(events: DataFrame) -> DataFrame:
    """Students by last activity, latest first."""
    return events.groupBy("user_id").agg(F.max("ts").alias("last_login")).orderBy(F.desc("last_login"), "user_id")


def priority_courses(designed: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Well-designed courses whose grades are kept elsewhere."""
    return designed.where("design_quality in ('Excelente', 'Bueno')").join(
        sources.where("with_grades = 0").select(key), key, "left_semi"
    )


def top_courses(df: DataFrame, column: str, n: int, tie: str) -> DataFrame:
    """The n largest by a column; the unique tie breaker makes the cut repeatable."""
    return df.orderBy(F.desc(column), tie).limit(n)


def current_final_score(subs: DataFrame, by: list[str], weights: DataFrame | None = None, default_weight: float = 1.0) -> DataFrame:
    """Current score over graded work and final score with missing work as zero.

    ``weights`` (assignment_id, weight) makes both weighted means. Work without a weight keeps its row and its student and
    counts with ``default_weight``.
    """
    w = F.coalesce(F.col("weight"), F.lit(default_weight)) if weights is not None else F.lit(1.0)
    df = subs.join(weights, "assignment_id", "left") if weights is not None else subs
    graded = F.when(F.col("score").isNotNull(), w)
    earned = F.sum(F.col("score") * w)
    return df.groupBy(*by).agg(
        F.try_divide(earned, F.sum(graded)).alias("current_score"),
        F.try_divide(F.coalesce(earned, F.lit(0.0)), F.sum(w)).alias("final_score"),
    )


def group_weighted_score(subs: DataFrame, by: list[str], groups: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores by assignment group, then their weighted mean: (by, current_score, final_score, n_unweighted).

    ``groups`` is (assignment_id, group_id), ``weights`` (group_id, weight). A group's current score is the mean over
    graded work, its final score counts missing work as zero; the current mean takes groups with graded work. Work outside a
    weighted group stays in the table with weight zero and is counted in ``n_unweighted``; a student with no weighted
    group at all gets the plain mean.
    """
    known = subs.join(groups, "assignment_id", "left").join(weights, "group_id", "left")
    per_group = known.groupBy(*by, "group_id").agg(
        F.avg("score").alias("current"), (F.coalesce(F.sum("score"), F.lit(0.0)) / F.count("*")).alias("final"),
        F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.count("*").alias("n"),
        F.count("score").alias("graded"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("earned"),
    )
    weight = F.col("weight")
    graded = F.when(F.col("graded") > 0, weight)
    return per_group.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.sum(F.col("current") * weight), F.sum(graded)), F.try_divide(F.sum("earned"), F.sum("graded"))).alias("current_score"),
        F.coalesce(F.try_divide(F.sum(F.col("final") * weight), F.sum(weight)), F.sum("earned") / F.sum("n")).alias("final_score"),
        F.sum(F.when(weight == 0, F.col("n")).otherwise(0)).alias("n_unweighted"),
    )


def department_statistics(members: DataFrame, assignments: DataFrame, modules: DataFrame) -> DataFrame:
    """Courses, teachers, students and items per department; a person counts once.

    ``members`` carries (account_id, course_id, user_id, user_role), the others (course_id, id) of the courses' items.
    """
    people = members.groupBy("account_id").agg(
        F.count_distinct("course_id").alias("courses"),
        F.count_distinct(F.when(F.col("user_role") == "teacher", F.col("user_id"))).alias("teachers"),
        F.count_distinct(F.when(F.col("user_role") == "student", F.col("user_id"))).alias("students"),
    )
    held = members.select("account_id", "course_id").distinct()
    items = held.join(assignments.groupBy("course_id").agg(F.count_distinct("id").alias("a")), "course_id", "left").join(
        modules.groupBy("course_id").agg(F.count_distinct("id").alias("m")), "course_id", "left")
    totals = items.groupBy("account_id").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("assignments"), F.coalesce(F.sum("m"), F.lit(0)).alias("modules"))
    return people.join(totals, "account_id")


def class_balance(members: DataFrame) -> DataFrame:
    s = F.col("final_score")
    return members.groupBy("course_id").agg(
        F.count_if(s >= PASS_MARK).alias("passed"), F.count_if(s < PASS_MARK).alias("failed"),
    ).withColumn("trainable", (F.col("passed") > 0) & (F.col("failed") > 0) & (F.col("passed") + F.col("failed") >= 20))


def feasibility(metrics: DataFrame) -> DataFrame:
    """100 * (0.4 * mean r2 + 0.6 * mean F1) over a table of model metrics."""
    return metrics.agg((100 * (0.4 * F.avg("r2") + 0.6 * F.avg("f1"))).alias("feasibility"))


def resource_view_share(views: DataFrame, totals: DataFrame) -> DataFrame:
    """Distinct resources viewed per student over the resources of the course."""
    seen = views.select(*KEYS, "url").distinct().groupBy(*KEYS).agg(F.count("*").alias("viewed"))
    return seen.join(totals, "course_id", "left").select(
        *KEYS, "viewed", safe_ratio(F.col("viewed"), F.col("resources")).alias("resource_view_pct")
    )


def with_course_names(df: DataFrame, courses: DataFrame) -> DataFrame:
    """Course names looked up by id; the id itself where there is none."""
    names = courses.select("course_id", "course_name")
    return df.join(names, "course_id", "left").withColumn(
        "course_name", F.coalesce("course_name", F.concat(F.lit("Course "), F.col("course_id")))
    )


def valid_students(members: DataFrame) -> DataFrame:
    return members.where(valid_grade(F.col("final_score")))
