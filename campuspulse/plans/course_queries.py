"""Frames, course tables, rules, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from campuspulse.functions import exprs
from campuspulse.operators import courses, frames, ranks
from campuspulse.operators.activity import KEYS, daily_activity as daily
from campuspulse.plans import inputs
from campuspulse.plans.registry import add_cte, big, query, rnd
from campuspulse.session import materialise
from campuspulse.sources import readers, tables


def course_subs(spark, d):
    """Submissions with the student's course."""
    return tables.submissions(spark, d).join(inputs.members(spark, d).select(*KEYS), "user_id")


def n_assignments(spark, d):
    return tables.assignments(spark, d).groupBy("course_id").agg(F.count("*").alias("n_assignments"))


def user_stats(spark, d, variant="population"):
    """Submission statistics per user."""
    return frames.submission_stats(tables.submissions(spark, d), ["user_id"], variant)


def user_sub_stats(spark, d, variant="population"):
    """The same with the student's course, reduced before the join with enrolments."""
    return user_stats(spark, d, variant).join(inputs.members(spark, d).select(*KEYS), "user_id")


# --- frames -----------------------------------------------------------------------

add_cte("subst", """
    SELECT course_id, user_id, count(submitted_at) AS num_submissions, count(*) FILTER (workflow_state = 'graded') AS num_graded,
           count(score) AS num_scores, avg(score) AS avg_score, min(score) AS min_score, max(score) AS max_score,
           coalesce(stddev_pop(score), 0) AS std_pop, stddev_samp(score) AS std_samp,
           first(score ORDER BY assignment_id, submitted_at, submission_id) FILTER (score IS NOT NULL) AS first_by_assignment,
           first(score ORDER BY submitted_at, submission_id) FILTER (score IS NOT NULL) AS first_by_time
    FROM sub GROUP BY ALL""", ["sub"])

SUB_COLS = f"num_graded, num_scores, {rnd('avg_score')}, {rnd('min_score')}, {rnd('max_score')}"


@query(
    "submission_stats", "subst",
    f"SELECT course_id, user_id, num_submissions, {SUB_COLS}, {rnd('std_pop', 'score_std')}, {rnd('first_by_assignment', 'first_score')} FROM subst",
)
def submission_stats(spark, d):
    return user_sub_stats(spark, d)


@query(
    "submission_stats_sample", "subst",
    f"SELECT course_id, user_id, num_scores AS num_submissions, {SUB_COLS}, {rnd('std_samp', 'score_std')}, {rnd('first_by_time', 'first_score')} FROM subst",
)
def submission_stats_sample(spark, d):
    return user_sub_stats(spark, d, "sample")


def flagged(spark, d):
    subs = tables.submissions(spark, d)
    status = exprs.submission_status(F.col("submitted_at"), F.col("due_at"))
    return subs.withColumns({
        "late": status == "late", "missing": status == "missing",
        "excused": F.col("due_at").isNull() & F.col("submitted_at").isNull(),
    })


add_cte("flags", """
    SELECT course_id, user_id, count(*) AS submission_count, avg(score) AS score_mean, stddev_samp(score) AS score_std,
           max(score) AS score_max, min(score) AS score_min,
           count(*) FILTER (due_at IS NOT NULL AND submitted_at > due_at) AS late_count,
           count(*) FILTER (due_at IS NOT NULL AND submitted_at IS NULL) AS missing_count,
           count(*) FILTER (due_at IS NULL AND submitted_at IS NULL) AS excused_count
    FROM sub GROUP BY ALL""", ["sub"])


@query(
    "submission_flags", "flags",
    f"SELECT course_id, user_id, submission_count, {rnd('score_mean')}, {rnd('score_std')}, {rnd('score_max')}, {rnd('score_min')}, late_count, missing_count, excused_count FROM flags",
)
def submission_flags(spark, d):
    per_user = frames.submission_flags(flagged(spark, d), ["user_id"])
    return per_user.join(inputs.members(spark, d).select(*KEYS), "user_id")


add_cte("exams", """
    SELECT course_id, user_id, """ + ", ".join(
    f"max(score) FILTER (no = {i}) AS exam_{i}_score" for i in range(1, 6)) + """
    FROM (SELECT s.course_id, s.user_id, no, s.score, row_number() OVER (PARTITION BY s.user_id, s.assignment_id ORDER BY submitted_at, submission_id) AS pick
          FROM sub s JOIN (SELECT course_id, assignment_id, row_number() OVER (PARTITION BY course_id ORDER BY assignment_id) AS no
                           FROM (SELECT DISTINCT course_id, assignment_id FROM sub) WHERE assignment_id % 2 = 1) USING (course_id, assignment_id)
          WHERE score IS NOT NULL)
    WHERE pick = 1 GROUP BY ALL""", ["sub"])


def exam_scores(spark, d):
    exams = tables.assignments(spark, d).where(exprs.name_matches(F.col("name"), "sumativa"))
    return frames.exam_pivot(tables.submissions(spark, d), exams.select("course_id", "assignment_id"), inputs.members(spark, d))


@query("exam_pivot", "exams", "SELECT course_id, user_id, " + ", ".join(rnd(f"exam_{i}_score") for i in range(1, 6)) + " FROM exams")
def exam_pivot(spark, d):
    return exam_scores(spark, d)


RATES = ", ".join(rnd(f"CASE WHEN on_time + late + missing > 0 THEN {c} / (on_time + late + missing) ELSE 0 END", f"{c}_rate") for c in ("on_time", "late", "missing"))


@query("tardiness_rates", "tard", f"SELECT user_id, on_time, late, missing, {RATES} FROM tard")
def tardiness_rates(spark, d):
    return frames.tardiness_rates(tables.tardiness(spark, d))


add_cte("nasg", "SELECT course_id, count(DISTINCT assignment_id) AS n_assignments FROM sub GROUP BY ALL", ["sub"])
add_cte("csf", """
    SELECT e.course_id, e.user_id, e.final_score, coalesce(page_views, 0) AS page_views, coalesce(participations, 0) AS participations,
           coalesce(total_activity_time, 0) AS total_activity_time, coalesce(on_time, 0) AS on_time, coalesce(late, 0) AS late, coalesce(missing, 0) AS missing,
           coalesce(num_submissions, 0) AS num_submissions, coalesce(num_scores, 0) AS num_scores, avg_score, std_pop AS score_std, first_by_assignment AS first_score,
           exam_1_score, exam_2_score, exam_3_score, coalesce(num_submissions, 0) / n_assignments AS submission_rate
    FROM enr e LEFT JOIN totals t ON t.user_id = e.user_id LEFT JOIN tard x ON x.user_id = e.user_id LEFT JOIN subst s ON s.user_id = e.user_id
    LEFT JOIN exams m ON m.user_id = e.user_id LEFT JOIN nasg n ON n.course_id = e.course_id""", ["enr", "totals", "tard", "subst", "exams", "nasg"])
ENGAGE = "page_views / greatest(max(page_views) OVER (PARTITION BY course_id), 1) * 0.5 + participations / greatest(max(participations) OVER (PARTITION BY course_id), 1) * 0.5"


def student_frame(spark, d):
    return frames.course_student_frame(
        inputs.members(spark, d).select(*KEYS, "final_score"), inputs.user_totals(spark, d), tables.tardiness(spark, d),
        user_stats(spark, d), n_assignments(spark, d), exam_scores(spark, d),
    )


@query(
    "course_student_frame", "csf",
    f"""SELECT course_id, user_id, final_score, page_views, participations, {rnd('total_activity_time')}, on_time, late, missing, num_submissions, num_scores,
               {rnd('avg_score')}, {rnd('score_std')}, {rnd('first_score')}, {rnd('exam_1_score')}, {rnd('exam_2_score')}, {rnd('exam_3_score')},
               {rnd('submission_rate')}, {RATES}, {rnd(ENGAGE, 'activity_engagement')} FROM csf""",
)
def course_student_frame(spark, d):
    return student_frame(spark, d).select(
        *KEYS, "final_score", "page_views", "participations", "total_activity_time", "on_time", "late", "missing",
        "num_submissions", "num_scores", "avg_score", "score_std", "first_score", "exam_1_score", "exam_2_score",
        "exam_3_score", "submission_rate", "on_time_rate", "late_rate", "missing_rate", "activity_engagement",
    )


@query(
    "baseline_frame", "subst totals tard nasg",
    f"""SELECT e.course_id, e.user_id, e.final_score AS target, coalesce(page_views, 0) AS page_views, coalesce(num_scores, 0) AS num_submissions,
               {rnd('coalesce(std_samp, 0)', 'score_std')}, {rnd('coalesce(first_by_time, 0)', 'first_score')}, {rnd('coalesce(num_scores, 0) / n_assignments', 'submission_rate')}
        FROM enr e LEFT JOIN totals t ON t.user_id = e.user_id LEFT JOIN tard x ON x.user_id = e.user_id LEFT JOIN subst s ON s.user_id = e.user_id
        LEFT JOIN nasg n ON n.course_id = e.course_id""",
)
def baseline_frame(spark, d):
    """The variant with sample deviations, first score in time and zero fill."""
    frame = frames.course_student_frame(
        inputs.members(spark, d).select(*KEYS, "final_score"), inputs.user_totals(spark, d), tables.tardiness(spark, d),
        user_stats(spark, d, "sample"), n_assignments(spark, d),
    )
    return frame.select(
        *KEYS, F.col("final_score").alias("target"), "page_views", "num_submissions",
        F.coalesce("score_std", F.lit(0.0)).alias("score_std"), F.coalesce("first_score", F.lit(0.0)).alias("first_score"),
        "submission_rate",
    )


LEVELS = """CASE WHEN page_views > 0 THEN ntile(3) OVER (PARTITION BY course_id, page_views > 0 ORDER BY page_views, user_id) ELSE 0 END"""
PLEVELS = """CASE WHEN participations > 0 THEN ntile(3) OVER (PARTITION BY course_id, participations > 0 ORDER BY participations, user_id) ELSE 0 END"""


def levelled(spark, d):
    totals = materialise(inputs.summaries(spark, d))
    return frames.activity_level(frames.activity_level(totals, value="page_views"), value="participations")


@query(
    "activity_level", "totals",
    f"SELECT course_id, user_id, page_views, participations, {big(LEVELS, 'page_views_level')}, {big(PLEVELS, 'participations_level')} FROM totals",
)
def activity_level(spark, d):
    return levelled(spark, d).drop("total_activity_time")


@query(
    "grade_prediction_frame", "totals flags",
    f"""SELECT *, {rnd("25 * (page_views_level * 0.3 + participations_level * 0.3 + (1 - coalesce(lp, 0)) * 0.2 + (1 - coalesce(mp, 0)) * 0.2)", 'engagement_score')}
        EXCLUDE_MARK FROM (
        SELECT t.course_id, t.user_id, {LEVELS.replace('user_id', 't.user_id').replace('PARTITION BY course_id', 'PARTITION BY t.course_id')} AS page_views_level,
               {PLEVELS.replace('user_id', 't.user_id').replace('PARTITION BY course_id', 'PARTITION BY t.course_id')} AS participations_level,
               late_count / submission_count AS lp, missing_count / submission_count AS mp
        FROM totals t LEFT JOIN flags f ON f.user_id = t.user_id)""".replace("SELECT *,", "SELECT course_id, user_id, " + rnd("lp", "late_pct") + ", " + rnd("mp", "missing_pct") + ",").replace("EXCLUDE_MARK", ""),
)
def grade_prediction_frame(spark, d):
    flags = frames.submission_flags(flagged(spark, d), ["user_id"])
    frame = frames.grade_prediction_frame(inputs.members(spark, d).select(*KEYS), levelled(spark, d), flags)
    return frame.select(*KEYS, "late_pct", "missing_pct", "engagement_score")


@query("max_norm_engagement", "totals", f"SELECT course_id, user_id, {rnd(ENGAGE, 'activity_engagement')} FROM totals")
def max_norm_engagement(spark, d):
    return frames.max_norm_engagement(inputs.summaries(spark, d)).select(*KEYS, "activity_engagement")


# --- grades per course ----------------------------------------------------------------

FAIL = "avg(CASE WHEN final_score < 57 THEN 1.0 ELSE 0.0 END)"
add_cte("gstat", f"""
    SELECT course_id, count(final_score) AS n, avg(final_score) AS grade_mean, stddev_samp(final_score) AS grade_std, stddev_pop(final_score) AS grade_std_pop,
           min(final_score) AS grade_min, max(final_score) AS grade_max, {FAIL} AS fail_rate, 1 - {FAIL} AS pass_rate FROM enr GROUP BY ALL""", ["enr"])


@query("grade_stats", "gstat", "SELECT course_id, n, " + ", ".join(rnd(c) for c in ("grade_mean", "grade_std", "grade_std_pop", "grade_min", "grade_max", "fail_rate", "pass_rate")) + " FROM gstat")
def grade_stats(spark, d):
    return courses.grade_stats(inputs.members(spark, d))


@query("pass_rate", "gstat", f"SELECT course_id, {rnd('pass_rate * 100', 'pass_rate')}, n AS total FROM gstat WHERE n >= 5")
def pass_rate(spark, d):
    return courses.pass_rate(inputs.members(spark, d))


DIVERSITY = "CASE WHEN pass_rate IN (0, 1) THEN 'LOW DIVERSITY' WHEN pass_rate < 0.2 OR pass_rate > 0.8 THEN 'MODERATE' ELSE 'GOOD' END"


@query("class_diversity", "gstat", f"SELECT course_id, n, {rnd('pass_rate')}, {DIVERSITY} AS class_diversity FROM gstat WHERE n >= 10 AND grade_std_pop >= 5")
def class_diversity(spark, d):
    return courses.class_diversity(inputs.members(spark, d))


@query("diversity_counts", "enr", f"""SELECT class_diversity, count(*) AS n_courses FROM (
    SELECT {DIVERSITY} AS class_diversity FROM (SELECT account_id, count(*) AS n, avg(CASE WHEN final_score >= 57 THEN 1.0 ELSE 0.0 END) AS pass_rate, stddev_pop(final_score) AS s FROM enr GROUP BY ALL)
    WHERE n >= 10 AND s >= 5) GROUP BY ALL""")
def diversity_counts(spark, d):
    """Classes here are accounts, so that more than one tag occurs."""
    by_account = inputs.members(spark, d).select(F.col("account_id").alias("course_id"), "final_score")
    return courses.class_diversity(by_account).groupBy("class_diversity").agg(F.count("*").alias("n_courses"))


@query("good_course_students", "enr gstat", f"SELECT count(*) AS n FROM enr WHERE course_id IN (SELECT course_id FROM gstat WHERE n >= 10 AND grade_std_pop >= 5 AND {DIVERSITY} = 'GOOD')")
def good_course_students(spark, d):
    m = inputs.members(spark, d)
    return courses.good_courses_only(m, courses.class_diversity(m)).agg(F.count("*").alias("n"))


@query("course_quality_gate", "gstat", f"SELECT course_id, n, {rnd('grade_std_pop')} FROM gstat WHERE n >= 15 AND grade_std_pop > 5")
def course_quality_gate(spark, d):
    return courses.quality_gate(inputs.members(spark, d), strict=True).select("course_id", "n", "grade_std_pop")


@query("grade_audit", "enr subst", f"""
    SELECT course_id, count(*) AS students, count(current_score) AS with_grades, {big('coalesce(sum(num_scores), 0)', 'graded_subs')},
           {rnd('avg(current_score)', 'grade_mean')}, {rnd('stddev_pop(current_score)', 'grade_std')},
           CASE WHEN count(current_score) > 0 THEN 'CANVAS' ELSE 'EXTERNAL/NONE' END AS grade_source
    FROM enr LEFT JOIN subst USING (course_id, user_id) GROUP BY ALL""")
def grade_audit(spark, d):
    return courses.grade_audit(inputs.members(spark, d), user_sub_stats(spark, d))


@query("course_potential", "enr nasg", """
    SELECT course_id, n >= 10 AS has_grades, n_assignments,
           CASE WHEN n >= 10 AND s > 10 AND n_assignments >= 5 AND p BETWEEN 0.2 AND 0.8 THEN 'HIGH' WHEN n >= 10 AND s > 10 AND n_assignments >= 3 THEN 'MEDIUM'
                WHEN n >= 10 AND s > 10 THEN 'LOW' WHEN n >= 10 THEN 'LOW-VAR' ELSE 'SKIP' END AS recommendation
    FROM (SELECT course_id, count(*) FILTER (final_score > 0) AS n, stddev_pop(final_score) FILTER (final_score > 0) AS s,
                 avg(CASE WHEN final_score >= 57 THEN 1.0 ELSE 0 END) FILTER (final_score > 0) AS p FROM enr GROUP BY ALL) JOIN nasg USING (course_id)""")
def course_potential(spark, d):
    return courses.course_potential(inputs.members(spark, d), n_assignments(spark, d))


@query("grade_distribution", "enr", "SELECT course_id, CAST(round(final_score) AS INTEGER) AS score, count(*) AS n FROM enr GROUP BY ALL")
def grade_distribution(spark, d):
    return courses.grade_distribution(inputs.members(spark, d))


@query("grade_histogram", "enr", """
    SELECT course_id, least(14, CAST(floor((final_score - lo) / ((hi - lo) / 15)) AS BIGINT)) AS bin, count(*) AS n
    FROM enr, (SELECT min(final_score) AS lo, max(final_score) AS hi FROM enr) GROUP BY ALL""")
def grade_histogram(spark, d):
    return courses.histogram(inputs.members(spark, d), "final_score", 15, ["course_id"])


@query("box_stats", "enr", f"""
    SELECT course_id, {rnd('q1')}, {rnd('median')}, {rnd('q3')}, count(*) AS n, {rnd('min(final_score) FILTER (final_score >= q1 - 1.5 * (q3 - q1))', 'whisker_low')},
           {rnd('max(final_score) FILTER (final_score <= q3 + 1.5 * (q3 - q1))', 'whisker_high')},
           count(*) FILTER (final_score < q1 - 1.5 * (q3 - q1) OR final_score > q3 + 1.5 * (q3 - q1)) AS outliers
    FROM enr JOIN (SELECT course_id, quantile_cont(final_score, 0.25) AS q1, quantile_cont(final_score, 0.5) AS median, quantile_cont(final_score, 0.75) AS q3 FROM enr GROUP BY ALL) USING (course_id)
    GROUP BY course_id, q1, median, q3 HAVING count(*) >= 5""")
def box_stats(spark, d):
    return courses.box_stats(inputs.members(spark, d))


@query("course_coverage", "enr", f"""
    SELECT course_id, count(*) AS students, count(*) FILTER (final_score > 0) AS with_grades, {rnd('min(final_score) FILTER (final_score > 0)', 'grade_low')},
           {rnd('max(final_score) FILTER (final_score > 0)', 'grade_high')}, {rnd(FAIL + ' FILTER (final_score > 0)', 'fail_rate')} FROM enr GROUP BY ALL""")
def course_coverage(spark, d):
    return courses.course_coverage(inputs.members(spark, d))


@query("class_balance", "enr", """
    SELECT course_id, count(*) FILTER (final_score >= 57) AS passed, count(*) FILTER (final_score < 57) AS failed,
           count(*) FILTER (final_score >= 57) > 0 AND count(*) FILTER (final_score < 57) > 0 AND count(*) >= 20 AS trainable FROM enr GROUP BY ALL""")
def class_balance(spark, d):
    return courses.class_balance(inputs.members(spark, d))


@query("summary_totals", "enr sub", f"""
    SELECT count(DISTINCT course_id) AS courses, count(*) AS students, {rnd('avg(final_score)', 'grade_mean')}, count(*) FILTER (final_score < 57) AS failed,
           (SELECT count(*) FROM sub) AS submissions, (SELECT count(*) FROM (SELECT DISTINCT course_id, assignment_id FROM sub)) AS assignments FROM enr""")
def summary_totals(spark, d):
    return courses.summary_totals(inputs.members(spark, d), tables.submissions(spark, d), tables.assignments(spark, d))


@query("valid_grades", "enr", """SELECT course_id, count(*) AS n_all, count(*) FILTER (final_score > 0 AND final_score <= 100) AS n_valid,
    count(*) FILTER (final_score = 0) AS n_noncompleters FROM enr GROUP BY ALL""")
def valid_grades(spark, d):
    s = F.col("final_score")
    return inputs.members(spark, d).groupBy("course_id").agg(
        F.count("*").alias("n_all"), F.count_if(exprs.valid_grade(s)).alias("n_valid"),
        F.count_if(exprs.non_completer(s)).alias("n_noncompleters"),
    )


# --- resources and design -----------------------------------------------------------------

POINTS = """(CASE WHEN modules >= 10 THEN 3 WHEN modules >= 5 THEN 2 WHEN modules >= 1 THEN 1 ELSE 0 END
    + CASE WHEN assignments >= 15 THEN 3 WHEN assignments >= 8 THEN 2 WHEN assignments >= 3 THEN 1 ELSE 0 END
    + CASE WHEN quizzes >= 10 THEN 3 WHEN quizzes >= 5 THEN 2 WHEN quizzes >= 1 THEN 1 ELSE 0 END
    + CASE WHEN pages >= 5 THEN 1 ELSE 0 END + CASE WHEN discussions >= 3 THEN 1 ELSE 0 END)"""
add_cte("dsgn", f"SELECT *, {POINTS} AS design_points, CASE WHEN {POINTS} >= 8 THEN 'Excelente' WHEN {POINTS} >= 4 THEN 'Bueno' ELSE 'Básico' END AS design_quality FROM res", ["res"])


@query("design_quality", "dsgn", "SELECT section_id, design_points, design_quality, CASE design_quality WHEN 'Excelente' THEN 3 WHEN 'Bueno' THEN 2 ELSE 1 END AS design_score FROM dsgn")
def design_quality(spark, d):
    return courses.design_quality(tables.resource_counts(spark, d)).select("section_id", "design_points", "design_quality", "design_score")


@query("design_summary", "dsgn", "SELECT design_quality, count(*) AS n FROM dsgn GROUP BY ALL")
def design_summary(spark, d):
    return courses.design_quality(tables.resource_counts(spark, d)).groupBy("design_quality").agg(F.count("*").alias("n"))


READY = """least(100, CASE WHEN modules >= 5 THEN 25 WHEN modules >= 3 THEN 15 ELSE 0 END + CASE WHEN assignments >= 10 THEN 25 WHEN assignments >= 5 THEN 15 ELSE 0 END
    + CASE WHEN pages >= 20 THEN 20 WHEN pages >= 10 THEN 10 ELSE 0 END + CASE WHEN files >= 10 THEN 15 WHEN files >= 5 THEN 8 ELSE 0 END
    + CASE WHEN quizzes >= 3 THEN 15 WHEN quizzes >= 1 THEN 8 ELSE 0 END)"""


@query("readiness", "res", f"SELECT section_id, {READY} AS readiness_score, CASE WHEN {READY} >= 70 THEN 'high' WHEN {READY} >= 40 THEN 'medium' ELSE 'low' END AS readiness_level FROM res")
def readiness(spark, d):
    return courses.readiness(tables.resource_counts(spark, d)).select("section_id", "readiness_score", "readiness_level")


@query("design_complexity", "res", "SELECT section_id, CASE WHEN total_resources > 500 THEN 'complex' WHEN total_resources >= 100 THEN 'moderate' ELSE 'simple' END AS complexity FROM res")
def design_complexity(spark, d):
    return courses.design_complexity(tables.resource_counts(spark, d)).select("section_id", "complexity")


@query("high_potential", "res", "SELECT section_id, total_resources, students FROM res WHERE total_resources >= 50 AND students > 0")
def high_potential(spark, d):
    return courses.high_potential(tables.resource_counts(spark, d)).select("section_id", "total_resources", "students")


@query("quadrants", "res", """
    SELECT section_id, CASE WHEN total_resources > mr AND students > ms THEN 'high potential' WHEN students > ms THEN 'needs content' WHEN total_resources > mr THEN 'low reach' ELSE 'low potential' END AS quadrant
    FROM res, (SELECT quantile_cont(total_resources, 0.5) AS mr, quantile_cont(students, 0.5) AS ms FROM res)""")
def quadrants(spark, d):
    return courses.quadrants(tables.resource_counts(spark, d)).select("section_id", "quadrant")


@query("resource_totals", "res", " UNION ALL ".join(f"SELECT '{k}' AS category, {big(f'sum({k})', 'total')}, {rnd(f'avg({k})', 'average')} FROM res" for k in courses.RESOURCE_KINDS))
def resource_totals(spark, d):
    return courses.resource_totals(tables.resource_counts(spark, d))


@query("resource_minmax", "res", "SELECT section_id, " + ", ".join(rnd(f"({k} - min({k}) OVER ()) / (max({k}) OVER () - min({k}) OVER () + 0.001)", f"{k}_scaled") for k in courses.RESOURCE_KINDS) + " FROM res")
def resource_minmax(spark, d):
    table = courses.minmax_table(tables.resource_counts(spark, d), courses.RESOURCE_KINDS)
    return table.select("section_id", *[f"{k}_scaled" for k in courses.RESOURCE_KINDS])


@query("top_courses", "res", "SELECT section_id, total_resources, students FROM res ORDER BY total_resources DESC, section_id LIMIT 10")
def top_courses(spark, d):
    return courses.top_courses(tables.resource_counts(spark, d), "total_resources", 10, "section_id").select("section_id", "total_resources", "students")


@query("priority_courses", "dsgn", """SELECT section_id, design_quality FROM dsgn WHERE design_quality IN ('Excelente', 'Bueno')
    AND section_id IN (SELECT c_custkey % 50 + 1 FROM customer GROUP BY 1 HAVING count(*) FILTER (c_mktsegment = 'BUILDING') <= 5)""")
def priority_courses(spark, d):
    designed = courses.design_quality(tables.resource_counts(spark, d))
    graded = tables.table(spark, d, "customer").groupBy((F.pmod("c_custkey", F.lit(50)) + 1).alias("section_id")).agg(
        F.greatest(F.count_if(F.col("c_mktsegment") == "BUILDING") - 5, F.lit(0)).alias("with_grades")
    )
    return courses.priority_courses(designed, graded, "section_id").select("section_id", "design_quality")


@query("course_term_filter", "res", "SELECT section_id, students FROM res WHERE students >= 15 AND section_id % 2 = (CASE WHEN EXISTS (SELECT 1 FROM res WHERE students >= 15 AND section_id % 2 = 7) THEN 7 ELSE 1 END)")
def course_term_filter(spark, d):
    """The asked term has no course, so the fallback term is used."""
    listed = tables.resource_counts(spark, d).select(
        "section_id", "students", F.col("students").alias("total_students"), (F.col("section_id") % 2).alias("enrollment_term_id")
    )
    return courses.course_filter(listed, 7, 1).select("section_id", "students")


# --- activity per course -----------------------------------------------------------------

add_cte("cact", "SELECT e.course_id, e.account_id, e.program, e.user_id, coalesce(page_views, 0) AS v, coalesce(participations, 0) AS p, coalesce(total_activity_time, 0) AS t FROM enr e LEFT JOIN totals a ON a.user_id = e.user_id", ["enr", "totals"])


@query("course_engagement", "cact", f"""
    SELECT course_id, count(*) AS students, {rnd('avg(t) / 3600', 'avg_activity_time_hrs')}, {rnd('sum(t) / 3600', 'total_activity_time_hrs')}, {rnd('avg(v)', 'avg_page_views')},
           {big('sum(v)', 'total_page_views')}, {rnd('avg(p)', 'avg_participations')}, {big('sum(p)', 'total_participations')}, count(*) FILTER (v > 0) AS students_with_activity,
           {rnd('count(*) FILTER (v > 0) / count(*)', 'activity_rate')},
           CASE WHEN avg(v) > 500 AND avg(p) > 5 THEN 'High' WHEN avg(v) > 200 OR avg(p) > 2 THEN 'Medium' ELSE 'Low' END AS engagement_level FROM cact GROUP BY ALL""")
def course_engagement(spark, d):
    return courses.course_engagement(inputs.members(spark, d), inputs.summaries(spark, d))


@query("course_activity", "cact", f"SELECT account_id, {big('sum(v)', 'total_views')}, {rnd('avg(v)', 'avg_views_per_student')}, {rnd('count(*) FILTER (v > 0) / count(*)', 'coverage')} FROM cact GROUP BY ALL")
def course_activity(spark, d):
    return courses.course_activity_comparison(inputs.members(spark, d), inputs.summaries(spark, d), "account_id")


@query("daily_activity", "act", "SELECT course_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS views, count(*) FILTER (kind IN ('purchase', 'signup')) AS participations FROM act GROUP BY ALL")
def daily_activity(spark, d):
    days = daily(tables.activity(spark, d), inputs.members(spark, d), tables.PARTICIPATION_KINDS)
    return days.withColumn("day", F.col("day").cast("string"))


@query("activity_by_category", "", "SELECT CAST(day AS VARCHAR) AS day, category, count(*) AS views FROM (SELECT CAST(ts AS DATE) AS day, event_type AS category FROM events) GROUP BY GROUPING SETS ((day), (category))")
def activity_by_category(spark, d):
    return courses.activity_by_category(tables.activity(spark, d))


@query("dept_stats", "cact", f"SELECT coalesce(CAST(course_id AS VARCHAR), 'all') AS course, coalesce(CAST(account_id AS VARCHAR), 'all') AS account, count(*) AS students, count(DISTINCT program) AS programs, {big('sum(v)', 'views')} FROM cact GROUP BY ROLLUP (course_id, account_id)")
def dept_stats(spark, d):
    return courses.dept_stats(inputs.members(spark, d), inputs.summaries(spark, d))


@query("recent_students", "", "SELECT user_id, max(ts) AS last_login FROM events GROUP BY ALL")
def recent_students(spark, d):
    return courses.recent_students(tables.activity(spark, d))


STATUS = "CASE WHEN due_at IS NULL THEN 'floating' WHEN submitted_at IS NULL THEN 'missing' WHEN submitted_at <= due_at THEN 'on_time' ELSE 'late' END"


@query("assignment_stats", "sub", f"""
    SELECT course_id, assignment_id, count(*) AS n, {rnd('min(score)', 'min_score')}, {rnd('max(score)', 'max_score')},
           """ + ", ".join(rnd(f"count(*) FILTER ({STATUS} = '{s}') / count(*)", f"{s}_share") for s in ("on_time", "late", "missing", "floating")) + f""",
           {rnd('quantile_cont(score, 0.25)', 'first_quartile')}, {rnd('quantile_cont(score, 0.5)', 'median')}, {rnd('quantile_cont(score, 0.75)', 'third_quartile')}
    FROM sub GROUP BY ALL""")
def assignment_stats(spark, d):
    return courses.assignment_stats(course_subs(spark, d), ["course_id", "assignment_id"])


@query("submission_status", "sub", f"SELECT course_id, {STATUS} AS status, count(*) AS n FROM sub GROUP BY ALL")
def submission_status(spark, d):
    status = exprs.submission_status(F.col("submitted_at"), F.col("due_at")).alias("status")
    per_user = tables.submissions(spark, d).groupBy("user_id", status).agg(F.count("*").alias("n"))
    return per_user.join(inputs.members(spark, d).select(*KEYS), "user_id").groupBy("course_id", "status").agg(F.sum("n").alias("n"))


@query("current_final_score", "sub", f"SELECT user_id, {rnd('avg(score)', 'current_score')}, {rnd('coalesce(sum(score), 0) / count(*)', 'final_score')} FROM sub GROUP BY ALL")
def current_final_score(spark, d):
    return courses.current_final_score(tables.submissions(spark, d), ["user_id"])


@query("weighted_scores", "sub", f"""SELECT user_id, {rnd('sum(score * w) / sum(w) FILTER (score IS NOT NULL)', 'current_score', 9)}, {rnd('coalesce(sum(score * w), 0) / sum(w)', 'final_score', 9)}
    FROM (SELECT *, 1 / (assignment_id + 0.7) AS w FROM sub) GROUP BY ALL""", digits=9)
def weighted_scores(spark, d):
    """Falling weights by assignment, taken from the assignment list."""
    weights = tables.assignments(spark, d).select("assignment_id").distinct().withColumn("weight", 1 / (F.col("assignment_id") + 0.7))
    return courses.current_final_score(tables.submissions(spark, d), ["user_id"], weights)


@query("group_scores", "sub", f"""
    SELECT user_id, {rnd("coalesce(sum(cur * w) / nullif(sum(w) FILTER (g > 0), 0), sum(e) / nullif(sum(g), 0))", 'current_score')}, {rnd("coalesce(sum(fin * w) / nullif(sum(w), 0), sum(e) / sum(n))", 'final_score')},
           CAST(coalesce(sum(n) FILTER (w = 0), 0) AS BIGINT) AS n_unweighted
    FROM (SELECT user_id, k, avg(score) AS cur, coalesce(sum(score), 0) / count(*) AS fin, coalesce(sum(score), 0) AS e, count(score) AS g, count(*) AS n,
                 CASE k WHEN 1 THEN 0.7 WHEN 0 THEN 0.3 ELSE 0 END AS w
          FROM (SELECT *, CASE WHEN assignment_id < 5 THEN assignment_id % 2 END AS k FROM sub) GROUP BY user_id, k) GROUP BY user_id""")
def group_scores(spark, d):
    """Exams weigh 70 %, tasks 30 %; assignment 5 belongs to no group."""
    groups = tables.assignments(spark, d).select("assignment_id").distinct().where("assignment_id < 5").withColumn("group_id", F.col("assignment_id") % 2)
    weights = spark.createDataFrame([(1, 0.7), (0, 0.3)], "group_id long, weight double")
    return courses.group_weighted_score(tables.submissions(spark, d), ["user_id"], groups, weights)


@query("department_statistics", "enr sub prog", """
    SELECT account_id, count(DISTINCT e.course_id) AS courses, count(DISTINCT user_id) FILTER (program = 'BUILDING') AS teachers, count(DISTINCT user_id) FILTER (program <> 'BUILDING') AS students,
           any_value(a) AS assignments, any_value(m) AS modules
    FROM enr e LEFT JOIN (SELECT course_id, count(DISTINCT assignment_id) AS a FROM sub GROUP BY 1) x ON x.course_id = e.course_id
    LEFT JOIN (SELECT course_id, count(DISTINCT module_id) AS m FROM prog GROUP BY 1) y ON y.course_id = e.course_id GROUP BY account_id""")
def department_statistics(spark, d):
    role = F.when(F.col("program") == "BUILDING", "teacher").otherwise("student")
    modules = tables.module_progress(spark, d).select("course_id", F.col("module_id").alias("id"))
    work = tables.assignments(spark, d).select("course_id", F.col("assignment_id").alias("id"))
    return courses.department_statistics(inputs.members(spark, d).withColumn("user_role", role), work, modules)


@query("grade_changes", "sub", f"""
    SELECT user_id, assignment_id, submission_id, {rnd('prev', 'previous_score')}, {rnd('score')} FROM (
        SELECT *, lag(score) OVER (PARTITION BY user_id, assignment_id ORDER BY submitted_at, submission_id) AS prev FROM sub WHERE score IS NOT NULL) WHERE prev <> score""")
def grade_changes(spark, d):
    graded = tables.submissions(spark, d).where("score is not null")
    lagged = ranks.lag_in_chunks(
        graded, ["user_id", "assignment_id"], ["submitted_at", "submission_id"], "score", F.date_trunc("day", "submitted_at"), "previous_score"
    )
    return lagged.where("previous_score <> score").select("user_id", "assignment_id", "submission_id", "previous_score", "score")


# --- joins and sets ------------------------------------------------------------------------

URL = """CASE kind WHEN 'view' THEN '/courses/' || course_id || '/pages/' || resource_id WHEN 'click' THEN '/courses/' || course_id || '/files/' || resource_id
    WHEN 'purchase' THEN '/courses/' || course_id || '/assignments/' || resource_id WHEN 'signup' THEN '/courses/' || course_id ELSE '/about' END"""
add_cte("pv", f"SELECT *, {URL} AS url FROM act", ["act"])


@query("url_parse", "pv", "SELECT TRY_CAST(nullif(regexp_extract(url, '/courses/(\\d+)', 1), '') AS DOUBLE) AS url_course, regexp_matches(url, '/(files|pages)/') AS is_resource, count(*) AS n FROM pv GROUP BY ALL")
def url_parse(spark, d):
    url = F.col("url")
    return (
        tables.page_view_counts(spark, d)
        .groupBy(exprs.course_id_from_url(url).cast("double").alias("url_course"), exprs.is_resource_url(url).alias("is_resource"))
        .agg(F.sum("cnt").alias("n"))
    )


@query("page_url_parse", "", """SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/[a-z]{2}/(\\d+)', 1) AS BIGINT) AS item, count(*) AS n FROM pages GROUP BY ALL""")
def page_url_parse(spark, d):
    """The same extraction on crawled page addresses."""
    return (
        tables.table(spark, d, "pages")
        .groupBy(
            F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"),
            F.regexp_extract("url", r"/[a-z]{2}/(\d+)", 1).try_cast("long").alias("item"),
        )
        .agg(F.count("*").alias("n"))
    )


@query("resource_view_pct", "pv", f"""
    SELECT s.course_id, s.user_id, viewed, {rnd('viewed / resources', 'resource_view_pct')} FROM
    (SELECT course_id, user_id, count(DISTINCT url) AS viewed FROM pv WHERE regexp_matches(url, '/(files|pages)/') GROUP BY ALL) s
    JOIN (SELECT course_id, count(DISTINCT url) AS resources FROM pv WHERE regexp_matches(url, '/(files|pages)/') GROUP BY ALL) r USING (course_id)""")
def resource_view_pct(spark, d):
    views = tables.page_view_counts(spark, d).where(exprs.is_resource_url(F.col("url"))).select(*KEYS, "url")
    totals = views.select("course_id", "url").distinct().groupBy("course_id").agg(F.count("*").alias("resources"))
    return courses.resource_view_share(views, totals)


@query("page_views_in_window", "act", """SELECT course_id, user_id, count(*) AS n, min(ts) AS first_ts FROM act
    WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' GROUP BY ALL""")
def page_views_in_window(spark, d):
    """Views inside each course's second third; the bounds travel with the roster."""
    windows = tables.courses(spark, d).select(
        "course_id", (F.col("start_at") + F.expr("INTERVAL 9 DAYS")).alias("start_at"), (F.col("end_at") - F.expr("INTERVAL 11 DAYS")).alias("end_at")
    )
    hours = frames.hours_in_window(tables.activity(spark, d), inputs.members(spark, d), windows)
    return hours.groupBy(*KEYS).agg(F.sum("cnt").alias("n"), F.min("first_ts").alias("first_ts"))


@query("page_view_rows_in_window", "act", """SELECT course_id, user_id, event_id, ts FROM act
    WHERE ts BETWEEN TIMESTAMP '2024-01-10 11:30:00' AND TIMESTAMP '2024-01-20 07:15:00'""")
def page_view_rows_in_window(spark, d):
    """The views themselves, for bounds that cut an hour."""
    windows = tables.courses(spark, d).select("course_id", F.lit("2024-01-10 11:30:00").cast("timestamp_ntz").alias("start_at"), F.lit("2024-01-20 07:15:00").cast("timestamp_ntz").alias("end_at"))
    return frames.in_course_window(tables.activity(spark, d), inputs.members(spark, d), windows).select(*KEYS, "event_id", "ts")


@query("page_views_in_cut_hours", "act", """SELECT course_id, user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM act
    WHERE ts BETWEEN TIMESTAMP '2024-01-10 11:30:00' AND TIMESTAMP '2024-01-20 07:15:00' GROUP BY ALL""")
def page_views_in_cut_hours(spark, d):
    windows = tables.courses(spark, d).select("course_id", F.lit("2024-01-10 11:30:00").cast("timestamp_ntz").alias("start_at"), F.lit("2024-01-20 07:15:00").cast("timestamp_ntz").alias("end_at"))
    hours = frames.hours_in_window(tables.activity(spark, d), inputs.members(spark, d), windows)
    return hours.groupBy(*KEYS).agg(F.sum("cnt").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


@query("unprocessed_ids", "enr", "SELECT user_id FROM enr WHERE user_id NOT IN (SELECT user_id FROM events)")
def unprocessed_ids(spark, d):
    done = tables.table(spark, d, "events").select("user_id").distinct()
    return readers.unprocessed(inputs.members(spark, d).select("user_id"), done, ["user_id"])


@query("id_set_difference", "", "SELECT o_custkey AS user_id FROM orders EXCEPT SELECT user_id FROM events")
def id_set_difference(spark, d):
    ordered = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return ordered.exceptAll(tables.table(spark, d, "events").select("user_id").distinct())


@query("course_id_union", "enr act", "SELECT course_id FROM enr UNION SELECT course_id FROM act")
def course_id_union(spark, d):
    a = inputs.members(spark, d).select("course_id")
    b = inputs.summaries(spark, d).select("course_id")
    return a.union(b).distinct()


@query("staff_union", "enr", "SELECT program, count(*) AS n FROM (SELECT * FROM enr WHERE program = 'BUILDING' UNION ALL SELECT * FROM enr WHERE program = 'MACHINERY') GROUP BY ALL")
def staff_union(spark, d):
    m = inputs.members(spark, d)
    both = m.where("program = 'BUILDING'").unionByName(m.where("program = 'MACHINERY'"))
    return both.groupBy("program").agg(F.count("*").alias("n"))


@query("ingest_profile", "", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def ingest_profile(spark, d):
    return readers.ingest_profile(tables.activity(spark, d), "user_id", "ts")


@query("messages_by_day", "", "SELECT conv_id AS user_id, CAST(CAST(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER) AS DATE) AS VARCHAR) AS day, role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY ALL")
def messages_by_day(spark, d):
    return tables.messages(spark, d).groupBy("user_id", F.col("day").cast("string").alias("day"), "role").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("interaction_time", "", f"SELECT user_id, event_type AS controller, {rnd('sum(value)', 'seconds')}, {rnd('sum(value) / 60', 'minutes')}, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'signup')) AS participated FROM events GROUP BY ALL")
def interaction_time(spark, d):
    seconds = F.sum("seconds")
    return tables.activity(spark, d).groupBy("user_id", F.col("kind").alias("controller")).agg(
        seconds.alias("seconds"), exprs.seconds_to_minutes(seconds).alias("minutes"), F.count("*").alias("n"),
        F.count_if(F.col("kind").isin(*tables.PARTICIPATION_KINDS)).alias("participated"),
    )


@query("student_history", "", "SELECT o_custkey AS user_id, count(DISTINCT year(o_orderdate)) AS terms, count(DISTINCT o_orderpriority) AS courses, count(*) AS records FROM orders GROUP BY ALL")
def student_history(spark, d):
    """Terms and courses over a student's whole record; distinct pairs first, so hot ids shrink early."""
    per_pair = tables.table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("user_id"), F.year("o_orderdate").alias("term"), "o_orderpriority"
    ).agg(F.count("*").alias("records"))
    return per_pair.groupBy("user_id").agg(
        F.count_distinct("term").alias("terms"), F.count_distinct("o_orderpriority").alias("courses"), F.sum("records").alias("records")
    )


@query("requirement_ratio", "prog", f"SELECT user_id, {big('sum(items_count)', 'required')}, {big('coalesce(sum(items_count) FILTER (state = $$completed$$), 0)', 'done')}, {rnd('coalesce(sum(items_count) FILTER (state = $$completed$$), 0) / sum(items_count)', 'ratio')} FROM prog GROUP BY ALL")
def requirement_ratio(spark, d):
    done = F.sum(F.when(F.col("state") == "completed", F.col("items_count")).otherwise(0))
    total = F.sum("items_count")
    return tables.module_progress(spark, d).groupBy("user_id").agg(
        total.alias("required"), done.alias("done"), exprs.safe_ratio(done, total).alias("ratio")
    )


@query("distinct_counts", "enr", "SELECT count(DISTINCT course_id) AS courses, count(DISTINCT user_id) AS students FROM enr")
def distinct_counts(spark, d):
    return inputs.members(spark, d).agg(F.count_distinct("course_id").alias("courses"), F.count_distinct("user_id").alias("students"))
