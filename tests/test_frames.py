import pytest
from helpers import one, when
from pyspark.sql import functions as F

from campuspulse.operators import courses, frames


def subs(spark, rows):
    data = [(1, u, a, i, s, when(t) if t else None, w) for i, (u, a, s, t, w) in enumerate(rows)]
    return spark.createDataFrame(
        data, "course_id long, user_id long, assignment_id long, submission_id long, score double, submitted_at timestamp, workflow_state string"
    )


ROWS = [
    (1, 2, 80.0, "2024-01-01", "graded"), (1, 1, 60.0, "2024-01-05", "graded"), (1, 3, None, "2024-01-06", "submitted"),
    (1, 4, None, None, "unsubmitted"), (2, 1, 50.0, "2024-01-02", "graded"),
]


def test_submission_variants(spark):
    pop = {r.user_id: r for r in frames.submission_stats(subs(spark, ROWS)).collect()}
    assert (pop[1].num_submissions, pop[1].num_graded, pop[1].num_scores) == (3, 2, 2)
    assert pop[1].score_std == 10.0 and pop[2].score_std == 0.0
    assert pop[1].first_score == 60.0
    sam = {r.user_id: r for r in frames.submission_stats(subs(spark, ROWS), variant="sample").collect()}
    assert sam[1].num_submissions == 2 and sam[1].score_std == pytest.approx(14.1421356)
    assert sam[2].score_std is None and sam[1].first_score == 80.0


def test_exam_pivot(spark):
    exams = spark.createDataFrame([(1, 2), (1, 3)], "course_id long, assignment_id long")
    members = spark.createDataFrame([(1, 1), (1, 2)], "course_id long, user_id long")
    r = one(frames.exam_pivot(subs(spark, ROWS), exams, members))
    assert (r.user_id, r.exam_1_score, r.exam_2_score) == (1, 80.0, None)


def test_zscore_keeps_courses_apart_and_constants_at_zero(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 7.0), (1, 2, 3.0, 7.0), (2, 3, 100.0, 7.0), (2, 4, 300.0, 7.0), (3, 5, 4.0, 1.0)],
                               "course_id long, user_id long, a double, c double")
    got = {r.user_id: r for r in frames.zscore_within(df, ["a", "c"]).collect()}
    assert got[1].a_norm == pytest.approx(got[3].a_norm) == pytest.approx(-0.70710678)
    assert all(r.c_norm == 0.0 for r in got.values()) and got[5].a_norm == 0.0
    pop = {r.user_id: r for r in frames.zscore_within(df, ["a"], sample=False).collect()}
    assert pop[1].a_norm == -1.0 and pop[5].a_norm == 4.0


def test_max_norm_engagement(spark):
    df = spark.createDataFrame([(1, 1, 10, 0), (1, 2, 5, 4), (2, 3, 0, 0)], "course_id long, user_id long, page_views long, participations long")
    got = {r.user_id: r.activity_engagement for r in frames.max_norm_engagement(df).collect()}
    assert got == {1: 0.5, 2: 0.75, 3: 0.0}


def test_activity_level_is_ntile(spark):
    df = spark.createDataFrame([(1, i, i * i) for i in range(0, 11)] + [(2, 99, 5), (2, 98, 5)], "course_id long, user_id long, page_views long")
    got = {(r.course_id, r.user_id): r.page_views_level for r in frames.activity_level(df).collect()}
    assert [got[(1, i)] for i in range(11)] == [0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert (got[(2, 98)], got[(2, 99)]) == (1, 2)


def test_window_join_bounds_are_inclusive(spark):
    ev = spark.createDataFrame([(1, when("2024-01-01")), (1, when("2024-01-10")), (1, when("2024-01-11")), (2, when("2024-01-05"))], "user_id long, ts timestamp")
    roster = spark.createDataFrame([(7, 1)], "course_id long, user_id long")
    crs = spark.createDataFrame([(7, when("2024-01-01"), when("2024-01-10"))], "course_id long, start_at timestamp, end_at timestamp")
    assert frames.in_course_window(ev, roster, crs).count() == 2


def resources(spark, **counts):
    base = {"section_id": 1, "students": 10, "modules": 0, "assignments": 0, "quizzes": 0, "pages": 0, "files": 0, "discussions": 0}
    row = {**base, **counts}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))
    return df.withColumn("total_resources", F.expr("modules + assignments + quizzes + pages + files + discussions"))


@pytest.mark.parametrize(
    "counts, points, level",
    [({}, 0, "Básico"), ({"modules": 5, "assignments": 8}, 4, "Bueno"), ({"modules": 10, "assignments": 15, "quizzes": 1, "pages": 5}, 8, "Excelente")],
)
def test_design_quality(spark, counts, points, level):
    r = one(courses.design_quality(resources(spark, **counts)))
    assert (r.design_points, r.design_quality) == (points, level)


def test_readiness_and_complexity(spark):
    df = resources(spark, modules=5, assignments=10, pages=20, files=5, quizzes=1)
    r = one(courses.design_complexity(courses.readiness(df)))
    assert (r.readiness_score, r.readiness_level, r.complexity) == (86, "high", "simple")
    assert courses.high_potential(df).count() == 0


def members(spark, scores, course=1):
    return spark.createDataFrame([(course, i, s, s) for i, s in enumerate(scores)], "course_id long, user_id long, final_score double, current_score double")


def test_diversity_potential_and_audit(spark):
    m = (
        members(spark, [90.0] * 8 + [60.0] * 4).union(members(spark, [90.0] * 11 + [10.0], 2))
        .union(members(spark, [90.0] * 6 + [10.0] * 6, 3)).union(members(spark, [None] * 3, 4))
    )
    tags = {r.course_id: r.class_diversity for r in courses.class_diversity(m).collect()}
    assert tags == {1: "LOW DIVERSITY", 2: "MODERATE", 3: "GOOD"}
    assert courses.good_courses_only(m, courses.class_diversity(m)).count() == 12
    n = spark.createDataFrame([(1, 5), (2, 3), (3, 5)], "course_id long, n_assignments long")
    rec = {r.course_id: r.recommendation for r in courses.course_potential(m, n).collect()}
    assert rec == {1: "MEDIUM", 2: "MEDIUM", 3: "HIGH", 4: "SKIP"}
    graded = spark.createDataFrame([(1, 8)], "course_id long, num_scores long")
    source = {r.course_id: (r.grade_source, r.graded_subs) for r in courses.grade_audit(m, graded).collect()}
    assert source[1] == ("CANVAS", 8) and source[4] == ("EXTERNAL/NONE", 0)


def test_current_and_final_score(spark):
    got = {r.user_id: r for r in courses.current_final_score(subs(spark, ROWS), ["user_id"]).collect()}
    assert (got[1].current_score, got[1].final_score) == (70.0, 35.0)
    none = subs(spark, [(5, 1, None, None, "unsubmitted")])
    assert one(courses.current_final_score(none, ["user_id"])).final_score == 0.0


def test_course_names(spark):
    names = spark.createDataFrame([(1, "Algebra")], "course_id long, course_name string")
    df = spark.createDataFrame([(1,), (2,)], "course_id long")
    assert {r.course_name for r in courses.with_course_names(df, names).collect()} == {"Algebra", "Course 2"}


def test_term_fallback(spark):
    df = spark.createDataFrame([(1, 336, 20), (2, 322, 30), (3, 336, 5)], "id long, enrollment_term_id int, total_students int")
    assert [r.id for r in courses.course_filter(df, 336, 322).collect()] == [1]
    assert [r.id for r in courses.course_filter(df.where("id <> 1"), 336, 322).collect()] == [2]


def test_quadrants_and_histogram_edges(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 9, 9), (3, 1, 9), (4, 9, 1)], "section_id long, total_resources long, students long")
    got = {r.section_id: r.quadrant for r in courses.quadrants(df).collect()}
    assert got == {1: "low potential", 2: "high potential", 3: "needs content", 4: "low reach"}
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.n) for r in courses.histogram(flat, "x", 10).collect()] == [(5, 2)]
