"""Cases that used to lose rows or give a wrong answer."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from campuspulse.operators import courses, ranks, stats
from campuspulse.plans import activity_queries, inputs, stats_queries


def test_students_without_activity_stay_in_the_tables(spark, sf):
    roster = inputs.members(spark, sf)
    enrolled = roster.count()
    students = inputs.all_students(spark, sf)
    assert students.count() == enrolled
    quiet = students.where("page_views = 0")
    assert quiet.count() > 0 and quiet.where("dominant_time <> 'none' or unique_active_hours <> 0 or avg_gap_hours is null").count() == 0
    assert stats_queries.risk_report(spark, sf).count() == roster.where("final_score is not null").count()


def test_staff_without_views_have_a_zero_row(spark, sf):
    staff = inputs.members(spark, sf).where("program in ('BUILDING', 'MACHINERY')").count()
    rows = activity_queries.instructor_features(spark, sf)
    assert rows.count() == staff and rows.where("total_page_views = 0 and session_count = 0").count() > 0


def test_access_days_of_students_never_seen_are_zero(spark, sf):
    rows = inputs.engagement(spark, sf).where("total_page_views = 0")
    assert rows.count() > 0 and rows.where("first_module_day <> 0 or first_access_day <> 0").count() == 0


def test_direction_follows_failing(spark, sf):
    rows = stats_queries.pooled_correlations(spark, sf).collect()
    failed = {r.feature: r.r for r in stats_queries.failure_correlations(spark, sf).collect()}
    assert rows and all(r.direction == ("increases failure" if failed[r.feature] > 0 else "decreases failure") for r in rows)


def test_a_sixth_course_is_compared(spark):
    corr = spark.createDataFrame([(c, "f", 10, 0.1 * c) for c in range(6)], "course_id int, feature string, n int, r double")
    assert stats.compare_groups(corr, "course_id", list(range(6))).first().r_5 == 0.5


def test_lag_keeps_rows_without_a_time(spark):
    rows = [(1, 1, None, 50.0), (1, 2, datetime(2024, 1, 1), 60.0), (1, 3, datetime(2024, 1, 2), 70.0)]
    df = spark.createDataFrame(rows, "user_id int, submission_id int, at timestamp, score double")
    out = ranks.lag_in_chunks(df, ["user_id"], ["at", "submission_id"], "score", F.date_trunc("day", "at"), "before")
    assert {(r.submission_id, r.before) for r in out.collect()} == {(1, None), (2, 50.0), (3, 60.0)}


def test_work_without_weight_counts(spark):
    subs = spark.createDataFrame([(1, 1, 80.0), (1, 2, 40.0)], "user_id int, assignment_id int, score double")
    weights = spark.createDataFrame([(1, 1.0)], "assignment_id int, weight double")
    assert courses.current_final_score(subs, ["user_id"], weights).first().final_score == 60.0


def test_correlation_matrix_uses_pairwise_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 1.0), (3.0, 6.0, 2.0), (4.0, None, 9.0)], "a double, b double, c double")
    got = {(r.feature1, r.feature2): r.r for r in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(1.0) and set(got) == {("a", "b"), ("a", "c"), ("b", "c")}


@pytest.mark.parametrize("name", ["auc", "roc_points", "quintiles", "alert_thresholds", "risk_factors", "r2_overall"])
def test_global_ranks_have_no_cross_join(spark, sf, name):
    plan = getattr(stats_queries, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sessions_merge_inside_tasks(spark):
    assert spark.conf.get("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition") == "true"
