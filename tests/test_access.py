import pytest
from helpers import when

from campuspulse.operators import access


def progress(spark, rows):
    data = [(1, u, m, s, when(t) if t else None) for u, m, s, t in rows]
    return spark.createDataFrame(data, "course_id long, user_id long, module_id long, state string, completed_at timestamp")


def test_module_ranks_ties_nulls_and_lone_completer(spark):
    rows = [
        (1, 1, "completed", "2024-01-01"), (2, 1, "completed", "2024-01-01"), (3, 1, "completed", "2024-01-03"),
        (4, 1, "started", None), (5, 1, "started", "2024-01-02"), (1, 2, "completed", "2024-01-01"),
    ]
    got = {(r.user_id, r.module_id): r for r in access.module_ranks(progress(spark, rows)).collect()}
    assert [got[(u, 1)].completion_rank for u in (1, 2, 3, 4, 5)] == [1, 1, 4, None, 3]
    assert got[(1, 1)].completers_in_module == 3
    assert got[(3, 1)].completion_rank_normalized == pytest.approx(1.5)
    assert got[(4, 1)].completion_rank_normalized is None
    assert got[(1, 2)].completion_rank_normalized == 0.5


def test_published_rank_values(spark):
    rows = [(u, 1, "completed", f"2024-01-{1 + u // 24:02d} {u % 24:02d}:00") for u in range(1, 42)]
    got = {r.user_id: r.completion_rank_normalized for r in access.module_ranks(progress(spark, rows)).collect()}
    assert got[32] == pytest.approx(0.775) and got[8] == pytest.approx(0.175)
    students = progress(spark, rows).selectExpr("course_id", "user_id", "completed_at as first_module_completed_at")
    score = {r.user_id: r.early_access_score for r in access.early_access_rank(students).collect()}
    assert score[8] == pytest.approx(0.825) and score[7] == pytest.approx(0.85)


def test_early_access_scores(spark):
    data = [(1, 1, when("2024-01-01")), (1, 2, when("2024-01-02")), (1, 3, when("2024-01-03")), (1, 4, None), (2, 9, when("2024-01-01")), (3, 7, None)]
    df = spark.createDataFrame(data, "course_id long, user_id long, first_module_completed_at timestamp")
    got = {r.user_id: (r.early_access_rank, r.early_access_score) for r in access.early_access_rank(df).collect()}
    assert got == {1: (1, 1.0), 2: (2, 0.5), 3: (3, 0.0), 4: (4, 0.0), 9: (1, 0.5), 7: (1, 0.0)}


def test_module_lookups(spark):
    rows = progress(spark, [(1, 1, "completed", "2024-01-01"), (1, 9, "started", None)])
    modules = spark.createDataFrame([(1, 1, "Intro")], "course_id long, module_id long, module_name string")
    assert [r.module_id for r in access.known_modules(rows, modules).collect()] == [1]
    assert {r.module_id: r.module_name for r in access.with_module_names(rows, modules).collect()} == {1: "Intro", 9: "Unknown"}


def test_timing_score(spark):
    rows = [(1, 1, "completed", "2024-01-01"), (2, 1, "completed", "2024-01-02"), (1, 2, "started", None)]
    got = {r.user_id: r for r in access.module_timing(access.module_ranks(progress(spark, rows))).collect()}
    assert got[1].module_completion_pct == 0.5 and got[1].early_access_score == 1.0
    assert got[2].early_access_score == 0.0
