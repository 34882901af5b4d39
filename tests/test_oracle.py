"""Registered queries next to their SQL twins on the smallest tables.

A slice of every family runs here; ``python tools/check.py SF_DIR`` runs all.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from campuspulse.plans import catalog
from tools.check import TABLES, compare

CHOSEN = [
    "session_gaps", "session_features", "sessions_by_gap", "raw_gap_features", "time_of_day_a", "time_of_day_local", "block_weekly_sd",
    "hour_matrix", "dct_rhythm", "trajectory_features", "workload_features", "access_time_pct", "module_rank", "early_access_score",
    "engagement_features", "early_warning_features", "submission_stats", "exam_pivot", "grade_stats", "grade_audit", "box_stats",
    "design_quality", "activity_by_category", "dept_stats", "assignment_stats", "grade_changes", "resource_view_pct", "page_views_in_window",
    "pearson_by_course", "spearman_by_course", "mann_whitney", "chi_square", "quintiles", "threshold_sweep", "risk_factors", "roc_points",
    "auc", "catch_rate", "stream_sessions", "stream_ingest", "stream_trending", "stream_hourly", "zscore_in_course", "instructor_features", "risk_report",
    "pooled_correlations", "corr_matrix", "insights", "correlation_pvalues", "course_comparison", "cross_course_mean_r",
    "read_enrollments", "read_summaries", "read_submissions", "read_assignments", "read_courses", "read_hourly_activity", "read_participations",
    "read_module_progress", "read_page_views", "write_by_course", "features_csv", "results_json", "read_hour_matrix", "read_course_bundle", "read_wrapped",
    "known_modules", "module_names", "course_names", "views_of_course", "course_windows", "parsed_times", "significance_stars",
]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_its_sql_twin(spark, sf, db, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, db.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_registry_is_consistent():
    queries, oracles = catalog.queries(), catalog.oracles()
    assert set(oracles) <= set(queries) and len(oracles) >= 170
    without = sorted(set(queries) - set(oracles))
    # Only fitted models lack a twin.
    assert all(any(w in n for w in ("oof", "model", "forest", "odds", "confusion", "holdout", "regression", "ablation",
                                    "pca", "clusters", "pooled_features", "reduced", "course_profiles", "mean_importance", "feasibility")) for n in without), without


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 59 and df.count() == 150
