"""Feature lists. Names and groups the feature tables must carry."""

SESSION = [
    "session_count", "session_gap_min", "session_gap_max", "session_gap_mean",
    "session_gap_std", "session_regularity", "sessions_per_week",
]
BLOCK_PCT = [f"{d}_{s}_pct" for d in ("weekday", "weekend") for s in ("morning", "afternoon", "evening", "night")]
BLOCK_SD = ["weekday_morning_sd", "weekday_afternoon_sd", "weekend_total_sd"]
DCT = [f"dct_coef_{k}" for k in range(12)]
TRAJECTORY = [
    "engagement_velocity", "engagement_acceleration", "weekly_cv", "trend_reversals",
    "early_engagement_ratio", "late_surge",
]
WORKLOAD = [
    "peak_count_type1", "peak_count_type2", "peak_count_type3", "peak_ratio",
    "max_positive_slope", "max_negative_slope", "slope_std",
    "positive_slope_sum", "negative_slope_sum", "weekly_range",
]
ACCESS = ["first_access_day", "first_module_day", "first_assignment_day", "access_time_pct"]
RAW = ["total_page_views", "total_participations", "activity_span_days", "unique_active_hours"]

GROUPS = {
    "session_regularity": SESSION,
    "time_blocks": BLOCK_PCT + BLOCK_SD,
    "dct_coefficients": DCT,
    "engagement_trajectory": TRAJECTORY,
    "workload_dynamics": WORKLOAD,
    "time_to_access": ACCESS,
    "raw_aggregates": RAW,
}
ALL_FEATURES = [f for group in GROUPS.values() for f in group]

# Features that follow from submitting graded work.
LEAKY = [
    "total_participations", "on_time", "late", "missing", "floating", "on_time_rate", "late_rate",
    "missing_rate", "num_submissions", "submission_rate", "participations", "participations_level",
]
PURE_ACTIVITY = [f for f in ALL_FEATURES if f not in LEAKY]

# Features that are also normalised within the course.
NORMALISED = [
    "session_count", "session_gap_mean", "session_regularity", "sessions_per_week",
    "engagement_velocity", "weekly_cv", "early_engagement_ratio", "late_surge",
    "peak_count_type1", "peak_count_type2", "peak_count_type3",
    "max_positive_slope", "max_negative_slope", "weekly_range",
    "first_access_day", "total_page_views", "total_participations",
]

ACTIVITY_ONLY = ["page_views", "participations", "total_activity_time", "page_views_level", "participations_level"]
SUBMISSION_BASED = [
    "on_time", "late", "missing", "floating", "on_time_rate", "late_rate", "missing_rate",
    "num_submissions", "submission_rate",
]
SCORE_BASED = ["avg_score", "min_score", "max_score", "score_std", "first_score", "num_graded", "num_scores"]
ALL_DATA = ACTIVITY_ONLY + SUBMISSION_BASED + SCORE_BASED
