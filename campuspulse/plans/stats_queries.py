"""Correlation, significance, table and risk queries on all enrolled students."""

from __future__ import annotations

from pyspark.sql import functions as F

from campuspulse.functions.exprs import days_since, outcome
from campuspulse.operators import access, courses, risk, stats
from campuspulse.operators.activity import KEYS
from campuspulse.operators.sessions import session_features
from campuspulse.plans import inputs
from campuspulse.plans.course_queries import student_frame, user_stats
from campuspulse.plans.registry import add_cte, big, query, rnd, sql_chi2_p, sql_t_p, sql_z_p
from campuspulse.session import materialise
from campuspulse.sources import tables

FEATURES = [
    "page_views", "participations", "total_activity_time", "unique_active_hours", "avg_gap_hours", "gap_std_hours",
    "activity_span_days", "morning_activity", "afternoon_activity", "evening_activity", "night_activity",
]
CORE = ["unique_active_hours", "total_activity_time", "avg_gap_hours", "gap_std_hours"]


def students(spark, d):
    """All enrolled students with target, written once to the shared folder: later steps read it several times."""
    return materialise(stats.pass_fail(inputs.all_students(spark, d)))


add_cte("active", """
    SELECT e.course_id, e.user_id, e.final_score, CASE WHEN e.final_score < 57 THEN 1 ELSE 0 END AS failed, coalesce(t.page_views, 0) AS page_views,
           coalesce(t.participations, 0) AS participations, coalesce(t.total_activity_time, 0) AS total_activity_time, coalesce(g.unique_active_hours, 0) AS unique_active_hours,
           coalesce(g.avg_gap_hours, 0) AS avg_gap_hours, coalesce(g.gap_std_hours, 0) AS gap_std_hours, coalesce(g.activity_span_days, 0) AS activity_span_days,
           coalesce(morning_activity, 0) AS morning_activity, coalesce(afternoon_activity, 0) AS afternoon_activity, coalesce(evening_activity, 0) AS evening_activity,
           coalesce(night_activity, 0) AS night_activity, coalesce(dominant_time, 'none') AS dominant_time,
           CASE WHEN morning_activity = best THEN 1 ELSE 0 END AS is_morning_studier, CASE WHEN evening_activity = best THEN 1 ELSE 0 END AS is_evening_studier
    FROM enr e LEFT JOIN totals t ON t.user_id = e.user_id LEFT JOIN rawgap g ON g.user_id = e.user_id LEFT JOIN tod d ON d.user_id = e.user_id""",
    ["enr", "totals", "rawgap", "tod"])
add_cte("along", "SELECT * FROM (SELECT course_id, user_id, final_score, failed, " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATURES)
        + f" FROM active) UNPIVOT (value FOR feature IN ({', '.join(FEATURES)}))", ["active"])
R = "covar_pop(value, final_score) / nullif(stddev_pop(value) * stddev_pop(final_score), 0)"
add_cte("pear", f"SELECT course_id, feature, count(*) AS n, {R} AS r FROM along GROUP BY ALL HAVING count(*) >= 5 AND {R} IS NOT NULL", ["along"])
RF = R.replace("final_score", "failed")
add_cte("pooled", f"SELECT feature, count(*) AS n, {RF} AS r FROM along GROUP BY ALL HAVING count(*) >= 10 AND {RF} IS NOT NULL", ["along"])


def pearson(spark, d):
    return stats.correlations(inputs.all_students(spark, d), FEATURES, "final_score", ["course_id"])


@query("pearson_by_course", "pear", f"SELECT course_id, feature, n, {rnd('r')} FROM pear")
def pearson_by_course(spark, d):
    return pearson(spark, d)


@query("pooled_correlations", "pooled", f"SELECT feature, n, {rnd('r')}, {rnd('abs(r)', 'abs_r')}, CASE WHEN r > 0 THEN 'increases failure' ELSE 'decreases failure' END AS direction FROM pooled")
def pooled_correlations(spark, d):
    """Strength and direction against failing, so that a positive r increases failure."""
    return stats.ranked(stats.correlations(stats.pass_fail(inputs.all_students(spark, d)), FEATURES, "failed", [], min_n=10))


@query("failure_correlations", "along", f"SELECT feature, count(*) AS n, {rnd('covar_pop(value, failed) / nullif(stddev_pop(value) * stddev_pop(failed), 0)', 'r')} FROM along GROUP BY ALL HAVING count(*) >= 10 AND stddev_pop(value) > 0")
def failure_correlations(spark, d):
    return stats.correlations(stats.pass_fail(inputs.all_students(spark, d)), FEATURES, "failed", [], min_n=10)


@query("spearman_by_course", "along", f"""
    SELECT course_id, feature, count(*) AS n, {rnd('covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0)', 'r')} FROM (
        SELECT course_id, feature, rank() OVER (PARTITION BY course_id, feature ORDER BY value) + (count(*) OVER (PARTITION BY course_id, feature, value) - 1) / 2 AS rx,
               rank() OVER (PARTITION BY course_id, feature ORDER BY final_score) + (count(*) OVER (PARTITION BY course_id, feature, final_score) - 1) / 2 AS ry
        FROM along) GROUP BY ALL HAVING count(*) >= 5 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0""")
def spearman_by_course(spark, d):
    return stats.spearman(students(spark, d), FEATURES, "final_score", ["course_id"])


add_cte("peart", "SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM pear", ["pear"])
P_R = sql_t_p("t", "n - 2")


@query("correlation_pvalues", "peart", f"SELECT course_id, feature, n, {rnd('r')}, {rnd('p', 'p_value')}, p < 0.05 AS significant FROM (SELECT *, {P_R} AS p FROM peart)")
def correlation_pvalues(spark, d):
    return stats.with_significance(pearson(spark, d))


add_cte("mat", "SELECT a.feature AS feature1, b.feature AS feature2, covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0) AS r FROM along a JOIN along b USING (user_id) WHERE list_position(["
        + ", ".join(f"'{f}'" for f in FEATURES) + "], a.feature) < list_position([" + ", ".join(f"'{f}'" for f in FEATURES) + "], b.feature) GROUP BY ALL", ["along"])


@query("corr_matrix", "mat", f"SELECT feature1, feature2, {rnd('r')} FROM mat WHERE r IS NOT NULL")
def corr_matrix(spark, d):
    return stats.correlation_matrix(students(spark, d), FEATURES)


@query("high_corr_pairs", "mat", f"SELECT feature1, feature2, {rnd('r')} FROM mat WHERE abs(r) > 0.7")
def high_corr_pairs(spark, d):
    return stats.high_pairs(stats.correlation_matrix(students(spark, d), FEATURES))


add_cte("sig", f"SELECT * FROM peart WHERE {P_R} < 0.05", ["peart"])


@query("cross_course_mean_r", "sig", f"SELECT feature, {rnd('avg(r)', 'avg_r')}, count(*) AS n_courses, {big('sum(n)', 'total_n')}, {rnd('abs(avg(r))', 'abs_avg_r')} FROM sig GROUP BY ALL HAVING count(*) >= 2")
def cross_course_mean_r(spark, d):
    return stats.cross_course_mean(stats.with_significance(pearson(spark, d)).where("significant"))


add_cte("sigwide", f"SELECT * FROM peart WHERE {P_R} < 0.5", ["peart"])


@query("cross_course_mean_r_wide", "sigwide", f"SELECT feature, {rnd('avg(r)', 'avg_r')}, count(*) AS n_courses, {big('sum(n)', 'total_n')}, {rnd('abs(avg(r))', 'abs_avg_r')} FROM sigwide GROUP BY ALL HAVING count(*) >= 2")
def cross_course_mean_r_wide(spark, d):
    """The same at p < 0.5, which the test data reaches."""
    return stats.cross_course_mean(stats.with_significance(pearson(spark, d), 0.5).where("significant"))


@query("cross_course_consistency", "pear", f"SELECT feature, {rnd('avg(r)', 'mean')}, {rnd('stddev_pop(r)', 'std')}, count(*) AS n_courses, CASE WHEN min(r) > 0 OR max(r) < 0 THEN 'consistent' ELSE 'mixed' END AS consistency FROM pear GROUP BY ALL")
def cross_course_consistency(spark, d):
    return stats.cross_course_consistency(pearson(spark, d))


@query("top_features_heatmap", "pear", f"""SELECT course_id, feature, n, {rnd('r')} FROM pear WHERE feature IN (
    SELECT feature FROM (SELECT feature, row_number() OVER (PARTITION BY course_id ORDER BY abs(r) DESC, feature) AS k FROM pear) WHERE k <= 5)""")
def top_features_heatmap(spark, d):
    return stats.top_feature_heatmap(pearson(spark, d))


@query("course_comparison", "pear", f"SELECT feature, course_id, {rnd('r')} FROM pear")
def course_comparison(spark, d):
    """One row per feature and course, so that no list of courses is needed; ``stats.compare_groups`` makes it wide."""
    return pearson(spark, d).select("feature", "course_id", "r")


@query("top_feature_per_course", "pear", f"SELECT course_id, feature, {rnd('r')}, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY abs(r) DESC, feature) AS k FROM pear) WHERE k <= 5")
def top_feature_per_course(spark, d):
    return stats.top_per_group(pearson(spark, d), ["course_id"]).drop("n")


TT = "((avg(value) FILTER (failed = 0)) - (avg(value) FILTER (failed = 1))) / sqrt(((count(*) FILTER (failed = 0) - 1) * var_samp(value) FILTER (failed = 0) + (count(*) FILTER (failed = 1) - 1) * var_samp(value) FILTER (failed = 1)) / (count(*) - 2) * (1.0 / count(*) FILTER (failed = 0) + 1.0 / count(*) FILTER (failed = 1)))"


@query("t_test", "along", f"""SELECT feature, count(*) FILTER (failed = 0) AS n_passed, count(*) FILTER (failed = 1) AS n_failed, {rnd('avg(value) FILTER (failed = 0)', 'mean_passed')},
    {rnd('avg(value) FILTER (failed = 1)', 'mean_failed')}, {rnd(TT, 't')}, count(*) - 2 AS df FROM along WHERE feature IN ('page_views', 'total_activity_time', 'unique_active_hours', 'avg_gap_hours') GROUP BY ALL""")
def t_test(spark, d):
    return stats.t_test(stats.pass_fail(inputs.all_students(spark, d)), ["page_views", "total_activity_time", "unique_active_hours", "avg_gap_hours"])


add_cte("core_t", f"""SELECT feature, count(*) FILTER (failed = 0) AS n_passed, count(*) FILTER (failed = 1) AS n_failed, avg(value) FILTER (failed = 0) AS mean_passed,
    avg(value) FILTER (failed = 1) AS mean_failed, {TT} AS t, count(*) - 2 AS df FROM along WHERE feature IN ('unique_active_hours', 'total_activity_time', 'avg_gap_hours', 'gap_std_hours') GROUP BY ALL""", ["along"])


@query("t_test_pvalues", "core_t", f"SELECT feature, n_passed, n_failed, {rnd('mean_passed')}, {rnd('mean_failed')}, {rnd('t')}, df, {rnd(sql_t_p('t', 'df'), 'p_value')} FROM core_t")
def t_test_pvalues(spark, d):
    return stats.with_t_p(stats.t_test(stats.pass_fail(inputs.all_students(spark, d)), CORE))


MID = "rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2"


def _mwu(features: str) -> str:
    return f"""
    SELECT feature, n_passed, n_failed, u, greatest(0, (abs(u - n_passed * n_failed / 2) - 0.5) / sqrt(n_passed * n_failed / 12 * ((n + 1) - ties / (n * (n - 1))))) AS z
    FROM (SELECT feature, count(*) FILTER (failed = 0) AS n_passed, count(*) FILTER (failed = 1) AS n_failed, count(*) AS n,
                 sum(mid) FILTER (failed = 0) - count(*) FILTER (failed = 0) * (count(*) FILTER (failed = 0) + 1) / 2 AS u, CAST(sum(tie * tie - 1) AS DOUBLE) AS ties
          FROM (SELECT feature, failed, {MID} AS mid, count(*) OVER (PARTITION BY feature, value) AS tie FROM along WHERE feature IN ({features}))
          GROUP BY ALL)"""


@query("mann_whitney", "along", f"SELECT feature, n_passed, n_failed, {rnd('u')}, {rnd('z')} FROM ({_mwu("'page_views', 'total_activity_time', 'unique_active_hours', 'avg_gap_hours'")})")
def mann_whitney(spark, d):
    return stats.mann_whitney(students(spark, d), ["page_views", "total_activity_time", "unique_active_hours", "avg_gap_hours"])


add_cte("core_u", _mwu("'unique_active_hours', 'total_activity_time', 'avg_gap_hours', 'gap_std_hours'"), ["along"])


@query("mann_whitney_pvalues", "core_u", f"SELECT feature, n_passed, n_failed, {rnd('u')}, {rnd('z')}, {rnd(sql_z_p('z'), 'p_value')} FROM core_u")
def mann_whitney_pvalues(spark, d):
    return stats.mann_whitney_test(students(spark, d), CORE)


add_cte("mwpart", """
    SELECT account_id, program, failed, score, rank() OVER w + (count(*) OVER (PARTITION BY account_id, program, score) - 1) / 2 AS mid, count(*) OVER (PARTITION BY account_id, program, score) AS tie
    FROM (SELECT account_id, program, CASE WHEN final_score < 57 THEN 1 ELSE 0 END AS failed, avg_score AS score
          FROM enr JOIN (SELECT user_id, avg_score FROM subst) USING (user_id) WHERE avg_score IS NOT NULL AND final_score IS NOT NULL)
    WINDOW w AS (PARTITION BY account_id, program ORDER BY score)""", ["enr", "subst"])
add_cte("mwgroup", """
    SELECT account_id, program, count(*) FILTER (failed = 0) AS n_passed, count(*) FILTER (failed = 1) AS n_failed, count(*) AS n, max(tie) > 1 AS tied,
           sum(mid) FILTER (failed = 0) - count(*) FILTER (failed = 0) * (count(*) FILTER (failed = 0) + 1) / 2 AS u, CAST(sum(tie * tie - 1) AS DOUBLE) AS ties
    FROM mwpart GROUP BY ALL HAVING count(*) FILTER (failed = 0) > 0 AND count(*) FILTER (failed = 1) > 0""", ["mwpart"])
add_cte("mwsmall", "SELECT *, least(n_passed, n_failed) AS m, least(u, n_passed * n_failed - u) AS low FROM mwgroup WHERE least(n_passed, n_failed) <= 8 AND NOT tied", ["mwgroup"])
# ways: how many sets of m of the first n ranks have the sum s.
add_cte("mwways", """SELECT 0 AS n, 0 AS m, 0 AS s, CAST(1 AS DOUBLE) AS ways
    UNION ALL SELECT n + 1, m + j, s + j * (n + 1), sum(ways) FROM mwways, range(2) q(j) WHERE n < (SELECT max(n) FROM mwsmall) AND m + j <= 8 GROUP BY n, m + j, s + j * (n + 1)""",
        ["mwsmall"], recursive=True)
add_cte("mwexact", """SELECT account_id, program, least(1, 2 * sum(w.ways) FILTER (w.s - w.m * (w.m + 1) / 2 <= low) / sum(w.ways)) AS p
    FROM mwsmall g JOIN mwways w ON w.n = g.n AND w.m = g.m GROUP BY ALL""", ["mwways"])


@query("mann_whitney_small_groups", "mwexact", f"""SELECT account_id, program, n_passed, n_failed, {rnd('u')}, {rnd('z')}, {rnd(f"coalesce(p, {sql_z_p('z')})", 'p_value')} FROM (
    SELECT *, greatest(0, (abs(u - n_passed * n_failed / 2) - 0.5) / sqrt(n_passed * n_failed / 12 * ((n + 1) - ties / (n * (n - 1))))) AS z FROM mwgroup)
    LEFT JOIN mwexact USING (account_id, program)""")
def mann_whitney_small_groups(spark, d):
    """Average submission scores of passing against failing students of each account and programme; most groups are small enough for the exact test."""
    scores = user_stats(spark, d).select("user_id", F.col("avg_score").alias("score"))
    members = stats.pass_fail(inputs.members(spark, d)).select("user_id", "account_id", "program", "failed")
    found = stats.mann_whitney_test(members.join(scores, "user_id"), ["score"], ["account_id", "program"])
    return found.drop("feature")


add_cte("cont", "SELECT dominant_time, CASE WHEN final_score >= 57 THEN 'Passed' ELSE 'Failed' END AS outcome, count(*) AS n FROM active GROUP BY ALL", ["active"])


def outcomes(spark, d):
    return inputs.all_students(spark, d).withColumn("outcome", outcome(F.col("final_score")))


@query("contingency", "cont", "SELECT * FROM cont")
def contingency(spark, d):
    return stats.contingency(outcomes(spark, d), "dominant_time", "outcome")


add_cte("chi", """
    SELECT sum((coalesce(c.n, 0) - rs * cs / tot) * (coalesce(c.n, 0) - rs * cs / tot) / (rs * cs / tot)) AS chi2, (count(DISTINCT r.dominant_time) - 1) * (count(DISTINCT s.outcome) - 1) AS dof, max(tot) AS n
    FROM (SELECT dominant_time, sum(n) AS rs FROM cont GROUP BY 1) r CROSS JOIN (SELECT outcome, sum(n) AS cs FROM cont GROUP BY 1) s CROSS JOIN (SELECT sum(n) AS tot FROM cont) t
    LEFT JOIN cont c ON c.dominant_time = r.dominant_time AND c.outcome = s.outcome""", ["cont"])


@query("chi_square", "chi", f"SELECT {rnd('chi2')}, dof, {big('n', 'n')} FROM chi")
def chi_square(spark, d):
    return stats.chi_square(materialise(stats.contingency(outcomes(spark, d), "dominant_time", "outcome")), "dominant_time", "outcome")


@query("chi_square_pvalue", "chi", f"SELECT {rnd('chi2')}, dof, {big('n', 'n')}, {rnd(sql_chi2_p('chi2', 'dof'), 'p_value')} FROM chi")
def chi_square_pvalue(spark, d):
    return stats.with_chi2_p(chi_square(spark, d))


# --- insights ---------------------------------------------------------------------------

IMPACT_FEATURES = [("page_views", "views", False, False), ("unique_active_hours", "hours", False, False), ("avg_gap_hours", "gap", True, False),
                   ("total_activity_time", "time", False, False), ("morning_share", "morning", False, True), ("night_share", "night", False, True)]


def share_students(spark, d):
    def share(c):
        return F.coalesce(F.try_divide(c, F.col("page_views")), F.lit(0.0))

    return students(spark, d).withColumn("morning_share", share(F.col("morning_activity"))).withColumn("night_share", share(F.col("night_activity")))


add_cte("imp", """SELECT failed, feature, round(value, 6) AS value FROM (SELECT failed, CAST(page_views AS DOUBLE) AS page_views, CAST(unique_active_hours AS DOUBLE) AS unique_active_hours, avg_gap_hours, total_activity_time,
    CASE WHEN page_views > 0 THEN morning_activity / page_views ELSE 0 END AS morning_share, CASE WHEN page_views > 0 THEN night_activity / page_views ELSE 0 END AS night_share FROM active)
    UNPIVOT (value FOR feature IN (page_views, unique_active_hours, avg_gap_hours, total_activity_time, morning_share, night_share))""", ["active"])


@query("feature_impact", "imp", f"""
    SELECT feature, high_n AS high_group_n, n - high_n AS low_group_n, {rnd('hf / high_n', 'high_fail_rate')}, {rnd('lf / (n - high_n)', 'low_fail_rate')},
           {rnd("CASE WHEN feature = 'avg_gap_hours' THEN (hf / high_n) / (lf / (n - high_n)) ELSE (lf / (n - high_n)) / (hf / high_n) END", 'relative_risk')},
           {rnd('(high_n - hf) * lf / nullif(hf * ((n - high_n) - lf), 0)', 'odds_ratio')},
           {rnd('n * pow(greatest(abs((high_n - hf) * lf - hf * (n - high_n - lf)) - n / 2, 0), 2) / nullif(CAST(high_n AS DOUBLE) * (n - high_n) * (n - hf - lf) * (hf + lf), 0)', 'yates_chi2')}
    FROM (SELECT feature, count(*) AS n, count(*) FILTER (value > cut) AS high_n, CAST(sum(failed) FILTER (value > cut) AS BIGINT) AS hf, CAST(sum(failed) FILTER (value <= cut) AS BIGINT) AS lf
          FROM imp JOIN (SELECT feature, CASE WHEN feature LIKE '%share' THEN 0.2 ELSE quantile_cont(value, 0.5) END AS cut FROM imp GROUP BY feature) USING (feature) GROUP BY ALL)
    WHERE n >= 50 AND high_n >= 10 AND n - high_n >= 10 AND hf > 0 AND lf > 0""")
def feature_impact(spark, d):
    impact = stats.feature_impact(share_students(spark, d), IMPACT_FEATURES, digits=6)
    return impact.select("feature", "high_group_n", "low_group_n", "high_fail_rate", "low_fail_rate", "relative_risk", "odds_ratio", "yates_chi2")


CAT = ", ".join(
    f"('{f}', '{text}', {str(inverse).upper()}, {str(share).upper()})" for f, text, inverse, share in stats.CATALOGUE
)
CAT_FEATURES = [c[0] for c in stats.CATALOGUE if c[0] != "weekend_study_pct"]
add_cte("inl", "SELECT failed, feature, value FROM (SELECT failed, " + ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in CAT_FEATURES)
        + ", round(weekend_morning_pct + weekend_afternoon_pct + weekend_evening_pct + weekend_night_pct, 6) AS weekend_study_pct FROM eng) "
        + f"UNPIVOT (value FOR feature IN ({', '.join(c[0] for c in stats.CATALOGUE)}))", ["eng"])
add_cte("ing", f"""
    SELECT *, CASE WHEN inverse THEN hr / lr ELSE lr / hr END AS rr, (a * d) / nullif(b * c, 0) AS oratio FROM (
        SELECT feature, description, inverse, hn, ln_, hf / hn AS hr, lf / ln_ AS lr, CAST(hn - hf AS DOUBLE) AS a, CAST(hf AS DOUBLE) AS b, CAST(ln_ - lf AS DOUBLE) AS c, CAST(lf AS DOUBLE) AS d
        FROM (SELECT feature, description, inverse, count(*) FILTER (value > cut) AS hn, count(*) FILTER (value <= cut) AS ln_, coalesce(sum(failed) FILTER (value > cut), 0) AS hf, coalesce(sum(failed) FILTER (value <= cut), 0) AS lf
              FROM inl JOIN (SELECT feature, description, inverse, CASE WHEN share THEN CASE WHEN max(value) <= 1 THEN 0.2 ELSE 20 END ELSE quantile_cont(value, 0.5) END AS cut
                             FROM inl JOIN (VALUES {CAT}) v(feature, description, inverse, share) USING (feature) GROUP BY feature, description, inverse, share) USING (feature) GROUP BY ALL)
        WHERE hn + ln_ >= 50 AND hn >= 10 AND ln_ >= 10 AND hf > 0 AND lf > 0)""", ["inl"])
_FACT = "lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)"
_CELL = "exp({f} - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1))"
_SEEN = _CELL.format(f=_FACT).replace("(k", "(a").replace(" k", " a")
FISHER = f"(SELECT sum(pk) FROM (SELECT {_CELL.format(f=_FACT)} AS pk FROM range(CAST(least(a + b, a + c) AS BIGINT) + 1) r(k) WHERE k >= greatest(0, a - d)) WHERE pk <= {_SEEN} * (1 + 1e-7))"
YATES = "(a + b + c + d) * pow(greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d))"
TEXT = """printf('Students with %s %s have %.0f%% higher failure risk (failure rate: %.1f%% vs %.1f%%)', CASE WHEN inverse THEN 'high' ELSE 'low' END, description, (rr - 1) * 100,
    CASE WHEN inverse THEN hr ELSE lr END * 100, CASE WHEN inverse THEN lr ELSE hr END * 100)
    || CASE WHEN p < 0.001 THEN ' (p < 0.001)' WHEN p < 0.01 THEN ' (p < 0.01)' WHEN p < 0.05 THEN ' (p < 0.05)' ELSE printf(' (p = %.3f, not statistically significant)', p) END"""


def insights_sql(least):
    return f"""SELECT feature, {rnd('rr', 'relative_risk')}, {rnd('oratio', 'odds_ratio')}, {rnd('p', 'p_value')}, p < 0.05 AS significant, hn AS high_group_n, ln_ AS low_group_n,
    {rnd('hr', 'high_fail_rate')}, {rnd('lr', 'low_fail_rate')}, {TEXT} AS insight_text
    FROM (SELECT *, CASE WHEN least(a, b, c, d) < 5 THEN {FISHER} ELSE {sql_chi2_p('y2', '1')} END AS p FROM (SELECT *, {YATES} AS y2 FROM ing WHERE rr > {least}))"""


def insight_table(spark, d, min_risk):
    table = stats.pass_fail(inputs.engagement(spark, d))
    weekend = [F.round(f"weekend_{s}_pct", 6) for s in ("morning", "afternoon", "evening", "night")]
    total = weekend[0]
    for c in weekend[1:]:
        total = total + c
    frame = materialise(table.select(*KEYS, "failed", *CAT_FEATURES, total.alias("weekend_study_pct")))
    out = stats.insights(stats.feature_impact(frame, digits=6), min_risk)
    return out.select("feature", "relative_risk", "odds_ratio", "p_value", "significant", "high_group_n", "low_group_n", "high_fail_rate", "low_fail_rate", "insight_text")


@query("insights", "ing", insights_sql(1.2))
def insights(spark, d):
    """The whole catalogue over the engagement table of all students, with sentences."""
    return insight_table(spark, d, 1.2)


@query("insights_wide", "ing", insights_sql(0.9))
def insights_wide(spark, d):
    """The same from a relative risk of 0.9 on, which the test data reaches."""
    return insight_table(spark, d, 0.9)


@query("trend_line", "active", f"SELECT {rnd('regr_slope(final_score, page_views)', 'slope')}, {rnd('regr_intercept(final_score, page_views)', 'intercept')}, count(*) AS n FROM active")
def trend_line(spark, d):
    return stats.trend_line(inputs.all_students(spark, d), "page_views", "final_score")


add_cte("dens", "SELECT failed, count(*) AS n, stddev_samp(total_activity_time) * pow(count(*), -0.2) AS h FROM active GROUP BY 1 HAVING stddev_samp(total_activity_time) > 0", ["active"])
add_cte("densp", """SELECT failed, n, h, lo, hi, (total_activity_time - lo) / (h / 20) AS place
    FROM active JOIN dens USING (failed), (SELECT CAST(min(total_activity_time) AS DOUBLE) AS lo, CAST(max(total_activity_time) AS DOUBLE) AS hi FROM active)""", ["dens"])
add_cte("densw", """SELECT failed, n, h, lo, hi, bin, sum(w) AS w FROM (SELECT failed, n, h, lo, hi, floor(place) AS bin, 1 - (place - floor(place)) AS w FROM densp
    UNION ALL SELECT failed, n, h, lo, hi, floor(place) + 1, place - floor(place) FROM densp) GROUP BY ALL""", ["densp"])


@query("density_curve", "densw", f"""SELECT failed, CAST(i AS INTEGER) AS point, {rnd('max(lo + i * (hi - lo) / 39)', 'x')},
    {rnd('sum(CASE WHEN abs(i * (hi - lo) / 39 / h - bin / 20) <= 9 THEN w * exp(-0.5 * pow(i * (hi - lo) / 39 / h - bin / 20, 2)) ELSE 0 END / (n * h * sqrt(2 * pi())))', 'density')}
    FROM densw, range(40) t(i) GROUP BY failed, i""")
def density_curve(spark, d):
    return stats.density_curve(students(spark, d), "total_activity_time", "failed")


@query("resource_impact", "act", f"""
    SELECT course_id, resource_id, viewers, {rnd('vm', 'viewed_mean', 9)}, {rnd('om', 'other_mean', 9)}, {rnd('vm - om', 'difference', 9)}, {rnd('r2', None, 9)} FROM (
    SELECT t.course_id, resource_id, count(*) FILTER (seen) AS viewers, avg(final_score) FILTER (seen) AS vm, avg(final_score) FILTER (NOT seen) AS om,
           pow(covar_pop(CASE WHEN seen THEN 1.0 ELSE 0.0 END, final_score), 2) / nullif(var_pop(CASE WHEN seen THEN 1.0 ELSE 0.0 END) * var_pop(final_score), 0) AS r2
    FROM (SELECT e.course_id, e.user_id, e.final_score, q.resource_id, v.user_id IS NOT NULL AS seen
          FROM enr e JOIN (SELECT DISTINCT course_id, resource_id FROM act) q USING (course_id)
          LEFT JOIN (SELECT DISTINCT user_id, resource_id FROM act) v ON v.user_id = e.user_id AND v.resource_id = q.resource_id) t
    GROUP BY ALL) WHERE viewers >= 5 AND om IS NOT NULL""", digits=9)
def resource_impact(spark, d):
    per_user = tables.activity(spark, d).select("user_id", "resource_id").distinct()
    views = per_user.join(inputs.members(spark, d).select(*KEYS), "user_id")
    scores = inputs.members(spark, d).select(*KEYS, F.col("final_score").alias("score"))
    return stats.resource_impact(views, scores)


@query("trending_resources", "act enr", f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, resource_id, count(*) AS views, {rnd('sum(CASE WHEN final_score >= 57 THEN 2.0 ELSE 1.0 END)', 'weighted_views')}
    FROM act JOIN (SELECT user_id, final_score FROM enr) USING (user_id) GROUP BY ALL""")
def trending_resources(spark, d):
    scores = inputs.members(spark, d).select("user_id", F.col("final_score").alias("score"))
    return stats.trending_resources(tables.activity(spark, d), scores).withColumn("day", F.col("day").cast("string"))


R2 = "pow(covar_pop(value, final_score) / nullif(stddev_pop(value) * stddev_pop(final_score), 0), 2)"
add_cte("ccor", "SELECT course_id, user_id, final_score, feature, value FROM (SELECT course_id, user_id, final_score, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in ("page_views", "total_activity_time", "num_submissions", "submission_rate", "on_time", "late", "missing"))
    + " FROM csf) UNPIVOT (value FOR feature IN (page_views, total_activity_time, num_submissions, submission_rate, on_time, late, missing))", ["csf"])
add_cte("cr2", f"SELECT course_id, feature, {R2} AS r2 FROM ccor GROUP BY ALL", ["ccor"])
PURE, LEAKY = ["page_views", "total_activity_time"], ["page_views", "total_activity_time", "num_submissions", "submission_rate", "on_time", "late", "missing"]


def best_r2(spark, d, names):
    corr = stats.correlations(student_frame(spark, d), names, "final_score", ["course_id"])
    return corr.groupBy("course_id").agg(F.max(F.col("r") * F.col("r")).alias("r2"))


@query("leaky_vs_pure", "cr2", f"""
    SELECT {rnd('avg(l)', 'with_leaky')}, {rnd('avg(p)', 'pure')}, {rnd('avg(l) - avg(p)', 'difference')}, {rnd('(avg(l) / avg(p) - 1) * 100', 'inflation_pct', 4)}, count(*) AS n_courses
    FROM (SELECT course_id, max(r2) AS l, max(r2) FILTER (feature IN ('page_views', 'total_activity_time')) AS p FROM cr2 GROUP BY ALL)""")
def leaky_vs_pure(spark, d):
    """Best single-feature r2 per course with and without submission features."""
    corr = materialise(stats.correlations(student_frame(spark, d), LEAKY, "final_score", ["course_id"]))
    best = F.max(F.col("r") * F.col("r")).alias("r2")
    leaky = corr.groupBy("course_id").agg(best)
    pure = corr.where(F.col("feature").isin(*PURE)).groupBy("course_id").agg(best)
    out = stats.leaky_vs_pure(leaky, pure)
    return out.withColumn("inflation_pct", F.round("inflation_pct", 4))


@query("r2_overall", "pear", f"SELECT {rnd('avg(r2)', 'average')}, {rnd('max(r2)', 'best')}, {rnd('min(r2)', 'worst')}, {rnd('quantile_cont(r2, 0.5)', 'median')} FROM (SELECT course_id, max(r * r) AS r2 FROM pear GROUP BY ALL)")
def r2_overall(spark, d):
    best = pearson(spark, d).groupBy("course_id").agg(F.max(F.col("r") * F.col("r")).alias("r2"))
    return stats.overall(materialise(best), "r2")


# --- tables -------------------------------------------------------------------------------

@query("outcome_counts", "active", f"SELECT CASE WHEN final_score >= 57 THEN 'Passed' ELSE 'Failed' END AS outcome, count(*) AS n, {rnd('count(*) / sum(count(*)) OVER ()', 'share')} FROM active GROUP BY 1")
def outcome_counts(spark, d):
    counts = outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))
    total = inputs.members(spark, d).agg(F.count("*").alias("_all"))
    return stats.attach_row(counts, total).select("outcome", "n", (F.col("n") / F.col("_all")).alias("share"))


@query("dominant_time", "active", f"SELECT dominant_time, count(*) AS n_students, {big('sum(failed)', 'n_failed')}, {rnd('avg(failed)', 'failure_rate')}, {rnd('count(*) / sum(count(*)) OVER ()', 'share')} FROM active GROUP BY 1")
def dominant_time(spark, d):
    return stats.failure_rate_by(students(spark, d), "dominant_time")


@query("quintiles", "active", f"""
    SELECT CAST(1 + CASE WHEN total_activity_time > q1 THEN 1 ELSE 0 END + CASE WHEN total_activity_time > q2 THEN 1 ELSE 0 END + CASE WHEN total_activity_time > q3 THEN 1 ELSE 0 END
           + CASE WHEN total_activity_time > q4 THEN 1 ELSE 0 END AS INTEGER) AS bucket, count(*) AS n, {rnd('avg(failed)', 'failure_rate')}, {rnd('avg(total_activity_time)', 'mean_time')}
    FROM active, (SELECT quantile_cont(total_activity_time, 0.2) AS q1, quantile_cont(total_activity_time, 0.4) AS q2, quantile_cont(total_activity_time, 0.6) AS q3, quantile_cont(total_activity_time, 0.8) AS q4 FROM active) GROUP BY 1""")
def quintiles(spark, d):
    return stats.quantile_buckets(students(spark, d), "total_activity_time").groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg("failed").alias("failure_rate"), F.avg("total_activity_time").alias("mean_time")
    )


@query("early_late_split", "active", f"""SELECT CASE WHEN unique_active_hours >= m THEN 'early' ELSE 'late' END AS side, count(*) AS n, {rnd('avg(final_score)', 'avg_grade')}, {rnd('avg(failed)', 'failure_rate')}
    FROM active, (SELECT quantile_cont(unique_active_hours, 0.5) AS m FROM active) GROUP BY 1""")
def early_late_split(spark, d):
    return stats.median_split(students(spark, d), "unique_active_hours").groupBy("side").agg(
        F.count("*").alias("n"), F.avg("final_score").alias("avg_grade"), F.avg("failed").alias("failure_rate")
    )


@query("missing_profile", "enr totals", """SELECT "column", missing, round(missing * 100.0 / n, 6) + 0.0 AS missing_pct FROM (SELECT count(*) AS n, count(*) FILTER (current_score IS NULL) AS current_score,
    count(*) FILTER (page_views IS NULL) AS page_views, count(*) FILTER (final_score IS NULL) AS final_score FROM enr LEFT JOIN totals USING (course_id, user_id)) UNPIVOT (missing FOR "column" IN (current_score, page_views, final_score))""")
def missing_profile(spark, d):
    frame = inputs.members(spark, d).join(inputs.summaries(spark, d), KEYS, "left")
    return stats.missing_profile(frame.select("current_score", "page_views", "final_score"))


@query("describe", "along", f"""SELECT feature, count(value) AS count, {rnd('avg(value)', 'mean')}, {rnd('stddev_samp(value)', 'std')}, {rnd('min(value)', 'min')}, {rnd('max(value)', 'max')},
    {rnd('quantile_cont(value, 0.25)', 'q25')}, {rnd('quantile_cont(value, 0.5)', 'q50')}, {rnd('quantile_cont(value, 0.75)', 'q75')} FROM along GROUP BY ALL""")
def describe(spark, d):
    return stats.describe(students(spark, d), FEATURES)


PROFILE = ["page_views", "total_activity_time", "participations", "morning_activity", "evening_activity", "activity_span_days"]


@query("passed_failed_means", "along", f"""SELECT feature, {rnd('p', 'passed_mean')}, {rnd('q', 'failed_mean')}, {rnd('p - q', 'difference')}, {rnd('coalesce((p - q) * 100 / nullif(q, 0), 0)', 'diff_pct')},
    {rnd('CASE WHEN top > 0 THEN p / top ELSE 0 END', 'passed_scaled')}, {rnd('CASE WHEN top > 0 THEN q / top ELSE 0 END', 'failed_scaled')}
    FROM (SELECT feature, avg(value) FILTER (failed = 0) AS p, avg(value) FILTER (failed = 1) AS q, max(value) AS top FROM along WHERE feature IN ({', '.join(repr(f) for f in PROFILE)}) GROUP BY ALL)""")
def passed_failed_means(spark, d):
    return stats.outcome_means(stats.pass_fail(inputs.all_students(spark, d)), PROFILE)


@query("median_order", "enr", f"SELECT program, {rnd('quantile_cont(final_score, 0.5)', 'median')} FROM enr GROUP BY ALL")
def median_order(spark, d):
    return stats.order_by_median(inputs.members(spark, d), "program", "final_score")


@query("feature_histogram", "active", """SELECT failed, least(19, CAST(floor((total_activity_time - lo) / ((hi - lo) / 20)) AS BIGINT)) AS bin, count(*) AS n
    FROM active, (SELECT min(total_activity_time) AS lo, max(total_activity_time) AS hi FROM active) GROUP BY ALL""")
def feature_histogram(spark, d):
    return courses.histogram(students(spark, d), "total_activity_time", 20, ["failed"])


# --- risk ---------------------------------------------------------------------------------

def _sum(template: str) -> str:
    weights = {"unique_active_hours": "-0.36", "total_activity_time": "-0.36", "avg_gap_hours": "0.35", "gap_std_hours": "0.29"}
    return " + ".join(f"({w}) * {template.format(c=c)}" for c, w in weights.items())


add_cte("rz", f"SELECT course_id, user_id, final_score, failed, {_sum('(({c}) - avg({c}) OVER ()) / stddev_samp({c}) OVER ()')} AS risk_score FROM active", ["active"])
add_cte("rm0", f"SELECT course_id, user_id, final_score, failed, {_sum('(({c}) - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 0.001)')} AS raw FROM active", ["active"])
add_cte("rm", "SELECT *, (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + 0.001) * 100 AS risk_score FROM rm0", ["rm0"])


def scored(spark, d):
    """Students with the 0-100 risk score; six digits, so that ties are ties everywhere."""
    return risk.risk_score_minmax(students(spark, d)).withColumn("risk_score", F.round("risk_score", 6))


@query("risk_score_z", "rz", f"SELECT course_id, user_id, {rnd('risk_score')} FROM rz")
def risk_score_z(spark, d):
    return risk.risk_score_z(students(spark, d)).select(*KEYS, "risk_score")


@query("risk_score_minmax", "rm", f"SELECT course_id, user_id, {rnd('risk_score')} FROM rm")
def risk_score_minmax(spark, d):
    return risk.risk_score_minmax(students(spark, d)).select(*KEYS, "risk_score")


@query("threshold_sweep", "rm", f"""SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (risk_score >= t) AS n_flagged, {rnd('count(*) FILTER (risk_score >= t) * 100.0 / count(*)', 'pct_flagged')},
    {rnd('coalesce(count(*) FILTER (risk_score >= t AND failed = 1) * 100.0 / nullif(sum(failed), 0), 0)', 'recall')}, {rnd('coalesce(count(*) FILTER (risk_score >= t AND failed = 1) * 100.0 / nullif(count(*) FILTER (risk_score >= t), 0), 0)', 'precision')}
    FROM rm, (VALUES (25), (50), (75)) v(t) GROUP BY t""")
def threshold_sweep(spark, d):
    return risk.threshold_sweep(risk.risk_score_minmax(students(spark, d)))


@query("alert_thresholds", "along", f"""SELECT feature, CASE WHEN feature IN ('unique_active_hours', 'total_activity_time') THEN 'low' ELSE 'high' END AS side, {rnd('t', 'threshold')},
    {rnd('avg(failed) FILTER (CASE WHEN feature IN ($$unique_active_hours$$, $$total_activity_time$$) THEN value < t ELSE value > t END) * 100', 'fail_rate_at_risk')},
    {rnd('avg(failed) FILTER (NOT CASE WHEN feature IN ($$unique_active_hours$$, $$total_activity_time$$) THEN value < t ELSE value > t END) * 100', 'fail_rate_normal')}
    FROM along JOIN (SELECT feature, quantile_cont(value, 0.25) AS lo, quantile_cont(value, 0.75) AS hi, CASE WHEN feature IN ('unique_active_hours', 'total_activity_time') THEN lo ELSE hi END AS t FROM along
        WHERE feature IN ('unique_active_hours', 'total_activity_time', 'avg_gap_hours', 'gap_std_hours') GROUP BY feature) USING (feature) GROUP BY feature, t""")
def alert_thresholds(spark, d):
    return risk.alert_thresholds(students(spark, d))


add_cte("rf", """
    SELECT a.*, CASE WHEN is_evening_studier = 1 THEN 1 ELSE 0 END AS risk_evening, CASE WHEN coalesce(early_access_score, 0) < 0.3 THEN 1 ELSE 0 END AS risk_late_access,
           CASE WHEN page_views < (SELECT quantile_cont(page_views, 0.25) FROM active) THEN 1 ELSE 0 END AS risk_low_views,
           CASE WHEN total_activity_time < (SELECT quantile_cont(total_activity_time, 0.25) FROM active) THEN 1 ELSE 0 END AS risk_low_time
    FROM active a LEFT JOIN (SELECT user_id, early_access_score FROM early) USING (user_id)""", ["active", "early"])


def with_factors(spark, d):
    done = inputs.completion(spark, d).select(*KEYS, "first_module_completed_at")
    roster = inputs.members(spark, d).select(*KEYS).join(done, KEYS, "left")
    scores = access.early_access_rank(materialise(roster)).select(*KEYS, "early_access_score")
    frame = stats.pass_fail(inputs.all_students(spark, d)).join(scores, KEYS, "left")
    return risk.risk_factors(materialise(frame))


@query("risk_factors", "rf", """SELECT course_id, user_id, risk_evening, risk_late_access, risk_low_views, risk_low_time, risk_evening + risk_late_access + risk_low_views + risk_low_time AS risk_count,
    CASE risk_evening + risk_late_access + risk_low_views + risk_low_time WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Critical' END AS risk_level FROM rf""")
def risk_factors(spark, d):
    return with_factors(spark, d).select(*KEYS, "risk_evening", "risk_late_access", "risk_low_views", "risk_low_time", "risk_count", "risk_level")


@query("risk_count_rates", "rf", f"SELECT risk_evening + risk_late_access + risk_low_views + risk_low_time AS risk_count, count(*) AS n_students, {big('sum(failed)', 'n_failed')}, {rnd('avg(failed)', 'failure_rate')} FROM rf GROUP BY 1")
def risk_count_rates(spark, d):
    return stats.failure_rate_by(with_factors(spark, d), "risk_count", total=False)


@query("alerts", "enr sess totals hourly fmod", """
    SELECT e.course_id, e.user_id, CASE WHEN first_module_day IS NULL OR first_module_day > 5 THEN 1 ELSE 0 END AS alert_no_module, CASE WHEN coalesce(total_activity_time, 0) < 600 THEN 1 ELSE 0 END AS alert_low_time,
           CASE WHEN gmean > 72 THEN 1 ELSE 0 END AS alert_long_gap, CASE WHEN coalesce(h, 0) < 10 THEN 1 ELSE 0 END AS alert_few_hours,
           CASE WHEN last_ts IS NULL OR date_diff('microsecond', last_ts, TIMESTAMP '2024-01-31') > 72 * 3600000000 THEN 1 ELSE 0 END AS alert_inactive
    FROM enr e LEFT JOIN sess s ON s.user_id = e.user_id LEFT JOIN totals t ON t.user_id = e.user_id LEFT JOIN fmod m ON m.user_id = e.user_id
    LEFT JOIN (SELECT user_id, count(*) AS h, max(last_ts) AS last_ts FROM hourly GROUP BY ALL) x ON x.user_id = e.user_id""")
def alerts(spark, d):
    hours = inputs.hours(spark, d)
    seen = hours.groupBy(*KEYS).agg(F.count("*").alias("unique_active_hours"), F.max("last_ts").alias("last_ts"))
    gaps = session_features(hours, 30 / 7).select(*KEYS, "session_gap_mean")
    start = F.lit(inputs.MODULE_START).cast("timestamp")
    done = F.min("completed_at")
    first = tables.module_progress_by_user(spark, d).groupBy("user_id").agg(
        F.when(done.isNotNull(), days_since(done, start)).alias("first_module_day")
    )
    frame = (
        inputs.members(spark, d).select(*KEYS)
        .join(inputs.summaries(spark, d).select(*KEYS, "total_activity_time"), KEYS, "left")
        .join(seen, KEYS, "left").join(gaps, KEYS, "left").join(first, "user_id", "left")
    )
    flags = risk.activity_alerts(frame, F.lit(tables.COURSE_END).cast("timestamp"))
    return flags.select(*KEYS, "alert_no_module", "alert_low_time", "alert_long_gap", "alert_few_hours", "alert_inactive")


def _idle(hours: int) -> str:
    return f"SELECT user_id, max(ts) AS last_ts, {rnd('date_diff($$microsecond$$, max(ts), TIMESTAMP $$2024-01-31$$) / 3600000000.0', 'idle_hours')} FROM events GROUP BY ALL HAVING date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') > {hours} * 3600000000"


def idle_students(spark, d, hours):
    last = tables.activity(spark, d).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    return risk.inactive_students(last, F.lit(tables.COURSE_END).cast("timestamp"), hours=hours)


@query("inactive_students", "", _idle(72))
def inactive_students(spark, d):
    """Silent for more than the rule's 72 hours."""
    return idle_students(spark, d, 72)


@query("inactive_students_36h", "", _idle(36))
def inactive_students_36h(spark, d):
    return idle_students(spark, d, 36)


add_cte("rms", "SELECT course_id, user_id, failed, round(risk_score, 6) AS s FROM rm", ["rm"])


@query("roc_points", "rms", f"""SELECT {rnd('s', 'threshold')}, {rnd('tp / nullif(p, 0)', 'tpr')}, {rnd('fp / nullif(q, 0)', 'fpr')} FROM (
    SELECT s, sum(sum(failed)) OVER (ORDER BY s DESC) AS tp, sum(sum(1 - failed)) OVER (ORDER BY s DESC) AS fp, sum(sum(failed)) OVER () AS p, sum(sum(1 - failed)) OVER () AS q FROM rms GROUP BY s)""")
def roc_points(spark, d):
    return stats.roc_points(materialise(scored(spark, d).select("risk_score", "failed")), "risk_score", "failed")


@query("pr_points", "rms", f"""SELECT {rnd('s', 'threshold')}, {rnd('tp / (tp + fp)', 'precision')}, {rnd('tp / nullif(p, 0)', 'recall')} FROM (
    SELECT s, sum(sum(failed)) OVER (ORDER BY s DESC) AS tp, sum(sum(1 - failed)) OVER (ORDER BY s DESC) AS fp, sum(sum(failed)) OVER () AS p FROM rms GROUP BY s)""")
def pr_points(spark, d):
    return stats.pr_points(materialise(scored(spark, d).select("risk_score", "failed")), "risk_score", "failed")


@query("auc", "rms", f"""SELECT {rnd('(sum(mid) FILTER (failed = 1) - p * (p + 1) / 2) / (p * q)', 'auc')} FROM (
    SELECT failed, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS mid, sum(failed) OVER () AS p, sum(1 - failed) OVER () AS q FROM rms) GROUP BY p, q""")
def auc(spark, d):
    return stats.auc(materialise(scored(spark, d).select("risk_score", "failed")), "risk_score", "failed")


LEVEL = "CASE WHEN s / 100 > 0.7 THEN 'Critical' WHEN s / 100 > 0.5 THEN 'High' WHEN s / 100 > 0.3 THEN 'Medium' WHEN s > 0 THEN 'Low' END"


def report(spark, d):
    return risk.risk_report(scored(spark, d).withColumn("probability", F.col("risk_score") / 100))


@query("risk_report", "rms", f"SELECT course_id, user_id, {rnd('s / 100', 'probability')}, {LEVEL} AS risk_level FROM rms")
def risk_report(spark, d):
    return report(spark, d).select(*KEYS, "probability", "risk_level")


@query("catch_rate", "rms", f"""SELECT count(*) FILTER (failed = 1) AS n_failed, count(*) FILTER (failed = 1 AND s > 50) AS n_caught, {rnd('coalesce(count(*) FILTER (failed = 1 AND s > 50) * 100.0 / nullif(count(*) FILTER (failed = 1), 0), 0)', 'catch_rate')},
    count(*) FILTER (s > 50) AS n_flagged FROM rms""")
def catch_rate(spark, d):
    return risk.catch_rate(report(spark, d))
