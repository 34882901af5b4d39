import numpy as np
import pandas as pd
import pytest
from helpers import one
from pyspark.sql import functions as F

from campuspulse.operators import ml, risk, stats


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    n = 240
    pdf = pd.DataFrame({
        "course_id": rng.integers(1, 4, n), "user_id": np.arange(n), "a": np.round(rng.normal(size=n), 1), "b": rng.integers(0, 9, n).astype(float),
        "final_score": np.round(rng.uniform(0, 100, n), 1),
    })
    pdf["c"] = 1.0
    pdf["d"] = pdf.a * 2 + rng.normal(scale=0.2, size=n)
    pdf["failed"] = (pdf.final_score < 57).astype(int)
    return pdf, spark.createDataFrame(pdf).cache()


def test_correlations_skip_constants_and_match_numpy(sample):
    pdf, df = sample
    got = {(r.course_id, r.feature): r for r in stats.correlations(df, ["a", "b", "c"], "final_score", ["course_id"]).collect()}
    assert {f for _, f in got} == {"a", "b"}
    for (course, f), r in got.items():
        part = pdf[pdf.course_id == course]
        assert r.r == pytest.approx(np.corrcoef(part[f], part.final_score)[0, 1]) and r.n == len(part)


def test_spearman_matches_pandas(sample):
    pdf, df = sample
    for r in stats.spearman(df, ["a", "b", "c"], "final_score", ["course_id"]).collect():
        part = pdf[pdf.course_id == r.course_id]
        assert r.r == pytest.approx(np.corrcoef(part[r.feature].rank(), part.final_score.rank())[0, 1])


def test_matrix_and_pairs(sample):
    pdf, df = sample
    pairs = stats.high_pairs(stats.correlation_matrix(df, ["a", "b", "d"])).collect()
    assert [(r.feature1, r.feature2) for r in pairs] == [("a", "d")]


def test_t_and_u_match_direct_computation(sample):
    pdf, df = sample
    p, q = pdf[pdf.failed == 0].b, pdf[pdf.failed == 1].b
    t = one(stats.t_test(df, ["b"]))
    pooled = ((len(p) - 1) * p.var() + (len(q) - 1) * q.var()) / (len(pdf) - 2)
    assert t.t == pytest.approx((p.mean() - q.mean()) / np.sqrt(pooled * (1 / len(p) + 1 / len(q))))
    u = one(stats.mann_whitney(df, ["b"]))
    brute = sum((x > q).sum() + 0.5 * (x == q).sum() for x in p)
    assert u.u == pytest.approx(brute)


def test_chi_square_2x2_uses_yates_and_counts_missing_cells(spark):
    table = spark.createDataFrame([("x", "p", 12), ("x", "f", 5), ("y", "p", 3), ("y", "f", 9)], "r string, c string, n long")
    n, a, b, c, d = 29, 12, 5, 3, 9
    want = n * max(abs(a * d - b * c) - n / 2, 0) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    r = one(stats.with_chi2_p(stats.chi_square(table, "r", "c")))
    assert r.chi2 == pytest.approx(want) and r.dof == 1
    sparse = spark.createDataFrame([("x", "p", 4), ("y", "f", 6), ("z", "p", 2), ("z", "f", 3)], "r string, c string, n long")
    m = np.array([[4, 0], [0, 6], [2, 3]], float)
    e = np.outer(m.sum(1), m.sum(0)) / m.sum()
    assert one(stats.chi_square(sparse, "r", "c")).chi2 == pytest.approx(((m - e) ** 2 / e).sum())


def test_insight_gates_ratios_and_text(spark):
    rows = [(i, 1.0 if i < 100 else 0.0, 1 if (i < 26 or 100 <= i < 153) else 0) for i in range(200)]
    df = spark.createDataFrame([(i, s, f) for i, s, f in rows], "user_id long, session_count double, failed int")
    r = one(stats.insights(stats.feature_impact(df)))
    assert r.relative_risk == pytest.approx(0.53 / 0.26)
    assert r.insight_text.startswith("Students with low total number of study sessions have 104% higher failure risk (failure rate: 53.0% vs 26.0%)")
    assert r.insight_text.endswith("(p < 0.001)") and r.significant
    assert stats.feature_impact(df.limit(40)).count() == 0


def test_insight_uses_fisher_for_small_cells(spark):
    rows = [(float(i), 1 if i in (0, 1, 2, 3, 4, 5, 6, 7, 55) else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "total_page_views double, failed int")
    r = one(stats.insights(stats.feature_impact(df)))
    from campuspulse.functions.tails import fisher_two_sided

    assert r.p_value == pytest.approx(fisher_two_sided(29, 1, 22, 8))


def test_quantile_buckets_are_right_closed(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)], "x double")
    got = [r.bucket for r in stats.quantile_buckets(df, "x").orderBy("x").collect()]
    want = pd.qcut(pd.Series(range(1, 12), dtype=float), 5, labels=False) + 1
    assert got == want.tolist()


def test_auc_and_curves(sample):
    pdf, df = sample
    scored = df.withColumn("s", F.col("b"))
    p, q = pdf[pdf.failed == 1].b, pdf[pdf.failed == 0].b
    want = np.mean([(x > q).mean() + 0.5 * (x == q).mean() for x in p])
    assert one(stats.auc(scored, "s", "failed")).auc == pytest.approx(want)
    roc = stats.roc_points(scored, "s", "failed").orderBy("threshold").collect()
    for r in roc:
        assert r.tpr == pytest.approx((p >= r.threshold).mean()) and r.fpr == pytest.approx((q >= r.threshold).mean())
    for r in stats.pr_points(scored, "s", "failed").collect():
        assert r.precision == pytest.approx(pdf[pdf.b >= r.threshold].failed.mean())


def test_risk_scores_and_sweep(sample):
    pdf, df = sample
    wide = df.selectExpr("user_id", "failed", "a as unique_active_hours", "b as total_activity_time", "d as avg_gap_hours", "c as gap_std_hours")
    got = risk.risk_score_minmax(wide).toPandas().sort_values("user_id")

    def norm(s):
        return (s - s.min()) / (s.max() - s.min() + 0.001)

    raw = -0.36 * norm(pdf.a) - 0.36 * norm(pdf.b) + 0.35 * norm(pdf.d) + 0.29 * norm(pdf.c)
    assert np.allclose(got.risk_score, norm(raw) * 100)
    sweep = {r.threshold: r for r in risk.threshold_sweep(risk.risk_score_minmax(wide)).collect()}
    flagged = (norm(raw) * 100 >= 50).values
    assert sweep[50.0].n_flagged == flagged.sum()
    assert sweep[50.0].recall == pytest.approx((flagged & (pdf.failed == 1)).sum() / pdf.failed.sum() * 100)


def test_f1_of_published_precision_and_recall(spark):
    # 617 of 1000 failures found, 885 flagged: precision .697, recall .617 -> F1 .655
    rows = [(1, 1.0)] * 617 + [(0, 1.0)] * 268 + [(1, 0.0)] * 383 + [(0, 0.0)] * 100
    m = one(ml.classification_metrics(spark.createDataFrame(rows, "failed int, prediction double")))
    assert (round(m.precision, 3), round(m.recall, 3), round(m.f1, 3)) == (0.697, 0.617, 0.655)


def test_empty_metrics_are_zero(spark):
    m = one(ml.classification_metrics(spark.createDataFrame([(0, 0.0)], "failed int, prediction double")))
    assert (m.precision, m.recall, m.f1, m.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_density_is_close_to_the_exact_sum(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i % 2), float(v)) for i, v in enumerate(np.concatenate([rng.exponential(50, 400), [0.0] * 100, [900.0]]))]
    df = spark.createDataFrame(rows + [(0, None), (None, 1.0), (2, 5.0)], "g int, v double")
    got = {(r.g, r.point): (r.x, r.density) for r in stats.density_curve(df, "v", "g").collect()}
    assert {g for g, _ in got} == {0, 1}
    for g in (0, 1):
        v = np.array([x for k, x in rows if k == g])
        h = v.std(ddof=1) * len(v) ** -0.2
        exact = {i: np.exp(-0.5 * ((got[g, i][0] - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi)) for i in range(40)}
        peak = max(exact.values())
        assert max(abs(got[g, i][1] - exact[i]) for i in exact) < peak / (8 * 20**2) * 1.01


def test_small_groups_get_the_exact_rank_test(spark):
    from campuspulse.functions.tails import normal_two_sided, rank_sum_two_sided

    rows = [("a", int(i >= 4), float(v)) for i, v in enumerate([1, 5, 6, 9, 2, 3, 4])]  # no ties
    rows += [("b", i % 2, float(i // 4)) for i in range(12)] + [("c", 0, 1.0)]  # ties; one class only
    df = spark.createDataFrame(rows, "g string, failed int, x double")
    got = {r.g: r for r in stats.mann_whitney_test(df, ["x"], ["g"]).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].p_value == pytest.approx(rank_sum_two_sided(got["a"].u, 4, 3)) and got["b"].p_value == pytest.approx(normal_two_sided(got["b"].z))


def test_planted_effect_across_courses_and_as_an_insight(spark):
    corr = spark.createDataFrame([("f", c, 40, 0.6) for c in (1, 2, 3)] + [("g", 1, 40, 0.05), ("g", 2, 40, 0.7)], "feature string, course_id long, n long, r double")
    mean = stats.cross_course_mean(stats.with_significance(corr).where("significant")).collect()
    assert [(r.feature, r.n_courses, round(r.avg_r, 9)) for r in mean] == [("f", 3, 0.6)]
