import numpy as np
import pandas as pd
import pytest
from helpers import one
from pyspark.sql import functions as F

from campuspulse.operators import ml


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 200
    x = rng.normal(size=(n, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 60 + rng.normal(scale=2, size=n)
    pdf = pd.DataFrame({"course_id": 1, "user_id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "final_score": y})
    pdf["failed"] = (y < 58).astype(int)
    df = ml.stratified_folds(ml.balanced_weight(spark.createDataFrame(pdf), "failed"), "failed")
    return pdf, ml.assemble(df, ["a", "b", "c"]).cache()


def test_folds_are_stratified_and_complete(data):
    pdf, df = data
    sizes = df.groupBy("fold", "failed").count().toPandas()
    assert sizes["count"].sum() == len(pdf)
    for label in (0, 1):
        part = sizes[sizes.failed == label]["count"]
        assert len(part) == 5 and part.max() - part.min() <= 1


def test_ridge_and_linear_match_closed_form(data):
    pdf, df = data
    x, y = pdf[["a", "b", "c"]].values, pdf.final_score.values
    xc, yc = x - x.mean(0), y - y.mean()
    fit = ml.ridge(len(y), y.std(), alpha=25.0).fit(df)
    assert np.allclose(fit.coefficients.toArray(), np.linalg.solve(xc.T @ xc + 25 * np.eye(3), xc.T @ yc), atol=1e-4)
    assert np.allclose(ml.linear().fit(df).coefficients.toArray(), np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-6)


def test_logistic_matches_newton(data):
    pdf, df = data
    model = ml.logistic(len(pdf)).fit(df)
    w = len(pdf) / (2 * pdf.failed.map(pdf.failed.value_counts())).values
    x = np.column_stack([pdf[["a", "b", "c"]].values, np.ones(len(pdf))])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = x.T @ (w * (p - pdf.failed.values)) + np.r_[beta[:3], 0]
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1, 1, 1, 0])
        beta -= np.linalg.solve(hess, grad)
    assert np.allclose(model.coefficients.toArray(), beta[:3], atol=5e-3)


def test_out_of_fold_covers_every_row_and_learns(data):
    pdf, df = data
    pred = ml.out_of_fold(df, ml.linear()).select("user_id", "final_score", "prediction")
    assert pred.select("user_id").distinct().count() == len(pdf)
    assert one(ml.regression_metrics(pred)).r2 > 0.5
    assert {r.fold for r in ml.out_of_fold(df, ml.linear()).select("fold").distinct().collect()} == set(range(5))
    summary = one(ml.fold_summary(ml.out_of_fold(df, ml.logistic(160)).cache()))
    assert summary.auc_mean > 0.8 and summary.f1_std >= 0


def test_comparison_picks_the_best_model(spark):
    rows = [("a", 0.9, 0.1), ("b", 0.4, 0.7)]
    table = spark.createDataFrame(rows, "model string, recall double, auc double")
    assert one(ml.best_model(table)).model == "a" and one(ml.best_model(table, "auc")).model == "b"
    imp = spark.createDataFrame([("x", 0.2, 1), ("x", 0.4, 2)], "feature string, importance double, course_id long")
    assert one(ml.mean_importance(imp)).importance == pytest.approx(0.3)


def test_impute_median_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (100.0,)], "x double")
    got = sorted(r.x for r in ml.impute(df, ["x"]).collect())
    assert got == [1.0, 3.0, 3.0, 100.0]
    inf = spark.createDataFrame([(float("inf"),), (None,)], "x double")
    assert [r.x for r in ml.impute(inf, ["x"], "zero").collect()] == [0.0, 0.0]


def test_ward_groups_correlated_features():
    r = np.array([[1, 0.9, 0, 0], [0.9, 1, 0, 0], [0, 0, 1, 0.8], [0, 0, 0.8, 1]], float)
    assert ml.ward_clusters(r, 2) == [0, 0, 1, 1]
    assert ml.ward_clusters(r, 4) == [0, 1, 2, 3]


def test_cluster_names_never_clash(spark):
    names = ["session_count", "session_gap_min", "weekly_cv", "late_surge"]
    matrix = spark.createDataFrame([("session_count", "session_gap_min", 0.1), ("weekly_cv", "late_surge", 0.9)], "feature1 string, feature2 string, r double")
    rows = ml.feature_clusters(matrix, names, 3)
    assert len({n for _, _, n in rows}) == 3
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (2.0, 1.0, 5.0, 6.0)], ", ".join(f"{n} double" for n in names))
    assert sum(c.startswith("agg_") for c in ml.pooled_features(df, rows).columns) == 3


def test_pca_and_standardise(data):
    pdf, df = data
    z = ml.standardise(df.select("user_id", "a", "b"), ["a", "b"]).agg(F.stddev_pop("a").alias("s"), F.avg("b").alias("m"))
    assert one(z).s == pytest.approx(1.0) and abs(one(z).m) < 1e-12
    got = [r.explained for r in ml.pca_variance(df.drop("features"), ["a", "b", "c"], 3).collect()]
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(pdf[["a", "b", "c"]].values.T)))[::-1] / 3
    assert np.allclose(got, want)


def test_boosting_is_weighted_only_where_asked():
    plain, weighted = ml.boosted(), ml.boosted(200, 5, weighted=True)
    assert not plain.isSet("weightCol") and weighted.getWeightCol() == "weight"
    assert (plain.getMaxIter(), plain.getMaxDepth(), weighted.getMaxIter(), weighted.getMaxDepth()) == (100, 3, 200, 5)


def test_trees_learn_planted_data(data):
    _, df = data
    forest = one(ml.fold_summary(ml.out_of_fold(df, ml.forest(trees=20)).cache()))
    trees = one(ml.fold_summary(ml.out_of_fold(df, ml.boosted(rounds=10, weighted=True)).cache()))
    assert forest.auc_mean > 0.8 and trees.auc_mean > 0.8
    grades = one(ml.regression_metrics(ml.out_of_fold(df, ml.forest_regressor(trees=20)).select("final_score", "prediction")))
    assert grades.r2 > 0.5


def test_queries_fit_full_models(spark, monkeypatch):
    from campuspulse.plans import catalog, ml_queries

    fitted, frame = [], spark.createDataFrame([(1, 1, 0, 50.0)], "course_id long, user_id long, failed int, final_score double")
    done = frame.withColumn("prediction", F.lit(1.0)).withColumn("probability", F.lit(0.5))
    for name in ("model_frame", "feature_table"):
        monkeypatch.setattr(ml_queries, name, lambda *a, **b: frame)
    monkeypatch.setattr(ml_queries, "materialise", lambda df: df)
    monkeypatch.setattr(ml, "assemble", lambda df, features: df)
    monkeypatch.setattr(ml, "out_of_fold", lambda df, model, k=5: fitted.append((model, k)) or done)
    monkeypatch.setattr(ml, "fold_summary", lambda df: df)
    monkeypatch.setattr(ml, "compare_models", lambda models: frame)
    monkeypatch.setattr(ml_queries.lm, "logistic_out_of_fold", lambda *a, **b: done)
    monkeypatch.setattr(ml_queries.lm, "linear_out_of_fold", lambda *a, **b: done)
    monkeypatch.setattr(ml_queries.stats, "correlation_matrix", lambda *a: None)
    monkeypatch.setattr(ml, "feature_clusters", lambda *a: [])
    monkeypatch.setattr(ml, "pooled_features", lambda *a: frame.withColumn("agg_a", F.lit(1.0)))
    monkeypatch.setattr(frame.__class__, "select", lambda self, *c, f=frame.__class__.select: f(self, *[x for x in c if not isinstance(x, str) or x in self.columns]))
    for name in ("gbt_oof", "gbt_oof_weighted", "rf_oof_deep", "model_comparison", "grade_regression", "reduced_vs_original"):
        catalog.queries()[name](spark, "")
    forests = sorted((m.getNumTrees(), m.getMaxDepth()) for m, _ in fitted if "RandomForest" in type(m).__name__)
    rounds = sorted((m.getMaxIter(), m.getMaxDepth()) for m, _ in fitted if "GBT" in type(m).__name__)
    assert forests == [(100, 4), (100, 30), (100, 30), (100, 30), (200, 10)] and rounds == [(100, 3), (100, 3), (100, 3), (200, 5)]
    assert all(k == 5 for _, k in fitted)
