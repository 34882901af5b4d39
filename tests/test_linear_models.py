"""Grouped linear and logistic models against plain numpy and against Spark's own trainer."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campuspulse.operators import linear_models as lm
from campuspulse.operators import ml

F_ = ["a", "b", "c"]


def make(n, courses, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 60 + rng.normal(scale=2, size=n)
    pdf = pd.DataFrame({"course_id": rng.integers(0, courses, n), "user_id": rng.permutation(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "final_score": y})
    pdf["failed"] = (y < 58).astype(int)
    return pdf


def contiguous(n, k):
    """Fold sizes n // k, the first n % k one longer."""
    return np.repeat(np.arange(k), [n // k + (i < n % k) for i in range(k)])


@pytest.fixture(scope="module")
def grouped(spark):
    pdf = make(160, 6)
    extra = pd.DataFrame([(90, i, 1.0 * i, 0.0, 0.0, 50.0 + i, 1) for i in range(4)] + [(91, 7, 1.0, 2.0, 3.0, 40.0, 1)], columns=["course_id", "user_id", *F_, "final_score", "failed"])
    pdf = pd.concat([pdf, extra], ignore_index=True)
    return pdf, lm.contiguous_folds(spark.createDataFrame(pdf), ["course_id"], "user_id").cache()


def test_contiguous_folds(grouped):
    pdf, df = grouped
    got = df.toPandas()
    assert len(got) == len(pdf)
    for _, part in got.groupby("course_id"):
        k = min(5, len(part) // 3)
        folds = part.sort_values("user_id").fold
        assert folds.isna().all() if k < 2 else folds.tolist() == contiguous(len(part), k).tolist()


def brute_ridge(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return y.mean() - x.mean(0) @ beta, beta


def test_cross_validated_equals_single_fits(grouped):
    pdf, df = grouped
    choices = {"all": F_, "two": ["a", "c"]}
    grams = lm.gram(df, F_, "final_score", ["course_id", "fold"])
    got = {(r.course_id, r.choice): r for r in lm.cross_validated(grams, ["course_id"], F_, choices).collect()}
    rows = df.toPandas()
    assert len(got) == 2 * rows.course_id.nunique()
    for (course, choice), r in got.items():
        part = rows[rows.course_id == course]
        x, y = part[choices[choice]].values, part.final_score.values
        intercept, beta = brute_ridge(x, y, 1.0)
        assert r.n == len(part) and np.allclose(r.coefficients, beta) and r.intercept == pytest.approx(intercept)
        scores = []
        for fold in sorted(part.fold.dropna().unique()):
            held = (part.fold == fold).values
            b0, b = brute_ridge(x[~held], y[~held], 1.0)
            e = y[held] - b0 - x[held] @ b
            scores.append(1 - (e @ e) / ((y[held] - y[held].mean()) ** 2).sum())
        assert r.folds == len(scores)
        if scores:
            assert r.r2_mean == pytest.approx(np.mean(scores), rel=1e-7) and r.r2_std == pytest.approx(np.std(scores), rel=1e-6)
        else:
            assert r.r2_mean is None and r.r2_std is None
    shares = lm.weights_of(lm.cross_validated(grams, ["course_id"], F_, {"all": F_}), ["course_id"], F_).groupBy("course_id").sum("importance").collect()
    assert all(s[1] == pytest.approx(1) or s[1] == 0 for s in shares)


def test_one_aggregate_whatever_the_number_of_courses(grouped):
    _, df = grouped
    grams = lm.gram(df, F_, "final_score", ["course_id", "fold"])
    plan = lm.cross_validated(grams, ["course_id"], F_, {"all": F_})._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("InMemoryTableScan") <= 2


def test_linear_out_of_fold(spark):
    pdf = make(90, 1)
    df = ml.stratified_folds(spark.createDataFrame(pdf), "failed").cache()
    for alpha in (0.0, 5.0):
        got = lm.linear_out_of_fold(df, F_, alpha=alpha).toPandas()
        for fold, part in got.groupby("fold"):
            rest = got[got.fold != fold]
            b0, b = brute_ridge(rest[F_].values, rest.final_score.values, alpha)
            assert np.allclose(part.prediction, b0 + part[F_].values @ b)


def test_least_squares_of_equal_features():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 1))
    z = np.column_stack([np.ones(30), x, x, 2 * x[:, 0] + 1])
    intercept, first, second = lm.ridge(z.T @ z, 0.0)
    assert intercept == pytest.approx(1) and first + second == pytest.approx(2)


def test_logistic_equals_the_trainer_and_covers_every_fold(spark):
    pdf = make(240, 3)
    df = ml.stratified_folds(spark.createDataFrame(pdf), "failed").cache()
    models = lm.logistic_by_fold(df, F_)
    rows = df.toPandas()
    for m, w in models.items():
        part = rows[rows.fold != m]
        fit = ml.logistic(len(part)).setTol(1e-12).setMaxIter(500).fit(
            ml.assemble(ml.balanced_weight(spark.createDataFrame(part), "failed"), F_))
        assert np.allclose([fit.intercept, *fit.coefficients.toArray()], w, atol=1e-5)
    pred = lm.logistic_out_of_fold(df, F_).toPandas()
    assert len(pred) == len(pdf) and ((pred.probability > 0.5) == (pred.prediction == 1)).all()
    assert ((pred.prediction == pred.failed).mean()) > 0.7


def test_logistic_with_one_class(spark):
    pdf = make(40, 1)
    pdf["failed"] = 0
    df = ml.stratified_folds(spark.createDataFrame(pdf), "failed").cache()
    pred = lm.logistic_out_of_fold(df, F_).toPandas()
    assert (pred.prediction == 0).all() and pred.probability.max() < 1e-6
    metrics = ml.classification_metrics(lm.logistic_out_of_fold(df, F_))
    assert ml.large_enough(metrics, df).count() == 0


def test_medians_of_the_course(spark):
    rows = [(1, 1.0), (1, 3.0), (1, None), (2, None), (2, float("inf")), (3, None)]
    df = spark.createDataFrame(rows, "course_id int, x double")
    got = sorted((r.course_id, r.x) for r in ml.impute(df, ["x"], by=["course_id"]).collect())
    assert got == [(1, 1.0), (1, 2.0), (1, 3.0), (2, 0.0), (2, 0.0), (3, 0.0)]


def test_best_model_prefers_the_first_of_a_tie(spark):
    table = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "model string, auc double")
    assert ml.best_model(table, "auc").first().model == "a"


def test_feature_sets_share_one_frame(spark, monkeypatch):
    from campuspulse.plans import catalog, ml_queries

    rows = [(1, i, i % 2, i % 5, *[float((i * (j + 3)) % 7) for j in range(len(ml_queries.EVERYTHING))]) for i in range(60)]
    names = ", ".join(f"{f} double" for f in ml_queries.EVERYTHING)
    frame = spark.createDataFrame(rows, f"course_id long, user_id long, failed int, fold int, {names}").withColumn("weight", F.lit(1.0))
    built = []
    monkeypatch.setattr(ml_queries, "model_frame", lambda *a, **b: built.append(a) or frame)
    for name in ("feature_set_comparison", "best_model"):
        built.clear()
        assert catalog.queries()[name](spark, "").count() == 3 and len(built) == 1
