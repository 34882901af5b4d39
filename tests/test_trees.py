import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campuspulse.operators import linear_models as lm
from campuspulse.operators import ml, trees


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    n = 400
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] - x[:, 1] + rng.normal(scale=0.7, size=n) > 0.3).astype(int)
    w = n / (2 * np.where(y == 1, y.sum(), n - y.sum()))
    rows = pd.DataFrame({"user_id": np.arange(n), "fold": np.arange(n) % 5, "failed": y, "weight": w} | {c: x[:, j] for j, c in enumerate("abcd")})
    return ml.assemble(spark.createDataFrame(rows), list("abcd")).cache()


def by_spark(df, estimator, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(ml, "fits", lambda e: False)
        return ml.out_of_fold(df, estimator).orderBy("user_id").toPandas()


def test_boosting_is_that_of_sparks_trainer(planted, monkeypatch):
    model = ml.boosted(rounds=5, depth=3, weighted=True)
    want = by_spark(planted, model, monkeypatch)
    # No fold is fitted by a chain of jobs of its own.
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda *a: pytest.fail("fitted row by row"))
    got = ml.out_of_fold(planted, model).orderBy("user_id").toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    # Equal gains may fall to either split.
    assert np.mean(np.isclose(got.probability, want.probability, atol=1e-6)) > 0.5
    assert np.corrcoef(got.probability, want.probability)[0, 1] > 0.98


def test_boosted_regressors_are_those_of_sparks_trainer(planted, monkeypatch):
    model = ml.boosted_regressor(rounds=5, depth=3, target="grade")
    df = planted.withColumn("grade", 50 + 9 * F.col("a") + 4 * F.sin(3 * F.col("b")))
    want = by_spark(df, model, monkeypatch)
    monkeypatch.setattr(trees, "TRAINER_ROWS", 100, raising=False)
    # No fold is fitted by a chain of jobs of its own.
    monkeypatch.setattr(ml.GBTRegressor, "fit", lambda *a: pytest.fail("fitted row by row"))
    got = ml.out_of_fold(df, model).orderBy("user_id").toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert np.mean(np.isclose(got.prediction, want.prediction, atol=1e-6)) > 0.9
    assert np.corrcoef(got.prediction, want.prediction)[0, 1] > 0.99


def test_boosted_regressors_of_one_target_or_unknown_ones(planted, monkeypatch):
    monkeypatch.setattr(trees, "TRAINER_ROWS", 100)
    model = ml.boosted_regressor(rounds=2, target="grade")
    assert {r.prediction for r in ml.out_of_fold(planted.withColumn("grade", F.lit(3.0)), model).collect()} == {3.0}
    with pytest.raises(ValueError, match="null or NaN in 4 rows"):
        ml.out_of_fold(planted.withColumn("grade", F.when(F.col("user_id") > 3, 1.0)), model)


def test_few_rows_leave_boosted_regressors_to_sparks_trainer(planted):
    df, model = planted.withColumn("grade", F.col("a")), ml.boosted_regressor(rounds=2, target="grade")
    assert trees.regressor_out_of_fold(df, model) is None
    assert ml.out_of_fold(df, model).count() == planted.count()


def test_sums_of_few_bytes_need_no_shuffle(spark, monkeypatch):
    parts = spark.sparkContext.parallelize([(m, np.array([m, 1.0])) for m in (0, 1, 0, 1, 0)], 3)
    for most in (1 << 25, 0):
        monkeypatch.setattr(trees, "DRIVER_BYTES", most)
        assert {m: v.tolist() for m, v in trees._added(parts, 2, 16).items()} == {0: [0.0, 3.0], 1: [2.0, 2.0]}


def test_forests_agree_with_sparks_trainer_within_chance(planted, monkeypatch):
    model = ml.forest(trees=40, depth=6, leaf=5)
    want = by_spark(planted, model, monkeypatch)
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda *a: pytest.fail("fitted row by row"))
    got = ml.out_of_fold(planted, model).orderBy("user_id").toPandas()
    assert np.corrcoef(got.probability, want.probability)[0, 1] > 0.95
    assert abs((got.prediction == got.failed).mean() - (want.prediction == want.failed).mean()) < 0.05


def test_weights_of_single_rows_leave_forests_to_sparks_trainer(planted):
    uneven = planted.withColumn("weight", 1.0 + F.col("user_id") % 2)
    assert trees.classifier_out_of_fold(uneven, ml.forest(trees=2)) is None
    assert ml.out_of_fold(uneven, ml.forest(trees=2)).count() == planted.count()


def test_best_splits_by_hand():
    # Two codes of one feature: the cut parts weights 2 and 3 with targets 2 and -3.
    f, cut, (values, weights) = trees.best_cut(np.array([[[1.0, 1.0, 3.0, 0.0]], [[1.0, 1.0, -3.0, 0.0]]]))
    assert (f, cut, values.tolist(), weights.tolist()) == (0, 1, [1.0, -1.0], [2.0, 3.0])
    assert trees.best_cut(np.array([[[1.0, 1.0]], [[2.0, 2.0]]])) is None
    counts = np.array([[[[3, 0], [1, 0], [0, 4]]]])
    feature, cut, sides = trees.forest_splits(counts, np.array([[7]]), np.ones(2), 1)
    assert (feature.tolist(), cut.tolist(), sides.tolist()) == ([7], [1], [[[4, 0], [0, 4]]])
    assert trees.forest_splits(counts, np.array([[7]]), np.ones(2), 5)[0].tolist() == [-1]


def test_quantiles_of_all_rows_cut_large_tables(spark, monkeypatch):
    monkeypatch.setattr(trees, "EXACT_ROWS", 10)
    rows = spark.range(1000).select((F.col("id") % 5).cast("int").alias("fold"), F.lit(1.0).alias("w"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("x"))
    cuts = trees.cut_points(rows, 1000, 2, 5, 4)
    assert [len(c) for c in cuts[0]] == [3, 1] and np.allclose(cuts[0][0], [250, 500, 750], atol=5)


def test_out_of_fold_logistic_models_leave_out_the_model_of_all_rows(planted, monkeypatch):
    seen, sums = set(), lm.newton_sums
    monkeypatch.setattr(lm, "newton_sums", lambda df, features, label, models, weights: seen.update(models) or sums(df, features, label, models, weights))
    lm.logistic_out_of_fold(planted, list("abcd"))
    assert seen == set(range(5))
    assert lm.ALL_ROWS in lm.logistic_by_fold(planted, list("abcd"))
