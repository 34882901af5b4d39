import numpy as np
import pandas as pd
import pytest
from helpers import one
from pyspark.sql import functions as F

from campuspulse.operators import forests, ml


def test_a_tree_grown_to_its_end_fits_its_own_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (500, 6)).astype(np.uint8)
    y = rng.normal(size=500)
    every = forests.grown(x, y, np.ones(500), x, 30, 6, rng)
    assert np.allclose(every, y)
    # No levels: the mean. One level: the best of all cuts of both features.
    assert np.allclose(forests.grown(x, y, np.ones(500), x[:3], 0, 6, rng), y.mean())
    step = (x[:, 1] > 99) * 4.0 + x[:, 0] / 1000
    got = forests.grown(x, step, np.ones(500), x, 1, 6, rng)
    assert np.allclose(got, np.where(x[:, 1] > 99, step[x[:, 1] > 99].mean(), step[x[:, 1] <= 99].mean()))


def test_rows_of_one_kind_end_a_tree():
    x, y = np.zeros((50, 2), np.uint8), np.arange(50.0)
    assert np.allclose(forests.grown(x, y, np.ones(50), x[:2], 30, 2, np.random.default_rng(1)), y.mean())


def test_deep_forests_leave_small_nodes_to_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal(size=(n, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 60 + rng.normal(scale=0.5, size=n)
    rows = pd.DataFrame({"user_id": np.arange(n), "fold": np.arange(n) % 5, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "final_score": y})
    df = ml.assemble(spark.createDataFrame(rows), ["a", "b", "c"])
    fitted, fit = [], ml.RandomForestRegressor.fit
    monkeypatch.setattr(ml.RandomForestRegressor, "fit", lambda self, data, *a: fitted.append(self.getMaxDepth()) or fit(self, data, *a))
    for least in (4_000, 100):
        monkeypatch.setattr(forests, "NODE_ROWS", least)
        pred = ml.out_of_fold(df, ml.forest_regressor(trees=20)).select("user_id", "final_score", "prediction").cache()
        assert pred.count() == n and pred.select("user_id").distinct().count() == n
        assert one(ml.regression_metrics(pred)).r2 > 0.8
        assert pred.where(F.col("prediction").isNull()).isEmpty()
    # Spark's trainer grows the levels near the root only.
    assert set(fitted) == {0, 3} and len(fitted) == 10


def test_rows_that_stand_for_several_grow_the_same_tree():
    rng = np.random.default_rng(8)
    kinds = rng.integers(0, 256, (40, 4)).astype(np.uint8)
    kind = rng.integers(0, 40, 400)
    y, w = rng.normal(size=400), rng.integers(1, 4, 400).astype(float)
    every = forests.grown(kinds[kind], y, w, kinds, 3, 4, np.random.default_rng(2))
    total, sums = np.bincount(kind, w), np.bincount(kind, w * y)
    inner = np.bincount(kind, w * y * y) - sums**2 / total
    assert np.allclose(every, forests.grown(kinds, sums / total, total, kinds, 3, 4, np.random.default_rng(2), inner))


def test_many_equal_rows_need_no_further_levels_of_the_trainer(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 2_000
    x = rng.normal(size=(n, 3)) * (np.arange(n) % 10 == 0)[:, None]
    rows = pd.DataFrame({"user_id": np.arange(n), "fold": rng.integers(0, 5, n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "final_score": 5 * x[:, 0] + rng.normal(size=n)})
    df = ml.assemble(spark.createDataFrame(rows), ["a", "b", "c"])
    fitted, fit = [], ml.RandomForestRegressor.fit
    monkeypatch.setattr(ml.RandomForestRegressor, "fit", lambda self, data, *a: fitted.append(self.getMaxDepth()) or fit(self, data, *a))
    monkeypatch.setattr(forests, "NODE_ROWS", 100)
    pred = ml.out_of_fold(df, ml.forest_regressor(trees=10)).select("a", "fold", "final_score", "prediction").toPandas()
    assert len(pred) == n and pred.prediction.notna().all()
    assert len(fitted) == 5
    assert (pred[pred.a == 0].groupby("fold").prediction.nunique() == 1).all()
    assert np.corrcoef(pred[pred.a != 0].prediction, pred[pred.a != 0].final_score)[0, 1] > 0.8


def test_uneven_trees_of_large_tables_grow_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 3_000
    # Splits take a few rows off at the edge, so nodes of many rows stay at any depth of even splits.
    x = rng.normal(size=(n, 3))
    y = np.exp(2.5 * x[:, 0]) + 0.01 * x[:, 1] + rng.normal(scale=0.01, size=n)
    rows = pd.DataFrame({"user_id": np.arange(n), "fold": np.arange(n) % 5, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "final_score": y})
    df = ml.assemble(spark.createDataFrame(rows), ["a", "b", "c"])
    fitted, fit = [], ml.RandomForestRegressor.fit
    monkeypatch.setattr(ml.RandomForestRegressor, "fit", lambda self, data, *a: fitted.append(1) or fit(self, data, *a))
    monkeypatch.setattr(forests, "NODE_ROWS", 40)
    monkeypatch.setattr(forests, "TRAINER_ROWS", 1_000, raising=False)
    pred = ml.out_of_fold(df, ml.forest_regressor(trees=10)).select("user_id", "final_score", "prediction").toPandas()
    assert len(fitted) <= 5
    assert len(pred) == n and pred.user_id.nunique() == n and pred.prediction.notna().all()
    # The few largest targets take most of the gain; in ranks most of the target is found.
    assert pred.prediction.rank().corr(pred.final_score.rank()) > 0.8


def test_only_large_nodes_go_on_to_the_next_level(spark, monkeypatch):
    monkeypatch.setattr(forests, "NODE_ROWS", 50)
    rng = np.random.default_rng(6)
    n, same = 900, 300
    code = rng.integers(0, 256, (n, 4)).astype(np.uint8)
    code[:same] = 7
    alike = np.where(np.arange(n) < same, 0, np.arange(n))
    rows = [(i, i % 5, float(code[i, 0] + rng.normal()), int(alike[i]), bytes(code[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "_row long, fold int, y double, alike long, code binary").repartition(3, "alike")
    blocks = df.mapInArrow(forests._packer, forests._BLOCK).cache()
    bins = forests.bins_of_codes([np.arange(255.0)] * 4, 32)
    trees, ends, levels = forests.near_root(blocks, ml.forest_regressor(trees=4), bins, 2, 5)
    assert len(trees) == 20 and 4 <= levels < 30
    for key, tree in trees.items():
        is_open, value, depth = ends[divmod(key, 4)]
        assert len(is_open) == len(value) == len(depth) == len(tree[0]) and depth.max() <= levels and is_open.all()
        found = np.concatenate([forests.reached(forests._unpacked(b, bins)[6], tree, levels, np.arange(len(b["alike"]) // 8)) for b in blocks.collect()])
        assert np.bincount(found).max() <= 1.25 * 2 * 50 and (tree[2][found] == found).all()


def test_splits_near_the_root_by_hand():
    w, kinds = np.array([[[2.0, 1.0, 0.0, 3.0]]]), np.array([[[1.0, 1.0, 0.0, 2.0]]])
    y = np.array([1.0, 1.0, 0.0, 5.0])
    feature, cut, sides, pure = forests.level_splits(w, w * y, kinds, (w * y * y)[0].sum(axis=1), np.array([[9]]))
    assert (feature.tolist(), cut.tolist(), pure.tolist()) == ([9], [1], [False])
    assert sides.tolist() == [[[3.0, 3.0, 2.0], [3.0, 15.0, 2.0]]]
    # Equal targets end a node; one bin only lets it try other features.
    assert forests.level_splits(w, w * 4, kinds, np.array([96.0]), np.array([[9]]))[3].tolist() == [True]
    one = np.array([[[6.0, 0.0]]])
    assert [v.tolist() for v in forests.level_splits(one, one * 2, one, np.array([30.0]), np.array([[9]]))[::3]] == [[-1], [False]]


def test_bins_near_the_root_share_out_many_codes():
    few, many = forests.bins_of_codes([np.arange(10.0), np.arange(255.0)], 32)
    assert few[:11].tolist() == list(range(11)) and many.max() == 31 and (np.bincount(many) == 8).all()


def test_targets_must_be_known(spark, monkeypatch):
    monkeypatch.setattr(forests, "TRAINER_ROWS", 0)
    df = ml.assemble(spark.range(20).selectExpr("id", "cast(id % 5 as int) AS fold", "id * 1.0 AS a", "if(id < 3, null, id * 1.0) AS final_score"), ["a"])
    with pytest.raises(ValueError, match="null or NaN in 3 rows"):
        ml.out_of_fold(df, ml.forest_regressor(trees=2))
