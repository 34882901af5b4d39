"""Sliced ranks and quantiles against pandas, with ties, skew and few slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from campuspulse.operators import ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    # One group holds most rows and a third of those share one value.
    g = np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 6, 3000))
    v = np.where(rng.random(3000) < 0.33, 5.0, np.round(rng.exponential(50, 3000), 1))
    pdf = pd.DataFrame({"g": g, "v": v, "id": np.arange(3000)})
    return pdf, spark.createDataFrame(pdf).cache()


def test_ranks_match_pandas(skewed):
    pdf, df = skewed
    want = pdf.assign(mid=pdf.groupby("g").v.rank(), low=pdf.groupby("g").v.rank(method="min")).drop_duplicates(["g", "v"])
    mids = ranks.midranks(df, ["g"], "v").toPandas()
    below = ranks.count_below(df, ["g"], "v").toPandas()
    both = want.merge(mids, on=["g", "v"]).merge(below, on=["g", "v"])
    assert len(both) == len(want) == len(mids)
    assert np.allclose(both.mid, both.midrank)
    assert (both.low == both.n_below + 1).all()
    assert (both.n_below_all == both.g.map(pdf.g.value_counts())).all()


def test_coarse_slices_give_the_same_counts(skewed):
    _, df = skewed
    a = ranks.count_below(df, ["g"], "v").orderBy("g", "v").collect()
    b = ranks.count_below(df, ["g"], "v", F.floor("v")).orderBy("g", "v").collect()
    assert a == b


def test_positions_match_row_number(skewed):
    pdf, df = skewed
    want = pdf.sort_values(["g", "v", "id"]).groupby("g").cumcount() + 1
    got = ranks.positions(df, ["g"], ["v", "id"]).toPandas().set_index("id").position
    assert (got.sort_index() == want.sort_index()).all()
    numbered = ranks.sliced_row_number(df, ["g"], ["id"], F.floor(F.col("id") / 100), "k").toPandas().set_index("id").k
    assert (numbered.sort_index() == pdf.groupby("g").cumcount().add(1)).all()


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_percentiles_match_numpy(skewed, keys):
    pdf, df = skewed
    got = ranks.percentiles(df, keys, "v", {"a": 0.1, "m": 0.5, "z": 0.93}).toPandas()
    groups = pdf.groupby("g") if keys else [(None, pdf)]
    for g, part in groups:
        row = got[got.g == g].iloc[0] if keys else got.iloc[0]
        assert np.allclose([row.a, row.m, row.z], np.quantile(part.v, [0.1, 0.5, 0.93]))


def test_lag_in_chunks_is_lag(spark):
    pdf = pd.DataFrame({"k": [1] * 6 + [2], "o": [1, 2, 11, 12, 31, 32, 5], "v": [1.0, None, 3.0, 4.0, None, 6.0, 9.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "k int, o int, v double")
    got = ranks.lag_in_chunks(df, ["k"], ["o"], "v", F.floor(F.col("o") / 10), "p").orderBy("k", "o").collect()
    assert [r.p for r in got] == [None, 1.0, None, 3.0, 4.0, None, None]


def test_attach_row_needs_no_join(spark):
    df = spark.range(5)
    out = ranks.attach_row(df, df.agg(F.max("id").alias("top"), F.min("id").alias("low")))
    assert [(r.top, r.low) for r in out.collect()] == [(4, 0)] * 5
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
