"""Rank correlation on counts against ranks of rows."""

import numpy as np
import pandas as pd
import pytest

from campuspulse.operators import stats


def test_equals_ranks_of_rows(spark):
    rng = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"course_id": rng.integers(0, 3, n), "score": np.round(rng.normal(60, 10, n)), "hot": np.where(rng.random(n) < 0.8, 0.0, rng.random(n)),
                        "ties": rng.integers(0, 4, n).astype(float), "flat": 1.0, "gaps": rng.normal(size=n)})
    pdf.loc[rng.random(n) < 0.3, "gaps"] = None
    pdf.loc[rng.random(n) < 0.1, "score"] = None
    pdf.loc[pdf.course_id == 2, "hot"] = None
    pdf.loc[(pdf.course_id == 2) & (pdf.index > 30), "ties"] = None
    features = ["hot", "ties", "flat", "gaps"]
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False, name=None)],
                               "course_id long, score double, hot double, ties double, flat double, gaps double")
    got = {(r.course_id, r.feature): (r.n, r.r) for r in stats.spearman(df, features, "score", ["course_id"]).collect()}
    want = {}
    for course, part in pdf.groupby("course_id"):
        for f in features:
            both = part[[f, "score"]].dropna()
            if len(both) >= 5 and both[f].nunique() > 1:
                want[course, f] = (len(both), np.corrcoef(both[f].rank(), both["score"].rank())[0, 1])
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)


def test_no_join_on_feature_values(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "course_id long, score double, x double")
    plan = stats.spearman(df, ["x"], "score", ["course_id"])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not any("value#" in line for line in joins)
