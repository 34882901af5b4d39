"""Model training and evaluation as Spark ML pipelines.

Frames come in materialised. Folds are a function of hashed ids, so every
evaluation of a fold sees the same rows. Each model is fitted once per fold and
all its metrics come from one aggregate over the out-of-fold predictions.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campuspulse.functions.exprs import safe_ratio
from campuspulse.functions.features import GROUPS
from campuspulse.operators.forests import forest_out_of_fold
from campuspulse.operators.frames import zscore_within
from campuspulse.operators.ranks import attach_row, percentiles, sliced_row_number
from campuspulse.operators.stats import auc
from campuspulse.operators.trees import classifier_out_of_fold, fits, regressor_out_of_fold

SEED = 42


# --- preparation ----------------------------------------------------------------------

def impute(df: DataFrame, features: list[str], strategy: str = "median", by: list[str] | None = None) -> DataFrame:
    """Fill nulls with the column median (of the row's group with ``by``) or zero; infinities become zero."""
    inf = float("inf")
    ready = df.withColumns({f: F.col(f).cast("double") for f in features})
    if strategy == "median" and by:
        present = [F.struct(F.lit(f).alias("feature"), F.when(~F.isnan(f), F.col(f)).alias("value")) for f in features]
        medians = percentiles(ready.select(*by, F.inline(F.array(*present))), [*by, "feature"], "value", {"median": 0.5})
        wide = medians.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"_m_{f}") for f in features])
        ready = ready.join(wide, by, "left").select(*[
            F.coalesce(F.when(~F.isnan(c), F.col(c)), F.col(f"_m_{c}")).alias(c) if c in features else F.col(c) for c in ready.columns])
    elif strategy == "median":
        present = [F.struct(F.lit(f).alias("feature"), F.when(~F.isnan(f), F.col(f)).alias("value")) for f in features]
        # Exact medians of all features in one pass; one number per feature reaches the driver.
        long = ready.select(F.inline(F.array(*present)))
        medians = {r.feature: r.median for r in percentiles(long, ["feature"], "value", {"median": 0.5}).collect()}
        ready = ready.withColumns({f: F.coalesce(F.when(~F.isnan(f), F.col(f)), F.lit(medians.get(f))) for f in features})
    elif strategy != "zero":
        raise ValueError(strategy)
    return ready.withColumns({
        f: F.when(F.col(f).isNull() | F.isnan(f) | F.col(f).isin(inf, -inf), 0.0).otherwise(F.col(f)) for f in features
    })


def complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    return df.dropna(subset=features)


def standardise(df: DataFrame, features: list[str]) -> DataFrame:
    """Zero mean and unit population deviation over all rows; constants become zero."""
    scaled = zscore_within(df, features, [], sample=False, suffix="_z")
    return scaled.drop(*features).withColumnsRenamed({f"{f}_z": f for f in features})


def standardise_within(df: DataFrame, features: list[str], by: str = "course_id") -> DataFrame:
    scaled = zscore_within(df, features, [by], sample=False, suffix="_z")
    return scaled.drop(*features).withColumnsRenamed({f"{f}_z": f for f in features})


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = SEED, ids: tuple[str, ...] = ("course_id", "user_id")) -> DataFrame:
    """Fold 0..k-1 with every class spread evenly.

    Rows are numbered within their class in the order of an MD5 of seed and ids; the numbering is sliced by
    the leading digits, so a class is never sorted in one task.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *ids)))
    numbered = sliced_row_number(hashed, [label], ["_h", *ids], F.substring("_h", 1, 3), "_pos")
    return numbered.withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_h", "_pos")


def balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """n / (2 * class size) per row, for two classes."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all"))
    return attach_row(df.join(sizes, label), total).withColumn("weight", F.col("_all") / (2 * F.col("_n"))).drop("_n", "_all")


# --- estimators. Hyper-parameters ------------------------------------------

def logistic(n_rows: int, c: float = 1.0) -> LogisticRegression:
    """L2 logistic regression; ``n_rows`` turns the inverse strength C into Spark's penalty."""
    return LogisticRegression(
        featuresCol="features", labelCol="failed", weightCol="weight", standardization=False,
        regParam=1.0 / (c * max(n_rows, 1)), maxIter=200,
    )


def forest(trees: int = 100, depth: int = 4, leaf: int = 1) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol="features", labelCol="failed", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=leaf, seed=SEED,
    )


def boosted(rounds: int = 100, depth: int = 3, rate: float = 0.1, weighted: bool = False) -> GBTClassifier:
    """Boosted trees, with the balanced weights of the classes if ``weighted``; node ids are cached and their lineage is cut every ten rounds."""
    model = GBTClassifier(
        featuresCol="features", labelCol="failed", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=SEED, cacheNodeIds=True, checkpointInterval=10
    )
    return model.setWeightCol("weight") if weighted else model


def linear(target: str = "final_score") -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=target)


def ridge(n_rows: int, target_std: float, alpha: float = 1.0, target: str = "final_score") -> LinearRegression:
    """Ridge with the usual alpha; the solver divides the penalty by the target's deviation."""
    return LinearRegression(
        featuresCol="features", labelCol=target, elasticNetParam=0.0, standardization=False, regParam=alpha * target_std / n_rows
    )


def lasso(alpha: float = 0.1, target: str = "final_score") -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=target, elasticNetParam=1.0, standardization=False, regParam=alpha)


def forest_regressor(trees: int = 100, depth: int = 30, target: str = "final_score") -> RandomForestRegressor:
    """Trees that grow as far as the trainer allows: 30 levels."""
    return RandomForestRegressor(featuresCol="features", labelCol=target, numTrees=trees, maxDepth=depth, seed=SEED)


def boosted_regressor(rounds: int = 100, depth: int = 3, target: str = "final_score") -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=SEED, cacheNodeIds=True, checkpointInterval=10)


# --- evaluation ------------------------------------------------------------------------

ROWS_PER_TASK = 50_000


def fitted_input(df: DataFrame) -> DataFrame:
    """The rows that all fits read, dealt to as many tasks as they can fill and kept: trees make a job per level, and each starts from here."""
    tasks = max(1, min(df.count() // ROWS_PER_TASK + 1, df.sparkSession.sparkContext.defaultParallelism * 4))
    return df.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)


def fit_together(spark: SparkSession, jobs: list[Callable[[], object]], width: int = 8) -> list:
    """Results of fits that run side by side: each is a chain of small jobs, so one fit leaves most cores idle."""
    with ThreadPoolExecutor(max_workers=min(width, max(1, len(jobs)))) as pool:
        return list(pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs]))


def out_of_fold(df: DataFrame, estimator, k: int = 5) -> DataFrame:
    """Each row predicted by the model fitted on the other folds; all folds are fitted side by side."""
    if isinstance(estimator, RandomForestRegressor):
        return forest_out_of_fold(df, estimator, fit_together, k)
    if fits(estimator):
        found = (regressor_out_of_fold if isinstance(estimator, GBTRegressor) else classifier_out_of_fold)(df, estimator, k)
        if found is not None:
            return found
    ready = fitted_input(df)
    try:
        models = fit_together(df.sparkSession, [lambda i=i: estimator.fit(ready.where(F.col("fold") != i)) for i in range(k)])
    finally:
        ready.unpersist()
    out = reduce(DataFrame.unionByName, [m.transform(df.where(F.col("fold") == i)) for i, m in enumerate(models)])
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction")


def large_enough(result: DataFrame, frame: DataFrame, label: str = "failed", least: int = 20) -> DataFrame:
    """``result``, or nothing where the frame has under ``least`` rows or a single class."""
    shape = frame.agg(F.count("*").alias("_n"), F.count_distinct(label).alias("_classes"))
    return attach_row(result, shape).where((F.col("_n") >= least) & (F.col("_classes") > 1)).drop("_n", "_classes")


def classification_metrics(pred: DataFrame, by: list[str] | None = None, label: str = "failed") -> DataFrame:
    """tp/fp/fn/tn with accuracy, precision, recall and F1; empty denominators give zero."""
    y, p = F.col(label) == 1, F.col("prediction") == 1
    counts = pred.groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "accuracy": safe_ratio(tp + tn, tp + fp + fn + tn),
        "precision": safe_ratio(tp, tp + fp),
        "recall": safe_ratio(tp, tp + fn),
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
    })


def fold_summary(pred: DataFrame) -> DataFrame:
    """Mean and population deviation of the metrics over folds."""
    per_fold = classification_metrics(pred, ["fold"])
    scores = auc(pred, "probability", "failed", ["fold"])
    names = ["accuracy", "precision", "recall", "f1", "auc"]
    return per_fold.join(scores, "fold").agg(
        *[F.avg(n).alias(f"{n}_mean") for n in names], *[F.stddev_pop(n).alias(f"{n}_std") for n in names]
    )


def regression_metrics(pred: DataFrame, by: list[str] | None = None, target: str = "final_score") -> DataFrame:
    """n, mse, rmse, mae and r2 (null without spread)."""
    err = F.col(target) - F.col("prediction")
    return pred.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(F.sum(err * err), F.var_pop(target) * F.count("*"))).alias("r2"),
    )


def confusion(pred: DataFrame, label: str = "failed") -> DataFrame:
    return pred.groupBy(F.col(label).cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")).agg(
        F.count("*").alias("n")
    )


def compare_models(predictions: dict[str, DataFrame]) -> DataFrame:
    """One row of metrics per model."""
    tagged = [p.select(F.lit(name).alias("model"), "failed", "prediction", "probability") for name, p in predictions.items()]
    pooled = reduce(DataFrame.unionByName, tagged)
    return classification_metrics(pooled, ["model"]).join(auc(pooled, "probability", "failed", ["model"]), "model")


def best_model(comparison: DataFrame, by: str = "recall") -> DataFrame:
    """The model with the highest value (nine digits; the first by name of a tie)."""
    order = F.struct(-F.round(F.coalesce(by, F.lit(float("-inf"))), 9), "model")
    return comparison.agg(F.min_by("model", order).alias("model"), F.max(by).alias(by))


def importances(model, features: list[str], spark) -> DataFrame:
    """Ranked importances of a tree model, or coefficients with odds ratios of a linear one."""
    if hasattr(model, "featureImportances"):
        rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    rows = [(f, float(v)) for f, v in zip(features, model.coefficients.toArray())]
    return (
        spark.createDataFrame(rows, "feature string, coefficient double")
        .withColumn("odds_ratio", F.exp("coefficient"))
        .orderBy(F.desc(F.abs("coefficient")), "feature")
    )


def mean_importance(per_course: DataFrame) -> DataFrame:
    return per_course.groupBy("feature").agg(F.avg("importance").alias("importance"), F.count("*").alias("n_courses"))


# --- structure of the features ------------------------------------------------------------

def pca_variance(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """Explained variance per component of the standardised features."""
    vectors = assemble(standardise(df, features), features)
    model = PCA(k=k, inputCol="features", outputCol="pcs").fit(vectors)
    ratios = model.explainedVariance.toArray()
    rows = [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(ratios, np.cumsum(ratios)))]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double")


def ward_clusters(r: np.ndarray, k: int) -> list[int]:
    """Cluster number of each feature by Ward's rule on distances 2 (1 - r).

    The matrix has one row per feature; its correlations were computed by Spark.
    """
    n = len(r)
    d = 2.0 * (1.0 - np.clip(r, -1.0, 1.0))
    np.fill_diagonal(d, np.inf)
    size, member, alive = np.ones(n), [{i} for i in range(n)], list(range(n))
    while len(alive) > k:
        sub = d[np.ix_(alive, alive)]
        i, j = sorted(alive[p] for p in np.unravel_index(np.argmin(sub), sub.shape))
        for m in alive:
            if m not in (i, j):
                total = size[i] + size[j] + size[m]
                d[i, m] = d[m, i] = ((size[i] + size[m]) * d[i, m] + (size[j] + size[m]) * d[j, m] - size[m] * d[i, j]) / total
        size[i] += size[j]
        member[i] |= member[j]
        alive.remove(j)
    labels = [0] * n
    for number, root in enumerate(sorted(alive, key=lambda a: min(member[a]))):
        for f in member[root]:
            labels[f] = number
    return labels


def feature_clusters(matrix: DataFrame, features: list[str], k: int) -> list[tuple[str, int, str]]:
    """(feature, cluster, cluster name) from the long correlation matrix.

    Features missing from the matrix (no spread) correlate with nothing. Names are
    those of the dominant feature group with the cluster number, so no two clash.
    """
    at = {f: i for i, f in enumerate(features)}
    r = np.eye(len(features))
    for row in matrix.collect():  # one row per pair of features
        i, j = at[row.feature1], at[row.feature2]
        r[i, j] = r[j, i] = row.r
    labels = ward_clusters(r, k)
    names = {}
    for c in set(labels):
        held = [f for f, label in zip(features, labels) if label == c]
        counts = {g: sum(f in fs for f in held) for g, fs in GROUPS.items()}
        best = max(counts, key=counts.get)
        names[c] = f"{best if counts[best] else 'cluster'}_{c}"
    return [(f, c, names[c]) for f, c in zip(features, labels)]


def pooled_features(df: DataFrame, clusters: list[tuple[str, int, str]]) -> DataFrame:
    """Mean of the standardised members of each cluster as new ``agg_`` columns."""
    features = [f for f, _, _ in clusters]
    scaled = standardise(df, features)
    columns: dict[str, Column] = {}
    for name in sorted({n for _, _, n in clusters}):
        held = [F.col(f) for f, _, n in clusters if n == name]
        columns[f"agg_{name}"] = reduce(lambda a, b: a + b, held) / len(held)
    return scaled.withColumns(columns)
