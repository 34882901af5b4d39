"""Linear and logistic models of all groups and folds at once, from grouped sums of products.

A row with features x and target y adds the products of z = (1, x, y) to the sums of its group and fold. Those sums are all that a linear model
needs: the model without a fold is solved from the group's total less the fold's sums, and its error on that fold is the quadratic form
c' G c of the fold's own sums with c = (-intercept, -coefficients, 1). So one grouped aggregate serves every course, every
fold and every subset of the features, at any number of rows.

Logistic models take Newton steps for all folds together: a step is one aggregate of gradients and Hessians per model. What reaches the
driver has the size of the models (folds times features squared), never of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campuspulse.operators.ranks import count_below

ALL_ROWS = -1


# --- folds --------------------------------------------------------------------------------


def contiguous_folds(df: DataFrame, by: list[str], row_id: str, k: int = 5, least: int = 3) -> DataFrame:
    """``fold``: runs of rows in id order, as even as possible, at most ``k`` and at least ``least`` rows each; null below two folds.

    Rows are counted in slices of the id range, so no group is sorted in one task.
    """
    placed = count_below(df, by, row_id)
    i, n = F.col("n_below"), F.col("n_below_all")
    folds = F.least(F.lit(k), F.floor(n / least)).cast("long")
    size, longer = F.floor(n / folds), n % folds
    edge = longer * (size + 1)
    fold = F.when(i < edge, F.floor(i / (size + 1))).otherwise(longer + F.floor((i - edge) / size))
    return df.join(placed.select(*by, row_id, F.when(folds >= 2, fold).cast("int").alias("fold")), [*by, row_id])


# --- linear models --------------------------------------------------------------------------


def gram(df: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """(by, gram): the upper triangle of the sums of products of (1, features, target), row by row."""
    z = [F.lit(1.0), *(F.col(f).cast("double") for f in features), F.col(target).cast("double")]
    sums = [F.sum(z[i] * z[j]).alias(f"_g{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    wide = df.groupBy(*by).agg(*sums)
    return wide.select(*by, F.array(*wide.columns[len(by):]).alias("gram"))


def unpacked(values, size: int) -> np.ndarray:
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = values
    return full + np.triu(full, 1).T


def ridge(g: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, coefficients) from the sums of products; the intercept is not penalised, ``alpha`` 0 gives the least solution."""
    n, sx, sy = g[0, 0], g[0, 1:-1], g[0, -1]
    a = g[1:-1, 1:-1] - np.outer(sx, sx) / n
    b = g[1:-1, -1] - sx * (sy / n)
    beta = np.linalg.solve(a + alpha * np.eye(len(a)), b) if alpha > 0 else np.linalg.lstsq(a, b, rcond=1e-12)[0]
    return np.concatenate([[(sy - beta @ sx) / n], beta])


def held_out_r2(g: np.ndarray, model: np.ndarray) -> float | None:
    """r2 of a model on the rows behind ``g``; None where the target has no spread."""
    c = np.concatenate([-model, [1.0]])
    spread = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
    return 1 - float(c @ g @ c) / spread if spread > 1e-9 * max(g[-1, -1], 1e-300) else None


def cross_validated(grams: DataFrame, by: list[str], features: list[str], choices: dict[str, list[str]], alpha: float = 1.0) -> DataFrame:
    """(by, choice, n, folds, r2_mean, r2_std, intercept, coefficients): one row per group and choice of features.

    ``grams`` has one row per group and ``fold``. Coefficients are those of the model of all rows. r2 is the mean over folds, null without folds.
    """
    size = len(features) + 2
    places = {name: [0, *(features.index(f) + 1 for f in chosen), size - 1] for name, chosen in choices.items()}
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grams.schema.fields if f.name in by)
    fields = "choice string, n long, folds int, r2_mean double, r2_std double, intercept double, coefficients array<double>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                parts = {p["fold"]: unpacked(p["gram"], size) for p in row["parts"]}
                total = sum(parts.values())
                for name, at in places.items():
                    sub = np.ix_(at, at)
                    model = ridge(total[sub], alpha)
                    held = [p for fold, p in sorted((f, p) for f, p in parts.items() if f is not None)]
                    scores = [held_out_r2(p[sub], ridge((total - p)[sub], alpha)) for p in held]
                    scores = [s for s in scores if s is not None]
                    rows.append({**{k: row[k] for k in by}, "choice": name, "n": int(total[0, 0]), "folds": len(held),
                                 "r2_mean": float(np.mean(scores)) if scores else None, "r2_std": float(np.std(scores)) if scores else None,
                                 "intercept": float(model[0]), "coefficients": model[1:].tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([*((f.name, kinds[f.dataType.simpleString()]) for f in grams.schema.fields if f.name in by),
                        ("choice", pa.string()), ("n", pa.int64()), ("folds", pa.int32()), ("r2_mean", pa.float64()), ("r2_std", pa.float64()),
                        ("intercept", pa.float64()), ("coefficients", pa.list_(pa.float64()))])
    # One row per fold of a group: a handful.
    grouped = grams.groupBy(*by).agg(F.collect_list(F.struct("fold", "gram")).alias("parts"))
    return grouped.mapInArrow(solve, f"{ddl}, {fields}" if ddl else fields)


def weights_of(models: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """(by, feature, coefficient, importance): importances are absolute coefficients of standardised features, as shares."""
    total = F.aggregate("coefficients", F.lit(0.0), lambda s, c: s + F.abs(c))
    pairs = F.arrays_zip(F.array(*map(F.lit, features)).alias("feature"), F.col("coefficients").alias("coefficient"))
    long = models.select(*by, total.alias("_t"), F.inline(pairs).alias("feature", "coefficient"))
    return long.select(*by, "feature", "coefficient", F.coalesce(F.try_divide(F.abs("coefficient"), F.col("_t")), F.lit(0.0)).alias("importance"))


def per_fold(df: DataFrame, features: list[str], models: dict[int, np.ndarray]) -> Column:
    """Intercept and weighted features of the model that did not see the row's ``fold``."""
    order = range(max(models) + 1)

    def weight(i: int) -> Column:
        return F.get(F.lit([float(models[m][i]) if m in models else 0.0 for m in order]), F.col("fold"))

    return sum((F.col(f) * weight(i + 1) for i, f in enumerate(features)), weight(0))


def ridge_by_fold(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> dict[int, np.ndarray]:
    """The model without each fold, by fold, and the one of all rows under ``ALL_ROWS``."""
    size = len(features) + 2
    parts = {r.fold: unpacked(r.gram, size) for r in gram(df, features, target, ["fold"]).collect()}  # one row per fold
    total = sum(parts.values())
    return {ALL_ROWS: ridge(total, alpha)} | {fold: ridge(total - g, alpha) for fold, g in parts.items()}


def linear_out_of_fold(df: DataFrame, features: list[str], target: str = "final_score", alpha: float = 1.0) -> DataFrame:
    """``prediction`` of every row by the linear model of the other folds (``alpha`` 0: no penalty)."""
    return df.withColumn("prediction", per_fold(df, features, ridge_by_fold(df, features, target, alpha)))


# --- logistic models ---------------------------------------------------------------------------


def class_weights(counts: dict[tuple[int, int], int], without: int) -> list[float]:
    """n / (2 * class size) of both classes over all folds but one; a missing class weighs nothing."""
    sizes = [sum(n for (fold, y), n in counts.items() if y == label and fold != without) for label in (0, 1)]
    return [sum(sizes) / (2 * s) if s else 0.0 for s in sizes]


def newton_sums(df: DataFrame, features: list[str], label: str, models: dict[int, np.ndarray], weights: dict[int, list[float]]) -> dict[int, np.ndarray]:
    """The upper triangle of the Hessian and the gradient of each model, without penalty, over the rows outside its fold."""
    names = list(models)
    p = len(features) + 1
    # Literal arrays are passed by reference, so all steps share one generated plan.
    given = df.select("fold", F.col(label).cast("int").alias("_y"), *features, F.posexplode(F.lit([[float(v) for v in models[m]] for m in names])).alias("_at", "_w"))
    given = given.withColumn("_m", F.get(F.lit(names), F.col("_at"))).where("_m <> fold")
    z = [F.lit(1.0), *(F.col(f) for f in features)]
    eta = sum((z[i] * F.get("_w", F.lit(i)) for i in range(1, p)), F.get("_w", F.lit(0)))
    balance = F.get(F.get(F.lit([weights[m] for m in names]), F.col("_at")), F.col("_y"))
    rows = given.withColumn("_p", 1 / (1 + F.exp(-eta))).withColumn("_c", balance)
    rows = rows.withColumn("_v", F.col("_c") * F.col("_p") * (1 - F.col("_p"))).withColumn("_r", F.col("_c") * (F.col("_y") - F.col("_p")))
    sums = [F.sum(F.col("_v") * z[i] * z[j]) for i in range(p) for j in range(i, p)] + [F.sum(F.col("_r") * z[i]) for i in range(p)]
    wide = rows.groupBy("_m").agg(*(s.alias(f"_s{i}") for i, s in enumerate(sums)))
    return {r[0]: np.array(r[1:], float) for r in wide.collect()}  # one row per model


def logistic_by_fold(df: DataFrame, features: list[str], label: str = "failed", c: float = 1.0, steps: int = 25, tolerance: float = 1e-11, whole: bool = True) -> dict[int, np.ndarray]:
    """(intercept, coefficients) of the balanced logistic model without each fold, and with ``whole`` of all rows under ``ALL_ROWS``.

    Newton's method on c * Σ w loss + |coefficients|² / 2, with weights that balance the classes of each model's own rows. All models
    share each scan. Without one of the classes a model has no coefficients and an intercept of ±40.
    """
    counts = {(r.fold, r.y): r.n for r in df.groupBy("fold", F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    folds = [ALL_ROWS][:whole] + sorted({fold for fold, _ in counts})
    weights = {m: class_weights(counts, m) for m in folds}
    p = len(features) + 1
    done = {m: np.concatenate([[40.0 if w[1] else -40.0], np.zeros(p - 1)]) for m, w in weights.items() if 0.0 in w}
    models = {m: np.zeros(p) for m in folds if m not in done}
    penalty = np.diag([0.0] + [1.0 / c] * (p - 1))
    for _ in range(steps):
        if not models:
            break
        sums = newton_sums(df, features, label, models, weights)
        moved = 0.0
        for m, s in sums.items():
            hessian, gradient = unpacked(s[:-p], p) + penalty, s[-p:] - penalty @ models[m]
            step = np.linalg.solve(hessian, gradient)
            models[m] = models[m] + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return done | models


def logistic_out_of_fold(df: DataFrame, features: list[str], label: str = "failed", c: float = 1.0) -> DataFrame:
    """``probability`` (ten digits) and ``prediction`` of every row by the model of the other folds."""
    score = per_fold(df, features, logistic_by_fold(df, features, label, c, whole=False))
    out = df.withColumn("probability", F.round(1 / (1 + F.exp(-score)), 10))
    return out.withColumn("prediction", (F.col("probability") > 0.5).cast("double"))
