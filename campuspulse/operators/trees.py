"""Tree classifiers and boosted regressors of all folds at once, grown level by level from histograms.

Spark's trainer walks rows one at a time, for each fold and tree apart. Here rows are kept as blocks of feature codes, and one job per level
sums the histograms of the open nodes of all folds and trees over all blocks. The rules are those of Spark's trainer: cut points, impurity,
class weights, least rows of a node, Poisson weights and tried features of a forest, loss and steps of boosting.

What reaches the driver has the size of the models: per level, the sums of the open nodes of boosting, the chosen splits of a forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campuspulse.session import materialise

ROWS_PER_TASK = 10_000
BLOCK_ROWS = 50_000
EXACT_ROWS = 10_000
TRAINER_ROWS = 10_000
ROUNDS_KEPT = 25
DRIVER_BYTES = 1 << 25
NONE = 1e-12

Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # feature, cut, left child, value of each node


# --- features as codes -----------------------------------------------------------------------


def stride_cuts(value: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Cut points at even strides of weight, halfway between neighbouring values, as Spark's trainer places them."""
    found, at = np.unique(value, return_inverse=True)
    size = np.bincount(at, weight)
    middle = (found[1:] + found[:-1]) / 2
    if len(middle) < bins:
        return middle
    stride = size.sum() / bins
    cuts, upto, target = [], size[0], stride
    for i in range(1, len(found)):
        before, upto = upto, upto + size[i]
        if abs(before - target) < abs(upto - target):
            cuts.append(middle[i - 1])
            target += stride
    return np.array(cuts)


def cut_points(rows: DataFrame, n: int, width: int, k: int, bins: int) -> list[list[np.ndarray]]:
    """Ascending cut points of each feature for the model without each fold, from all of its rows.

    Few rows are cut as Spark's trainer does; where that would draw a sample of them, quantiles of all rows take its place, and one row
    of them reaches the driver.
    """
    if n <= EXACT_ROWS:
        table = rows.select("fold", "w", "x").toArrow().combine_chunks()
        fold, w, x = table["fold"].to_numpy(), table["w"].to_numpy(), table["x"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        used = [fold != m for m in range(k)]
        return [[stride_cuts(x[u, j], w[u], min(bins, max(1, int(u.sum())))) for j in range(width)] for u in used]
    at = [(i + 1) / bins for i in range(bins - 1)]
    columns = [F.percentile_approx(F.when(F.col("fold") != m, F.col("x")[j]), at, 10_000).alias(f"q{m}_{j}") for m in range(k) for j in range(width)]
    row = rows.agg(*columns).first()
    return [[np.unique(np.array(row[f"q{m}_{j}"] or [], float)) for j in range(width)] for m in range(k)]


def _packer(cuts: list[list[np.ndarray]]):
    def block(parts: list[tuple]) -> pa.RecordBatch:
        row, fold, y, w, x = (np.concatenate(p) for p in zip(*parts))
        code = np.stack([[np.searchsorted(c, x[:, j], "left") for j, c in enumerate(own)] for own in cuts]).astype(np.uint8)
        columns = {"row": row, "fold": fold, "y": y, "w": w, "code": code}
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in columns.values()], names=list(columns))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            parts.append((*(batch[c].to_numpy() for c in ("_row", "fold", "y", "w")), batch["x"].flatten().to_numpy().reshape(len(batch), -1)))
            size += len(batch)
            if size >= BLOCK_ROWS:
                yield block(parts)
                parts, size = [], 0
        if parts:
            yield block(parts)

    return emit


def opened(block, k: int, kind: type = np.int32) -> tuple[np.ndarray, ...]:
    """(row, fold, y, w, codes by model and feature) of a block whose targets are of ``kind``."""
    row = np.frombuffer(block["row"], np.int64)
    return (row, np.frombuffer(block["fold"], np.int32), np.frombuffer(block["y"], kind), np.frombuffer(block["w"], np.float64),
            np.frombuffer(block["code"], np.uint8).reshape(k, -1, len(row)))


def reached(code: np.ndarray, tree: Tree, levels: int, rows: np.ndarray) -> np.ndarray:
    """The node where each of ``rows`` stands after ``levels`` steps; a leaf leads to itself."""
    feature, cut, left, _ = tree
    flat, n = code.ravel(), code.shape[1]
    node = np.zeros(len(rows), np.int64)
    for _ in range(levels):
        node = left[node] + (flat[feature[node] * n + rows] > cut[node])
    return node


def seed_tree(value: float) -> Tree:
    return np.zeros(1, np.int64), np.full(1, 255), np.zeros(1, np.int64), np.array([value])


def with_children(tree: Tree, node: np.ndarray, feature: np.ndarray, cut: np.ndarray, values: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree with two more nodes below each ``node``, of ``values`` (nodes, 2), and their numbers (nodes, 2)."""
    have = len(tree[0])
    child = have + np.arange(2 * len(node)).reshape(-1, 2)
    f, c, at, v = (np.concatenate([old, new]) for old, new in zip(tree, seed_rows(child.ravel(), values.ravel())))
    f[node], c[node], at[node] = feature, cut, child[:, 0]
    return (f, c, at, v), child


def seed_rows(number: np.ndarray, value: np.ndarray) -> Tree:
    return np.zeros(len(number), np.int64), np.full(len(number), 255), number, value


# --- boosting -----------------------------------------------------------------------------------


def _boosting_parts(k: int, squared: bool):
    """The training rows of each model of a block, with a margin of zero; classes become -1 and 1."""
    def parts(block):
        _, fold, y, w, code = opened(block, k, np.float64 if squared else np.int32)
        s = y if squared else 2.0 * y - 1.0
        for m in range(k):
            use = fold != m
            yield m, code[m][:, use], s[use], w[use], np.zeros(int(use.sum()))

    return parts


def _advanced(trees: dict[int, Tree], rate: float, depth: int):
    def step(part):
        m, code, s, w, margin = part
        return m, code, s, w, margin + rate * trees[m][3][reached(code, trees[m], depth, np.arange(len(s)))]

    return step


def _level_sums(trees: dict[int, Tree], asked: dict[int, list[int]], level: int, first: bool, bins: int, squared: bool):
    """(model, sums): weights and weighted targets of the asked nodes by feature and code, over the parts of a task.

    The first tree fits the targets, the others the falling gradient of the squared error or the logistic loss.
    """
    def run(parts):
        sums: dict[int, np.ndarray] = {}
        for m, code, s, w, margin in parts:
            if not asked[m]:
                continue
            if first:
                t = s
            elif squared:
                t = 2 * (s - margin)
            else:
                with np.errstate(over="ignore"):
                    t = 4 * s / (1 + np.exp(2 * s * margin))
            number = np.full(len(trees[m][0]), -1)
            number[asked[m]] = np.arange(len(asked[m]))
            at = number[reached(code, trees[m], level, np.arange(len(s)))]
            use = np.flatnonzero(at >= 0)
            at, code, w, t = at[use] * bins, code[:, use], w[use], (w * t)[use]
            size = len(asked[m]) * bins
            own = np.array([[np.bincount(at + c, v, size) for c in code] for v in (w, t)])
            sums[m] = sums[m] + own if m in sums else own
        yield from sums.items()

    return run


def best_cut(h: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """(feature, cut, values of both sides, their weights) of the split that lowers the squared error most; None if none does."""
    weight, total = h[0][0].sum(), h[1][0].sum()
    w, y = h[0].cumsum(axis=1)[:, :-1], h[1].cumsum(axis=1)[:, :-1]
    both = (w > 1e-9 * weight) & (weight - w > 1e-9 * weight)
    if not both.any():
        return None
    left, right = np.where(both, w, 1.0), np.where(both, weight - w, 1.0)
    gain = np.where(both, y**2 / left + (total - y) ** 2 / right - total**2 / weight, -np.inf)
    f, c = np.unravel_index(gain.argmax(), gain.shape)
    if gain[f, c] <= NONE * total**2 / weight:
        return None
    return int(f), int(c), np.array([[y[f, c] / w[f, c], (total - y[f, c]) / (weight - w[f, c])], [w[f, c], weight - w[f, c]]])


def _added(sums: RDD, k: int, size: int) -> dict[int, np.ndarray]:
    """The sums of each model over all tasks, of ``size`` bytes a task. The driver adds them up itself where all are few: that saves a shuffle on each level."""
    if size * sums.getNumPartitions() > DRIVER_BYTES:
        return dict(sums.reduceByKey(np.add, k).collect())
    total: dict[int, np.ndarray] = {}
    for m, own in sums.collect():
        total[m] = total[m] + own if m in total else own
    return total


def _boosted_trees(state: RDD, k: int, width: int, depth: int, first: bool, bins: int, squared: bool) -> dict[int, Tree]:
    """The next tree of every model. Sums are taken for the lighter child of a node; the other child has the rest of its parent's."""
    trees = {m: seed_tree(0.0) for m in range(k)}
    asked, derived, held = {m: [0] for m in range(k)}, {m: [] for m in range(k)}, {}
    for level in range(depth):
        sums = _added(state.mapPartitions(_level_sums(trees, asked, level, first, bins, squared)), k, 16 * bins * width * sum(map(len, asked.values())))
        new_asked, new_derived, new_held = {m: [] for m in range(k)}, {m: [] for m in range(k)}, {}
        for m, own in sums.items():
            h = {node: own[:, :, i * bins:(i + 1) * bins] for i, node in enumerate(asked[m])}
            h |= {node: held[m, parent] - h[other] for node, parent, other in derived[m]}
            if level == 0:
                trees[m][3][0] = h[0][1][0].sum() / h[0][0][0].sum()
            cuts = {node: found for node in sorted(h) if (found := best_cut(h[node]))}
            if not cuts:
                continue
            node = np.array(list(cuts))
            trees[m], child = with_children(
                trees[m], node, *(np.array([c[i] for c in cuts.values()]) for i in (0, 1)), np.array([c[2][0] for c in cuts.values()]))
            for parent, (a, b), (_, _, (_, w)) in zip(cuts, child.tolist(), cuts.values()):
                small, large = (a, b) if w[0] <= w[1] else (b, a)
                new_asked[m].append(small)
                new_derived[m].append((large, parent, small))
                new_held[m, parent] = h[parent]
        asked, derived, held = new_asked, new_derived, new_held
        if not any(asked.values()):
            break
    return trees


def _boosted(blocks: DataFrame, estimator: GBTClassifier | GBTRegressor, k: int, width: int, bins: int) -> list[list[tuple[float, Tree]]]:
    """The steps of each model. Margins are kept from round to round; their lineage is cut every ``ROUNDS_KEPT`` rounds."""
    depth, rounds, squared = estimator.getMaxDepth(), estimator.getMaxIter(), isinstance(estimator, GBTRegressor)
    steps: list[list[tuple[float, Tree]]] = [[] for _ in range(k)]
    state, old = blocks.rdd.flatMap(_boosting_parts(k, squared)).persist(StorageLevel.MEMORY_AND_DISK), None
    for r in range(rounds):
        trees = _boosted_trees(state, k, width, depth, r == 0, bins, squared)
        if old is not None:
            old.unpersist()
        rate = estimator.getStepSize() if r else 1.0
        for m in range(k):
            steps[m].append((rate, trees[m]))
        old, state = state, state.map(_advanced(trees, rate, depth)).persist(StorageLevel.MEMORY_AND_DISK)
        if r % ROUNDS_KEPT == ROUNDS_KEPT - 1 and r + 1 < rounds:
            state.checkpoint()
    for kept in (old, state):
        kept.unpersist()
    return steps


# --- forests --------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def poisson_table(most: int = 12) -> np.ndarray:
    """Poisson(1) by 16 uniform bits."""
    upto = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(most)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def drawn(row: np.ndarray, seed: int, key: int, table: np.ndarray) -> np.ndarray:
    """How often a tree draws each row: a function of seed, tree and row, the same on every level."""
    start = mix(np.array([seed], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key + 1))
    return table[mix(row.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + start) >> np.uint64(48)]


def tried_features(seed: int, key: int, level: int, nodes: int, width: int, subset: int) -> np.ndarray:
    return np.argsort(np.random.default_rng([seed & 0xFFFFFFFF, key, level]).random((nodes, width)), axis=1)[:, :subset].T


def _forest_sums(shared, seed: int, trees_each: int, subset: int, bins: int, level: int, k: int):
    """(tree, counts): draws of the open nodes by tried feature, code and class, over the blocks of a task."""
    def run(part):
        trees, live = shared.value
        blocks, table = [opened(b, k) for b in part], poisson_table()
        for m in range(k):
            own = []
            for row, fold, y, _, code in blocks:
                use = np.flatnonzero(fold != m)
                own.append((row[use], y[use].astype(np.int64), np.ascontiguousarray(code[m][:, use])))
            for key in range(m * trees_each, (m + 1) * trees_each):
                if key not in live:
                    continue
                nodes, tree = live[key], trees[key]
                number = np.full(len(tree[0]), -1)
                number[nodes] = np.arange(len(nodes))
                counts = np.zeros((subset, len(nodes) * bins * 2))
                for row, y, code in own:
                    tried = tried_features(seed, key, level, len(nodes), len(code), subset)
                    often = drawn(row, seed, key, table)
                    rows = np.flatnonzero(often)
                    at = number[reached(code, tree, level, rows)]
                    if level:
                        inside = np.flatnonzero(at >= 0)
                        rows, at = rows[inside], at[inside]
                    often, place, flat, n = often[rows].astype(float), at * bins * 2 + y[rows], code.ravel(), code.shape[1]
                    for j in range(subset):
                        counts[j] += np.bincount(place + 2 * flat[tried[j][at] * n + rows].astype(np.int64), often, counts.shape[1])
                most = counts.max(initial=0)
                yield key, counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64)

    return run


def forest_splits(counts: np.ndarray, tried: np.ndarray, weights: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, cut, draws by side and class) of each node from draws (tried, nodes, codes, classes): the split of least Gini impurity."""
    nodes = counts.shape[1]
    left = counts.cumsum(axis=2)
    whole = left[:, :, -1:]
    left, right = left[:, :, :-1], whole - left[:, :, :-1]

    def purity(c: np.ndarray) -> np.ndarray:
        c = c * weights
        return (c**2).sum(axis=-1) / np.maximum(c.sum(axis=-1), 1e-300)

    both = (left.sum(axis=-1) >= max(leaf, 1)) & (right.sum(axis=-1) >= max(leaf, 1))
    score = np.where(both, purity(left) + purity(right), -np.inf).transpose(1, 0, 2).reshape(nodes, -1)
    best, at = score.argmax(axis=1), np.arange(nodes)
    line, cut = best // left.shape[2], best % left.shape[2]
    good = score[at, best] > purity(whole[0, :, 0]) * (1 + NONE)
    return np.where(good, tried[line, at], -1), cut, np.stack([left[line, at, cut], right[line, at, cut]], axis=1)


def _forest_best(seed: int, subset: int, bins: int, level: int, width: int, weights: np.ndarray, leaf: int):
    def run(part):
        sums: dict[int, np.ndarray] = {}
        for key, counts in part:
            sums[key] = sums[key] + counts if key in sums else counts.astype(np.int64)
        for key, counts in sums.items():
            nodes = counts.shape[1] // (2 * bins)
            counts = counts.reshape(subset, nodes, bins, 2)
            tried = tried_features(seed, key, level, nodes, width, subset)
            yield key, counts[0].sum(axis=1), *forest_splits(counts, tried, weights, leaf)

    return run


def _forest(blocks: DataFrame, estimator: RandomForestClassifier, weights: np.ndarray, k: int, width: int, bins: int) -> list[list[tuple[float, Tree]]]:
    """The trees of each model; one job per level for all of them."""
    context, seed, trees_each, leaf = blocks.sparkSession.sparkContext, estimator.getSeed(), estimator.getNumTrees(), estimator.getMinInstancesPerNode()
    subset = width if trees_each == 1 else math.ceil(math.sqrt(width))
    trees = {key: seed_tree(0.0) for key in range(k * trees_each)}
    live = {key: np.zeros(1, np.int64) for key in trees}

    def share(c: np.ndarray) -> np.ndarray:
        c = c * weights
        return c[..., 1] / np.maximum(c.sum(axis=-1), 1e-300)

    data = blocks.rdd.persist(StorageLevel.MEMORY_AND_DISK)
    for level in range(max(1, estimator.getMaxDepth())):
        shared = context.broadcast((trees, live))
        tasks = max(1, min(len(live), context.defaultParallelism * 4))
        found = data.mapPartitions(_forest_sums(shared, seed, trees_each, subset, bins, level, k)).partitionBy(tasks).mapPartitions(
            _forest_best(seed, subset, bins, level, width, weights, leaf)).collect()
        shared.unpersist()
        following = {}
        for key, whole, feature, cut, sides in found:
            if level == 0:
                trees[key][3][0] = share(whole)[0]
            good = feature >= 0
            if not good.any() or estimator.getMaxDepth() == 0:
                continue
            sides = sides[good]
            trees[key], child = with_children(trees[key], live[key][good], feature[good], cut[good], share(sides))
            # A child of one class ends, and one that is too small for two.
            open_ = (sides.min(axis=-1) > 0) & (sides.sum(axis=-1) >= 2 * max(leaf, 1))
            if open_.any():
                following[key] = child[open_]
        live = following
        if not live:
            break
    data.unpersist()
    return [[(1.0 / trees_each, trees[key]) for key in range(m * trees_each, (m + 1) * trees_each)] for m in range(k)]


# --- predictions --------------------------------------------------------------------------------------


def _predicted(shared, k: int, depth: int, boosted: bool, squared: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for block in batch.to_pylist():
                row, fold, _, _, code = opened(block, k)
                for m in range(k):
                    held = np.flatnonzero(fold == m)
                    total = np.zeros(len(held))
                    for rate, tree in models[m]:
                        total += rate * tree[3][reached(code[m], tree, depth, held)]
                    if squared:
                        yield pa.RecordBatch.from_arrays([pa.array(row[held]), pa.array(total)], names=["_row", "prediction"])
                        continue
                    with np.errstate(over="ignore"):
                        p = 1 / (1 + np.exp(-2 * total)) if boosted else total
                    names = ["_row", "probability", "prediction"]
                    yield pa.RecordBatch.from_arrays([pa.array(row[held]), pa.array(p), pa.array((total > (0.0 if boosted else 0.5)).astype(float))], names=names)

    return emit


def class_weights(rows: DataFrame) -> np.ndarray | None:
    """The weight of each class, or None where rows of one class differ in weight."""
    found = {r.y: (r.low, r.high) for r in rows.groupBy("y").agg(F.min("w").alias("low"), F.max("w").alias("high")).collect()}
    if any(low != high for low, high in found.values()):
        return None
    return np.array([found.get(y, (1.0, 1.0))[0] for y in (0, 1)])


def fits(estimator) -> bool:
    """Whether the estimator is one whose rules are followed here: no sampling of its own, no validation, no limits on gain."""
    if not isinstance(estimator, GBTClassifier | GBTRegressor | RandomForestClassifier):
        return False
    same = estimator.getMaxBins() <= 256 and estimator.getMinInfoGain() == 0 and estimator.getMinWeightFractionPerNode() == 0 and estimator.getSubsamplingRate() == 1
    if isinstance(estimator, GBTRegressor) and estimator.getLossType() != "squared":
        return False
    if not isinstance(estimator, RandomForestClassifier):
        return same and estimator.getMinInstancesPerNode() == 1 and estimator.getFeatureSubsetStrategy() == "all" and not estimator.isSet("validationIndicatorCol")
    return same and estimator.getFeatureSubsetStrategy() == "auto" and estimator.getImpurity() == "gini" and estimator.getBootstrap()


def _numbered(df: DataFrame, estimator, kind: str) -> tuple[DataFrame, DataFrame]:
    """The frame with a number for each row, and what models read of its rows in folds."""
    ready = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    weight = F.col(estimator.getWeightCol()).cast("double") if estimator.isSet("weightCol") else F.lit(1.0)
    return ready, ready.where("fold is not null").select(
        "_row", F.col("fold").cast("int").alias("fold"), F.col(estimator.getLabelCol()).cast(kind).alias("y"), weight.alias("w"), vector_to_array("features").alias("x"))


def _blocks(rows: DataFrame, n: int, width: int, k: int, bins: int) -> DataFrame:
    cuts = cut_points(rows, n, width, k, bins)
    tasks = max(1, min(n // ROWS_PER_TASK + 1, rows.sparkSession.sparkContext.defaultParallelism * 4))
    return materialise(rows.repartition(tasks).mapInArrow(_packer(cuts), "row binary, fold binary, y binary, w binary, code binary"))


def classifier_out_of_fold(df: DataFrame, estimator, k: int = 5) -> DataFrame | None:
    """Each row with ``probability`` and ``prediction`` of the model of the other folds; None where a forest's weights are not those of classes."""
    spark, boosted = df.sparkSession, isinstance(estimator, GBTClassifier)
    ready, rows = _numbered(df, estimator, "int")
    weights = None if boosted else class_weights(rows)
    if not boosted and weights is None:
        return None
    first = rows.first()
    if first is None:
        return ready.withColumns({"probability": F.lit(None).cast("double"), "prediction": F.lit(None).cast("double")}).drop("features", "_row").limit(0)
    width, bins = len(first.x), estimator.getMaxBins()
    blocks = _blocks(rows, rows.count(), width, k, bins)
    models = _boosted(blocks, estimator, k, width, bins) if boosted else _forest(blocks, estimator, weights, k, width, bins)
    shared = spark.sparkContext.broadcast(models)
    held = blocks.mapInArrow(_predicted(shared, k, estimator.getMaxDepth(), boosted, False), "_row long, probability double, prediction double")
    return ready.join(held, "_row").drop("features", "_row")


def regressor_out_of_fold(df: DataFrame, estimator: GBTRegressor, k: int = 5) -> DataFrame | None:
    """Each row with the ``prediction`` of the boosted trees of the other folds; None where there are at most ``TRAINER_ROWS``.

    In the small nodes of few rows many splits gain the same, and rounding chooses between them; there Spark's trainer keeps its own choice.
    """
    y = F.col(estimator.getLabelCol()).cast("double")
    n, unknown = df.where("fold is not null").agg(F.count("*"), F.count_if(y.isNull() | F.isnan(y))).first()
    if n <= TRAINER_ROWS:
        return None
    if unknown:
        raise ValueError(f"{estimator.getLabelCol()} is null or NaN in {unknown} rows")
    ready, rows = _numbered(df, estimator, "double")
    width, bins = len(rows.first().x), estimator.getMaxBins()
    blocks = _blocks(rows, n, width, k, bins)
    shared = df.sparkSession.sparkContext.broadcast(_boosted(blocks, estimator, k, width, bins))
    held = blocks.mapInArrow(_predicted(shared, k, estimator.getMaxDepth(), True, True), "_row long, prediction double")
    return ready.join(held, "_row").drop("features", "_row")
