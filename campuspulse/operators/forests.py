"""Regression forests whose trees grow until their nodes are pure, as Spark jobs over rows and trees.

A histogram of every feature for each open node is small beside the node's rows near the root; far down, where a node holds a few rows, it is
thousands of times larger than they are, and there are as many nodes as rows. So the levels near the root are grown from histograms, until a
node holds ``NODE_ROWS`` rows. From there the rows of each open node of each tree meet in one group, which grows the rest of that tree below
the node and sends the held-out rows down.

Up to ``TRAINER_ROWS`` rows Spark's trainer grows the levels near the root, as many as even splits need. Above that, splits are uneven enough to
leave nodes far too large at any such depth. There one job per level sums the histograms of the large nodes of all folds and trees, and only
nodes that are still large go on to the next level.

Rows of equal features stay together in every tree. So a task adds up those it holds before it sends them, and a node that many of them share,
such as the students without any activity, needs no further levels near the root.

Each tree draws Poisson weights for its rows, anew below the levels of Spark's trainer, which does not tell the weights it drew. Cut points
in the groups are up to 255 quantiles of each feature; near the root they are put together to as many bins as the estimator allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campuspulse.operators.trees import Tree, drawn, poisson_table, reached, seed_tree, tried_features, with_children
from campuspulse.session import materialise

NODE_ROWS = 4_000
TRAINER_ROWS = 50_000
BLOCK_ROWS = 50_000
PART_BYTES = 1 << 25
CUTS = 255
NONE = 1e-12


# --- features as bytes ------------------------------------------------------------------


def cut_points(df: DataFrame, width: int) -> list[np.ndarray]:
    """Ascending cut points of each entry of ``x``, each from a group of its own; one row of quantiles per entry reaches the driver."""
    at = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    long = df.select(F.posexplode("x").alias("j", "v"))
    found = {r.j: r.q for r in long.groupBy("j").agg(F.percentile_approx("v", at, 10_000).alias("q")).collect()}
    return [np.unique(np.array(found.get(j) or [], float)) for j in range(width)]


def _coder(cuts: list[np.ndarray]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(len(batch), -1)
            codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)
            body = pa.array([row.tobytes() for row in codes], pa.binary())
            # Rows of equal features carry the number of the first of them in the batch.
            _, first, kind = np.unique(np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel(), return_index=True, return_inverse=True)
            alike = batch["_row"].take(pa.array(first[kind.ravel()]))
            yield pa.RecordBatch.from_arrays([batch["_row"], body, alike], names=["_row", "code", "alike"])

    return emit


# --- the part of a tree below a node ---------------------------------------------------------


def _chosen(nodes: int, width: int, subset: int, rng: np.random.Generator, wanted: np.ndarray) -> np.ndarray:
    """(subset, wanted nodes): the features each node tries. Every node draws, so that a node's features do not depend on which others are open."""
    drawn = rng.random((nodes, width))[wanted]
    if subset >= width:
        return np.argsort(drawn, axis=1).T
    some = np.argpartition(drawn, subset - 1, axis=1)[:, :subset]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(drawn, some, axis=1), axis=1), axis=1).T


def _by_node_and_code(node: np.ndarray, code: np.ndarray, nodes: int) -> np.ndarray:
    """The order of the rows by node and then code, for each line of ``code``; short keys are sorted by digits and not by comparison."""
    if nodes <= 256:
        return np.argsort((node << 8).astype(np.uint16) | code, axis=1, kind="stable")
    first = np.argsort(code, axis=1, kind="stable")
    again = np.argsort((node.astype(np.uint16) if nodes <= 65536 else node)[first], axis=1, kind="stable")
    return np.take_along_axis(first, again, axis=1)


def _best_splits(x: np.ndarray, wy: np.ndarray, w: np.ndarray, node: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, cut) of the best split of each node; a node without two codes gains minus infinity.

    Each line below stands for one tried feature. A node's rows fill the same places of every line, whatever the feature.
    """
    at, nodes = np.arange(len(x)), tried.shape[1]
    code = x[at, tried[:, node]]
    order = _by_node_and_code(node, code, nodes)
    code = np.take_along_axis(code, order, axis=1)
    size = np.bincount(node, minlength=nodes)
    end = np.cumsum(size)
    place = np.repeat(np.arange(nodes), size)
    start = end - size

    def left(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = np.cumsum(v[order], axis=1)
        before = np.concatenate([np.zeros((len(upto), 1)), upto[:, end[:-1] - 1]], axis=1)
        return upto - before[:, place], np.bincount(node, v, nodes)

    (w_left, weight), (y_left, total) = left(w), left(wy)
    inside = np.zeros(code.shape, bool)
    inside[:, :-1] = code[:, 1:] != code[:, :-1]
    inside[:, end - 1] = False
    w_right = np.where(inside, weight[place] - w_left, 1.0)
    gain = y_left**2 / w_left + (total[place] - y_left) ** 2 / w_right
    gain = np.where(inside, gain - (total**2 / weight)[place], -np.inf)
    best = np.maximum.reduceat(gain, start, axis=1)
    line = best.argmax(axis=0)
    top = best[line, np.arange(nodes)]
    hit = np.flatnonzero(gain[line[place], at] == top[place])
    hit = hit[np.append(True, place[hit][1:] != place[hit][:-1])]
    return top, tried[line, np.arange(nodes)], code[line, hit].astype(np.int64)


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, depth: int, subset: int, rng: np.random.Generator,
          inner: np.ndarray | None = None) -> np.ndarray:
    """The values of the rows ``held`` by a tree grown on rows ``x`` of weight ``w``, all nodes of a level at once.

    A node tries ``subset`` features and splits where the squared error falls most; it ends when none lowers it. A row may stand for several
    of equal features, with their mean ``y`` and ``inner``, their squared error about it.
    """
    out, centre = np.zeros(len(held)), np.average(y, weights=w)
    inner = np.zeros(len(x)) if inner is None else inner
    y, node, below, where, nodes = y - centre, np.zeros(len(x), np.int64), np.zeros(len(held), np.int64), np.arange(len(held)), 1
    for level in range(depth + 1):
        weight, total = np.bincount(node, w, nodes), np.bincount(node, w * y, nodes)
        rest = np.bincount(node, w * y * y + inner, nodes) - total**2 / weight
        split, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        wanted = np.flatnonzero(rest > 1e-9)
        if level < depth and len(wanted):
            number = np.full(nodes, -1)
            number[wanted] = np.arange(len(wanted))
            live = number[node] >= 0
            x, y, w, inner, node = x[live], y[live], w[live], inner[live], node[live]
            gain, feature, code = _best_splits(x, w * y, w, number[node], _chosen(nodes, x.shape[1], subset, rng, wanted))
            better = gain > 1e-9 * rest[wanted]
            split[wanted[better]], cut[wanted[better]] = feature[better], code[better]
        done = split[below] < 0
        out[where[done]] = (total / weight)[below[done]] + centre
        where, below = where[~done], below[~done]
        if not len(where):
            break
        child = 2 * (np.cumsum(split >= 0) - 1)
        live = split[node] >= 0
        x, y, w, inner, node = x[live], y[live], w[live], inner[live], node[live]
        node = child[node] + (x[np.arange(len(x)), split[node]] > cut[node])
        below = child[below] + (held[where, split[below]] > cut[below])
        nodes = int(2 * (split >= 0).sum())
    return out


# --- levels near the root of large tables -------------------------------------------------------


def bins_of_codes(cuts: list[np.ndarray], bins: int) -> np.ndarray:
    """(feature, code): the bin of each code. Features of more codes than bins share them out evenly."""
    code = np.arange(CUTS + 1)
    return np.stack([code * bins // (len(c) + 1) if len(c) >= bins else code for c in cuts]).astype(np.uint8)


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows; rows of equal features share a number, and their codes are held once, by feature."""
    def block(parts: list[tuple]) -> pa.RecordBatch:
        row, fold, y, alike, code = (np.concatenate(p) for p in zip(*parts))
        alike, first, kind = np.unique(alike, return_index=True, return_inverse=True)
        columns = {"row": row, "fold": fold, "y": y, "kind": kind.ravel().astype(np.int32), "alike": alike, "code": np.ascontiguousarray(code[first].T)}
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in columns.values()], names=list(columns))

    parts, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(batch), -1)
        parts.append((*(batch[c].to_numpy() for c in ("_row", "fold", "y", "alike")), code))
        size += len(batch)
        if size >= BLOCK_ROWS:
            yield block(parts)
            parts, size = [], 0
    if parts:
        yield block(parts)


_BLOCK = "row binary, fold binary, y binary, kind binary, alike binary, code binary"


def _unpacked(block, bins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, fold, y, kind of each row; number of its first row, codes and bins of each kind, both by feature) of a block."""
    row, alike = (np.frombuffer(block[c], np.int64) for c in ("row", "alike"))
    code = np.frombuffer(block["code"], np.uint8).reshape(-1, len(alike))
    return (row, np.frombuffer(block["fold"], np.int32), np.frombuffer(block["y"], np.float64), np.frombuffer(block["kind"], np.int32), alike, code,
            np.stack([own[c] for own, c in zip(bins, code)]))


def _small(v: np.ndarray) -> np.ndarray:
    most = v.max(initial=0)
    return v.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int64)


def _level_sums(shared, seed: int, each: int, subset: int, bins: int, level: int, k: int):
    """(tree, sums): draws, drawn targets and kinds of the live nodes by tried feature and bin, and their drawn squares, over the blocks of a task."""
    def run(part):
        trees, live, bin_of = shared.value
        blocks, table = [_unpacked(b, bin_of) for b in part], poisson_table()
        for m in range(k):
            own = []
            for row, fold, y, kind, _, _, code in blocks:
                use = np.flatnonzero(fold != m)
                own.append((row[use], y[use], kind[use], code))
            for key in range(m * each, (m + 1) * each):
                if key not in live:
                    continue
                nodes, tree = live[key], trees[key]
                number = np.full(len(tree[0]), -1)
                number[nodes] = np.arange(len(nodes))
                size = len(nodes) * bins
                sums, squares = np.zeros((3, subset, size)), np.zeros(len(nodes))
                for row, y, kind, code in own:
                    n = code.shape[1]
                    tried = tried_features(seed, key, level, len(nodes), len(code), subset)
                    at = number[reached(code, tree, level, np.arange(n))]
                    use = np.flatnonzero(at[kind] >= 0)
                    often, of, target = drawn(row[use], seed, key, table).astype(float), kind[use], y[use]
                    w, wy, wyy = (np.bincount(of, v, n) for v in (often, often * target, often * target * target))
                    rows = np.flatnonzero(w)
                    at, w, wy = at[rows], w[rows], wy[rows]
                    squares += np.bincount(at, wyy[rows], len(nodes))
                    place, flat = at * bins, code.ravel()
                    for j in range(subset):
                        here = place + flat[tried[j][at] * n + rows]
                        for total, v in zip(sums, (w, wy, None)):
                            total[j] += np.bincount(here, v, size)
                yield key, (_small(sums[0]), sums[1], _small(sums[2]), squares)

    return run


def level_splits(w: np.ndarray, wy: np.ndarray, kinds: np.ndarray, squares: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, ...]:
    """(feature or -1, cut, (draws, drawn targets, kinds) by side, whether all targets are equal) of each node from sums (tried, nodes, bins).

    The split is the one that lowers the squared error most.
    """
    nodes = w.shape[1]
    left = np.stack([v.cumsum(axis=2).astype(float) for v in (w, wy, kinds)])
    whole = left[:, 0, :, -1]
    left = left[..., :-1]
    weight, total, _ = whole[..., None]
    w_left, y_left, _ = left
    both = (w_left > 0) & (w_left < weight)
    gain = np.where(both, y_left**2 / np.where(both, w_left, 1.0) + (total - y_left) ** 2 / np.where(both, weight - w_left, 1.0) - total**2 / weight, -np.inf)
    gain = gain.transpose(1, 0, 2).reshape(nodes, -1)
    best, at = gain.argmax(axis=1), np.arange(nodes)
    line, cut = best // left.shape[3], best % left.shape[3]
    rest = squares - (total**2 / weight)[:, 0]
    pure = rest <= NONE * squares
    good = ~pure & (gain[at, best] > np.maximum(1e-9 * rest, NONE * squares))
    one = left[:, line, at, cut]
    return np.where(good, tried[line, at], -1), cut, np.stack([one, whole - one]).transpose(2, 0, 1), pure


def _level_best(seed: int, subset: int, bins: int, level: int, width: int):
    def run(part):
        found: dict[int, list[np.ndarray]] = {}
        for key, sums in part:
            if key in found:
                for mine, more in zip(found[key], sums):
                    mine += more
            else:
                found[key] = [v.astype(float) for v in sums]
        for key, (*sums, squares) in found.items():
            nodes = len(squares)
            tried = tried_features(seed, key, level, nodes, width, subset)
            yield key, *level_splits(*(v.reshape(subset, nodes, bins) for v in sums), squares, tried)

    return run


def near_root(blocks: DataFrame, estimator: RandomForestRegressor, bin_of: np.ndarray, subset: int, k: int) -> tuple[dict[int, Tree], dict[tuple[int, int], tuple], int]:
    """(trees, ends, levels): the trees of all folds down to nodes of at most ``NODE_ROWS`` kinds; one job per level for all of them.

    A node that gains by none of the features it tried tries others on the next level.
    """
    context, seed, each, deepest, bins = blocks.sparkSession.sparkContext, estimator.getSeed(), estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMaxBins()
    trees = {key: seed_tree(0.0) for key in range(k * each)}
    live = {key: np.zeros(1, np.int64) for key in trees}
    is_open, depth = ({key: np.full(1, v) for key in trees} for v in (True, 0))
    data, level = blocks.rdd.persist(StorageLevel.MEMORY_AND_DISK), 0
    while live and level < deepest:
        shared = context.broadcast((trees, live, bin_of))
        tasks = max(1, min(len(live), context.defaultParallelism * 4))
        found = data.mapPartitions(_level_sums(shared, seed, each, subset, bins, level, k)).partitionBy(tasks).mapPartitions(
            _level_best(seed, subset, bins, level, len(bin_of))).collect()
        shared.unpersist()
        following = {}
        for key, feature, cut, sides, pure in found:
            nodes, good = live[key], feature >= 0
            w, wy, kinds = sides[good].transpose(2, 0, 1)
            if level == 0:
                trees[key][3][0] = sides[0, :, 1].sum() / sides[0, :, 0].sum()
            trees[key], child = with_children(trees[key], nodes[good], feature[good], cut[good], wy / w)
            is_open[key][nodes[pure]] = False
            is_open[key] = np.append(is_open[key], np.full(child.size, True))
            depth[key] = np.append(depth[key], np.full(child.size, level + 1))
            large = np.concatenate([child[kinds > NODE_ROWS], nodes[~good & ~pure]])
            if len(large):
                following[key] = large
        live, level = following, level + 1
    data.unpersist()
    return trees, {divmod(key, each): (is_open[key], tree[3], depth[key]) for key, tree in trees.items()}, level


# --- the rows of open nodes -------------------------------------------------------------------


_PART = "model int, tree int, leaf int, level int, value double, first long, n long, code binary, w binary, wy binary, wyy binary, held_code binary, held binary"


def _cut_up(leaf: np.ndarray) -> dict[int, np.ndarray]:
    """The places of each leaf."""
    order = np.argsort(leaf, kind="stable")
    names, start = np.unique(leaf[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, start[1:])))


def _by_trainer(k: int):
    """(row, fold, y, kind of each row; first row and codes of each kind, its leaf by fold and tree) of a batch that carries the trainer's leaves."""
    def opened(batch: pa.RecordBatch):
        if not len(batch):
            return
        row, fold, y, alike = (batch[c].to_numpy() for c in ("_row", "fold", "y", "alike"))
        alike, first, kind = np.unique(alike, return_index=True, return_inverse=True)
        code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(batch), -1)
        leaf = [batch[f"_leaf{m}"].flatten().to_numpy().reshape(len(batch), -1)[first] for m in range(k)]
        yield row, fold, y, kind, alike, code[first], lambda m, t: leaf[m][:, t]

    return opened


def _by_level(shared):
    """The same of blocks and the trees of ``near_root``."""
    def opened(batch: pa.RecordBatch):
        trees, bin_of, each, levels = shared.value
        for block in batch.to_pylist():
            row, fold, y, kind, alike, code, binned = _unpacked(block, bin_of)
            at = np.arange(len(alike))
            yield row, fold, y, kind, alike, np.ascontiguousarray(code.T), lambda m, t: reached(binned, trees[m * each + t], levels, at)

    return opened


def _parts(opened, shared, k: int, seed: int):
    """Per open node and batch: codes, draws and sums of its training rows, kinds of equal rows as one, and codes and numbers of its held-out kinds."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (ends, trees) = poisson_table(), shared.value
        for row, fold, y, kind, alike, code, leaf_of in (part for batch in batches for part in opened(batch)):
            out, size = [], 0
            for m in range(k):
                train, all_held = np.flatnonzero(fold != m), np.unique(kind[fold == m])
                for t in range(trees):
                    (is_open, value, level), leaf = ends[m, t], leaf_of(m, t)
                    often = drawn(row[train], seed, m * trees + t, table).astype(float)
                    at, target = kind[train], y[train]
                    w, wy, wyy = (np.bincount(at, v, len(alike)) for v in (often, often * target, often * target * target))
                    use = np.flatnonzero((w > 0) & is_open[leaf])
                    held = all_held[is_open[leaf[all_held]]]
                    learnt, asked = _cut_up(leaf[use]), _cut_up(leaf[held])
                    for name in sorted(learnt.keys() | asked.keys()):
                        mine = use[learnt.get(name, [])] if name in learnt else use[:0]
                        theirs = held[asked[name]] if name in asked else held[:0]
                        out.append((m, t, name, int(level[name]), float(value[name]), int(row.min()), len(mine) + len(theirs), code[mine].tobytes(), w[mine].tobytes(),
                                    wy[mine].tobytes(), wyy[mine].tobytes(), code[theirs].tobytes(), alike[theirs].tobytes()))
                    size += len(use) * (code.shape[1] + 24) + len(held) * (code.shape[1] + 8)
                    if out and (t == trees - 1 or size > PART_BYTES):
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind_) for c, kind_ in zip(zip(*out), _KINDS)], names=_NAMES)
                        out, size = [], 0

    return emit


_NAMES = [field.split()[0] for field in _PART.split(", ")]
_KINDS = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[field.split()[1]] for field in _PART.split(", ")]


def _ended(opened, shared, k: int):
    """(fold, alike, total, n) of held-out kinds over the trees whose leaf ended near the root."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, trees = shared.value
        for _, fold, _, kind, alike, _, leaf_of in (part for batch in batches for part in opened(batch)):
            for m in range(k):
                held = np.unique(kind[fold == m])
                total, n = np.zeros(len(held)), np.zeros(len(held), np.int64)
                for t in range(trees):
                    (is_open, value, _), leaf = ends[m, t], leaf_of(m, t)[held]
                    done = ~is_open[leaf]
                    total, n = total + np.where(done, value[leaf], 0.0), n + done
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), m, np.int32)), pa.array(alike[held]), pa.array(total), pa.array(n)], names=["fold", "alike", "total", "n"])

    return emit


def _finish(deepest: int, subset: int, seed: int, width: int):
    def values(part: pa.Table) -> pa.Table:
        part = part.sort_by("first")
        code, w, wy, wyy, held, alike = (
            np.frombuffer(b"".join(part[c].to_pylist()), kind)
            for c, kind in (("code", np.uint8), ("w", float), ("wy", float), ("wyy", float), ("held_code", np.uint8), ("held", np.int64)))
        model, tree, leaf, level = (part[c][0].as_py() for c in ("model", "tree", "leaf", "level"))
        value = np.full(len(alike), part["value"][0].as_py())
        if len(w) and len(alike):
            # Kinds of one code can no longer be told apart.
            _, first, at = np.unique(code.reshape(-1, width).view(f"V{width}").ravel(), return_index=True, return_inverse=True)
            w, wy, wyy = (np.bincount(at.ravel(), v) for v in (w, wy, wyy))
            value = grown(code.reshape(-1, width)[first], wy / w, w, held.reshape(-1, width), deepest - level, subset,
                          np.random.default_rng([seed, model, tree, leaf]), np.maximum(wyy - wy**2 / w, 0.0))
        return pa.table({"fold": pa.array(np.full(len(alike), model, np.int32)), "alike": alike, "total": value, "n": np.ones(len(alike), np.int64)})

    return values


# --- the forest -------------------------------------------------------------------------------


def leaves(model: RandomForestRegressionModel, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(open, value, level) of the leaves of each tree; those at full depth are open: the trainer stopped there and not for want of a gain."""
    found = []
    for tree in model.trees:
        lines = [s for s in tree.toDebugString.splitlines() if s.lstrip().startswith("Predict:")]
        is_open = np.array([len(s) - len(s.lstrip()) - 2 >= depth for s in lines])
        found.append((is_open, np.array([float(s.split(":")[1]) for s in lines]), np.full(len(lines), depth)))
    return found


def forest_out_of_fold(df: DataFrame, estimator: RandomForestRegressor, fit_together, k: int = 5) -> DataFrame:
    """Each row with the ``prediction`` of the forest of the other folds; all folds and trees grow side by side.

    Groups hold about ``NODE_ROWS`` kinds, rows of equal features in one batch counted once; under Spark's trainer up to eight times that.
    """
    spark, target, deepest, seed = df.sparkSession, estimator.getLabelCol(), estimator.getMaxDepth(), estimator.getSeed()
    context, trees = spark.sparkContext, estimator.getNumTrees()
    ready = materialise(df.withColumn("_row", F.monotonically_increasing_id()))
    rows = ready.where("fold is not null").select("_row", "fold", F.col(target).cast("double").alias("y"), "features", vector_to_array("features").alias("x"))
    first = rows.first()
    if first is None:
        return ready.withColumn("prediction", F.lit(None).cast("double")).drop("features", "_row").limit(0)
    width = len(first.x)
    n, unknown = rows.agg(F.count("*"), F.count_if(F.col("y").isNull() | F.isnan("y"))).first()
    if unknown:
        raise ValueError(f"{target} is null or NaN in {unknown} rows")
    subset = max(1, math.ceil(width / 3))
    cuts = cut_points(rows, width)
    codes = rows.select("_row", "x").mapInArrow(_coder(cuts), "_row long, code binary, alike long")
    # Rows of equal features are sent to one task, a small share of all.
    tasks = max(n // 5_000 + 1, context.defaultParallelism)
    coded = materialise(rows.drop("x").join(codes, "_row").repartition(tasks, "alike"))
    if n <= TRAINER_ROWS and coded.where("_row = alike").count() <= 8 * NODE_ROWS:
        fitted = coded.coalesce(max(1, min(n // 50_000 + 1, context.defaultParallelism * 4)))
        depth = min(deepest, max(0, math.ceil(math.log2(max(n, 1) / NODE_ROWS))))
        top = estimator.copy().setMaxDepth(depth).setLabelCol("y").setLeafCol("_leaf")
        models = fit_together(spark, [lambda i=i: top.fit(fitted.where(F.col("fold") != i)) for i in range(k)])
        ends = {(i, t): leaf for i, m in enumerate(models) for t, leaf in enumerate(leaves(m, depth))}
        places = coded
        for i, m in enumerate(models):
            places = m.transform(places).withColumn(f"_leaf{i}", vector_to_array("_leaf").cast("array<int>")).drop("_leaf", "prediction")
        places, opened = places.drop("features"), _by_trainer(k)
    else:
        packed = coded.select("_row", F.col("fold").cast("int").alias("fold"), "y", "alike", "code").coalesce(max(1, min(n // 10_000 + 1, context.defaultParallelism * 2)))
        places = materialise(packed.mapInArrow(_packer, _BLOCK))
        bin_of = bins_of_codes(cuts, estimator.getMaxBins())
        grown_trees, ends, levels = near_root(places, estimator, bin_of, subset, k)
        opened = _by_level(context.broadcast((grown_trees, bin_of, trees, levels)))
    shared = context.broadcast((ends, trees))
    parts = places.mapInArrow(_parts(opened, shared, k, seed), _PART)
    low = parts.groupBy("model", "tree", "leaf").applyInArrow(_finish(deepest, subset, seed, width), "fold int, alike long, total double, n long")
    high = places.mapInArrow(_ended(opened, shared, k), "fold int, alike long, total double, n long")
    means = low.unionByName(high).groupBy("fold", "alike").agg((F.sum("total") / F.sum("n")).alias("prediction"))
    found = coded.join(means, ["fold", "alike"]).select("_row", "prediction")
    return ready.join(found, "_row").drop("features", "_row")
