"""Embedding whitening: unit variance and no correlation along the leading principal directions, found without a covariance matrix.

Entries become integers, ``floor(1024 * c) + 100000``, so counts and sums are exact. Then

1. every task adds up its vectors; the sums of all tasks are added as decimals,
2. every task reduces its centred rows, block by block, to a triangular factor R by QR; factors of tasks are stacked and reduced again,
   sixteen at a time, until one is left (its size is the number of dimensions),
3. ``bidiagonal`` takes singular values and right vectors from R,
4. every row is projected; the covariance of the results, merged from blocks that are centred before they are multiplied, must be the identity.

Rows are never moved: tasks send one row each. What later tasks get is one vector and ``k`` directions.

Edge cases: rows whose vector is null, or holds a null, a non-finite entry or one beyond ±2**42 (its integer has no exact double), are dropped. Of
vectors of several lengths those of the most frequent length stay (the greater one of a tie), empty ones never. Components without variance (a singular value of
rounding size) have no whitened values and are left out, as are components beyond the dimensions: one row, or equal rows only, give no result. Repeated rows and
null ids count like others. ``deviation`` is null beyond the range of a long. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campuspulse.llm.bidiagonal import EPS, right_singular
from campuspulse.llm.common import table, written

COMPONENTS = 8
FAN_IN = 16
ROWS = 4096
LARGEST = 2.0**42
LONG = 2**63


# --- vectors of a batch ----------------------------------------------------------------------


def integer_rows(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer entries) of the rows that count, one pair for each length."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64())
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    bad = ~(np.abs(values) <= LARGEST)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    wrong = np.concatenate([[0], np.cumsum(bad)])
    good = (lengths > 0) & (wrong[edges[1:]] == wrong[edges[:-1]])
    for d in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == d))
        for a in range(0, len(rows), ROWS):
            some = rows[a: a + ROWS]
            entries = values[edges[some][:, None] + np.arange(d)]
            yield some, np.floor(1024 * entries).astype(np.int64) + 100_000


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for rows, x in integer_rows(batch["embedding"]):
            n, sums = total.get(x.shape[1], (0, None))
            # By halves: the sum of many rows may pass 64 bits.
            low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
            part = [int(a) + (int(b) << 32) for a, b in zip(low, high)]
            total[x.shape[1]] = (n + len(rows), part if sums is None else [a + b for a, b in zip(sums, part)])
    for d, (n, sums) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int32()), pa.array([n], pa.int64()), pa.array([sums], pa.list_(pa.decimal128(38, 0)))], names=["d", "n", "sums"])


@dataclass
class Centre:
    """Dimensions, rows and exact sums. Rows centre as ``x - base`` (exact) less ``rest / n``, where ``sums = n * base + rest``."""

    d: int
    n: int
    sums: list[int]

    def __post_init__(self):
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Σ (n x - S)² of each row. Integers wrap at 64 bits, which is exact where the result fits a long."""
        y = x - self.base
        near = (y.astype(float) * self.n - self.rest) ** 2
        with np.errstate(over="ignore"):
            steps = y * np.int64(self.n) - self.rest
            out = (steps * steps).sum(axis=1).tolist()
        for i in np.flatnonzero(near.sum(axis=1) > LONG / 2).tolist():
            exact = sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(y[i], self.rest))
            out[i] = exact if exact < LONG else None
        return out


def centre_of(vectors: DataFrame) -> Centre | None:
    """Count and sums of the rows of the most frequent length; one number per dimension reaches the driver."""
    parts = written(vectors.mapInArrow(_sums, "d int, n long, sums array<decimal(38,0)>"), "vector-sums")
    best = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return None
    own = parts.where(F.col("d") == best.d).select(F.posexplode("sums").alias("i", "s"))
    sums = own.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return Centre(best.d, best.n, [int(r.s) for r in sums])


# --- one row per task, merged by fan-in ------------------------------------------------------------


def merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], label: str) -> bytes | None:
    """The payloads of (part, payload) merged sixteen at a time, each round a job; one row is left."""
    ddl = "part long, payload binary"

    def group(rows: pa.Table) -> pa.Table:
        order = rows.sort_by("part")
        return pa.table({"part": pa.array([order["part"][0].as_py() // FAN_IN], pa.int64()),
                         "payload": pa.array([merge(order["payload"].to_pylist())], pa.binary())})

    parts = written(parts, label)
    while True:
        size = parts.agg(F.count("*").alias("n"), F.max("part").alias("last")).first()
        if size.n <= 1:
            row = parts.first()
            return bytes(row.payload) if row else None
        parts = written(parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(group, ddl), label)


def _payload(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, float).tobytes()


def triangular_factor(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows."""
    d = centre.d

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for _, x in integer_rows(batch["embedding"]):
                if x.shape[1] == d:
                    r = np.linalg.qr(np.concatenate([r, centre.centred(x)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_payload(r)], pa.binary())], names=["part", "payload"])

    def merge(payloads: list[bytes]) -> bytes:
        return _payload(np.linalg.qr(np.concatenate([np.frombuffer(p).reshape(-1, d) for p in payloads]), mode="r"))

    r = np.frombuffer(merged(vectors.mapInArrow(reduce_rows, "part long, payload binary"), merge, "factors")).reshape(-1, d)
    return np.concatenate([r, np.zeros((max(0, d - len(r)), d))])


# --- the operator ------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """Centre, directions (rows), their variances and shares of the whole variance."""

    centre: Centre
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.directions / np.sqrt(self.variances)[:, None]).T


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows that count; None without any variance."""
    vectors = _vectors(rows)
    centre = centre_of(vectors)
    if centre is None:
        return None
    r = triangular_factor(vectors, centre)
    values, directions = right_singular(r, k)
    total = values.sum()
    # Singular values below this are rounding of the reduction, not variance.
    keep = np.sqrt(values[:k]) > 10 * centre.d * EPS * np.sqrt(values[0])
    if not keep.any():
        return None
    top = values[:k][keep]
    return Whitening(centre, directions[keep], top / centre.n, top / total)


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, deviation, whitened: one row per vector that counts, with one value per component."""
    ddl = "vec_id long, deviation long, whitened array<double>"
    if model is None:
        return rows.sparkSession.createDataFrame([], ddl)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integer_rows(batch["embedding"]):
                if x.shape[1] == model.centre.d:
                    values = model.project(x)
                    edges = np.arange(len(at) + 1, dtype=np.int32) * values.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [batch["vec_id"].take(pa.array(at)), pa.array(model.centre.deviations(x), pa.int64()),
                         pa.ListArray.from_arrays(pa.array(edges), pa.array(values.ravel()))], names=["vec_id", "deviation", "whitened"])

    return _vectors(rows).mapInArrow(project, ddl)


def identity_error(done: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` less the identity."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            w = batch["whitened"].flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            if len(w):
                mean = w.mean(axis=0)
                held.append(_payload(np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([merge(held)], pa.binary())], names=["part", "payload"])

    def merge(payloads: list[bytes]) -> bytes:
        n, mean, cross = 0.0, np.zeros(k), np.zeros((k, k))
        for p in payloads:
            a = np.frombuffer(p)
            gap, size = a[1: k + 1] - mean, n + a[0]
            cross = cross + a[k + 1:].reshape(k, k) + np.outer(gap, gap) * (n * a[0] / size)
            mean, n = mean + gap * (a[0] / size), size
        return _payload(np.concatenate([[n], mean, cross.ravel()]))

    a = np.frombuffer(merged(done.select("whitened").mapInArrow(moments, "part long, payload binary"), merge, "covariances"))
    return float(np.abs(a[k + 1:].reshape(k, k) / a[0] - np.eye(k)).max())


def components(rows: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: one row per vector and component."""
    model = fit(rows, k)
    done = whitened(rows, model)
    if model is None:
        size, error, shares = 0, 0.0, []
    else:
        done = written(done, "whitened")
        size, shares = model.centre.n, model.explained.tolist()
        error = identity_error(done, len(shares))
    share = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    long = done.select("vec_id", "deviation", F.posexplode("whitened").alias("__i", "whitened"))
    return long.select(
        "vec_id", (F.col("__i") + 1).alias("component"), F.lit(size).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("__i")).alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark, sf_dir):
    return components(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
