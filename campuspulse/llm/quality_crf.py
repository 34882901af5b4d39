"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. Its features describe the line and its two neighbours (capitals, signs,
digits, repeated words); transitions tie neighbouring labels. Forward-backward gives each line's
probability of being good, and a document's score is their mean, weighted by line length.

Only documents are labelled, so in training each line carries its document's label. The model is fitted on at most
``TRAIN_DOCS`` labelled documents, those of the smallest id hashes, whole ones only and at most ``TRAIN_LINES`` lines together, which bounds
what the driver gets; scoring covers all lines of all documents. Messages are computed as products of
2 x 2 matrices by parallel prefixes: the first line's matrix has equal rows, which starts a new chain.

Edge cases: null text is empty, one empty line, and gets a score like any other. Lines weigh their bytes plus one. Rows of labels
without an id or quality are ignored; an id labelled several times counts with its highest label. With no labelled rows, or one
class only, the score is that class's share (0.5 without rows). Repeated rows are scored each; an empty table gives an empty result;
extra columns are ignored. Labels, language, source and id are no features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from campuspulse.llm.common import ids_and_text, table, text_of
from campuspulse.llm.textbytes import slices, span_hashes, spans

TRAIN_DOCS = 3_000
TRAIN_LINES = 200_000
ROUNDS = 200
L2 = 1e-4
THRESHOLD = 0.3
SIGNS = "#$%&*|!<>=~^@\\/_+[]{}"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[[ord(c) for c in chars]] = 1
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _table("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC3:] = 1  # lead bytes of characters outside ASCII
_DIGIT = _table("0123456789")
_SIGN = _table(SIGNS)
_OWN = ("one", "upper", "signs", "digits", "again", "repeated", "words", "length", "empty", "much_upper", "many_signs", "much_repeated")
_NEAR = ("upper", "signs", "again", "repeated")
FEATURES = (*_OWN, *(f"before_{n}" for n in _NEAR), *(f"after_{n}" for n in _NEAR), "first", "last")


# --- lines and features -------------------------------------------------------------------


def lines(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of all lines; a text has one more line than line ends."""
    breaks = np.flatnonzero(raw == 10)
    start = np.concatenate([offs[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, breaks, "right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    end = offs[1:][owner]
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    end[inner] = start[inner + 1] - 1
    return start, end, owner


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x features, text number, line bytes)"""
    start, end, owner = lines(raw, offs)
    n = len(start)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[end] - total[start]).astype(float)

    capital = _UPPER[raw]
    # Capitals of the Latin-1 block: C3 80 … C3 9E.
    capital[:-1] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    size = np.maximum(1.0, end - start)
    word_start, word_end, _ = spans(raw, offs)
    line = np.searchsorted(start, word_start, "right") - 1
    words = np.bincount(line, minlength=n).astype(float)
    word = span_hashes(raw, word_start, word_end)
    same = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[1:][same], minlength=n) / np.maximum(1, words)
    order = np.lexsort((word, line))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=n)
    own = {
        "one": np.ones(n), "upper": count(capital) / np.maximum(1, count(_LETTER[raw])), "signs": count(_SIGN[raw]) / size,
        "digits": count(_DIGIT[raw]) / size, "again": again, "repeated": 1 - distinct / np.maximum(1, words) - (words == 0),
        "words": np.log1p(words) / 5, "length": np.minimum(3, size / np.maximum(1, words) / 10), "empty": (words == 0) * 1.0,
    }
    own |= {"much_upper": (own["upper"] > 0.25) * 1.0, "many_signs": (own["signs"] > 0.04) * 1.0, "much_repeated": (own["repeated"] > 0.45) * 1.0}
    first, last = np.append(True, owner[1:] != owner[:-1]), np.append(owner[1:] != owner[:-1], True)
    first, last = first[:n], last[:n]
    near = []
    for step, edge in ((1, first), (-1, last)):
        near += [np.where(edge, 0.0, np.roll(own[name], step)) for name in _NEAR]
    return np.column_stack([*(own[k] for k in _OWN), *near, first, last]).astype(np.float64), owner, end - start


# --- the chain ------------------------------------------------------------------------------


def _prefixes(m: np.ndarray) -> np.ndarray:
    """Products m[0] … m[i] of 2 x 2 matrices, each scaled to a largest entry of one."""
    out = m / m.max(axis=(1, 2), keepdims=True)
    step = 1
    while step < len(out):
        made = out[:-step] @ out[step:]
        out = np.concatenate([out[:step], made / made.max(axis=(1, 2), keepdims=True)])
        step *= 2
    return out


def forward_backward(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected pairs of labels per line, none at a first line); states are bad and good."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    local = np.exp(np.column_stack([-np.maximum(emission, 0), np.minimum(emission, 0)]))
    local = np.maximum(local, 1e-30)
    step = np.where(first[:, None, None], 1.0, np.exp(transition - transition.max())[None]) * local[:, None, :]
    alpha = _prefixes(step)[:, 0, :]
    # Backwards: beta[i] = m[i + 1] beta[i + 1]; a first line's matrix gives equal entries, which ends the chain before it.
    back = _prefixes(step[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1)
    beta = np.ones((n, 2))
    beta[:-1] = back[1:].sum(axis=2)
    both = alpha * beta
    good = both[:, 1] / both.sum(axis=1)
    pairs = np.zeros((n, 2, 2))
    pairs[1:] = alpha[:-1, :, None] * step[1:] * beta[1:, None, :]
    pairs[first] = 0
    total = pairs.sum(axis=(1, 2), keepdims=True)
    return good, np.divide(pairs, total, out=pairs, where=total > 0)


class Model:
    """Weights of a fitted field; ``constant`` replaces it where there was nothing to learn from."""

    def __init__(self, weights: np.ndarray, transition: np.ndarray, constant: float | None = None):
        self.weights, self.transition, self.constant = weights, transition, constant

    def line_scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        first = x[:, FEATURES.index("first")] > 0
        return forward_backward(np.clip(x @ self.weights, -60, 60), self.transition, first)[0]

    def text_scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        x, owner, size = features(raw, offs)
        weight = size + 1.0
        n = len(offs) - 1
        mean = np.bincount(owner, self.line_scores(x) * weight, n) / np.bincount(owner, weight, n)
        return np.clip(mean, 0, 1)


def fit_chains(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam steps on the exact gradient."""
    if not len(x) or label.min() == label.max():
        return Model(np.zeros(len(FEATURES)), np.zeros((2, 2)), float(label[0]) if len(x) else 0.5)
    y = label.astype(int)
    seen = np.zeros((len(x), 2, 2))
    inner = np.flatnonzero(~first)
    seen[inner, y[inner - 1], y[inner]] = 1
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        good, pairs = forward_backward(np.clip(x @ theta[:-4], -60, 60), theta[-4:].reshape(2, 2), first)
        grad = np.concatenate([x.T @ (y - good), (seen - pairs).sum(axis=0).ravel()]) / len(x) - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(theta[:-4], theta[-4:].reshape(2, 2))


# --- on tables --------------------------------------------------------------------------------


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, raw, offs in slices(batch["text"]):
            x, owner, _ = features(raw, offs)
            labels = batch["quality"].take(pa.array(owner + a))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(owner + a)), pa.array(np.arange(len(x)), pa.int64()), labels, pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))],
                names=["doc_id", "line", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> Model:
    """Fit on the labelled documents that are not held out; ``limit`` and ``max_lines`` bound the sample of whole documents."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    wanted = wanted.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` rows of two numbers: small enough to broadcast at any size of input.
    sample = ids_and_text(docs).join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "quality")
    sizes = sample.groupBy("doc_id").agg(F.sum(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"))) + 1).alias("n")).withColumn("h", F.xxhash64("doc_id"))
    kept, total = [], 0
    for r in sorted(sizes.collect(), key=lambda r: (r.h, r.doc_id)):  # at most ``limit`` rows
        if total + r.n <= max_lines:
            kept.append(r.doc_id)
            total += r.n
    sample = sample.where(F.col("doc_id").isin(kept)) if kept else sample.limit(0)
    found = sample.mapInArrow(_training_lines, "doc_id long, line long, quality int, x array<float>").toArrow()
    if not found.num_rows:
        return fit_chains(np.zeros((0, len(FEATURES))), np.zeros(0, bool), np.zeros(0))
    x = found["x"].combine_chunks().values.to_numpy().reshape(-1, len(FEATURES)).astype(float)
    return fit_chains(x, x[:, FEATURES.index("first")] > 0, found["quality"].to_numpy())


def scored(model: Model, text: Column) -> Column:
    """The quality score of a text."""

    @arrow_udf(from_arrow_type(pa.float64()))
    def score_texts(texts: pa.Array) -> pa.Array:
        parts = [model.text_scores(raw, offs) for _, _, raw, offs in slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score_texts(text)


def line_quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, good): each document with the probability of being good of each of its lines."""

    @arrow_udf(from_arrow_type(pa.list_(pa.float64())))
    def score_lines(texts: pa.Array) -> pa.Array:
        parts = []
        for _, _, raw, offs in slices(texts):
            x, owner, _ = features(raw, offs)
            edges = np.searchsorted(owner, np.arange(len(offs))).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(model.line_scores(x))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return ids_and_text(docs).select("doc_id", score_lines("text").alias("good"))


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    rows = ids_and_text(docs).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), scored(model, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_bad(docs: DataFrame, model: Model) -> DataFrame:
    """The documents scored ``THRESHOLD`` or more, with all their columns, filtered where they are."""
    return docs.where(scored(model, text_of()) >= THRESHOLD)


def op2_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
