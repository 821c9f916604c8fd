"""Perceptrons for class labels, fitted by L-BFGS over rows that are packed once.

The network, its first weights and the steps are those of Spark's learner: sigmoid layers, softmax at the end, strong Wolfe steps, ten remembered.
Its loss is the plain mean over all rows, wherever they lie. A pass is one job: tasks add up loss and gradient of their rows with matrix
products over blocks of rows, and the driver gets as many numbers as the model has weights from each task. The outcome is Spark's model, so scoring and
saving stay as they are.

Rows travel in chunks, column by column, each column of a chunk in the smallest type that holds all its values exactly, and are kept by Spark between passes.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import batch_bytes, dealt_out, discard, materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-6  # of the first loss: less than that in 20 steps is no gain
HISTORY = 10  # steps that L-BFGS remembers
BLOCK = 1024  # rows of a matrix product
CHUNK_ROWS = 1 << 16  # rows packed together at most
CHUNK_CELLS = 1 << 21  # and values
BATCH_BYTES = 1 << 22  # of the chunks that go to a Python process at once, one chunk at least
_KINDS = [np.dtype(k) for k in (np.uint8, np.int16, np.float32, np.float64)]
_PACKED = "kinds binary, x binary, y binary"


# -- packed rows ------------------------------------------------------------------------


def _smallest(values: np.ndarray) -> int:
    """Place in _KINDS of the first type that holds these values exactly."""
    for i, kind in enumerate(_KINDS[:-1]):
        with np.errstate(all="ignore"):
            if np.array_equal(values.astype(kind).astype(np.float64), values):
                return i
    return len(_KINDS) - 1


def _packing(width: int, classes: int):
    """Chunks of rows (columns and, last, the label)."""
    most = max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(1, width)))

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        *columns, label = np.concatenate(parts, axis=1)
        if not np.isfinite(label).all() or (label != label.astype(np.uint8)).any() or (label >= classes).any():
            raise ValueError(f"labels must be whole numbers below {classes}, without missing ones")
        if any(np.isnan(c).any() for c in columns):
            raise ValueError("columns must be complete")
        kinds = [_smallest(c) for c in columns]
        x = b"".join(c.astype(_KINDS[k]).tobytes() for c, k in zip(columns, kinds, strict=True))
        y = label.astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (bytes(kinds), x, y)], ["kinds", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, most):
                some = batch.slice(i, most)
                # A missing value comes as NaN, which is refused.
                parts.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in some.columns]))
                rows += some.num_rows
                if rows >= most:
                    yield packed(parts)
                    parts, rows = [], 0
        if parts:
            yield packed(parts)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Values (rows, columns) and labels of every chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            kinds, x, y = (batch.column(j)[i].as_buffer() for j in range(3))
            y = np.frombuffer(y, np.uint8).astype(np.int64)
            kinds, at = np.frombuffer(kinds, np.uint8), 0
            values = np.empty((len(kinds), len(y)))
            for j, k in enumerate(kinds):
                values[j] = np.frombuffer(x, _KINDS[k], len(y), at)
                at += len(y) * _KINDS[k].itemsize
            yield values.T, y


# -- loss and gradient --------------------------------------------------------------------


def _parts(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (in, out) and offsets of every layer, as views, in the order of Spark's weights."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append((weights[at : at + n * m].reshape(n, m), weights[at + n * m : at + (n + 1) * m]))
        at += (n + 1) * m
    return out


def add_loss(weights: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray, total: np.ndarray) -> float:
    """Summed cross-entropy of rows; its gradient is added to ``total``."""
    parts, sums, loss = _parts(weights, layers), _parts(total, layers), 0.0
    with np.errstate(over="ignore"):
        for low in range(0, len(y), BLOCK):
            labels = y[low : low + BLOCK]
            rows = np.arange(len(labels))
            values = [x[low : low + BLOCK]]
            for w, b in parts:
                z = values[-1] @ w
                z += b
                if len(values) < len(parts):  # sigmoid
                    np.negative(z, out=z)
                    np.exp(z, out=z)
                    z += 1
                    np.reciprocal(z, out=z)
                values.append(z)
            z = values.pop()
            z -= z.max(axis=1, keepdims=True)
            share = np.exp(z)
            whole = share.sum(axis=1)
            loss += float((np.log(whole) - z[rows, labels]).sum())
            delta = share / whole[:, None]
            delta[rows, labels] -= 1
            for i in range(len(parts) - 1, -1, -1):
                sums[i][0][...] += values[i].T @ delta
                sums[i][1][...] += delta.sum(axis=0)
                if i:
                    delta = delta @ parts[i][0].T
                    delta *= values[i]
                    np.subtract(1, values[i], out=values[i])
                    delta *= values[i]
    return loss


def _task(weights: np.ndarray, layers: Sequence[int]):
    """A task's loss, rows and gradient."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, rows = np.zeros(len(weights)), 0.0, 0
        for x, y in _unpacked(batches):
            loss += add_loss(weights, layers, x, y, total)
            rows += len(y)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([rows], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["loss", "n", "g"])

    return run


def _asked(rows: DataFrame, layers: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and gradient at any weights, by one job."""

    def ask(weights: np.ndarray) -> tuple[float, np.ndarray]:
        found = rows.mapInArrow(_task(weights, layers), "loss double, n bigint, g binary").toArrow()  # a row a task
        total = np.zeros(len(weights))
        for g in found["g"]:
            total += np.frombuffer(g.as_buffer(), np.float64)
        many = max(1, sum(found["n"].to_pylist()))
        return sum(found["loss"].to_pylist()) / many, total / many

    return ask


# -- L-BFGS -----------------------------------------------------------------------------


class _Failed(Exception):
    """No step along this direction is good enough."""


def _between(l: tuple, r: tuple) -> float:
    """Least place of the cubic through two ends (place, loss, slope), kept off both ends."""
    with np.errstate(invalid="ignore", divide="ignore"):
        a = l[2] + r[2] - 3 * (l[1] - r[1]) / (l[0] - r[0])
        b = np.sqrt(a * a - l[2] * r[2])
        t = r[0] - (r[0] - l[0]) * (r[2] + b - a) / (r[2] - l[2] + 2 * b)
    wide = r[0] - l[0]
    if not np.isfinite(t):
        return l[0] + wide / 2
    return float(min(max(t, l[0] + 0.1 * wide), l[0] + 0.9 * wide))


def _step(along: Callable[[float], tuple], begin: tuple, first: float) -> float:
    """Length of a step that meets the strong Wolfe conditions; ``along(t)`` gives (t, loss, slope)."""
    _, loss, slope = begin
    if not slope < 0:
        raise _Failed

    def too_high(c: tuple) -> bool:
        return c[1] > loss + 1e-4 * c[0] * slope

    def flat(c: tuple) -> bool:
        return abs(c[2]) <= 0.9 * abs(slope)

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(10):
            c = along(_between(*sorted((low, high))))
            if too_high(c) or c[1] >= low[1]:
                high = c
                continue
            if flat(c):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise _Failed

    low, t = begin, first
    for i in range(10):
        c = along(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if too_high(c) or (i > 0 and c[1] >= low[1]):
            return zoom(low, c)
        if flat(c):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise _Failed


def _direction(gradient: np.ndarray, steps: deque) -> np.ndarray:
    d, kept = -gradient, []
    for s, y in reversed(steps):
        kept.append((s @ d) / (s @ y))
        d = d - kept[-1] * y
    if steps:
        s, y = steps[-1]
        d *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept)):
        d += (a - (y @ d) / (s @ y)) * s
    return d


def minimised(ask: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, most: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """The weights after at most so many steps, fewer where the last 20 gained next to nothing or no step helps any more."""
    x = np.array(start, float)
    if most <= 0:
        return x
    loss, g = ask(x)
    first, recent, steps, failed, done = loss, deque([np.inf], 20), deque(maxlen=HISTORY), False, 0
    while done < most and np.linalg.norm(g) > max(tolerance * loss, 1e-8):
        d, seen = _direction(g, steps), {}

        def along(t: float) -> tuple:
            seen[t] = ask(x + t * d)
            return t, seen[t][0], float(seen[t][1] @ d)

        try:
            t = _step(along, (0.0, loss, float(g @ d)), 1.0 / np.linalg.norm(d) if done == 0 else 1.0)
            if t * np.linalg.norm(g) < 1e-10:
                raise _Failed
        except _Failed:
            if failed or not steps:
                break
            failed = True
            steps.clear()
            continue
        failed = False
        new_loss, new_g = seen[t]
        if (t * d) @ (new_g - g) > 0:
            steps.append((t * d, new_g - g))
        x, loss, g, done = x + t * d, new_loss, new_g, done + 1
        recent.append(loss)
        if abs(loss - max(recent)) <= tolerance * first:
            break
    return x


# -- models -------------------------------------------------------------------------------


def _model(like: MultilayerPerceptronClassifier, data: DataFrame) -> MultilayerPerceptronClassificationModel:
    """Spark's model with the learner's first weights."""
    return like.copy({like.maxIter: 0}).fit(data)


def fit(learner: MultilayerPerceptronClassifier, train: DataFrame, columns: Sequence[str], rows: int) -> MultilayerPerceptronClassificationModel:
    """What the learner's settings ask for, fitted to so many rows; the columns must be complete numbers, the label a class number."""
    layers, label = list(learner.getLayers()), learner.getLabelCol()
    spark = train.sparkSession
    few = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], [learner.getFeaturesCol(), label])
    start = np.array(_model(learner, few).weights)
    names = [f"c{i}" for i in range(len(columns))]
    data = train.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)], F.col(label).cast("double").alias("y"))
    kept = materialise(dealt_out(data, rows).mapInArrow(_packing(len(columns), layers[-1]), _PACKED), "perceptron-rows")
    held = kept.persist()
    with batch_bytes(spark, BATCH_BYTES):
        weights = minimised(_asked(held, layers), start, learner.getMaxIter())
    held.unpersist()
    discard(kept)
    return _model(learner.copy({learner.initialWeights: Vectors.dense(weights)}), few)
