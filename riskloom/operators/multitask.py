"""Training on the multi-task score: one code per vector that tells the class, rebuilds the vector, and keeps the classes apart.

A vector x gets the code z = tanh(A x + a). The class probability is that of the logistic u z + c, the rebuilt vector is B z + b, and the third part is the
absolute cosine between the two classes' code sums. The loss is their weighted sum, the mean squared error divided by the rows of a batch, as in
``metrics.multitask_score``.

Every evaluation is one aggregate: tasks add up losses and gradients of their rows, Spark sums what the tasks found, and the driver gets as many numbers as the
model has parameters, times three at most. The cosine depends on all rows at once; its gradient is linear in two sums per class, so those are added up in
the same pass. Steps are those of L-BFGS on the driver. Several lengths of a step are evaluated by the same aggregate, and the one of least
loss is taken, so a step takes one pass over the rows; only where the cosine has weight may its kink at 0 ask for a second one, of shorter lengths.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (0.5, 0.5, 0.0)  # class loss, reconstruction, cosine
BATCH_ROWS = 500
HISTORY = 8  # steps that L-BFGS remembers
LENGTHS = (1.0, 0.4, 0.1, 0.01)  # of a step, evaluated at once


@dataclass(frozen=True)
class Shape:
    size: int  # elements of a vector
    code: int  # elements of a code

    def split(self, theta: np.ndarray) -> list[np.ndarray]:
        """A (code x size), a, u, c, B (size x code), b."""
        d, k = self.size, self.code
        parts = np.split(theta, np.cumsum([k * d, k, k, 1, d * k]))
        return [parts[0].reshape(k, d), parts[1], parts[2], parts[3], parts[4].reshape(d, k), parts[5]]

    def length(self) -> int:
        return 2 * self.size * self.code + 2 * self.code + 1 + self.size

    def start(self, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        theta = np.zeros(self.length())
        a, *_, b, _ = self.split(theta)  # views
        a[:] = rng.normal(0, 1 / np.sqrt(self.size), a.shape)
        b[:] = rng.normal(0, 1 / np.sqrt(self.code), b.shape)
        return theta


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def row_sums(theta: np.ndarray, shape: Shape, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums over rows: their number, class loss and squared error; both losses' gradients; per class the codes and what their gradients need."""
    A, a, u, c, B, b = shape.split(theta)
    z = np.tanh(x @ A.T + a)
    slope = 1 - z * z
    margin = z @ u + c
    class_loss = np.logaddexp(0, margin) - y * margin
    wrong = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y
    gap = z @ B.T + b - x
    by_class = (wrong[:, None] * u) * slope
    by_gap = 2 * (gap @ B) * slope
    out = [[len(x), class_loss.sum(), (gap * gap).sum()]]
    out += [(by_class.T @ x).ravel(), by_class.sum(axis=0), wrong @ z, [wrong.sum()]]
    out += [(by_gap.T @ x).ravel(), by_gap.sum(axis=0), 2 * (gap.T @ z).ravel(), 2 * gap.sum(axis=0)]
    for of in (y, 1 - y):
        out += [of @ z, ((slope * of[:, None]).T @ x).ravel(), of @ slope]
    return np.concatenate([np.asarray(part, np.float64) for part in out])


def _added(thetas: list[np.ndarray], shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x, y = _vectors(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                found = np.concatenate([row_sums(theta, shape, x, y) for theta in thetas])
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    return run


def losses_and_gradients(
    rows: DataFrame, thetas: list[np.ndarray], shape: Shape, weights=WEIGHTS, batch_rows: int = BATCH_ROWS
) -> list[tuple[float, dict, np.ndarray]]:
    """Loss over all rows (x, y), its three parts, and its gradient at each of some points, by one aggregate."""
    found = rows.mapInArrow(_added(thetas, shape), "place bigint, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    if not found.num_rows:
        raise ValueError("no rows to learn from")
    sums = np.empty(found.num_rows)
    sums[found["place"].to_numpy()] = found["value"].to_numpy()
    return [_combined(part, shape, weights, batch_rows) for part in np.split(sums, len(thetas))]


def _combined(sums: np.ndarray, shape: Shape, weights, batch_rows: int) -> tuple[float, dict, np.ndarray]:
    d, k = shape.size, shape.code
    widths = [3, k * d, k, k, 1, k * d, k, d * k, d, k, k * d, k, k, k * d, k]
    (n, class_loss, squares), cA, ca, cu, cc, gA, ga, gB, gb, s1, m1, e1, s0, m0, e0 = np.split(sums, np.cumsum(widths)[:-1])
    parts = {"log_loss": class_loss / n, "mse": squares / (n * d), "cosine": 0.0}
    w_class, w_gap, w_cosine = weights[0] / n, weights[1] / (n * d * batch_rows), weights[2]
    grad = np.zeros(shape.length())
    A, a, u, c, B, b = shape.split(grad)  # views
    A += (w_class * cA + w_gap * gA).reshape(k, d)
    a += w_class * ca + w_gap * ga
    u += w_class * cu
    c += w_class * cc
    B += w_gap * gB.reshape(d, k)
    b += w_gap * gb
    long1, long0 = np.linalg.norm(s1), np.linalg.norm(s0)
    if long1 > 0 and long0 > 0:
        cosine = s1 @ s0 / (long1 * long0)
        parts["cosine"] = abs(cosine)
        for mine, other, size, m, e in ((s1 / long1, s0 / long0, long1, m1, e1), (s0 / long0, s1 / long1, long0, m0, e0)):
            by_sum = np.sign(cosine) * (other - cosine * mine) / size
            A += w_cosine * by_sum[:, None] * m.reshape(k, d)
            a += w_cosine * by_sum * e
    loss = weights[0] * parts["log_loss"] + weights[1] * parts["mse"] / batch_rows + weights[2] * parts["cosine"]
    return float(loss), parts, grad


def _direction(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill by the curvature of the last steps (change of parameters, change of gradient)."""
    q, used = grad.copy(), []
    for s, t in reversed(steps):
        alpha = (s @ q) / (s @ t)
        q -= alpha * t
        used.append(alpha)
    if steps:
        s, t = steps[-1]
        q *= (s @ t) / (t @ t)
    for (s, t), alpha in zip(steps, reversed(used)):
        q += (alpha - (t @ q) / (s @ t)) * s
    return -q


@dataclass(frozen=True)
class MultiTask:
    """A trained model, the loss after every step (the first before any), and how many aggregates that took."""

    column: str
    shape: Shape
    theta: np.ndarray
    losses: list[float]
    aggregates: int

    def score(self, df: DataFrame, p: str = "p", rebuilt: str = "rebuilt", code: str = "code") -> DataFrame:
        """Add class probability, rebuilt vector and code."""
        A, a, u, c, B, b = self.shape.split(self.theta)

        @F.pandas_udf("p double, rebuilt array<double>, code array<double>")
        def applied(vectors: pd.Series) -> pd.DataFrame:
            x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.empty((0, A.shape[1]))
            z = np.tanh(x @ A.T + a)
            return pd.DataFrame({"p": 1 / (1 + np.exp(-(z @ u + c))), "rebuilt": list(z @ B.T + b), "code": list(z)})

        out = df.withColumn("__m", applied(F.col(self.column)))
        return out.select(*df.columns, F.col("__m.p").alias(p), F.col("__m.rebuilt").alias(rebuilt), F.col("__m.code").alias(code))


def fit(
    df: DataFrame,
    column: str,
    label: str,
    size: int,
    code: int = 32,
    weights: tuple[float, float, float] = WEIGHTS,
    batch_rows: int = BATCH_ROWS,
    steps: int = 50,
    tolerance: float = 1e-7,
    seed: int = 0,
) -> MultiTask:
    """Train on vectors of ``size`` complete numbers and a 0/1 label. Rows without either take no part; without any row there is nothing to learn.

    It ends after so many steps, or once a step no longer lowers the loss by a share of ``tolerance``.
    """
    shape = Shape(size, code)
    rows = df.select(F.col(column).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    rows = materialise(rows.filter(F.col("y").isNotNull() & (F.size("x") == size)), "vectors")
    theta = shape.start(seed)
    loss, _, grad = losses_and_gradients(rows, [theta], shape, weights, batch_rows)[0]
    losses, asked, known = [loss], 1, []
    while len(losses) <= steps:
        way = _direction(grad, known)
        if way @ grad >= 0:  # curvature misled
            known, way = [], -grad
        whole = 1.0 if known else min(1.0, 1 / max(np.abs(grad).sum(), 1e-300))
        for shorter in (1.0, 1e-3, 1e-6):
            tried = [theta + whole * shorter * length * way for length in LENGTHS]
            found = losses_and_gradients(rows, tried, shape, weights, batch_rows)
            asked += 1
            new, (new_loss, _, new_grad) = min(zip(tried, found), key=lambda t: t[1][0])
            if new_loss < loss:
                break
        if not new_loss < loss:
            break
        change, turn = new - theta, new_grad - grad
        if change @ turn > 1e-12 * (turn @ turn):
            known = [*known, (change, turn)][-HISTORY:]
        fell, theta, loss, grad = loss - new_loss, new, new_loss, new_grad
        losses.append(loss)
        if fell <= tolerance * abs(loss):
            break
    return MultiTask(column, shape, theta, losses, asked)
