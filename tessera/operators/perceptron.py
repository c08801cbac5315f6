"""Multilayer perceptron regression by data-parallel full-batch steps (M9).

Spark holds the rows and evaluates loss and gradient: every partition adds up
its own, and the partitions' sums, one row of as many numbers as the network
has weights, are added in the order of the partitions.  The few thousand
weights and the search direction (limited-memory BFGS) stay on the driver and
are sent with every step.  Partitions follow from the rows alone
(``for_fitting``), so a fit gives the same weights on any cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of steps and gradient changes that the search direction is made of.
MEMORY = 10
SHRINK, ENOUGH, TRIES = 0.5, 1e-4, 20


def shapes_of(sizes: tuple[int, ...]) -> list[tuple[int, int]]:
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def layers_of(weights: np.ndarray, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, offsets) of each layer, as views of the flat weights."""
    out, at = [], 0
    for a, b in shapes_of(sizes):
        out.append((weights[at: at + a * b].reshape(a, b), weights[at + a * b: at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, layers) -> list[np.ndarray]:
    """The input and each layer's output; all but the last are rectified."""
    held = [x]
    for k, (w, b) in enumerate(layers):
        z = held[-1] @ w + b
        held.append(np.maximum(z, 0.0) if k + 1 < len(layers) else z)
    return held


def loss_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Gradient of half the squared error of some rows, then that loss and the rows."""
    layers = layers_of(weights, sizes)
    held = forward(x, layers)
    back = held[-1] - y[:, None]
    parts = []
    loss = 0.5 * float((back**2).sum())
    for k in range(len(layers) - 1, -1, -1):
        parts.append(np.concatenate([(held[k].T @ back).ravel(), back.sum(axis=0)]))
        if k:
            back = (back @ layers[k][0].T) * (held[k] > 0)
    return np.concatenate([*parts[::-1], [loss, len(y)]])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch], *, weights: np.ndarray, sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(part, features, label) to one row (part, sums) for the partition."""
    total, part = None, 0
    for batch in batches:
        if batch.num_rows:
            part = batch.column(0)[0].as_py()
            own = loss_gradient(_matrix(batch.column(1), sizes[0]), batch.column(2).to_numpy(zero_copy_only=False), weights, sizes)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part", "sums"])


@dataclass
class Perceptron:
    """Fitted weights, with the mean and spread of the labels they were scaled by; ``losses`` falls from step to step."""

    sizes: tuple[int, ...]
    weights: np.ndarray
    mean: float
    spread: float
    losses: list[float]

    def predict(self, features: Column) -> Column:
        """Prediction from an array of features; null where the array is null."""
        layers, mean, spread, width = layers_of(self.weights, self.sizes), self.mean, self.spread, self.sizes[0]

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            some = x.notna()
            out = pd.Series(np.nan, index=x.index)
            if some.any():
                out[some] = forward(np.stack(x[some].to_numpy()).reshape(-1, width), layers)[-1][:, 0] * spread + mean
            return out.astype(object).where(some, None)

        return run(features)


def _direction(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton direction from the last steps and gradient changes."""
    q, held = gradient.copy(), []
    for s, g in reversed(steps):
        a = (s @ q) / (s @ g)
        q -= a * g
        held.append(a)
    if steps:
        s, g = steps[-1]
        q *= (s @ g) / (g @ g)
    for (s, g), a in zip(steps, reversed(held), strict=True):
        q += s * (a - (g @ q) / (s @ g))
    return -q


def fit(data: DataFrame, features: str, label: str, *, hidden: tuple[int, ...] = (50, 25), steps: int = 60, decay: float = 1e-4,
        tolerance: float = 1e-5, seed: int = 42) -> Perceptron:
    """Fit on ``data`` (an array of features, a label), which should be dealt and
    persisted by ``for_fitting``: every step reads it once or a few times.

    ``decay`` weighs the squared weights, as in ridge regression.  The fit ends
    after ``steps`` steps, or when no step lowers the loss by ``tolerance`` of
    it.  Rows with a null label or null features take no part; without rows it
    raises ValueError.
    """
    rows = data.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    scale = rows.agg(F.avg(label).alias("mean"), F.stddev_pop(label).alias("spread"), F.max(F.size(features)).alias("width")).first()
    if scale["width"] is None:
        raise ValueError("no rows to fit on")
    mean, spread = float(scale["mean"]), float(scale["spread"]) or 1.0
    rows = rows.select(F.spark_partition_id().alias("part"), F.col(features).cast("array<double>").alias("x"), ((F.col(label) - mean) / spread).alias("y"))
    sizes = (int(scale["width"]), *hidden, 1)
    rng = np.random.default_rng(seed)
    weights = np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in shapes_of(sizes)])

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(partial(_sums, weights=w, sizes=sizes), "part int, sums array<double>").collect()  # one row a partition
        total = np.sum([np.array(r["sums"]) for r in sorted(parts, key=lambda r: r["part"])], axis=0)
        n = total[-1]
        return float((total[-2] + 0.5 * decay * (w @ w)) / n), (total[:-2] + decay * w) / n

    loss, gradient = evaluate(weights)
    losses, held = [loss], []
    for _ in range(steps):
        way = _direction(gradient, held)
        if way @ gradient >= 0:
            way, held = -gradient, []
        size = 1.0 if held else min(1.0, 1.0 / float(np.abs(gradient).sum() or 1.0))
        for _ in range(TRIES):
            new_loss, new_gradient = evaluate(weights + size * way)
            if new_loss <= loss + ENOUGH * size * float(way @ gradient):
                break
            size *= SHRINK
        else:
            break
        step, change = size * way, new_gradient - gradient
        if step @ change > 1e-12:
            held = [*held, (step, change)][-MEMORY:]
        weights, gradient = weights + step, new_gradient
        losses.append(new_loss)
        if loss - new_loss <= tolerance * abs(loss):
            break
        loss = new_loss
    return Perceptron(sizes, weights, mean, spread, losses)
