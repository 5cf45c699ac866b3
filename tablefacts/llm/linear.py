"""Logistic regression on a bounded sample, and the sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
MOST_LABELLED = 20_000


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from. Rows without an id have no label."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_labels(labels: DataFrame, name: str, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, label) of at most ``most`` labelled rows outside the held-out third, in the
    order of a hash of the id. An id with two labels counts as labelled if either is 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(most)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, the intercept last. ``y`` may be
    probabilities. Features are scaled inside; weights come back for the plain features."""
    if not len(y):
        return np.zeros(x.shape[1] + 1)
    weight = np.ones(len(y)) if weight is None else weight
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / spread, np.ones(len(y))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        slope = z.T @ (weight * (p - y)) + penalty @ w
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    plain = w[:-1] / spread
    return np.append(plain, w[-1] - plain @ mean)


def linear(features: Column, weights: np.ndarray) -> Column:
    """Weights times an array of features, and the intercept."""
    total = F.lit(float(weights[-1]))
    for k, w in enumerate(weights[:-1]):
        total = total + F.lit(float(w)) * features[k]
    return total


def probability(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit))))
