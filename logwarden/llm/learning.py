"""What the trained operators share: which labels may be learned from, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def labelled_sample(rows: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """``rows`` with their ``label`` as a column ``y``, for at most ``per_class`` learnable labels of each value.

    Labels are taken in the order of a hash of their id, so the sample is the same wherever it is drawn, and is sorted
    out before any text is touched; as its size is bounded, it is broadcast. ``weight`` is how many labels of its value
    a row stands for, so fits see the classes as frequent as they are. Labels other than 0 and 1, and null ids, are not
    learned from. An id with several labels has the larger one.
    """
    known = (labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id"), F.col("doc_id")
    parts = [known.filter(F.col("y") == y).orderBy(*order).limit(per_class)
             .select(F.col("doc_id").alias("labelled"), "y", F.lit(max(1.0, counts.get(y, 0) / per_class)).alias("weight")) for y in (0, 1)]
    return rows.join(F.broadcast(parts[0].unionByName(parts[1])), F.col("doc_id") == F.col("labelled")).drop("labelled")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 50) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method. ``ridge`` is the penalty on every one but the constant."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The threshold on ``p`` with the highest F1 for label 1."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((weight * y)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * y).sum())
    return float(p[order][int(np.argmax(f1))])
