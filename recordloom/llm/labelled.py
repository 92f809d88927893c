"""A bounded sample of labelled documents that classifiers are fitted on, and calibration of their scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.snapshots import cut


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int, max_bytes: int, seed: int = 11) -> list[tuple[bytes, int]]:
    """Texts and labels of at most ``per_class`` documents of either class, of those that have a fitting text the first by a hash of their id.

    Only rows for which ``train`` holds are looked at; an id that labels name twice counts with its smaller label.
    Longer texts than ``max_bytes`` don't take part in fitting, so the sample has a proven size.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & train).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    order = F.xxhash64("doc_id", F.lit(seed))
    fit = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    # Only ids that have such a text are chosen from.
    there = cut(fit.select("doc_id").join(known, "doc_id").distinct(), "labelled")
    chosen = [there.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    texts = (
        fit.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # as many rows as asked for
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )
    rows = texts.orderBy(order, "doc_id").collect()
    out: list[tuple[bytes, int]] = []
    for y in (0, 1):
        out += [(r["text"].encode("utf-8", "replace"), y) for r in rows if r["y"] == y]
    return out


def logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method: columns of x, then the constant. A class that is missing gives a constant."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    if not len(x):
        return b
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = logistic(x @ b)
        grad = x.T @ (weight * (p - y)) + keep * b
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -5, 5)
    return np.clip(b, -60, 60)
