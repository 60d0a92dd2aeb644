"""Bounded samples of labelled rows, and small models fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, out: Column | None = None) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """At most per_class rows (doc_id, text, label) of each label 0 and 1, by the least hash of doc_id, and the count of each label.

    out: rows for which it is true are neither sampled nor counted. Rows with a null id or label are left out; an
    id with several labels takes the least. Ids are chosen from the label table first, so only the chosen texts move.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if out is not None:
        known = known.where(~out)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen: dict[int, int] = {}
    for y in (0, 1):
        for r in known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            chosen[r["doc_id"]] = y
    texts = texts_of(docs, list(chosen))
    return [(i, t, chosen[i]) for i, t in texts], counts


def texts_of(docs: DataFrame, ids: list[int]) -> list[tuple[int, str]]:
    """(doc_id, text) of the rows with these ids, one row per id, sorted by id."""
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")
    got: dict[int, str] = {}
    for r in found.collect():
        text = r["text"] or ""
        got[r["doc_id"]] = min(text, got.get(r["doc_id"], text))
    return sorted(got.items())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, offset) of a weighted logistic calibration, by Newton steps with a weak ridge."""
    x = np.stack([z, np.ones_like(z)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + 1e-3 * (w - [1.0, 0.0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give the sample the label shares of all labelled rows; mean 1."""
    n = np.array([max(1, counts.get(0, 1)), max(1, counts.get(1, 1))], float)
    got = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())], float)
    w = (n / got)[y]
    return w / w.mean()
