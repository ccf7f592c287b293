"""Bounded labelled samples and probability calibration."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int, where: Column | None = None) -> pa.Table:
    """At most `rows` labelled texts of at most `max_chars` characters: doc_id, text, y, sorted by doc_id.

    Ids with the smallest crc32 are taken. A document with several labels counts with the largest, and of rows with one
    id the one with the least text counts, so that the sample is the same each time.
    docs has doc_id and text. The bound makes the broadcast and what reaches the driver of known size.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = chosen.orderBy(crc_of_id(), "doc_id").limit(rows)
    found = docs.where(F.length("text") <= max_chars).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
    return found.toArrow().sort_by("doc_id")


def calibration_rows(sample: pa.Table) -> np.ndarray:
    """Which rows of a labelled sample, about a fifth, serve calibration only; told by the id."""
    return np.array([zlib.crc32(b"calibrate %d" % d) % 5 == 0 for d in sample.column("doc_id").to_pylist()], bool)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows; x is dense."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, rounds + 1):
        err = sigmoid(x @ w.astype(x.dtype) + b) - y
        g = np.append(err.astype(x.dtype) @ x / max(1, len(y)) + l2 * w, err.mean() if len(y) else 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit_platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn raw scores into probabilities (Newton steps on smoothed targets)."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        s = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        h = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)
