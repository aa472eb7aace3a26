"""Follow-the-regularised-leader (proximal) for sparse linear models: per-coordinate rates, L1 and L2 penalties.

For each coordinate z holds the sum of adjusted gradients and n that of their squares; a weight is 0 while |z| <= l1, else
(sign(z) * l1 - z) / ((beta + sqrt(n)) / alpha + l2). Weights are worked out only for the coordinates of the row at hand.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Ftrl:
    """A model of `classes` score columns over `size` coordinates; one column is a logistic model, several a softmax."""

    def __init__(self, size: int, classes: int = 1, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One row: distinct coordinates, their values, and the target (0 or 1 for each class)."""
        w = self.weights(at)
        off = probabilities(x @ w) - y
        g = x[:, None] * off
        squares = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(squares) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = squares


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Of one score: the logistic function; of several: softmax over the last axis."""
    if scores.shape[-1] == 1:
        return 0.5 * (1 + np.tanh(scores / 2))
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bucket_of(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n; null for null."""
    return F.crc32(key.cast("string").cast("binary")) % n


def least_hashes(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of df where keys are distinct: those of least hash, alike for any order or partitioning."""
    h = F.xxhash64(F.col(key), F.lit("sample"))
    limit = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.filter(h <= F.lit(limit)) if limit is not None else df.limit(0)
