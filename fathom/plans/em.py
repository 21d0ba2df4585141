"""Expectation-maximisation over classes: soft assignment of vectors (images) to references.

An iteration is one pass over the data: squared differences to the broadcast references (k x d numbers, a model),
weights by softmax, and weighted sums reduced in partitions before anything is shuffled. The driver holds the
model only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def weights(x: np.ndarray, refs: np.ndarray, share: np.ndarray, sigma2: float) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each class, log-likelihood) of each row."""
    d2 = (x * x).sum(1)[:, None] - 2 * x @ refs.T + (refs * refs).sum(1)[None]
    e = np.log(np.maximum(share, 1e-300))[None] - d2 / (2 * sigma2)
    top = e.max(1, keepdims=True)
    p = np.exp(np.where(e - top < -700, -np.inf, e - top))
    s = p.sum(1, keepdims=True)
    return p / s, (top + np.log(s))[:, 0] - 0.5 * x.shape[1] * np.log(2 * np.pi * sigma2)


def _sums(vector: str, model):
    def run(batches):
        refs, share, sigma2 = model
        k, d = refs.shape
        w, wx, rest, ll, n = np.zeros(k), np.zeros((k, d)), 0.0, 0.0, 0
        for b in batches:
            x = np.array(b.column(vector).drop_null().to_pylist(), float).reshape(-1, d)
            p, like = weights(x, refs, share, sigma2)
            w += p.sum(0)
            wx += p.T @ x
            rest += float((x * x).sum())
            ll += float(like.sum())
            n += len(x)
        total = np.concatenate((w, wx.ravel(), [rest, ll, n]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "sum"])

    return run


def classify(df: DataFrame, vector: str, k: int, iterations: int, seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """(references, log-likelihood before each iteration). Starts from k rows chosen by hash."""
    ship(df.sparkSession)
    start = df.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector, F.lit(seed))).limit(k).collect()
    refs = np.array([r[0] for r in start], float)
    share, sigma2, history = np.full(k, 1 / k), 1.0, []
    d = refs.shape[1]
    for _ in range(iterations):
        rows = df.select(vector).mapInArrow(_sums(vector, (refs, share, sigma2)), "at long, sum double")
        got = np.zeros(k + k * d + 3)
        for r in rows.groupBy("at").agg(F.sum("sum").alias("sum")).toLocalIterator():  # as many rows as the model has numbers
            got[r["at"]] = r["sum"]
        w, wx, (xx, ll, n) = got[:k], got[k:-3].reshape(k, d), got[-3:]
        history.append(float(ll))
        refs = np.where(w[:, None] > 1e-12, wx / np.maximum(w, 1e-12)[:, None], refs)
        share = w / w.sum()
        sigma2 = max((xx - float((w[:, None] * refs * refs).sum())) / (n * d), 1e-9)
    return refs, history
