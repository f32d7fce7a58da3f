"""Bounded labelled samples and the small solvers of the trained operators. Models are fitted on the driver from such a
sample only; its size is a parameter, and every document is scored by tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import light

#: Most labelled documents that a model is fitted on.
SAMPLE = 12_000


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts).cast("int")


def held_out(parts: int, part: int, doc_id: str = "doc_id") -> Column:
    """A row without an id isn't held out, and isn't learned from either."""
    return F.coalesce(fold(doc_id, parts) == part, F.lit(False))


def hash_sample(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The `limit` rows whose hash of the keys is smallest.

    Rows far above the limit's share of all hashes are left out first, so that what the tasks send to be sorted is
    about twice the limit however many tasks there are.
    """
    rows, place = df.count(), F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    share = min(1.0, 2 * (limit + 100) / max(1, rows))
    return df.withColumn("_place", place).where(F.col("_place") <= int(share * (1 << 40))).orderBy("_place", *keys).limit(limit).drop("_place")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, use: Column, limit: int = SAMPLE) -> DataFrame:
    """doc_id, text and label of at most `limit` labelled documents, the first in the order of a hash of their ids."""
    chosen = labels.where(use & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("label"))
    chosen = hash_sample(chosen, limit, "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def with_score(docs: DataFrame, model, of: Callable[[object, pa.RecordBatch], list[float]]) -> DataFrame:
    """docs and score, a column of that name replaced; of() gets the model, which is broadcast, and a batch of rows."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of(shared.value, b), pa.float64())], names=[*b.schema.names, "score"])

    return docs.mapInArrow(light(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


class Rows:
    """A sparse matrix by rows: the columns at[begin[i]:begin[i+1]] of row i, with values."""

    def __init__(self, lists: list[np.ndarray], values: list[np.ndarray] | None = None):
        self.begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.at = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        self.values = np.ones(len(self.at)) if values is None else np.concatenate([*values, np.zeros(0)])
        self.row = np.repeat(np.arange(len(lists)), np.diff(self.begin))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.values * w[self.at], minlength=len(self.begin) - 1)

    def transposed_times(self, x: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.at, self.values * x[self.row], minlength=width)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: Rows, target: np.ndarray, width: int, l1: float = 0.0, l2: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias for soft targets, by accelerated proximal steps on the mean loss with both penalties."""
    n = max(1, len(target))
    lengths = rows.times(np.ones(width)) + 1
    # The curvature in a column is at most a quarter of the mean of its values times their rows' sums.
    bound = 0.25 * rows.transposed_times(lengths, width) / n + l2 + 1e-9
    bound_b = 0.25 * float(lengths.mean()) if len(target) else 1.0
    mean = float(np.clip(target.mean(), 1e-3, 1 - 1e-3)) if len(target) else 0.5
    w, b = np.zeros(width), float(np.log(mean / (1 - mean)))
    vw, vb, old_w, old_b = w, b, w, b
    for t in range(1, steps + 1):
        error = sigmoid(rows.times(vw) + vb) - target
        w = vw - (rows.transposed_times(error, width) / n + l2 * vw) / bound
        w = np.sign(w) * np.maximum(np.abs(w) - l1 / bound, 0)
        b = vb - float(error.mean() if len(error) else 0) / bound_b
        push = (t - 1) / (t + 2)
        vw, vb, old_w, old_b = w + push * (w - old_w), b + push * (b - old_b), w, b
    return w, b


def fit_hinge(rows: Rows, sign: np.ndarray, cost: np.ndarray, width: int, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model with squared hinge loss, by dual coordinate descent (a constant column is the bias)."""
    w, b, alpha = np.zeros(width), 0.0, np.zeros(len(sign))
    diagonal = np.bincount(rows.row, rows.values**2, minlength=len(sign)) + 1 + 0.5 / cost
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(sign)):
            part = slice(rows.begin[i], rows.begin[i + 1])
            at, values = rows.at[part], rows.values[part]
            slope = sign[i] * (values @ w[at] + b) - 1 + 0.5 * alpha[i] / cost[i]
            new = max(0.0, alpha[i] - slope / diagonal[i])
            if step := new - alpha[i]:
                alpha[i] = new
                w[at] += step * sign[i] * values
                b += step * sign[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, b


def fit_sigmoid(margin: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """a and b so that sigmoid(a * margin + b) is the chance of label 1, with slightly softened targets."""
    ones, zeros = label.sum(), (1 - label).sum()
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * margin**2).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * margin).sum(), g.sum()])
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b
