"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their class counts; a linear model with squared hinge loss is
fitted by dual coordinate descent. The n-grams are a text's words, and one- and two-grams of its tokens' shapes (runs of
lower case, upper case, digits and each mark) with how dense they are, so that symbol noise, shouting, tables and
repetition show whatever the words are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, light, table, utf8
from .training import SAMPLE, Rows, fit_hinge, fit_sigmoid, held_out, labelled_sample, sigmoid, with_score

BUCKETS = 1 << 18
#: An n-gram counts if so many sampled documents have it.
LEAST_DOCS = 4
_SHAPE = bytes(32 if c in b" \t\n\r\x0b\x0c" else 97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))


def _shapes(raw: bytes) -> list[bytes]:
    x = np.frombuffer(raw.translate(_SHAPE), np.uint8)
    return x[np.concatenate([[True], x[1:] != x[:-1]])].tobytes().split() if len(x) else []


def _density(counts: Counter, total: int, tag: bytes) -> list[bytes]:
    return [tag + x + b"|%d" % min(12, (total // c).bit_length()) for x, c in counts.items()]


def features(raw: bytes | None) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    raw = raw or b""
    words, shapes = raw.split(), _shapes(raw)
    n = len(words)
    if not n:
        return np.zeros(0, np.int32)
    grams = _density(Counter(shapes), n, b"1")
    grams += _density(Counter(map(b" ".join, zip(shapes, shapes[1:]))), n, b"2")
    again = sum(map(bytes.__eq__, words, words[1:]))
    distinct = set(raw.lower().split())
    lines = raw.split(b"\n")
    grams += [b"again|%d" % (n // again).bit_length() if again else b"again|no", b"distinct|%d" % (10 * len(distinct) // n), b"lines|%d" % (10 * len(set(lines)) // len(lines))]
    hashes = {zlib.crc32(x) for x in grams}
    hashes |= {zlib.crc32(x, 1) for x in distinct}
    return np.unique(np.fromiter(hashes, np.int64, len(hashes)) % BUCKETS).astype(np.int32)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(x) for x in utf8(column(b, "text"))]
        yield pa.RecordBatch.from_arrays([column(b, "label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "at"])


class QualityModel:
    """weight and ratio by bucket, bias, and the sigmoid of the margin."""

    def __init__(self, lists: list[np.ndarray], labels: np.ndarray, cost: float = 1.0):
        self.ratio = np.zeros(BUCKETS, np.float32)
        self.weight = np.zeros(BUCKETS, np.float32)
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0
        if len(set(labels.tolist())) < 2:  # nothing to learn from: the share of the one class
            self.shift = 4.0 if len(labels) and labels[0] else -4.0 if len(labels) else 0.0
            return
        self.ratio = self._ratios(lists, labels)
        half = np.arange(len(labels)) % 2
        margins = np.zeros(len(labels))
        for part in (0, 1):  # margins of documents that the fit hasn't seen
            seen = [i for i in range(len(labels)) if half[i] != part]
            if len(set(labels[seen].tolist())) == 2:
                self._fit([lists[i] for i in seen], labels[seen], cost)
                for i in np.flatnonzero(half == part):
                    margins[i] = self.margin(lists[i])
        self._fit(lists, labels, cost)
        self.slope, self.shift = fit_sigmoid(margins, labels)

    @staticmethod
    def _ratios(lists: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
        counts = [np.bincount(np.concatenate([x for x, y in zip(lists, labels) if y == c]), minlength=BUCKETS) for c in (0, 1)]
        share = [(c + 1.0) / (c.sum() + 1.0) for c in counts]
        return np.where(counts[0] + counts[1] >= LEAST_DOCS, np.log(share[1] / share[0]), 0).astype(np.float32)

    def _scaled(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.ratio[at].astype(np.float64)
        at, r = at[r != 0], r[r != 0]
        return at, r / max(1e-9, float(np.sqrt((r * r).sum())))

    def _fit(self, lists: list[np.ndarray], labels: np.ndarray, cost: float) -> None:
        scaled = [self._scaled(x) for x in lists]
        rows = Rows([x for x, _ in scaled], [x for _, x in scaled])
        share = np.where(labels > 0, labels.mean(), 1 - labels.mean())
        w, self.bias = fit_hinge(rows, np.where(labels > 0, 1.0, -1.0), cost * 0.5 / share, BUCKETS)
        self.weight = w.astype(np.float32)

    def margin(self, at: np.ndarray) -> float:
        at, r = self._scaled(at)
        return float(self.weight[at] @ r) + self.bias

    def score(self, raw: bytes | None) -> float:
        return float(sigmoid(self.slope * self.margin(features(raw)) + self.shift))


def fit_quality(docs: DataFrame, labels: DataFrame, use=None, label: str = "quality", limit: int = SAMPLE) -> QualityModel:
    """Learns from at most `limit` labelled documents."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if use is None else use, limit)
    sample = sample.select("text", F.col("label").cast("int").alias("label")).mapInArrow(light(_features), "label int, at array<int>")
    got = sample.toArrow()
    lists = [np.array(x.values, np.int32) for x in got.column("at")]
    return QualityModel(lists, np.array(got.column("label"), np.int64))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs and score: the chance of label 1, from the text alone. Null and empty texts get the score of no n-grams."""
    return with_score(docs, model, lambda m, b: [m.score(x) for x in utf8(column(b, "text"))])  # the model: 2 MB, by BUCKETS


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    model = fit_quality(docs, labels, ~held_out(3, 1))
    return score_quality(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
