"""Hard negatives by a vertical (BOND) scan of blocks of vectors.

A block of rows lies in columns, one a dimension. An anchor reads them in the descending order of its own magnitudes,
STEP at a time. After each step the partial products of the candidates and the least and greatest that the dimensions not
yet read can add (from each column's minimum and maximum) bound every score; a bitmap of candidates loses those whose
bounds leave every open question, until exact scores resolve it. The first scan asks for the best rows of the anchor's
label, the second for the best rows of other labels inside the windows that the positives' scores open.

The anchors are a stated query set. They are dealt to every block of rows, as rows, and a task keeps the best of its block
for each, so what is shuffled grows with anchors times blocks and never with pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, light, stored, table

#: Rows of a block (16 MB at 64 dimensions in 32-bit numbers) when there are many; at least LEAST, so that few rows spread.
BLOCK, LEAST = 65_536, 4_096
#: Dimensions that are read before candidates are bounded again.
STEP = 8
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95


def quantized(vector: Column) -> Column:
    """floor(256 x) of each component, or null if one is null or not finite, or the vector is null."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, whole)


class Block:
    """Rows of a block in columns, in the order of their labels, with each column's minimum and maximum.

    Columns are 32-bit or 64-bit floats where the products of all dimensions stay exact in them, else 64-bit integers.
    """

    def __init__(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray]):
        order = np.lexsort((ids, labels))
        self.row, self.ids, self.labels = row[order], ids[order], labels[order]
        self.wide = max(map(len, vectors))
        whole = np.zeros((len(vectors), self.wide), np.int64)
        for i, at in enumerate(order.tolist()):
            whole[i, : len(vectors[at])] = vectors[at]
        whole = np.ascontiguousarray(whole.T)
        self.least, self.most = whole.min(axis=1, initial=0), whole.max(axis=1, initial=0)
        self.columns = {np.int64: whole}

    def columns_for(self, q: np.ndarray) -> np.ndarray:
        reach = float(np.abs(q.astype(float)) @ np.maximum(np.abs(self.least.astype(float)), np.abs(self.most.astype(float))))
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
        if kind not in self.columns:
            self.columns[kind] = self.columns[np.int64].astype(kind)
        return self.columns[kind]

    def span(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def scan(self, q: np.ndarray, candidates: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (places in the block) that no bound rejects, and their exact scores.

        keep(partial, low, high) gives the bitmap of those that may still be wanted, if the rest adds low to high.
        """
        q = np.pad(q, (0, max(0, self.wide - len(q))))[: self.wide]  # what one of two vectors lacks counts as zero
        columns = self.columns_for(q)
        order = np.argsort(-np.abs(q), kind="stable")
        order = order[: np.count_nonzero(q)]
        exact = object if columns.dtype == np.int64 else np.int64  # bounds may need more than 64 bits where no score does
        ends = np.stack([q.astype(exact) * self.least, q.astype(exact) * self.most])[:, order]
        rest = [[*np.cumsum(x[::-1])[::-1].tolist(), 0] for x in (ends.min(axis=0), ends.max(axis=0))]
        q = q.astype(columns.dtype)
        first, last = (int(candidates[0]), int(candidates[-1]) + 1) if len(candidates) else (0, 0)
        whole = 2 * len(candidates) > last - first  # then columns are read as they lie, without picking candidates out
        columns = columns[:, first:last]
        candidates = candidates - first
        scores = np.zeros(last - first if whole else len(candidates), columns.dtype)
        for at in range(0, len(order), STEP):
            dims = order[at : at + STEP]
            scores += q[dims] @ (columns[dims] if whole else columns[dims[:, None], candidates])
            after = min(at + STEP, len(order))
            bitmap = keep(scores[candidates] if whole else scores, rest[0][after], rest[1][after])
            if not bitmap.all():
                scores = scores if whole else scores[bitmap]
                candidates = candidates[bitmap]
            if whole and 4 * len(candidates) < len(scores):
                scores, whole = scores[candidates], False
        if whole:
            scores = scores[candidates]
        if not len(order):
            bitmap = keep(scores, 0, 0)
            candidates, scores = candidates[bitmap], scores[bitmap]
        return candidates + first, scores.astype(np.int64)


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def among_best(k: int) -> Callable:
    """A row stays while its upper bound reaches the k-th best lower bound."""

    def keep(partial: np.ndarray, low, high) -> np.ndarray:
        return partial >= int(_kth(partial, k)) - (high - low) if len(partial) > k else np.ones(len(partial), bool)

    return keep


def among_windows(windows: list[tuple[int, int]], k: int) -> Callable:
    """A row stays while it may be among the k best in one of the windows (from, to) of scores."""
    least, most = min(a for a, _ in windows), max(b for _, b in windows)

    def keep(partial: np.ndarray, low, high) -> np.ndarray:
        inside = (partial >= least - high) & (partial <= most - low)
        if high - low > most - least:
            return inside
        some = partial[inside]
        wanted = np.zeros(len(some), bool)
        for a, b in windows:
            sure = some[(some >= a - low) & (some <= b - high)]
            a = max(a, int(_kth(sure, k)) + low) if len(sure) >= k else a
            wanted |= (some >= a - high) & (some <= b - low)
        inside[inside] = wanted
        return inside

    return keep


def windows_of(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """For each positive's score the negatives' least and greatest: low score <= 100 negative <= high score."""
    return [(-(-low * s // 100), high * s // 100) for s in scores]


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _blocks(batches: Iterator[pa.RecordBatch], answer: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches in the order of blocks, in each its rows and then anchors: a block is held, the anchors stream by."""
    held: list = []
    number, block = None, None
    for b in batches:
        n, asked = column(b, "block").to_numpy(), column(b, "asked").to_numpy(zero_copy_only=False)
        row, ids, labels = (column(b, c).to_numpy() for c in ("row", "id", "label"))
        offsets, flat = column(b, "q").offsets.to_numpy(), column(b, "q").values.to_numpy()
        scores = column(b, "scores").to_pylist()
        out = []
        for i in range(len(b)):
            if n[i] != number:
                number, block, held = n[i], None, []
            q = flat[offsets[i] : offsets[i + 1]]
            if not asked[i]:
                held.append((row[i], ids[i], labels[i], q))
                continue
            if block is None and held:
                block, held = Block(*[np.array(x, np.int64) for x in list(zip(*held))[:3]], [h[3] for h in held]), []
            if block is not None:
                out += [(int(row[i]), *x) for x in answer(block, int(row[i]), int(labels[i]), q, scores[i])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)


def _best_positives(k: int):
    def answer(block: Block, row: int, label: int, q: np.ndarray, _) -> list[tuple]:
        own = np.arange(*block.span(label))
        own, scores = block.scan(q, own[block.row[own] != row], among_best(k))
        best = _top(block.ids[own], scores, k)
        return list(zip(block.row[own[best]].tolist(), block.ids[own[best]].tolist(), scores[best].tolist()))

    return lambda batches: _blocks(batches, answer, ["anchor", "other", "id", "score"])


def _best_negatives(k: int, low: int, high: int):
    def answer(block: Block, row: int, label: int, q: np.ndarray, positives: list[int]) -> list[tuple]:
        windows = [(a, b, rank) for rank, (a, b) in enumerate(windows_of(positives, low, high)) if a <= b]
        if not windows:
            return []
        lo, hi = block.span(label)
        others = np.concatenate([np.arange(lo), np.arange(hi, len(block.row))])
        others, scores = block.scan(q, others, among_windows([w[:2] for w in windows], k))
        out = []
        for a, b, rank in windows:
            inside = np.flatnonzero((scores >= a) & (scores <= b))
            best = inside[_top(block.ids[others[inside]], scores[inside], k)]
            out += [(rank, x, s) for x, s in zip(block.ids[others[best]].tolist(), scores[best].tolist())]
        return out

    return lambda batches: _blocks(batches, answer, ["anchor", "place", "id", "score"])


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, of rows with vec_id, embedding, label.

    Components count as floor(256 x), and a score is the inner product of an anchor's and a row's. An anchor (a row for
    which the condition on vec_id holds) has as positives its best other rows of the same label, and for each of them as
    negatives the best rows of other labels with low <= 100 negative / positive <= high. Higher scores come first, the
    smaller vec_id among equals.

    Rows without vec_id or label, and those whose vector is null or has a component that is null or not finite, take no
    part. Vectors of unequal length count as continued by zeros; an empty one has the score 0 with all. Rows are told
    apart as rows: rows repeated with one vec_id are positives or negatives of each other and answered each. A positive of
    negative score has no negatives. Scores are 64-bit integers. No rows, or no anchors, give no rows. Columns other than
    these three are ignored.
    """
    spark = vectors.sparkSession
    names = [F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), quantized(F.col("embedding")).alias("q"), F.coalesce(anchor, F.lit(False)).alias("is_anchor")]
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("row"), *names).where("id is not null and label is not null and q is not null"), "negatives-rows")
    total = rows.count()
    n = max(1, math.ceil(total / min(BLOCK, max(LEAST, total // spark.sparkContext.defaultParallelism))))
    anchors = rows.where("is_anchor")
    mine = rows.select(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("block"), F.lit(False).alias("asked"), "row", "id", "label", "q", F.array().cast("array<bigint>").alias("scores"))

    def scanned(asked: DataFrame, scan, schema: str) -> DataFrame:
        everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.lit(True).alias("asked"), "row", "id", "label", "q", "scores")
        return mine.unionByName(everywhere).repartition(n, "block").sortWithinPartitions("block", "asked").mapInArrow(light(scan), schema)

    found = scanned(anchors.withColumn("scores", F.array().cast("array<bigint>")), _best_positives(positives), "anchor long, other long, id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id", "other"))
    found = found.withColumn("place", (rank - 1).cast("long")).where(F.col("place") < positives)
    best = stored(found.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    lists = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asked = anchors.join(lists.select(F.col("anchor").alias("row"), F.col("p.positive_score").alias("scores")), "row")
    found = scanned(asked, _best_negatives(negatives, low, high), "anchor long, place long, id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = best.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = """
with finite as (
    select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
pairs as (
    select a.r as a, a.vec_id as anchor_id, b.r as b, b.vec_id, a.label = b.label as alike, cast(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) as bigint) as score
    from finite a, finite b where a.vec_id % 50 = 0 and a.r <> b.r),
positives as (
    select * from (select *, row_number() over (partition by a order by score desc, vec_id, b) as k from pairs where alike) where k <= 5),
negatives as (
    select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.a, p.b order by n.score desc, n.vec_id) as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
    from positives p join pairs n on n.a = p.a and not n.alike and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negatives where rank <= 3
"""
