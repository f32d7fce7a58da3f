"""Exact nearest neighbours of a stated set of query vectors, block against block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut

#: Query vectors in a block, on average, and blocks that are held against the corpus in one scan of it (2 MB each at 64
#: dimensions, broadcast).
BLOCK, GROUP = 4096, 16
PACKED = "ids binary, v binary, block int"


def _pack(block: str | None = None):
    """Rows of a batch, or of each of its blocks, as rows of two binaries: 64-bit ids and vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, rows in b.groupby(block) if block else [(0, b)]:
                for lo in range(0, len(rows), BLOCK):
                    part = rows.iloc[lo : lo + BLOCK]
                    yield pd.DataFrame([(part["id"].to_numpy(np.int64).tobytes(), np.stack(part["v"].to_numpy()).astype(np.float64).tobytes(), int(number))], columns=["ids", "v", "block"])

    return run


def _best(k: int, with_self: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                own, ids = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                scores = np.frombuffer(r.v, np.float64).reshape(len(own), -1) @ np.frombuffer(r.q_v, np.float64).reshape(len(ids), -1).T
                scores = np.round(scores, 5)
                if not with_self:
                    scores[own[:, None] == ids[None, :]] = -np.inf
                n = min(k, len(own))
                top = np.lexsort((np.broadcast_to(own[:, None], scores.shape), -scores), axis=0)[:n]
                found = pd.DataFrame({"id": np.tile(ids, n), "other": own[top].ravel(), "similarity": np.take_along_axis(scores, top, axis=0).ravel()})
                yield found[np.isfinite(found.similarity)]

    return run


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, with_self: bool = False) -> DataFrame:
    """id, other, rank, similarity: the k corpus vectors nearest each query; both have id and v, a unit vector.

    Similarities are compared at five decimals, the smaller id first among equals. Queries come in blocks, written as a
    table; a corpus batch meets each block once and keeps its k best, so no pair is shuffled that isn't among them.
    """
    n = max(1, math.ceil(queries.count() / BLOCK))
    dealt = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    dealt = dealt.repartition("block").sortWithinPartitions("block") if n > 1 else dealt.coalesce(1)
    blocks = cut(dealt.mapInPandas(_pack("block"), PACKED).select("block", F.col("ids").alias("q_ids"), F.col("v").alias("q_v")))
    packed = corpus.select("id", "v").mapInPandas(_pack(), PACKED).drop("block")
    found = None
    for lo in range(0, n, GROUP):
        numbers = F.sequence(F.lit(lo), F.lit(min(n, lo + GROUP) - 1))
        meet = packed.select("*", F.explode(numbers).alias("block")).join(F.broadcast(blocks.where(F.col("block").between(lo, lo + GROUP - 1))), "block")
        best = meet.mapInPandas(_best(k, with_self), "id long, other long, similarity double")
        found = best if found is None else found.unionByName(best)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other")))
    return ranked.where(F.col("rank") <= k).select("id", "other", "rank", "similarity")
