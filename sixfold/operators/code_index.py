"""An inverted index of nodes by code: which nodes a query may meet is known before any product is made.

The index is a table of blocks. A block holds nodes of one code only, their ids and unit vectors packed, so a query, whose
codes are the bits of a mask, skips all blocks of other codes: blocks that no query of a block of queries asks for are
filtered out by their code column, and inside a pair of blocks only the queries that ask for the code are multiplied.

Two modes. "compat": a node stands under its stored code, and a query asks for the union of the balls around its codes in
all projections. "sound": a node stands under its code in each projection, and a query asks, in each projection, for the
ball around its own code there, so that both sides are turned alike; a node that several projections admit counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import q6, vectors
from .graph import cut

#: Nodes of a block, queries of a block, and blocks of queries that are held against the index in one scan (2 MB each at 64
#: dimensions, broadcast).
NODES, QUERIES, GROUP = 8192, 4096, 16
BLOCK = "place int, code int, size int, ids binary, v binary, codes binary"
ASKED = "block int, ids binary, v binary, masks binary, any array<bigint>"


@dataclass
class CodeIndex:
    """blocks: place (the projection, or 0), code, size, and the packed nodes. sound: whether codes are those of projections."""

    blocks: DataFrame
    lsh: vectors.Projections
    sound: bool


def ball_mask(code: Column, radius: int) -> Column:
    """The codes of a ball as the bits of a 64-bit number."""
    return F.aggregate(q6.ball(code, radius), F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h)))


def codes_mask(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h)))


def asked(queries: DataFrame, lsh: vectors.Projections, radius: int) -> DataFrame:
    """queries (query, v, ...) written once with codes (one a projection), ball (their union, ascending), own (the code
    without a turn) and unit: later plans read columns instead of repeating how they are made."""
    coded = cut(queries.withColumn("codes", lsh.codes(F.col("v"))).withColumn("own", q6.embed(F.col("v"))).withColumn("unit", vectors.normalize(F.col("v"))))
    around = lambda h: F.array(*[h.bitwiseXOR(F.lit(m)) for m in q6.masks(radius)])
    return cut(coded.withColumn("ball", F.array_sort(F.array_distinct(F.flatten(F.transform("codes", around))))))


def _packed_nodes(size: int):
    """Nodes in the order of place and code as blocks of `size` at most; a block never spans two codes."""

    def block(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held)
        held.clear()
        values = (int(rows.place.iloc[0]), int(rows.code.iloc[0]), len(rows), rows.id.to_numpy(np.int64).tobytes(), np.stack(rows.v.to_numpy()).astype(np.float64).tobytes(), np.stack(rows.codes.to_numpy()).astype(np.uint8).tobytes())
        return pd.DataFrame([values], columns=[x.split()[0] for x in BLOCK.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            for key, rows in b.groupby(["place", "code"], sort=False):
                if held and (held[0].place.iloc[0], held[0].code.iloc[0]) != key:
                    yield block(held)
                while len(rows):
                    room = size - sum(map(len, held))
                    held.append(rows.iloc[:room])
                    rows = rows.iloc[room:]
                    if sum(map(len, held)) == size:
                        yield block(held)
        if held:
            yield block(held)

    return run


def build_index(nodes: DataFrame, lsh: vectors.Projections, sound: bool = False, size: int = NODES) -> CodeIndex:
    """The index of nodes (id, embedding, hex_id); those without a vector aren't in it.

    Rows are dealt by code and, so that a code with most nodes is several tasks' work, by a part of their id.
    """
    unit = nodes.where("embedding is not null").select("id", vectors.normalize(F.col("embedding")).alias("v"), *([lsh.codes(F.col("embedding")).alias("codes")] if sound else [F.array("hex_id").alias("codes")]))
    parts = max(1, math.ceil(nodes.count() / (4 * size)))
    posted = unit.select("id", "v", "codes", F.posexplode("codes").alias("place", "code"))
    dealt = posted.repartition("place", "code", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("place", "code", "id")
    return CodeIndex(cut(dealt.mapInPandas(_packed_nodes(size), BLOCK)), lsh, sound)


def _packed_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for number, rows in b.groupby("block"):
            for lo in range(0, len(rows), QUERIES):
                part = rows.iloc[lo : lo + QUERIES]
                masks = np.stack(part["masks"].to_numpy()).astype(np.int64)
                values = (int(number), part["query"].to_numpy(np.int64).tobytes(), np.stack(part["unit"].to_numpy()).astype(np.float64).tobytes(), masks.tobytes(), np.bitwise_or.reduce(masks, axis=0).tolist())
                yield pd.DataFrame([values], columns=[x.split()[0] for x in ASKED.split(", ")])


def _best(k: int, tally: Accumulator | None):
    """The k best admitted nodes of each query in a pair of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                ids, queries = np.frombuffer(r.ids, np.int64), np.frombuffer(r.q_ids, np.int64)
                masks = np.frombuffer(r.masks, np.uint64).reshape(len(queries), -1)
                asks = np.flatnonzero(masks[:, r.place] >> np.uint64(r.code) & np.uint64(1))
                if not len(asks):
                    continue
                if tally is not None:
                    tally.add(len(asks) * len(ids))
                queries, masks = queries[asks], masks[asks]
                scores = np.frombuffer(r.v, np.float64).reshape(len(ids), -1) @ np.frombuffer(r.q_v, np.float64).reshape(-1, len(r.v) // 8 // len(ids))[asks].T
                scores = np.round((scores + 1) / 2, 6)
                codes = np.frombuffer(r.codes, np.uint8).reshape(len(ids), -1).astype(np.uint64)
                for p in range(r.place):  # admitted by an earlier projection, and so scored there
                    scores[masks[None, :, p] >> codes[:, p, None] & np.uint64(1) == 1] = -np.inf
                n = min(k, len(ids))
                top = np.lexsort((np.broadcast_to(ids[:, None], scores.shape), -scores), axis=0)[:n]
                found = pd.DataFrame({"query": np.tile(queries, n), "id": ids[top].ravel(), "score": np.take_along_axis(scores, top, axis=0).ravel()})
                yield found[np.isfinite(found.score)]

    return run


def candidates(index: CodeIndex, queries: DataFrame, radius: int, most: int, tally: Accumulator | None = None, size: int = QUERIES) -> DataFrame:
    """query, id, score of the `most` best nodes that each query admits, by (1 + cosine) / 2 at six decimals, the smaller id
    first among equals. queries: as asked() gives them. tally, if given, adds up how many products were made."""
    masks = F.transform("codes", lambda c: ball_mask(c, radius)) if index.sound else F.array(codes_mask(F.col("ball")))
    n = max(1, math.ceil(queries.count() / size))
    dealt = queries.select("query", "unit", masks.alias("masks"), F.pmod(F.xxhash64("query"), F.lit(n)).cast("int").alias("block"))
    dealt = dealt.repartition("block").sortWithinPartitions("block") if n > 1 else dealt.coalesce(1)
    blocks = cut(dealt.mapInPandas(_packed_queries, ASKED).select("block", "masks", "any", F.col("ids").alias("q_ids"), F.col("v").alias("q_v")))
    found = None
    for lo in range(0, n, GROUP):
        numbers = F.sequence(F.lit(lo), F.lit(min(n, lo + GROUP) - 1))
        few = F.broadcast(blocks.where(F.col("block").between(lo, lo + GROUP - 1)))
        wanted = F.call_function("getbit", F.get("any", F.col("place")), F.col("code")) == 1
        meet = index.blocks.withColumn("block", F.explode(numbers)).join(few, "block").where(wanted)
        best = meet.mapInPandas(_best(most, tally), "query long, id long, score double")
        found = best if found is None else found.unionByName(best)
    ranked = found.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("r") <= most).drop("r")
