"""Sharding by minimax contiguous partition, in DataFrame functions only.

Groups of equal texts are atomic and stand in the order of their text's digest. The smallest feasible shard capacity is
found by binary search with a greedy check. The search works on sums over ranges of the digest: from a few thousand
ranges, only those in which a cut may fall are split further, until upper and lower bound meet, so that the driver sees
a bounded summary at any input size and the result is that of a search over every single group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shuffle_partitions, stored, table

#: Hex digits of the digest that make the first ranges: 16^3.
FIRST_DIGITS = 3
#: Rows numbered in one task.
CELL_ROWS = 50_000


@dataclass
class Ranges:
    """Ranges of digests in order: prefix, bytes, number of groups. A range of one group is atomic."""

    prefix: list[str]
    size: np.ndarray
    groups: np.ndarray

    def __post_init__(self):
        self.end = np.cumsum(self.size)
        self.total = int(self.end[-1]) if len(self.end) else 0

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """Greedy ends of the shards, None if there are more than `shards`.

        Not hopeful: cuts fall between ranges only, so success is certain. Hopeful: a cut may fall anywhere in a range of
        several groups, so failure is certain.
        """
        at, out = 0, []
        while at < self.total:
            if len(out) == shards:
                return None
            i = int(np.searchsorted(self.end, at + capacity, side="right"))
            to = int(self.end[i - 1]) if i else 0
            if hopeful and i < len(self.end) and self.groups[i] > 1:
                to = at + capacity
            if to <= at:
                return None
            out.append(to)
            at = to
        return out

    def even(self, capacity: int, shards: int) -> list[int]:
        """Ends of `shards` shards within the capacity, each as near above an equal share of the rest as feasible."""
        at, out = 0, []
        for left in range(shards, 0, -1):
            i = int(np.searchsorted(self.end, at - (at - self.total) // left))
            to = int(self.end[min(i, len(self.end) - 1)])
            if to > at + capacity or not self.rest(to).fits(capacity, left - 1):
                to = int(self.end[int(np.searchsorted(self.end, at + capacity, side="right")) - 1])
            if to >= self.total:
                break
            out.append(to)
            at = to
        return [*out, self.total]

    def rest(self, at: int) -> Ranges:
        i = int(np.searchsorted(self.end, at, side="right"))
        return Ranges(self.prefix[i:], self.size[i:], self.groups[i:])

    def fits(self, capacity: int, shards: int) -> bool:
        return self.cuts(capacity, shards, False) is not None

    def least(self, shards: int, lo: int, hopeful: bool) -> int:
        """The smallest capacity, lo or more, that passes the greedy check."""
        hi = max(lo, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.cuts(mid, shards, hopeful) is not None else (mid + 1, hi)
        return lo


def _sums(groups: DataFrame, digits: int) -> list:
    prefix = F.substring("key", 1, digits).alias("prefix")
    return groups.groupBy(prefix).agg(F.sum("size").alias("size"), F.count("*").alias("groups")).collect()


def minimax_cuts(groups: DataFrame, shards: int, largest: int) -> list[str]:
    """The prefixes after which the order of `key` is cut into `shards` ranges at most, the largest as small as can be."""
    made = {r.prefix: (r["size"], r.groups) for r in _sums(groups, FIRST_DIGITS)}
    while True:
        names = sorted(made)
        ranges = Ranges(names, np.array([made[x][0] for x in names], np.int64), np.array([made[x][1] for x in names], np.int64))
        if not ranges.total:
            return []
        floor = max(math.ceil(ranges.total / shards), largest)
        sure, bound = ranges.least(shards, floor, False), ranges.least(shards, floor, True)
        if sure == bound:
            return [names[int(np.searchsorted(ranges.end, e))] for e in ranges.even(sure, shards)[:-1]]
        # Every cut of a capacity between the bounds lies between these two.
        early, late = ranges.cuts(bound, len(names), False) or [], ranges.cuts(sure, shards, True)
        split = set()
        for k, hi in enumerate(late):
            lo = early[k] if k < len(early) else 0
            i, j = int(np.searchsorted(ranges.end, lo, side="right")), int(np.searchsorted(ranges.end, hi))
            split |= {names[x] for x in range(i, min(j, len(names) - 1) + 1) if ranges.groups[x] > 1}
        for digits in sorted({len(x) for x in split}):
            chosen = [x for x in split if len(x) == digits]
            within = groups.where(F.substring("key", 1, digits).isin(chosen))
            for x in chosen:
                del made[x]
            made |= {r.prefix: (r["size"], r.groups) for r in _sums(within, digits + 1)}


def shard_of(groups: DataFrame, shards: int) -> Column:
    """An expression over `key` for the shard.

    A group as large as an equal share of what is left has a shard to itself; the others are cut minimax in order.
    """
    top = groups.orderBy(F.desc("size"), "key").limit(shards).collect()
    left, alone = groups.agg(F.sum("size")).first()[0] or 0, []
    for r in top:
        if len(alone) < shards - 1 and r["size"] * (shards - len(alone)) >= left and r["size"] < left:
            alone.append(r.key)
            left -= r["size"]
    rest = groups.where(~F.col("key").isin(alone)) if alone else groups
    largest = next((r["size"] for r in top if r.key not in alone), 0)
    shard = F.lit(0)
    for x in minimax_cuts(rest, shards - len(alone), largest):
        shard = shard + (F.col("key") > x + "g").cast("int")  # g: above every hex digit
    for i, x in enumerate(alone):
        shard = F.when(F.col("key") == x, F.lit(shards - 1 - i)).otherwise(shard)
    return shard


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """All rows in shards 0 to shards-1: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Rows with equal texts stay together; null and empty texts are one group. A size is the text's bytes and 8. Within a
    shard, slots run from 0 without gaps. Repeated rows each get a slot, a null doc_id is a row like any other, and no
    rows give no rows. With fewer groups than shards some shards stay empty. Columns other than doc_id and text are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.sha2(text, 256), 1, 40).alias("key"),
    )
    slim = stored(slim, "shard-rows")
    groups = stored(slim.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    rows = slim.withColumn("shard", shard_of(groups, shards))
    most = max([1, *(r["count"] for r in rows.groupBy("shard").count().collect())])
    salts = max(math.ceil(most / CELL_ROWS), math.ceil(shuffle_partitions(docs.sparkSession) / shards))
    rows = rows.withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = rows.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "key")) - 1
    return rows.withColumn("slot", within).join(cells, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("slot") + F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id", "text"))
