"""Hierarchical best-fit packing of documents into token sequences.

Tasks that read texts cut them into items (a document, or the pieces of one that is longer than a sequence) of which only
lengths and checksums go on. Items are dealt at random to leaves of bounded size, and a leaf places them best-fit, the
longest first. Bins that are nearly full are done; the others are items of the next round, in which FAN nodes meet in one
and place them best-fit again, until there is one node.

After a best-fit no two bins of a node fit together, so a node has one bin at most that isn't over half full, and only these
can still move. At most FAN of them meet in a node, so of the bins over half full that are equally full, a node hands on
FAN for each round that is left and no more are ever needed. So a node's rows are bounded, whatever the number of documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, light, stored, table, tokenizer_path
from .packing import END, Ids

LENGTH = 2048
#: Items of a leaf, on average, and nodes that meet in one.
ITEMS, FAN = 50_000, 16
#: Free ids at most of a bin that is done.
SPARE = 16
ITEM = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = ITEM + ", bin long, offset long, fill long, node long"
MERGED = "bin long, sequence long, shift long, fill long, node long, again boolean"


def _items(path: str, length: int):
    """Items of the documents: a longer one's first piece has what the full ones leave."""
    names = [x.split()[0] for x in ITEM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(path)
        for batch in batches:
            texts, rows = column(batch, "text"), []
            for k, (row, doc) in enumerate(zip(column(batch, "row").to_pylist(), column(batch, "doc_id").to_pylist())):
                ids = ids_of.of([texts[k].as_py() or ""])[0] + END
                total = len(ids) // 4
                start, n = 0, total % length or length
                piece = 0
                while start < total:
                    rows.append((row, doc, piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start, n, piece = start + n, length, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if c == "piece" else pa.int64()) for c, x in zip(names, zip(*rows))], names=names)

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each item's bin and its place there, and the bins' fill; items are placed from the longest to the shortest, equals in order.

    An item goes into the fullest bin that has room, and into a new one if none has. A bit for each number of free ids
    tells whether an open bin has so many.
    """
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, fill = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += n
        free[room - n].append(b)
        some |= 1 << (room - n)
    return bins, places, np.array(fill, np.int64)


def _leaf(length: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("row", "ascending"), ("piece", "ascending")])  # so that a task that runs again gives the same
        node = t.column("node")[0].as_py()
        bins, places, fill = best_fit(t.column("length").to_numpy(), length)
        for c, x in (("bin", (node << 32) + bins), ("offset", places), ("fill", fill[bins])):
            t = t.append_column(c, pa.array(x))
        return t.select([x.split()[0] for x in PLACED.split(", ")])

    return run


def _merge(length: int, spare: int, most: int):
    """Bins as items. sequence: the bin that one is moved to, itself if it stays; again: whether it goes on to the next round."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bin")
        ids, size = t.column("bin").to_numpy(), t.column("fill").to_numpy()
        bins, places, fill = best_fit(size, length)
        head = np.zeros(len(fill), np.int64)
        head[bins[places == 0]] = ids[places == 0]
        stays = places == 0
        again = stays & (fill[bins] < length - spare)
        large = np.flatnonzero(again & (2 * fill[bins] > length))
        large = large[np.lexsort((ids[large], fill[bins[large]]))]
        level = fill[bins[large]]
        rank = np.arange(len(level)) - np.searchsorted(level, level)
        again[large[rank >= most]] = False
        values = (ids, head[bins], places, fill[bins], t.column("node").to_numpy(), again)
        return pa.table(dict(zip([x.split()[0] for x in MERGED.split(", ")], map(pa.array, values))))

    return run


def residual_pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, items: int = ITEMS, fan: int = FAN, spare: int = SPARE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a closing id 0; null and empty texts are that id alone. Only documents longer than `length`
    are cut, into pieces of `length` ids, of which the first may be shorter. Pieces of a sequence lie one after the other.
    Repeated rows and null doc_ids are packed like any row; equal lengths are placed in the order of rows; no rows give no
    rows. Sequence ids are unique, not consecutive. Columns other than doc_id and text are ignored.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = stored(rows.mapInArrow(light(_items(path, length)), ITEM), "residual-items")
    leaves = nodes = max(1, math.ceil(cut.count() / items))
    dealt = cut.withColumn("node", F.pmod(F.xxhash64("row", "piece"), F.lit(leaves)))
    placed = stored(dealt.groupBy("node").applyInArrow(_leaf(length), PLACED), "residual-placed")
    left = placed.where((F.col("offset") == 0) & (F.col("fill") < length - spare)).select("bin", "fill", "node")
    moved: list[DataFrame] = []
    rounds = math.ceil(math.log(leaves, fan)) if leaves > 1 else 0
    while nodes > 1:
        nodes, rounds = math.ceil(nodes / fan), max(0, rounds - 1)
        merged = left.withColumn("node", F.floor(F.col("node") / fan)).groupBy("node").applyInArrow(_merge(length, spare, fan * rounds), MERGED)
        merged = stored(merged, "residual-merged")
        moved.append(merged.where("bin <> sequence").select("bin", "sequence", "shift"))
        left = merged.where("again").select("bin", "fill", "node")
    if not moved:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")

    def through(later: DataFrame, earlier: DataFrame) -> DataFrame:
        """Where bins end that moved in a round or in one after it; a node moves FAN of them at most."""
        to = later.select(F.col("bin").alias("sequence"), F.col("sequence").alias("last"), F.col("shift").alias("more"))
        both = earlier.join(to, "sequence", "left").select("bin", F.coalesce("last", "sequence").alias("sequence"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        return later.unionByName(both)

    ends = stored(reduce(through, reversed(moved)), "residual-moved")
    found = placed.join(ends, "bin", "left")
    place = (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence", "bin").alias("sequence_id"), place)


def op13_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_pack(table(spark, sf_dir, "documents", "doc_id", "text"))
