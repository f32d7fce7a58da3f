"""Near duplicates by SimHash, found through deletion-variant signatures.

Fingerprints that differ in D = 3 bits or fewer are cut into two segments, so that one segment differs in one bit at
most. Each segment is indexed once for every bit left out, and equal keys make buckets whose members are verified. A
bucket that many different fingerprints share is indexed again the same way on what its key leaves free (halves of the
other segment, then quarters), which bounds every bucket by 2^11 members at the third level and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored, table, utf8, with_group

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Most members of a bucket that are compared with each other; larger buckets are indexed again.
BUCKET = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash over the word shingles of a text; 0 for a text without words. bytes.lower() and bytes.split() know ASCII only."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: n - shingle])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        bits = np.unpackbits(np.array(hashes[lo : lo + 65536], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x, shingle) for x in utf8(column(b, "text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _without_one(shift: int, width: int) -> list[int]:
    """The masks of a segment with one bit left out."""
    whole = ((1 << width) - 1) << shift
    return [_signed(whole & ~(1 << (shift + i))) for i in range(width)]


def _children() -> list[list[list[int]]]:
    """For each level the masks that a bucket of the level above splits into, by its place."""
    top = [_without_one(0, 32) + _without_one(32, 32)]
    halves = [_without_one(o, 16) + _without_one(o + 16, 16) for o in (32, 0)]
    quarters = [_without_one(o, 8) + _without_one(o + 8, 8) for o in (48, 32, 16, 0)]
    return [top, halves, quarters]


CHILDREN = _children()


def _keys(rows: DataFrame, level: int) -> DataFrame:
    """place, mask, fp and key of every variant; rows: place and mask of the level above, and fp."""
    n = len(CHILDREN[level][0])
    sets = F.array(*[F.array(*[F.lit(m) for m in masks]) for masks in CHILDREN[level]])
    out = rows.select("place", "mask", "fp", F.posexplode(F.get(sets, F.col("place"))).alias("i", "m"))
    mask = F.col("mask").bitwiseOR(F.col("m"))
    # The segment, half or quarter that the key fixes decides what is free below it.
    place = F.col("place") * 2 + F.floor(F.col("i") / (n // 2)).cast("int")
    return out.select(place.alias("place"), mask.alias("mask"), "fp").withColumn("key", F.xxhash64(F.lit(level), "mask", F.col("fp").bitwiseAND(F.col("mask"))))


def _spanning(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(least, other) for each component of two or more among the sorted members."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= distance
    todo, out = np.ones(len(members), bool), []
    for i in range(len(members)):
        if not todo[i]:
            continue
        front = np.array([i])
        todo[i] = False
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & todo)
            todo[front] = False
            out += [(i, j) for j in front.tolist()]
    return out


def _links(distance: int):
    """Edges among equal keys; a task gets whole buckets in the order of their keys."""

    def of(keys: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        lo = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([lo, [len(keys)]]))
        two = lo[sizes == 2]
        a, b = prints[two], prints[two + 1]
        close = np.bitwise_count(a ^ b) <= distance
        yield a[close], b[close]
        for at, n in zip(lo[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            members = np.unique(prints[at : at + n])
            if found := _spanning(members, distance):
                i, j = np.array(found).T
                yield members[i], members[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = object()
        for batch in chain(batches, [last]):
            if batch is not last:
                k, p = (np.concatenate([x, column(batch, c).to_numpy().astype(x.dtype)]) for x, c in ((held_k, "key"), (held_p, "fp")))
                whole = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last bucket may go on
            else:
                k, p, whole = held_k, held_p, len(held_k)
            held_k, held_p = k[whole:], p[whole:]
            if whole:
                ends = [np.concatenate(x) for x in zip(*of(k[:whole], p[:whole]))]
                lo, hi = np.minimum(*ends).view(np.int64), np.maximum(*ends).view(np.int64)
                pairs = np.unique(np.stack([hi, lo], axis=1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span the components of all links at the distance, 3 or less."""
    rows = prints.select(F.lit(0).alias("place"), F.lit(0).cast("long").alias("mask"), "fp")
    found = None
    # A bucket of the first level holds the fingerprints of one or two segment values, so these tell where a large one may be.
    halves = F.array(*[F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("fp", 32 * s).bitwiseAND(0xFFFFFFFF).alias("v")) for s in (0, 1)])
    many = prints.select(F.explode(halves).alias("x")).groupBy("x").count().where(F.col("count") > BUCKET // 2)
    masks = F.array(*[F.array(*[F.lit(m) for m in _without_one(32 * s, 32)]) for s in (0, 1)])
    value = F.when(F.col("x.s") == 0, F.col("x.v")).otherwise(F.shiftleft("x.v", 32))
    large = stored(many.select(value.alias("v"), F.explode(F.get(masks, F.col("x.s"))).alias("mask")).select(F.xxhash64(F.lit(0), "mask", F.col("v").bitwiseAND(F.col("mask"))).alias("key")).distinct(), "simhash-large")
    for level in range(len(CHILDREN)):
        keyed = _keys(rows, level)
        some = not large.isEmpty()
        small = keyed.join(large, "key", "left_anti") if some else keyed
        dealt = small.select("key", "fp").repartition("key").sortWithinPartitions("key")
        edges = dealt.mapInArrow(_links(distance), "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if not some:
            break
        rows = stored(keyed.join(large, "key", "left_semi").select("place", "mask", "fp"), "simhash-rows")
        below = _keys(rows, level + 1).groupBy("key").count() if level + 2 < len(CHILDREN) else None
        large = stored((below.where(F.col("count") > BUCKET) if below is not None else large.limit(0)).select("key"), "simhash-large")
    return found.distinct()


def components(edges: DataFrame, stored=stored) -> DataFrame:
    """node and component (the least node that it reaches) of every node of the edges (a, b), by alternating stars.

    Large stars hang a node's larger neighbours on its least one, small stars its smaller ones, until nothing changes.
    Every round is a table that stored() writes.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == state or not n:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        state = (n, total)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        large = with_group(both.where("b > a"), least, "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = with_group(large, least, "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")


def _ordered(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id linked, however far).

    Texts without words, null ones too, have fingerprint zero and link like any other. Repeated rows get the same answer
    each; a null doc_id links but is never a component_id unless its component has no other. No rows give no rows.
    Columns other than doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash-prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "simhash-distinct")
    edges = links(prints.select("fp"), distance)
    root = components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    prints = prints.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    prints = stored(prints, "simhash-roots")
    least = prints.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("prints"))
    found = with_group(prints.select("fp", "root", "n"), least, "root", "prints").select("fp", "n", "component_id")
    return with_group(rows, stored(found, "simhash-components"), "fp", "n").select("doc_id", _ordered(F.col("fp")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
