"""Exact duplicates by a Golomb-coded fingerprint exchange.

Each sender (a task's rows) sorts its truncated 64-bit fingerprints and sends every owner, who has one range of the
fingerprint space, the sorted gaps in a Golomb-Rice code. The owner answers with a bitmap that marks which of them occur
elsewhere. Only rows with a marked fingerprint send their text, which is then compared byte for byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, column, light, shuffle_partitions, stored, table, with_group

#: Fingerprints are log2(rows) + SPARE_BITS long, so that about one row in 2^SPARE_BITS is suspected wrongly.
SPARE_BITS = 8
#: Fingerprints that one owner decodes at once.
OWNER_ROWS = 1 << 20
#: Up to so many suspect fingerprints (8 bytes each) are broadcast; beyond, the join is shuffled.
BROADCAST_SUSPECTS = 2_000_000


def rice_encode(gaps: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """Golomb-Rice code with divisor 2^k: the unary quotients and the k-bit remainders, as two bit streams."""
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    shifts = np.arange(k, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(remainders.ravel()).tobytes()


def rice_decode(unary: bytes, remainders: bytes, n: int, k: int) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    bits = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
    return (quotients << np.uint64(k)) | (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def encode_set(values: np.ndarray, base: int, width: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct values of [base, base + 2^width) in a Golomb-Rice code."""
    gaps = np.diff(values - np.uint64(base), prepend=np.uint64(0))
    k = max(0, int(math.log2(max(1.0, 2.0**width / max(1, len(values)) * math.log(2)))))
    return k, *rice_encode(gaps, k)


def decode_set(unary: bytes, remainders: bytes, n: int, k: int, base: int) -> np.ndarray:
    return np.cumsum(rice_decode(unary, remainders, n, k), dtype=np.uint64) + np.uint64(base)


MESSAGE = "sender long, owner int, n int, k int, unary binary, remainders binary, twice binary"


def _send(width: int):
    """Messages of one task; width: bits of a fingerprint below the owner's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [column(b, "fp").to_numpy(zero_copy_only=False) for b in batches]
        if not sum(map(len, parts)):
            return
        values, counts = np.unique(np.concatenate(parts).astype(np.uint64), return_counts=True)
        owners = (values >> np.uint64(width)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owners, prepend=-1))
        sender, rows = TaskContext.get().partitionId(), []
        for lo, hi in zip(cuts, [*cuts[1:], len(values)]):
            k, unary, rest = encode_set(values[lo:hi], int(owners[lo]) << width, width)
            rows.append((sender, int(owners[lo]), int(hi - lo), k, unary, rest, np.packbits(counts[lo:hi] > 1).tobytes()))
        names = [x.split()[0] for x in MESSAGE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def _decoded(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for b in batches:
        for m in b.to_pylist():
            yield m, decode_set(m["unary"], m["remainders"], m["n"], m["k"], m["owner"] << width)


def _answer(width: int):
    """Owners' side: a bitmap for each message, marking the fingerprints that another sender also has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, lists = [], []
        for m, values in _decoded(width, batches):
            heads.append((m["sender"], m["owner"], m["n"]))
            lists.append(values)
        if not heads:
            return
        _, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        marks, at, maps = counts[place] > 1, 0, []
        for _, _, n in heads:
            maps.append(np.packbits(marks[at : at + n]).tobytes())
            at += n
        senders, owners, _ = zip(*heads)
        yield pa.RecordBatch.from_arrays([pa.array(senders, pa.int64()), pa.array(owners, pa.int32()), pa.array(maps, pa.binary())], names=["sender", "owner", "marks"])

    return run


def _suspects(width: int):
    """Senders' side: the fingerprints that the answer marks, or that the sender itself has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m, values in _decoded(width, batches):
            own, other = (np.unpackbits(np.frombuffer(m[x], np.uint8), count=m["n"]) for x in ("twice", "marks"))
            yield pa.RecordBatch.from_arrays([pa.array(values[(own | other) > 0].astype(np.int64))], names=["fp"])

    return run


def suspect_fingerprints(prints: DataFrame, bits: int, rows: int) -> DataFrame:
    """Distinct values of the column fp (a `bits`-bit number) that at least two rows have, by the coded exchange."""
    spark = prints.sparkSession
    owner_bits = min(bits - 1, max(1, math.ceil(math.log2(max(shuffle_partitions(spark), rows / OWNER_ROWS)))))
    width = bits - owner_bits
    messages = stored(prints.select("fp").mapInArrow(light(_send(width)), MESSAGE), "golomb-messages")
    answers = (
        messages.select("sender", "owner", "n", "k", "unary", "remainders")
        .repartition(1 << owner_bits, "owner")
        .mapInArrow(light(_answer(width)), "sender long, owner int, marks binary")
    )
    return messages.join(answers, ["sender", "owner"]).mapInArrow(light(_suspects(width)), "fp long").distinct()


def exact_dedup(docs: DataFrame, normalise=ascii_lower) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. The largest doc_id of a group stays. A null text counts as the
    empty text, so null and empty texts form one group. Rows repeated with one doc_id and one text get the same answer
    each and count in group_size; a null doc_id never wins over another. No rows give no rows. Columns other than
    doc_id and text are ignored.
    """
    norm = normalise(F.coalesce("text", F.lit("")))
    slim = docs.select("doc_id", F.unhex(F.sha2(norm, 256)).alias("sha"), F.xxhash64(norm).alias("h"))
    slim = stored(slim, "exact-prints")
    rows = slim.count()
    bits = min(62, max(16, math.ceil(math.log2(rows + 1)) + SPARE_BITS))
    fp = lambda h: F.shiftrightunsigned(h, 64 - bits)
    suspects = stored(suspect_fingerprints(slim.select(fp("h").alias("fp")), bits, rows), "exact-suspects")
    if suspects.count() <= BROADCAST_SUSPECTS:
        suspects = F.broadcast(suspects)
    texts = docs.select("doc_id", norm.alias("norm")).withColumn("fp", fp(F.xxhash64("norm"))).join(suspects, "fp", "left_semi")
    # Byte verification: the grouping key is the text itself, and equal texts meet within their own task first.
    groups = texts.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = stored(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size"), "exact-groups")
    found = with_group(slim.select("doc_id", "sha"), groups, "sha", "group_size")
    keep = F.coalesce("keep_id", "doc_id")
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


OP5_SQL = f"""
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256 from t join g on t.norm = g.norm
"""
