"""Removal of long repeated byte strings by bucket-pointer refinement.

Every window of `span` bytes falls to the bucket of its smallest q-gram hash, so equal windows share a bucket, and a run of
consecutive windows of one bucket is one row. Runs with the same bytes are one context, of which two copies at most go on.
A task refines the windows of its buckets from buckets of a quarter of the length, sorting by the bucket identifiers at a place and further
on, over and over with the identifiers just made, to buckets of `span` bytes, and compares the bytes of what it has put
together. What it finds for a context holds for all its copies. A bucket of very many contexts is dealt out to the buckets
of longer q-grams first, again and again until it is small enough.

Strings of PASSAGE bytes are looked for in whole texts; the longer ones that are removed can only lie where these are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, shuffle_partitions, stored, table, utf8, with_group

#: Bytes of a string that is removed; of the shorter one that is only reported (about 50 words); of the first q-grams for
#: either.
SPAN, PASSAGE, GRAM, SHORT_GRAM = 400, 250, 150, 50
#: Bytes of contexts dealt to a task, and refined at once; contexts beyond which a bucket is dealt out by longer q-grams.
TASK_BYTES, REFINED_BYTES, LARGE = 4_000_000, 600_000, 4000
#: Spans to read or remove, and buckets, that may be broadcast (40 bytes each); beyond, so with all but small inputs, the join is shuffled.
BROADCAST_SPANS = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=4)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b), dtype=np.uint64)]) for b in (_BASE, _INVERSE))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of every substring of some bytes, from their prefix sums."""

    def __init__(self, raw: np.ndarray):
        self.power, self.inverse = _powers(max(12, (len(raw) + 1).bit_length()))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * self.power[: len(raw)], dtype=np.uint64)])

    def all(self, n: int) -> np.ndarray:
        count = max(0, len(self.sums) - n)
        return _mixed((self.sums[n : n + count] - self.sums[:count]) * self.inverse[:count])

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def _extreme(x: np.ndarray, n: int, of) -> np.ndarray:
    """of() over every n consecutive values, by doubling."""
    done = 1
    while 2 * done <= n:
        x = of(x[:-done], x[done:])
        done *= 2
    return of(x[: len(x) - (n - done)], x[n - done :]) if n > done else x


def runs(raw: bytes, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """bucket, start, windows, context (two hashes) and several of each run of windows; several: its bucket's gram may recur in it."""
    import xxhash

    if len(raw) < span:
        return (np.zeros(0, np.uint64),) * 6
    hashes, width = Hashes(np.frombuffer(raw, np.uint8)), span - gram + 1
    grams = hashes.all(gram)
    least = _extreme(grams, width, np.minimum)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    length = np.diff(np.concatenate([start, [len(least)]]))
    if length.max() > width:  # periodic bytes
        parts = -(-length // width)
        first = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, ends = np.repeat(start, parts) + first * width, np.repeat(start + length, parts)
        length = np.minimum(width, ends - start)
    # A gram is the smallest of some window if it equals the largest of the minima around it.
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    anchors = grams[_extreme(padded, width, np.maximum) == grams]
    values, counts = np.unique(anchors, return_counts=True)
    bucket = least[start]
    several = np.isin(bucket, values[counts > 1])
    ends = start + length + span - 1
    again = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start.tolist(), ends.tolist())), np.uint64, len(start))
    return bucket, start, length, hashes.between(start, ends), again, several


KEY = ["bucket", "c1", "c2"]
RUNS = "doc long, print long, bucket long, c1 long, c2 long, start int, windows int, several boolean"


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _runs(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = [runs(x or b"", span, gram) for x in utf8(column(part, "text"))]
                repeat = np.repeat(np.arange(part.num_rows), [len(f[0]) for f in found])
                bucket, start, length, c1, c2, several = (np.concatenate(x) for x in zip(*found))
                doc, print_, base = (column(part, c).to_numpy()[repeat] for c in ("doc", "print", "base"))
                values = [doc, print_, _signed(bucket), _signed(c1), _signed(c2), (base + start.astype(np.int64)).astype(np.int32), length.astype(np.int32), several.astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], names=_fields(RUNS))

    return run


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, span: int) -> bool:
    """Whether the strings of span bytes at each a (ascending) and b are the same; where both go on by one, one byte tells."""
    if not len(a):
        return True
    head = np.concatenate([[True], (np.diff(a) != 1) | (np.diff(b) != 1)])
    if (raw[a[~head] + span - 1] != raw[b[~head] + span - 1]).any():
        return False
    a, b, within = a[head], b[head], np.arange(span)
    return all((raw[a[lo : lo + 2048, None] + within] == raw[b[lo : lo + 2048, None] + within]).all() for lo in range(0, len(a), 2048))


def _refined(raw: np.ndarray, room: np.ndarray, span: int, first: int) -> np.ndarray | None:
    """The places whose string of span bytes is at another place too; None if the bytes don't bear the buckets out."""
    pointer = np.zeros(len(raw) + 1, np.int64)  # 0 for a place alone in its bucket, which no refinement can bring back
    wide = len(raw).bit_length()
    low = np.uint64((1 << wide) - 1)

    def bucket(keys: np.ndarray, at: np.ndarray, bits: int) -> None:
        """Sorts the places by key, both in one number if they fit; pointers of buckets of two or more, from 1."""
        if not len(at):
            pointer[:] = 0
            return
        if bits + wide <= 64:
            both = np.sort(keys << np.uint64(wide) | np.arange(len(at), dtype=np.uint64))
            ranked, order = both >> np.uint64(wide), (both & low).astype(np.int64)
        else:
            order = np.argsort(keys)
            ranked = keys[order]
        same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
        alive, new = same[1:] | same[:-1], ~same[:-1]
        pointer[:] = 0
        pointer[at[order[alive]]] = np.cumsum(new[alive])

    at = np.flatnonzero(room >= first)
    bucket(Hashes(raw).all(first)[at] & np.uint64((1 << (64 - wide)) - 1), at, 64 - wide)
    length = first
    while length < span:
        step = min(length, span - length)
        at = np.flatnonzero(pointer)
        at = at[room[at] >= length + step]
        later = pointer[at + step]
        at, later = at[later > 0], later[later > 0]
        bits = int(later.max(initial=0)).bit_length()
        bucket((pointer[at] << bits | later).astype(np.uint64), at, wide + bits)
        length += step
    alive = np.flatnonzero(pointer)
    of = pointer[alive]
    stands = np.zeros(len(alive) + 1, np.int64)
    stands[of[::-1]] = alive[::-1]  # the first place of each bucket stands for it
    other = alive != stands[of]
    return alive if _equal(raw, alive[other], stands[of][other], span) else None


def _by_digest(raw: np.ndarray, room: np.ndarray, span: int) -> np.ndarray:
    """The same by a long digest of each string, for the case that hashes of different strings have met."""
    at: dict[bytes, list[int]] = {}
    for p in np.flatnonzero(room >= span).tolist():
        at.setdefault(hashlib.blake2b(raw[p : p + span].tobytes(), digest_size=20).digest(), []).append(p)
    return np.array([p for x in at.values() if len(x) > 1 for p in x], np.int64)


def repeated_windows(raw: np.ndarray, sizes: np.ndarray, span: int = SPAN, first: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece, start and end of every stretch of bytes, within pieces of these sizes, that windows cover which are at another
    place of any piece too."""
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(raw))  # bytes from here to the piece's end
    alive = _refined(raw, room, span, first or -(-span // 4))
    marks = np.zeros(len(raw) + 2, np.int8)
    marks[1 + (_by_digest(raw, room, span) if alive is None else alive)] = 1
    edge = np.diff(marks)  # no window begins in a piece's last bytes, so stretches don't cross pieces
    start, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) - 1
    piece = np.searchsorted(ends, start, side="right")
    begin = ends[piece] - sizes[piece]
    return piece, start - begin, last + span - begin


#: place: a context's start in its text, its windows and flags (copies exist, it is the second copy, its bucket is large).
BYTES = "doc long, print long, context long, bucket long, place long, bytes binary"
REFINED = "doc long, print long, context long, copied boolean, start long, end long"
COPIED, SECOND, HOT = 1, 2, 4


def _place(start: Column, windows: Column, flags: Column) -> Column:
    return F.shiftleft(start.cast("long"), 24).bitwiseOR(F.shiftleft(windows.cast("long"), 3)).bitwiseOR(flags.cast("long"))


def _refine(span: int):
    """The contexts of whole buckets in, their repeated spans out; of contexts with copies, relative to their start."""

    def spans(part: pa.Table) -> pa.RecordBatch:
        text = part.column("bytes").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        piece, start, end = repeated_windows(raw, np.diff(offsets).astype(np.int64), span)
        place = part.column("place").to_numpy()[piece]
        own, copied = place & SECOND == 0, place & COPIED > 0
        base = np.where(copied, 0, place >> 24)
        values = [*[part.column(c).to_numpy()[piece] for c in ("doc", "print", "context")], copied, base + start, base + end]
        return pa.RecordBatch.from_arrays([pa.array(x[own]) for x in values], names=_fields(REFINED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:  # sorted by bucket
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            bucket = held.column("bucket").to_numpy()
            size = np.cumsum(pc.binary_length(held.column("bytes")).to_numpy())
            cuts, begin = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, 0
            for lo, hi in zip(cuts, cuts[1:]):  # up to the next cut it would be too much
                if size[hi - 1] - (size[begin - 1] if begin else 0) > REFINED_BYTES:
                    yield spans(held.slice(begin, lo - begin))
                    begin = lo
            held = held.slice(begin)
        if held is not None and len(held):
            yield spans(held)

    return run


def _read(span: int):
    """The bytes of the wanted contexts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.binary()]
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = []
                keys = [column(part, c).to_pylist() for c in ("doc", "print", "base")]
                wanted = column(part, "wanted")
                fields = zip(*[wanted.flatten().field(c).to_pylist() for c in ("context", "bucket", "place")])
                counts = np.diff(wanted.offsets.to_numpy())
                for text, doc, print_, base, n in zip(utf8(column(part, "text")), *keys, counts.tolist()):
                    for context, bucket, place in islice(fields, n):
                        at, size = (place >> 24) - base, (place >> 3 & 0x1FFFFF) + span - 1
                        if at >= 0 and at + size <= len(text):
                            rows.append((doc, print_, context, bucket, place, text[at : at + size]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=_fields(BYTES))

    return run


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SPANS else df


def _of_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc", "print").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def _found(pieces: DataFrame, span: int, gram: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """doc, print, start and end of what is found in the buckets of these q-grams, and the pieces of buckets too large."""
    spark, one = pieces.sparkSession, F.struct("doc", "print", "start", "windows")
    rows = scratch.stored(pieces.mapInArrow(_runs(span, gram), RUNS), "runs")
    # Most buckets have one window or a few in a row, and go before anything else is shuffled.
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("total"), F.max("several").alias("several")).where("total > 1 or several")
    buckets = scratch.stored(buckets.select("bucket", "total"), "buckets")
    if buckets.count() <= BROADCAST_SPANS:
        rows = rows.join(F.broadcast(buckets.select("bucket")), "bucket", "left_semi").drop("several")
    else:
        rows = with_group(rows, buckets, "bucket", "total").where("total is not null").drop("several", "total")
    rows = scratch.stored(rows, "rows")
    scratch.drop("runs", "buckets")
    contexts = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(one).alias("first"), F.max(one).alias("last"))
    contexts = scratch.stored(contexts.withColumn("context", F.monotonically_increasing_id()), "contexts")
    sizes = contexts.groupBy("bucket").agg(F.count("*").alias("different")).where(F.col("different") > (LARGE if gram < span else 1 << 40))
    hot = scratch.stored(sizes, "hot")  # of more than LARGE contexts each, so few against all contexts
    some = not hot.isEmpty()
    contexts = with_group(contexts, hot, "bucket", "different") if some else contexts.withColumn("different", F.lit(None).cast("long"))
    # Two copies of a context that has more than one are read, else its only one; of large buckets one.
    large, flag = F.col("different").isNotNull(), lambda c, bit: F.when(c, bit).otherwise(0)
    flags = flag(F.col("n") > 1, COPIED) + flag(large, HOT)
    copies = F.array(F.struct("first.*", flags.alias("flags")))
    copies = F.when((F.col("n") > 1) & ~large, F.concat(copies, F.array(F.struct("last.*", (flags + SECOND).alias("flags"))))).otherwise(copies)
    each = contexts.select("context", "bucket", F.explode(copies).alias("at"))
    want = F.struct("context", "bucket", _place(F.col("at.start"), F.col("at.windows"), F.col("at.flags")).alias("place"))
    wanted = scratch.stored(each.groupBy(F.col("at.doc").alias("doc"), F.col("at.print").alias("print")).agg(F.collect_list(want).alias("wanted")), "wanted")
    count, size = wanted.agg(F.sum(F.size("wanted")), F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda a, x: a + F.shiftright(x["place"], 3).bitwiseAND(0x1FFFFF) + span))).first()
    read = pieces.join(_sized(wanted, count or 0), ["doc", "print"]).mapInArrow(_read(span), BYTES)
    is_hot = F.col("place").bitwiseAND(HOT) > 0
    if some:
        read = scratch.stored(read, "bytes")
    parts = max(shuffle_partitions(spark), math.ceil((size or 0) / TASK_BYTES))
    refined = scratch.stored(read.where(~is_hot).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_refine(span), REFINED), "refined")
    single = refined.where("not copied").select("doc", "print", "start", "end")
    copied = refined.where("copied").groupBy("context").agg(F.collect_list(F.struct("start", "end")).alias("of"))
    copied = contexts.where("n > 1 and different is null").join(copied, "context").select(*KEY, "n", "of")
    if some:  # the copies of a context are whole
        end = F.col("first.windows") + span - 1
        copied = copied.unionByName(contexts.where("n > 1 and different is not null").select(*KEY, "n", F.array(F.struct(F.lit(0).cast("long").alias("start"), end.cast("long").alias("end"))).alias("of")))
    copied = scratch.stored(copied, "copied")
    copied = with_group(rows, copied, KEY, "n").where("of is not null").select("doc", "print", F.col("start").cast("long").alias("base"), F.explode("of").alias("x"))
    found = single.unionByName(copied.select("doc", "print", (F.col("base") + F.col("x.start")).alias("start"), (F.col("base") + F.col("x.end")).alias("end")))
    if not some:
        return found, None
    return found, read.where(is_hot).select("doc", "print", F.shiftright("place", 24).alias("base"), F.col("bytes").alias("text"))


def repeated_spans(pieces: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc, print and spans (start, end; sorted) of every text with a string of span bytes that is elsewhere too.

    pieces: doc, print, base and text: a text or parts of it, where in it they begin. Parts of a text may overlap by less
    than span bytes.
    """
    found = None
    with Scratch(pieces.sparkSession) as scratch:
        while pieces is not None:
            more, pieces = _found(pieces, span, gram, scratch)
            found = more if found is None else found.unionByName(more)
            gram += -(-(span - gram) // 2)
        return stored(_of_text(found), "spans")


def _merged(spans: list[dict]) -> list[list[int]]:
    """Overlapping and touching spans, sorted by start, as one."""
    out: list[list[int]] = []
    for x in spans or []:
        if out and x["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["end"])
        else:
            out.append([x["start"], x["end"]])
    return out


def _parts(span: int):
    """The parts of texts that spans cover without a break over at least `span` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, rows = b.slice(lo, 256), []
                keys = [column(part, c).to_pylist() for c in ("doc", "print", "spans")]
                for text, doc, print_, spans in zip(utf8(column(part, "text")), *keys):
                    rows += [(doc, print_, x, text[x:y]) for x, y in _merged(spans) if y - x >= span]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int64()] * 3 + [pa.binary()])], names=["doc", "print", "base", "text"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part, rows = b.slice(lo, 512), []
            keys = [column(part, c).to_pylist() for c in ("doc_id", "spans", "repeats")]
            for raw, doc, spans, repeats in zip(utf8(column(part, "text")), *keys):
                raw, at, kept, removed, spans = raw or b"", 0, [], 0, _merged(spans)
                for x, y in spans:
                    kept.append(raw[at:x])
                    removed, at = removed + y - x, y
                kept = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), removed, len(spans), hashlib.sha256(kept).hexdigest(), repeats, kept))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats", "kept"])


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, passage: int = PASSAGE, short: int = SHORT_GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats, kept (the remaining bytes).

    A byte goes if a string of `span` bytes that covers it also starts anywhere else in the input; repeats tells whether
    any string of `passage` bytes does, which may be less than what is removed. Null and shorter texts have no such string.
    Repeated rows are other places, so their strings go from each; a null doc_id is a document like any other. No rows
    give no rows. Columns other than doc_id and text are ignored.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc.alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"), F.col("text").cast("string").alias("text"))
    n_spans = lambda df: df.agg(F.sum(F.size("spans"))).first()[0] or 0
    passages = repeated_spans(docs.select("doc", "print", F.lit(0).cast("long").alias("base"), F.col("text").cast("binary").alias("text")), passage, short)
    parts = docs.select("doc", "print", "text").join(_sized(passages, n_spans(passages)), ["doc", "print"]).mapInArrow(_parts(span), "doc long, print long, base long, text binary")
    spans = repeated_spans(stored(parts, "span-parts"), span, gram)
    both = passages.select("doc", "print", F.lit(True).alias("repeats")).join(spans, ["doc", "print"], "left")
    both = stored(both, "span-both")
    rows = docs.join(_sized(both, n_spans(both) + both.count()), ["doc", "print"], "left").select("doc_id", "text", "spans", F.coalesce("repeats", F.lit(False)).alias("repeats"))
    return rows.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")
