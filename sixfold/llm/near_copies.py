"""Near copies by SimHash fingerprints of word shingles first, and by prefixes of a common order for what these don't reach.

A fingerprint is made of a text's distinct shingles. Fingerprints that differ in 3 bits or fewer are found through
deletion-variant signatures, as in simhash.py, and each such pair of texts is verified by its exact Jaccard similarity. Texts
of the similarity 0.8 are up to 17 bits apart, so the fingerprints alone would lose links; prefixes find all others.

If two sets reach the similarity, the first n - ceil(0.8 n) + 1 members of each, in any order that both share, have one in
common. The order puts shingles that a sample finds often last, so lines that many documents repeat are in few prefixes;
it decides the work only, never the result. Members of a bucket, the documents with one shingle in their prefixes, are
compared with its first one; a bucket of near copies of one text so makes no pairs among them. Copies that all differ from
the first are compared with a further member, the one that meets most others in all its buckets, as the text that they were
made from does. Where very many members of a bucket are still in different components, they share a passage and little else. Then its shingle goes to the end of the
order, and the documents whose prefixes held it get new ones, which tell them apart by what they don't share. What is left
is compared with the members that are in other components, in tasks that get parts of a bucket.

A parity map of each set's hashes, one bit a member or more, bounds from below in how many members two sets differ, and
rejects most of what meets by chance before whole sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, light, shuffle_partitions, stored, utf8, with_group
from .simhash import SEED, components, links

#: Words of a shingle. The similarity is UPPER / LOWER = 0.8, in whole numbers so that no pair is lost to rounding.
SHINGLE, UPPER, LOWER = 5, 4, 5
#: Documents sampled, and in how many of them a shingle must be, to find COMMON shingles at most that go last.
SAMPLE, OFTEN, COMMON = 10_000, 4, 200_000
#: Shingles in more than one prefix that Python workers may get at once (8 bytes each), and rows that a join may broadcast.
SHARED, BROADCAST_ROWS = 2_000_000, 200_000
#: A bucket is crowded if so many members are outside its main component. At most CROWDED_MOST shingles, those of the
#: fullest buckets, go to the end of the order (16 bytes each), in at most ROUNDS rounds.
CROWD, CROWDED_MOST, ROUNDS = 256, 500_000, 3
#: While a bucket has more than FEW members outside its main component, one of them is compared with all, TURNS times at most.
FEW, TURNS = 4, 1
#: Members of a bucket that meet in one task; larger buckets are dealt to several.
PART = 500
#: Edges whose components a task finds at once (some 100 bytes each).
FOREST = 500_000


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted hashes of a text's shingles; a text of SHINGLE words or fewer, none too, is one. ASCII rules as in fingerprint()."""
    import xxhash

    words = (text or b"").lower().split()
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: n - SHINGLE])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], np.uint64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(x).view(np.int64) for x in utf8(column(b, "text"))]
        yield pa.RecordBatch.from_arrays([column(b, "row"), pa.array(sets, pa.list_(pa.int64()))], names=["row", "own"])


def parity(own: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of hashes falls on them; as many as members, rounded up to a power of two, 64 at least."""
    wide = max(64, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(wide - 1)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _places(known: np.ndarray, values: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The value of each hash that is known, else 0."""
    if not len(known):
        return np.zeros(len(own), np.int64)
    i = np.minimum(np.searchsorted(known, own), len(known) - 1)
    return np.where(known[i] == own, values[i], 0)


def print_of(own: np.ndarray) -> int:
    """The SimHash of a set of hashes: a bit is 1 if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(own), 65536):
        counts += np.unpackbits(own[lo : lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<i8")[0])


PREFIX = "row long, n int, gs array<long>, map array<long>, fp long"


def _prefixes(common, crowded=None):
    """row, n (size of the set), gs (its prefix in the order), the parity map and the fingerprint. crowded: what goes behind all else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [x.value for x in (common, crowded) if x is not None]
        for b in batches:
            gs, ns, maps, prints = [], [], [], []
            for x in utf8(column(b, "text")):
                own = shingles(x)
                maps.append(parity(own))
                prints.append(print_of(own))
                own = own[np.lexsort((own, *[_places(*order, own) for order in orders]))]
                gs.append(own[: len(own) - -(-UPPER * len(own) // LOWER) + 1].view(np.int64))
                ns.append(len(own))
            yield pa.RecordBatch.from_arrays([column(b, "row"), pa.array(ns, pa.int32()), pa.array(gs, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64())), pa.array(prints, pa.int64())], names=["row", "n", "gs", "map", "fp"])

    return run


def _shared(known):
    """g, row, n and at (the place of g in the prefix) of the prefixes' shingles that are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = known.value
        for b in batches:
            gs = column(b, "gs")
            flat, sizes = gs.flatten().to_numpy(), np.diff(gs.offsets.to_numpy())
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = keys[np.minimum(np.searchsorted(keys, flat), len(keys) - 1)] == flat if len(keys) else np.zeros(len(flat), bool)
            rows, ns = (np.repeat(column(b, c).to_numpy(), sizes)[keep] for c in ("row", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep]), pa.array(rows), pa.array(ns), pa.array(at[keep].astype(np.int32))], names=["g", "row", "n", "at"])

    return run


def _inner(n: Column, at: Column) -> Column:
    """Whether a member can be the shorter one of a pair: its share of what both must have in common leaves a ninth of the set."""
    return (UPPER + LOWER) * (n - at) >= 2 * UPPER * n


def _cell(n: Column) -> Column:
    """A bit for the size: sets that reach the similarity have the same one or neighbouring ones (all beyond 62 are one).

    A cell is a little wider than their sizes can differ, so rounding loses none.
    """
    return F.pow(F.lit(2.0), F.least(F.floor(F.log(n + 0.0) / math.log(1.001 * LOWER / UPPER)), F.lit(62))).cast("long")


def _filled(n: Column, at: Column) -> list[Column]:
    """size, cells (of all members) and inner (of those that can be the shorter one) of a bucket."""
    return [F.count("*").alias("size"), F.bit_or(_cell(n)).alias("cells"), F.bit_or(F.when(_inner(n, at), _cell(n)).otherwise(F.lit(0).cast("long"))).alias("inner")]


#: Whether a bucket can hold a pair: one in the same cell twice, or a shorter member and one a cell above it.
WORTH = "size > 1 and inner <> 0 and (size > bit_count(cells) or (inner & shiftrightunsigned(cells, 1)) <> 0)"


def _members(prefixes: DataFrame, part: DataFrame | None, scratch: Scratch) -> DataFrame:
    """g, row, n, at and component (by part, else the row) of every shingle whose bucket can hold a pair by its members' sizes
    and places, with first (the same of the least row) and size of its bucket."""
    n, at = F.col("n"), F.col("at")
    shared = scratch.stored(prefixes.select("n", F.posexplode("gs").alias("at", "g")).groupBy("g").agg(*_filled(n, at)).where(WORTH).select("g"), "shared")
    if shared.count() <= SHARED:  # most shingles of prefixes are in one document only and go before anything else is shuffled
        known = prefixes.sparkSession.sparkContext.broadcast(np.sort(shared.toArrow().column("g").to_numpy()))
        members = scratch.stored(prefixes.select("row", "n", "gs").mapInArrow(light(_shared(known)), "g long, row long, n int, at int"), "repeated")
        known.destroy()
    else:
        members = prefixes.select("row", "n", F.posexplode("gs").alias("at", "g"))
    if part is not None:
        members = scratch.stored(members.join(part, "row", "left"), "repeated")
    members = members.withColumn("component", F.col("row") if part is None else F.coalesce("component", "row"))
    groups = members.groupBy("g").agg(F.min(F.struct("row", "n", "at", "component")).alias("first"), *_filled(n, at)).where(WORTH).drop("cells", "inner")
    out = scratch.stored(with_group(members, scratch.stored(groups, "buckets"), "g", "size").where("size is not null"), "members")
    scratch.drop("shared", "repeated", "buckets")
    return out


def _common(docs: DataFrame):
    """Broadcast sorted hashes, and counts, of the shingles that a sample finds often."""
    total = max(1, docs.count())
    sample = docs.where(F.pmod(F.xxhash64("row"), F.lit(total)) < SAMPLE).mapInArrow(light(_sets), "row long, own array<long>")
    found = sample.select(F.explode("own").alias("g")).groupBy("g").count().where(F.col("count") >= OFTEN)
    t = found.orderBy(F.desc("count"), "g").limit(COMMON).toArrow()
    known, often = t.column("g").to_numpy().astype(np.int64).view(np.uint64), t.column("count").to_numpy()
    order = np.argsort(known)
    return docs.sparkSession.sparkContext.broadcast((known[order], often[order]))


def _possible(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of n and m members can reach the similarity if the first that they share has these places."""
    return (UPPER + LOWER) * (1 + F.least(n - at - 1, m - to - 1)) >= UPPER * (n + m)


def _folded(m: Column, n: Column) -> Column:
    """A map of twice n words as one of n."""
    return F.when(F.size(m) == n, m).otherwise(F.zip_with(F.slice(m, 1, n), F.slice(m, n + 1, n), lambda x, y: x.bitwiseXOR(y)))


def _apart(a: Column, b: Column) -> Column:
    """In how many members two sets differ at least, by their maps; sizes differ by a factor below two."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(_folded(a, n), _folded(b, n), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _by_maps(pairs: DataFrame, maps: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose maps leave the similarity possible."""
    pairs = scratch.stored(pairs, "met")
    if pairs.isEmpty():
        return pairs
    sizes = pairs.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").count()
    maps = scratch.stored(maps.join(sizes, "row"), "maps")
    for end in ("a", "b"):
        pairs = with_group(pairs, maps.select(F.col("row").alias(end), F.col("n").alias(f"n_{end}"), F.col("map").alias(f"map_{end}"), "count"), end, "count").drop("count")
    # J >= u / l means that u + l times the difference is at most l - u times the sum of both sizes.
    both, low = F.col("n_a") + F.col("n_b"), LOWER * F.least("n_a", "n_b") >= UPPER * F.greatest("n_a", "n_b")
    kept = scratch.stored(pairs.where(low & ((UPPER + LOWER) * _apart(F.col("map_a"), F.col("map_b")) <= (LOWER - UPPER) * both)).select("a", "b"), "pairs")
    scratch.drop("met", "maps")
    return kept


MEMBER = "g long, slot int, row long, n int, at int, component long, map array<long>, one boolean"


def _near(rows: dict[str, np.ndarray], maps: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of members their maps leave possible."""
    wide = np.array([len(m) for m in maps])
    i, j = np.where(wide[i] <= wide[j], i, j), np.where(wide[i] <= wide[j], j, i)
    ok = np.zeros(len(i), bool)
    for a, b in set(zip(wide[i].tolist(), wide[j].tolist())):
        at = np.flatnonzero((wide[i] == a) & (wide[j] == b))
        for part in np.array_split(at, max(1, len(at) * b // 500_000)):
            x, y = np.stack([maps[k] for k in i[part]]), np.stack([maps[k] for k in j[part]])
            y = y if a == b else y[:, :a] ^ y[:, a : 2 * a]
            apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            ok[part] = (UPPER + LOWER) * apart <= (LOWER - UPPER) * (rows["n"][i[part]] + rows["n"][j[part]])
    return ok


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of members of one slot that may have the similarity and are in different components: each `one` with the others.

    Members are compared by their places, sizes and maps here, so that only what passes becomes a row.
    """
    names = [x.split()[0] for x in MEMBER.split(", ")]

    def pairs(rows: dict[str, np.ndarray], maps: list[np.ndarray]) -> list[np.ndarray]:
        left, right = np.flatnonzero(rows["one"]), np.flatnonzero(~rows["one"])
        n, rest, found = rows["n"], rows["n"] - rows["at"] - 1, []
        for block in np.array_split(left, max(1, len(left) * len(right) // 1_000_000)) if len(left) and len(right) else []:
            x, y = block[:, None], right[None, :]
            both = (rows["component"][x] != rows["component"][y]) & (LOWER * np.minimum(n[x], n[y]) >= UPPER * np.maximum(n[x], n[y]))
            both &= (UPPER + LOWER) * (1 + np.minimum(rest[x], rest[y])) >= UPPER * (n[x] + n[y])
            i, j = np.nonzero(both)
            if len(i):
                i, j = block[i], right[j]
                ok = _near(rows, maps, i, j)
                found.append(np.stack([rows["row"][i[ok]], rows["row"][j[ok]]], axis=1))
        return found

    def met(part: pa.Table) -> pa.RecordBatch:
        """All slots of a table, whole ones; its columns are read once."""
        rows = {c: part.column(c).to_numpy().astype(bool if c == "one" else np.int64) for c in names if c != "map"}
        maps = part.column("map").combine_chunks()
        maps = maps.chunk(0) if isinstance(maps, pa.ChunkedArray) else maps
        offsets, flat = maps.offsets.to_numpy(), maps.values.to_numpy().view(np.uint64)
        new = (np.diff(rows["g"]) != 0) | (np.diff(rows["slot"]) != 0)
        cuts, found = [0, *(np.flatnonzero(new) + 1).tolist(), len(part)], [np.zeros((0, 2), np.int64)]
        for lo, hi in zip(cuts, cuts[1:]):
            found += pairs({c: x[lo:hi] for c, x in rows.items()}, [flat[offsets[k] : offsets[k + 1]] for k in range(lo, hi)])
        both = np.concatenate(found)
        both = np.unique(np.stack([both.min(axis=1), both.max(axis=1)], axis=1), axis=0) if len(both) else both
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    held: pa.Table | None = None
    for b in batches:  # sorted by bucket and slot
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        g, slot = held.column("g").to_numpy(), held.column("slot").to_numpy()
        ends = np.flatnonzero((g[1:] != g[:-1]) | (slot[1:] != slot[:-1])) + 1
        if len(ends):
            yield met(held.slice(0, int(ends[-1])))
            held = held.slice(int(ends[-1]))
    if held is not None and len(held):
        yield met(held)


def _linked(pairs: DataFrame, docs: DataFrame, maps: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity; maps: None where pairs have been held against them."""
    pairs = scratch.stored(pairs, "pairs") if maps is None else _by_maps(pairs, maps, scratch)
    if pairs.isEmpty():
        return pairs
    sizes = scratch.stored(pairs.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").count(), "sizes")
    few = F.broadcast(sizes.select("row")) if sizes.count() <= BROADCAST_ROWS else sizes.select("row")
    needed = docs.join(few, "row", "left_semi").mapInArrow(light(_sets), "row long, own array<long>")
    sets = scratch.stored(needed.join(sizes, "row"), "sets")
    for end in ("a", "b"):
        pairs = with_group(pairs, sets.select(F.col("row").alias(end), F.col("own").alias(f"own_{end}"), "count"), end, "count").drop("count")
    both = F.size(F.array_intersect("own_a", "own_b"))
    edges = scratch.stored(pairs.where((UPPER + LOWER) * both >= UPPER * (F.size("own_a") + F.size("own_b"))).select("a", "b"), "edges")
    scratch.drop("pairs", "sizes", "sets")
    return edges


def near_copies(docs: DataFrame) -> DataFrame:
    """row and component (the least row linked, however far) of every row that has a near copy. docs: row (unique long) and text.

    Texts of SHINGLE words or fewer, null and empty ones too, are one shingle, so those with equal words are copies. No rows
    give no rows. Very long texts are read whole.
    """
    with Scratch(docs.sparkSession, tidy=True) as scratch:
        return stored(_near_copies(docs.select("row", "text"), scratch), "near-copies")


def _parted(members: DataFrame, part: DataFrame | None, scratch: Scratch) -> DataFrame:
    """members with the component that each is in by part, its own row if in none."""
    joined = members.select("g", "row", "n", "at", *(["component"] if part is None else []))
    if part is not None:
        joined = joined.join(part, "row", "left").withColumn("component", F.coalesce("component", "row"))
    return scratch.stored(joined, "parted")


def _open(parted: DataFrame, scratch: Scratch) -> DataFrame:
    """g, main (its largest component), size, others (members outside of it), cells and inner of buckets with more than one component."""
    each = parted.groupBy("g", "component").agg(*_filled(F.col("n"), F.col("at")))
    most = F.max("size").alias("most")
    by_g = each.groupBy("g").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"), most, F.bit_or("cells").alias("cells"), F.bit_or("inner").alias("inner"))
    return scratch.stored(by_g.where("most < size").select("g", "main", "size", (F.col("size") - F.col("most")).alias("others"), "cells", "inner"), "open")


def _meeting(parted: DataFrame, opened: DataFrame) -> DataFrame:
    """The members of opened buckets, with main and size, that their bucket's sizes and places leave a partner.

    A member that can't be the shorter one needs one that can, in its cell or the one below; any other one needs a neighbour,
    or a cell that holds two.
    """
    inside = with_group(parted, opened.drop("others"), "g", "size").where("main is not null")
    cell = _cell(F.col("n"))
    beside = cell.bitwiseOR(F.shiftleft(cell, 1)).bitwiseOR(F.shiftrightunsigned(cell, 1))
    around = (F.col("cells").bitwiseAND(beside).bitwiseAND(F.bitwise_not(cell)) != 0) | (F.col("size") > F.bit_count("cells"))
    below = F.col("inner").bitwiseAND(cell.bitwiseOR(F.shiftrightunsigned(cell, 1))) != 0
    return inside.where(F.when(_inner(F.col("n"), F.col("at")), around).otherwise(below)).drop("cells", "inner")


def _most(opened: DataFrame) -> int:
    """The most members that an opened bucket has outside its main component."""
    return opened.agg(F.max("others").alias("m")).first().m or 0


def _pivoted(parted: DataFrame, opened: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b): in each opened bucket, one member outside the main component with all that are in other components.

    The member is the one whose opened buckets hold most in all, the least row among equals.
    """
    inside = scratch.stored(with_group(parted, opened.select("g", "main", "size"), "g", "size").where("main is not null"), "inside")
    weight = inside.groupBy("row").agg(F.sum("size").alias("weight"))
    apart = inside.where("component <> main").join(weight, "row")
    pivot = apart.groupBy("g", "size").agg(F.max_by(F.struct("row", "n", "at", "component"), F.struct("weight", -F.col("row"))).alias("pivot"))
    each = with_group(inside.drop("main", "size"), scratch.stored(pivot, "pivots"), "g", "size").where(F.col("pivot").isNotNull() & (F.col("component") != F.col("pivot.component")))
    each = each.where(_possible(F.col("n"), F.col("at"), F.col("pivot.n"), F.col("pivot.at")))
    return each.select(F.least("row", "pivot.row").alias("a"), F.greatest("row", "pivot.row").alias("b")).distinct()


def _fullest(crowded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and sizes of the crowded buckets' shingles; of more than CROWDED_MOST those of the fullest ones."""
    level = F.floor(8 * F.log2("others"))
    taken, least = 0, None
    for r in sorted(crowded.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # 512 rows at most
        if taken + r["count"] > CROWDED_MOST:
            break
        taken, least = taken + r["count"], r.level
    t = crowded.where(level >= least if least is not None else F.lit(False)).select("g", "others").toArrow()
    known, others = t.column("g").to_numpy().view(np.uint64), t.column("others").to_numpy()
    order = np.argsort(known)
    return known[order], others[order]


def _by_prints(prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b): the least rows of fingerprints that are linked, and all rows of a fingerprint with its least one."""
    rows = prefixes.select("fp", "row")
    least = stored(rows.groupBy("fp").agg(F.min("row").alias("least"), F.count("*").alias("size")), "near-prints")
    near = links(least.select("fp"))
    ends = [least.select(F.col("fp").alias(end), F.col("least").alias(f"row_{end}")) for end in ("a", "b")]
    across = near.join(ends[0], "a").join(ends[1], "b").select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
    same = with_group(rows, least.where("size > 1"), "fp", "size").where("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b"))
    return across.unionByName(same)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), sorted, and the least node that each reaches by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        least = np.minimum(root[i], root[j])
        for end in (i, j):
            np.minimum.at(root, root[end], least)
        while (root[root] != root).any():
            root = root[root]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return nodes, nodes[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and root (the least node that it reaches) by the edges of each FOREST in a task: a node comes once for each."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        nodes, roots = _roots(*np.concatenate(held, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    held: list[np.ndarray] = []
    for b in batches:
        held.append(np.stack([column(b, "a").to_numpy(), column(b, "b").to_numpy()]))
        if sum(x.shape[1] for x in held) >= FOREST:
            yield rows(held)
            held = []
    if held:
        yield rows(held)


def _joined(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (the least node that it reaches) of every node of the edges (a, b).

    Tasks make forests of the edges that they read, and a node's roots in different forests are the edges that are left.
    A node has a row for each forest at most, however many edges it has, so no key is hot. Where edges hardly grow fewer
    that way (long chains dealt over many tasks), alternating stars do the rest.
    """
    levels, left = [], None
    while True:
        found = edges.mapInArrow(light(_forests), "node long, root long").groupBy("node").agg(F.min("root").alias("component"), F.collect_set("root").alias("roots"))
        levels.append(scratch.stored(found.withColumn("roots", F.when(F.size("roots") > 1, F.col("roots"))), "forests"))
        several = levels[-1].where("roots is not null")
        edges = several.select(F.explode("roots").alias("a"), F.col("component").alias("b")).where("a <> b")
        before, left = left, edges.count()
        if not left:
            break
        if before is not None and 2 * left > before:
            levels.append(scratch.stored(components(edges, scratch.stored), "forests"))
            break
    out = levels.pop().select("node", "component")
    while levels:
        roots, below = out.select(F.col("node").alias("component"), F.col("component").alias("to")), levels.pop()
        if out.count() <= BROADCAST_ROWS:
            out = below.join(F.broadcast(roots), "component", "left")
        else:
            sizes = below.groupBy("component").agg(F.count("*").alias("size"))
            out = with_group(below, scratch.stored(roots.join(sizes, "component"), "forests"), "component", "size")
        out = out.select("node", F.coalesce("to", "component").alias("component"))
    return out


def _united(part: DataFrame | None, found: DataFrame, scratch: Scratch) -> DataFrame | None:
    """row and component of all that part, the components so far, and the pairs found link."""
    if found.isEmpty():
        return part
    edges = found.select("a", "b")
    if part is not None:
        edges = edges.unionByName(part.where("row <> component").select(F.col("component").alias("a"), F.col("row").alias("b")))
    part = scratch.stored(_joined(edges, scratch).select(F.col("node").alias("row"), "component"), "part")
    scratch.drop("forests", "stars")
    return part


def _near_copies(docs: DataFrame, scratch: Scratch) -> DataFrame:
    sc, common = docs.sparkSession.sparkContext, _common(docs)
    prefixes = scratch.stored(docs.mapInArrow(light(_prefixes(common)), PREFIX), "prefixes")
    maps = prefixes.select("row", "n", "map")
    part = _united(None, _linked(_by_prints(prefixes), docs, maps, scratch), scratch)
    last = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for turn in range(ROUNDS + 1):
        members = _members(prefixes, part, scratch)
        stars = members.where((F.col("component") != F.col("first.component")) & _possible(F.col("n"), F.col("at"), F.col("first.n"), F.col("first.at")))
        found = _linked(stars.select(F.col("first.row").alias("a"), F.col("row").alias("b")).distinct(), docs, maps, scratch)
        scratch.drop("parted", "open", *[f"parted-{turn - 1}-{k}" for k in range(TURNS)])
        part = _united(part, found, scratch)
        parted = _parted(members, part, scratch)
        scratch.drop("members")
        opened = _open(parted, scratch)
        for more in range(TURNS):
            if _most(opened) <= FEW:
                break
            found = _linked(_pivoted(parted, opened.where(F.col("others") > FEW), scratch), docs, maps, scratch)
            scratch.drop("inside", "pivots")
            if found.isEmpty():
                break
            part = _united(part, found, scratch)
            # What isn't open any more is done with, unless a new order gives it new members.
            again = parted.drop("component").join(part, "row", "left").withColumn("component", F.coalesce("component", "row"))
            parted = scratch.stored(again, f"parted-{turn}-{more}")
            opened = _open(parted, scratch)
        if turn == ROUNDS or _most(opened) <= CROWD:
            break
        crowded = opened.where(F.col("others") > CROWD)
        known, others = _fullest(crowded)
        fresh = ~np.isin(known, last[0])
        if not fresh.any():
            break
        known, others = np.concatenate([last[0], known[fresh]]), np.concatenate([last[1], others[fresh]])
        last = known[np.argsort(known)], others[np.argsort(known)]
        # Only prefixes that hold such a shingle change in the new order.
        moved = crowded.select("g")
        moved = F.broadcast(moved) if moved.count() <= BROADCAST_ROWS else moved
        rows = scratch.stored(parted.join(moved, "g", "left_semi").select("row").distinct(), f"moved-{turn}")
        few = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
        behind = sc.broadcast(last)
        again = scratch.stored(docs.join(few, "row", "left_semi").mapInArrow(light(_prefixes(common, behind)), PREFIX), f"again-{turn}")
        behind.destroy()
        prefixes = prefixes.join(few, "row", "left_anti").unionByName(again)
    common.destroy()
    across = _meeting(parted, opened).withColumn("slots", F.ceil(F.col("size") / PART).cast("int"))
    across = scratch.stored(across, "across")
    scratch.drop("parted", "open")
    across = across.join(maps.select("row", "map"), "row")
    slot = {True: F.explode(F.sequence(F.lit(0), F.col("slots") - 1)), False: F.pmod(F.xxhash64("row"), F.col("slots")).cast("int")}
    member = lambda df, one: df.select("g", slot[one].alias("slot"), "row", "n", "at", "component", "map", F.lit(one).alias("one"))
    both = member(across.where("component <> main"), True).unionByName(member(across, False))
    pairs = both.repartition(2 * shuffle_partitions(docs.sparkSession), "g", "slot").sortWithinPartitions("g", "slot").mapInArrow(light(_met), "a long, b long").distinct()
    part = _united(part, _linked(pairs, docs, None, scratch), scratch)
    return part if part is not None else docs.sparkSession.createDataFrame([], "row long, component long")
