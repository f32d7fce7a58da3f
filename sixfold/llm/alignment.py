"""Alignment of two tokenizers' tokens by merging their ends along a merge path.

Both token sequences cut the same bytes, so their ends are two sorted lists, and every end of their merge closes one
overlap of a token of A with a token of B. A task that has encoded a document cuts the merge at equally spaced diagonals,
each found by a binary search, into pieces of WORK ends; a piece knows where in both sequences it begins and carries the
tokens that are open at its end, so it can be merged without the others, wherever it lies. Pieces are a table. One pass
over it counts the links of each pair of ids, one looks the counts up and sums them, and where a document has several
pieces, the groups at their borders are stitched in the order of the pieces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, light, stored, table, tokenizer_path
from .packing import Ids

#: Ends of a piece; the tokens of a document below it are one piece.
WORK = 16_384
#: Tokens that a task merges at once, and bytes of pieces that it hands on at once.
AT_ONCE, HANDED = 500_000, 4_000_000
#: The pairs of ids with the most links that are broadcast with their counts (16 bytes each); all others are joined by a shuffle.
HOT_PAIRS = 500_000
PIECE = "row long, doc_id long, piece int, pieces int, a binary, b binary, own_a int, own_b int, ahead int"
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
SCORED = "row long, doc_id long, piece int, pieces int, " + ", ".join(f"{c} long" for c in COUNTS) + ", sha string, closed boolean, head_a string, head_b string, mid string, tail_a string, tail_b string, cold array<bigint>, times array<bigint>"


class ByteLevel:
    """Tokenizer A: a byte-level tokenizers file. ids of a text with a space before it, and each id's bytes."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.encode = Ids(path).encode
        with open(path, encoding="utf-8") as f:
            ranks = Ids._ranks(json.load(f)["model"]["vocab"], pre_tokenizers.ByteLevel.alphabet())
        self.bytes = [b""] * (1 + max(ranks.values()))
        for x, i in ranks.items():
            self.bytes[i] = x

    def ids(self, text: str) -> list[int]:
        return self.encode(" " + text)


class Pieces:
    """Tokenizer B: a sentencepiece model, which itself sets a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        spelled = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(spelled)]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


def split(a: np.ndarray, b: np.ndarray, at: int) -> tuple[int, int]:
    """How many of the sorted ends a and b are among the first `at` of their merge, a's first of equals.

    The diagonal i + j = at is searched for the place where a[i - 1] <= b[j] and b[j - 1] < a[i]; equal ends aren't parted.
    """
    lo, hi = max(0, at - len(b)), min(at, len(a))
    while lo < hi:
        mid = (lo + hi) // 2
        if a[mid] <= b[at - mid - 1]:
            lo = mid + 1
        else:
            hi = mid
    i, j = lo, at - lo
    return i, j + bool(i and j < len(b) and a[i - 1] == b[j])


def cut(a: np.ndarray, b: np.ndarray, work: int) -> list[tuple[int, int]]:
    """The places (i, j) at which the merge is cut into pieces of about `work` ends, the first and last included."""
    return [(0, 0), *(split(a, b, at) for at in range(work, len(a) + len(b), work)), (len(a), len(b))]


def _width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _lengths(kind) -> np.ndarray:
    return np.array([len(x) for x in kind.bytes], np.int64)


def _encoded(path_a: str, path_b: str, work: int):
    """Documents as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = ByteLevel(path_a), Pieces(path_b)
        lengths = [_lengths(s) for s in sides]
        kinds = [_width(len(s.bytes)) for s in sides]
        names = [x.split()[0] for x in PIECE.split(", ")]
        rows: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            texts = column(batch, "text")
            for k, (row, doc) in enumerate(zip(column(batch, "row").to_pylist(), column(batch, "doc_id").to_pylist())):
                text = texts[k].as_py()
                found = [s.ids(text) for s in sides] if text else [[], []]
                if text:
                    whole = (" " + text).encode()
                    if any(b"".join(map(s.bytes.__getitem__, x)) != whole for s, x in zip(sides, found)):
                        found = [[], []]
                a, b = (np.array(x, kind) for x, kind in zip(found, kinds))
                ends = [np.cumsum(n[x]) for n, x in zip(lengths, (a, b))]
                cuts = cut(*ends, work) if len(a) + len(b) > work else [(0, 0), (len(a), len(b))]
                for p, ((i, j), (i2, j2)) in enumerate(zip(cuts, cuts[1:])):
                    starts = [int(e[x - 1]) if x else 0 for e, x in zip(ends, (i, j))]
                    rows.append((row, doc, p, len(cuts) - 1, a[i : i2 + 1].tobytes(), b[j : j2 + 1].tobytes(), i2 - i, j2 - j, starts[0] - starts[1]))
                    held += len(rows[-1][4]) + len(rows[-1][5]) + 64
                if held >= HANDED:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()

    return run


class Merged:
    """Pieces merged at once, each as if alone. A link is a place in A's ids and one in B's; ids include the open tokens."""

    def __init__(self, a: pa.Array, b: pa.Array, own_a: np.ndarray, own_b: np.ndarray, ahead: np.ndarray, lengths: list[np.ndarray]):
        sides = []
        for ids, own, n, start in ((a, own_a, lengths[0], np.maximum(ahead, 0)), (b, own_b, lengths[1], np.maximum(-ahead, 0))):
            kind = _width(len(n))
            parts = [np.frombuffer(x.as_buffer(), kind) for x in ids]
            sizes = np.array([len(x) for x in parts], np.int64)
            sides.append((np.concatenate(parts) if parts else np.zeros(0, kind), own.astype(np.int64), n, start, sizes))
        spans, ends = [], []
        for ids, _, n, start, sizes in sides:  # a token's end in its piece
            at = np.concatenate([[0], np.cumsum(n[ids])])
            first = np.concatenate([[0], np.cumsum(sizes)])
            ends.append(at[1:] - np.repeat(at[first[:-1]] - start, sizes))
            spans.append(at[first[1:]] - at[first[:-1]] + start)
        base = np.concatenate([[0], np.cumsum(np.maximum(*spans) + 1)])[:-1]  # no piece's ends reach the next one's
        self.ids, self.piece, self.own = [], [], []
        for k, (ids, own, _, _, sizes) in enumerate(sides):
            piece = np.repeat(np.arange(len(sizes)), sizes)
            ends[k] = ends[k] + base[piece]
            place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            self.ids.append(ids.astype(np.int64))
            self.piece.append(piece)
            self.own.append(np.flatnonzero(place < own[piece]))
        mine = [e[o] for e, o in zip(ends, self.own)]
        to_b, to_a = np.searchsorted(ends[1], mine[0]), np.searchsorted(ends[0], mine[1])
        tie = ends[1][to_b] == mine[0] if len(to_b) else np.zeros(0, bool)
        new = ends[0][to_a] != mine[1] if len(to_a) else np.zeros(0, bool)
        self.left = np.concatenate([self.own[0], to_a[new]])
        self.right = np.concatenate([to_b, self.own[1][new]])
        self.ties = mine[0][tie]
        #: Of each owned token, how many ties lie before its end: the number of its group.
        self.group = [np.searchsorted(self.ties, m) for m in mine]
        self.link_piece = self.piece[0][self.left]
        self.tie_piece = self.piece[0][self.own[0][tie]]

    def keys(self) -> np.ndarray:
        """The links' pairs of ids, B's id first, so that those of one B id lie together."""
        return self.ids[1][self.right] << 32 | self.ids[0][self.left]


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(column(batch, "own_a").to_numpy().astype(np.int64) + column(batch, "own_b").to_numpy() + 1)
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + AT_ONCE)))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _merged(part: pa.RecordBatch, lengths: list[np.ndarray]) -> Merged:
    return Merged(column(part, "a"), column(part, "b"), *[column(part, c).to_numpy() for c in ("own_a", "own_b", "ahead")], lengths)


def _counted(lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _in_parts(batch):
                keys, n = np.unique(_merged(part, lengths.value).keys(), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

    return run


class Strings:
    """Owned tokens of merged pieces in the order of their groups, each with what stands behind it."""

    def __init__(self, m: Merged, tables: list[np.ndarray]):
        a, b = m.group
        # Groups go on counting from piece to piece: a piece's last tokens may be open, so each piece is a group apart.
        a, b = (g + m.piece[k][m.own[k]] for k, g in enumerate((a, b)))
        self.places = np.arange(len(a)) + np.searchsorted(b, a), np.arange(len(b)) + np.searchsorted(a, b, "right")
        out = np.empty(len(a) + len(b), object)
        for k, g in enumerate((a, b)):
            last = np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
            out[self.places[k]] = tables[k][m.ids[k][m.own[k]] + last * (len(tables[k]) // 2)]
        self.out = out


def _tables(lengths: list[np.ndarray]) -> list[np.ndarray]:
    """Each id with a comma behind it, and then each with the sign that ends its side of a group."""
    return [np.array([f"{i}," for i in range(len(n))] + [f"{i}{end}" for i in range(len(n))], object) for n, end in zip(lengths, "|;")]


def _scored(lengths, known):
    """Counts and digests of pieces; where a document has several, the strings of its ends, which are stitched later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        tables = _tables(lengths.value)
        for batch in batches:
            for part in _in_parts(batch):
                m = _merged(part, lengths.value)
                size, own = len(part), [column(part, c).to_numpy().astype(np.int64) for c in ("own_a", "own_b")]
                link = m.keys()
                at = np.minimum(np.searchsorted(keys, link), max(0, len(keys) - 1))
                hot = keys[at] == link if len(keys) else np.zeros(len(link), bool)
                per_piece = lambda where, w=None: np.bincount(where, w, size)
                n_links = per_piece(m.link_piece)
                n_best = per_piece(m.link_piece[hot], best[at[hot]].astype(float)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(n_links)])
                in_order = np.argsort(m.link_piece, kind="stable")
                sums = np.concatenate([[0], np.cumsum(np.where(hot, counts[at], 0)[in_order] if len(keys) else np.zeros(len(link), np.int64))])
                total = sums[ends[1:]] - sums[ends[:-1]]
                cold, times = [None] * size, [None] * size
                if not hot.all():
                    where, which = m.link_piece[~hot], link[~hot]
                    for p in np.unique(where).tolist():
                        cold[p], times[p] = (x.tolist() for x in np.unique(which[where == p], return_counts=True))
                strings = Strings(m, tables)
                token = np.concatenate([[0], np.cumsum(own[0] + own[1])]).tolist()
                ties = per_piece(m.tie_piece)
                pieces = column(part, "pieces").to_numpy()
                sha, rest = [], {c: [None] * size for c in ("head_a", "head_b", "mid", "tail_a", "tail_b")}
                first = [np.concatenate([[0], np.cumsum(o)]) for o in own]
                before = np.concatenate([[0], np.cumsum(ties)])
                for p in range(size):
                    mine = strings.out[token[p] : token[p + 1]]
                    if pieces[p] == 1:
                        sha.append(hashlib.sha256("".join(mine)[:-1].encode()).hexdigest() if len(mine) else "")
                        continue
                    sha.append(None)
                    groups = [m.group[k][first[k][p] : first[k][p + 1]] - before[p] for k in (0, 1)]
                    ids = [m.ids[k][m.own[k]][first[k][p] : first[k][p + 1]] for k in (0, 1)]
                    front, back = [int(np.searchsorted(g, 1)) for g in groups], [int(np.searchsorted(g, max(1, ties[p]))) for g in groups]
                    for k, side in enumerate("ab"):
                        rest[f"head_{side}"][p] = ",".join(map(str, ids[k][: front[k]].tolist()))
                        rest[f"tail_{side}"][p] = ",".join(map(str, ids[k][back[k] :].tolist()))
                    rest["mid"][p] = "".join(mine[sum(front) : sum(back)])[:-1]
                values = [column(part, c) for c in ("row", "doc_id", "piece", "pieces")]
                values += [pa.array(x.astype(np.int64)) for x in (*own, ties, n_links, n_best, total)]
                values += [pa.array(sha, pa.string()), pa.array(ties > 0), *[pa.array(x, pa.string()) for x in rest.values()]]
                values += [pa.array(x, pa.list_(pa.int64())) for x in (cold, times)]
                yield pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of several pieces, which come in order: a digest over the groups, the open ones joined."""
    names = ["row", "doc_id", *COUNTS, "groups_sha256"]

    def pieces() -> Iterator[dict]:
        for b in batches:
            for i in range(len(b)):
                yield {c: x[0] for c, x in b.slice(i, 1).to_pydict().items()}

    for _, its in groupby(pieces(), lambda r: r["row"]):
        digest, totals, begun = hashlib.sha256(), [0] * len(COUNTS), False
        open_a, open_b = [], []
        for r in its:
            totals = [x + r[c] for x, c in zip(totals, COUNTS)]
            open_a += [r["head_a"]] if r["head_a"] else []
            open_b += [r["head_b"]] if r["head_b"] else []
            if r["closed"]:
                for x in (",".join(open_a) + "|" + ",".join(open_b), r["mid"]):
                    if x:
                        digest.update((";" * begun + x).encode())
                        begun = True
                open_a, open_b = ([x] if x else [] for x in (r["tail_a"], r["tail_b"]))
        values = [r["row"], r["doc_id"], *totals, digest.hexdigest()]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if isinstance(v, str) else pa.int64()) for v in values], names=names)


def _hot(pairs: DataFrame) -> tuple[pa.Table, bool]:
    """The pairs with the most links, HOT_PAIRS at most, and whether they are all: from a histogram of eighths of powers of two."""
    level = F.floor(8 * F.log2("n"))
    sizes = sorted(((r.level, r.n) for r in pairs.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 512 rows at most
    taken, least = 0, None
    for at, n in sizes:
        if taken + n > HOT_PAIRS:
            break
        taken, least = taken + n, at
    return pairs.where(level >= least if least is not None else F.lit(False)).toArrow(), taken == sum(n for _, n in sizes)


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None, work: int = WORK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level tokenizers file, for space and text; B a sentencepiece model that adds the space itself. A link is a
    token of A and one of B whose byte ranges overlap; offsets where both end cut groups. A pair of ids counts the links
    that hold it in all documents: n_best links have the count that is their B id's highest, equals included, and count_sum
    adds up the counts of the links. groups_sha256 digests the groups, `a1,a2|b1;a3|b2,b3` in decimal ids.

    Texts that are null or empty, or whose tokens' bytes aren't space and text, have no tokens: zeros, and '' undigested.
    Rows repeated, or with the same or no doc_id, are answered each and all count. No rows give no rows. Very long texts
    are several pieces. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    paths = tokenizer_a or tokenizer_path(), tokenizer_b or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(rows.mapInArrow(light(_encoded(*paths, work)), PIECE), "align-pieces")
    lengths = spark.sparkContext.broadcast([_lengths(ByteLevel(paths[0])), _lengths(Pieces(paths[1]))])
    counted = pieces.mapInArrow(light(_counted(lengths)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = stored(counted.withColumn("b", F.shiftright("key", 32)), "align-counted")
    highest = counted.groupBy("b").agg(F.max("n").alias("highest"))  # one row for each of B's ids
    pairs = stored(counted.join(F.broadcast(highest), "b").select("key", "n", (F.col("n") == F.col("highest")).alias("best")), "align-pairs")
    hot, all_hot = _hot(pairs)
    order = np.argsort(hot.column("key").to_numpy())
    known = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy()[order] for c in ("key", "n", "best")))
    scored = stored(pieces.mapInArrow(light(_scored(lengths, known)), SCORED), "align-scored")
    several = scored.where("pieces > 1").repartition("row").sortWithinPartitions("row", "piece")
    stitched = several.mapInArrow(light(_stitched), "row long, doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string")
    found = scored.where("pieces = 1").select("row", "doc_id", *COUNTS, F.col("sha").alias("groups_sha256")).unionByName(stitched)
    if not all_hot:
        each = scored.where("cold is not null").select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("key"), F.col("x.times").alias("times"))
        more = each.join(pairs, "key").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        found = found.join(more, "row", "left")
        found = found.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    result = stored(found.select("doc_id", *COUNTS, "groups_sha256"), "align-result")
    lengths.destroy()
    known.destroy()
    return result


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents", "doc_id", "text"))
