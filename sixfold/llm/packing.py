"""Sum-of-squares online packing of documents into token sequences.

A task packs the documents of its partition in one pass. A level array holds, for every fill below the length of a
sequence, how many open windows have it. What remains of a document after its full windows goes, in one piece, where the
sum of the squared counts grows least. What is still open at the end of the partition goes on to a second pass, which
packs the same way over many partitions' open windows and cuts what remains to full windows, the last ones at powers of
two, so that no padding is left.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, light, stored, table, tokenizer_path

LENGTH = 1024
END = (0).to_bytes(4, "little")
#: How the byte-level vocabulary cuts a text before its merges, as its library documents it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Ids:
    """Token ids of texts as little-endian 32-bit bytes, by the merges of a tokenizers file.

    A plain byte-level vocabulary, whose ids follow the order of its merges, is run by tiktoken: the same ids in less than
    half the time, and nothing is remembered from text to text. Any other file is run by tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        ids, merges = kind["model"].get("vocab", {}), kind["model"].get("merges", [])
        ranks = self._ranks(ids, pre_tokenizers.ByteLevel.alphabet())
        made = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges] if kind["model"]["type"] == "BPE" else []
        cut = kind.get("pre_tokenizer") or {}
        plain = made and made == sorted(made) and len(ranks) == len(ids) and not kind.get("normalizer") and not kind.get("truncation")
        plain = plain and not any(kind["model"].get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if plain and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space"):
            import tiktoken

            self.encode = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _ranks(ids: dict[str, int], alphabet: list[str]) -> dict[bytes, int]:
        """The vocabulary by its bytes: printable Latin-1 stands for itself, the other bytes, in order, for what follows 255."""
        moved = [b for b in range(256) if chr(b) not in alphabet]
        byte = {c: ord(c) if ord(c) < 256 else moved[ord(c) - 256] for c in alphabet}
        return {bytes(map(byte.__getitem__, x)): i for x, i in ids.items() if all(c in byte for c in x)}

    def of(self, texts: list[str]) -> list[bytes]:
        return [np.array(self.encode(x), "<u4").tobytes() for x in texts]


class Levels:
    """Open windows by their fill. counts[0] stands for windows not yet begun and stays 0."""

    def __init__(self, length: int):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(length)]

    def level_for(self, n: int) -> int:
        """The fill that a piece of n joins: the one whose move changes the sum of squared counts least; the fullest of equals."""
        counts, top = self.counts, self.length - n
        # A window leaves level h (1 - 2 N[h]) and enters h + n (1 + 2 N[h + n]); full windows are no longer counted.
        change = 2 + 2 * (counts[n : self.length + 1] - counts[: top + 1])
        change[0] = 1 + 2 * counts[n]
        change[top] = 1 - 2 * counts[top] if top else 0
        possible = counts[: top + 1] > 0
        possible[0] = True
        levels = np.flatnonzero(possible)
        best = change[levels]
        return int(levels[len(best) - 1 - int(np.argmin(best[::-1]))])


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Partitions whose open windows one task of the second pass goes on with.
CARRIED = 32


def _tail_cuts(total: int, length: int) -> list[int]:
    """Full windows, then powers of two."""
    out = [length] * (total // length)
    return out + [1 << b for b in range(length.bit_length(), -1, -1) if (total % length) >> b & 1]


class Packing:
    """The open windows of a task. rows gathers what is closed; a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, length: int, serial: int):
        self.length, self.serial, self.levels = length, serial, Levels(length)
        self.held: dict[int, list[tuple]] = {}  # the pieces of open windows, with their ids
        self.rows: list[tuple] = []

    def put(self, piece: tuple, sequence: int | None, offset: int | None, ids: bytes | None = None) -> None:
        self.rows.append((piece[0], piece[1], len(piece[2]) // 4, zlib.crc32(piece[2]), piece[3], sequence, offset, ids))

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        """Full windows close at once; the rest joins the level that sum of squares chooses."""
        length, levels = self.length, self.levels
        while len(ids) >= 4 * length:
            self.put((doc, start, ids[: 4 * length], total), self.serial, 0)
            self.serial += 1
            start, ids = start + length, ids[4 * length :]
        n = len(ids) // 4
        if not n:
            return
        at = levels.level_for(n)
        if at:
            sequence = levels.open[at].pop()
            levels.counts[at] -= 1
        else:
            sequence, self.serial = self.serial, self.serial + 1
            self.held[sequence] = []
        self.held[sequence].append((doc, start, ids, total))
        if at + n < length:
            levels.open[at + n].append(sequence)
            levels.counts[at + n] += 1
            return
        offset = 0
        for piece in self.held.pop(sequence):
            self.put(piece, sequence, offset)
            offset += len(piece[2]) // 4

    def left(self) -> list[tuple]:
        return [p for fill in range(self.length - 1, 0, -1) for sequence in self.levels.open[fill] for p in self.held[sequence]]

    def carry(self) -> None:
        """Hands the pieces of open windows on, with their ids and without a sequence."""
        for piece in self.left():
            self.put(piece, None, None, piece[2])

    def cut(self) -> None:
        """Cuts what is open to full windows, the last ones at powers of two."""
        pieces = self.left()
        cuts = iter(_tail_cuts(sum(len(p[2]) // 4 for p in pieces), self.length))
        room = offset = 0
        for doc, start, ids, total in pieces:
            while ids:
                if not room:
                    room, offset, self.serial = next(cuts), 0, self.serial + 1
                n = min(room, len(ids) // 4)
                self.put((doc, start, ids[: 4 * n], total), self.serial - 1, offset)
                start, ids, room, offset = start + n, ids[4 * n :], room - n, offset + n

    def flushed(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        values = list(zip(*self.rows)) if self.rows else [[]] * (len(names) + 1)
        self.rows = []
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in values[:-1]], pa.array(values[-1], pa.binary())], names=[*names, "ids"])


def _pack_texts(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packing = Ids(path), Packing(length, TaskContext.get().partitionId() << 36)
        for batch in batches:
            docs, texts = column(batch, "doc_id"), column(batch, "text")
            for lo in range(0, len(docs), 256):
                part = [x or "" for x in texts.slice(lo, 256).to_pylist()]
                for doc, ids in zip(docs.slice(lo, 256).to_pylist(), ids_of.of(part)):
                    packing.add(doc, 0, ids + END, len(ids) // 4 + 1)
                yield packing.flushed()
        packing.carry()
        yield packing.flushed()

    return run


def _pack_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packing = Packing(length, TaskContext.get().partitionId() << 36 | 1 << 35)  # none of the first pass's numbers
        for batch in batches:
            for piece in zip(*[column(batch, c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]):
                packing.add(*piece)
            yield packing.flushed()
        packing.cut()
        yield packing.flushed()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and a closing id 0; null and empty texts are that id alone. Every id is in one piece.
    Sequences have `length` ids, except the last of a task of the second pass, which have a smaller power of two, so none
    needs padding. Repeated rows and null doc_ids are packed like any row; no rows give no rows. Sequence ids are unique,
    not consecutive. Each task packs its own rows and nothing is shuffled; windows still open at its end are packed in a
    second pass together with those of CARRIED - 1 others. Columns other than doc_id and text are ignored.
    """
    path = tokenizer or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = stored(docs.mapInArrow(light(_pack_texts(path, length)), SCHEMA + ", ids binary"), "packing")
    left = first.where("sequence_id is null").select("doc_id", "start", "ids", "doc_tokens")
    left = left.coalesce(max(1, left.rdd.getNumPartitions() // CARRIED)).mapInArrow(light(_pack_pieces(length)), SCHEMA + ", ids binary")
    return first.where("sequence_id is not null").unionByName(left).drop("ids")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
