"""Embedding of texts by a vocabulary of phrases, given as a table (phrase, ord, v) with unit vectors.

A vocabulary of bounded size is broadcast, and each text is embedded inside its row, without a shuffle. A larger one is
joined with the texts' positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from . import phrases
from .graph import cut
from .lookup import looked_up

TOKEN, BETWEEN = r"[а-яёa-z0-9]+", r"[^а-яёa-z0-9]+"
#: What a token counts that a phrase only holds, or that holds a phrase, and the factor of the fallback's seed.
HELD, SEED_FACTOR = 0.6, 2654435761
#: The name of the texts' key while they are embedded.
KEY = "_text"
#: Phrases of a vocabulary that may be broadcast whole, and numbers in all their vectors.
WHOLE, NUMBERS = 100_000, 4_000_000
#: Bytes of texts that a task works on at once, and different tokens that it keeps from one time to the next.
AT_ONCE, KEPT = 1 << 21, 200_000


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


@dataclass
class Whole:
    """A whole vocabulary: its phrases by rank in the order of ords, an automaton of those that may be the first inside a
    token, and where runs of one, two and three words lead.

    words numbers the words of such phrases; a run is the number that its words' numbers make as digits.
    """

    phrases: list[tuple[str, int]]
    vectors: np.ndarray
    machine: object
    words: dict[str, int]
    runs: list[tuple[np.ndarray, np.ndarray]]


def whole(vocabulary: DataFrame, most: int = WHOLE) -> Whole | None:
    """A vocabulary (phrase, ord, v) of phrases and vectors of one length without nulls; None for others, and for too large ones."""
    size = F.size("v")
    n, least, longest, holes = vocabulary.agg(F.count("*"), F.min(size), F.max(size), F.max(F.coalesce(F.col("phrase") == "", F.lit(True)) | F.col("ord").isNull() | F.col("v").isNull() | F.exists("v", lambda x: x.isNull()))).first()
    if not 0 < n <= most or holes is not False or not least == longest > 0 or n * longest > NUMBERS:
        return None
    rows = vocabulary.toArrow().sort_by([("ord", "ascending"), ("phrase", "ascending")]).combine_chunks()
    known = rows.column("phrase").to_pylist()
    split = [p.split(" ") for p in known]
    words: dict[str, int] = {}
    for parts in split:
        for w in parts if len(parts) <= 3 else []:
            words.setdefault(w, len(words))
    runs = []
    for length in (1, 2, 3):
        of = sorted((sum(words[w] * len(words) ** (length - 1 - i) for i, w in enumerate(parts)), rank) for rank, parts in enumerate(split) if len(parts) == length)
        runs.append((np.array([k for k, _ in of], np.int64), np.array([rank for _, rank in of], np.int64)))
    ranked = [(p, rank) for rank, p in enumerate(known)]
    v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    # A phrase that holds an earlier one is never the first that a token holds.
    every = phrases.automaton(ranked)
    least = phrases.automaton([(p, rank) for p, rank in ranked if min(r for _, (r, _) in every.iter(p)) == rank])
    return Whole(ranked, v, least, words, runs)


class _Numbers(dict):
    """token: number. A token that isn't there gets the next one."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def _longest(t: np.ndarray, left: np.ndarray, w: Whole) -> tuple[np.ndarray, np.ndarray]:
    """For each token the rank of the longest phrase that begins there, or -1, and its size; left: tokens to the text's end."""
    n = len(w.words)
    rank, size, run = np.full(len(t), -1), np.zeros(len(t)), np.zeros(len(t), np.int64)
    at = np.arange(len(t))
    for length, (keys, ranks) in enumerate(w.runs, 1):
        at = at[left[at] >= length]
        at = at[t[at + length - 1] < n]
        run[at] = run[at] * n + t[at + length - 1]
        if len(keys):
            place = np.minimum(np.searchsorted(keys, run[at]), len(keys) - 1)
            hit = keys[place] == run[at]
            rank[at[hit]] = ranks[place[hit]]
            size[at[hit]] = np.where(left[at[hit]] == length, 3, length)
    return rank, size


def _inside(known, partly: bool):
    """Key, hits, mean vector (null without a hit) and, without a hit, the text, for rows of key and lower-cased text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Whole = known.value
        numbers, held = _Numbers(w.words), np.zeros(0, np.int64)

        def embedded(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            nonlocal numbers, held
            n, parts = len(texts), pc.split_pattern_regex(texts, BETWEEN)
            of = parts.flatten().dictionary_encode()
            t = np.array([numbers[x] if x else -1 for x in of.dictionary.to_pylist()], np.int64)[of.indices.to_numpy()]
            text = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(parts), 0).to_numpy())[t >= 0]
            t = t[t >= 0]
            ends = np.cumsum(np.bincount(text, minlength=n))
            rank, size = _longest(t, ends[text] - np.arange(len(t)), w)
            if partly:
                new = phrases.first(list(islice(numbers, len(held), None)), w.machine, w.phrases)
                held = np.append(held, np.array([-1 if r is None else r for r in new], np.int64))
                missing = rank < 0
                rank[missing], size[missing] = held[t[missing]], HELD
                if len(numbers) > max(KEPT, 2 * len(w.words)):
                    numbers, held = _Numbers(w.words), held[: len(w.words)]
            hit = rank >= 0
            text, rank, size = text[hit], rank[hit], size[hit]
            hits, total = np.bincount(text, minlength=n), np.bincount(text, size, n)
            some = hits > 0
            sums = [np.bincount(text, size * of[rank], n)[some] / total[some] for of in w.vectors.T]
            starts = np.append(0, np.cumsum(some * len(sums))).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.stack(sums, 1).ravel()), mask=pa.array(~some))
            rest = texts.take(pa.array(np.arange(n), mask=some))
            return pa.RecordBatch.from_arrays([keys, pa.array(hits.astype(np.int64)), v, rest], names=[KEY, "hits", "v", "text"])

        for b in batches:
            # Whole texts of AT_ONCE bytes or so.
            block = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(b)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    yield embedded(b.column(0).slice(low, high - low), b.column(1).slice(low, high - low))

    return run


def _own(low: Column) -> Column:
    """A unit vector of six numbers that the characters of a lower-cased text seed; a null text counts as empty."""
    total = F.aggregate(F.filter(F.split(F.coalesce(low, F.lit("")), ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a + F.ascii(c))
    seed = ((total % (1 << 31)) * (SEED_FACTOR % (1 << 32))).bitwiseAND(F.lit(vectors.MASK))
    return vectors.normalize(vectors.generated(seed))


def embed(texts: DataFrame, key: str, vocabulary: DataFrame, partly: bool = False, most: int = WHOLE) -> DataFrame:
    """key, hits, v: the weighted mean of the phrases found, made a unit vector; null without a hit.

    At each token the longest phrase of three, two or one tokens counts its size (at a text's end a shorter one counts
    the size it was looked up with, so the last tokens weigh up to three).

    partly: a token without a phrase counts HELD for the first phrase (by ord) that holds it or that it holds, and a text
    without any hit gets a vector of six numbers that its characters seed. A phrase stands once in the vocabulary; without
    partly it needs no ord. A vocabulary of more than `most` phrases is joined instead of broadcast.
    """
    texts = texts.select(F.col(key).alias(KEY), "text")
    if "ord" not in vocabulary.columns:
        vocabulary = vocabulary.withColumn("ord", F.xxhash64("phrase"))
    vocabulary = cut(vocabulary.select("phrase", F.col("ord").cast("long").alias("ord"), "v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform(F.array(F.when(size == 0, F.lit(1.0)).otherwise(size)), lambda n: F.transform("v", lambda x: x / n))[0]
    if (w := whole(vocabulary, most)) is not None:
        schema = T.StructType([*texts.select(KEY).schema.fields, *T.StructType.fromDDL("hits long, v array<double>, text string").fields])
        rows = texts.select(KEY, F.lower("text").alias("text")).mapInArrow(_inside(texts.sparkSession.sparkContext.broadcast(w), partly), schema)
        v = F.when(F.col("hits") > 0, unit).otherwise(_own(F.col("text"))) if partly else unit
        return rows.select(F.col(KEY).alias(key), "hits", v.alias("v"))
    ords = vocabulary.select("phrase", "ord")

    def tries(w: Column) -> Column:
        at = lambda i, n: F.struct(F.lit(n).alias("size"), F.array_join(F.slice(w, i + 1, n), " ").alias("phrase"))
        return F.flatten(F.transform(w, lambda _, i: F.array(*[F.struct(i.alias("i"), at(i, n).alias("t")) for n in (3, 2, 1)])))

    words = texts.select(KEY, tokens(F.col("text")).alias("w"))
    looked = words.select(KEY, F.explode(F.transform(F.array("w"), tries)[0]).alias("x")).select(KEY, "x.i", F.col("x.t.size").alias("size"), F.col("x.t.phrase").alias("phrase"))
    if partly:
        looked = looked_up(looked, ords, "phrase", "left")
        best = looked.groupBy(KEY, "i").agg(F.max(F.when(F.col("ord").isNotNull(), F.struct("size", "ord"))).alias("best"), F.max(F.when(F.col("size") == 1, F.col("phrase"))).alias("token"))
        best = cut(best.select(KEY, F.col("best.size").cast("double").alias("size"), F.col("best.ord").alias("ord"), "token"))
        missing = best.where("ord is null").select(KEY, "token")
        known = cut(phrases.partly(missing, vocabulary))
        found = best.where("ord is not null").drop("token").unionByName(looked_up(missing, known, "token").select(KEY, F.lit(HELD).alias("size"), "ord"))
    else:
        found = looked_up(looked, ords, "phrase").groupBy(KEY, "i").agg(F.max(F.struct("size", "ord")).alias("best")).select(KEY, F.col("best.size").cast("double").alias("size"), "best.ord")
    # A phrase's vector is joined once for each text that has the phrase.
    weights = found.groupBy(KEY, "ord").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    parts = looked_up(weights, vocabulary.select("ord", "v"), "ord").select(KEY, "size", "n", F.posexplode("v").alias("k", "x"))
    sums = parts.groupBy(KEY, "k").agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("m"), F.sum("n").alias("hits"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"])
    out = sums.groupBy(KEY).agg(F.max("hits").alias("hits"), v.alias("v"))
    if not partly:
        return texts.select(KEY).join(out, KEY, "left").select(F.col(KEY).alias(key), F.coalesce("hits", F.lit(0)).alias("hits"), unit.alias("v"))
    own = texts.select(KEY, _own(F.lower("text")).alias("own"))
    return own.join(out, KEY, "left").select(F.col(KEY).alias(key), F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce(unit, F.col("own")).alias("v"))
