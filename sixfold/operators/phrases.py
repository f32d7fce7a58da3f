"""Phrases inside texts by an Aho-Corasick automaton: one pass over a text finds all phrases of a vocabulary.

A vocabulary (phrase, ord) is dealt to parts of bounded size by a hash of the phrase. The driver builds the automaton of
one part after the other and broadcasts it; rows go through the parts in one chain of Arrow batches, each of which improves
what the row has found so far, so nothing is shuffled or joined however many parts there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Phrases of a part, on average (some 10 MB of automaton).
PART = 100_000


def automaton(words: list[tuple[str, int]]):
    """An automaton of (word, value); a word that stands twice keeps the smaller value. None without words."""
    import ahocorasick

    least: dict[str, int] = {}
    for w, v in words:
        if w:
            least[w] = min(v, least.get(w, v))
    if not least:
        return None
    out = ahocorasick.Automaton()
    for w, v in least.items():
        out.add_word(w, (v, w))
    out.make_automaton()
    return out


def _parts(vocabulary: DataFrame, part: int) -> Iterator[list[tuple[str, int]]]:
    """The phrases and their ords, part by part, in the order of ords."""
    words = cut(vocabulary.where("phrase is not null").select("phrase", F.col("ord").cast("long").alias("ord")))
    n = max(1, math.ceil(words.count() / part))
    for k in range(n):
        rows = words.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k).toArrow() if n > 1 else words.toArrow()
        yield sorted(zip(rows.column("phrase").to_pylist(), rows.column("ord").to_pylist()), key=lambda x: (x[1], x[0]))


def _through(rows: DataFrame, vocabulary: DataFrame, part: int, step: Callable) -> DataFrame:
    """rows after step(batch, automaton, phrases) for each part of the vocabulary."""
    sc = rows.sparkSession.sparkContext

    def run(known):
        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machine, phrases = known.value
            for b in batches:
                yield step(b, machine, phrases)

        return over

    for phrases in _parts(vocabulary, part):
        rows = rows.mapInPandas(run(sc.broadcast((automaton(phrases), phrases))), rows.schema)
    return rows


def held(texts: DataFrame, vocabulary: DataFrame, most: int, part: int = PART) -> DataFrame:
    """texts with hits: the phrases that the text column holds anywhere, parts of words too, the `most` first of them by ord.

    A null text holds none. Of phrases with one ord the smaller one is first.
    """

    def step(b: pd.DataFrame, machine, _) -> pd.DataFrame:
        if machine is not None:
            found = []
            for text, before in zip(b["text"], b["hits"]):
                new = {(r["ord"], r["phrase"]) for r in before} | ({v for _, v in machine.iter(text)} if text else set())
                found.append([{"ord": o, "phrase": p} for o, p in sorted(new)[:most]])
            b = b.assign(hits=found)
        return b

    none = F.array().cast("array<struct<ord:bigint,phrase:string>>")
    found = _through(texts.withColumn("hits", none), vocabulary, part, step)
    return found.withColumn("hits", F.transform("hits", lambda x: x["phrase"]))


def first(tokens: list[str], machine, phrases: list[tuple[str, int]]) -> list[int | None]:
    """For each of different tokens the least ord of a phrase that holds it or that it holds; phrases come in the order of ords.

    The automaton of phrases runs over the tokens for phrases inside them; for tokens inside phrases, an automaton of the
    tokens runs over the phrases.
    """
    inside = automaton([(t, i) for i, t in enumerate(tokens)])
    holds: dict[int, int] = {}
    for phrase, ord_ in phrases if inside is not None else []:
        for _, (i, _) in inside.iter(phrase):
            holds.setdefault(i, ord_)
    least = [min((v for _, (v, _) in machine.iter(t)), default=None) for t in tokens]
    return [holds.get(i) if v is None else min(v, holds.get(i, v)) for i, v in enumerate(least)]


def partly(tokens: DataFrame, vocabulary: DataFrame, part: int = PART) -> DataFrame:
    """token, ord: for each different token the least ord of a phrase that holds it or that it holds, if there is one."""

    def step(b: pd.DataFrame, machine, phrases) -> pd.DataFrame:
        if machine is None:
            return b
        before = [[] if pd.isna(x) else [int(x)] for x in b["ord"]]
        now = first(b["token"].tolist(), machine, phrases)
        best = [min([*x, *([] if o is None else [o])], default=None) for x, o in zip(before, now)]
        return b.assign(ord=pd.array(best, dtype="Int64"))

    found = _through(tokens.select("token").distinct().withColumn("ord", F.lit(None).cast("long")), vocabulary, part, step)
    return found.where("ord is not null")
