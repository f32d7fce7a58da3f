"""Arrays of one large JSON document, read in byte ranges.

Spark's text source cuts the file at closing braces, in as many ranges as it likes, on any store that Spark reads. A range
alone doesn't tell whether it begins inside a string, or how deep. So a first pass finds, for both cases, what a range does to
the state; the driver puts these together, a row for each range; and a second pass, which knows its ranges' first states,
finds the elements of the root's arrays. Elements that ranges cut are joined from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
_PLAIN = re.compile(r"\\.", re.S)
EFFECT = "file string, start long, flips boolean, deeper long, deeper_inside long"
PART = "file string, start long, i long, key string, part string, json string"
#: Where an element is: root object, array, element.
ROOT, ARRAY, ELEMENT = 1, 2, 3


def _fragments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """The ranges of a task, each with its text up to each closing brace, brace included."""
    rows = ((r.file, r.start, r.value) for b in batches for r in b.itertuples(index=False))
    for key, its in groupby(rows, lambda r: r[:2]):
        yield key, (r[2] + "}" for r in its)


def _depth(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whether a range ends on the other side of a quote, and how much deeper, if it begins outside or inside a string."""
    for (file, start), fragments in _fragments(batches):
        flips, deeper = False, [0, 0]
        for f in fragments:
            parts = _PLAIN.sub("", f).split('"')
            even, odd = (sum(map(_depth, parts[k::2])) for k in (0, 1))
            deeper[0] += odd if flips else even
            deeper[1] += even if flips else odd
            flips ^= len(parts) % 2 == 0
        yield pd.DataFrame([(file, start, flips, *deeper)], columns=[x.split()[0] for x in EFFECT.split(", ")])


class _Range:
    """One range read from a known state. key: the root's array that is open; None: that of the range before."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth = inside, depth
        self.key: str | None = None
        self.name = ""
        self.held: list[str] | None = [] if depth >= ELEMENT else None
        self.part = "head" if depth >= ELEMENT else "whole"
        self.out: list[tuple] = []

    def read(self, text: str) -> None:
        begin = 0
        quote = None
        for m in _TOKEN.finditer(text):
            c, at = m.group(), m.start()
            if self.inside:
                if c == '"':
                    self.inside = False
                    if self.depth == ROOT and quote is not None:
                        self.name = text[quote + 1 : at]
            elif c == '"':
                self.inside, quote = True, at
            elif c in "{[":
                self.depth += 1
                if self.depth == ARRAY:
                    self.key = self.name if c == "[" else ""
                elif self.depth == ELEMENT and c == "{":
                    self.held, begin = [], at
            elif c in "}]":
                self.depth -= 1
                if self.depth == ARRAY and self.held is not None:
                    self.out.append((self.key, self.part, "".join([*self.held, text[begin : at + 1]])))
                    self.held, self.part = None, "whole"
        if self.held is not None:
            self.held.append(text[begin:])

    def ended(self) -> list[tuple]:
        """Elements, whole ones and the rest of one that began before; then what is open; last the array that is open."""
        if self.held is not None:
            self.out.append((self.key, "middle" if self.part == "head" else "tail", "".join(self.held)))
        return [*self.out, (self.key, "end", "")]


def _elements(states: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (file, start), fragments in _fragments(batches):
            r = _Range(*states[file, start])
            n = 0
            for f in fragments:
                r.read(f)
                if len(r.out) >= 5000:
                    yield _rows(file, start, n, r.out)
                    n += len(r.out)
                    r.out = []
            yield _rows(file, start, n, r.ended())

    return run


def _rows(file: str, start: int, n: int, out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(file, start, n + i, *x) for i, x in enumerate(out)], columns=[x.split()[0] for x in PART.split(", ")])


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """key, ord, json: the objects in the arrays that the root object of a JSON document holds under its keys.

    ord grows along the document. path: a file, or a folder whose files are a document each; their elements follow each
    other in the order of their names. What isn't an object, or isn't in such an array, is left out. The driver holds a
    row for each range of a file (spark.sql.files.maxPartitionBytes).
    """
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    states, place, last = {}, {}, None
    for r in sorted(text.mapInPandas(_effects, EFFECT).collect(), key=lambda r: (r.file, r.start)):
        if r.file != last:
            inside, depth, last = False, 0, r.file
        states[r.file, r.start] = inside, depth
        place[r.file, r.start] = len(place)
        depth += r.deeper_inside if inside else r.deeper
        inside ^= r.flips
    parts = cut(text.mapInPandas(_elements(states), PART))
    # A row for each range again: which array is open, and where an element that a range goes on with began.
    key, owner, open_key, began, known = None, None, {}, {}, {}
    ends = {(r.file, r.start): r for r in parts.where("part = 'end'").collect()}
    cuts: dict[tuple, set] = {}
    for r in parts.where("part not in ('whole', 'end')").select("file", "start", "part").collect():
        cuts.setdefault((r.file, r.start), set()).add(r.part)
    for at in sorted(states):
        open_key[at] = key if states[at][1] >= ARRAY else None
        began[at], own = owner, cuts.get(at, set())
        key = ends[at].key if at in ends and ends[at].key is not None else open_key[at]
        owner = place[at] if "tail" in own else owner if "middle" in own else None
        known[at] = (place[at], open_key[at], began[at])
    ranges = spark.createDataFrame([(*at, *x) for at, x in known.items()], "file string, start long, place long, open string, began long")
    rows = parts.where("part <> 'end'").join(F.broadcast(ranges), ["file", "start"]).withColumn("key", F.coalesce("key", "open"))
    whole = rows.where("part = 'whole'").select("key", F.col("place").alias("p"), "i", "json")
    pieces = rows.where("part <> 'whole'").withColumn("p", F.when(F.col("part") == "tail", F.col("place")).otherwise(F.col("began")))
    order = F.array_sort(F.collect_list(F.struct("place", "i", "json")))
    joined = pieces.groupBy("p").agg(F.min_by("key", F.struct("place", "i")).alias("key"), F.min_by("i", F.struct("place", "i")).alias("i"), F.array_join(F.transform(order, lambda x: x["json"]), "").alias("json"))
    found = whole.unionByName(joined.select("key", "p", "i", "json")).where("key <> ''")
    return found.select("key", (F.shiftleft("p", 36) + F.col("i")).alias("ord"), "json")
