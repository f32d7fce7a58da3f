"""Substring search over labels by positional grams.

An index lists, for every gram of GRAM characters (and every shorter one, for shorter texts), the labels that hold it and
where. A text is looked up by the one of its grams that the fewest labels hold, so a common beginning is no key that all
texts and labels share. Grams that very many labels hold are split by label, and the texts that still ask for one go to
every part. What meets is compared at the places where the gram says that the text would begin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Characters of a gram. A gram is split where its postings exceed HOT_SHARE of all, or HOT_LEAST: 1 / HOT_SHARE grams at most.
GRAM, HOT_SHARE, HOT_LEAST = 3, 1 / 2000, 10_000


@dataclass
class GramIndex:
    """labels: id, l (in lower case); postings: gram, part, id, at (places from 1, ascending); counts: gram, n, parts."""

    labels: DataFrame
    postings: DataFrame
    counts: DataFrame


def _grams(l: Column, k: int) -> Column:
    """gram and place of every k characters of a text, none if it is shorter."""
    starts = F.when(F.length(l) >= k, F.sequence(F.lit(1), F.greatest(F.length(l) - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.substring(l, i, F.lit(k)).alias("gram"), i.alias("i")))


def build_index(nodes: DataFrame, hot_least: int = HOT_LEAST) -> GramIndex:
    """The index of nodes (id, label). Null labels aren't in it."""
    labels = cut(nodes.where("label is not null").select("id", F.lower("label").alias("l")))
    every = F.concat(*[_grams(F.col("l"), k) for k in range(1, GRAM + 1)])
    # A label's grams stay together: its places of one gram are one posting.
    places = lambda gs: F.transform(F.array_distinct(F.transform(gs, lambda g: g["gram"])), lambda x: F.struct(x.alias("gram"), F.transform(F.filter(gs, lambda g: g["gram"] == x), lambda g: g["i"]).alias("at")))
    each = labels.select("id", F.explode(F.transform(F.array(every), places)[0]).alias("g")).select("id", "g.gram", "g.at")
    each = cut(each)
    counts = each.groupBy("gram").agg(F.count("*").alias("n"))
    total = each.count()
    most = max(hot_least, math.ceil(total * HOT_SHARE))
    counts = cut(counts.withColumn("parts", F.ceil(F.col("n") / most).cast("int")))
    hot = counts.where("parts > 1").select("gram", "parts")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
    return GramIndex(labels, each.join(F.broadcast(hot), "gram", "left").select("gram", part.alias("part"), "id", "at"), counts)


def found_in(index: GramIndex, texts: DataFrame) -> DataFrame:
    """query, id: the labels that hold each text (query, text), whatever the case; null and empty texts find none."""
    asked = texts.select("query", F.lower("text").alias("t")).where("length(t) > 0")
    k = F.least(F.length("t"), F.lit(GRAM))
    own = F.when(k == 1, _grams(F.col("t"), 1)).when(k == 2, _grams(F.col("t"), 2)).otherwise(_grams(F.col("t"), GRAM))
    each = asked.select("query", "t", F.explode(own).alias("g")).select("query", "t", "g.gram", "g.i")
    counted = each.join(index.counts, "gram", "left")
    # A gram that no label holds is the rarest, and then the text is in none.
    rarest = counted.groupBy("query", "t").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "gram", "parts")).alias("r")).where("r.n > 0")
    dealt = rarest.select("query", "t", "r.gram", "r.i", F.explode(F.sequence(F.lit(0), F.col("r.parts") - 1)).alias("part"))
    met = dealt.join(index.postings, ["gram", "part"])
    starts = F.filter(F.transform("at", lambda p: p - F.col("i") + 1), lambda p: p >= 1)
    met = met.select("query", "t", "id", starts.alias("starts")).where("size(starts) > 0").join(index.labels, "id")
    return met.where(F.exists("starts", lambda p: F.substring(F.col("l"), p, F.length("t")) == F.col("t"))).select("query", "id")
