"""Borders between neighbouring communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, q6


def touching(communities: DataFrame) -> DataFrame:
    """a, b: pairs of communities (community, hex_id; 32 at most) whose cells of the 6-cube touch, a before b.

    The first community of a code stands for it; every vertex falls to the nearest code, the first of equals.
    """
    first = communities.groupBy("hex_id").agg(F.min("community").alias("community"))
    reach = first.select("community", "hex_id", F.explode(q6.codes()).alias("h"))
    cells = reach.groupBy("h").agg(F.min_by("community", F.struct(q6.hamming(F.col("h"), F.col("hex_id")), "community")).alias("community"))
    near = cells.select("community", F.explode(q6.neighbors(F.col("h"))).alias("h")).join(cells.withColumnRenamed("community", "other"), "h").where("community <> other")
    return near.select(F.least("community", "other").alias("a"), F.greatest("community", "other").alias("b")).distinct()


def border_curves(communities: DataFrame) -> DataFrame:
    """a, b, hd and curve of every border; communities: community, hex_id, center. Communities share no node."""
    side = lambda x: communities.select(F.col("community").alias(x), F.col("hex_id").alias(f"hex_{x}"), F.col("center").alias(f"center_{x}"))
    pairs = touching(communities).join(side("a"), "a").join(side("b"), "b")
    names = F.concat(F.lit("comm_"), F.col("a").cast("string"), F.lit("comm_"), F.col("b").cast("string"))
    curve = geometry.border_curve(F.col("center_a"), F.col("center_b"), F.col("hex_a"), F.col("hex_b"), names, F.lit(0))
    return pairs.select("a", "b", q6.hamming(F.col("hex_a"), F.col("hex_b")).alias("hd"), curve.alias("curve"))


def signatures(borders: DataFrame) -> DataFrame:
    """The fractal signature of each border."""
    c = F.col("curve")
    scales = [F.struct(F.lit(s).alias("sigma"), geometry.zero_crossings(c, s).alias("crossings")) for s in (1.0, 2.0, 4.0, 8.0)]
    return borders.select("a", "b", geometry.box_dimension(c).alias("fd_box"), geometry.divider_dimension(c).alias("fd_divider"), geometry.ifs(c).alias("ifs"), geometry.chain_code(c).alias("chain_code"), F.array(*scales).alias("css"))


def similar(borders: DataFrame) -> DataFrame:
    """a, b, c, d, similarity of every two borders (a community table is small: 32 rows at most, so 496 borders)."""
    one = borders.select("a", "b", "ifs", F.lit(1).alias("k"))
    two = borders.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("ifs").alias("other"), F.lit(1).alias("k"))
    both = one.join(two, "k").where("struct(a, b) <> struct(c, d)")
    return both.select("a", "b", "c", "d", geometry.similarity(F.col("ifs"), F.col("other")).alias("similarity"))


def fuzzy(borders: DataFrame, above: float = 1.5) -> DataFrame:
    """a, b of the borders whose box dimension is above the limit."""
    return borders.where(geometry.box_dimension(F.col("curve")) > above).select("a", "b")


def sharp(borders: DataFrame, below: float = 1.2) -> DataFrame:
    return borders.where(geometry.box_dimension(F.col("curve")) < below).select("a", "b")


def ranked(pairs: DataFrame, top: int = 5) -> DataFrame:
    """The `top` borders (c, d) most similar to each border (a, b), with their rank."""
    out = pairs.withColumn("rank", F.row_number().over(W.partitionBy("a", "b").orderBy(F.desc("similarity"), "c", "d")))
    return out.where(F.col("rank") <= top)


def search(asked: DataFrame, pairs: DataFrame, top: int = 5) -> DataFrame:
    """p, q, c, d, similarity, rank: the borders most similar to the border of communities p and q, in either order; none
    for communities without one."""
    both = asked.select("p", "q", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return both.join(ranked(pairs, top), ["a", "b"]).select("p", "q", "c", "d", "similarity", "rank")
