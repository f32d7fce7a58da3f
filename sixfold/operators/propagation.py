"""Label propagation in a given order of nodes, run in parallel.

In a sequential sweep a node sees the new communities of the neighbours before it and the old ones of those after it. So
the sweep's result is the one assignment that fits itself: every node's new community is what it decides if its earlier
neighbours have their new ones. It is found in rounds. At first nobody has moved; a round decides again only the nodes with
an earlier neighbour that changed in the round before. A node is right once all earlier neighbours are, so a sweep takes no
more rounds than its longest chain of changes, one depending on the other, and the work of a round follows what changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import PULL, both_ways, cut


def shuffled(sweep: int, node: Column) -> Column:
    """An order that differs from sweep to sweep."""
    return F.xxhash64(F.lit(sweep), node)


def decided(voices: DataFrame) -> DataFrame:
    """node_id and what it moves to, or its own community: of voices (node_id, own, c, weight, ord), the votes it sees.

    A node counts 1 for its own community. Another one wins with the most votes, if these exceed the own one's by PULL;
    among equals that of the earliest edge.
    """
    tally = voices.groupBy("node_id", "own", "c").agg(F.sum("weight").alias("w"), F.min("ord").alias("first"))
    other = F.col("c") != F.col("own")
    best = tally.groupBy("node_id", "own").agg(
        F.max(F.when(~other, F.col("w"))).alias("mine"), F.max(F.when(other, F.col("w"))).alias("theirs"), F.min_by("c", F.when(other, F.struct((-F.col("w")).alias("w"), "first", "c"))).alias("to")
    )
    moves = F.col("theirs") > PULL * (1 + F.coalesce("mine", F.lit(0.0)))
    return best.select("node_id", F.when(F.coalesce(moves, F.lit(False)), F.col("to")).otherwise(F.col("own")).alias("now"))


def ordered_sweep(edges: DataFrame, member: DataFrame, order: Callable[[Column], Column], rounds: list[int] | None = None) -> DataFrame:
    """node_id, community, moved after one sequential sweep over the nodes by order(node), the smaller id first among equals.

    edges: source, target, weight, and ord where ties between communities shall go by the order of edges; without it they
    go to the smaller community. rounds, if given, gets how many rounds it took.
    """
    key = lambda c: F.struct(order(F.col(c)).alias("o"), F.col(c).alias("n"))
    ranked = edges.select("source", "target", F.struct("weight", F.col("ord") if "ord" in edges.columns else F.lit(0).alias("ord")).alias("weight"))
    ends = both_ways(ranked).select("id", "other", "weight.weight", "weight.ord", (key("other") < key("id")).alias("earlier"))
    ends = cut(ends)
    state = cut(member.select("node_id", F.col("community").alias("own"), F.col("community").alias("now")))
    asked = None
    taken = 0
    while True:
        taken += 1
        own = state.select(F.col("node_id").alias("id"), "own")
        some = ends.join(own if asked is None else own.join(asked, "id", "left_semi"), "id")
        seen = state.select(F.col("node_id").alias("other"), F.col("own").alias("before"), "now")
        voices = some.join(seen, "other").select(F.col("id").alias("node_id"), "own", F.when(F.col("earlier"), F.col("now")).otherwise(F.col("before")).alias("c"), "weight", "ord")
        found = cut(decided(voices).join(state.select("node_id", F.col("now").alias("last")), "node_id").where("now <> last").select("node_id", "now"))
        if found.isEmpty():
            break
        state = cut(state.join(found.withColumnRenamed("now", "new"), "node_id", "left").select("node_id", "own", F.coalesce("new", "now").alias("now")))
        asked = ends.where("earlier").join(found.select(F.col("node_id").alias("other")), "other", "left_semi").select("id").distinct()
    if rounds is not None:
        rounds.append(taken)
    return state.select("node_id", F.col("now").alias("community"), (F.col("now") != F.col("own")).alias("moved"))


def ordered_propagation(edges: DataFrame, member: DataFrame, sweeps: int = 20, order: Callable[[int, Column], Column] = shuffled) -> tuple[DataFrame, int]:
    """node_id, community after sequential sweeps until none moves a node, at most `sweeps`, and how many there were.

    order: the order of a sweep, by its number and the node. Edges with an end outside the graph have no voice there; nodes
    without edges stay.
    """
    edges = cut(edges.select("source", "target", "weight", *[c for c in ("ord",) if c in edges.columns]))
    for sweep in range(sweeps):
        member = cut(ordered_sweep(edges, member.select("node_id", "community"), lambda c, k=sweep: order(k, c)))
        if member.where("moved").isEmpty():
            return member.select("node_id", "community"), sweep + 1
    return member.select("node_id", "community"), sweeps
