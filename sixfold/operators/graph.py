"""Communities of a graph: membership, edges, degrees, modularity, profiles, label propagation, ego clusters."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import q6

#: Names of a cluster by its size.
CLUSTER_NAMES = {3: "triad", 4: "quad", 5: "pentagon_cluster", 6: "hexagon_community", 7: "heptagram_group", 8: "octagram_domain"}
#: A community replaces a node's own one if its votes exceed the own one's by this factor.
PULL = 1.5


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared checkpoint folder; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sixfold-")
        sc.setCheckpointDir(base)
    return os.path.join(base, f"graph-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in a table of the shared checkpoint folder."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def membership(nodes: DataFrame, n_communities: int = 8) -> DataFrame:
    """node_id, community (its Voronoi center) for nodes with hex_id: a lookup of 64 entries, no join."""
    centers = q6.packing(1)[:n_communities]
    return nodes.select(F.col("id").alias("node_id"), q6.cell(F.col("hex_id"), centers).alias("community"))


def between_members(edges: DataFrame, member: DataFrame) -> DataFrame:
    """edges with the communities a and b of their ends; edges with an end outside the graph are dropped."""
    a = member.select(F.col("node_id").alias("source"), F.col("community").alias("a"))
    b = member.select(F.col("node_id").alias("target"), F.col("community").alias("b"))
    return edges.join(a, "source").join(b, "target")


def intra_edges(edges: DataFrame, member: DataFrame) -> DataFrame:
    return between_members(edges, member).where("a = b").withColumnRenamed("a", "community").drop("b")


def both_ways(edges: DataFrame) -> DataFrame:
    """id, other, weight: every edge from either end, in one pass."""
    ends = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))
    return edges.select(F.explode(ends).alias("e"), "weight").select("e.id", "e.other", "weight")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("id").agg(F.sum("weight").alias("degree"), F.count("*").alias("n_edges"))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: the sum over edges inside communities of 2 (w - ki kj / 2m) / 2m; 0 without edges."""
    degree = degrees(edges).select("id", "degree")
    total = edges.agg((2 * F.sum("weight")).alias("m2"))
    inside = intra_edges(edges, member)
    inside = inside.join(degree.select(F.col("id").alias("source"), F.col("degree").alias("ki")), "source").join(degree.select(F.col("id").alias("target"), F.col("degree").alias("kj")), "target")
    # One row on either side: sums of the parts that do and don't depend on 2m.
    parts = inside.agg(F.sum(2 * F.col("weight")).alias("w"), F.sum(2 * F.col("ki") * F.col("kj")).alias("kk"), F.count("*").alias("n_intra"))
    q = (F.col("w") - F.col("kk") / F.col("m2")) / F.col("m2")
    return parts.join(total, F.lit(True)).select("n_intra", F.coalesce(q, F.lit(0.0)).alias("modularity"))


def dominant(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """community, n_nodes, dominant_archetype: the most frequent one that isn't empty, the first seen of equals, or ?."""
    named = member.join(nodes.select(F.col("id").alias("node_id"), "archetype"), "node_id")
    each = named.groupBy("community", "archetype").agg(F.count("*").alias("k"), F.min("node_id").alias("first"))
    some = F.when(F.coalesce("archetype", F.lit("")) != "", F.struct((-F.col("k")).alias("k"), "first"))
    return each.groupBy("community").agg(F.sum("k").alias("n_nodes"), F.coalesce(F.min_by("archetype", some), F.lit("?")).alias("dominant_archetype"))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


#: The names of the seven rays.
RAYS = ["strength", "direction", "temporal", "confidence", "scale", "context", "source"]


def edge_rays(intra: DataFrame) -> DataFrame:
    """The seven automatic rays of every community with edges, from its inner edges."""
    mean, n = F.avg("weight"), F.count("*")
    return intra.groupBy("community").agg(
        clamp(mean).alias("strength"),
        clamp(F.avg(F.col("directed").cast("double"))).alias("direction"),
        F.lit(0.5).alias("temporal"),
        clamp(mean).alias("confidence"),
        F.least(F.lit(1.0), n / 20).alias("scale"),
        clamp(F.max("weight")).alias("context"),
        F.lit(0.7).alias("source"),
    )


def community_rays(member: DataFrame, intra: DataFrame) -> DataFrame:
    """community and its seven rays, for every community that has a node; all one half without inner edges."""
    every = member.select("community").distinct().join(edge_rays(intra), "community", "left")
    return every.select("community", *[F.coalesce(r, F.lit(0.5)).alias(r) for r in RAYS])


def octagram(code: Column) -> Column:
    """Eight ray lengths (N, NE, E, SE, S, SW, W, NW) from the bits of a code; all one half without one."""
    b = [F.shiftright(code, i).bitwiseAND(1).cast("double") for i in range(6)]
    rays = F.array(b[0], b[1], b[2], b[3], 1 - b[0], b[4], b[5], b[1] * b[2])
    return F.when(code.isNull(), F.array(*[F.lit(0.5)] * 8)).otherwise(rays)


def skeleton(code: Column) -> Column:
    """On the automatic path only two kinds can occur: a tower where north is longer than south, else a fractal."""
    return F.when(code.isNull(), "sphere").when(code.bitwiseAND(1) == 1, "tower").otherwise("fractal")


def mean_codes(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """community, center (the mean embedding) and hex_id (its code)."""
    e = member.join(nodes.select(F.col("id").alias("node_id"), "embedding"), "node_id").select("community", F.posexplode("embedding").alias("i", "x"))
    means = e.groupBy("community", "i").agg(F.avg("x").alias("m"))
    center = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    return means.groupBy("community").agg(center.alias("center")).withColumn("hex_id", q6.embed(F.col("center")))


def vote_sweep(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One synchronous sweep: node_id, community, moved. A node counts 1 for its own community and each edge its weight."""
    voices = both_ways(edges).join(member.select(F.col("node_id").alias("other"), F.col("community").alias("c")), "other")
    tally = voices.groupBy(F.col("id").alias("node_id"), "c").agg(F.sum("weight").alias("w")).join(member, "node_id")
    own = F.col("c") == F.col("community")
    best = tally.groupBy("node_id").agg(
        F.max(F.when(own, F.col("w"))).alias("mine"), F.max_by("c", F.when(~own, F.struct("w", -F.col("c")))).alias("other"), F.max(F.when(~own, F.col("w"))).alias("theirs")
    )
    to = F.col("theirs") > PULL * (1 + F.coalesce("mine", F.lit(0.0)))
    out = member.join(best, "node_id", "left").withColumn("moved", F.coalesce(to, F.lit(False)))
    return out.select("node_id", F.when(F.col("moved"), F.col("other")).otherwise(F.col("community")).alias("community"), "moved")


def label_propagation(edges: DataFrame, member: DataFrame, sweeps: int = 20) -> DataFrame:
    """Synchronous sweeps until no node moves, at most `sweeps`; each is a table. Node order has no part in it."""
    edges = cut(edges.select("source", "target", "weight"))
    for _ in range(sweeps):
        member = cut(vote_sweep(edges, member.select("node_id", "community")))
        if member.where("moved").isEmpty():
            break
    return member.select("node_id", "community")


def neighbor_pairs(edges: DataFrame) -> DataFrame:
    return both_ways(edges).where("id <> other").select("id", "other").distinct()


def common_neighbors(pairs: DataFrame) -> DataFrame:
    """id, other, common: how many neighbours the ends of each pair share, where they share any; pairs: both directions.

    Every triangle is listed once, from its corner of the least degree: edges point to the larger degree, so that even a
    node with very many neighbours has few outward ones, and no node's neighbours are all paired.
    """
    degree = pairs.groupBy("id").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree, "id").join(degree.select(F.col("id").alias("other"), F.col("d").alias("e")), "other")
    out = cut(ranked.where("struct(d, id) < struct(e, other)").select(F.col("id").alias("u"), F.col("other").alias("v"), F.struct(F.col("e").alias("d"), F.col("other").alias("id")).alias("r")))
    wedges = out.join(out.select("u", F.col("v").alias("w"), F.col("r").alias("s")), "u").where("r < s").select("u", "v", "w")
    triangles = wedges.join(out.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"], "left_semi")
    sides = [F.struct(F.col(x).alias("id"), F.col(y).alias("other")) for x in "uvw" for y in "uvw" if x != y]
    return triangles.select(F.explode(F.array(*sides)).alias("e")).groupBy("e.id", "e.other").agg(F.count("*").alias("common"))


def ego_clusters(edges: DataFrame, most: int = 8, least: int = 3) -> DataFrame:
    """node, members (sorted), n: each node and its neighbours; beyond `most`, those that share most neighbours with it,
    the smaller id first among equals."""
    pairs = cut(neighbor_pairs(edges))
    ranked = pairs.join(common_neighbors(pairs), ["id", "other"], "left").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.coalesce("common", F.lit(0)).desc(), "other")))
    kept = ranked.where(F.col("r") < most).groupBy("id").agg(F.collect_list("other").alias("near"))
    members = F.array_sort(F.concat(F.array("id"), "near"))
    return kept.select(F.col("id").alias("node"), members.alias("members"), F.size(members).alias("n")).where(F.col("n") >= least)


def overlapping(clusters: DataFrame, overlap: float) -> DataFrame:
    """first, second: clusters (node, members, n) that share more than `overlap` of the larger, first before second.

    Of each cluster only the rarest members are join keys: so many that two clusters with this overlap share one of them.
    """
    rarity = clusters.select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("f"))
    each = clusters.select("node", "n", F.explode("members").alias("m")).join(rarity, "m")
    ranked = each.withColumn("r", F.row_number().over(W.partitionBy("node").orderBy("f", "m")))
    keys = ranked.where(F.col("r") <= F.col("n") - F.floor(F.col("n") * overlap)).select("node", "m")
    two = keys.withColumnRenamed("node", "first").join(keys.withColumnRenamed("node", "second"), "m").where("first < second").select("first", "second").distinct()
    side = lambda x: clusters.select(F.col("node").alias(x), F.col("members").alias(f"of_{x}"))
    both = two.join(side("first"), "first").join(side("second"), "second")
    shared = F.size(F.array_intersect("of_first", "of_second")) / F.greatest(F.size("of_first"), F.size("of_second"))
    return both.where(shared > overlap).select("first", "second")


def cluster_name(n: Column) -> Column:
    name = F.concat(F.lit("poly_"), n.cast("string"), F.lit("_cluster"))
    for size, text in CLUSTER_NAMES.items():
        name = F.when(n == size, F.lit(text)).otherwise(name)
    return name


def hyper_edges(edges: DataFrame, overlap: float = 0.8) -> DataFrame:
    """The ego clusters that no earlier kept one covers by more than `overlap` of the larger: node, members, label.

    Rounds of: a cluster stays once every earlier overlapping one is gone, and goes once one of them stays. A round decides the
    earliest undecided cluster of every chain of overlapping ones, so there are at most as many rounds as the longest chain
    has clusters.
    """
    egos = cut(ego_clusters(edges))
    clash = cut(overlapping(egos, overlap))
    state = egos.select("node", F.lit(None).cast("boolean").alias("kept"))
    while True:
        blocked = clash.join(state.select(F.col("node").alias("first"), "kept"), "first").groupBy(F.col("second").alias("node")).agg(F.max(F.coalesce("kept", F.lit(False))).alias("loses"), F.max(F.col("kept").isNull()).alias("waits"))
        now = state.join(blocked, "node", "left")
        decided = F.when(F.coalesce("loses", F.lit(False)), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True))
        state = cut(now.select("node", F.coalesce("kept", decided).alias("kept")))
        if state.where("kept is null").isEmpty():
            break
    return egos.join(state.where("kept"), "node", "left_semi").select("node", "members", cluster_name(F.col("n")).alias("label"))
