"""A whole map from nodes and edges: communities with all their signatures, hyper-edges, borders and modularity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, q6, vectors
from . import borders as b
from . import graph as g
from . import projection


@dataclass
class KnowledgeMap:
    """The tables of a map. members: node_id, community; borders: a, b, hd and the fractal signature."""

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    communities: DataFrame
    hyper_edges: DataFrame
    borders: DataFrame
    modularity: DataFrame


def upsert(table: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """table with the rows of new, which replace those of their keys; of several new rows of a key the last one counts.

    order: what is larger for a later row; without it a key stands once in new.
    """
    if order:
        new = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("r")).select(key, "r.*")
    return table.join(new.select(key), key, "left_anti").select(table.columns).unionByName(new.select(table.columns))


def _corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the hull of points, counter-clockwise from the smallest one, as rows; those inside its extremes in eight
    directions are left out before the rest is walked along."""
    at = np.unique(np.stack([x, y], axis=1), axis=0)
    if len(at) > 16:
        ways = np.array([[1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1], [0, -1], [1, -1]])
        ring = at[np.argmax(at @ ways.T, axis=0)]
        along = np.roll(ring, -1, axis=0) - ring
        off = at[:, None, :] - ring[None, :, :]
        left = along[None, :, 0] * off[:, :, 1] - along[None, :, 1] * off[:, :, 0]
        sides = (along != 0).any(axis=1)
        at = at[~(left[:, sides] > 0).all(axis=1)]
    if len(at) < 3:
        return at

    def side(points: np.ndarray) -> list:
        kept: list = []
        for p in points:
            while len(kept) > 1 and np.linalg.det([kept[-1] - kept[-2], p - kept[-2]]) <= 0:
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(side(at) + side(at[::-1]))


def _part_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each community of a task, how many points it has and their hull."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        for community, part in b.groupby("community"):
            n, hull = held.get(community, (0, np.zeros((0, 2))))
            held[community] = n + len(part), _corners(np.concatenate([hull[:, 0], part["x"]]), np.concatenate([hull[:, 1], part["y"]]))
    yield pd.DataFrame([(c, n, h[:, 0].tolist(), h[:, 1].tolist()) for c, (n, h) in held.items()], columns=["community", "n", "x", "y"])


def _whole_hull(rows: pd.DataFrame) -> pd.DataFrame:
    hull = _corners(np.concatenate(rows["x"].to_list()), np.concatenate(rows["y"].to_list()))
    points = [{"x": float(x), "y": float(y)} for x, y in hull]
    return pd.DataFrame([(rows["community"].iloc[0], int(rows["n"].sum()), points)], columns=["community", "n", "hull"])


def community_hulls(points: DataFrame) -> DataFrame:
    """community, n and hull of points (community, x, y): tasks send the hulls of their parts, not the points."""
    parts = points.select("community", "x", "y").mapInPandas(_part_hulls, "community int, n long, x array<double>, y array<double>")
    return parts.groupBy("community").applyInPandas(_whole_hull, "community int, n long, hull array<struct<x:double,y:double>>")


def small_tangram(n: Column, hull: Column) -> Column:
    """The shape of a community: two nodes are a rectangle without area, one is a polygon, else the hull tells."""
    none = lambda name, k: F.struct(F.lit(name).alias("shape"), F.lit(0.0).alias("area"), F.lit(0.0).alias("angle"), k.alias("vertices"))
    return F.when(n == 1, none("polygon", F.lit(1))).when(n == 2, none("rectangle", F.lit(2))).otherwise(geometry.tangram(hull))


def signatures(nodes: DataFrame, edges: DataFrame, member: DataFrame) -> DataFrame:
    """community, n_nodes, dominant_archetype, short_label, hex_id, center, n_edges, rays, octagram, skeleton, tangram.

    nodes: id, label, embedding, archetype. One row for every community that has a node.
    """
    intra = g.intra_edges(edges, member)
    first = member.join(nodes.select(F.col("id").alias("node_id"), "label"), "node_id").withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("node_id"))).where("r <= 2")
    two = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda s: F.substring(s["label"], 1, 6)), ",").alias("two"))
    n_edges = intra.groupBy("community").agg(F.count("*").alias("n_edges"))
    c = g.dominant(member, nodes).join(two, "community").join(g.mean_codes(member, nodes), "community")
    c = c.join(n_edges, "community", "left").join(g.community_rays(member, intra), "community")
    shape = community_hulls(projection.plane(nodes, member)).select("community", small_tangram(F.col("n"), F.col("hull")).alias("tangram"))
    rays = F.array(*g.RAYS)
    octagram = geometry.octagram(g.octagram(F.col("hex_id")))
    return c.join(shape, "community").select(
        "community",
        "n_nodes",
        "dominant_archetype",
        F.concat("dominant_archetype", F.lit(":"), "two").alias("short_label"),
        "hex_id",
        "center",
        F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
        rays.alias("rays"),
        octagram.alias("octagram"),
        geometry.octagram_skeleton(octagram).alias("skeleton"),
        "tangram",
    )


def signature_vector(shape: bool = True) -> Column:
    """The code's bits, the shape's area, angle and vertices, the seven and the eight ray lengths: 24 numbers."""
    bits = F.transform(q6.bits(F.col("hex_id")), lambda x: x.cast("double"))
    tangram = [F.array(F.col("tangram.area"), F.col("tangram.angle"), F.col("tangram.vertices").cast("double"))] if shape else []
    return F.concat(bits, *tangram, F.col("rays"), geometry.octagram_lengths(F.col("octagram")))


def distances(communities: DataFrame) -> DataFrame:
    """community, other, distance, steps of every two communities (community, hex_id, v); there are 64 at most."""
    one = communities.select("community", "hex_id", "v", F.lit(1).alias("k"))
    two = one.select(F.col("community").alias("other"), F.col("hex_id").alias("h"), F.col("v").alias("w"), "k")
    both = one.join(two, "k").where("community <> other")
    return both.select("community", "other", vectors.distance(F.col("v"), F.col("w")).alias("distance"), q6.hamming(F.col("hex_id"), F.col("h")).alias("steps"))


def nearest(pairs: DataFrame, top: int = 5) -> DataFrame:
    """community, other, distance, rank: the `top` nearest of each, the smaller one among equals."""
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("community").orderBy("distance", "other")))
    return ranked.where(F.col("rank") <= top).select("community", "other", "distance", "rank")


def cluster_rays(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n_edges and the seven rays of each cluster (node, members) from the weights of its inner edges.

    A cluster without inner edges has rays of one half. An edge counts as directed if no edge leads back, or one whose
    weight differs by more than 0.1.
    """
    m = clusters.select("node", F.explode("members").alias("m"))
    e = edges.select("source", "target", "weight")
    back = e.groupBy(F.col("target").alias("source"), F.col("source").alias("target")).agg(F.max("weight").alias("back"))
    e = e.join(back, ["source", "target"], "left").withColumn("oneway", F.when(F.col("back").isNull() | (F.abs(F.col("back") - F.col("weight")) > 0.1), 1.0).otherwise(0.0))
    inner = m.withColumnRenamed("m", "source").join(e, "source").join(m.select("node", F.col("m").alias("target")), ["node", "target"])
    mean, spread = F.avg("weight"), F.var_pop("weight")
    rays = [mean, F.avg("oneway"), spread, 1 - (F.max("weight") - F.min("weight")), F.least(F.lit(1.0), F.count("*") / 10), F.max("weight"), mean * (1 - spread)]
    found = inner.groupBy("node").agg(F.count("*").alias("n_edges"), *[g.clamp(x).alias(r) for r, x in zip(g.RAYS, rays)])
    out = clusters.select("node").join(found, "node", "left")
    return out.select("node", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), *[F.coalesce(r, F.lit(0.5)).alias(r) for r in g.RAYS])


def cluster_shapes(clusters: DataFrame, points: DataFrame) -> DataFrame:
    """node and tangram of each cluster (node, members; eight at most) on its members' points (id, x, y)."""
    at = points.select(F.col("id").alias("m"), geometry.point(F.col("x"), F.col("y")).alias("p"))
    each = clusters.select("node", F.explode("members").alias("m")).join(at, "m").groupBy("node").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return each.select("node", geometry.hull(F.col("ps")).alias("hull")).select("node", geometry.tangram(F.col("hull")).alias("tangram"))


def build(nodes: DataFrame, edges: DataFrame, n_communities: int = 8, sweeps: int = 20) -> KnowledgeMap:
    """All tables of a map from nodes (id, label, embedding, archetype, hex_id) and edges (source, target, weight, directed).

    Nodes fall to the nearest of the first n_communities greedy centers, then follow their neighbours' votes for at most
    `sweeps` rounds; what is left of each community gets its signatures. Hyper-edges stand on the plane of all nodes.
    """
    nodes, edges = g.cut(nodes), g.cut(edges)
    member = g.cut(g.label_propagation(edges, g.membership(nodes, n_communities), sweeps))
    communities = g.cut(signatures(nodes, edges, member))
    whole = projection.plane(nodes, nodes.select(F.col("id").alias("node_id"), F.lit(0).alias("community")))
    clusters = g.cut(g.hyper_edges(edges))
    hyper = clusters.join(cluster_shapes(clusters, whole), "node").join(cluster_rays(clusters, edges), "node")
    curves = g.cut(b.border_curves(communities.select("community", "hex_id", "center")))
    fractal = curves.select("a", "b", "hd").join(b.signatures(curves), ["a", "b"])
    return KnowledgeMap(nodes, edges, member, communities, hyper, fractal, g.modularity(edges, member))


def summary(built: KnowledgeMap) -> DataFrame:
    """One row: how many nodes, edges, hyper-edges, communities and borders there are, modularity, and how many communities have each shape."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    shapes = built.communities.groupBy("tangram.shape").agg(F.count("*").alias("k"))
    shapes = shapes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("shape", "k")))).alias("shapes"))  # eight shapes at most
    out = count(built.nodes, "n_nodes")
    for df in (count(built.edges, "n_edges"), count(built.hyper_edges, "n_hyper_edges"), count(built.communities, "n_communities"), count(built.borders, "n_borders"), built.modularity.select("modularity"), shapes):
        out = out.join(df, F.lit(True))
    return out
