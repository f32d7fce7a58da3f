"""A map kept up to date under batches of nodes and edges.

What a batch changes is added to tables of sums: degrees by node; members, sums of embeddings, inner edges and their weight
by community; three sums that modularity is made of. Only edges that touch a node of the batch, or are in it, are read
again, under the old and under the new memberships and degrees. Signatures are made anew only for communities that gained or
lost a member or an inner edge. Nodes fall to the nearest greedy center, so a node's community depends on it alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import q6
from . import build, graph
from .graph import cut

#: Batches after which the tables of nodes and edges, to which batches only add, are written anew.
COMPACT = 8
NODE = "id long, label string, embedding array<double>, archetype string, hex_id int, community int"
EDGE = "source long, target long, weight double, directed boolean"
TOTAL = "community int, n_nodes long, sums array<double>, n_edges long, weight double, directed long"


@dataclass
class LiveMap:
    """nodes, edges; degrees (id, degree, n_edges); totals by community; modularity's sums; signatures by community.

    inside: twice the weight of edges inside communities; crossed: twice the products of their ends' degrees; m2: twice the
    weight of all edges. touched: the communities of the last batch, as a table.
    """

    nodes: DataFrame
    edges: DataFrame
    degrees: DataFrame
    totals: DataFrame
    signatures: DataFrame
    touched: DataFrame
    n_communities: int
    inside: float = 0.0
    crossed: float = 0.0
    m2: float = 0.0
    since: int = 0

    @property
    def modularity(self) -> float:
        return (self.inside - self.crossed / self.m2) / self.m2 if self.m2 else 0.0


def empty(spark: SparkSession, n_communities: int = 8) -> LiveMap:
    none = lambda schema: spark.createDataFrame([], schema)
    nodes, edges = none(NODE), none(EDGE)
    signatures = build.signatures(nodes, edges, none("node_id long, community int")).limit(0)
    return LiveMap(nodes, edges, none("id long, degree double, n_edges long"), none(TOTAL), none(signatures.schema), none("community int"), n_communities)


def _by_place(changes: DataFrame) -> DataFrame:
    """community, sums: of rows community, embedding, sign, added up by place so that no row gathers a community."""
    each = changes.select("community", F.posexplode("embedding").alias("i", "x"), "sign")
    sums = each.groupBy("community", "i").agg(F.sum(F.col("x") * F.col("sign")).alias("s"))
    return sums.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda p: p["s"]).alias("sums"))


def _inner(edges: DataFrame, members: DataFrame, degrees: DataFrame) -> DataFrame:
    """The edges inside communities: source, target, weight, directed, community, and their ends' degrees ka, kb."""
    m = members.select(F.col("id").alias("node_id"), "community")
    inner = graph.intra_edges(edges, m)
    side = lambda end, k: degrees.select(F.col("id").alias(end), F.col("degree").alias(k))
    return inner.join(side("source", "ka"), "source").join(side("target", "kb"), "target")


def add(state: LiveMap, nodes: DataFrame, edges: DataFrame) -> LiveMap:
    """The map after a batch: nodes (id, label, embedding, archetype; new ones, or the new versions of known ones, an id
    once) and edges (source, target, weight, directed), which are added, also where they repeat others.

    An edge counts inside a community once both its ends are nodes, whichever comes first; degrees count all edges.
    """
    centers = q6.packing(1)[: state.n_communities]
    new = nodes.withColumn("hex_id", q6.embed(F.col("embedding"))).withColumn("community", q6.cell(F.col("hex_id"), centers))
    new = cut(new.select([x.split()[0] for x in NODE.split(", ")]))
    fresh = cut(edges.select([x.split()[0] for x in EDGE.split(", ")]))
    ids = new.select("id")
    old = cut(state.nodes.join(ids, "id", "left_semi"))
    all_nodes = state.nodes.join(ids, "id", "left_anti").unionByName(new)
    all_edges = state.edges.unionByName(fresh)

    more = graph.degrees(fresh)
    degrees = state.degrees.join(more.select("id", F.col("degree").alias("d"), F.col("n_edges").alias("n")), "id", "full")
    degrees = cut(degrees.select("id", (F.coalesce("degree", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).alias("degree"), (F.coalesce("n_edges", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_edges")))

    # Edges that count anew: those of the batch's nodes, and those of nodes whose degree has changed.
    stirred = cut(ids.unionByName(more.select("id")).distinct())
    near = lambda e: e.join(stirred.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(e.join(stirred.withColumnRenamed("id", "source"), "source", "left_anti").join(stirred.withColumnRenamed("id", "target"), "target", "left_semi").select(e.columns))
    ends = cut(near(all_edges).select(F.explode(F.array("source", "target")).alias("id")).distinct())
    now_nodes, before_nodes = (cut(x.join(ends, "id", "left_semi").select("id", "community")) for x in (all_nodes, state.nodes))
    before = cut(_inner(near(state.edges), before_nodes, state.degrees).withColumn("sign", F.lit(-1)))
    now = cut(_inner(near(all_edges), now_nodes, degrees).withColumn("sign", F.lit(1)))
    changed = before.unionByName(now)
    moved = changed.agg(F.sum(2 * F.col("weight") * F.col("sign")).alias("w"), F.sum(2 * F.col("ka") * F.col("kb") * F.col("sign")).alias("k")).first()
    added = fresh.agg(F.sum(2 * F.col("weight")).alias("w")).first().w or 0.0

    # An edge that stays in its community cancels out here, whatever its ends' degrees.
    same = changed.groupBy("source", "target", "weight", "directed", "community").agg(F.sum("sign").alias("k")).where("k <> 0")
    by_edges = same.groupBy("community").agg(F.sum("k").alias("e"), F.sum(F.col("weight") * F.col("k")).alias("w"), F.sum(F.col("directed").cast("int") * F.col("k")).alias("ways"))
    turned = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
    by_nodes = turned.groupBy("community").agg(F.sum("sign").alias("n")).join(_by_place(turned), "community", "left").withColumnRenamed("sums", "s")
    delta = cut(by_nodes.join(by_edges, "community", "full"))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    none = F.array().cast("array<double>")
    t = state.totals.join(delta, "community", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = t.select("community", (zero("n_nodes") + zero("n")).alias("n_nodes"), plus(F.coalesce("sums", none), F.coalesce("s", none)).alias("sums"), (zero("n_edges") + zero("e")).alias("n_edges"), (zero("weight") + zero("w")).cast("double").alias("weight"), (zero("directed") + zero("ways")).alias("directed"))
    totals = cut(totals.where("n_nodes > 0"))

    touched = cut(delta.select("community"))  # 64 at most
    theirs = cut(all_nodes.join(F.broadcast(touched), "community", "left_semi"))
    own = theirs.select("id")
    some = all_edges.join(own.withColumnRenamed("id", "source"), "source", "left_semi").join(own.withColumnRenamed("id", "target"), "target", "left_semi")
    made = build.signatures(theirs.drop("community"), some, theirs.select(F.col("id").alias("node_id"), "community"))
    signatures = cut(state.signatures.join(F.broadcast(touched), "community", "left_anti").unionByName(made.select(state.signatures.columns)))
    since = state.since + 1
    if since == COMPACT:
        all_nodes, all_edges, since = cut(all_nodes), cut(all_edges), 0
    return replace(state, nodes=all_nodes, edges=all_edges, degrees=degrees, totals=totals, signatures=signatures, touched=touched, inside=state.inside + (moved.w or 0.0), crossed=state.crossed + (moved.k or 0.0), m2=state.m2 + added, since=since)


def profiles(state: LiveMap) -> DataFrame:
    """community, n_nodes, center, hex_id, n_edges, weight: from the sums alone, no member is read."""
    center = F.transform("sums", lambda x: x / F.col("n_nodes"))
    return state.totals.select("community", "n_nodes", center.alias("center"), q6.embed(center).alias("hex_id"), "n_edges", "weight")
