"""Contexts for questions: around the nearest nodes, over all communities, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import q6
from . import graph as g

#: Labels that a community's line names, labels that it gives as sources, characters of the wide context in a hybrid one,
#: and sources of an answer.
NAMED, CITED, WIDE, SOURCES = 5, 3, 500, 10


def _ordered(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def dominant_ray(rays: Column) -> Column:
    """The name of the longest ray, the first of equals."""
    return F.get(F.array(*[F.lit(r) for r in g.RAYS]), (F.array_position(rays, F.array_max(rays)) - 1).cast("int"))


def community_lines(communities: DataFrame, nodes: DataFrame, member: DataFrame) -> DataFrame:
    """community, line, sources: shape, archetype, code, skeleton and main ray of each community and its first labels.

    communities: as build.signatures() gives them.
    """
    ranked = member.join(nodes.select(F.col("id").alias("node_id"), "label"), "node_id").withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("node_id")))
    labels = ranked.where(F.col("r") <= NAMED).groupBy("community").agg(F.transform(_ordered("r", "label"), lambda x: x["label"]).alias("labels"))
    more = F.when(F.col("n_nodes") > NAMED, F.concat(F.lit(" +"), (F.col("n_nodes") - NAMED).cast("string"))).otherwise("")
    parts = [F.lit("["), "tangram.shape", F.lit("/"), "dominant_archetype", F.lit("] Q6="), F.col("hex_id").cast("string"), F.lit(" skel="), F.substring("skeleton", 1, 5), F.lit(" dom="), dominant_ray(F.col("rays")), F.lit(": "), F.array_join("labels", ", "), more]
    return communities.join(labels, "community").select("community", F.concat(*parts).alias("line"), F.slice("labels", 1, CITED).alias("sources"))


def local_contexts(top: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """query, labels, relations: the labels of the nodes found (query, id, rank) and the first edges that touch them."""
    named = nodes.select("id", "label")
    labels = top.join(named, "id").groupBy("query").agg(F.transform(_ordered("rank", "label"), lambda x: x["label"]).alias("labels"))
    touching = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), "source", "target")
    each = top.select("query", "id").join(touching, "id").select("query", "source", "target").distinct()
    few = each.withColumn("k", F.row_number().over(W.partitionBy("query").orderBy("source", "target"))).where(F.col("k") <= most)
    few = few.join(named.select(F.col("id").alias("source"), F.col("label").alias("a")), "source").join(named.select(F.col("id").alias("target"), F.col("label").alias("b")), "target")
    lines = few.groupBy("query").agg(F.transform(_ordered("k", "a", "b"), lambda x: F.concat(x["a"], F.lit(" -> "), x["b"])).alias("lines"))
    return labels.join(lines, "query", "left").select("query", "labels", F.coalesce(F.array_join("lines", "; "), F.lit("none")).alias("relations"))


def contexts(questions: DataFrame, local: DataFrame, lines: DataFrame) -> DataFrame:
    """query, mode, context, sources of questions (query, mode); any mode but local and global is hybrid.

    local: as local_contexts() gives it; lines: as community_lines() does, 64 at most, which become one row.
    """
    order = lambda field: F.transform(F.array_sort(F.collect_list(F.struct("community", field))), lambda x: x[field])
    wide = lines.agg(F.array_join(F.transform(order("line"), lambda x: F.concat(F.lit("  "), x)), "\n").alias("wide"), F.flatten(order("sources")).alias("wide_sources"))
    q = questions.select("query", "mode").join(local, "query", "left").join(F.broadcast(wide), F.lit(True))
    near = F.concat(F.lit("Entities: "), F.array_join("labels", ", "), F.lit("\nRelations: "), "relations")
    both = F.concat(F.lit("Near the question\n"), near, F.lit("\n\nAcross all communities\n"), F.substring("wide", 1, WIDE))
    pick = lambda a, b, c: F.when(F.col("mode") == "local", a).when(F.col("mode") == "global", b).otherwise(c)
    sources = F.slice(F.array_distinct(pick(F.col("labels"), F.col("wide_sources"), F.concat("labels", "wide_sources"))), 1, SOURCES)
    return q.select("query", "mode", pick(near, F.col("wide"), both).alias("context"), sources.alias("sources"))


def local_answers(found: DataFrame, nodes: DataFrame, edges: DataFrame, communities: DataFrame, questions: DataFrame, top: int = 5, asked: int = 5, least: int = 4) -> DataFrame:
    """query, labels, relations, archetypes, community, hex_id, bits, skeleton, ray, questions: what an answer is made from.

    found: what an approximate search gives (query, rank, kind, item). Its first `top` nodes give labels, the edges that touch
    them, and their archetypes; its first community the code, skeleton and longest ray (communities: community, hex_id, rays);
    questions (query, id, priority) the first `asked` ids of a priority of `least` or more. Without a community, or any
    node, what they would give is null.
    """
    ranked = found.where("kind = 1").withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("rank"))).where(F.col("r") <= top)
    near = g.cut(ranked.select("query", F.col("item").alias("id"), F.col("r").alias("rank")))
    kinds = near.join(nodes.select("id", "archetype"), "id").groupBy("query").agg(F.array_sort(F.collect_set("archetype")).alias("archetypes"))
    first = found.where("kind = 0").groupBy("query").agg(F.min_by("item", "rank").cast("int").alias("community"))
    bits = F.array_join(F.transform(q6.bits(F.col("hex_id")), lambda b: b.cast("string")), "")
    of = communities.select("community", "hex_id", bits.alias("bits"), g.skeleton(F.col("hex_id")).alias("skeleton"), dominant_ray(F.col("rays")).alias("ray"))
    urgent = questions.where(F.col("priority") >= least).withColumn("r", F.row_number().over(W.partitionBy("query").orderBy("id"))).where(F.col("r") <= asked)
    more = urgent.groupBy("query").agg(F.array_sort(F.collect_list("id")).alias("questions"))
    out = found.select("query").distinct().join(local_contexts(near, nodes, edges), "query", "left").join(kinds, "query", "left").join(first.join(of, "community"), "query", "left").join(more, "query", "left")
    return out.select("query", "labels", "relations", "archetypes", "community", "hex_id", "bits", "skeleton", "ray", "questions")
