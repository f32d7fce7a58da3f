"""Searches over a coded graph: nodes (id, label, embedding, archetype, hex_id), edges, members and communities.

Queries come as a table, so that one plan answers many; Hamming radii are equi-joins on the codes of a ball.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import q6, vectors
from . import substring
from .code_index import CodeIndex, asked, build_index, candidates

#: Words that name a domain in a question, in the order in which domains are tried, and the archetypes that go with it.
BOOST_WORDS = {
    "technology": ["алгоритм", "нейросет", "компил", "программ", "код", "систем"],
    "science": ["физик", "математ", "термо", "теори", "закон", "наук"],
    "biology": ["клетк", "днк", "ген", "организм", "экосис", "биол"],
    "urbanism": ["метро", "транспорт", "инфраструктур", "город", "улиц"],
}
BOOST_ARCHETYPES = {"technology": ["ADCO", "ADEO", "MDCO"], "science": ["ASCO", "ASEO", "ADEO"], "biology": ["MDEF", "MSCF", "MSEO"], "urbanism": ["MDCF", "MSCO", "MDCO"]}


def reachable(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """seed, id, level: nodes within `depth` steps, along edges and, if undirected, against them."""
    forth = edges.select(F.col("source").alias("id"), F.col("target").alias("to"))
    back = edges.where("not directed").select(F.col("target").alias("id"), F.col("source").alias("to"))
    steps = forth.unionByName(back).distinct()
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("level"))
    front = seen
    for level in range(1, depth + 1):
        front = front.join(steps, "id").select("seed", F.col("to").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    return seen


def local(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, top: int = 10) -> DataFrame:
    """seed, rank, id, level, distance: the reachable nodes nearest in Hamming distance, the smaller id among equals."""
    code = nodes.select("id", "hex_id")
    found = reachable(seeds, edges, depth).where("level > 0").join(code, "id").join(code.select(F.col("id").alias("seed"), F.col("hex_id").alias("own")), "seed")
    found = found.withColumn("distance", q6.hamming(F.col("own"), F.col("hex_id")))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= top).select("seed", "rank", "id", "level", "distance")


def local_score(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, n_edges, score: the mean weight of a node's edges, a loop once."""
    ends = F.array_distinct(F.array("source", "target"))
    each = edges.select(F.explode(ends).alias("id"), "weight").join(seeds.select("id"), "id", "left_semi")
    score = each.groupBy("id").agg(F.count("*").alias("n_edges"), F.avg("weight").alias("score"))
    return seeds.select("id").join(score, "id", "left").select(F.col("id").alias("seed"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("score", F.lit(0.0)).alias("score"))


def radial(communities: DataFrame, radius: int = 1) -> DataFrame:
    """community, other, distance: communities whose code lies within the radius."""
    around = communities.select("community", "hex_id", F.explode(q6.ball(F.col("hex_id"), radius)).alias("h"))
    other = communities.select(F.col("community").alias("other"), F.col("hex_id").alias("h"))
    return around.join(other, "h").where("community <> other").select("community", "other", q6.hamming(F.col("hex_id"), F.col("h")).alias("distance"))


def antipodal(communities: DataFrame) -> DataFrame:
    """community, opposite: the first community of the opposite code, or null."""
    first = communities.groupBy(F.col("hex_id").alias("h")).agg(F.min("community").alias("opposite"))
    return communities.select("community", q6.antipode(F.col("hex_id")).alias("h")).join(first, "h", "left").select("community", "opposite")


def between(communities: DataFrame) -> DataFrame:
    """a, b, way: for every community and its nearest other, the communities on shortest ways between their codes, by code."""
    near = radial(communities, 6).groupBy("community").agg(F.min_by("other", F.struct("distance", "other")).alias("other"))
    code = communities.select("community", "hex_id")
    ends = near.join(code, "community").join(code.select(F.col("community").alias("other"), F.col("hex_id").alias("h2")), "other")
    last = communities.groupBy("hex_id").agg(F.max("community").alias("on"))
    way = ends.select(F.col("community").alias("a"), F.col("other").alias("b"), F.explode(q6.interval(F.col("hex_id"), F.col("h2"))).alias("hex_id")).join(last, "hex_id")
    return way.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("hex_id", "on"))), lambda s: s["on"]).alias("way"))


def semantic_neighbors(seeds: DataFrame, nodes: DataFrame, top: int = 6) -> DataFrame:
    """seed, rank, id: the first nodes at Hamming distance one, in the order of insertion.

    Of each code only its `top` first nodes can be among them, so no more of a crowded code are joined.
    """
    first = W.partitionBy("hex_id").orderBy("id")
    few = nodes.select("id", "hex_id").withColumn("k", F.row_number().over(first)).where(F.col("k") <= top).select("id", F.col("hex_id").alias("h"))
    flips = seeds.select(F.col("id").alias("seed"), F.explode(q6.neighbors(F.col("hex_id"))).alias("h"))
    ranked = flips.join(few, "h").withColumn("rank", F.row_number().over(W.partitionBy("seed").orderBy("id")))
    return ranked.where(F.col("rank") <= top).select("seed", "rank", "id")


def stage1_counts(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, n: how many nodes have a code in the union of the query's balls, from a table of 64 counts. queries: see asked()."""
    per_code = nodes.groupBy("hex_id").agg(F.count("*").alias("k"))
    each = queries.select("query", F.explode("ball").alias("hex_id"))
    return each.join(F.broadcast(per_code), "hex_id").groupBy("query").agg(F.sum("k").alias("n"))


def boost(text: Column, archetype: Column, words: dict[str, list[str]] = BOOST_WORDS, archetypes: dict[str, list[str]] = BOOST_ARCHETYPES) -> Column:
    """0.15 if the first domain whose words the text holds goes with the archetype, else 0."""
    q = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0.0)
    for domain, its in reversed(words.items()):
        named = F.lit(False)
        for w in its:
            named = named | F.contains(q, F.lit(w))
        out = F.when(named, F.when(archetype.isin(archetypes[domain]), 0.15).otherwise(0.0)).otherwise(out)
    return out


def community_candidates(queries: DataFrame, communities: DataFrame, radius: int, borders: DataFrame | None = None) -> DataFrame:
    """query, community, score, distance: cosine with the community's signature, blended with distance and coverage.

    queries: as code_index.asked() gives them, with text if archetypes count; communities: community, hex_id, and
    dominant_archetype then. borders (a, b): neighbours of what the balls hold are candidates too, with a coverage of 0.1.
    """
    few = communities.select("community", "hex_id", *[c for c in ("dominant_archetype", "ifs") if c in communities.columns])
    found = queries.select("query", F.explode("ball").alias("hex_id")).join(F.broadcast(few.select("community", "hex_id")), "hex_id").select("query", "community", F.lit(False).alias("beside"))
    if borders is not None:
        both = borders.select("a", "b").unionByName(borders.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        beside = found.join(F.broadcast(both), F.col("community") == F.col("a")).select("query", F.col("b").alias("community"), F.lit(True).alias("beside"))
        found = found.unionByName(beside).groupBy("query", "community").agg(F.min("beside").alias("beside"))
    found = found.join(F.broadcast(few), "community").join(queries, "query")
    bits = F.transform(q6.bits(F.col("hex_id")), lambda b: b.cast("double"))
    cosine = (vectors.cosine(vectors.padded(F.col("v")), bits) + 1) / 2
    extra = boost(F.col("text"), F.col("dominant_archetype")) if "text" in queries.columns and "dominant_archetype" in few.columns else F.lit(0.0)
    steps = q6.hamming(F.col("own"), F.col("hex_id"))
    cover = F.when(F.col("beside"), 0.1).otherwise(vectors.coverage(F.col("codes"), F.col("hex_id"), radius))
    nearness = (1 - steps / F.lit(7.0)) * 0.7 + cover * 0.3
    return found.select("query", "community", (F.least(F.lit(1.0), cosine + extra) * 0.6 + nearness * 0.4).alias("score"), steps.cast("double").alias("distance"))


def ann(queries: DataFrame, nodes: DataFrame, communities: DataFrame, clusters: DataFrame, borders: DataFrame | None = None, k: int = 10, radius: int = 2, projections: int = 3, index: CodeIndex | None = None) -> DataFrame:
    """query, rank, kind, item, score: nodes and communities of stage one, the 2k best of them, with the clusters that
    hold such nodes, and of all these the k best. Communities go before nodes before clusters among equals.

    index: one of the nodes that is there already, in either mode; else a "compat" one is built. If queries have ifs
    (coefficients of a border) and communities too, the communities among the 2k best are scored again with how near
    these are.
    """
    index = index or build_index(nodes, vectors.Projections(projections))
    queries = asked(queries, index.lsh, radius)
    kind = lambda df, item, n: df.select("query", F.lit(n).alias("kind"), F.col(item).cast("long").alias("item"), F.round("score", 6).alias("score"))
    best = candidates(index, queries, radius, 2 * k)
    first = kind(community_candidates(queries, communities, radius, borders), "community", 0).unionByName(kind(best, "id", 1))
    order: list[Column] = [F.desc("score"), F.col("kind"), F.col("item")]
    by_query = W.partitionBy("query").orderBy(*order)
    top = first.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= 2 * k).drop("r")
    if "ifs" in queries.columns and "ifs" in communities.columns:
        theirs = F.broadcast(communities.select(F.lit(0).alias("kind"), F.col("community").cast("long").alias("item"), F.col("ifs").alias("own")))
        top = top.join(theirs, ["kind", "item"], "left").join(queries.select("query", "ifs"), "query")
        again = 0.7 * F.col("score") + 0.3 / (1 + 2 * vectors.distance(F.col("own"), F.col("ifs")))
        top = top.select("query", "kind", "item", F.when(F.col("own").isNull() | F.col("ifs").isNull(), F.col("score")).otherwise(F.round(again, 6)).alias("score"))
    member = clusters.select(F.col("node").cast("long").alias("cluster"), "n", F.explode("members").alias("item"))
    held = top.where("kind = 1").join(member, "item").groupBy("query", "cluster", "n").agg(F.sum("score").alias("total"), F.count("*").alias("k"))
    held = held.select("query", F.lit(2).alias("kind"), F.col("cluster").alias("item"), F.round(F.col("total") / F.col("n") * (0.7 + 0.3 * F.col("k") / F.col("n")), 6).alias("score"))
    final = top.unionByName(held).withColumn("rank", F.row_number().over(by_query))
    return final.where(F.col("rank") <= k).select("query", "rank", "kind", "item", "score")


def by_label(labels: DataFrame, nodes: DataFrame, dim: int = 6) -> DataFrame:
    """query, v: for each searched text (query, text) the embedding of the first node whose label holds it, whatever the
    case, else zeros."""
    first = label_matches(labels, nodes).groupBy("query").agg(F.min_by("embedding", "id").alias("v"))
    return labels.select("query").join(first, "query", "left").select("query", F.coalesce("v", F.array_repeat(F.lit(0.0), dim)).alias("v"))


def label_matches(labels: DataFrame, nodes: DataFrame, index: substring.GramIndex | None = None) -> DataFrame:
    """query, id, label, embedding of the nodes whose label holds the text, whatever the case; labels: query, text.

    index: one of the nodes' labels that is there already. Null and empty texts find nothing.
    """
    found = substring.found_in(index or substring.build_index(nodes), labels)
    return found.join(nodes.select("id", "label", "embedding"), "id").select("query", "id", "label", "embedding")


def facade(texts: DataFrame, nodes: DataFrame, edges: DataFrame, clusters: DataFrame, communities: DataFrame, questions: DataFrame, top: int = 10) -> DataFrame:
    """query, part, rank, item: what a question text brings together, for texts (query, text, node; node may be null).

    question: the text's expansion (query, id), in the order of its ids' numbers. local: the nodes around `node`. community:
    the first communities. hyper_edge: the first clusters (node, members) with a member whose label holds the text. Of
    the last three `top` at most.
    """
    row = lambda df, part, item: df.select("query", F.lit(part).alias("part"), F.col("rank").cast("int").alias("rank"), F.col(item).cast("string").alias("item"))
    asked_ = questions.withColumn("rank", F.substring("id", 2, 9).cast("int"))
    seeds = texts.where("node is not null").select(F.col("node").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    around = local(seeds, nodes, edges, top=top).join(texts.select("query", F.col("node").alias("seed")), "seed")
    first = communities.select("community").distinct().orderBy("community").limit(top)
    first = first.agg(F.array_sort(F.collect_list("community")).alias("of"))
    listed = texts.select("query").join(F.broadcast(first), F.lit(True)).select("query", F.posexplode("of").alias("p", "community")).withColumn("rank", F.col("p") + 1)
    member = clusters.select(F.col("node").alias("cluster"), F.explode("members").alias("id"))
    held = label_matches(texts.select("query", "text"), nodes).join(member, "id").select("query", "cluster").distinct()
    held = held.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("cluster"))).where(F.col("rank") <= top)
    return row(asked_, "question", "id").unionByName(row(around, "local", "id")).unionByName(row(listed, "community", "community")).unionByName(row(held, "hyper_edge", "cluster"))
