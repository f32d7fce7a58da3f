"""Entities and relations of texts by rules: capitalised terms, phrases of a vocabulary, acronyms, subjects before verbs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import q6, vectors
from . import graph, phrases, text

#: How many terms, phrases, acronyms and entities count; phrases and entities have more characters than these.
TERMS, PHRASES, ACRONYMS, ENTITIES, LONG_PHRASE, LONG_ENTITY, WEIGHT = 8, 6, 4, 10, 4, 3, 0.7
#: Words of the answer's format that aren't entities, what a text without any has, and the verbs after a subject.
NO_ENTITIES = ["JSON", "entities", "relations", "label", "source", "target", "weight", "type", "concept", "other", "place", "event", "person", "Верни", "Текст", "Сущности", "Связи", "Извлеки"]
STAND_INS = ["Объект", "Концепция"]
VERBS = ["является", "использует", "строит", "применяет", "содержит", "обеспечивает", "позволяет", "измеряет", "основан", "применяется", "представляет", "объединяет"]
#: A capitalised term, of any alphabet.
TERM = r"\p{Lu}\p{Ll}{3,}"
#: What stands between words.
APART = r"[^\p{L}\p{N}_]+"


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def entities(raw: Column, hits: Column) -> Column:
    """The terms, phrases and acronyms, in this order, without repeats and short ones."""

    def chosen(some: Column) -> Column:
        return F.slice(F.array_distinct(F.filter(some, lambda e: ~e.isin(NO_ENTITIES) & (F.length(e) > LONG_ENTITY))), 1, ENTITIES)

    terms = F.slice(F.regexp_extract_all(raw, F.lit(TERM), F.lit(0)), 1, TERMS)
    acronyms = F.slice(F.filter(F.split(raw, APART), lambda w: w.rlike("^[A-Z]{2,}$")), 1, ACRONYMS)
    found = F.transform(F.array(F.concat(terms, F.transform(hits, capitalized), acronyms)), chosen)[0]
    return F.transform(F.array(found), lambda e: F.when(F.size(e) == 0, F.array(*map(F.lit, STAND_INS))).otherwise(e))[0]


def relations(raw: Column, found: Column, verbs: list[str]) -> Column:
    """Each subject, a term before a verb, to the next one if it is another; without any the first entity to the second."""
    subjects = F.regexp_extract_all(raw, F.lit(rf"(?U)({TERM})\s+(?:{'|'.join(verbs)})"), F.lit(1))
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("target"))

    def linked(s: Column) -> Column:
        each = F.transform(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda a, i: pair(a, F.get(s, i + 1)))
        return F.filter(each, lambda p: (p["source"] != p["target"]) & ~p["source"].isin(NO_ENTITIES) & ~p["target"].isin(NO_ENTITIES))

    own = F.transform(F.array(subjects), linked)[0]
    first = F.when(F.size(found) >= 2, F.array(pair(F.get(found, F.lit(0)), F.get(found, F.lit(1))))).otherwise(F.array().cast("array<struct<source:string,target:string>>"))
    return F.transform(F.array(own), lambda r: F.when(F.size(r) > 0, r).otherwise(first))[0]


def extract(texts: DataFrame, vocabulary: DataFrame, verbs: list[str] = VERBS) -> DataFrame:
    """texts (key columns and text) with entities (labels) and relations (source, target) instead of the text.

    vocabulary: phrase, in lower case, and ord; its first phrases by ord that the lower-cased text holds anywhere count. A
    null text has neither entities nor relations.
    """
    known = vocabulary.where(F.length("phrase") > LONG_PHRASE).select("phrase", "ord")
    low = texts.where("text is not null").withColumn("raw", F.col("text")).withColumn("text", F.lower("text"))
    found = phrases.held(low, known, PHRASES).withColumn("entities", entities(F.col("raw"), F.col("hits")))
    return found.withColumn("relations", relations(F.col("raw"), F.col("entities"), verbs)).drop("raw", "text", "hits")


def index(docs: DataFrame, vocabulary: DataFrame, size: int = 512, overlap: int = 64, verbs: list[str] = VERBS, dim: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks (doc_id, chunk, entities, relations), nodes and edges of documents, chunk by chunk.

    nodes: entity (the lower-cased label), id, label of the first chunk that has it, archetype, embedding and hex_id. edges:
    source, target, label, weight, directed, a row for each relation whose ends are entities, and different ones.
    """
    found = graph.cut(extract(text.chunks(docs, size, overlap).select("doc_id", "chunk", "text"), vocabulary, verbs))
    each = found.select("doc_id", "chunk", F.posexplode("entities").alias("j", "label"))
    nodes = text.deduplicated(each, ["doc_id", "chunk", "j"]).drop("mentions")
    nodes = nodes.withColumn("id", F.substring("entity", 1, 12)).withColumn("archetype", text.guessed_archetype(F.col("label"), F.lit("concept")))
    nodes = nodes.withColumn("embedding", vectors.mock(F.col("label"), dim)).withColumn("hex_id", q6.embed(F.col("embedding")))
    nodes = graph.cut(nodes)
    pairs = found.select(F.explode("relations").alias("r")).select(F.lower(F.trim("r.source")).alias("source"), F.lower(F.trim("r.target")).alias("target")).where("source <> target")
    names = nodes.select("entity")
    kept = pairs.join(names.withColumnRenamed("entity", "source"), "source", "left_semi").join(names.withColumnRenamed("entity", "target"), "target", "left_semi")
    return found, nodes, kept.select("source", "target", F.lit("связан").alias("label"), F.lit(WEIGHT).alias("weight"), F.lit(True).alias("directed"))


def index_counts(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, n_communities: int = 6) -> DataFrame:
    """One row: n_chunks, n_entities, n_relations, n_nodes, n_edges, and n_communities that a node falls to."""
    own = chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(F.size("relations")), F.lit(0)).alias("n_relations"))
    member = graph.membership(nodes.select("id", "hex_id"), n_communities)
    of = nodes.agg(F.count("*").alias("n_entities"), F.count("*").alias("n_nodes"))
    out = own.join(of, F.lit(True)).join(edges.agg(F.count("*").alias("n_edges")), F.lit(True)).join(member.agg(F.countDistinct("community").alias("n_communities")), F.lit(True))
    return out.select("n_chunks", "n_entities", "n_relations", "n_nodes", "n_edges", "n_communities")
