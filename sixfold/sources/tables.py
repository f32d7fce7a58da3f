"""Graphs from the given tables, and snapshots of graphs as JSON documents or Parquet folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The sixteen archetypes (Material/Abstract, Static/Dynamic, Elementary/Complex, Ordered/Fluid) in the order in
#: which they win, with priority and keywords.
ARCHETYPE_ROWS = [
    ("MSEO", "Crystal", 3, "структура порядок решётка форма симметрия structure order lattice form symmetry"),
    ("MSEF", "Sand", 2, "частицы рассеяние хаос зерно порошок particles scatter chaos grain powder"),
    ("MSCO", "Building", 4, "здание конструкция архитектура инфраструктура building construction architecture infrastructure"),
    ("MSCF", "Forest", 3, "экосистема природа биом ландшафт ecosystem nature biome landscape"),
    ("MDEO", "Mechanism", 3, "механизм шестерня рычаг привод движение mechanism gear lever drive motion"),
    ("MDEF", "Organism", 4, "организм клетка бактерия адаптация жизнь organism cell bacteria adaptation life"),
    ("MDCO", "Machine", 5, "машина двигатель система технология автомат machine engine system technology automaton"),
    ("MDCF", "City", 5, "город транспорт население урбанизация сеть city transport population urbanization network"),
    ("ASEO", "Axiom", 4, "аксиома принцип закон теорема постулат axiom principle law theorem postulate"),
    ("ASEF", "Archetype", 3, "архетип образ символ прообраз паттерн archetype image symbol prototype pattern"),
    ("ASCO", "Theory", 5, "теория модель концепция фреймворк наука theory model concept framework science"),
    ("ASCF", "Culture", 4, "культура традиция ценности норма менталитет culture tradition values norm mentality"),
    ("ADEO", "Algorithm", 5, "алгоритм процедура шаг инструкция протокол algorithm procedure step instruction protocol"),
    ("ADEF", "Intuition", 2, "интуиция чувство инсайт эмоция спонтанность intuition feeling insight emotion spontaneity"),
    ("ADCO", "Program", 5, "программа система код архитектура платформа program system code architecture platform"),
    ("ADCF", "Society", 4, "общество социум сообщество движение политика society community movement politics social"),
]
ARCHETYPES = [code for code, *_ in ARCHETYPE_ROWS]
PRIORITIES = {code: priority for code, _, priority, _ in ARCHETYPE_ROWS}
KEYWORDS = {code: words.split() for code, _, _, words in ARCHETYPE_ROWS}


def archetype_table(spark: SparkSession) -> DataFrame:
    """ord, code, name, priority, keywords, quadrant, bits (material, dynamic, complex, ordered) and hex_id, the bits' number."""
    rows = [(i, code, name, priority, words.split()) for i, (code, name, priority, words) in enumerate(ARCHETYPE_ROWS)]
    out = spark.createDataFrame(rows, "ord int, code string, name string, priority int, keywords array<string>")
    bits = F.array(*[(F.substring("code", i + 1, 1) == x).cast("int") for i, x in enumerate("MDCO")])
    number = sum((F.shiftleft(F.get("bits", F.lit(i)), i) for i in range(1, 4)), F.get("bits", F.lit(0)))
    return out.withColumn("quadrant", F.substring("code", 1, 2)).withColumn("bits", bits).withColumn("hex_id", number)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def archetype(i: Column) -> Column:
    return F.get(F.array(*[F.lit(a) for a in ARCHETYPES]), i)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, embedding (ARRAY<DOUBLE>), archetype; ids are the order of insertion."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("embedding"),
        archetype(F.pmod("label", F.lit(16))).alias("archetype"),
        F.col("label").alias("topic"),
    )


def following(rows: DataFrame, steps: tuple[int, ...], width: int = 4096) -> DataFrame:
    """id, other: each row (id, topic) and those that come so many steps later among the rows of its topic, by id.

    Rows are numbered within ranges of `width` ids and the numbers of a topic's ranges added up, so that no task has to sort
    a whole topic.
    """
    ranged = rows.select("id", "topic", F.floor(F.col("id") / width).alias("r"))
    counts = ranged.groupBy("topic", "r").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("topic").orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("topic", "r").orderBy("id"))
    numbered = ranged.withColumn("own", own).join(counts.select("topic", "r", before.alias("before")), ["topic", "r"]).select("id", "topic", (F.col("own") + F.col("before")).alias("n"))
    ahead = numbered.select("id", "topic", F.explode(F.array(*[F.col("n") + s for s in steps])).alias("n"))
    return ahead.join(numbered.withColumnRenamed("id", "other"), ["topic", "n"]).select("id", "other")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, weight, directed: each vector to the 1st, 2nd, 3rd and 5th next one of its topic."""
    from ..functions import vectors

    n = nodes(spark, sf_dir).select("id", "topic", "embedding")
    pairs = following(n.select("id", "topic"), (1, 2, 3, 5)).select(F.col("id").alias("source"), F.col("other").alias("target"))
    v = n.select("id", "embedding")
    pairs = pairs.join(v.select(F.col("id").alias("source"), F.col("embedding").alias("a")), "source").join(v.select(F.col("id").alias("target"), F.col("embedding").alias("b")), "target")
    return pairs.select("source", "target", ((vectors.cosine(F.col("a"), F.col("b")) + 1) / 2).alias("weight"), (F.col("source") % 2 == 0).alias("directed"))


NODE = "id string, label string, archetype string, weight double, embedding array<double>, metadata map<string,string>"
EDGE = "source string, target string, label string, weight double, directed boolean"


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON snapshot, a document with arrays of both, which is read in byte ranges. Shorter embeddings
    are padded with zeros, a missing one is made from the label, edge fields get their defaults and edges without both ends
    are dropped."""
    from ..functions import vectors
    from ..operators.graph import cut
    from .document import array_elements

    elements = cut(array_elements(spark, path))
    n = elements.where("key = 'nodes'").select("ord", F.from_json("json", NODE).alias("n")).select("ord", "n.*")
    n = n.withColumn("embedding", F.coalesce("embedding", vectors.mock(F.col("label"))))
    longest = n.agg(F.max(F.size("embedding")).alias("dim"))
    n = n.join(F.broadcast(longest), F.lit(True)).withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0), F.col("dim") - F.size("embedding")))).drop("dim")
    e = elements.where("key = 'edges'").select("ord", F.from_json("json", EDGE).alias("e")).select("ord", "e.*")
    e = e.fillna({"label": "linked", "weight": 0.7, "directed": True})
    ids = n.select("id")
    return n, e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two Parquet folders; the JSON document is for small graphs, see snapshot_json()."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_document(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A snapshot as one JSON document: its elements a line each, in the order of their keys (a node's first column, an
    edge's first two) as text, which tell elements apart.

    One file is one task's work, which streams it; see snapshot_lines() for what no single task has to hold.
    """

    def lines(df: DataFrame, part: int) -> DataFrame:
        order = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns[: 1 if part == 1 else 2]])
        first = df.agg(F.min(order).alias("first"))
        comma = F.when(order == F.col("first"), "").otherwise(",")
        return df.join(F.broadcast(first), F.lit(True)).select(F.lit(part).alias("part"), order.alias("at"), F.concat(comma, F.to_json(F.struct(*df.columns))).alias("value"))

    signs = nodes.sparkSession.createDataFrame([(0, "", '{"nodes": ['), (2, "", '], "edges": ['), (4, "", "]}")], "part int, at string, value string")
    both = signs.unionByName(lines(nodes, 1)).unionByName(lines(edges, 3))
    both.coalesce(1).sortWithinPartitions("part", "at").select("value").write.mode("overwrite").text(path)


def snapshot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and edge: a snapshot that no single task has to hold."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("json")).unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("json")))


def payload(parts: dict[str, DataFrame]) -> DataFrame:
    """kind and json: the rows of each kind's table as JSON objects, in one table."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("json")) for kind, df in parts.items()])
