"""Corpus preparation: quality, exact duplicates, near duplicates, benchmark passages, packing.

Each stage works on all that the stage before kept, and every stage but the last returns rows with the columns of
documents, whatever further ones there are. Decisions are made and applied by row: a doc_id that stands on several texts,
or is missing, neither saves nor drops another row. No rows give no rows; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sixfold.llm.common import ascii_lower, stored, table, tidy_driver, with_group
from sixfold.llm.decontaminate import contamination
from sixfold.llm.exact_dedup import exact_dedup
from sixfold.llm.near_copies import near_copies
from sixfold.llm.packing import pack
from sixfold.llm.quality import fit_quality, score_quality

#: Keys of dropped rows that may be broadcast (100 bytes each at most); beyond, the join is shuffled.
BROADCAST_KEYS = 1_000_000
#: The key that a stage gives its rows, or their texts.
KEY = "_pipeline_key"
#: The names that such keys, and ids, have where they are matched.
ID, OTHER = "_pipeline_id", "_pipeline_other"


#: Rows of an Arrow batch in the stages' session: a batch is held by the JVM and by Python at once, with the texts.
ARROW_ROWS = 1000


def _light(spark: SparkSession) -> None:
    """Sets that, and gives back what the driver has freed in the stages before."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    tidy_driver(spark)


def _without(docs: DataFrame, dropped: DataFrame, on: list[Column]) -> DataFrame:
    """docs without the rows that a row of dropped matches."""
    small = dropped.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(dropped) if small else dropped, on, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, fitted on a bounded sample of the labels, finds good: a score of 0.5 or more.

    Empty texts get the score of no words. Without labels nothing is known to be bad, and all rows stay.
    """
    _light(spark)
    model = fit_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    own = docs.withColumnRenamed("score", KEY) if "score" in docs.columns else docs
    tidy_driver(spark)  # of the sample
    kept = score_quality(own, model).where("score >= 0.5").drop("score")
    return kept.withColumnRenamed(KEY, "score").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of texts equal but for A-Z, the row with the largest doc_id; of several such rows one, of the least text.

    Rows without a doc_id stay only if no row of their group has one, and then one of them does.
    """
    _light(spark)
    found = exact_dedup(docs).where("group_size > 1")
    again = found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1")
    again = stored(again.select(F.col("doc_id").alias(ID), F.col("text_sha256").alias(OTHER)), "pipeline-exact-repeated")
    dropped = stored(found.where("not kept").select(F.col("doc_id").alias(ID), F.col("text_sha256").alias(OTHER)).distinct(), "pipeline-exact-dropped")
    rows = docs.withColumn(KEY, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256))
    on = [F.col("doc_id").eqNullSafe(F.col(ID)), F.col(KEY) == F.col(OTHER)]
    left = _without(rows, dropped, on)
    if again.isEmpty():
        return left.select(docs.columns)
    one = left.join(again, on, "left_semi").groupBy("doc_id", KEY).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row"))
    return _without(left, again, on).select(docs.columns).unionByName(one.select("row.*"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of texts that a chain of pairs with a 5-word Jaccard similarity of 0.8 or more links, the row with the smallest doc_id.

    Texts of five words or fewer, none too, are one shingle. Rows without a doc_id come last, and of several rows that come
    first one stays.
    """
    _light(spark)
    rows = stored(docs.withColumn(KEY, F.monotonically_increasing_id()), "pipeline-near-rows")
    found = near_copies(rows.select(F.col(KEY).alias("row"), F.col("text").cast("string").alias("text"))).withColumnRenamed("row", KEY)
    found = stored(found.join(rows.select(KEY, "doc_id"), KEY), "pipeline-near-found")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("least"), F.count("*").alias("size"))
    dropped = with_group(found, least, "component", "size").where(F.col(KEY) != F.col(f"least.{KEY}")).select(F.col(KEY).alias(OTHER))
    return _without(rows, stored(dropped, "pipeline-near-dropped"), [F.col(KEY) == F.col(OTHER)]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a window of a benchmark item; without items none."""
    _light(spark)
    text = F.sha2("text", 256)
    found = contamination(docs.select(text.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    dropped = stored(found.where("contaminated").select(F.col("doc_id").alias(OTHER)).distinct(), "pipeline-contaminated")
    return _without(docs.withColumn(KEY, text), dropped, [F.col(KEY) == F.col(OTHER)]).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with the doc_id as it is, of every row."""
    _light(spark)
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("packing", packing)]

#: No stage list with trained and iterative stages can be said in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
