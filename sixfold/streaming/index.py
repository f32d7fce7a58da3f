"""Incremental indexing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import scratch_path
from ..operators.text import extracted


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream: its one file, or all files of its folder."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path if _is_folder(spark, path) else f"{sf_dir}/{name}*.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, mentions, indexed as documents arrive: every micro-batch adds its own counts to a table, whose sum is the index."""
    out = scratch_path(spark)

    def add(batch: DataFrame, epoch: int) -> None:
        entity = F.lower(F.trim("label"))
        counts = extracted(batch.select("doc_id", "text"), ["doc_id"]).groupBy(entity.alias("entity")).agg(F.count("*").alias("mentions"))
        counts.write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}")  # a batch run again replaces itself

    q = _stream(spark, sf_dir, "documents").writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("entity string, mentions long, epoch int").parquet(f"{out}/table").groupBy("entity").agg(F.sum("mentions").alias("mentions"))


FIRST = "entity string, label string, doc_id long, j int, mentions long"
CHANGE = FIRST + ", kind string"


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each entity of a batch: its first mention and how many there are. A word of most documents so reaches
    the task that keeps it as a row for each batch, not for each document."""
    for b in batches:
        b = b.sort_values(["doc_id", "j"], kind="stable")
        first = b.groupby("entity", sort=False, as_index=False).agg(label=("label", "first"), doc_id=("doc_id", "first"), j=("j", "first"), mentions=("label", "size"))
        yield first[[x.split()[0] for x in FIRST.split(", ")]]


def _kept(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state of an entity is its first mention and their count; every update is told, and what it changed."""
    (entity,) = key
    before = state.get if state.exists else None
    best = before[1:3] + before[:1] if before else None  # doc_id, j, label
    mentions = before[3] if before else 0
    for b in rows:
        for r in b.itertuples(index=False):
            mentions += int(r.mentions)
            if best is None or (r.doc_id, r.j) < best[:2]:
                best = (int(r.doc_id), int(r.j), r.label)
    now = (best[2], best[0], best[1], mentions)
    state.update(now)
    kind = "new" if before is None else "moved" if now[:3] != tuple(before[:3]) else "counted"
    yield pd.DataFrame([(entity, *now, kind)], columns=[x.split()[0] for x in CHANGE.split(", ")])


def entity_changes(docs: DataFrame) -> DataFrame:
    """entity, label, doc_id, j, mentions, kind: the changes that a stream of documents (doc_id, text) makes to the index.

    An entity's label is that of its first mention by document and place in it, in whatever order documents arrive; kind
    tells whether it is new, its first mention moved, or it was only counted. Documents without an id aren't indexed.
    """
    each = extracted(docs.where("doc_id is not null").select("doc_id", "text"), ["doc_id"]).withColumn("entity", F.lower(F.trim("label")))
    each = each.select("entity", "label", F.col("doc_id").cast("long").alias("doc_id"), "j").mapInPandas(_combined, FIRST)
    return each.groupBy("entity").applyInPandasWithState(_kept, CHANGE, "label string, doc_id long, j int, mentions long", "update", GroupStateTimeout.NoTimeout)


def start_index(docs: DataFrame, path: str) -> StreamingQuery:
    """Starts to index a stream of documents in a folder: its progress, its state, and the changes of every micro-batch.

    A query that starts again on the folder goes on where the last one ended; a micro-batch that runs again replaces what it
    wrote.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")

    writer = entity_changes(docs).writeStream.outputMode("update").foreachBatch(write)
    return writer.option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """entity, label, doc_id, j, mentions: the index as the changes have left it."""
    changes = spark.read.schema(CHANGE + ", epoch int").parquet(f"{path}/changes")
    names = [x.split()[0] for x in FIRST.split(", ")][1:]
    return changes.groupBy("entity").agg(F.max_by(F.struct(*names), "epoch").alias("r")).select("entity", "r.*")


def first_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, label, mentions of all documents, indexed as they arrive."""
    path = scratch_path(spark)
    start_index(_stream(spark, sf_dir, "documents"), path).awaitTermination()
    return indexed(spark, path).select("entity", "label", "mentions")


def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """start, event_type, n: events per hour by event time, whatever order they come in.

    Every micro-batch adds its own counts to a table, whose sum is the result: nothing is kept in state, so it can't grow
    with the hours, and no event is too late to count.
    """
    out = scratch_path(spark)

    def add(batch: DataFrame, epoch: int) -> None:
        counts = batch.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
        counts.select(F.col("w.start").alias("start"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/table/epoch={epoch}")  # a batch run again replaces itself

    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    q = events.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    counts = spark.read.schema("start timestamp, event_type string, n long, epoch int").parquet(f"{out}/table")
    return counts.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.sum("n").alias("n"))
