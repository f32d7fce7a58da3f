"""Shared pieces of the training-data operators: inputs, scratch tables, skew-safe lookups."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Binds value once inside an expression; body gets it as a lambda variable.

    The optimizer may otherwise copy an array expression into every element of a later transform().
    """
    return F.transform(F.array(value), body)[0]


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of its own only in a local session where none is configured (tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="sixfold-checkpoint-")
        sc.setCheckpointDir(configured)
    return configured


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, so a lost executor costs one read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/sixfold/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trim_jvm(spark: SparkSession) -> str:
    """Has the driver's JVM give the free memory of its C library back to the system; what it says, or nothing if it can't.

    The C library keeps what threads have freed, each in a place of its own, and a session of very many small queries has
    hundreds of threads. Only the interface of a bean server is open to calls from outside the JVM, not its class.
    """
    java, array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    of, kinds = java.Class.forName, array(java.Class, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = of(kind)
    values = array(java.Object, 4)
    values[0], values[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # older JVMs, or another C library
        return ""


def tidy_driver(spark: SparkSession) -> None:
    """On a cluster, gives the memory that the driver has freed back to the system: the heap's and C library's of its JVM, and Python's."""
    if not spark.sparkContext.master.startswith("local["):
        spark._jvm.System.gc()
        trim_jvm(spark)
        trim()


#: Whether the files that a session reads are kept in its cache of listings.
LISTINGS = "spark.sql.hive.manageFilesourcePartitions"


class Scratch:
    """Tables of the shared folder that are deleted when the computation is over; its result must be stored outside.

    tidy: on a cluster the driver's JVM collects its garbage after each table. Spark removes shuffle files and broadcasts of
    finished queries only then, and a computation of very many small queries otherwise keeps those of dozens. What the
    driver has freed then goes back to the system. Nor do the
    names of a table's files go to the session's cache of listings, which holds up to 250 MB of tables that are long deleted.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.path = spark, f"{checkpoint_dir(spark)}/sixfold/scratch-{uuid.uuid4().hex}"
        self.count, self.tidy = 0, tidy and not spark.sparkContext.master.startswith("local[")

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}-{tag}"
        df.write.parquet(path)
        if not self.tidy:
            return self.spark.read.schema(df.schema).parquet(path)
        tidy_driver(self.spark)
        kept = self.spark.conf.get(LISTINGS)
        self.spark.conf.set(LISTINGS, "false")
        try:
            return self.spark.read.schema(df.schema).parquet(path)
        finally:
            self.spark.conf.set(LISTINGS, kept)

    def drop(self, *tags: str) -> None:
        """Deletes the tables that were stored under these tags so far, or all of them."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(conf)
        if not tags:
            files.delete(path, True)
        elif files.exists(path):
            for x in files.listStatus(path):
                if x.getPath().getName().partition("-")[2] in tags:
                    files.delete(x.getPath(), True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A group with more than this share of all rows is looked up by broadcast; there can be no more than 1 / HOT_SHARE such groups.
HOT_SHARE = 1 / 2000


def with_group(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str) -> DataFrame:
    """rows left-joined with groups (one row a key, `size` = how many rows have that key), safe for hot keys.

    The groups above HOT_SHARE of all rows number 1 / HOT_SHARE at most, whatever the data, and are broadcast; every
    other key is small, so a plain shuffled join spreads it. Without such groups that join is all: a broadcast costs the
    driver threads and memory. Null keys match nothing and stay.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    least = max(1000, math.ceil((total or 0) * HOT_SHARE))
    if (most or 0) < least:
        return rows.join(groups, key, "left")
    others = [c for c in groups.columns if c not in ([key] if isinstance(key, str) else key)]
    hot = groups.where(F.col(size) >= least).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    near = marked.where("_hot").drop("_hot")
    far = marked.where("_hot is null").drop("_hot", *others).join(groups.where(F.col(size) < least), key, "left")
    return near.unionByName(far)


def trim() -> None:
    """Gives this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def light(run):
    """A function for mapInArrow that gives free memory back to the system when a task is over, since Python workers live on."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(values: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each value, without making str objects."""
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    for x in values.cast(kind):
        yield x.as_py()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
