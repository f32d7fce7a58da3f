"""The entity index over a stream, in any order of files and across a restart, against the batch index."""

import random

from pyspark.sql import functions as F

from sixfold.operators import text as t
from sixfold.streaming.index import indexed, start_index

SCHEMA = "doc_id long, text string"


def test_entity_index(spark, tmp_path):
    rng = random.Random(4)
    names = ["Alpha", "ALPHA", "Beta,", "Gamma", "gamma", "Delta", "Omega.", "word", "longer"]
    rows = [(i, " ".join(rng.choices(names, k=rng.randrange(1, 9)))) for i in range(60)] + [(100, None), (101, ""), (None, "Alpha Lost")]
    parts = [rows[lo::6] for lo in range(6)]
    rng.shuffle(parts)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "index")

    def arrive(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
        q = start_index(stream, out)
        q.awaitTermination()

    for part in parts[:3]:
        arrive(part)
    run()
    half = {r.entity: r for r in indexed(spark, out).collect()}
    for part in parts[3:]:
        arrive(part)
    run()  # a new query on the same folder
    run()  # and one that finds nothing new
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], SCHEMA)
    want = {r.entity: (r.label, r.mentions) for r in t.deduplicated(t.extracted(docs, ["doc_id"]), ["doc_id", "j"]).collect()}
    got = {r.entity: r for r in indexed(spark, out).collect()}
    assert {e: (r.label, r.mentions) for e, r in got.items()} == want
    changes = spark.read.parquet(f"{out}/changes")
    kinds = {r.entity: r.n for r in changes.where("kind = 'new'").groupBy("entity").agg(F.count("*").alias("n")).collect()}
    assert kinds == dict.fromkeys(want, 1)
    moved = {r.entity for r in changes.where("kind = 'moved'").collect()}
    assert {e for e, r in half.items() if (r.doc_id, r.j) != (got[e].doc_id, got[e].j)} <= moved
    assert changes.select("epoch").distinct().count() >= 6
