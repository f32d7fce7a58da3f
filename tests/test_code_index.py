"""The inverted index by codes: what it admits, and that only that is multiplied."""

import random

import pytest
from pyspark.sql import functions as F

from sixfold.functions import q6, vectors
from sixfold.operators.code_index import asked, build_index, candidates


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(8)
    near = [rng.gauss(0, 1) for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in near] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(9)]) for i in range(300)]  # a third crowd one code
    rows += [(300 + i, [0.0] * 9) for i in range(3)] + [(400, None)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("hex_id", q6.embed(F.col("embedding")))


@pytest.mark.parametrize("sound", [False, True])
@pytest.mark.parametrize("size, block", [(8192, 4096), (7, 3)])
def test_candidates(spark, nodes, sound, size, block):
    lsh, radius = vectors.Projections(3), 1
    every = {r.id: r for r in nodes.where("id < 400").select("*", lsh.codes(F.col("embedding")).alias("codes")).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    close = lambda a, b: (a ^ b).bit_count() <= radius
    tally = spark.sparkContext.accumulator(0)
    queries = asked(nodes.where("id % 20 = 0 and id < 400").select(F.col("id").alias("query"), F.col("embedding").alias("v")), lsh, radius)
    got = {}
    for r in candidates(build_index(nodes, lsh, sound, size), queries, radius, 5, tally, block).collect():
        got.setdefault(r.query, []).append((-r.score, r.id))
    admitted = products = 0
    for q in range(0, 301, 20):
        a = every[q]
        ways = {n: sum(close(x, y) for x, y in zip(a.codes, b.codes)) if sound else int(any(close(x, b.hex_id) for x in a.codes)) for n, b in every.items()}
        admitted += sum(w > 0 for w in ways.values())
        products += sum(ways.values())
        score = lambda b: round((sum(x * y for x, y in zip(a.embedding, b.embedding)) / norm(a.embedding) / norm(b.embedding) + 1) / 2, 6)  # noqa: B023, E731
        want = sorted((-score(every[n]), n) for n, w in ways.items() if w)[:5]
        found = sorted(got.get(q, []))
        assert [n for _, n in found] == [n for _, n in want] and [x for x, _ in found] == pytest.approx([x for x, _ in want])
    assert tally.value == products <= 3 * admitted and products < 0.7 * 16 * len(every)


def test_blocks_hold_one_code(spark, nodes):
    blocks = build_index(nodes, vectors.Projections(3), size=10).blocks.collect()
    assert sum(b["size"] for b in blocks) == 303 and max(b["size"] for b in blocks) <= 10
    assert {b.code for b in blocks} == {r.hex_id for r in nodes.where("id < 400").select("hex_id").distinct().collect()}
