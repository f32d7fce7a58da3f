"""Algebra of the 6-cube against plain Python."""

import random

from pyspark.sql import functions as F

from sixfold.functions import q6, vectors


def test_metric(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(64) for b in range(0, 64, 5)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    rows = pairs.select("a", "b", q6.hamming(a, b).alias("d"), q6.interval(a, b).alias("i"), q6.shortest_path(a, b).alias("p"), q6.ball(a, 2).alias("ball"), q6.from_bits(q6.bits(a)).alias("back"), q6.distances(a).alias("all")).collect()
    for r in rows:
        assert r.d == (r.a ^ r.b).bit_count() and r.back == r.a
        assert r.i == [h for h in range(64) if (r.a ^ h).bit_count() + (h ^ r.b).bit_count() == r.d] and len(r.i) == 2**r.d
        assert r.p[0] == r.a and r.p[-1] == r.b and len(r.p) == r.d + 1
        assert all((x ^ y).bit_count() == 1 and x ^ y < z for x, y, z in zip(r.p, r.p[1:], [64, *[x ^ y for x, y in zip(r.p, r.p[1:])]]))
        assert r.ball == [h for h in range(64) if (h ^ r.a).bit_count() <= 2]
        assert r.all == [(h ^ r.a).bit_count() for h in range(64)]


def test_packing_and_voronoi():
    assert q6.packing(2) == (0, 7, 25, 30, 42, 45, 51, 52) and q6.packing(3) == (0, 15, 51, 60)
    assert len(q6.packing(1)) == 32
    assert [q6.voronoi(q6.packing(1)[:4])[h] for h in range(16)] == [0, 0, 0, 3, 0, 5, 6, 3, 0, 0, 0, 3, 0, 5, 6, 3]


def test_embed(spark):
    """Padding, chunks and the case in which all are equal."""
    random.seed(1)
    vs = [[0.9, 0.8, 0.7, -0.5, -0.6, 0.8], [1.0] * 6, [0.2] * 6, [0.3, 0.1], [], [random.uniform(-1, 1) for _ in range(32)], None]
    got = [r.h for r in spark.createDataFrame([(v,) for v in vs], "v array<double>").select(q6.embed(F.col("v")).alias("h")).collect()]

    def plain(v):
        n = len(v)
        p = (v + [0.0] * 6)[:6] if n <= 6 else [sum(v[d * n // 6 : (d + 1) * n // 6]) / ((d + 1) * n // 6 - d * n // 6) for d in range(6)]
        mu = sum(p) / 6
        edge = 0.5 if all(abs(x - mu) < 1e-10 for x in p) else mu
        return sum(1 << i for i, x in enumerate(p) if x > edge)

    assert got[:-1] == [plain(v) for v in vs[:-1]] and got[-1] is None and got[0] == 39


def test_vectors(spark):
    rows = [("Граф",), ("",), ("a" * 500,)]
    got = spark.createDataFrame(rows, "t string").select("t", vectors.mock(F.col("t")).alias("e")).collect()
    for r in got:
        h = 0
        for c in r.t:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        for x in r.e:
            h = (h * 1664525 + 1013904223) & 0xFFFFFFFF
            assert abs(x - (h / 0x7FFFFFFF - 1)) < 1e-12
    m = vectors.rotation(42)
    assert all(abs(sum(x * y for x, y in zip(a, b)) - (i == j)) < 1e-9 for i, a in enumerate(m) for j, b in enumerate(m))
    zero = spark.range(1).select(vectors.normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("z"), vectors.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0))).alias("c")).first()
    assert zero.z == [0.0, 0.0] and abs(zero.c - 1) < 1e-12
