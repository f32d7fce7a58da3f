"""A map under batches of nodes and edges against a build of all that has come."""

import random

import pytest
from pyspark.sql import functions as F

from sixfold.functions import q6
from sixfold.operators import build, maintain
from sixfold.operators import graph as g

NODES = "id long, label string, embedding array<double>, archetype string"
EDGES = "source long, target long, weight double, directed boolean"


@pytest.fixture(scope="module")
def batches():
    rng = random.Random(12)
    node = lambda i: (i, f"node {i}", [rng.uniform(-1, 1) for _ in range(8)], rng.choice(["MSCF", "ADEO", "ASCO"]))
    edge = lambda n: (rng.randrange(n), rng.randrange(n), rng.randrange(1, 9) / 8, rng.random() < 0.5)
    first = ([node(i) for i in range(30)], [edge(34) for _ in range(50)])  # some ends come later
    second = ([node(i) for i in range(28, 36)], [edge(36) for _ in range(6)] + first[1][:2])  # 28 and 29 change, edges repeat
    third = ([], [edge(36) for _ in range(3)])
    fourth = ([node(36)], [])
    return [first, second, third, fourth]


def test_batches(spark, batches, monkeypatch):
    monkeypatch.setattr(maintain, "COMPACT", 3)
    state, nodes, edges = maintain.empty(spark, 6), {}, []
    for k, (some, more) in enumerate(batches):
        before = {r.community: r for r in state.signatures.collect()}
        state = maintain.add(state, spark.createDataFrame(some, NODES), spark.createDataFrame(more, EDGES))
        nodes.update({n[0]: n for n in some})
        edges += more
        n = spark.createDataFrame(list(nodes.values()), NODES).withColumn("hex_id", q6.embed(F.col("embedding")))
        e = spark.createDataFrame(edges, EDGES)
        member = g.membership(n, 6)
        assert {r.id: r.community for r in state.nodes.collect()} == {r.node_id: r.community for r in member.collect()}
        assert state.edges.count() == len(edges)
        degrees = {r.id: (r.degree, r.n_edges) for r in g.degrees(e).collect()}
        assert {r.id: (r.degree, r.n_edges) for r in state.degrees.collect()} == degrees
        assert state.modularity == pytest.approx(g.modularity(e, member).first().modularity)
        want = {r.community: r for r in build.signatures(n, e, member).collect()}
        got = {r.community: r for r in state.signatures.collect()}
        assert got.keys() == want.keys()
        for c, r in want.items():
            assert (got[c].n_nodes, got[c].dominant_archetype, got[c].short_label, got[c].hex_id, got[c].n_edges, got[c].skeleton) == (r.n_nodes, r.dominant_archetype, r.short_label, r.hex_id, r.n_edges, r.skeleton)
            assert got[c].center == pytest.approx(r.center) and got[c].rays == pytest.approx(r.rays) and got[c].tangram.area == pytest.approx(r.tangram.area)
        profiles = {r.community: r for r in maintain.profiles(state).collect()}
        inner = {r.community: r.w for r in g.intra_edges(e, member).groupBy("community").agg(F.sum("weight").alias("w")).collect()}
        for c, r in want.items():
            p = profiles[c]
            assert (p.n_nodes, p.hex_id, p.n_edges) == (r.n_nodes, r.hex_id, r.n_edges) and p.center == pytest.approx(r.center) and p.weight == pytest.approx(inner.get(c, 0.0))
        touched = {r.community for r in state.touched.collect()}
        if k >= 2:  # small batches leave most communities as they were
            assert len(touched) < len(want) and all(got[c] == before[c] for c in set(before) - touched)


def test_nothing(spark):
    state = maintain.empty(spark)
    state = maintain.add(state, spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    assert state.modularity == 0 and state.signatures.count() == 0
    state = maintain.add(state, spark.createDataFrame([], NODES), spark.createDataFrame([(1, 2, 0.5, True)], EDGES))
    assert state.totals.count() == 0 and state.degrees.count() == 2
