"""Whole maps, numbering, searches and snapshots against plain Python."""

import json
import random

from pyspark.sql import functions as F

from sixfold.functions import q6, vectors
from sixfold.operators import build, rag, search
from sixfold.operators import code_index
from sixfold.operators.nearest import cosine_topk
from sixfold.sources.tables import following, read_snapshot, write_snapshot

NODES = "id long, label string, embedding array<double>, archetype string"
EDGES = "source long, target long, weight double, directed boolean"


def small(spark, n=40, seed=2):
    rng = random.Random(seed)
    rows = [(i, f"node {i}", [rng.uniform(-1, 1) for _ in range(8)], rng.choice(["MSCF", "ADEO", ""])) for i in range(n)]
    edges = [(i, j, round(rng.uniform(0.3, 1), 3), i % 2 == 0) for i in range(n) for j in range(i + 1, min(n, i + 4))]
    return spark.createDataFrame(rows, NODES).withColumn("hex_id", q6.embed(F.col("embedding"))), spark.createDataFrame(edges, EDGES), rows, edges


def test_build(spark):
    nodes, edges, rows, pairs = small(spark)
    built = build.build(nodes, edges)
    member = {r.node_id: r.community for r in built.members.collect()}
    assert set(member) == set(range(40))
    for r in built.communities.collect():
        own = [i for i in member if member[i] == r.community]
        assert r.n_nodes == len(own)
        mean = [sum(rows[i][2][k] for i in own) / len(own) for k in range(8)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(mean, r.center))
        weights = [w for s, t, w, _ in pairs if member[s] == member[t] == r.community]
        assert r.n_edges == len(weights) and (abs(r.rays[0] - sum(weights) / len(weights)) < 1e-9 if weights else r.rays == [0.5] * 7)
        assert r.tangram.shape == {1: "polygon", 2: "rectangle"}.get(len(own), r.tangram.shape)
        assert r.short_label.split(":")[1].split(",") == [rows[i][1][:6] for i in sorted(own)[:2]]
    total = 2 * sum(w for *_, w, _ in pairs)
    degree = {i: sum(w for s, t, w, _ in pairs if i in (s, t)) for i in member}
    want = sum(2 * (w - degree[s] * degree[t] / total) for s, t, w, _ in pairs if member[s] == member[t]) / total
    s = build.summary(built).first()
    assert abs(s.modularity - want) < 1e-9 and (s.n_nodes, s.n_edges) == (40, len(pairs)) and sum(s.shapes.values()) == s.n_communities
    assert all(len(set(r.members)) >= 3 and r.tangram.vertices >= 1 for r in built.hyper_edges.collect())


def test_small_communities(spark):
    """One node, two nodes, and no inner edges."""
    rows = [(1, "a", [1.0] + [0.0] * 5, "MSCF"), (2, "b", [0.0] * 5 + [1.0], None), (3, "c", [0.0] * 5 + [1.5], "MSCF")]
    nodes = spark.createDataFrame(rows, NODES).withColumn("hex_id", q6.embed(F.col("embedding")))
    member = spark.createDataFrame([(1, 0), (2, 7), (3, 7)], "node_id long, community int")
    got = {r.community: r for r in build.signatures(nodes, spark.createDataFrame([], EDGES), member).collect()}
    assert (got[0].tangram.shape, got[7].tangram.shape) == ("polygon", "rectangle") and got[0].rays == got[7].rays == [0.5] * 7
    assert got[7].dominant_archetype == "MSCF" and got[0].short_label == "MSCF:a"


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, label string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, label string, at int")
    assert {tuple(r) for r in build.upsert(old, new, order="at").collect()} == {(1, "a"), (2, "y"), (3, "z")}


def test_following(spark):
    """Numbers run on across ranges, whatever lies between."""
    rng = random.Random(1)
    rows = sorted({(rng.randrange(3000), rng.randrange(3)) for _ in range(300)})
    rows = list({i: (i, t) for i, t in rows}.values())
    want = set()
    for t in range(3):
        own = [i for i, x in rows if x == t]
        want |= {(a, own[k + s]) for k, a in enumerate(own) for s in (1, 3) if k + s < len(own)}
    got = following(spark.createDataFrame(rows, "id long, topic int"), (1, 3), width=16)
    assert {tuple(r) for r in got.collect()} == want


def test_topk(spark, monkeypatch):
    """Several blocks of queries and of the corpus, with and without masks."""
    from sixfold.operators import nearest

    monkeypatch.setattr(nearest, "BLOCK", 7)
    monkeypatch.setattr(nearest, "GROUP", 2)
    nodes, _, rows, _ = small(spark, 60)
    unit = nodes.select("id", vectors.normalize(F.col("embedding")).alias("v"), (F.col("id") % 5).alias("code"))
    norm = {i: sum(x * x for x in v) ** 0.5 for i, _, v, _ in rows}
    cos = lambda a, b: round(sum(x * y for x, y in zip(rows[a][2], rows[b][2])) / norm[a] / norm[b], 5)
    got = {(r.id, r["rank"]): r.other for r in cosine_topk(unit.where("id % 2 = 0"), unit, 3).collect()}
    for a in range(0, 60, 2):
        best = sorted((b for b in range(60) if b != a), key=lambda b: (-cos(a, b), b))[:3]
        assert [got[a, k] for k in (1, 2, 3)] == best


def test_search(spark):
    """Labels, boosts, neighbours through borders, and the second look at communities by their borders."""
    nodes, edges, rows, _ = small(spark)
    asked = spark.createDataFrame([(1, "NODE 3"), (2, "e"), (3, "zzz"), (4, "39")], "query long, text string")
    got = {(r.query, r.id) for r in search.label_matches(asked, nodes).collect()}
    assert got == {(q, i) for q, t in ((1, "node 3"), (2, "e"), (4, "39")) for i, label, *_ in rows if t in label}
    v = {r.query: r.v for r in search.by_label(asked, nodes).collect()}
    assert v[1] == rows[3][2] and v[3] == [0.0] * 6
    texts = spark.createDataFrame([("алгоритм в городе", "ADCO"), ("Город", "MDCF"), ("город", "ADCO"), (None, "ADCO")], "t string, a string")
    assert [r.b for r in texts.select(search.boost(F.col("t"), F.col("a")).alias("b")).collect()] == [0.15, 0.15, 0.0, 0.0]
    communities = spark.createDataFrame([(k, k, [0.1 * k] * 8) for k in range(0, 64, 9)], "community int, hex_id int, ifs array<double>")
    queries = nodes.where("id < 5").select(F.col("id").alias("query"), F.col("embedding").alias("v"))
    lsh = vectors.Projections(3)
    plain = {(r.query, r.community) for r in search.community_candidates(code_index.asked(queries, lsh, 1), communities, 1).collect()}
    borders = spark.createDataFrame([(0, 9), (9, 18), (27, 36)], "a int, b int")
    beside = {(r.query, r.community) for r in search.community_candidates(code_index.asked(queries, lsh, 1), communities, 1, borders).collect()}
    near = {(a, b) for a, b in ((0, 9), (9, 18), (27, 36))}
    assert beside == plain | {(q, y) for q, x in plain for a, b in near for x2, y in ((a, b), (b, a)) if x2 == x}
    clusters = spark.createDataFrame([], "node long, members array<long>, n int")
    first = {(r.query, r.kind, r.item): r.score for r in search.ann(queries, nodes, communities, clusters, k=30).collect()}
    again = {(r.query, r.kind, r.item): r.score for r in search.ann(queries.withColumn("ifs", F.array_repeat(F.lit(0.9), 8)), nodes, communities, clusters, k=30).collect()}
    ifs = {k: [0.1 * k] * 8 for k in range(0, 64, 9)}
    for key in set(first) & set(again):
        far = sum((x - 0.9) ** 2 for x in ifs[key[2]]) ** 0.5 if key[1] == 0 else None
        assert abs(again[key] - (first[key] if far is None else 0.7 * first[key] + 0.3 / (1 + 2 * far))) < 2e-6


def test_contexts(spark):
    local = spark.createDataFrame([(1, ["a", "b"], "a -> b"), (2, ["c"], "none"), (3, ["d"], "none")], "query long, labels array<string>, relations string")
    lines = spark.createDataFrame([(0, "first " + "x" * 600, ["a", "q"]), (1, "second", ["z"])], "community int, line string, sources array<string>")
    asked = spark.createDataFrame([(1, "local"), (2, "global"), (3, "hybrid")], "query long, mode string")
    got = {r.query: r for r in rag.contexts(asked, local, lines).collect()}
    assert got[1].context == "Entities: a, b\nRelations: a -> b" and got[1].sources == ["a", "b"]
    assert got[2].context.split("\n")[1] == "  second" and got[2].sources == ["a", "q", "z"]
    assert got[3].sources == ["d", "a", "q", "z"] and got[3].context.endswith("x" * 100) and "second" not in got[3].context


def test_snapshots(spark, tmp_path):
    """A JSON document with gaps, and two folders of a graph."""
    doc = {"saved_at": "now", "nodes": [{"id": "a", "label": "A", "embedding": [1.0, 2.0]}, {"id": "b", "label": "B", "embedding": [1.0, 2.0, 3.0]}], "edges": [{"source": "a", "target": "b"}, {"source": "a", "target": "gone", "weight": 0.2}]}
    path = tmp_path / "snapshot.json"
    path.write_text(json.dumps(doc))
    nodes, edges = read_snapshot(spark, str(path))
    assert {r.id: r.embedding for r in nodes.collect()} == {"a": [1.0, 2.0, 0.0], "b": [1.0, 2.0, 3.0]}
    assert [(r.source, r.target, r.label, r.weight, r.directed) for r in edges.collect()] == [("a", "b", "linked", 0.7, True)]
    write_snapshot(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph" / "nodes")).count() == 2 and spark.read.parquet(str(tmp_path / "graph" / "edges")).count() == 1
