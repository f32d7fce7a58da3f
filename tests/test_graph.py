"""Iterative graph operators against plain Python on a small graph."""

import random

import pytest

from sixfold.operators import graph as g


@pytest.fixture(scope="module")
def small():
    random.seed(5)
    pairs = {(min(a, b), max(a, b)) for a in range(40) for b in random.sample(range(40), 3) if a != b}
    return [(a, b, round(random.random(), 3), a % 2 == 0) for a, b in sorted(pairs)]


def test_hyper_edges(spark, small):
    e = spark.createDataFrame(small, "source long, target long, weight double, directed boolean")
    near = {}
    for a, b, *_ in small:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept, want = [], []
    for n in sorted(near):
        best = sorted(near[n], key=lambda x: (-len(near[n] & near[x]), x))[:7]
        ego = {n, *best}
        if len(ego) >= 3 and not any(len(ego & k) / max(len(ego), len(k)) > 0.8 for k in kept):
            kept.append(ego)
            want.append((n, sorted(ego)))
    assert sorted((r.node, r.members) for r in g.hyper_edges(e).collect()) == want


def test_label_propagation(spark, small):
    e = spark.createDataFrame(small, "source long, target long, weight double, directed boolean")
    m = spark.createDataFrame([(i, i % 4) for i in range(40)], "node_id long, community int")
    now = {i: i % 4 for i in range(40)}
    for _ in range(20):
        new = dict(now)
        for n in now:
            votes = {}
            for a, b, w, _d in small:
                if n in (a, b):
                    c = now[b if a == n else a]
                    votes[c] = votes.get(c, 0) + w
            mine = 1 + votes.pop(now[n], 0)
            if votes:
                c = max(votes, key=lambda c: (votes[c], -c))
                if votes[c] > 1.5 * mine:
                    new[n] = c
        if new == now:
            break
        now = new
    assert {r.node_id: r.community for r in g.label_propagation(e, m).collect()} == now


def test_empty(spark):
    e = spark.createDataFrame([], "source long, target long, weight double, directed boolean")
    m = spark.createDataFrame([(1, 0)], "node_id long, community int")
    assert g.modularity(e, m).first().modularity == 0.0
    assert g.hyper_edges(e).count() == 0
    assert [tuple(r) for r in g.label_propagation(e, m).collect()] == [(1, 0)]
