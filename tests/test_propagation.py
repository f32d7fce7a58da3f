"""Ordered label propagation against a sequential sweep in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sixfold.operators.propagation import ordered_propagation, ordered_sweep


def sequential(n, edges, community, order):
    """One sweep in place: votes in the order of edges, the first community of equals, a pull of 1.5."""
    adjacent = {i: [] for i in range(n)}
    for s, t, w, _ in edges:
        if s in adjacent and t in adjacent:
            adjacent[s].append((t, w))
            adjacent[t].append((s, w))
    now = dict(community)
    for v in order:
        votes = {now[v]: 1.0}
        for u, w in adjacent[v]:
            votes[now[u]] = votes.get(now[u], 0.0) + w
        best = max(votes, key=votes.__getitem__)
        if best != now[v] and votes[best] > 1.5 * votes[now[v]]:
            now[v] = best
    return now


def graph(seed, n=60):
    """Weights are eighths, so that sums are exact and ties are frequent; loops, copies and loose ends are among the edges."""
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 12) / 8) for _ in range(3 * n)] + [(3, 3, 0.5), (1, 2, 1.0), (1, 2, 1.0), (5, 999, 1.0)]
    return [(s, t, w, i) for i, (s, t, w) in enumerate(edges)], {i: rng.randrange(4) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_one_sweep(spark, seed):
    edges, community = graph(seed)
    order = sorted(community, key=lambda v: (v * 29 % 17, v))
    e = spark.createDataFrame(edges, "source long, target long, weight double, ord int")
    m = spark.createDataFrame(list(community.items()), "node_id long, community int")
    got = ordered_sweep(e, m, lambda c: c * 29 % 17).collect()
    want = sequential(60, edges, community, order)
    assert {r.node_id: r.community for r in got} == want != community
    assert {r.node_id for r in got if r.moved} == {v for v in want if want[v] != community[v]}


def test_sweeps(spark):
    edges, community = graph(3)
    e = spark.createDataFrame(edges, "source long, target long, weight double, ord int")
    m = spark.createDataFrame(list(community.items()), "node_id long, community int")
    got, sweeps = ordered_propagation(e, m, order=lambda k, c: (c * 31 + k * 7) % 23)
    want, taken = community, 0
    while True:
        now = sequential(60, edges, want, sorted(community, key=lambda v: ((v * 31 + taken * 7) % 23, v)))
        taken += 1
        if now == want:
            break
        want = now
    assert {r.node_id: r.community for r in got.collect()} == want and sweeps == taken
    assert ordered_propagation(e.limit(0), m)[1] == 1


def test_rounds_follow_changes(spark):
    """A chain on which every node follows the one before takes a round for each; where nobody moves one is enough."""
    n = 12
    chain = [(i, i + 1, 4.0, i) for i in range(n - 1)] + [(0, 100 + i, 4.0, 50 + i) for i in range(3)]
    member = {i: 0 for i in range(n)} | {100 + i: 1 for i in range(3)}
    e = spark.createDataFrame(chain, "source long, target long, weight double, ord int")
    m = spark.createDataFrame(list(member.items()), "node_id long, community int")
    taken = []
    got = {r.node_id: r.community for r in ordered_sweep(e, m, lambda c: c, taken).collect()}
    nodes = {i: i for i in member}
    adjacent = [(s, t, w, o) for s, t, w, o in chain]
    now = dict(member)
    for v in sorted(nodes):
        votes = {now[v]: 1.0}
        for s, t, w, _ in adjacent:
            for a, b in ((s, t), (t, s)):
                if a == v:
                    votes[now[b]] = votes.get(now[b], 0.0) + w
        best = max(votes, key=votes.__getitem__)
        if best != now[v] and votes[best] > 1.5 * votes[now[v]]:
            now[v] = best
    assert got == now and taken[0] <= n + 2
    ordered_sweep(e, m.withColumn("community", F.lit(0)), lambda c: c, taken)
    assert taken[1] == 1
