"""Substring search by grams against plain search, also where nearly all labels and texts begin alike."""

import random

import pytest

from sixfold.operators.substring import build_index, found_in


@pytest.mark.parametrize("hot", [10_000, 25])
def test_found_in(spark, hot):
    rng = random.Random(3)
    labels = [(i, "item number " + "".join(rng.choices("abAB01 ", k=rng.randrange(0, 12)))) for i in range(200)]
    labels += [(300, ""), (301, None), (302, "x"), (303, "aaaaaaa"), (304, "Ünïcode ÄÄ"), (305, "item"), (306, "z" * 500)]
    texts = ["item number ab", "ITEM", "item number ", "b0", "a", "", None, "aaaa", "zzzz", "ünïcode ä", "not there at all", "item number q", "er 1", "01", "  "]
    texts += [t[rng.randrange(len(t)) :] for _, t in labels[:60:3]]
    nodes = spark.createDataFrame(labels, "id long, label string")
    asked = spark.createDataFrame(list(enumerate(texts)), "query long, text string")
    index = build_index(nodes, hot)
    got = sorted((r.query, r.id) for r in found_in(index, asked).collect())
    want = sorted((q, i) for q, t in enumerate(texts) for i, l in labels if t and l is not None and t.lower() in l.lower())
    assert got == want and len(want) > 200
    split = {r.gram: r.parts for r in index.counts.collect()}
    assert (split["ite"] > 1) == (hot == 25) and split["zzz"] == 1
    assert found_in(build_index(nodes.limit(0)), asked).count() == 0 and found_in(index, asked.limit(0)).count() == 0


def test_rarest_gram_decides(spark):
    """Texts that share their beginning are looked up by what follows: few postings meet."""
    nodes = spark.createDataFrame([(i, f"common beginning {i:05}") for i in range(2000)], "id long, label string")
    asked = spark.createDataFrame([(i, f"common beginning {i:05}") for i in range(0, 2000, 100)], "query long, text string")
    index = build_index(nodes)
    counts = {r.gram: r.n for r in index.counts.collect()}
    assert counts["com"] == 2000
    grams = lambda t: [t[k : k + 3] for k in range(len(t) - 2)]
    assert all(min(counts[x] for x in grams(f"common beginning {i:05}")) <= 250 for i in range(0, 2000, 100))
    assert sorted((r.query, r.id) for r in found_in(index, asked).collect()) == [(i, i) for i in range(0, 2000, 100)]
