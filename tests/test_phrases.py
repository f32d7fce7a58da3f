"""Phrases found by the automaton, against plain substring search."""

import random

import pytest
from pyspark.sql import functions as F

from sixfold.operators import lookup, phrases, vocabulary


@pytest.fixture(scope="module")
def words():
    rng = random.Random(6)
    syllables = ["ba", "ke", "lo", "mi", "nu", "re", "so", "ta"]
    some = sorted({"".join(rng.choices(syllables, k=rng.randrange(1, 6))) for _ in range(4000)})
    two = [f"{rng.choice(some)} {rng.choice(some)}" for _ in range(400)]
    return some + sorted(set(two)), rng


@pytest.mark.parametrize("part", [100_000, 700])
def test_partly(spark, words, part):
    """More than 2,000 phrases, in one part or several; the first phrase by ord wins."""
    known, rng = words
    rng = random.Random(1)
    order = known[:]
    rng.shuffle(order)
    assert len(order) > 2000
    tokens = [*rng.sample(known, 200), *["".join(rng.choices("abeiklmnorstu", k=rng.randrange(1, 9))) for _ in range(300)], "x" * 5000, "xba", "q"]
    vocab = spark.createDataFrame(list(zip(order, range(len(order)))), "phrase string, ord long")
    df = spark.createDataFrame([(t,) for t in tokens] * 2, "token string")
    want = {}
    for t in set(tokens):
        hits = [i for i, p in enumerate(order) if p in t or t in p]
        if hits:
            want[t] = min(hits)
    rows = phrases.partly(df, vocab, part).collect()
    assert {r.token: r.ord for r in rows} == want and len(rows) == len(want)
    assert phrases.partly(df, vocab.limit(0)).count() == 0 and phrases.partly(df.limit(0), vocab).count() == 0


@pytest.mark.parametrize("part", [100_000, 700])
def test_held(spark, words, part):
    known, rng = words
    texts = [(i, " ".join(rng.choices(known, k=rng.randrange(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "b" * 3000)]
    vocab = spark.createDataFrame(list(zip(known, range(len(known)))), "phrase string, ord long")
    got = {r.i: r.hits for r in phrases.held(spark.createDataFrame(texts, "i long, text string"), vocab, 6, part).collect()}
    assert got == {i: [p for p in known if p in (t or "")][:6] for i, t in texts}


@pytest.mark.parametrize("few", [100_000, 3])
def test_embed(spark, words, few, monkeypatch):
    """The plain rule over positions, also where the vocabulary is too large to be broadcast and one word is in most texts."""
    known, rng = words
    monkeypatch.setattr(lookup.looked_up, "__defaults__", ("inner", few))
    monkeypatch.setattr(lookup, "HOT_LEAST", 20)
    vectors = {p: [rng.gauss(0, 1) for _ in range(3)] for p in known}
    order = {p: i for i, p in enumerate(known)}
    texts = [(i, " ".join(["ba"] * 5 + rng.choices(known, k=4) + ["xq", "zba", rng.choice(known)[:-1]])) for i in range(20)] + [(50, None), (51, ""), (52, "?!")]
    vocab = spark.createDataFrame([(p, order[p], v) for p, v in vectors.items()], "phrase string, ord long, v array<double>")
    got = {r.i: r for r in vocabulary.embed(spark.createDataFrame(texts, "i long, text string"), "i", vocab, partly=True).collect()}
    for i, t in texts[:20]:
        w, found = t.split(), []
        for k in range(len(w)):
            size = next((n for n in (3, 2, 1) if " ".join(w[k : k + n]) in vectors), None)
            if size:
                found.append((size, vectors[" ".join(w[k : k + size])]))
            elif first := next((p for p in known if p in w[k] or w[k] in p), None):
                found.append((0.6, vectors[first]))
        mean = [sum(s * v[d] for s, v in found) / sum(s for s, _ in found) for d in range(3)]
        norm = sum(x * x for x in mean) ** 0.5
        assert got[i].hits == len(found) and got[i].v == pytest.approx([x / norm for x in mean])
    assert got[52].hits == 0 and len(got[52].v) == 6 and len(got) == len(texts)
    plain = vocabulary.embed(spark.createDataFrame(texts, "i long, text string"), "i", vocab.drop("ord"))
    assert plain.where(F.col("i") == 52).first().v is None and plain.count() == len(texts)
