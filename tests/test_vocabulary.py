"""Texts embedded inside their rows, against the joined way and whatever a task works on at once."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest

from sixfold.operators import vocabulary

TEXTS = "i long, text string"


@pytest.fixture(scope="module")
def made():
    rng = random.Random(8)
    words = [a + b for a in ("ba", "ke", "lo", "ми", "nu", "re") for b in ("", "s", "ta", "x9")]
    known = words[:16] + [" ".join(rng.choices(words, k=n)) for n in (2, 3, 4) for _ in range(40)]
    known = sorted(set(known))
    rng.shuffle(known)
    texts = [" ".join(rng.choices([*words, "zq", "kelo", "a", "ta", "qqq"], k=n)) for n in [*range(8), 9, 40, 200]] + ["Ба? Ke-LO, nuta!", known[0], known[0] + " zq", "?!", "", None, "日本", "qqq"]
    texts += [" ".join("".join(rng.choices("abeklmnorstuхми", k=4)) for _ in range(30)) for _ in range(8)]
    rows = [(p, k, [rng.gauss(0, 1) for _ in range(3)]) for k, p in enumerate(known)]
    return rows, list(enumerate(texts))


@pytest.mark.parametrize("partly", [True, False])
def test_inside_rows(spark, made, partly):
    """The same as with joins, without a shuffle."""
    known, texts = made
    vocab = spark.createDataFrame(known, "phrase string, ord long, v array<double>")
    df = spark.createDataFrame(texts, TEXTS)
    inside = vocabulary.embed(df, "i", vocab, partly)
    assert "Exchange" not in inside._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r for r in inside.collect()}
    want = {r.i: r for r in vocabulary.embed(df, "i", vocab, partly, most=0).collect()}
    assert set(got) == set(want) == {i for i, _ in texts} and max(r.hits for r in got.values()) > 50
    for i in got:
        assert got[i].hits == want[i].hits and (got[i].v or []) == pytest.approx(want[i].v or []), texts[i]
    assert {i for i in got if not got[i].hits} >= {i for i, t in texts if t in (None, "", "?!", "日本", "qqq")}
    assert all((r.v is None) == (not partly and r.hits == 0) and None not in (r.v or []) for r in got.values())


def test_at_once(spark, made, monkeypatch):
    """Neither how many tokens a task works on at once nor how many it keeps has a part in the result."""
    known, texts = made
    w = vocabulary.whole(spark.createDataFrame(known, "phrase string, ord long, v array<double>"))
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t and t.lower() for _, t in texts])], names=["k", "text"])

    def rows():
        return [r for b in vocabulary._inside(SimpleNamespace(value=w), True)(iter([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)])) for r in b.to_pylist()]

    want = rows()
    assert [r[vocabulary.KEY] for r in want] == [i for i, _ in texts]
    monkeypatch.setattr(vocabulary, "AT_ONCE", 20)
    monkeypatch.setattr(vocabulary, "KEPT", 0)
    assert rows() == want


def test_whole(spark, made):
    """Vocabularies that aren't broadcast whole: too large, empty, or with vectors of several lengths or without numbers."""
    known, _ = made
    frame = lambda rows: spark.createDataFrame(rows, "phrase string, ord long, v array<double>")
    assert vocabulary.whole(frame(known)).vectors.shape == (len(known), 3)
    assert vocabulary.whole(frame(known), len(known) - 1) is None and vocabulary.whole(frame(known).limit(0)) is None
    for odd in (("new", 900, [1.0]), ("new", 900, None), ("new", 900, [1.0, None, 2.0]), (None, 900, [1.0, 2.0, 3.0]), ("new", None, [1.0, 2.0, 3.0])):
        assert vocabulary.whole(frame([*known, odd])) is None
