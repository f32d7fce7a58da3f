"""Hard negatives against all pairs, the bounds of the scan, and odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sixfold.llm import negatives
from sixfold.llm.negatives import OP11_SQL, Block, among_best, among_windows, hard_negatives, op11_negatives, windows_of


def plain(rows, every=5, pos=5, neg=3):
    ok = [(n, i, v, k) for n, (i, v, k) in enumerate(rows) if i is not None and k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = [(n, i, [int(np.floor(256 * float(x))) for x in v], k) for n, i, v, k in ok]
    out = Counter()
    for n, i, q, k in ok:
        if i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j, m, k == l) for m, j, v, l in ok if m != n))
        for s, j, _, _ in [x for x in scored if x[3]][:pos]:
            inside = [(t, h) for t, h, _, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:neg]
            for rank, (t, h) in enumerate(inside):
                out[(i, j, rank + 1, h, -s, -t)] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    near = [[rng.gauss(0, 1) for _ in range(20)] for _ in range(4)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.7))) for x in near[i % 4]], rng.choice([0, 0, 1, 2])) for i in range(150)]
    rows += [(200 + i, near[0], i % 3) for i in range(12)] + [rows[5], rows[5], (5, rows[5][1], 7)]  # ties and repeated rows
    rows += [(300, None, 1), (305, [1.0, None], 1), (310, [float("nan")] * 20, 1), (315, [float("inf")] * 20, 0), (None, near[1], 1), (320, near[1], None)]
    rows += [(325, [], 1), (330, near[2][:7], 0), (335, near[3] + [1.0] * 3, 2), (340, [0.0] * 20, 0), (345, [3e4 * x for x in near[0]], 1), (350, [2e7 * x for x in near[0]], 1)]
    return rows


@pytest.mark.parametrize("least", [negatives.LEAST, 20])
def test_hard_negatives(spark, rows, least, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST", least)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    more = df.selectExpr("*", "1 as row", "2 as id", "3 as q", "4 as block", "5 as anchor", "6 as score")
    want = plain(rows)
    assert len(want) > 100
    for frame in (df, more) if least > 20 else (df,):
        assert Counter(tuple(r) for r in hard_negatives(frame, F.col("vec_id") % 5 == 0).collect()) == want
    assert hard_negatives(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives(df, F.col("vec_id") < 0).count() == 0


def test_query(spark, sf, same):
    same(op11_negatives(spark, sf), OP11_SQL)


def test_scan_reads_less(rows):
    """Bounds drop most candidates before all columns are read, and lose none that counts."""
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(0, 1, (400, 64)) / np.arange(1, 65)).astype(np.int64)
    block = Block(np.arange(400), np.arange(400), np.zeros(400, np.int64), list(v))
    for i in range(0, 400, 40):
        exact = v @ v[i]
        left = []

        def seen(keep):
            def run(p, low, high):
                left.append(len(p))
                return keep(p, low, high)

            return run

        at, scores = block.scan(v[i], np.arange(400), seen(among_best(5)))
        assert (scores == exact[block.ids[at]]).all() and set(np.lexsort((np.arange(400), -exact))[:5]) <= set(block.ids[at].tolist())
        assert left[-1] < 100
        windows = windows_of(sorted(exact.tolist())[-4:], 50, 95)
        at, scores = block.scan(v[i], np.arange(400), seen(among_windows(windows, 3)))
        got = set(block.ids[at].tolist())
        for a, b in windows:
            inside = np.flatnonzero((exact >= a) & (exact <= b))
            assert set(inside[np.lexsort((inside, -exact[inside]))[:3]].tolist()) <= got
