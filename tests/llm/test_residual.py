"""Hierarchical packing: whole ids, gapless sequences, and as few of them as a best-fit over all documents needs."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sixfold.llm.common import tokenizer_path
from sixfold.llm.packing import END
from sixfold.llm.residual import best_fit, op13_residual_packing, residual_pack


def plain_best_fit(sizes, capacity):
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [b for b in bins if b + n <= capacity]
        if fits:
            bins.remove(max(fits))
        bins.append((max(fits) if fits else 0) + n)
    return sorted(bins)


def test_best_fit():
    rng = random.Random(4)
    for _ in range(100):
        sizes = [rng.randrange(1, 101) for _ in range(rng.randrange(0, 60))]
        bins, places, fill = best_fit(np.array(sizes, np.int64), 100)
        assert sorted(fill.tolist()) == plain_best_fit(sizes, 100)
        for b in range(len(fill)):
            at = 0
            for i in sorted(np.flatnonzero(bins == b), key=lambda i: places[i]):
                assert places[i] == at
                at += sizes[i]
            assert at == fill[b] <= 100


def held(rows, texts, length):
    """Checks ids and places of all pieces; the number of sequences."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    ids = [(i, np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() + END) for i, x in texts]
    want = Counter()
    for i, x in ids:
        total = len(x) // 4
        first = total % length or length
        for p, (a, b) in enumerate(zip([0, *range(first, total, length)], [*range(first, total, length), total])):
            want[(i, p, a, b - a, zlib.crc32(x[4 * a : 4 * b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for its in sequences.values():
        its.sort()
        assert its[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(its, its[1:])) and sum(its[-1]) <= length
    return len(sequences)


@pytest.mark.parametrize("items, fan", [(50_000, 16), (12, 3), (3, 2)])
def test_residual_pack(docs, clashing, nothing, texts, items, fan):
    rows = residual_pack(docs, items=items, fan=fan).collect()
    n = held(rows, texts, 2048)
    sizes = [r.length for r in rows]
    best = len(plain_best_fit(sizes, 2048))
    assert math.ceil(sum(sizes) / 2048) <= n <= best + (2 if items > 3 else 6)
    if fan == 3:
        other = residual_pack(clashing, items=items, fan=fan)
        assert held(other.collect(), texts, 2048) <= best + 2 and residual_pack(nothing).count() == 0


def test_merged_bins_stay_bounded(spark):
    """Documents over half a sequence in most leaves, short ones in few: bins meet over several rounds."""
    texts = [(i, " word" * (1200 if i % 4 else 300)) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    n = held(residual_pack(docs, items=2, fan=2).collect(), texts, 2048)
    assert n <= 1.1 * len(plain_best_fit([1201 if i % 4 else 301 for i, _ in texts], 2048))


def test_query(spark, sf):
    rows = op13_residual_packing(spark, sf).collect()
    total, n = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert n == len(plain_best_fit([r.length for r in rows], 2048)) and total / (2048 * n) > 0.97
