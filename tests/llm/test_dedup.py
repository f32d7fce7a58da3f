"""Exact and near duplicates and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sixfold.llm import exact_dedup as ed
from sixfold.llm import simhash as sh
from sixfold.llm import suffix_dedup as sd
from sixfold.llm.simhash import components, fingerprint, simhash_groups


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_golomb():
    rng = np.random.default_rng(0)
    for n, width in ((1, 5), (10, 20), (5000, 40), (3, 62)):
        values = np.unique(rng.integers(0, 1 << width, n, dtype=np.uint64)) + np.uint64(1 << width)
        k, unary, rest = ed.encode_set(values, 1 << width, width)
        assert (ed.decode_set(unary, rest, len(values), k, 1 << width) == values).all()


@pytest.mark.parametrize("cap", [10**6, 0])
def test_exact(docs, clashing, nothing, texts, cap, monkeypatch):
    monkeypatch.setattr(ed, "BROADCAST_SUSPECTS", cap)
    groups = {}
    for i, t in texts:
        groups.setdefault(lower(t), []).append(i)
    want = Counter()
    for i, t in texts:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        keep = i if keep is None else keep
        want[(i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    for frame in (docs, clashing):
        assert Counter(tuple(r) for r in ed.exact_dedup(frame).collect()) == want
    assert ed.exact_dedup(nothing).count() == 0


def brute_components(prints):
    """The least print that each print reaches."""
    u = sorted(set(prints))
    a = np.array(u, np.uint64)
    root = list(range(len(u)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return {p: find(i) for i, p in enumerate(u)}


@pytest.mark.parametrize("bucket", [2048, 2])
def test_simhash(docs, clashing, nothing, texts, bucket, monkeypatch):
    """A small bucket sends everything through the second and third level."""
    monkeypatch.setattr(sh, "BUCKET", bucket)
    prints = [fingerprint((t or "").encode()) for _, t in texts]
    part = brute_components(prints)
    least = {}
    for (i, _), p in zip(texts, prints):
        if i is not None:
            least[part[p]] = min(i, least.get(part[p], i))
    want = Counter((i, f"{p:016x}", least.get(part[p])) for (i, _), p in zip(texts, prints))
    for frame in (docs, clashing)[: 2 if bucket > 2 else 1]:
        assert Counter(tuple(r) for r in simhash_groups(frame).collect()) == want
    assert simhash_groups(nothing).count() == 0


def test_fingerprint():
    import xxhash

    text = "A b\tC d\x0be  a B c"
    w = text.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(len(w) - 2)]
    assert fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert fingerprint(b"one Two") == xxhash.xxh64_intdigest(b"one two", 42) and fingerprint(None) == 0


def test_components(spark):
    """A long chain, a hub and a loop."""
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(1, 300)} == {1000}


def brute_spans(texts, span, passage=250):
    raw = [(t or "").encode() for _, t in texts]
    seen, short = (Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1)) for n in (span, passage))
    out = []
    for (i, _), b in zip(texts, raw):
        mark = bytearray(len(b))
        for at in range(len(b) - span + 1):
            if seen[b[at : at + span]] > 1:
                mark[at : at + span] = b"\1" * span
        kept = bytes(x for x, m in zip(b, mark) if not m)
        repeats = any(short[b[at : at + passage]] > 1 for at in range(len(b) - passage + 1))
        out.append((i, len(b), sum(mark), sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1])), hashlib.sha256(kept).hexdigest(), repeats))
    return Counter(out)


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_repeats(docs, clashing, nothing, texts, broadcast, monkeypatch):
    monkeypatch.setattr(sd, "BROADCAST_SPANS", broadcast)
    want = brute_spans(texts, 400)
    for frame in (clashing,) if broadcast else (docs,):
        assert Counter(tuple(r) for r in sd.remove_repeats(frame).drop("kept").collect()) == want
    assert sd.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("large", [4000, 5])
def test_shared_passages(spark, large, monkeypatch):
    """Passages of 150 to 900 bytes in many surroundings, one of them in all documents, and periodic texts; small buckets go
    through longer and longer q-grams."""
    monkeypatch.setattr(sd, "LARGE", large)
    rng = random.Random(8)
    prose = lambda n: " ".join(f"{rng.randrange(10**6):x}" for _ in range(n))
    common, passages = prose(90), [prose(n)[: 60 * n] for n in (25, 40, 50, 60, 75, 150)]
    rows = [(i, f"{prose(30)} {rng.choice(passages)} {prose(rng.randrange(5, 40))} {common[: rng.choice([260, 430, 600])]} {prose(9)}") for i in range(60)]
    rows += [(100, "ab" * 900), (101, "x" * 1200), (102, "ba" * 300 + prose(20)), (103, "one line of text\n" * 70), (104, "another one line of text\n" * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in sd.remove_repeats(frame).drop("kept").collect()) == brute_spans(rows, 400)


def test_hashes_that_meet(monkeypatch):
    """Bytes are compared: initial buckets that hold different strings don't change what is found."""
    rng = random.Random(4)
    piece = bytes(rng.randrange(97, 123) for _ in range(3000))
    pieces = [piece[:900], piece[200:1400], piece[1500:], piece[:300] + piece[2000:2500], b"short"]
    raw, sizes = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(x) for x in pieces])
    seen = Counter(x[i : i + 400] for x in pieces for i in range(len(x) - 399))
    covered = {(k, j) for k, x in enumerate(pieces) for i in range(len(x) - 399) if seen[x[i : i + 400]] > 1 for j in range(i, i + 400)}
    found = lambda: {(k, j) for k, a, b in zip(*[x.tolist() for x in sd.repeated_windows(raw, sizes, 400)]) for j in range(a, b)}
    assert found() == covered and covered
    monkeypatch.setattr(sd.Hashes, "all", lambda self, n: np.zeros(max(0, len(self.sums) - n), np.uint64))
    assert found() == covered
