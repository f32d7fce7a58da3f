"""Contamination, shards and packed sequences against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sixfold.llm import decontaminate
from sixfold.llm.decontaminate import contamination
from sixfold.llm.packing import LENGTH, Ids, Levels, pack
from sixfold.llm.sharding import Ranges, shard
from sixfold.llm.common import tokenizer_path


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_contamination(docs, clashing, nothing, items, texts, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    wins = {}
    for r in items.collect():
        w = words(r.text)
        n = min(10, len(w))
        if n and r.item_id is not None:
            for i in range(len(w) - n + 1):
                wins.setdefault(tuple(w[i : i + n]), set()).add(str(r.item_id))
    lengths = {len(k) for k in wins}
    want = Counter()
    for i, t in texts:
        w, hit, ids = words(t), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in wins:
                    hit |= set(range(at, at + n))
                    ids |= wins[tuple(w[at : at + n])]
        want[(i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    for frame in (docs, clashing):
        assert Counter(tuple(r) for r in contamination(frame, items).drop("items").collect()) == want
    assert sum(n for k, n in want.items() if k[-1]) > 5
    assert contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in contamination(docs, items.limit(0)).collect())


def test_minimax():
    """The searched capacity is the smallest that the greedy check passes over single groups."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        size = rng.integers(1, 100, rng.integers(5, 60))
        r = Ranges([f"{i:03}" for i in range(len(size))], size, np.ones(len(size), int))
        for shards in (1, 3, 7):
            best = r.least(shards, int(size.max()), False)
            plain = next(c for c in range(int(size.max()), int(size.sum()) + 1) if r.cuts(c, shards, False) is not None)
            assert best == plain
            ends = [0, *r.even(best, shards)]
            assert ends[-1] == size.sum() and len(ends) <= shards + 1 and all(0 < b - a <= best for a, b in zip(ends, ends[1:]))


def test_shards(docs, clashing, nothing, texts):
    for frame in (docs, clashing):
        rows = shard(frame, 6).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
        place = {}
        for r in rows:
            place.setdefault(r.shard, []).append(r.slot)
        assert set(place) <= set(range(6)) and all(sorted(s) == list(range(len(s))) for s in place.values())
        by_text = {}
        for r in rows:
            by_text.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
        assert all(len(s) == 1 for s in by_text.values())
        held, group = Counter(), Counter()
        for r in rows:
            held[r.shard] += r["size"]
            group[r.text_crc32, r["size"]] += r["size"]
        # A shard with a group as large as an equal share may be larger; the others differ by one ordinary group at most.
        large = {next(iter(by_text[k])) for k, n in group.items() if n >= sum(held.values()) / 6}
        rest = [n for k, n in held.items() if k not in large]
        assert max(rest) - min(rest) <= max(n for n in group.values() if n < sum(held.values()) / 6)
    assert shard(nothing, 6).count() == 0


def test_packing(docs, clashing, nothing, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    ids = [np.array([*e.ids, 0], "<u4").tobytes() for e in t.encode_batch([x or "" for _, x in texts], add_special_tokens=False)]
    for frame in (docs, clashing):
        rows = pack(frame).collect()
        seq = {}
        for r in rows:
            seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for s in seq.values():
            s.sort()
            assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:]))
            fill = sum(x[1] for x in s)
            assert fill == LENGTH or fill < LENGTH and fill & (fill - 1) == 0
        pieces = {}
        for r in rows:
            pieces.setdefault(r.doc_id, []).append(r)
        for (i, _), e in zip(texts, ids):
            if i is None or i == 500:
                continue
            own = sorted(pieces[i], key=lambda r: r.start)
            assert own[0].start == 0 and sum(r.length for r in own) == len(e) // 4 == own[0].doc_tokens
            assert all(zlib.crc32(e[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in own)
        assert sum(r.length for r in rows) == sum(map(len, ids)) // 4
    assert pack(nothing).count() == 0


def test_chunked_ids():
    """The ids are those of the tokenizers library, for every code point too."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    odd = ["a b", " a b ", "a  b", "x\n y", "x \ny", "x\n\ny z\n", "it's John's 'll", "1,000.50 € — “q” ", "é ß ñ w", "", " ", "<|endoftext|> z", "tab\there you", "emoji 😀😀 ok"]
    odd += [f"a{c}b {c}1{c}{c} .{c}. {c} {c}\n {c}{c}" for c in map(chr, range(0x11000)) if not 0xD800 <= ord(c) < 0xE000]
    odd += ["a" * 50_000, " " * 50_000, "1." * 30_000, "  a" * 20_000]
    own = Ids(tokenizer_path())
    assert own.of(odd) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(odd, add_special_tokens=False)]


def test_open_windows_go_on(spark):
    """Windows that small partitions leave open are packed together: few sequences are short of full, none overlap."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 900, rng.integers(1, 400)))) for i in range(600)]
    found = pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()
    fill = Counter()
    for r in found:
        fill[r.sequence_id] += r.length
    short = [n for n in fill.values() if n < LENGTH]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 10 * 2
    whole = Counter(r.doc_id for r in found)
    assert sum(n == 1 for n in whole.values()) > 0.5 * len(rows)  # most pieces stay whole instead of being cut in sequence


def test_levels():
    """The level chosen minimises the sum of squared counts, by trying every one."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        lv = Levels(16)
        lv.counts[1:16] = rng.integers(0, 4, 15)
        n = int(rng.integers(1, 16))

        def after(h):
            c = lv.counts.copy()
            if h:
                c[h] -= 1
            if h + n < 16:
                c[h + n] += 1
            return int((c[1:16] ** 2).sum())

        possible = [0, *[h for h in range(1, 17 - n) if lv.counts[h]]]
        assert after(lv.level_for(n)) == min(map(after, possible))
