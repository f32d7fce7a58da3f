"""Aligned tokens against a plain walk over bytes, and the merge path against a plain merge."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest

from sixfold.llm import alignment
from sixfold.llm.alignment import align, cut, split
from sixfold.llm.common import tokenizer_path


def plain(texts):
    """What align() returns for these texts, by the owners of every byte."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = tokenizer_path()
    one = Tokenizer.from_file(path)
    one.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spelled = {i: x for x, i in json.load(f)["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}
    two = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))

    def piece(i):
        x = two.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if len(x) == 6 and x.startswith("<0x") else x.replace("▁", " ").encode()

    docs = []
    for t in texts:
        a = [(i, bytes(byte[c] for c in spelled[i])) for i in (one.encode(" " + t, add_special_tokens=False).ids if t else [])]
        b = [(i, piece(i)) for i in (two.encode(t) if t else [])]
        whole = (" " + t).encode() if t else b""
        if any(b"".join(x for _, x in side) != whole for side in (a, b)):
            a = b = []
        owners = [[n for n, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
        docs.append(([i for i, _ in a], [i for i, _ in b], owners))
    links = [[(a[x], b[y]) for x, y in sorted(set(zip(*owners)))] for a, b, owners in docs]
    counts = Counter(x for its in links for x in its)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for (a, b, (own_a, own_b)), its in zip(docs, links):
        groups, at_a, at_b = [], 0, 0
        for k in range(1, len(own_a) + 1):
            if k == len(own_a) or own_a[k] != own_a[k - 1] and own_b[k] != own_b[k - 1]:
                to_a, to_b = own_a[k - 1] + 1, own_b[k - 1] + 1
                groups.append(",".join(map(str, a[at_a:to_a])) + "|" + ",".join(map(str, b[at_b:to_b])))
                at_a, at_b = to_a, to_b
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(its), sum(counts[x] == best[x[1]] for x in its), sum(counts[x] for x in its), sha))
    return out


HARD = ["<|endoftext|> <s> </s> <0x0A>", "½ ﬁ ▁ x", "▁", " ", "\x00a", "a  b\n\n\tc   ", "日本語のテキスト 👩‍👩‍👧 end", "é é ﷺ", "x" * 3000, "<unk>", "don't  Stop it's", "  "]


@pytest.mark.parametrize("work, hot", [(alignment.WORK, alignment.HOT_PAIRS), (40, 300), (2, 0)])
def test_align(spark, docs, clashing, texts, nothing, work, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    monkeypatch.setattr(alignment, "AT_ONCE", alignment.AT_ONCE if hot > 300 else 1000)
    rows = [(i, t if t is None or len(t) < 20_000 or work > 2 else t[:500]) for i, t in [*texts, *((600 + n, t) for n, t in enumerate(HARD))]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = Counter((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows])))
    assert Counter(tuple(r) for r in align(frame, work=work).collect()) == want
    if work == alignment.WORK:
        assert sum(x[1] == 0 for x in want) >= 4 and max(x[1] + x[2] for x in want) > 2 * work
        more = frame.selectExpr("doc_id", "text", "1 as row", "2 as piece", "3 as key", "4 as n")
        assert Counter(tuple(r) for r in align(more, work=work).collect()) == want
        empty = align(nothing)
        assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_merge_path():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (np.array(sorted(rng.sample(range(1, 60), rng.randrange(0, 30))), np.int64) for _ in range(2))
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for at in range(len(merged) + 1):
            i = sum(s == 0 for _, s in merged[:at])
            tied = 0 < at < len(merged) and merged[at - 1][0] == merged[at][0]
            assert split(a, b, at) == (i, at - i + tied)
        for work in (1, 3, 10):
            cuts = cut(a, b, work)
            assert cuts[0] == (0, 0) and cuts[-1] == (len(a), len(b)) and cuts == sorted(cuts)
            assert all(i2 - i + j2 - j <= work + 1 for (i, j), (i2, j2) in zip(cuts, cuts[1:]))
