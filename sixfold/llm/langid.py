"""Language identification with a linear-chain conditional random field over words.

Affix, trigram and lexicon features of a word and learned transitions label the words of code-switched text by
forward-backward; the language of a text is the one with the largest word marginals, over the whole text and at its
ends, in learned proportions. The field is fitted on a bounded sample of windows of labelled documents, spliced so that
languages change within a chain.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored, table
from .training import held_out, labelled_sample

#: Most documents that the field is fitted on, and words of each, from a place that a hash of its id gives. Only fitting is bounded.
SAMPLE, WINDOW = 6000, 48
BUCKETS = 1 << 16
#: Words of the sample that make the lexicon, by frequency.
LEXICON = 4000
#: Words of one chain in training, and of a block in prediction; blocks of a text pass their messages on.
CHAIN = 64
#: Words whose emissions a task remembers.
REMEMBERED = 400_000
UNDETERMINED = "und"
#: Parts of a text whose marginals tell its language: counted from its end or not, from a word, to a word.
REGIONS = ((False, 0, None), (False, 0, 24), (False, 24, 96), (True, 0, 24), (True, 24, 96))
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters. Numerals that aren't decimal digits, as in fractions or circles, are no letters."""
    out = []
    for w in _WORD.findall((text or "").lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def word_features(word: str, lexicon: set[str]) -> list[int]:
    edged = f"^{word}$"
    names = [f"p{n}{word[:n]}" for n in (1, 2, 3)] + [f"s{n}{word[-n:]}" for n in (1, 2, 3)]
    names += ["t" + edged[i : i + 3] for i in range(len(edged) - 2)]
    names.append("w" + word if word in lexicon else "unlisted")
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def forward_backward(emit: np.ndarray, mask: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
    """Marginals [chain, place, label] of padded chains, and the expected transitions [label, label] if asked for.

    before, after [chain, label]: what comes into a chain's first place instead of start, and back into its last place.
    """
    chains, places, n = emit.shape
    phi = np.exp(emit - emit.max(axis=2, keepdims=True))
    step = np.exp(move - move.max())
    alpha, beta = np.empty_like(phi), np.ones_like(phi)
    now = phi[:, 0] * (np.exp(start - start.max()) if before is None else before)
    if after is not None:
        beta[:, -1] = after
    alpha[:, 0] = now / now.sum(axis=1, keepdims=True)
    for t in range(1, places):
        now = (alpha[:, t - 1] @ step) * phi[:, t]
        alpha[:, t] = np.where(mask[:, t, None], now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300), alpha[:, t - 1])
    for t in range(places - 2, -1, -1):
        now = (phi[:, t + 1] * beta[:, t + 1]) @ step.T
        beta[:, t] = np.where(mask[:, t + 1, None], now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300), beta[:, t + 1])
    marginal = alpha * beta
    marginal /= np.maximum(marginal.sum(axis=2, keepdims=True), 1e-300)
    if not pairs:
        return marginal, None
    expected = np.zeros((n, n))
    for t in range(places - 1):
        both = alpha[:, t, :, None] * step[None] * (phi[:, t + 1] * beta[:, t + 1])[:, None, :]
        both /= np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)
        expected += both[mask[:, t + 1]].sum(axis=0)
    return marginal, expected


def block_messages(emit: np.ndarray, mask: np.ndarray, text: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes into each block's first and last place from the rest of its text; text: that of each block, ascending."""
    blocks, places, n = emit.shape
    phi, step = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(move - move.max())
    first, last = np.concatenate([[True], text[1:] != text[:-1]]), np.concatenate([text[1:] != text[:-1], [True]])
    # through[b, i, j]: from label i before the block (at its first place, in a text's first block) to j at its last one.
    through = np.where(first[:, None, None], np.eye(n)[None], step[None]) * phi[:, 0][:, None, :]
    for t in range(1, places):
        now = (through.reshape(-1, n) @ step).reshape(blocks, n, n) * phi[:, t][:, None, :]
        through = np.where(mask[:, t, None, None], now / np.maximum(now.sum(axis=(1, 2), keepdims=True), 1e-300), through)
    begin = np.exp(start - start.max())
    ahead, back = np.tile(begin / begin.sum(), (blocks, 1)), np.ones((blocks, n))
    number = np.arange(blocks) - np.flatnonzero(first)[np.cumsum(first) - 1]
    order = np.argsort(number, kind="stable")  # the first blocks of all texts, then the second ones
    cuts = np.searchsorted(number[order], np.arange(number.max(initial=0) + 2))
    levels = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    for at in levels:
        at = at[~last[at]]
        now = (ahead[at][:, None, :] @ through[at])[:, 0]
        ahead[at + 1] = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
    for at in levels[::-1]:
        at = at[~first[at]]
        now = (through[at] @ back[at][:, :, None])[:, :, 0]
        back[at - 1] = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
    return np.where(first[:, None], ahead, ahead @ step), back


class Field:
    """Weights of a linear-chain field; fit() learns them by Adagrad on the log likelihood of spliced chains."""

    def __init__(self, labels: list[str], lexicon: set[str]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weight = np.zeros((BUCKETS, n), np.float32)
        self.start, self.move = np.zeros(n), np.zeros((n, n))
        self.regions = np.eye(len(REGIONS))[0]

    @staticmethod
    def learned(windows: list[list[str]], langs: list[str], epochs: int = 6, seed: int = 3) -> Field:
        labels = sorted(set(langs))
        counts = Counter(w for x in windows for w in x)
        field = Field(labels, {w for w, _ in counts.most_common(LEXICON)})
        place = {x: i for i, x in enumerate(labels)}
        parts = []  # pieces of windows, so that a chain mixes documents
        random = np.random.default_rng(seed)
        for words, lang in zip(windows, langs):
            cut = int(random.integers(8, WINDOW + 1))
            parts += [(words[a:b], place[lang]) for a, b in ((0, cut), (cut, len(words))) if words[a:b]]
        known = {w: np.array(word_features(w, field.lexicon)) for w in counts}
        sums = [np.full_like(x, 1e-6, dtype=np.float64) for x in (field.weight, field.start, field.move)]
        for _ in range(epochs):
            words, tags = [], []
            for i in random.permutation(len(parts)):
                words += parts[i][0]
                tags += [parts[i][1]] * len(parts[i][0])
            for lo in range(0, len(words), CHAIN * 128):
                field._step([known[w] for w in words[lo : lo + CHAIN * 128]], np.array(tags[lo : lo + CHAIN * 128]), sums)
        return field

    def _step(self, features: list[np.ndarray], tags: np.ndarray, sums: list[np.ndarray], rate: float = 0.3) -> None:
        n, width = len(features), len(self.labels)
        chains = -(-n // CHAIN)
        at, row = np.concatenate(features), np.repeat(np.arange(n), [len(x) for x in features])
        emit = np.zeros((chains * CHAIN, width))
        for k in range(width):
            emit[:n, k] = np.bincount(row, self.weight[at, k], minlength=n)
        mask = (np.arange(chains * CHAIN) < n).reshape(chains, CHAIN)
        marginal, expected = forward_backward(emit.reshape(chains, CHAIN, width), mask, self.start, self.move, pairs=True)
        truth = np.zeros((chains * CHAIN, width))
        truth[np.arange(n), tags] = 1
        error = truth - marginal.reshape(-1, width) * mask.ravel()[:, None]
        padded = np.concatenate([tags, np.full(chains * CHAIN - n, -1)]).reshape(chains, CHAIN)
        a, b = padded[:, :-1].ravel(), padded[:, 1:].ravel()
        seen = np.bincount(a[b >= 0] * width + b[b >= 0], minlength=width * width).reshape(width, width)
        slope = np.stack([np.bincount(at, error[row, k], minlength=BUCKETS) for k in range(width)], axis=1)
        starts = error.reshape(chains, CHAIN, width)[:, 0].sum(axis=0)
        for value, g, total in ((self.weight, slope, sums[0]), (self.start, starts, sums[1]), (self.move, seen - expected, sums[2])):
            total += g * g
            value += (rate * g / np.sqrt(total)).astype(value.dtype)

    def emission(self, word: str) -> np.ndarray:
        return self.weight[word_features(word, self.lexicon)].sum(axis=0)


class Labeller:
    """A field at work in a task, with a bounded memory of emissions."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}
        self.table = np.zeros((REMEMBERED + 1, len(field.labels)), np.float32)

    def _places(self, words: list[str]) -> list[int]:
        known = self.known
        for w in [w for w in set(words) if w not in known]:
            self.table[len(known)] = self.field.emission(w)
            known[w] = len(known)
        return [known[w] for w in words]

    def regions(self, texts: list[str | None]) -> np.ndarray:
        """[text, region, label]: mean marginals of the whole text and of its ends; zeros for a text without words."""
        emits, lengths = [], []
        for x in texts:
            words = words_of(x)
            lengths.append(len(words))
            for lo in range(0, len(words), REMEMBERED // 2):
                part = words[lo : lo + REMEMBERED // 2]
                if len(self.known) + len(part) > REMEMBERED:
                    self.known = {}
                emits.append(self.table[self._places(part)])
        width = len(self.field.labels)
        if not sum(lengths) or not width:
            return np.zeros((len(texts), len(REGIONS), width))
        return self._means(np.concatenate(emits), np.array(lengths))

    def _means(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """A text is laid out in blocks of CHAIN words."""
        chains = -(-lengths // CHAIN)
        first = np.concatenate([[0], np.cumsum(chains)[:-1]])
        text = np.repeat(np.arange(len(lengths)), lengths)
        before = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        after = lengths[text] - 1 - before
        slot = first[text] * CHAIN + before
        total, width = int(chains.sum()), emit.shape[1]
        owner = np.repeat(np.arange(len(lengths)), chains)
        sums, words = np.zeros((len(lengths), len(REGIONS), width)), np.zeros((len(lengths), len(REGIONS)))
        padded, mask = np.zeros((total * CHAIN, width), np.float32), np.zeros(total * CHAIN, bool)
        padded[slot], mask[slot] = emit, True
        padded, mask = padded.reshape(-1, CHAIN, width), mask.reshape(-1, CHAIN)
        start, move = self.field.start, self.field.move
        ahead, back = block_messages(padded, mask, owner, start, move)
        for lo in range(0, total, 4096):  # bounded memory for very long texts
            a, b = np.searchsorted(slot, [lo * CHAIN, (lo + 4096) * CHAIN])
            part = slice(lo, lo + 4096)
            marginal, _ = forward_backward(padded[part], mask[part], start, move, before=ahead[part], after=back[part])
            marginal = marginal.reshape(-1, width)[slot[a:b] - lo * CHAIN]
            for k, (at_end, lowest, highest) in enumerate(REGIONS):
                where = (after if at_end else before)[a:b]
                inside = slice(None) if lowest == 0 and highest is None else np.flatnonzero((where >= lowest) & (where < highest))
                of = text[a:b][inside]
                words[:, k] += np.bincount(of, minlength=len(lengths))
                for l in range(width):
                    sums[:, k, l] += np.bincount(of, marginal[inside, l], minlength=len(lengths))
        return sums / np.maximum(words, 1)[:, :, None]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        means = self.regions(texts)
        chance = softmax(np.einsum("trl,r->tl", means, self.field.regions)) if means.shape[2] else means[:, 0]
        some = means.any(axis=(1, 2))
        return [(self.field.labels[int(np.argmax(c))], float(c.max())) if ok else (UNDETERMINED, 0.0) for ok, c in zip(some, chance)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_regions(means: np.ndarray, tags: np.ndarray, steps: int = 300, rate: float = 2.0) -> np.ndarray:
    """The weight of each region in a text's language, by gradient ascent on the log likelihood of the texts' languages."""
    weights = np.ones(len(REGIONS))
    own = means[np.arange(len(tags)), :, tags] if len(tags) else np.zeros((0, len(REGIONS)))
    for _ in range(steps if len(tags) else 0):
        chance = softmax(np.einsum("trl,r->tl", means, weights))
        weights = weights + rate * (own - np.einsum("trl,tl->tr", means, chance)).mean(axis=0) - 1e-4 * weights
    return weights


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc, text in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()):
            words = words_of(text)
            at = zlib.crc32(str(doc).encode()) % max(1, len(words) - WINDOW + 1)
            rows.append(words[at : at + WINDOW])
        yield pa.RecordBatch.from_arrays([column(b, "label"), pa.array(rows, pa.list_(pa.string()))], names=["label", "words"])


def fit_language(docs: DataFrame, use=None, limit: int = SAMPLE) -> Field:
    """Learns from text and lang of at most `limit` documents with a language."""
    sample = stored(labelled_sample(docs, docs, "lang", F.lit(True) if use is None else use, limit).select("doc_id", "text", F.col("label").cast("string").alias("label")), "language-sample")
    got = sample.mapInArrow(_windows, "label string, words array<string>").toArrow()
    field = Field.learned(got.column("words").to_pylist(), got.column("label").to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = labeller.regions(column(part, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([column(part, "label"), pa.array(list(rows.reshape(len(rows), -1)), pa.list_(pa.float64()))], names=["label", "means"])

    got = sample.mapInArrow(means, "label string, means array<double>").toArrow()
    place = {x: i for i, x in enumerate(field.labels)}
    rows = np.array(got.column("means").to_pylist()).reshape(got.num_rows, len(REGIONS), len(place))
    field.regions = fit_regions(rows, np.array([place[x] for x in got.column("label").to_pylist()], np.int64))
    return field


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score (the chance of that language) of every whole text.

    A text that is null or has no letter gets `und` and 0; numerals such as a half or a circled one are no letters. Without
    labelled documents every text does. Of languages that are equally likely the first by name is given. Very long texts
    are read whole, in blocks. Repeated rows get the same answer each; no rows give no rows. Columns other than doc_id and text are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS rows of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                langs, scores = zip(*labeller.predict(column(part, "text").to_pylist()))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    field = fit_language(docs, ~held_out(4, 2))
    return identify(docs, field).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
