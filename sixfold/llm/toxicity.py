"""Toxicity by weak supervision.

Many voters look at a text: lexicons of words and word beginnings, and patterns of how their entries occur. A generative
label model (a latent class with one conditional table per voter, voters that depend on each other joined in a tree)
estimates their accuracies and correlations without gold labels, and a linear classifier is trained on its posterior
labels. Gold labels of training rows only fill the lexicons.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, stored, table
from .training import SAMPLE, Rows, fit_logistic, held_out, labelled_sample, sigmoid, with_score

#: Lengths of the word beginnings that stand beside whole words.
BEGINNINGS = range(3, 9)
#: The entries found are dealt to so many lexicons; there are MOST_ENTRIES at most.
LEXICONS, MOST_ENTRIES = 16, 400
#: Terms occur in so many documents. Entries have at least this share of positives, and add so many positive documents that
#: no other entry marks; those that are precise enough by themselves are entries anyway.
LEAST_COUNT, LEAST_SHARE, LEAST_ADDED, CONFIRMING, CONFIRMING_SHARE = 3, 0.8, 2, 8, 0.9
#: Columns of the classifier at most, the penalty that chooses among them and the one on their weights.
COLUMNS, L1, L2 = 12_000, 3e-4, 2e-5
#: Documents without labels, at most, on which the label model and the classifier are fitted too.
UNLABELLED = 12_000
ABSTAIN, NO, YES = 0, 1, 2
_WORD = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    """Distinct words, and their beginnings marked with a star."""
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out.update({w[:n] + "*" for w in words if len(w) >= n})
    return out


class LabelModel:
    """Latent class y with P(vote | y), and P(vote | parent's vote, y) for voters that the tree joins to another."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, steps: int = 40, least_information: float = 2e-3):
        # A voter that only repeats another would count twice in the first round, and the pair could pass for the class.
        self.parent = self._repeats(votes)
        q, _ = self._expect(votes, start, steps)
        self.parent = self._tree(votes, q, least_information)
        self.posterior, self.likelihood = self._expect(votes, q, steps)

    @staticmethod
    def _repeats(votes: np.ndarray) -> np.ndarray:
        """As parent, an earlier voter that tells nearly all of a voter's votes, or -1."""
        n, m = votes.shape
        parent = np.full(m, -1)
        for i in range(m):
            for j in range(i):
                p = np.bincount(votes[:, i] * 3 + votes[:, j], minlength=9).reshape(3, 3) / max(n, 1) + 1e-12
                a, b = p.sum(axis=1), p.sum(axis=0)
                shared = float((p * np.log(p / np.outer(a, b))).sum())
                most = max(float(-(a * np.log(a)).sum()), float(-(b * np.log(b)).sum()))
                if parent[i] < 0 and most > 1e-6 and shared > 0.95 * most:
                    parent[i] = j
        return parent

    def _expect(self, votes: np.ndarray, q: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
        """The posterior of the class, and the mean log likelihood of a document's votes."""
        n, m = votes.shape
        above = np.where(self.parent >= 0, votes[:, self.parent], 0) if n else votes
        likelihood = 0.0
        for _ in range(steps if n else 0):
            both = np.tile(np.log([max(1e-6, 1 - q.mean()), max(1e-6, q.mean())]), (n, 1))
            for j in range(m):
                cell = above[:, j] * 3 + votes[:, j]
                for y, weight in enumerate((1 - q, q)):
                    table = np.bincount(cell, weight, minlength=9).reshape(3, 3) + 0.1
                    both[:, y] += np.log(table / table.sum(axis=1, keepdims=True)).ravel()[cell]
            likelihood = float(np.logaddexp(both[:, 0], both[:, 1]).mean())
            new = sigmoid(both[:, 1] - both[:, 0])
            moved = np.abs(new - q).max()
            q = new
            if moved < 1e-6:
                break
        return q, likelihood

    @staticmethod
    def _tree(votes: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
        """The spanning forest of the largest mutual information given y, as each voter's parent."""
        n, m = votes.shape
        pairs = []
        for i in range(m):
            for j in range(i):
                information = 0.0
                for weight in (1 - q, q):
                    p = (np.bincount(votes[:, i] * 3 + votes[:, j], weight, minlength=9).reshape(3, 3) + 1e-9) / max(n, 1)
                    rows, columns, total = p.sum(axis=1, keepdims=True), p.sum(axis=0, keepdims=True), p.sum()
                    information += float((p * np.log(p * total / (rows * columns))).sum())
                if information > least:
                    pairs.append((-information, i, j))
        group, near = list(range(m)), [[] for _ in range(m)]
        for _, i, j in sorted(pairs):
            if group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
                near[i].append(j)
                near[j].append(i)
        parent, seen = np.full(m, -1), set()
        for root in range(m):
            todo = [] if root in seen else [root]
            seen.add(root)
            while todo:
                i = todo.pop()
                for j in near[i]:
                    if j not in seen:
                        seen.add(j)
                        parent[j] = i
                        todo.append(j)
        return parent


def lexicon(rows: Rows, labels: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> list[int]:
    """Columns that mark positive training documents, by sequential covering: each next one marks the most that are left.

    Then those of the other columns that are frequent and precise, the strongest first. What they mark in the training
    documents is marked already, but not what they mark alone in others.
    """
    share = (positive + 0.5) / (positive + negative + 1)
    good = (positive >= LEAST_ADDED) & (share >= LEAST_SHARE)
    row, at = rows.row[good[rows.at]], rows.at[good[rows.at]]
    left, chosen = labels > 0, []
    while len(chosen) < MOST_ENTRIES:
        gain = np.bincount(at[left[row]], minlength=len(good))
        best = int(np.argmax(gain * share**2)) if len(gain) else 0
        if not len(gain) or gain[best] < (LEAST_ADDED if len(chosen) else 1):
            break
        chosen.append(best)
        left = left.copy()
        left[row[at == best]] = False
    others = (positive >= CONFIRMING) & (share >= CONFIRMING_SHARE)
    others[chosen] = False
    strongest = np.argsort(-positive * share**2, kind="stable")
    return (chosen + strongest[others[strongest]].tolist())[:MOST_ENTRIES]


def vote(rows: Rows, names: list[str], chosen: list[int]) -> np.ndarray:
    """One row per document: a vote of each lexicon, then of the patterns."""
    n, entries = len(rows.begin) - 1, np.zeros(len(names), bool)
    entries[chosen] = True
    size = np.array([len(x) - (x[-1] == "*") for x in names], np.int64)
    whole = np.array([x[-1] != "*" for x in names], bool)
    found = np.bincount(rows.row, entries[rows.at], minlength=n)
    words = np.bincount(rows.row, (entries & whole)[rows.at], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, rows.row, np.where(entries[rows.at], size[rows.at], 0))
    columns = []
    for k in range(min(LEXICONS, len(chosen))):
        own = np.zeros(len(names), bool)
        own[chosen[k::LEXICONS]] = True
        columns.append(np.where(np.bincount(rows.row, own[rows.at], minlength=n) > 0, YES, ABSTAIN))
    columns.append(np.where(found == 0, NO, ABSTAIN))
    columns.append(np.where(words >= 1, YES, ABSTAIN))
    columns.append(np.where(found >= 2, YES, np.where(found == 0, NO, ABSTAIN)))  # several entries
    columns.append(np.where(longest >= 5, YES, np.where(longest <= 3, NO, ABSTAIN)))  # no more than the shortest beginnings
    columns.append(np.where(found * 100 >= np.maximum(100, np.bincount(rows.row, minlength=n)), YES, ABSTAIN))  # dense
    return np.stack(columns, axis=1).astype(np.int64)


class ToxicityModel:
    """names: the terms that may matter; lists: those of each sampled document; labels: 1, 0, or -1 where none is known;
    counts: of positive and negative documents.

    Labels fill the lexicons only. The label model and the classifier see the votes on all documents, most of which have
    no label.
    """

    def __init__(self, names: list[str], lists: list[np.ndarray], labels: np.ndarray, positive: np.ndarray, negative: np.ndarray):
        rows = Rows(lists)
        votes = vote(rows, names, lexicon(rows, labels, positive, negative)) if names and len(labels) else np.zeros((len(labels), 1), np.int64)
        agree = (votes == YES).sum(axis=1) - (votes == NO).sum(axis=1)
        self.label_model = LabelModel(votes, np.where(agree > 0, 0.9, 0.1))
        q = self.label_model.posterior
        w, _ = fit_logistic(rows, q, len(names), l1=L1, l2=1e-6, steps=300)
        # The penalty has chosen the columns; without it they get their full weights.
        kept = np.flatnonzero(np.abs(w) > 1e-3)
        place = np.full(len(names), -1)
        place[kept] = np.arange(len(kept))
        w, self.bias = fit_logistic(Rows([place[x][place[x] >= 0] for x in lists]), q, len(kept), l2=L2, steps=400)
        self.weights = {names[i]: float(x) for i, x in zip(kept, w)}

    def score(self, text: str | None) -> float:
        get = self.weights.get
        words = set(_WORD.findall((text or "").lower()))
        total = sum([get(w, 0.0) for w in words])
        for n in BEGINNINGS:
            total += sum([get(x, 0.0) for x in {w[:n] + "*" for w in words if len(w) >= n}])
        return float(sigmoid(total + self.bias))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    positive, negative = Counter(), Counter()
    for b in batches:
        for text, y in zip(column(b, "text").to_pylist(), column(b, "label").to_pylist()):
            (positive if y else negative).update(terms(text))
    names = list(positive | negative)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([positive[x] for x in names], pa.int64()), pa.array([negative[x] for x in names], pa.int64())],
        names=["term", "positive", "negative"],
    )


def _chosen_terms(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: i for i, x in enumerate(names)}
        for b in batches:
            rows = [sorted(place[t] for t in terms(x) & place.keys()) for x in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(b, "label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "at"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, use=None, label: str = "toxic", limit: int = SAMPLE, unlabelled: int = UNLABELLED) -> ToxicityModel:
    """Learns from at most `limit` labelled documents and `unlabelled` others of `use`, each different text once.

    Tasks count the terms; the driver gets the COLUMNS whose positive counts are furthest from chance.
    """
    use = F.lit(True) if use is None else use
    sample = labelled_sample(docs, labels, label, use, limit).select("text", F.col("label").cast("int").alias("label"))
    more = labelled_sample(docs, docs.select("doc_id", F.lit(0).alias("none")), "none", use, unlabelled).select("text", F.lit(None).cast("int").alias("label"))
    sample = stored(sample.unionByName(more).groupBy("text").agg(F.max("label").alias("label")), "toxicity-sample")
    known = sample.where("label is not null")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    rate = min(0.999, max(0.001, ones / max(1, n)))
    counts = known.mapInArrow(_count, "term string, positive long, negative long").groupBy("term").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    total = F.col("positive") + F.col("negative")
    strength = F.abs(F.col("positive") - total * rate) / F.sqrt(total * rate * (1 - rate))
    top = counts.where(total >= LEAST_COUNT).orderBy(strength.desc(), "term").limit(COLUMNS).toArrow()
    names = top.column("term").to_pylist()
    got = sample.select("text", F.coalesce("label", F.lit(-1)).alias("label")).mapInArrow(_chosen_terms(names), "label int, at array<int>").toArrow()
    lists = [np.array(x.values, np.int32) for x in got.column("at")]
    return ToxicityModel(names, lists, np.array(got.column("label"), np.int64), np.array(top.column("positive")), np.array(top.column("negative")))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs and score: the chance of label 1, from the text alone, which is read whole however long it is.

    Null and empty texts get the score of no terms. Rows repeated, or equal in text, get the same score each; no rows give no
    rows; a column named score is replaced, all others stay.
    """
    return with_score(docs, model, lambda m, b: [m.score(x) for x in column(b, "text").to_pylist()])  # COLUMNS weights at most


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = fit_toxicity(docs, labels, ~held_out(3, 1))
    return score_toxicity(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
