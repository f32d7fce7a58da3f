"""Extraction by rules against plain regular expressions, and an index of whole documents against a plain walk."""

import random
import re

import pytest

from sixfold.operators import semantic
from sixfold.operators.semantic import NO_ENTITIES, STAND_INS, VERBS, extract, index, index_counts

NOTES = """Трансформер использует Внимание. Механизм позволяет модели видеть JSON и BERT, GPT.
Оптимизатор применяет Градиент. Трансформер строит Граф. Верни является чем-то. граф знаний и нейросеть"""


def plain(text, vocabulary):
    terms = re.findall(r"[А-ЯЁA-Z][а-яёa-z]{3,}", text)[:8]
    hits = [p.capitalize() for p in vocabulary if len(p) > 4 and p in text.lower()][:6]
    acronyms = re.findall(r"\b[A-Z]{2,}\b", text)[:4]
    found = list(dict.fromkeys(e for e in terms + hits + acronyms if e not in NO_ENTITIES and len(e) > 3))[:10] or STAND_INS
    subjects = re.findall(rf"([А-ЯЁA-Z][а-яёa-z]{{3,}})\s+(?:{'|'.join(VERBS)})", text)
    pairs = [(a, b) for a, b in zip(subjects, subjects[1:]) if a != b and a not in NO_ENTITIES and b not in NO_ENTITIES]
    return found, pairs or ([tuple(found[:2])] if len(found) >= 2 else [])


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    words = ["Внимание", "граф", "граф знаний", "BERT", "GPTS", "использует", "Механизм", "применяет", "нейросеть", "JSON", "Верни", "сеть", "Graph", "ГрафХ", "и", "строит\n", "A_BC", "ABCD."]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(80)] + [(100, NOTES), (101, ""), (102, "и"), (103, None), (104, "Слово " * 3000)]
    vocabulary = ["граф", "граф знаний", "нейросеть", "механизм внимания", "механизм", "сеть", "bertх", "использует", "gptsх"]
    return texts, vocabulary, spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(p, i) for i, p in enumerate(vocabulary)], "phrase string, ord long")


def test_extract(case):
    texts, vocabulary, docs, known = case
    got = {r.doc_id: (r.entities, [tuple(p) for p in r.relations]) for r in extract(docs, known).collect()}
    assert got == {i: plain(t, vocabulary) for i, t in texts if t is not None}
    assert got[100][1] == [("Трансформер", "Механизм"), ("Механизм", "Оптимизатор"), ("Оптимизатор", "Трансформер")]
    assert got[101] == (STAND_INS, [tuple(STAND_INS)])
    assert extract(docs.limit(0), known).count() == 0 and extract(docs, known.limit(0)).count() == len(got)


def test_index(case):
    from sixfold.operators import text as t

    texts, vocabulary, docs, known = case
    chunks, nodes, edges = index(docs, known, size=80, overlap=20)
    first, pairs = {}, []
    rows = sorted((tuple(r) for r in t.chunks(docs, 80, 20).select("doc_id", "chunk", "text").collect()))
    for _, _, text in rows:
        found, own = plain(text, vocabulary)
        for e in found:
            first.setdefault(e.lower().strip(), e)
        pairs += [(a.lower(), b.lower()) for a, b in own]
    assert {r.entity: r.label for r in nodes.collect()} == first
    want = sorted(p for p in pairs if p[0] != p[1] and p[0] in first and p[1] in first)
    assert sorted((r.source, r.target) for r in edges.collect()) == want
    counts = index_counts(chunks, nodes, edges).first()
    assert (counts.n_chunks, counts.n_entities, counts.n_relations, counts.n_nodes, counts.n_edges) == (len(rows), len(first), len(pairs), len(first), len(want))
    assert 1 <= counts.n_communities <= 6 and semantic.WEIGHT == 0.7
