"""Trained operators: held-out accuracy, defined answers for odd rows, and the solvers against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sixfold.llm import langid, licenses, quality, toxicity, training
from sixfold.llm.langid import forward_backward

TENTH = "/root/testdata/sf0.1"


def on_held_out(spark, query, label):
    """predicted and true labels of the labelled rows that the query holds out."""
    got = {r.doc_id: r for r in query(spark, TENTH).collect()}
    labels = [(r.doc_id, r[label]) for r in spark.read.parquet(f"{TENTH}/labels.parquet").collect()]
    assert len(got) == spark.read.parquet(f"{TENTH}/documents.parquet").count() and all(0 <= r.score <= 1 for r in got.values())
    return np.array([(got[i].predicted, y) for i, y in labels if got[i].held_out]).T


def test_quality_held_out(spark):
    predicted, true = on_held_out(spark, quality.op3_quality, "quality")
    assert (predicted == true).mean() > 0.98


def test_toxicity_held_out(spark):
    """Some 8 % of the positive labels are on texts without any word that marks others, so recall can't be much higher."""
    predicted, true = on_held_out(spark, toxicity.op1_toxicity, "toxic")
    assert predicted[true == 1].mean() > 0.88 and true[predicted == 1].mean() > 0.93


def test_lexicon():
    """Covering takes what adds documents; frequent, precise terms follow although all their documents are marked."""
    names = ["bad", "worse", "awful", "the", "rare"]
    docs = [[0, 1, 3]] * 9 + [[0, 3]] * 3 + [[2, 3]] * 2 + [[4]] + [[3]] * 20 + [[2, 3]]
    labels = np.array([1] * 15 + [0] * 21)
    rows = training.Rows([np.array(x, np.int32) for x in docs])
    positive, negative = (np.array([sum(k in d and y == want for d, y in zip(docs, labels)) for k in range(5)]) for want in (1, 0))
    assert toxicity.lexicon(rows, labels, positive, negative) == [0, 1]  # awful: a share of 2.5 / 4; rare: one document
    assert toxicity.lexicon(rows, labels, positive, np.where(np.arange(5) == 2, 0, negative)) == [0, 2, 1]
    chosen = [0, 2]
    got = toxicity.vote(rows, names, chosen)
    for d, v in zip(docs, got):
        hits = [k for k in d if k in chosen]
        plain = [toxicity.YES if c in d else toxicity.ABSTAIN for c in chosen]
        plain += [toxicity.NO if not hits else toxicity.ABSTAIN, toxicity.YES if hits else toxicity.ABSTAIN]
        plain += [toxicity.YES if len(hits) >= 2 else toxicity.NO if not hits else toxicity.ABSTAIN]
        longest = max([len(names[k]) for k in hits], default=0)
        plain += [toxicity.YES if longest >= 5 else toxicity.NO if longest <= 3 else toxicity.ABSTAIN]
        plain += [toxicity.YES if 100 * len(hits) >= max(100, len(d)) else toxicity.ABSTAIN]
        assert v.tolist() == plain


def test_language_held_out(spark, sf):
    rows = langid.op8_language(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and np.mean([r.lang_pred == lang[r.doc_id] for r in seen]) > 0.95


def test_odd_rows(spark, docs, clashing, nothing, texts):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    q, t = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    for frame in (docs, clashing):
        assert quality.score_quality(frame, q).count() == len(texts) == toxicity.score_toxicity(frame, t).count()
        assert quality.score_quality(frame, q).where("score is null or score < 0 or score > 1").count() == 0
    for none in (quality.fit_quality(nothing, labels), quality.fit_quality(docs, labels.limit(0))):
        assert quality.score_quality(docs, none).select("score").distinct().count() == 1
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(nothing, labels)).count() == len(texts)
    assert quality.score_quality(nothing, q).count() == 0 == toxicity.score_toxicity(nothing, t).count()


def test_odd_languages(spark, docs, nothing, texts):
    tagged = docs.withColumn("lang", (docs.doc_id % 2).cast("string"))
    field = langid.fit_language(tagged)
    got = langid.identify(docs, field).collect()
    assert len(got) == len(texts)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in dict(texts)[r.doc_id] or "")) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in langid.identify(docs, langid.fit_language(nothing)).collect()} == {"und"}
    assert langid.identify(nothing, field).count() == 0
    odd = docs.limit(2).withColumn("text", F.lit("½ ² ① Ⅷ"))
    assert {(r.lang_pred, r.score) for r in langid.identify(odd, field).collect()} == {("und", 0.0)}


def test_forward_backward():
    """Marginals and expected transitions against all labellings of a short chain."""
    from itertools import product

    rng = np.random.default_rng(3)
    emit, start, move = rng.normal(size=(1, 4, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    mask = np.array([[True, True, True, False]])
    marginal, expected = forward_backward(emit, mask, start, move, pairs=True)
    paths = list(product(range(3), repeat=3))
    weight = np.array([np.exp(start[p[0]] + sum(emit[0, i, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in paths])
    weight /= weight.sum()
    for i in range(3):
        for k in range(3):
            assert abs(marginal[0, i, k] - sum(w for w, p in zip(weight, paths) if p[i] == k)) < 1e-9
    want = np.zeros((3, 3))
    for w, p in zip(weight, paths):
        for a, b in zip(p, p[1:]):
            want[a, b] += w
    assert np.abs(expected - want).max() < 1e-9


def test_label_model():
    """Accuracies are found without labels, also where two voters say the same."""
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, np.where(y, 2, 1), np.where(y, 1, 2)) for a in (0.9, 0.85, 0.8, 0.7)], axis=1)
    votes = np.concatenate([votes, votes[:, 3:]], axis=1)
    model = toxicity.LabelModel(votes, np.where((votes == 2).sum(axis=1) > 2, 0.9, 0.1))
    assert ((model.posterior > 0.5) == y).mean() > 0.93
    assert model.parent[3] == 4 or model.parent[4] == 3


def test_solvers():
    rng = np.random.default_rng(5)
    lists = [np.flatnonzero(rng.random(20) < 0.3) for _ in range(300)]
    y = np.array([1.0 if 3 in x or 7 in x else 0.0 for x in lists])
    rows = training.Rows(lists)
    w, b = training.fit_logistic(rows, y, 20, l2=1e-4, steps=500)
    assert ((rows.times(w) + b > 0) == (y > 0)).all()
    w, b = training.fit_hinge(rows, np.where(y > 0, 1.0, -1.0), np.ones(300), 20, epochs=60)
    assert ((rows.times(w) + b > 0) == (y > 0)).mean() > 0.97


def test_licenses(spark, nothing):
    rows = [
        (1, "Intro.\nLicensed under the Apache License, Version 2.0.\nThe end"), (2, "Released under the MIT License."), (3, "Licensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3."), (5, "The license of the driver was lost."), (6, None), (7, ""), (8, "plain text about the version of a work"),
    ]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, family long, words string")
    model = licenses.fit_licenses(docs)
    got = {(r.doc_id, r.line_no): r for r in licenses.scan(docs, model).collect()}
    assert {k: r.family for k, r in got.items()} == {(1, 1): "apache-2.0", (2, 0): "mit", (3, 0): "cc-by-nc", (4, 0): "gpl", (5, 0): "unknown"}
    assert all(r.confirmed == (r.family != "unknown") for r in got.values())
    assert licenses.scan(nothing, model).count() == 0
    plan = licenses.scan(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_notices_without_cue(spark):
    """Notices that hold no cue are found though the sample holds them too, also where a third of all lines are one."""
    notices = {
        "All rights reserved.": "proprietary",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction.": "mit",
        "Released into the public domain.": "cc0",
    }
    plain = "The river is long and the work of a person is free of any charge"
    rows = [(i, f"{plain} {i}\nAll rights reserved.\nA copy of line {i} was sent to the city") for i in range(60)]
    rows += [(100 + i, f"Before {i}\n{t}\nafter") for i, t in enumerate(notices)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r.family for r in licenses.scan(docs, licenses.fit_licenses(docs)).collect()}
    assert got == {(i, 1): "proprietary" for i in range(60)} | {(100 + i, 1): f for i, f in enumerate(notices.values())}


def test_licences_see_all_lines(spark):
    """Counts of words are those of all lines, beyond what the lines weigh together; cues and lines near a template don't count."""
    n = 2 * licenses.OTHER_LINES
    lines = spark.range(n).selectExpr("concat('the river of line ', id, if(id % 2 = 0, ' in source', '')) AS line")
    lines = lines.unionByName(spark.createDataFrame([("All rights reserved.",), ("the license",), ("",)], "line string"))
    got = {tuple(r.grams): r.weight for r in licenses._patterns(lines).collect()}
    assert sum(w for g, w in got.items() if "in source" in g) == n // 2
    assert sum(got.values()) == n


def test_patterns_of_odd_lines(spark):
    """The patterns are those of a plain version, also of odd separators and letters; no function on elements runs on each line."""
    rng = np.random.default_rng(12)
    words = [*licenses._WORDS, *licenses.CUES, *"river them ofx xof é ß Ⅷ İn ½ 2.0 By-NC of_the \U0001d400the the\U0001d400 !!! work\u0301".split()]
    lines = ["".join(str(x) for w in rng.choice(words, rng.integers(0, 14)) for x in (w, rng.choice([" ", "  ", "-", ", ", "_", "\t", "\u00a0"]))) for _ in range(2000)]
    lines += ["", " ", "!!!", "the", " the ", "the river " * 20_000]
    lines += [x.upper() for x in lines[:200]]
    want = {}
    for line in lines:
        own = licenses.tokens(line)
        found = licenses.grams(own) & {*licenses.VOCABULARY}
        near = any(g.count(" ") == 2 for g in found) or any(len(found & {*t}) >= licenses.CONFIRMED * len(t) for t in licenses._TEMPLATE_WORDS)
        if own and not near and not {*own} & {*licenses.CUES}:
            want[tuple(sorted(found))] = want.get(tuple(sorted(found)), 0) + 1
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {tuple(r.grams): r.weight for r in licenses._patterns(df).collect()} == want
    plan = licenses._patterns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.rpartition("Aggregate")[2]  # the innermost one groups the lines


@pytest.mark.parametrize("parts,part", [(3, 1), (4, 2)])
def test_folds(spark, parts, part):
    import zlib

    got = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", training.held_out(parts, part).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in got)


def test_hash_sample(spark):
    """The same rows as sorting all of them."""
    from pyspark.sql import functions as F

    df = spark.range(20_000, numPartitions=5).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in df.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id").limit(500).collect()]
    assert [r.doc_id for r in training.hash_sample(df, 500, "doc_id").collect()] == want
    assert training.hash_sample(df.limit(7), 500, "doc_id").count() == 7 and training.hash_sample(df.limit(0), 5, "doc_id").count() == 0


def test_blocks_pass_messages(monkeypatch):
    """Marginals of texts laid out in short blocks are those of whole chains."""
    rng = np.random.default_rng(6)
    field = langid.Field(["a", "b", "c"], set())
    field.start, field.move = rng.normal(size=3), rng.normal(size=(3, 3)) * 2
    lengths = np.array([1, 4, 5, 0, 23, 8, 130])
    emit = rng.normal(size=(lengths.sum(), 3)).astype(np.float32)
    found = []
    for chain in (4, 1000):
        monkeypatch.setattr(langid, "CHAIN", chain)
        found.append(langid.Labeller(field)._means(emit, lengths))
    assert np.allclose(*found, atol=1e-9)


def test_unlabelled(spark):
    """The label model sees documents without labels too, and finds those that hold an entry."""
    rng = np.random.default_rng(7)
    plain = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*rng.choice(plain, 30), *([["vileword"], ["badword"]][i % 2] if i % 5 == 0 else [])])) for i in range(1500)]
    labels = [(i, int(i % 5 == 0)) for i in range(300)]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    q = model.label_model.posterior
    assert len(q) == 1500 and abs((q > 0.5).sum() - 300) <= 15
    assert model.score("w1 w2 vileword w3") > 0.7 > model.score("w1 w2 w3 w4")


def test_paragraphs(spark):
    """Wrapped notices, repeated rows and lines, very long lines, and columns that clash with names used inside."""
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 900, n))
    wrapped = "Permission is hereby\ngranted, free of charge, to any\nperson obtaining a copy of\nthis software, to deal in the\nSoftware without restriction."
    long = f"{prose(30_000)} Licensed under the Apache License, Version 2.0. {prose(3000)}"
    rows = [(1, f"{prose(9)}\n{wrapped}\n{prose(9)}"), (2, "Released under the MIT License.\nReleased under the MIT License."), (2, "Released under the MIT License.\nReleased under the MIT License."), (3, long), (4, prose(50)), (None, "All rights reserved.")]
    docs = spark.createDataFrame([(i, t, *[0] * 6) for i, t in rows], "doc_id long, text string, line int, row int, gram int, cue int, known int, lines int")
    got = licenses.scan(docs, licenses.fit_licenses(docs)).collect()
    own = [r for r in got if r.doc_id == 1]
    assert {r.family for r in own} == {"mit"} and sum(r.lines for r in own) >= 3 and max(r.lines for r in own) >= 2
    assert sorted((r.line_no, r.family) for r in got if r.doc_id == 2) == [(0, "mit"), (0, "mit"), (1, "mit"), (1, "mit")]
    assert [r.family for r in got if r.doc_id == 3] in (["apache-2.0"], ["unknown"])
    assert [r.family for r in got if r.doc_id is None] == ["proprietary"] and not [r for r in got if r.doc_id == 4]


def test_bound_loses_none(spark):
    """No line that a family is sure of stays below the bound of its words."""
    rng = np.random.default_rng(10)
    model = licenses.LicenseModel([" ".join(f"w{x}" for x in rng.integers(0, 50, 12)) for _ in range(400)])
    words = sorted({w for g in model.weights for w in g.split(" ")})
    for _ in range(3000):
        line = [str(x) for x in rng.choice(words, rng.integers(1, 12))]
        if rng.random() < 0.7:
            template = licenses.tokens(rng.choice([t for ts in licenses.TEMPLATES.values() for t in ts]))
            a = int(rng.integers(len(template)))
            line = template[a : a + int(rng.integers(1, 9))] + line[:3]
        margin = np.array(model.bias) + sum((np.array(model.weights[g]) for g in licenses.grams(line) if g in model.weights), np.zeros(len(model.bias)))
        if (margin >= np.array(model.need)).any():
            assert sum(model.charge.get(w, 0.0) for w in set(line)) >= 0.999999


def test_clashing_language(clashing, docs):
    """Further columns with names used inside change nothing."""
    field = langid.Field.learned([["the", "house"] * 8, ["der", "tag"] * 8] * 6, ["en", "de"] * 6)
    plain = sorted(map(repr, langid.identify(docs, field).collect()))
    assert plain == sorted(map(repr, langid.identify(clashing, field).collect()))


def test_numerals_are_no_letters():
    assert langid.words_of("½ ² ① Ⅷ ㊿") == [] and langid.words_of("x²y ①Ab ⅷ 3c") == ["x", "y", "ab", "c"]
    assert langid.words_of(None) == [] and langid.words_of("Straße été") == ["straße", "été"]
