"""Licence notices in documents: a trained paragraph classifier in DataFrame functions.

A multinomial logistic regression over sparse word n-grams, fitted by Spark on notice templates, their shortened and
surrounded variants and all of the corpus's own lines, names a paragraph's family. Counts of words and the thresholds are
those of all lines too. A paragraph that speaks of licensing but reaches no
family's threshold is `unknown`. A family counts as confirmed if the paragraph also holds enough of the words of one of the
family's templates.

A paragraph is a line, or neighbouring lines none of which is a notice by itself but which all hold words of notices, as of
a notice that is wrapped. Every line is read: the weights of its words bound what any family can reach, and only lines
that stay below that bound for every family, and name no licensing word, are done with.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, stored, table

#: Notices of each family, in the words that such notices commonly use.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license. SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction.",
        "This code is available under the terms of the MIT license. SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "Distributed under the GPL, version 2 or later. SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the LGPL. SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Distributed under the AGPL. SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Released under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the MPL 2.0. SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under CC BY-SA 4.0, the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights. Dedicated to the public domain under CC0 1.0.",
        "Released into the public domain. SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
        "Copyright. All rights reserved. Confidential and proprietary.",
        "All rights reserved.",
    ],
}
FAMILIES = list(TEMPLATES)
#: Sentences that speak of licensing without a family; they calibrate the thresholds.
GENERIC = [
    "Licensed under the terms of our own license.", "See the LICENSE file for details.", "A license fee applies to this product.",
    "This software is licensed, not sold.", "The license was revoked last year.", "Copyright by the authors.", "The permission was granted by the city.",
    "Released under a custom license.", "Distributed under different terms.", "This work is licensed.", "Please read the license agreement version 4.",
]
#: Words that mark a paragraph as speaking of licensing at all.
CUES = ["license", "licensed", "licence", "licenced", "licenses", "licensing", "copyright", "spdx", "redistribution", "copyleft"]
#: All lines of other text weigh as much as so many templates' variants, at most; n-grams are up to ORDER words long.
OTHER_LINES, ORDER = 3000, 3
#: Share of a template's words that confirms a family.
CONFIRMED = 0.6
#: Share of what the weakest family needs that makes a line part of a paragraph of several lines, if its rare words give it;
#: a rare word is in this share of other lines at most.
EVIDENCE, COMMON = 0.1, 0.01
#: Share of all other lines that may pass a family's threshold.
FALSE = 0.001
#: Steps of the fit, at most.
STEPS = 60
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: str) -> list[str]:
    return [x for x in re.split(r"[^\w]+|_", text.lower()) if x]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, ORDER + 1) for i in range(len(words) - n + 1)}


VOCABULARY = sorted(set().union(*(grams(tokens(t)) for ts in TEMPLATES.values() for t in ts)))


_WORDS = [g for g in VOCABULARY if " " not in g]
_TEMPLATE_WORDS = [list(dict.fromkeys(tokens(t))) for ts in TEMPLATES.values() for t in ts]


def _tree(words: list[str]) -> str:
    """A regular expression for these words, by their letters: most other words are told by the first one."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    if not heads:
        return ""
    return "(?:" + "|".join(re.escape(c) + _tree(rest) for c, rest in heads.items()) + ")" + "?" * ("" in words)


#: Between blanks, a word that is neither of the vocabulary nor a cue.
UNKNOWN = rf"(?<= )(?!{_tree(sorted({*_WORDS, *CUES}))} )[^ ]+"


def _runs(lines: DataFrame) -> DataFrame:
    """runs (the different ones of neighbouring known words) and weight (how many lines have just these) of all lines with words.

    Regular expressions are compiled with the pass over the lines; functions on an array's elements aren't, so only the groups get those.
    """
    blanks = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col("line")), SPLIT, " "), F.lit(" "))
    known = lines.select(F.explode(F.array(blanks)).alias("words")).where(F.trim("words") != "").select(F.trim(F.regexp_replace("words", UNKNOWN, "")).alias("known"))
    return known.groupBy(F.sort_array(F.array_distinct(F.split("known", " {2,}"))).alias("runs")).agg(F.count("*").alias("weight"))


def _patterns(lines: DataFrame) -> DataFrame:
    """grams (those of the vocabulary) and weight (how many lines have just these) of all lines that stand for other text.

    Lines near a template, which share ORDER words in a row with one or hold CONFIRMED of its words, and those with a word of
    licensing don't.
    """

    def of(words: Column) -> Column:
        at = lambda i, k: F.get(words, i + (k - 1))
        two = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: (at(i, 0) != "") & (at(i, 1) != ""))
        pairs = F.transform(two, lambda i: F.concat_ws(" ", at(i, 0), at(i, 1)))
        threes = F.transform(F.filter(two, lambda i: at(i, 2) != ""), lambda i: F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)))
        return F.sort_array(F.array_distinct(F.concat(F.array_remove(words, ""), F.filter(F.concat(pairs, threes), lambda g: g.isin(VOCABULARY)))))

    apart = F.split(F.array_join("runs", "  "), " ")  # an empty word between runs
    words = _runs(lines).select("weight", F.explode(F.array(apart)).alias("words")).where(~F.arrays_overlap("words", F.lit(CUES)))
    # Out of a generator, since the filters below would else be put before the sums, each with an expression of its own for the grams.
    each = words.select("weight", F.explode(F.array(let(F.col("words"), of))).alias("grams")).groupBy("grams").agg(F.sum("weight").alias("weight"))
    longest = F.exists("grams", lambda g: F.length(g) - F.length(F.replace(g, F.lit(" "))) == ORDER - 1)
    shared = [F.size(F.array_intersect("grams", F.lit(t))) >= CONFIRMED * len(t) for t in _TEMPLATE_WORDS]
    return each.where(~longest).where(~F.exists(F.array(*shared), lambda x: x))


class LicenseModel:
    """weights[gram] by family against other text, bias, and the margin that each family needs. other: lines, of which those
    near a template, or with a word of licensing, don't stand for other text."""

    def __init__(self, other: DataFrame | list[str], seed: int = 9):
        spark = SparkSession.active()
        lines = other if isinstance(other, DataFrame) else spark.createDataFrame([(x,) for x in other], "line string")
        patterns = stored(_patterns(lines), "license-patterns")
        total = patterns.agg(F.sum("weight")).first()[0] or 0
        ones = patterns.select(F.explode("grams").alias("w"), "weight").where(F.col("w").isin(_WORDS)).groupBy("w").agg(F.sum("weight").alias("n"))
        common = {r.w: r.n for r in ones.collect()}
        random = np.random.default_rng(seed)
        rows = []

        def surrounding() -> list[str]:
            """The vocabulary's words of an average line, apart from each other."""
            own = [w for w in _WORDS if random.random() * max(1, total) < common.get(w, 0)]
            return [x for w in random.permutation(own).tolist() for x in ("", w)]

        for k, family in enumerate(FAMILIES):
            for template in TEMPLATES[family]:
                words = tokens(template)
                for n, drop in enumerate([0.0] * 6 + [0.1] * 10 + [0.25] * 10):
                    own = [w for w in words if random.random() >= drop]
                    if n % 3 == 2:  # inside other text
                        x = surrounding()
                        cut = int(random.integers(len(x) + 1))
                        own = [*x[:cut], "", *own, "", *x[cut:]]
                    rows.append((sorted(grams(own)), float(k), 1.0))
        generic = [grams(tokens(x)) for x in GENERIC]
        rows += [(sorted(x), float(len(FAMILIES)), 10.0) for x in generic]
        scale = min(1.0, OTHER_LINES / max(1, total))
        data = patterns.select("grams", F.lit(float(len(FAMILIES))).alias("label"), (F.col("weight") * scale).alias("weight"))
        data = data.unionByName(spark.createDataFrame(rows, "grams array<string>, label double, weight double"))
        vectors = CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="grams", outputCol="features").setBinary(True)
        fit = LogisticRegression(family="multinomial", weightCol="weight", regParam=3e-5, elasticNetParam=2 / 3, standardization=False, maxIter=STEPS).fit(vectors.transform(data))
        matrix, bias = fit.coefficientMatrix.toArray(), fit.interceptVector.toArray()
        matrix, self.bias = matrix[:-1] - matrix[-1], (bias[:-1] - bias[-1]).tolist()
        self.weights = {g: matrix[:, i].tolist() for i, g in enumerate(VOCABULARY) if (np.abs(matrix[:, i]) > 1e-3).any()}
        # How many lines of other text have which margin, in steps of 1/1000, where it is above that of an even chance.
        raw = vector_to_array("rawPrediction")
        margins = fit.transform(vectors.transform(patterns)).select("weight", F.posexplode(F.transform(F.slice(raw, 1, len(FAMILIES)), lambda x: x - F.get(raw, F.lit(len(FAMILIES))))).alias("k", "margin"))
        passed = margins.where("margin > 0").groupBy("k", F.ceil(F.col("margin") * 1000).alias("step")).agg(F.sum("weight").alias("n")).collect()
        self.need = []
        for k in range(len(FAMILIES)):
            of = [sum(self.weights[g][k] for g in x if g in self.weights) + self.bias[k] for x in generic]
            need, beyond = max(0.0, max(of) + 1e-6), 0
            for r in sorted((r for r in passed if r.k == k), key=lambda r: -r.step):
                beyond += r.n
                if beyond > FALSE * total:
                    need = max(need, r.step / 1000 + 1e-6)
                    break
            self.need.append(need)
        self.charge = self._charges(common)
        #: Words that few other lines have: only these tell that a line may be part of a longer notice.
        self.rare = [w for w in self.charge if common.get(w, 0) <= COMMON * total]

    def _charges(self, common: dict[str, int]) -> dict[str, float]:
        """What a word can add to a line at most, as a share of what a family needs: each n-gram counts for its rarest word."""
        room = [max(n - b, 1e-3) for n, b in zip(self.need, self.bias)]
        sums: dict[str, np.ndarray] = {}
        for g, weights in self.weights.items():
            word = min(g.split(" "), key=lambda w: (common.get(w, 0), w))
            sums[word] = sums.get(word, np.zeros(len(room))) + np.maximum(weights, 0) / room
        return {w: float(x.max()) for w, x in sums.items() if x.max() > 0}


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), SPLIT), "")


def _grams(words: Column) -> Column:
    n = F.size(words)
    parts = [words]
    for k in range(2, ORDER + 1):
        starts = F.when(n >= k, F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        parts.append(_joined(words, starts, k))
    return F.array_distinct(F.concat(*parts))


def _joined(words: Column, starts: Column, k: int) -> Column:
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))


def fit_licenses(docs: DataFrame) -> LicenseModel:
    return LicenseModel(_lines(docs).where(F.length("line") > 0).select("line"))


def _scored(paragraphs: DataFrame, model: LicenseModel, reaches: Column | None = None) -> DataFrame:
    """paragraphs (words: ARRAY<STRING>) with best: chance, family and whether it is sure. Sums are made in the row, for
    those that can reach a family, if that is known."""
    vocabulary = list(model.weights)
    place, matrix = F.lit(vocabulary), F.array(*[F.lit([float(x) for x in model.weights[g]]) for g in vocabulary])
    hits = let(F.col("words"), lambda w: F.filter(_grams(w), lambda g: g.isin(vocabulary)))
    if reaches is not None:
        hits = F.when(reaches, hits).otherwise(F.array().cast("array<string>"))
    zero = F.lit([0.0] * len(FAMILIES))
    total = F.aggregate(F.col("_hits"), zero, lambda acc, g: F.zip_with(acc, F.get(matrix, (F.array_position(place, g) - 1).cast("int")), lambda x, y: x + y))
    out = paragraphs.withColumn("_hits", hits).withColumn("_sums", F.explode(F.array(total)))
    power = [F.exp(F.least(F.get("_sums", k) + model.bias[k], F.lit(300.0))) for k in range(len(FAMILIES))]
    out = out.withColumn("_all", F.explode(F.array(sum(power, F.lit(1.0)))))

    def chance(k: int) -> Column:
        p = power[k] / F.col("_all")
        sure = (F.get("_sums", k) + model.bias[k] >= model.need[k]) & (p >= 0.5)
        return F.struct(sure.alias("sure"), p.alias("p"), F.lit(FAMILIES[k]).alias("family"))

    return out.withColumn("best", F.array_max(F.array(*[chance(k) for k in range(len(FAMILIES))]))).drop("_hits", "_sums", "_all")


def scan(docs: DataFrame, model: LicenseModel) -> DataFrame:
    """One row per paragraph that speaks of licensing: doc_id, line_no, lines, family, probability, template, overlap, confirmed.

    line_no is the paragraph's first line, from 0. family is `unknown` where no family is sure; then template and overlap
    tell the nearest template of any family. Null and empty texts have no such paragraph, repeated rows and lines are
    answered one by one, and no rows give no rows. Of equal chances the family last by name counts. Columns other than
    doc_id and text are ignored.
    """
    cut = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), _words)  # so that words come out of the generator, once
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # before the generator, so that it numbers documents
    lines = rows.select("row", "doc_id", F.posexplode(cut).alias("line_no", "words"))
    names, worth = F.lit(list(model.charge)), F.lit(list(model.charge.values()))

    def evidence(words: Column) -> Column:
        return F.aggregate(words, F.lit(0.0), lambda a, w: a + F.get(worth, (F.array_position(names, w) - 1).cast("int")))

    known = let(F.array_intersect("words", names), lambda ws: F.struct(F.round(evidence(ws), 9).alias("all"), evidence(F.filter(ws, lambda w: w.isin(model.rare))).alias("rare")))
    cue = F.exists("words", lambda w: w.isin(CUES))
    lines = lines.withColumn("cue", cue).withColumn("known", F.explode(F.array(known))).where(f"known.all >= 0.999999 or known.rare >= {EVIDENCE} or cue").withColumn("evidence", F.col("known.all")).drop("known")
    # A line that is a notice by itself stays alone; neighbours among the others are one paragraph.
    alone = _scored(lines, model, F.col("cue") | (F.col("evidence") >= 0.999999)).select("*", F.col("best.sure").alias("sure"))
    others = W.partitionBy("row", "sure").orderBy("line_no")
    run = F.when(F.col("sure"), F.col("line_no")).otherwise(F.col("line_no") - F.row_number().over(others))
    found = alone.withColumn("run", run).groupBy("row", "sure", "run").agg(
        F.first("doc_id").alias("doc_id"),
        F.count("*").cast("int").alias("lines"),
        F.sum("evidence").alias("evidence"),
        F.max("cue").alias("cue"),
        F.array_sort(F.collect_list(F.struct("line_no", "words", "best"))).alias("of"),
    )
    found = found.where("sure or cue or (lines > 1 and evidence >= 0.999999)")
    found = found.select("doc_id", F.get("of", F.lit(0))["line_no"].alias("line_no"), "lines", "cue", F.flatten(F.transform("of", lambda x: x["words"])).alias("words"))
    best = _scored(found, model).where("best.sure or cue")
    best = best.select("doc_id", "line_no", "lines", F.array_distinct("words").alias("words"), F.when(F.col("best.sure"), F.col("best.family")).otherwise("unknown").alias("family"), F.col("best.p").alias("probability"))
    templates = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(f"{f}#{i}").alias("template"), F.array(*[F.lit(w) for w in dict.fromkeys(tokens(t))]).alias("own")) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)])
    near = F.transform(F.filter(templates, lambda t: (F.col("family") == "unknown") | (t["family"] == F.col("family"))), lambda t: F.struct((F.size(F.array_intersect(t["own"], F.col("words"))) / F.size(t["own"])).alias("overlap"), t["template"].alias("template")))
    out = best.withColumn("near", F.array_max(near))
    return out.select("doc_id", "line_no", "lines", "family", "probability", F.col("near.template").alias("template"), F.col("near.overlap").alias("overlap"), ((F.col("family") != "unknown") & (F.col("near.overlap") >= CONFIRMED)).alias("confirmed"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, fit_licenses(docs))
