"""The pipeline's stages against plain versions, each on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_pipeline import STAGES, run
from sixfold.llm import common, near_copies
from sixfold.llm.common import with_group
from sixfold.llm.registry import ORACLES

from .test_contamination_sharding_packing import words
from .test_dedup import lower


def test_registered():
    assert [n for n, _ in STAGES] == ["quality", "exact", "near", "decontaminate", "packing"]
    assert set(ORACLES) == {"op5_exact_dedup", "op7_decontaminate", "op11_negatives"}


def test_sql(spark, sf, same):
    from sixfold.llm.registry import QUERIES

    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, sf), sql)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    assert bad
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "quality":
            assert set(after) <= set(before) and len(good & set(after)) >= 0.98 * len(good) and len(bad & set(after)) <= 0.1 * len(bad)
        elif name == "exact":
            assert set(after) == {max(i for i, t in before.items() if lower(t) == x) for x in {lower(t) for t in before.values()}}
        elif name == "near":
            rows = list(before.items())
            assert set(after) == {rows[k][0] for k in brute_near(rows)}
        else:
            wins = {tuple(w[i : i + 10]) for w in map(words, [r.text for r in bench]) for i in range(len(w) - 9)}
            clean = {i for i, t in before.items() if not any(tuple(words(t)[k : k + 10]) in wins for k in range(len(words(t))))}
            assert set(after) == clean
        before = after
    pieces = STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == set(before)


def test_run(spark, sf):
    rows = run(spark, sf).collect()
    assert rows and all(r.length > 0 for r in rows)
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r.doc_id: r.doc_tokens for r in rows}


def test_repeated_rows(spark, docs, sf):
    """Of rows repeated with one id and text, the exact stage keeps one."""
    kept = [r.doc_id for r in dict(STAGES)["exact"](spark, docs, sf).collect()]
    assert kept.count(500) == 1


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_near(rows):
    """The places of rows that have the least id of their component under a 5-word Jaccard similarity of 0.8."""
    sets, root = [five_words(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    return {min((k for k in range(len(rows)) if root[k] == r), key=lambda k: rows[k][0]) for r in set(root)}


@pytest.mark.parametrize("part,often,crowd", [(500, 4, 32), (2, 10**6, 32), (500, 10**6, 4)])
def test_near_similarity(spark, sf, part, often, crowd, monkeypatch):
    """Pairs around 0.8, a chain, a crowd and a shared line, against brute-force Jaccard; small parts deal every bucket, and
    with a small crowd the shingles of shared lines go to the end of the order."""
    monkeypatch.setattr(near_copies, "PART", part)
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "OFTEN", often)
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    line, rows = prose(30), []
    for _ in range(12):
        base = prose(rng.randrange(40, 250))
        rows.append(base)
        for cut in (0.88, 0.9, 0.95):
            rows.append(base[: int(len(base) * cut)] + prose(len(base) - int(len(base) * cut)))
        rows.append([x if rng.random() > 0.02 else "x" for x in base])
    chain = prose(200)
    for _ in range(6):
        chain = chain[15:] + prose(15)
        rows.append(chain)
    crowd = prose(120)
    rows += [[x if rng.random() > 0.015 else f"y{rng.randrange(9)}" for x in crowd] for _ in range(40)]
    rows += [line + prose(rng.randrange(2, 60)) for _ in range(40)] + [[], ["one"], ["One"]]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in dict(STAGES)["near"](spark, docs, sf).collect())
    assert got == sorted(brute_near(rows)) and len(got) < len(rows) - 40


def test_shared_passages(spark, monkeypatch):
    """Texts that share passages and little else make few pairs once the passages' shingles are last, and none is lost."""
    monkeypatch.setattr(near_copies, "OFTEN", 10**6)
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for _ in range(3):
        passage = prose(60)
        own = [prose(20) + passage + prose(25) for _ in range(80)]
        rows += own + [w[:-2] + ["x", "y"] for w in own[:10]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    met = []
    real = near_copies._linked

    def seen(pairs, docs, maps, scratch):
        out = real(pairs, docs, maps, scratch)
        if maps is None:
            met.append(pairs.count())
        return out

    monkeypatch.setattr(near_copies, "_linked", seen)
    docs = spark.createDataFrame(rows, "row long, text string")
    counts = {}
    for rounds in (0, 3):
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        monkeypatch.setattr(near_copies, "CROWD", 8)
        got = {}
        for r in near_copies.near_copies(docs).collect():
            got.setdefault(r.component, set()).add(r.row)
        kept = {k for k, _ in rows} - {x for c in got.values() for x in c if x != min(c)}
        assert kept == {rows[k][0] for k in brute_near(rows)} and len(kept) == 240
        counts[rounds] = met.pop()
    assert counts[3] * 5 <= counts[0] or counts[0] == 0


def test_fingerprints_first(spark):
    """The near stage's first pairs are those of op2's deletion-variant signatures, on prints of five words."""
    import numpy as np

    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**5)}" for _ in range(300)] for _ in range(6)]
    texts = [" ".join(x if rng.random() > change else "y" for x in w) for w in base for change in (0, 0, 0.003, 0.01, 0.03)]
    common = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    prefixes = near_copies.stored(docs.mapInArrow(near_copies._prefixes(common), near_copies.PREFIX), "test-prefixes")
    prints = []
    for t in texts:
        own = [int(x) for x in near_copies.shingles(t.encode())]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own)))
    assert {r.row: r.fp % 2**64 for r in prefixes.select("row", "fp").collect()} == dict(enumerate(prints))
    pairs = {(r.a, r.b) for r in near_copies._by_prints(prefixes).collect()}
    root = lambda links: [min(x) for x in (reached(i, links, len(texts)) for i in range(len(texts)))]
    close = {(i, j) for j in range(len(texts)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert pairs <= close and len(close) > 6 and root(pairs) == root(close)


def reached(i, links, n):
    seen, more = set(), {i}
    while more:
        seen |= more
        more = {b for a, b in links | {(b, a) for a, b in links} if a in seen} - seen
    return seen


def test_lookups_without_hot_keys(spark):
    """Groups that are all small are joined plainly, without a broadcast that the driver would have to hold; hot ones still get theirs."""
    rows = spark.range(4000).selectExpr("id", "if(id % 5 = 0, null, id % 50) AS k")
    for hot in (False, True):
        many = rows.unionByName(spark.range(3000).selectExpr("-id - 1 AS id", "7L AS k")) if hot else rows
        groups = many.where("k is not null").groupBy("k").count().withColumn("x", F.col("k") * 2)
        got = with_group(many, groups, "k", "count")
        assert got.columns == ["k", "id", "count", "x"]
        size = {k: 80 + 3000 * (hot and k == 7) for k in range(50)}
        want = {(r.id, r.k, r.k and size[r.k], r.k and 2 * r.k) for r in many.collect()}
        assert {(r.id, r.k, r["count"], r.x) for r in got.collect()} == want and got.count() == many.count()
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == hot


def test_sizes_of_a_bucket(spark):
    """A bucket is kept if two of its members can reach the similarity by size and place, and always if they do."""
    from pyspark.sql import functions as F

    rng, rows = random.Random(7), []
    for g in range(3000):
        n = [rng.randrange(1, 3000), rng.randrange(1, 3000)]
        n[1] = rng.randrange(max(1, -(-4 * n[0] // 5)), n[0] * 5 // 4 + 1) if g % 2 else n[1]
        rows += [(g, m, rng.randrange(0, m // 5 + 1)) for m in n]
    df = spark.createDataFrame(rows, "g long, n int, at int")
    kept = {r.g for r in df.groupBy("g").agg(*near_copies._filled(F.col("n"), F.col("at"))).where(near_copies.WORTH).collect()}
    can = {g for (g, n, x), (_, m, y) in zip(rows[::2], rows[1::2]) if 9 * (1 + min(n - x - 1, m - y - 1)) >= 4 * (n + m)}
    assert can <= kept and len(can) > 300 and len(kept) < 2000


def test_near_on_tables(spark, sf):
    """The near stage on the given table, quality filter not applied, and the stage after it on what is left."""
    docs = dict(STAGES)["exact"](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept = dict(STAGES)["near"](spark, docs, sf)
    want = {rows[k] for k in brute_near(rows)}
    assert {(r.doc_id, r.text) for r in kept.collect()} == want and len(want) < len(rows)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    wins = {tuple(w[i : i + 10]) for w in map(words, bench) for i in range(len(w) - 9)}
    clean = {i for i, t in want if not any(tuple(words(t)[k : k + 10]) in wins for k in range(len(words(t))))}
    assert {r.doc_id for r in dict(STAGES)["decontaminate"](spark, kept, sf).collect()} == clean


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, sha string, words array<string>"


def odd(spark, rows):
    """Rows of id and text, with further columns whose names the stages use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, 0.1, 7, "x", ["w"]) for i, t in rows], ODD)


def test_by_row(spark, sf):
    """One id on several texts, ids that are missing, and clashing columns: each row is decided by itself."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 80").first().text
    filler = lambda n, seed: " ".join(f"w{random.Random(seed + i).randrange(10**6)}" for i in range(n))
    stages, unique = dict(STAGES), filler(40, 1)
    kept = lambda name, rows: sorted((repr((r.doc_id, r.text)) for r in stages[name](spark, odd(spark, rows), sf).collect()))
    want = lambda rows: sorted(map(repr, rows))
    assert kept("exact", [(5, "same text here"), (9, "Same text here"), (5, unique), (None, "SAME text here"), (None, "alone"), (None, "alone"), (3, None), (2, "")]) == want([(9, "Same text here"), (5, unique), (None, "alone"), (3, None)])
    assert kept("decontaminate", [(5, f"before {item} after"), (5, unique), (None, item), (6, None)]) == want([(5, unique), (6, None)])
    near = filler(60, 2)
    assert kept("near", [(5, near), (4, near + " more"), (4, unique), (None, near + " yet"), (8, None), (9, "")]) == want([(4, near + " more"), (4, unique), (8, None)])
    for name, stage in STAGES[:-1]:
        assert stage(spark, odd(spark, [(1, unique)]), sf).columns == odd(spark, []).columns


def test_nothing(spark, nothing, sf):
    """Empty tables go through every stage, and so do rows without any label."""
    for name, stage in STAGES[:-1]:
        out = stage(spark, nothing, sf)
        assert out.columns == nothing.columns and out.count() == 0
    assert STAGES[-1][1](spark, nothing, sf).count() == 0


def test_null_labels(spark, docs, tmp_path):
    spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert dict(STAGES)["quality"](spark, docs, str(tmp_path)).count() == docs.count()


def test_joined(spark, monkeypatch):
    """Forests, and stars where these don't help, give the components of plain Python."""
    rng = random.Random(5)
    chain = list(range(100, 160))
    edges = list(zip(chain, chain[1:])) + [(1, k) for k in range(200, 260)] + [(k, 260 - k) for k in range(1, 40)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(90)]
    rng.shuffle(edges)
    least = {x: x for e in edges for x in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    for forest in (1, 7, 10**6):
        monkeypatch.setattr(near_copies, "FOREST", forest)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        df = spark.createDataFrame(edges, "a long, b long").repartition(5)
        for most in (0, 10**6):
            monkeypatch.setattr(near_copies, "BROADCAST_ROWS", most)
            with near_copies.Scratch(spark) as scratch:
                assert sorted(map(tuple, near_copies._joined(df, scratch).collect())) == sorted(least.items())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def test_few_jobs(spark, docs):
    """The driver keeps what it knows of finished jobs and tasks, so a near stage must not run hundreds of them."""
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "near copies")
    near_copies.near_copies(docs.select(F.monotonically_increasing_id().alias("row"), "text")).count()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few-jobs")) < 100


def test_driver_gives_back(spark, nothing, sf, monkeypatch):
    """The driver's JVM gives back what its C library has freed, behind each scratch table on a cluster and before each stage."""
    assert common.trim_jvm(spark).startswith("Trim native heap")
    calls = []
    for where in (common, corpus_pipeline):
        monkeypatch.setattr(where, "tidy_driver", calls.append)
    with common.Scratch(spark, tidy=True) as scratch:
        assert not scratch.tidy  # a local session
        scratch.tidy = True
        assert scratch.stored(nothing, "none").count() == 0 and len(calls) == 1
    dict(STAGES)["packing"](spark, nothing, sf)
    assert calls == [spark, spark]
