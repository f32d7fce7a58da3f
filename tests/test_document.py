"""A JSON document read in byte ranges, against a parser that reads it whole."""

import json
import random

import pytest

from sixfold.sources.document import array_elements


def document(seed, n):
    rng = random.Random(seed)
    odd = ["plain", 'quo"te', "back\\slash", "brace } and { [ ]", "\\\\\"}", "новый } узел", "line\nbreak", "", " ", "}{" * 40]
    nested = lambda: {rng.choice("abc"): rng.choice(odd), "deep": [{"x": [1, {"y": rng.choice(odd)}]}, rng.choice(odd)]}
    nodes = [{"id": f"n{i}", "label": rng.choice(odd), "metadata": nested()} for i in range(n)]
    edges = [{"source": f"n{i}", "note": rng.choice(odd)} for i in range(n // 2)]
    return {"saved_at": 'at } "now', "extra": {"nodes": [{"not": "these"}], "z": {}}, "nodes": nodes, "more": [1, "{}", [{"deeper": 1}], {"ok": True}], "none": [], "edges": edges, "last": "}"}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", ["128m", "700", "60"])
def test_ranges(spark, tmp_path, size, indent):
    docs = {f"{k}.json": document(k, 12 if size == "60" else 60) for k in (1, 2)}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=name == "1.json", indent=indent) + "\n" * (name == "2.json"), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for path, them in [(str(tmp_path), docs), (str(tmp_path / "1.json"), {"1.json": docs["1.json"]})]:
            found = array_elements(spark, path)
            rows = sorted(found.collect(), key=lambda r: r.ord)
            for key in ("nodes", "edges"):
                assert [json.loads(r.json) for r in rows if r.key == key] == [x for doc in them.values() for x in doc[key]]
            assert [r.json for r in rows if r.key == "more"] and {r.key for r in rows} == {"nodes", "edges", "more"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_small(spark, tmp_path):
    for text, want in [("{}", []), ('{"nodes": []}', []), ('{"nodes": [{}]}', ["{}"]), ('{"a":[{"b":1},{"b":"}"}]}', ['{"b":1}', '{"b":"}"}'])]:
        path = tmp_path / "x.json"
        path.write_text(text)
        assert [r.json for r in sorted(array_elements(spark, str(path)).collect(), key=lambda r: r.ord)] == want
