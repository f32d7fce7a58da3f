"""Numbers that round to zero keep their sign, as they do in the SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from sixfold.functions import vectors
from sixfold.plans import ORACLES, QUERIES

from .conftest import rounded

TINY = [-1e-7, 1e-7, -0.0, 0.0, -4.9e-7, -5.1e-7, -2e-7, 3e-7]


def test_rounded(spark):
    values = [*TINY, 5e-7, -5e-7, 0.0078125, -0.0078125, 1.5, math.inf, -math.inf, math.nan, None]
    want = [-0.0, 0.0, -0.0, 0.0, -0.0, -1e-6, -0.0, 0.0, 1e-6, -1e-6, 0.007813, -0.007813, 1.5, math.inf, -math.inf, math.nan, None]
    got = spark.createDataFrame([(values,)], "v array<double>").select(F.transform("v", vectors.rounded)).first()[0]
    assert list(map(repr, got)) == list(map(repr, want))


@pytest.mark.parametrize("name", ["node_signature", "octagram_signature", "vec_normalize"])
def test_signs(spark, tmp_path, name):
    """Vectors of 64 numbers, some of which are too small for six decimals."""
    rows = [(i, [TINY[(i + k) % 8] if k % 3 == 0 else math.sin(7 * i + k) / 8 for k in range(64)], i % 10) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.sql(ORACLES[name])
    rows = [tuple(rounded(x) for x in r) for r in want.select(*df.columns).fetchall()]
    assert "-0.0" in repr(rows)
    assert sorted(tuple(rounded(x) for x in r) for r in df.collect()) == sorted(rows)
