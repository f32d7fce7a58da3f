import math
import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rounded(v):
    if isinstance(v, float):
        if v == 0 and math.copysign(1, v) < 0:
            return "-0.0"  # differs from zero where values are hashed
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(rounded(x) for x in v)
    return v


@pytest.fixture(scope="session")
def same(duck):
    """Compares a DataFrame with the rows of SQL, whatever their order."""

    def compare(df, sql):
        o = duck.sql(sql)
        columns = sorted(df.columns)
        assert sorted(o.columns) == columns
        at = [o.columns.index(c) for c in columns]
        key = lambda t: tuple(map(repr, t))
        a = sorted((tuple(rounded(r[c]) for c in columns) for r in df.collect()), key=key)
        b = sorted((tuple(rounded(r[i]) for i in at) for r in o.fetchall()), key=key)
        assert a == b

    return compare
