"""Joins with a lookup table that has one row a key, safe for keys that very many rows have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Rows of a lookup table that may be broadcast. Beyond, keys above HOT_SHARE of all rows (1 / HOT_SHARE at most) are.
BROADCAST, HOT_SHARE, HOT_LEAST = 100_000, 1 / 2000, 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", few: int = BROADCAST) -> DataFrame:
    """rows joined with table on key; how: inner or left. Rows without a key find nothing."""
    if table.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(table), key, how)
    rows, table = cut(rows), cut(table)
    least = max(HOT_LEAST, int(rows.count() * HOT_SHARE))
    hot = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") >= least) & F.col(key).isNotNull()).select(key))
    near = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key, how)
    return near.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))
