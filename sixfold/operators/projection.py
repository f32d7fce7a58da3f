"""Two principal axes of every group of vectors, by power iteration.

Up to WIDE dimensions a group's second moments are gathered in one pass, and the iteration runs on them. Wider vectors go
without the matrix: a round multiplies every vector with its group's axis, and adds up the vectors times these products, so a
task gives one vector for each group, and each of the rounds is a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

#: Fixed value: rounds of the power iteration.
STEPS = 20
#: The widest vectors whose second moments (half a megabyte for a group, then) are gathered.
WIDE = 256
#: Groups whose axes are looked for at once, and parts in which tasks' vectors are added up before they meet.
GROUPS, PARTS = 64, 32


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per group of a task: count, sum, sum of outer products, and the first vector by id."""
    held: dict = {}
    for b in batches:
        for group, part in b.groupby("community"):
            x = np.stack(part["embedding"].to_numpy())
            first = int(part["id"].idxmin())
            n, s, c, low, v = held.get(group, (0, 0.0, 0.0, None, None))
            if low is None or part["id"][first] < low:
                low, v = int(part["id"][first]), part["embedding"][first]
            held[group] = (n + len(x), s + x.sum(axis=0), c + x.T @ x, low, v)
    rows = [(int(g), n, s.tolist(), c.ravel().tolist(), low, list(v)) for g, (n, s, c, low, v) in held.items()]
    yield pd.DataFrame(rows, columns=["community", "n", "s", "c", "low", "v"])


def _axes(rows: pd.DataFrame) -> pd.DataFrame:
    """One group's partial moments (one row per task) to its mean and two axes."""
    n, s = int(rows["n"].sum()), np.sum(np.stack(rows["s"]), axis=0)
    d = len(s)
    mean = s / n
    c = np.sum(np.stack(rows["c"]), axis=0).reshape(d, d) - n * np.outer(mean, mean)
    v = np.array(rows["v"][rows["low"].idxmin()]) - mean

    def power(m: np.ndarray, start: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(start)
        w = start / size if size > 1e-10 else np.eye(d)[0]
        for _ in range(STEPS):
            w = m @ w
            w = w / (np.linalg.norm(w) or 1.0)
        return w

    first = power(c, v)
    left = np.eye(d) - np.outer(first, first)
    rest = left @ c @ left
    second = power(rest, left @ v) if np.trace(rest) > 1e-10 else np.zeros(d)
    return pd.DataFrame([(int(rows["community"].iloc[0]), mean.tolist(), first.tolist(), second.tolist())], columns=["community", "mean", "first", "second"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows of one group as one: counts and vectors added, of first vectors the one of the least id."""
    low = int(rows["low"].to_numpy().argmin())
    total = np.sum(np.stack(rows["s"]), axis=0)
    return pd.DataFrame([(int(rows["community"].iloc[0]), int(rows["part"].iloc[0]), int(rows["n"].sum()), total.tolist(), int(rows["low"].iloc[low]), list(rows["v"].iloc[low]))], columns=["community", "part", "n", "s", "low", "v"])


SUM = "community int, part int, n long, s array<double>, low long, v array<double>"


def _gathered(of: DataFrame, width: int, known, axis: int) -> dict:
    """community: (n, sum, first vector), by passes of tasks that each give one vector a group.

    axis -1: the sum of the vectors; 0 and 1: the sum of centered vectors times their products with the axis, for 1 of what
    the first axis leaves of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        state = known.value
        for b in batches:
            for group, part in b.groupby("community"):
                x = np.zeros((len(part), width))
                for i, v in enumerate(part["embedding"]):
                    x[i, : len(v)] = v
                n, total, low, v = held.get(group, (0, 0.0, None, None))
                if axis < 0:
                    first = int(part["id"].to_numpy().argmin())
                    if low is None or part["id"].iloc[first] < low:
                        low, v = int(part["id"].iloc[first]), x[first]
                    found = x.sum(axis=0)
                else:
                    mean, *axes = state[group]
                    x = x - mean
                    if axis == 1:
                        x = x - np.outer(x @ axes[0], axes[0])
                    found = (x @ axes[axis]) @ x
                held[group] = (n + len(x), total + found, low, v)
        spread = TaskContext.get().partitionId() % PARTS
        rows = [(int(g), spread, n, s.tolist(), low or 0, [] if v is None else v.tolist()) for g, (n, s, low, v) in held.items()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUM.split(", ")])

    sums = of.mapInPandas(run, SUM).groupBy("community", "part").applyInPandas(_summed, SUM).groupBy("community").applyInPandas(_summed, SUM)
    return {r.community: (r.n, np.array(r.s), np.array(r.v)) for r in sums.collect()}


def _unit(v: np.ndarray, start: bool = False) -> np.ndarray:
    size = np.linalg.norm(v)
    if start and size <= 1e-10:
        return np.eye(len(v))[0]
    return v / (size or 1.0)


def wide_axes(of: DataFrame, width: int) -> DataFrame:
    """community, mean, first, second of vectors (id, community, embedding) without their moments.

    The driver holds three vectors for each of the GROUPS that it looks at at once, and tells them to the tasks each round.
    """
    sc, schema = of.sparkSession.sparkContext, "community int, mean array<double>, first array<double>, second array<double>"
    every = sorted(r.community for r in of.select("community").distinct().collect())  # a map has 64 at most
    found: list[tuple] = []

    def told(state: dict, axis: int, its: DataFrame) -> dict:
        known = sc.broadcast(state)
        out = _gathered(its, width, known, axis)
        known.destroy()
        return out

    for lo in range(0, len(every), GROUPS):
        its = of.where(F.col("community").isin(every[lo : lo + GROUPS]))
        start = told({}, -1, its)
        mean = {g: s / n for g, (n, s, _) in start.items()}
        first = {g: _unit(v - mean[g], True) for g, (_, _, v) in start.items()}
        for _ in range(STEPS):
            first = {g: _unit(s) for g, (_, s, _) in told({g: (mean[g], first[g]) for g in mean}, 0, its).items()}
        off = {g: (v - mean[g]) - ((v - mean[g]) @ first[g]) * first[g] for g, (_, _, v) in start.items()}
        second = {g: _unit(v, True) for g, v in off.items()}
        for _ in range(STEPS):
            second = {g: _unit(s) for g, (_, s, _) in told({g: (mean[g], first[g], second[g]) for g in mean}, 1, its).items()}
        found += [(g, mean[g].tolist(), first[g].tolist(), second[g].tolist()) for g in mean]
    return of.sparkSession.createDataFrame(found, schema)


def plane(nodes: DataFrame, member: DataFrame, wide: int = WIDE) -> DataFrame:
    """id, community, x, y: each node on the two axes of its community. What is shuffled is sums, not vectors.

    Vectors of unequal length count as continued by zeros where the longest has more than `wide` dimensions.
    """
    of = nodes.select("id", "embedding").join(member.select(F.col("node_id").alias("id"), "community"), "id")
    width = nodes.agg(F.max(F.size("embedding")).alias("d")).first().d or 0
    if width > wide:
        of = cut(of)
        axes = wide_axes(of, width)
    else:
        moments = of.mapInPandas(_moments, "community int, n long, s array<double>, c array<double>, low long, v array<double>")
        axes = moments.groupBy("community").applyInPandas(_axes, "community int, mean array<double>, first array<double>, second array<double>")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    along = lambda axis: F.aggregate(F.zip_with(F.zip_with("embedding", "mean", lambda x, m: zero(x) - m), axis, lambda x, a: x * a), F.lit(0.0), lambda a, x: a + x)
    return of.join(axes, "community").select("id", "community", along("first").alias("x"), along("second").alias("y"))
