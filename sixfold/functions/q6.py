"""The 6-cube as column expressions: codes 0..63, bit i of a code is (code >> i) & 1."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS, CODES = 6, 64
AXES = ["material", "dynamic", "complex", "ordered", "local", "explicit"]


def codes() -> Column:
    return F.sequence(F.lit(0), F.lit(CODES - 1))


def bits(code: Column) -> Column:
    return F.array(*[F.shiftright(code, i).bitwiseAND(1) for i in range(DIMS)])


def from_bits(bit: Column) -> Column:
    return sum((F.shiftleft(F.get(bit, F.lit(i)), i) for i in range(1, DIMS)), F.get(bit, F.lit(0)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def neighbors(code: Column) -> Column:
    return F.array(*[code.bitwiseXOR(F.lit(1 << i)) for i in range(DIMS)])


def antipode(code: Column) -> Column:
    return code.bitwiseXOR(F.lit(CODES - 1))


@lru_cache
def masks(radius: int) -> tuple[int, ...]:
    """Codes within the radius of 0: a Hamming-radius join becomes an equi-join on code ^ mask."""
    return tuple(m for m in range(CODES) if m.bit_count() <= radius)


def ball(code: Column, radius: int) -> Column:
    """Ascending codes within the radius."""
    return F.array_sort(F.array(*[code.bitwiseXOR(F.lit(m)) for m in masks(radius)]))


def sphere(code: Column, radius: int) -> Column:
    return F.array_sort(F.array(*[code.bitwiseXOR(F.lit(m)) for m in range(CODES) if m.bit_count() == radius]))


def distances(code: Column) -> Column:
    """Steps from the code to each vertex, by vertex."""
    return F.transform(codes(), lambda h: F.bit_count(h.bitwiseXOR(code)).cast("int"))


def interval(a: Column, b: Column) -> Column:
    """Ascending vertices on some shortest way: they agree with both ends wherever the ends agree."""
    return F.filter(codes(), lambda h: h.bitwiseXOR(a).bitwiseAND(F.bitwise_not(a.bitwiseXOR(b))) == 0)


def shortest_path(a: Column, b: Column) -> Column:
    """Flips the differing bits from the highest to the lowest."""
    differing = a.bitwiseXOR(b)
    steps = F.filter(F.sequence(F.lit(DIMS), F.lit(0), F.lit(-1)), lambda i: (i == DIMS) | (F.call_function("getbit", differing, i) == 1))
    # After bit i is flipped, the bits from i up are b's and those below are a's.
    high = lambda i: F.lit(CODES - 1) - (F.call_function("shiftleft", F.lit(1), i) - 1)
    return F.transform(steps, lambda i: a.bitwiseXOR(differing.bitwiseAND(high(i))))


def median(code: Column) -> Column:
    """An aggregate: the bits that more than half of the codes have."""
    return sum(((F.sum(F.shiftright(code, i).bitwiseAND(1)) * 2 > F.count(code)).cast("int") * (1 << i) for i in range(1, DIMS)), (F.sum(code.bitwiseAND(1)) * 2 > F.count(code)).cast("int"))


@lru_cache
def packing(radius: int) -> tuple[int, ...]:
    """Greedy centers: each next code that no ball covers yet."""
    covered: set[int] = set()
    out = []
    for h in range(CODES):
        if h not in covered:
            out.append(h)
            covered |= {h ^ m for m in masks(radius)}
    return tuple(out)


@lru_cache
def voronoi(centers: tuple[int, ...]) -> tuple[int, ...]:
    """The nearest center of every code, the first of equals."""
    return tuple(min(centers, key=lambda c: ((c ^ h).bit_count(), centers.index(c))) for h in range(CODES))


def cell(code: Column, centers: tuple[int, ...]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in voronoi(centers)]), code)


def embed(v: Column) -> Column:
    """The code of a vector: six chunk means (a vector of six or fewer is padded with zeros) against their mean.

    If all six equal their mean, against one half. A null vector has no code.
    """
    n = F.size(v)

    def at(d: Column) -> Column:
        return F.floor(d * n / F.lit(DIMS)).cast("int")

    chunk = F.transform(
        F.sequence(F.lit(0), F.lit(DIMS - 1)),
        lambda d: F.aggregate(F.slice(v, at(d) + 1, at(d + 1) - at(d)), F.lit(0.0), lambda a, x: a + x) / (at(d + 1) - at(d)),
    )
    six = F.when(n <= DIMS, F.slice(F.concat(v, F.array_repeat(F.lit(0.0), DIMS)), 1, DIMS)).otherwise(chunk)

    def code(p: Column) -> Column:
        mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.lit(float(DIMS))

        def against(mu: Column) -> Column:
            edge = F.when(F.forall(p, lambda x: F.abs(x - mu) < 1e-10), F.lit(0.5)).otherwise(mu)
            return F.aggregate(F.transform(p, lambda x, i: F.when(x > edge, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda a, x: a + x)

        return F.transform(F.array(mean), against)[0]

    return F.when(v.isNotNull(), F.transform(F.array(six), code)[0])
