"""Distances between binary hypervectors in arrays of longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_apart(a, b, words: int | None = None) -> Column:
    """Bits that differ. Where the number of ``words`` is told, it is an expression that Spark compiles; higher-order functions are interpreted."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    if words is not None:
        # plain sums, so that no pair goes through a lambda
        found = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(words)]
        return sum(found[1:], found[0])
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def distance(a, b, words: int | None = None) -> Column:
    """Bits that differ, as a share of all."""
    a = F.col(a) if isinstance(a, str) else a
    return bits_apart(a, b, words) / (64.0 * (F.size(a) if words is None else F.lit(words)))
