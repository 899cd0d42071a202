"""Fingerprints that tell whether two groups hold the same values, each as often, without bringing them together.

A fingerprint is the number of rows and four sums of 24 bits of two 64-bit hashes of the
value.  Sums don't depend on the order, tasks add them up before the shuffle, and those
of a union or a difference are sums and differences.  Equal multisets have equal ones.
Unequal ones, not made to collide, have equal ones with a chance of about 2^-96, so of
10^12 comparisons one is wrong with a chance of 10^-17.  The sums are exact longs up to
2^39 rows in a group; beyond, Spark raises an overflow error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECES = ("s0", "s1", "s2", "s3")


def multiset_print(column: str, *, salt: int = 7) -> list[Column]:
    """Aggregates n (rows), known (rows that aren't null) and PIECES of the values of ``column``, compared as strings."""
    value = F.col(column).cast("string")
    first, second = F.xxhash64(value), F.xxhash64(F.lit(salt), value)
    low = lambda h, at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 24) - 1))
    pieces = (low(first, 0), low(first, 24), low(second, 0), low(second, 24))
    return [F.count("*").alias("n"), F.count(column).alias("known"), *(F.sum(p).alias(name) for name, p in zip(PIECES, pieces))]
