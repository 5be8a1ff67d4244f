"""Vector kernels as Column expressions, in double precision."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    """Sum of an array of doubles, in order."""
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """a over its norm; null for the zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)


def checked(c: Column, dim: int) -> Column:
    """The vector, or an error for a row whose vector hasn't `dim` components or holds null or NaN."""
    bad = c.isNull() | (F.size(c) != dim) | F.exists(c, lambda x: x.isNull() | F.isnan(x))
    return F.when(bad, F.raise_error(F.lit(f"vector must have {dim} finite components"))).otherwise(c)


def default_partitions(n: Column) -> Column:
    """Number of partitions for n vectors: the square root, from 4 to 65536."""
    return F.greatest(F.lit(4), F.least(F.lit(65536), F.floor(F.sqrt(n.cast("double"))))).cast("long")
