"""Vector functions as Column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; vectors of different length give 0, null gives null."""
    pairs = F.zip_with(a, b, lambda x, y: x * y)
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


def is_valid(v: Column) -> Column:
    """Non-null, non-empty, and every entry a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)
