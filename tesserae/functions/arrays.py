"""Array functions as Column expressions that stay near-linear in long arrays and strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 1024  # code points of the pieces that `cut` takes stretches from


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; inside a lambda it would otherwise be computed for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def prefix_sums(numbers: Column) -> Column:
    """Running sums of an array of longs, by doubling: log2(n) passes over it."""

    def add(sums: Column, power: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), power)
        return F.when(step < F.size(sums), F.transform(sums, lambda x, i: x + F.when(i >= step, F.get(sums, i - step)).otherwise(F.lit(0).cast("long")))).otherwise(sums)

    return F.aggregate(F.sequence(F.lit(0), F.lit(29)), numbers, add)


def pieces(t: Column) -> Column:
    """A string in pieces of PIECE code points, for `cut`."""
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, at: Column, n: Column) -> Column:
    """The n code points from `at` (from 0) of a string in pieces; its cost is that of the stretch, wherever it lies."""
    first, last = F.floor(at / PIECE), F.floor((at + n - 1) / PIECE)
    around = F.array_join(F.slice(parts, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
    return F.when(n <= 0, F.lit("")).otherwise(around.substr((at - first * PIECE + 1).cast("int"), n.cast("int")))
