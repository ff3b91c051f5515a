"""Where a value falls among sorted boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place_in(bounds: list, value: Column) -> Column:
    """How many of the sorted boundaries lie at or below the value: 0 .. len(bounds); null counts as below all.

    A binary search: a step for each doubling of their number, whatever the number."""
    if not bounds:
        return F.lit(0)
    held, n = F.array(*map(F.lit, bounds)), len(bounds)
    steps = F.array(*(F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)))
    at = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(held, at + s - 1) <= value), at + s).otherwise(at))
    return F.coalesce(at, F.lit(0))
