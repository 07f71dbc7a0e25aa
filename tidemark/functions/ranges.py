"""Ranges of about equal numbers of rows, for ranks over a whole table without one task that orders it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES, STEP = 256, 16


def bounds(df: DataFrame, col: str, ranges: int = RANGES) -> list[float]:
    """Ascending distinct values that part the column into at most `ranges` ranges: its approximate quantiles."""
    got = df.agg(F.percentile_approx(F.col(col).cast("double"), [k / ranges for k in range(1, ranges)], 10_000)).first()[0]
    return sorted(set(got or []))


def range_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value: first among every STEP-th one, then within that step. An outlier moves no cut."""
    if not cuts:
        return F.lit(0)
    below = lambda some: F.size(F.filter(some, lambda c: c < value))
    listed = lambda some: F.expr(f"array({', '.join(f'{float(c)!r}D' for c in some)})")
    coarse = cuts[STEP - 1 :: STEP]
    steps = below(listed(coarse)) if coarse else F.lit(0)
    return F.get(F.transform(F.array(steps), lambda n: n * STEP + below(F.slice(listed(cuts), n * STEP + 1, F.lit(STEP)))), F.lit(0))


def narrow(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df`, marked for broadcast if a count proves that it has at most `rows` narrow rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
