"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(value)` with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median(values: Column) -> Column:
    """Middle of the values, mean of the middle two; null for none. NULL items are ignored."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)

    return let(F.array_sort(F.filter(values, lambda v: v.isNotNull())), middle)


def quantile(values: Column, q: float) -> Column:
    """Quantile with linear interpolation; null for no values."""

    def at(s: Column) -> Column:
        h = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(h).cast("int")
        a = F.get(s, lo)
        return F.when(F.size(s) > 0, a + (h - lo) * (F.coalesce(F.get(s, lo + 1), a) - a))

    return let(F.array_sort(F.filter(values, lambda v: v.isNotNull())), at)


def mad(values: Column, center: Column) -> Column:
    """Median distance from the center (not scaled)."""
    return median(F.transform(values, lambda v: F.abs(v - center)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def diffs(values: Column) -> Column:
    """Differences of neighbours; empty below two values."""
    n = F.size(values)
    later = F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0)))
    earlier = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return F.when(n > 1, F.zip_with(later, earlier, lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def sd(values: Column, ddof: int) -> Column:
    """Standard deviation; null below ddof + 1 values."""

    def of(m: Column) -> Column:
        return F.when(F.size(values) > ddof, F.sqrt(total(F.transform(values, lambda v: (v - m) * (v - m))) / (F.size(values) - ddof)))

    return let(mean(values), of)


def mean_slope(values: Column, fs: float = 1.0, up: bool = True) -> Column:
    """Mean of the rising (or falling) steps per second; 0 without one, null below two values."""

    def of(d: Column) -> Column:
        steps = F.filter(d, lambda v: v > 0 if up else v < 0)
        return F.when(F.size(d) > 0, F.coalesce(mean(steps) * F.lit(float(fs)), F.lit(0.0)))

    return let(diffs(values), of)


def rmssd(values: Column) -> Column:
    """Root of the mean squared successive difference; null below two values."""
    return let(diffs(values), lambda d: F.when(F.size(d) > 0, F.sqrt(total(F.transform(d, lambda v: v * v)) / F.size(d))))


def share_above(values: Column, limit: float) -> Column:
    """Percentage of successive differences above the limit in size; null below two values."""
    return let(diffs(values), lambda d: F.when(F.size(d) > 0, F.size(F.filter(d, lambda v: F.abs(v) > limit)) * 100.0 / F.size(d)))


def clean_intervals(values: Column, policy: str = "median", tolerance: float = 0.3, low: float = 0.3, high: float = 2.0) -> Column:
    """Heart-beat intervals within [low, high] that pass a policy.

    `median`: within the tolerance of the median of those in range; `previous`: within it of the last one accepted;
    `neighbour`: within 30 % of the median, and within the tolerance of the median of up to two such on either side.
    """
    ranged = F.filter(values, lambda v: v.between(low, high))
    if policy == "median":
        return let(ranged, lambda r: let(median(r), lambda m: F.filter(r, lambda v: F.abs(v - m) <= tolerance * m)))
    if policy == "previous":
        start = F.array().cast("array<double>")

        def keep(acc: Column, v: Column) -> Column:
            last = F.element_at(acc, -1)
            return F.when((F.size(acc) == 0) | (F.abs(v - F.when(F.size(acc) > 0, last)) <= tolerance * F.when(F.size(acc) > 0, last)), F.concat(acc, F.array(v))).otherwise(acc)

        return F.aggregate(ranged, start, keep)
    if policy == "neighbour":

        def near(r: Column) -> Column:
            """r: the intervals in place, null where they are out of range or 30 % from the median."""

            def ok(v: Column, i: Column) -> Column:
                others = F.filter(F.array(*[F.when(i + k >= 0, F.get(r, i + k)) for k in (-2, -1, 1, 2)]), lambda o: o.isNotNull())
                return let(others, lambda o: F.when((F.size(o) < 2) | (F.abs(v - median(o)) <= tolerance * median(o)), v))

            return F.filter(F.transform(r, ok), lambda v: v.isNotNull())

        def marked(r: Column) -> Column:
            return let(median(r), lambda m: F.transform(values, lambda v: F.when(v.between(low, high) & (F.abs(v - m) <= 0.3 * m), v)))

        return let(let(ranged, marked), near)
    raise ValueError(policy)


def stress_index(intervals: Column, width: float = 0.05, floor: float = 0.05, min_n: int = 10) -> Column:
    """Baevsky's index: share of the modal bin over twice the mode and the range; the lowest bin wins a tie. Null below min_n."""

    def of(v: Column) -> Column:
        bins = F.transform(v, lambda x: F.floor(x / width))
        counts = F.transform(F.array_distinct(bins), lambda b: F.struct(F.size(F.filter(bins, lambda y: y == b)).alias("n"), (-b).alias("b")))
        top = F.array_max(counts)
        mode = (-top["b"] + 0.5) * width
        spread = F.greatest(F.array_max(v) - F.array_min(v), F.lit(floor))
        return F.when(F.size(v) >= min_n, 100.0 * top["n"] / F.size(v) / (2 * mode * spread))

    return let(intervals, of)
