"""Scalar scores and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import arrays


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def stress_score(index: Column) -> Column:
    """0 to 100 on a log scale from an index of 50 to one of 1000."""
    x = (F.ln(index) - F.ln(F.lit(50.0))) / (F.ln(F.lit(1000.0)) - F.ln(F.lit(50.0)))
    return 100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def stress_zone(score: Column) -> Column:
    return F.when(score < 30, "low").when(score < 60, "normal").when(score < 80, "high").when(score.isNotNull(), "very_high")


def bmi_zone(bmi: Column) -> Column:
    return F.when(bmi < 18.5, "under").when(bmi < 23, "normal").when(bmi < 25, "over").when(bmi.isNotNull(), "obese")


def cut_right_closed(x: Column, edges: list[float]) -> Column:
    """Number of the interval (a, b] that holds x, from 0; null outside."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(edges) - 1)):
        out = F.when((x > edges[k]) & (x <= edges[k + 1]), k).otherwise(out)
    return out


def weighted_present(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the non-null parts, weights renormalised; null if none is present."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        top = top + F.coalesce(value * weight, F.lit(0.0))
        bottom = bottom + F.when(value.isNotNull(), weight).otherwise(0.0)
    return top / F.nullif(bottom, F.lit(0.0))


def band_score(x: Column, low: float, high: float, slope: float) -> Column:
    """100 within the band, less `slope` for each unit outside, not below 0."""
    outside = F.greatest(low - x, x - high, F.lit(0.0))
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), 100 - slope * outside))


def life_score(sleep_hours: Column, caffeine: Column, mood: Column) -> Column:
    """Mean of the parts present: sleep within 7 to 9 hours, cups beyond the first, mood of 1 to 5."""
    cups = F.when(caffeine.isNotNull(), F.greatest(F.lit(0.0), 100 - 20 * F.greatest(F.lit(0.0), caffeine - 1)))
    return weighted_present([(band_score(sleep_hours, 7, 9, 15), 1.0), (cups, 1.0), (mood * 20.0, 1.0)])


def health_score(stress: Column, hrv: Column, hr: Column, life: Column) -> Column:
    return weighted_present([(100 - stress, 0.35), (hrv, 0.20), (hr, 0.15), (life, 0.30)])


def risk_probability(night_z: Column, z3: Column, dev3: Column, coefficients=(0.1179, 0.2500, 0.2070), intercept: float = -0.2371) -> Column:
    """A stored logistic model over a night's z (clipped to [-5, 10]), its 3-row mean and the deviating rows of 3."""
    z = F.greatest(F.lit(-5.0), F.least(F.lit(10.0), night_z))
    return sigmoid(z * coefficients[0] + z3 * coefficients[1] + dev3 * coefficients[2] + intercept)


def risk_level(p: Column, cuts=(0.6222, 0.7343, 0.7647)) -> Column:
    return F.when(p >= cuts[2], 3).when(p >= cuts[1], 2).when(p >= cuts[0], 1).when(p.isNotNull(), 0)


def lab(red: Column, green: Column, blue: Column) -> list[Column]:
    """sRGB of 0 to 255 to CIE L*, a*, b* under D65."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)

    # fixed values: the sRGB matrix and the D65 white point
    r, g, b = linear(red), linear(green), linear(blue)
    x = f((0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.95047)
    y = f(0.2126 * r + 0.7152 * g + 0.0722 * b)
    z = f((0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.08883)
    return [116 * y - 16, 500 * (x - y), 200 * (y - z)]


def complexion(forehead: Column, cheeks: Column) -> dict[str, Column]:
    """Mean colours of both regions by frame -> a_rel (redness of the cheeks less the forehead's), a_cheek, s_rel (saturation)
    and rg_rel (red over green), medians over the frames in which all six numbers are known; NULL without one."""
    known = lambda c: F.coalesce((F.size(c) == 3) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    frames = F.filter(F.arrays_zip(forehead.alias("f"), cheeks.alias("c")), lambda p: known(p["f"]) & known(p["c"]))
    redness = lambda c: lab(c[0], c[1], c[2])[1]
    top = lambda c: F.array_max(c)
    saturation = lambda c: F.when(top(c) > 0, (top(c) - F.array_min(c)) / top(c)).otherwise(0.0)
    middle = lambda of: arrays.median(F.transform(frames, of))
    return {
        "a_rel": middle(lambda p: redness(p["c"]) - redness(p["f"])), "a_cheek": middle(lambda p: redness(p["c"])),
        "s_rel": middle(lambda p: saturation(p["c"]) - saturation(p["f"])), "rg_rel": middle(lambda p: p["c"][0] / p["c"][1] - p["f"][0] / p["f"][1]),
    }
