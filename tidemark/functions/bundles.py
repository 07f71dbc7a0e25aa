"""Feature bundles of a window's arrays, as Column expressions by name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import arrays


def acceleration(axes: dict[str, Column], fs: float = 32.0, unit: float = 64.0) -> dict[str, Column]:
    """Eleven features of raw axes x, y, z (64 counts a g): each axis, the magnitude and its movement about its median."""
    g = {k: F.transform(v, lambda x: x / unit) for k, v in axes.items()}
    size = F.transform(F.arrays_zip(g["x"].alias("x"), g["y"].alias("y"), g["z"].alias("z")), lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]))
    of = lambda body: arrays.let(size, body)
    out = {f"{k}_mean": arrays.mean(v) for k, v in g.items()} | {f"{k}_std": arrays.sd(v, 1) for k, v in g.items()}
    return out | {
        "acc_mean": of(arrays.mean), "acc_std": of(lambda m: arrays.sd(m, 1)), "acc_ratio_up": of(lambda m: arrays.mean_slope(m, fs)), "acc_ratio_down": of(lambda m: arrays.mean_slope(m, fs, up=False)),
        "acc_dyn_mean": of(lambda m: arrays.let(arrays.median(m), lambda c: arrays.mean(F.transform(m, lambda v: F.abs(v - c))))),
    }


def heart_rate(hr: Column, fs: float = 1.0) -> dict[str, Column]:
    return {"hr_mean": arrays.mean(hr), "hr_std": arrays.sd(hr, 1), "hr_ratio_up": arrays.mean_slope(hr, fs), "hr_ratio_down": arrays.mean_slope(hr, fs, up=False)}


def temperature(temp: Column, fs: float = 4.0) -> dict[str, Column]:
    """Mean, spread and least-squares slope a second; null below four samples."""
    n = F.size(temp)
    centre = lambda v, m: F.transform(v, lambda x: x - m)
    rise = arrays.let(arrays.mean(temp), lambda m: arrays.total(F.transform(centre(temp, m), lambda d, i: d * (i - (n - 1) / 2.0))))
    enough = n >= 4
    slope = rise / (n * (F.pow(n.cast("double"), F.lit(2)) - 1) / 12.0) * fs
    return {"TEMP_mean": F.when(enough, arrays.mean(temp)), "TEMP_std": F.when(enough, arrays.sd(temp, 1)), "TEMP_slope": F.when(enough, slope)}


def movement(axes: dict[str, Column]) -> dict[str, Column]:
    """Mean, spread and energy of the acceleration's size; null below eight samples."""
    size = F.transform(F.arrays_zip(axes["x"].alias("x"), axes["y"].alias("y"), axes["z"].alias("z")), lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]))
    of = lambda body: arrays.let(size, lambda m: F.when(F.size(m) >= 8, body(m)))
    return {"ACC_magnitude_mean": of(arrays.mean), "ACC_magnitude_std": of(lambda m: arrays.sd(m, 1)), "ACC_energy": of(lambda m: arrays.mean(F.transform(m, lambda v: v * v)))}
