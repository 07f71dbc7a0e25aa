"""The feature bundle of a wearable's windows: signals of different starts and rates laid on one window grid.

A session's signals come as one row each (sources.text.read_signals); its windows as rows too. Both cross one shuffle on the
session's keys, each array once whatever the number of windows over it, and are sorted there, a session's signals before its
windows. A task reads them in Arrow batches and holds one batch and the signals of the session it ends in. A window's slice of
a signal starts at the first sample not before the window and ends before the last that would reach beyond it, by that
signal's own start and rate; slices of one length and rate, of whatever sessions of the batch, meet a kernel together.

A signal that a session lacks, or has no sample of in a window, leaves its features NULL; of several pieces of one signal the one
with most samples in the window counts. Sessions without windows and windows without a session give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.functions import bundles
from tidemark.operators import signals

HEART_RATE = ("hr_mean", "hr_std", "hr_ratio_up", "hr_ratio_down")
PULSE = ("bvp_mean", "bvp_std")
INTERVALS = ("ibi_mean", "ibi_max", "ibi_min", "hr_from_ibi", "rmssd", "sdnn", "pnn20", "pnn50")
SPECTRUM = (*[f"{b}_{what}" for b in signals.BANDS for what in ("power", "peak")], "total_power", "LF_n", "HF_n", "LF_HF_ratio")
SKIN = (
    "mean_raw_eda", "std_raw_eda", "mean_tonic_eda", "std_tonic_eda", "mean_phasic_eda", "std_phasic_eda", "tonic_ratio_up", "tonic_ratio_down",
    "peaks_density", "mean_amplitude", "mean_onset_sample", "mean_peak_sample", "mean_risetime", "mean_recoverytime",
)
MOVEMENT = ("x_mean", "y_mean", "z_mean", "x_std", "y_std", "z_std", "acc_mean", "acc_std", "acc_ratio_up", "acc_ratio_down", "acc_dyn_mean")
FEATURES = (*PULSE, *HEART_RATE, *INTERVALS, *SPECTRUM, "n_beats", *SKIN, *MOVEMENT)
#: Fixed value: acceleration counts in one g.
COUNTS = 64.0


#: Fixed value: numbers that a kernel sees at a time (one window may hold more).
MOST = 1 << 19


def _every(x: np.ndarray, **figures: np.ndarray) -> signals.Told:
    """Figures that are told of every row of x."""
    return {name: (np.arange(len(x)), v) for name, v in figures.items()}


def _level(x: np.ndarray, mean: str, std: str) -> signals.Told:
    return _every(x, **{mean: x.mean(-1)} | ({std: x.std(-1, ddof=1)} if x.shape[-1] > 1 else {}))


def _slopes(x: np.ndarray, fs: float, up: str, down: str) -> signals.Told:
    """Mean rise and mean fall a second of each row; 0 where nothing rises or falls."""
    if x.shape[-1] < 2:
        return {}
    d = np.diff(x) * fs
    return _every(x, **{name: _means(np.where(part, d, 0).sum(-1), part.sum(-1)) for name, part in ((up, d > 0), (down, d < 0))})


def _means(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(total, n, out=np.zeros(len(n)), where=n > 0)


def pulse_features(x: np.ndarray, fs: float) -> dict:
    """Features of one window's pulse."""
    return signals.one_row(pulse_of_rows(x[None], fs))


def pulse_of_rows(x: np.ndarray, fs: float) -> signals.Told:
    row, at = signals.pulse_peaks_of_rows(signals.zero_phase(x, fs, 0.5, 10.0, 4), fs)
    row, ibi, t = signals.near_intervals_of_rows(row, at / fs)
    count = np.bincount(row, minlength=len(x))
    out = _level(x, "bvp_mean", "bvp_std") | _every(x, n_beats=count.astype(float))
    told = np.nonzero(count > 1)[0]
    if len(told):
        sums = lambda r, v: np.bincount(r, v, len(x))[told]
        n, some = count[told], count > 0
        ends = (np.cumsum(count) - count)[some]
        mean, inner = sums(row, ibi) / n, row[1:] == row[:-1]
        of, steps = row[1:][inner], np.diff(ibi)[inner] * 1000
        whole = np.zeros(len(x))
        whole[told] = mean
        figures = (
            mean, *[f.reduceat(ibi, ends)[count[some] > 1] for f in (np.maximum, np.minimum)], 60 / mean, np.sqrt(sums(of, steps**2) / (n - 1)),
            np.sqrt(sums(row, (ibi - whole[row]) ** 2) / (n - 1)) * 1000, *[sums(of, np.abs(steps) > ms) / (n - 1) * 100 for ms in (20, 50)],
        )
        out |= {name: (told, v) for name, v in zip(INTERVALS, figures, strict=True)}
    return out | signals.bands_of_rows(row, ibi, t)


def skin_of_rows(x: np.ndarray, fs: float) -> signals.Told:
    clean = signals.zero_phase(x, fs, None, 1.0, 4)
    tonic = signals.zero_phase(clean, fs, None, 0.05, 2)
    row, found = signals.responses_of_rows(clean - tonic, fs)
    count = np.bincount(row, minlength=len(x))
    of_found = {"mean_amplitude": "amplitude", "mean_onset_sample": "onset", "mean_peak_sample": "peak", "mean_risetime": "rise", "mean_recoverytime": "recovery"}
    out = _slopes(tonic, fs, "tonic_ratio_up", "tonic_ratio_down")
    for name, part in (("raw", clean), ("tonic", tonic), ("phasic", clean - tonic)):
        out |= _level(part, f"mean_{name}_eda", f"std_{name}_eda")
    return out | _every(x, peaks_density=60 * count * fs / x.shape[1], **{name: _means(np.bincount(row, found[k], len(x)), count) for name, k in of_found.items()})


def heart_rate_of_rows(x: np.ndarray, fs: float) -> signals.Told:
    return _level(x, "hr_mean", "hr_std") | _slopes(x, fs, "hr_ratio_up", "hr_ratio_down")


def movement_of_rows(x: np.ndarray, fs: float) -> signals.Told:
    g = np.ascontiguousarray(np.moveaxis(x, -1, 0)) / COUNTS
    size = np.sqrt((g**2).sum(0))
    out = _level(size, "acc_mean", "acc_std") | _slopes(size, fs, "acc_ratio_up", "acc_ratio_down") | _every(size, acc_dyn_mean=np.abs(size - np.median(size, -1, keepdims=True)).mean(-1))
    for axis, v in zip("xyz", g, strict=True):
        out |= _level(v, f"{axis}_mean", f"{axis}_std")
    return out


#: signal -> (the features of many windows of one length, numbers in a sample, their names)
KINDS = {
    "BVP": (pulse_of_rows, 1, (*PULSE, *INTERVALS, *SPECTRUM, "n_beats")), "EDA": (skin_of_rows, 1, SKIN), "HR": (heart_rate_of_rows, 1, HEART_RATE), "ACC": (movement_of_rows, 3, MOVEMENT),
}


#: The first phase's slowest and fastest pulse (a minute), usable intervals for a good window, and the largest step
#: from the interval kept before.
PULSE_RANGE, GOOD_INTERVALS, LARGEST_STEP = (40.0, 180.0), 20, 0.20
FIRST_PHASE = "HR_mean double, HR_std double, HR_min double, HR_max double, RMSSD double, SDNN double, mean_IBI double, n_ibi bigint, bvp_quality int, EDA_mean double, EDA_std double, SCL_mean double, SCR_count bigint, SCR_mean_amplitude double"


def steady_intervals(ms: np.ndarray) -> np.ndarray:
    """Intervals without those that differ from the last one kept by more than LARGEST_STEP; fewer than three stay as they are."""
    if len(ms) < 3:
        return ms
    kept = [0]
    for k in range(1, len(ms)):
        if abs(ms[k] - ms[kept[-1]]) <= LARGEST_STEP * ms[kept[-1]]:
            kept.append(k)
    return ms[kept]


def first_pulse(x: np.ndarray, fs: float) -> dict:
    """Heart rate and its variation from a pulse of ten seconds or more; `bvp_quality` is 1 from GOOD_INTERVALS intervals on."""
    none = {"n_ibi": 0, "bvp_quality": 0}
    if len(x) < 10 * fs:
        return none
    y = signals.zero_phase(x, fs, 0.5, 8.0, 2)
    peaks = signals.find_peaks(y, int(fs * 60 / PULSE_RANGE[1]), max(0.4 * float(y.std()), 1e-6))
    ms = np.diff(peaks) / fs * 1000
    ms = steady_intervals(ms[(ms >= 60_000 / PULSE_RANGE[1]) & (ms <= 60_000 / PULSE_RANGE[0])])
    if len(peaks) < 3 or len(ms) < 3:
        return none
    hr = 60_000 / ms
    return {
        "HR_mean": float(hr.mean()), "HR_std": float(hr.std(ddof=1)), "HR_min": float(hr.min()), "HR_max": float(hr.max()), "RMSSD": float(np.sqrt((np.diff(ms) ** 2).mean())), "SDNN": float(ms.std(ddof=1)),
        "mean_IBI": float(ms.mean()), "n_ibi": len(ms), "bvp_quality": int(len(ms) >= GOOD_INTERVALS),
    }


def first_skin(x: np.ndarray, fs: float) -> dict:
    """Skin conductance of five seconds or more: level, and responses as peaks of half a deviation (0.02 at least), a second apart."""
    if len(x) < 5 * fs:
        return {}
    clean = signals.zero_phase(x, fs, None, 1.0, 2)
    level = signals.zero_phase(clean, fs, None, 0.05, 2)
    fast = clean - level
    peaks = signals.find_peaks(fast, max(int(fs), 1), height=max(0.5 * float(fast.std()), 0.02))
    return {"EDA_mean": float(clean.mean()), "EDA_std": float(clean.std(ddof=1)), "SCL_mean": float(level.mean()), "SCR_count": len(peaks), "SCR_mean_amplitude": float(fast[peaks].mean()) if len(peaks) else 0.0}


def first_phase_features(df: DataFrame, keys: list[str], bvp: str, eda: str, temp: str, axes: dict[str, str], fs_bvp: float = 64.0, fs_eda: float = 4.0, fs_temp: float = 4.0) -> DataFrame:
    """Windows as arrays -> keys, FIRST_PHASE, TEMP_mean, TEMP_std, TEMP_slope, ACC_magnitude_mean, ACC_magnitude_std, ACC_energy.

    What is arithmetic over arrays is Column expressions; pulse and skin are kernels over one row's samples. No shuffle.
    """
    plain = bundles.temperature(F.col(temp), fs_temp) | bundles.movement({k: F.col(c) for k, c in axes.items()})
    kernel = lambda x, y: first_pulse(x, fs_bvp) | first_skin(y, fs_eda)
    return signals.per_row(df.withColumns(plain), [*keys, *plain], [bvp, eda], kernel, FIRST_PHASE)


def sliced(t0: float, fs: float, x: np.ndarray, start: float, end: float) -> np.ndarray:
    first = max(0, int(np.ceil((start - t0) * fs)))
    return x[first : max(first, min(len(x), int(np.floor((end - t0) * fs))))]


#: A session's signals by name: start, rate and samples of each piece.
Pieces = dict[str, list[tuple[float, float, np.ndarray]]]


def features_of(windows: list[tuple[Pieces, float | None, float | None]], features: tuple[str, ...] = FEATURES) -> list[pa.Array]:
    """Windows, each with its session's signals, its start and its end -> their `features`; what cannot be told is null."""
    values, told = {c: np.zeros(len(windows)) for c in FEATURES}, {c: np.zeros(len(windows), bool) for c in FEATURES}
    for name, (kernel, *_) in KINDS.items():
        alike: dict[tuple[float, int], list[tuple[int, np.ndarray]]] = {}
        for k, (pieces, start, end) in enumerate(windows):
            if start is not None and end is not None and name in pieces:
                x, fs = max(((sliced(t0, fs, x, start, end), fs) for t0, fs, x in pieces[name]), key=lambda p: len(p[0]))
                if len(x):
                    alike.setdefault((fs, len(x)), []).append((k, x))
        for (fs, _), given in alike.items():
            some = max(1, MOST // given[0][1].size)
            for part in (given[k : k + some] for k in range(0, len(given), some)):
                places = np.array([k for k, _ in part])
                for c, (rows, v) in kernel(np.stack([x for _, x in part]), fs).items():
                    values[c][places[rows]], told[c][places[rows]] = v, True
    return [pa.array(values[c], mask=~told[c]) for c in features]


def window_features(recordings: DataFrame, windows: DataFrame, keys: list[str], start: str = "start", end: str = "end", features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Signals (keys, name, t0, fs, values) and windows (keys, start, end, ...) -> windows' columns, `features`.

    `values` holds samples as arrays of numbers, or all numbers of all samples in one array, which is cheaper to make and to move.
    Samples of signals that tell none of `features` cross no shuffle and meet no kernel; such a signal still makes its session one with a recording.
    """
    asked = [name for name, (*_, told) in KINDS.items() if set(told) & set(features)]
    kind = recordings.schema["values"].dataType
    recordings = recordings.where(F.col("name").isin(*KINDS)).withColumn("values", F.when(F.col("name").isin(*asked) | F.col("values").isNull(), F.col("values")).otherwise(F.array().cast(kind)))
    samples = F.flatten("values") if isinstance(kind.elementType, T.ArrayType) else F.col("values")
    flat = recordings.select(*keys, "name", F.col("t0").cast("double").alias("t0"), F.col("fs").cast("double").alias("fs"), samples.cast("array<double>").alias("values"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema] + [f"{c} double" for c in features])
    types = to_arrow_schema(windows.limit(0).select(*windows.columns).schema)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, pieces = None, {}
        for batch in batches:
            lies = batch.column("_window").field(start).to_pylist(), batch.column("_window").field(end).to_pylist()
            rows, given = [], []
            of = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            plain = zip(*[batch.column(c).to_pylist() for c in ("name", "t0", "fs")], signals._row_arrays(batch.column("values")), strict=True)
            for k, (key, (name, t0, fs, x)) in enumerate(zip(of, plain, strict=True)):
                key = tuple("NaN" if v != v else v for v in key)
                if key != session:
                    session, pieces = key, {}
                if name is None and pieces:
                    rows.append(k)
                    given.append((pieces, lies[0][k], lies[1][k]))
                elif name is not None and x is not None and t0 is not None and fs:
                    wide = KINDS[name][1]
                    pieces.setdefault(name, []).append((t0, fs, x[: len(x) // wide * wide].reshape(-1, wide) if wide > 1 else x))
            if rows:
                told = batch.column("_window").take(pa.array(rows)).flatten()
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(told, types, strict=True)], *features_of(given, features)], [*types.names, *features])

    both = flat.withColumn("_window", F.lit(None)).unionByName(windows.select(*keys, F.struct(*windows.columns).alias("_window")), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, F.col("name").asc_nulls_last()).mapInArrow(bundle, schema)
