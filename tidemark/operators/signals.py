"""Signal kernels over whole arrays, and their Spark forms: one row holds one window's or scan's arrays.

Spark partitions the rows; each kernel sees one row's few thousand samples, in NumPy. What is plain arithmetic over
arrays (interval statistics, slopes, activity) is in functions.arrays as Column expressions instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scores


# -- filters -------------------------------------------------------------------------------------------------
def zero_phase(x: np.ndarray, fs: float, low: float | None, high: float | None, order: int) -> np.ndarray:
    """Butterworth filter run forward and backward: its squared gain, applied to the spectrum of the oddly extended signal (or of each row)."""
    n = x.shape[-1]
    if n < 6 * order or (high is not None and low is None and high >= fs / 2):
        return x
    pad = min(n - 1, max(3 * (2 * order + 1), int(fs / max(low or high, 1e-6))))
    ext = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], -1)
    size = ext.shape[-1]
    return np.fft.irfft(np.fft.rfft(ext) * _gain(size, fs, low, high, order), size)[..., pad : pad + n]


@lru_cache(maxsize=16)
def _gain(n: int, fs: float, low: float | None, high: float | None, order: int) -> np.ndarray:
    """The filter's squared gain at the frequencies of n samples."""
    f = np.fft.rfftfreq(n, 1 / fs)
    w = np.tan(np.pi * np.minimum(f, fs / 2 * 0.9999) / fs)
    edge = lambda v: np.tan(np.pi * min(v, fs / 2 * 0.99) / fs)
    if low is None:
        return 1 / (1 + (w / edge(high)) ** (2 * order))
    a, b = edge(low), edge(high)
    with np.errstate(divide="ignore"):
        return np.where(w > 0, 1 / (1 + ((w * w - a * b) / (np.maximum(w, 1e-12) * (b - a))) ** (2 * order)), 0.0)


def values_at(t: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`x`, known at the ascending times `t`, at other times: the two neighbours weighted by nearness, the ends held."""
    right = np.clip(np.searchsorted(t, at, "right"), 1, len(t) - 1)
    gap = t[right] - t[right - 1]
    share = np.clip(np.divide(at - t[right - 1], gap, out=np.ones(len(at)), where=gap > 0), 0, 1).reshape(-1, *[1] * (x.ndim - 1))
    return x[right - 1] * (1 - share) + x[right] * share


def resample(t: np.ndarray, x: np.ndarray, fs: float) -> np.ndarray:
    """Samples at irregular times, at whole multiples of 1 / fs after the first of them and before the last."""
    n = int((t[-1] - t[0]) * fs)
    return values_at(t, x, t[0] + np.arange(n) / fs)


def known_at(t: np.ndarray, fs: float, hole: float = 0.25) -> np.ndarray:
    """Which samples of that regular rate lie between two samples at most `hole` seconds apart."""
    at = t[0] + np.arange(int((t[-1] - t[0]) * fs)) / fs
    right = np.clip(np.searchsorted(t, at, "right"), 1, len(t) - 1)
    return t[right] - t[right - 1] <= hole


def moving_detrend(x: np.ndarray, fs: float) -> np.ndarray:
    """Less the mean of one second on either side."""
    w = int(round(fs))
    c = np.concatenate([[0], np.cumsum(x)])
    i = np.arange(len(x))
    a, b = np.maximum(i - w, 0), np.minimum(i + w + 1, len(x))
    return x - (c[b] - c[a]) / (b - a)


@lru_cache(maxsize=16)
def _hann(n: int) -> np.ndarray:
    return np.hanning(n)


@lru_cache(maxsize=4)
def _trend(n: int, strength: float) -> np.ndarray:
    """The matrix (I + strength^2 D'D)^-1 whose product with a signal is its smooth trend; D takes second differences."""
    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.inv(np.eye(n) + strength**2 * d.T @ d)


def smooth_detrend(x: np.ndarray, strength: float = 100.0) -> np.ndarray:
    """Smoothness-priors detrending (Tarvainen et al. 2002): less the minimiser of squared error plus strength^2 times
    squared second differences. Signals of more than 2,048 samples are solved in the cosine basis, which mirrors the ends."""
    n = len(x)
    if n < 3:
        return x - x.mean() if n else x
    if n <= 2048:
        return x - _trend(n, strength) @ x
    both = np.concatenate([x, x[::-1]])
    k = 2 - 2 * np.cos(np.pi * np.arange(n + 1) / n)
    return x - np.fft.irfft(np.fft.rfft(both) / (1 + strength**2 * k**2), 2 * n)[:n]


# -- peaks ---------------------------------------------------------------------------------------------------
def find_peaks(x: np.ndarray, distance: float = 1, prominence: float | None = None, height: float | None = None) -> np.ndarray:
    """Local maxima, the higher first where they are closer than `distance`, then those of enough prominence."""
    return peaks_of_rows(x[None], distance, prominence, height)[1]


def peaks_of_rows(x: np.ndarray, distance: float = 1, prominence: float | np.ndarray | None = None, height: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The peaks of each row of `x` by itself, as (row, sample) in order; `prominence` may be one number a row."""
    row, mid = np.nonzero((x[:, 1:-1] > x[:, :-2]) & (x[:, 1:-1] >= x[:, 2:]))
    mid += 1
    tops = row, mid
    if height is not None:
        high = x[tops] >= height
        row, mid = row[high], mid[high]
    at = row * (x.shape[1] + int(np.ceil(distance))) + mid  # rows lie too far apart to meet
    first, end = np.searchsorted(at, at - distance, "right").tolist(), np.searchsorted(at, at + distance, "left").tolist()
    free, keep = bytearray(b"\1" * len(at)), bytearray(len(at))
    for k in np.argsort(-x[row, mid], kind="stable").tolist():
        if free[k]:
            keep[k] = 1
            a, b = first[k], end[k]
            free[a:b] = bytes(b - a)
    kept = np.frombuffer(keep, bool)
    row, mid = row[kept], mid[kept]
    if prominence is not None and len(row):
        enough = _prominences(x, *tops)[np.searchsorted(tops[0] * x.shape[1] + tops[1], row * x.shape[1] + mid)] >= (prominence[row] if isinstance(prominence, np.ndarray) else prominence)
        row, mid = row[enough], mid[enough]
    return row, mid


def _prominences(x: np.ndarray, row: np.ndarray, top: np.ndarray) -> np.ndarray:
    """How far each local maximum of the rows lies above the higher of the lowest samples on its two sides, each side as far as the row's next higher sample."""
    n = x.shape[1]
    starts = np.arange(len(x)) * n
    edges = np.sort(np.concatenate([starts, row * n + top]))
    walls = edges % n == 0  # where a row begins; no maximum is a first sample
    high, valleys = np.where(walls, np.inf, x.ravel()[edges]).tolist(), np.minimum.reduceat(x.ravel(), edges).tolist()

    def lowest(high: list, valleys: list) -> np.ndarray:
        """For each top the least sample since the last higher top, by a stack of falling tops; valleys[k] lies before top k."""
        tops, lows, out = [], [], []
        for top, low in zip(high, valleys, strict=True):
            while tops and tops[-1] <= top:
                tops.pop()
                before = lows.pop()
                if before < low:
                    low = before
            tops.append(top)
            lows.append(low)
            out.append(low)
        return np.array(out)

    before, after = lowest(high, [np.inf, *valleys[:-1]]), lowest(high[::-1], valleys[::-1])[::-1]
    return (x.ravel()[edges] - np.maximum(before, after))[~walls]


def pulse_peaks(x: np.ndarray, fs: float, fastest: float = 200.0) -> np.ndarray:
    """Beats of a pulse signal; the prominence follows the signal's own size."""
    return pulse_peaks_of_rows(x[None], fs, fastest)[1]


def pulse_peaks_of_rows(x: np.ndarray, fs: float, fastest: float = 200.0) -> tuple[np.ndarray, np.ndarray]:
    """The beats of each row by itself, as (row, sample)."""
    if x.shape[1] < fs:
        return np.zeros(0, int), np.zeros(0, int)
    size = 0.3 * np.percentile(np.abs(x), 75, axis=1)
    return peaks_of_rows(x, max(1, int(fs * 60 / fastest)), np.where(size > 0, size, -np.inf))


def beats(x: np.ndarray, fs: float, bpm: float) -> tuple[np.ndarray, np.ndarray]:
    """(times, heights) of beats at least half a period apart, refined by a parabola."""
    p = find_peaks(np.where(x > 0, x, 0.0), 0.5 * 60 / max(bpm, 40.0) * fs)
    y0, y1, y2 = x[p - 1], x[p], x[p + 1]
    bend = y0 - 2 * y1 + y2
    off = np.clip(np.where(bend != 0, 0.5 * (y0 - y2) / np.where(bend != 0, bend, 1), 0), -0.5, 0.5)
    return (p + off) / fs, y1 - 0.25 * (y0 - y2) * off


def skin_responses(phasic: np.ndarray, fs: float, least: float = 0.01, apart: float = 1.0) -> list[dict]:
    """Onset, peak, amplitude, rise and half-recovery time of each skin-conductance response."""
    _, found = responses_of_rows(phasic[None], fs, least, apart)
    return [dict(zip(found, of, strict=True)) for of in zip(*[v.tolist() for v in found.values()], strict=True)]


def responses_of_rows(phasic: np.ndarray, fs: float, least: float = 0.01, apart: float = 1.0) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The responses of each row by itself: the row of each, and its onset, peak, amplitude, rise and recovery."""
    n = phasic.shape[1]
    row, p = peaks_of_rows(phasic, max(1, int(fs * apart)), least) if n >= 2 * fs else (np.zeros(0, int), np.zeros(0, int))
    falling = np.diff(phasic) < 0  # sample below the one before
    fell = np.maximum.accumulate(np.where(falling, np.arange(1, n), 0), 1)
    onset = fell[row, p - 1]
    size = phasic[row, p] - phasic[row, onset]
    ok = size >= least
    row, p, onset, size = row[ok], p[ok], onset[ok], size[ok]
    half, end = phasic[row, onset] + size / 2, p.copy()
    going = np.arange(len(p))
    while len(going):
        going = going[~(phasic[row[going], end[going]] <= half[going]) & (end[going] < n - 1)]
        end[going] += 1
    return row, {"onset": onset, "peak": p, "amplitude": size, "rise": (p - onset) / fs, "recovery": (end - p) / fs}


def r_peaks(ecg: np.ndarray, fs: float, fastest: float = 200.0) -> np.ndarray:
    """R waves: band-pass, slope, square, moving sum, peaks above a share of the 99th percentile."""
    if len(ecg) < 5 * fs:
        return np.zeros(0, int)
    f = zero_phase(ecg, fs, 5, 20, 3)
    w = max(1, int(0.12 * fs))
    power = np.convolve(np.diff(f, prepend=f[0]) ** 2, np.ones(w) / w, "same")
    return find_peaks(power, max(1, int(fs * 60 / fastest)), height=0.35 * np.percentile(power, 99))


@lru_cache(maxsize=4)
def _cubic(n: int, fs: float, to: float) -> tuple[np.ndarray, np.ndarray]:
    """For each sample of the higher rate, the sample before it and the weights of four around it."""
    at = np.arange(int((n - 1) / fs * to) + 1) * fs / to
    i = np.minimum(at.astype(int), n - 1)
    u = at - i
    return i, np.array([-u + 2 * u**2 - u**3, 2 - 5 * u**2 + 3 * u**3, u + 4 * u**2 - 3 * u**3, u**3 - u**2]) / 2


def upsample(x: np.ndarray, fs: float, to: float) -> np.ndarray:
    """The cubic (Catmull-Rom) through the samples at a higher rate; the ends are repeated."""
    i, weights = _cubic(len(x), fs, to)
    ends = np.concatenate([x[:1], x, x[-1:], x[-1:]])
    return (weights * np.stack([ends[i + k] for k in range(4)])).sum(0)


def run_minima(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive samples: minima of runs of twice the length, then of two runs that overlap."""
    k = 1
    while 2 * k <= n:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (n - k)], x[n - k :])


def local_peaks(x: np.ndarray, near: int, share: float) -> np.ndarray:
    """Local maxima that rise above the minima within `near` samples on both sides by `share` of the deviation; the more prominent first."""
    lowest = run_minima(np.pad(x, near, constant_values=np.inf), near + 1)
    rise = x - np.maximum(lowest[: len(x)], lowest[near:])
    top = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    top = top[rise[top] >= share * x.std()]
    kept: list[int] = []
    for p in top[np.argsort(-rise[top], kind="stable")]:
        if all(abs(p - q) >= near for q in kept):
            kept.append(int(p))
    return np.sort(np.array(kept, int))


def rhythm(pulse: np.ndarray, fs: float, bpm: float, known: np.ndarray | None = None, to: float = 250.0) -> dict:
    """Intervals of a scan's pulse around its known rate -> n_rr, pairs, mean_rr, rmssd, sdnn, pnn50, stress_index (ms, %).

    The pulse is narrowed to 0.6 to 1.5 times the rate (75 if unknown) and drawn at `to` Hz; its peaks lie at least the period
    of 1.6 times the rate (90 if unknown, 240 at most) apart. Usable intervals hold no unknown sample and, of three or more,
    lie within 25 % of the median; differences are those of neighbours that are both usable.
    """
    given = np.isfinite(bpm) and bpm > 0
    centre, fastest = (bpm if given else 75.0) / 60, min(240.0, 1.6 * (bpm if given else 90.0)) / 60
    narrow = zero_phase(pulse, fs, max(0.5, 0.6 * centre), min(fs / 2 - 0.5, 1.5 * centre), 1)
    at = local_peaks(upsample(narrow, fs, to), int(round(to / fastest)), 0.3) / to
    rr = np.diff(at) * 1000
    usable = np.ones(len(rr), bool)
    if known is not None:
        unknown_before = np.concatenate([[0], np.cumsum(~known)])
        ends = lambda t, up: np.clip((np.ceil if up else np.floor)(t * fs).astype(int) + up, 0, len(known))
        usable = unknown_before[ends(at[1:], 1)] == unknown_before[ends(at[:-1], 0)]
    if usable.sum() >= 3:
        middle = np.median(rr[usable])
        usable = usable & (np.abs(rr - middle) <= 0.25 * middle)
    left = rr[usable]
    steps = np.diff(rr)[usable[1:] & usable[:-1]]
    out = {"n_rr": len(left), "pairs": len(steps)}
    if len(left) >= 3:
        bins, counts = np.unique(np.floor(left / 50), return_counts=True)
        mode = (bins[counts.argmax()] + 0.5) * 0.05
        out |= {"mean_rr": float(left.mean()), "sdnn": float(left.std(ddof=1)), "stress_index": float(100 * counts.max() / len(left) / (2 * mode * max(np.ptp(left) / 1000, 0.01)))}
    if len(steps) >= 2:
        out |= {"rmssd": float(np.sqrt((steps**2).mean())), "pnn50": float((np.abs(steps) > 50).mean() * 100)}
    return out


# -- spectra -------------------------------------------------------------------------------------------------
#: Heart-rate variability bands in Hz.
BANDS = {"VLF": (0.0033, 0.04), "LF": (0.04, 0.15), "HF": (0.15, 0.40), "VHF": (0.40, 0.50)}


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided power density (of each row): Hann windows of `size`, half overlapping, their means removed."""
    starts = np.arange(0, x.shape[-1] - size + 1, max(1, size - size // 2))
    seg = x[..., starts[:, None] + np.arange(size)]
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    power = (np.abs(np.fft.rfft((seg - seg.mean(-1, keepdims=True)) * win)) ** 2).mean(-2) / (fs * (win**2).sum())
    power[..., 1 : None if size % 2 else -1] *= 2
    return np.fft.rfftfreq(size, 1 / fs), power


def interval_bands(ibi: np.ndarray, at: np.ndarray, least: int = 30, fs: float = 4.0) -> dict[str, float | None]:
    """Power and peak of each band of the intervals, their total, and what LF and HF are of each other.

    The intervals become a regular series first, of four minutes a window at most; nothing is said of fewer than
    `least` beats or of less than four seconds.
    """
    told = bands_of_rows(np.zeros(len(ibi), int), ibi, at, least, fs)
    return one_row(told)


#: What kernels tell of many rows: name -> (the rows it is told of, its values there).
Told = dict[str, tuple[np.ndarray, np.ndarray]]


def one_row(told: Told) -> dict[str, float | None]:
    return {name: float(values[0]) if len(values) else None for name, (_, values) in told.items()}


def bands_of_rows(row: np.ndarray, ibi: np.ndarray, at: np.ndarray, least: int = 30, fs: float = 4.0) -> Told:
    """interval_bands of each row's intervals, which lie together; rows with series of one length share a transform."""
    rows, first, count = np.unique(row, return_index=True, return_counts=True)
    long = count >= least
    rows, first, last = rows[long], first[long], (first + count - 1)[long]
    size = np.ceil((at[last] - at[first]) * fs).astype(int)
    parts: dict[str, list] = {}
    for n in np.unique(size[size >= 4 * fs]).tolist():
        of = np.flatnonzero(size == n)
        grid = at[first[of], None] + np.arange(n) / fs
        right = np.stack([a + np.clip(np.searchsorted(at[a : b + 1], g, "right"), 1, b - a) for a, b, g in zip(first[of].tolist(), last[of].tolist(), grid, strict=True)])
        gap = at[right] - at[right - 1]
        share = np.clip(np.divide(grid - at[right - 1], gap, out=np.ones(grid.shape), where=gap > 0), 0, 1)
        series = ibi[right - 1] * (1 - share) + ibi[right] * share
        f, density = welch(series - series.mean(1, keepdims=True), fs, min(n, int(60 * fs)))
        power, peak = {}, {}
        for name, edges in BANDS.items():
            b = slice(*np.searchsorted(f, edges))
            power[name] = ((density[:, b][:, 1:] + density[:, b][:, :-1]) / 2 * np.diff(f[b])).sum(1)
            peak[name] = f[b][density[:, b].argmax(1)] if len(f[b]) else np.full(len(of), np.nan)
        both = power["LF"] + power["HF"]
        with np.errstate(divide="ignore", invalid="ignore"):
            shares = {name: np.where(whole > 0, part / whole, np.nan) for name, part, whole in (("LF_n", power["LF"], both), ("HF_n", power["HF"], both), ("LF_HF_ratio", power["LF"], power["HF"]))}
        figures = {f"{k}_power": v for k, v in power.items()} | {f"{k}_peak": v for k, v in peak.items()} | {"total_power": sum(power.values())} | shares
        for name, v in figures.items():
            parts.setdefault(name, []).append((rows[of], v))
    out = {name: tuple(map(np.concatenate, zip(*found, strict=True))) if len(found) > 1 else found[0] for name, found in parts.items()}
    unknown = {name: np.isnan(v) for name, (_, v) in out.items() if not name.endswith("_power")}
    return out | {name: (out[name][0][~none], out[name][1][~none]) for name, none in unknown.items() if none.any()}


@lru_cache(maxsize=32)
def _waves(n: int, fs: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies of a hundredth apart and their waves over n samples."""
    f = np.arange(low, high + 1e-9, 0.01)
    return f, np.exp(-2j * np.pi * np.outer(f, np.arange(n)) / fs)


def strongest(x: np.ndarray, fs: float, low: float = 0.7, high: float = 3.0, near: float = 0.1) -> tuple[float, float]:
    """(beats per minute, SNR in dB) of the strongest frequency; its harmonic's surroundings count as signal."""
    f, waves = _waves(len(x), fs, low, high)
    p = np.abs(waves @ x) ** 2
    top = f[np.argmax(p)]
    signal = p[(np.abs(f - top) <= near) | (np.abs(f - 2 * top) <= near)].sum()
    return float(top * 60), float(10 * np.log10(max(signal, 1e-12) / max(p.sum() - signal, 1e-12)))


def spectrum_peak(x: np.ndarray, fs: float, low: float = 0.6, high: float = 3.3, near: float = 0.1) -> tuple[float, float]:
    """(beats per minute, SNR in dB) as the second estimator judges a pulse: detrended and band-passed once more, then the
    top of a periodogram padded to a power of two; the first two harmonics within `near` count as signal."""
    y = zero_phase(smooth_detrend(x), fs, low, high, 1)
    size = 1 << max(0, (len(y) - 1).bit_length())
    f, p = np.fft.rfftfreq(size, 1 / fs), np.abs(np.fft.rfft(y, size)) ** 2
    f, p = f[(f >= low) & (f <= high)], p[(f >= low) & (f <= high)]
    top = f[p.argmax()]
    signal = np.minimum(np.abs(f - top), np.abs(f - 2 * top)) <= near
    return float(top * 60), float(10 * np.log10(max(p[signal].sum(), 1e-12) / max(p[~signal].sum(), 1e-12)))


#: The camera scan's pulse filter and search band in Hz, the band in which half a peak's rate may be the
#: true one, the power it then needs, and the harmonics that count as signal.
PULSE_BAND, SEARCH_BAND, HALF_BAND, HALF_SHARE, HARMONICS = (0.5, 4.0), (0.7, 4.0), (0.75, 0.95), 0.2, 3


def scan_peak(x: np.ndarray, fs: float, least: int = 4096, near: float = 0.1) -> tuple[float, float]:
    """(beats per minute, SNR in dB) of a camera scan's pulse: Hann window, the peak refined by a parabola, and half its
    rate instead if that lies in HALF_BAND and has a local peak of HALF_SHARE of its power."""
    rate, snr = scan_peaks(x[None], fs, least, near)
    return float(rate[0]), float(snr[0])


def scan_peaks(x: np.ndarray, fs: float, least: int = 4096, near: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """scan_peak of each row: all rates, all SNRs."""
    n, size = x.shape[1], max(least, 4 << max(0, (x.shape[1] - 1).bit_length()))
    f, inside = _search_band(size, fs)
    p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * _hann(n), size)[:, inside]) ** 2
    rows, top = np.arange(len(p)), p.argmax(1)
    for k in np.flatnonzero((HALF_BAND[0] <= f[top] / 2) & (f[top] / 2 <= HALF_BAND[1])):
        q = p[k]
        local = np.flatnonzero((q[1:-1] >= q[:-2]) & (q[1:-1] >= q[2:]) & (np.abs(f[1:-1] - f[top[k]] / 2) <= 0.05)) + 1
        local = local[q[local] >= HALF_SHARE * q[top[k]]]
        top[k] = local[q[local].argmax()] if len(local) else top[k]
    rate, mid = f[top], np.clip(top, 1, len(f) - 2)
    y0, y1, y2 = p[rows, mid - 1], p[rows, mid], p[rows, mid + 1]
    bend = y0 - 2 * y1 + y2
    rate = rate + np.where(top == mid, (y0 - y2) / (2 * np.where(bend == 0, 1, bend)) * (f[1] - f[0]), 0)
    signal = np.abs(f - rate[:, None]) <= near
    for k in range(2, HARMONICS + 1):
        signal |= np.abs(f - k * rate[:, None]) <= near
    power = lambda part: np.maximum(np.where(part, p, 0).sum(1), 1e-12)
    return rate * 60, 10 * np.log10(power(signal) / power(~signal))


@lru_cache(maxsize=16)
def _search_band(size: int, fs: float) -> tuple[np.ndarray, slice]:
    """The frequencies of SEARCH_BAND in the spectrum of so many samples, and where they lie."""
    f = np.fft.rfftfreq(size, 1 / fs)
    inside = slice(np.searchsorted(f, SEARCH_BAND[0], "left"), np.searchsorted(f, SEARCH_BAND[1], "right"))
    return f[inside], inside


def amplitude_at(x: np.ndarray, fs: float, rate: float) -> tuple[float, float]:
    """(amplitude of the sine of that rate, under a Hann window; its share of the variance). Nothing below four samples."""
    if len(x) < 4 or not np.isfinite(rate):
        return 0.0, 0.0
    apart, taper = x - x.mean(), _hann(len(x))
    size = 2 * abs((taper * apart) @ np.exp(-2j * np.pi * rate * np.arange(len(x)) / fs)) / taper.sum()
    spread = float((apart**2).mean())
    return float(size), min(1.0, float(size**2 / 2 / spread)) if spread > 0 else 0.0


# -- pulse from colour ---------------------------------------------------------------------------------------
def plane_orthogonal(rgb: np.ndarray, fs: float, how: str = "v1", seconds: float = 1.6) -> np.ndarray:
    """Pulse from mean colours (Wang et al. 2017): every window divided by its mean, projected, overlap-added.

    v1 rounds the window's length and uses every window; v2 takes the ceiling and leaves the last window out.
    """
    w = int(np.ceil(seconds * fs)) if how == "v2" else int(round(seconds * fs))
    n, laid = len(rgb), len(rgb) - w + (how != "v2")
    if laid < 1:
        return np.zeros(n)
    win = np.lib.stride_tricks.sliding_window_view(np.ascontiguousarray(rgb.T), laid, axis=1)[:, :w]  # colours, samples, windows
    red, green, blue = (c / c.mean(0) for c in win[:3])
    s1, s2 = green - blue, green + blue - 2 * red
    sd = s2.std(0)
    h = s1 + s1.std(0) / np.where(sd > 0, sd, 1) * s2
    h -= h.mean(0)
    out = np.zeros(n)
    for k in range(w - 1, -1, -1):  # from the last sample on, so that a sample's windows are added in their order
        out[k : k + laid] += h[k]
    return out


def pulse_v1(rgb: np.ndarray, fs: float) -> np.ndarray:
    return moving_detrend(plane_orthogonal(rgb, fs), fs)


def pulse_v2(rgb: np.ndarray, fs: float) -> np.ndarray:
    return zero_phase(smooth_detrend(plane_orthogonal(rgb, fs, "v2")), fs, 0.75, 3.0, 1)


#: Fixed value: how many windows of a scan are looked at together.
WINDOWS = 64


def fused(pulses: list[np.ndarray], fs: float, seconds: float = 6.0) -> np.ndarray:
    """One pulse of several: in windows a second apart each is scaled to unit size and weighted by its SNR as a power
    ratio; the windows are joined under Hann tapers."""
    n = len(pulses[0])
    size = min(n, int(round(seconds * fs)))
    starts = sorted({*range(0, n - size + 1, max(1, int(round(fs)))), n - size})
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(size) + 0.5) / size)
    some, out, weight = np.stack(pulses), np.zeros(n), np.zeros(n)
    for k in range(0, len(starts), WINDOWS):
        block = np.array(starts[k : k + WINDOWS])
        parts = some[:, block[:, None] + np.arange(size)]  # pulses, windows, samples
        spread = parts.std(2, keepdims=True)
        power = 10 ** (scan_peaks(parts.reshape(-1, size), fs, 1024)[1].reshape(spread.shape) / 10)
        parts = np.where(spread > 0, taper * power * parts / np.where(spread > 0, spread, 1), 0).sum(0)
        for a, part in zip(block, parts, strict=True):
            out[a : a + size] += part
            weight[a : a + size] += taper
    return out / np.where(weight > 0, weight, 1)


def cancel(x: np.ndarray, refs: np.ndarray, rate: float = 0.05, taps: int = 8) -> np.ndarray:
    """Normalised least-mean-squares: what the references of the last few samples predict is taken out of x."""
    n, k = refs.shape
    lagged = np.stack([np.vstack([np.zeros((j, k)), refs[: n - j]]) for j in range(taps)], axis=2).reshape(n, -1)
    norm = (lagged**2).sum(1) + 1e-6
    w, out = np.zeros(k * taps), np.empty(n)
    for i in range(n):
        out[i] = x[i] - w @ lagged[i]
        w += rate * out[i] / norm[i] * lagged[i]
    return out


def breathing(t: np.ndarray, v: np.ndarray, fs: float = 4.0, low: float = 0.1, high: float = 0.5) -> tuple[float | None, float]:
    """(breaths per minute, share of the band's power near the peak) of an irregular series."""
    if len(t) < 6 or (t[-1] - t[0]) * fs < 32:
        return None, 0.0
    x = resample(t, v, fs)
    x = zero_phase(smooth_detrend(x - x.mean(), 10.0), fs, low, high, 1)
    size = 4 * 2 ** int(np.ceil(np.log2(len(x))))
    p, f = np.abs(np.fft.rfft(x * np.hanning(len(x)), size)) ** 2, np.fft.rfftfreq(size, 1 / fs)
    band = (f >= low) & (f <= high)
    if p[band].sum() <= 0:
        return None, 0.0
    top = f[band][np.argmax(p[band])]
    return float(top * 60), float(p[band & (np.abs(f - top) <= 0.03)].sum() / p[band].sum())


#: The band of breathing in a camera scan (Hz), how far from its ends a peak must lie, how far it must rise above
#: the band's median power, and how far head and light may differ (breaths a minute).
BREATH_BAND, BREATH_EDGE, BREATH_RISE, BREATH_AGREE = (0.13, 0.5), 0.02, 10.0, 2.0


def breath_peak(x: np.ndarray, fs: float) -> tuple[float | None, float]:
    """(breaths per minute, power over the band's median) of the highest local maximum inside the band: slow drift that leaks in
    at its lower end is no breath, and a flat floor has some highest point too, so the rise above the median tells them apart."""
    y = zero_phase(x, fs, *BREATH_BAND, 1)
    size = max(8192, 4 << max(0, (len(y) - 1).bit_length()))
    f, p = np.fft.rfftfreq(size, 1 / fs), np.abs(np.fft.rfft((y - y.mean()) * _hann(len(y)), size)) ** 2
    band = (f >= BREATH_BAND[0]) & (f <= BREATH_BAND[1])
    f, p = f[band], p[band]
    top = np.flatnonzero((p[1:-1] >= p[:-2]) & (p[1:-1] >= p[2:])) + 1
    top = top[(f[top] - BREATH_BAND[0] >= BREATH_EDGE) & (BREATH_BAND[1] - f[top] >= BREATH_EDGE)]
    if not len(top):
        return None, 0.0
    best = top[p[top].argmax()]
    return float(f[best] * 60), float(p[best] / (np.sort(p)[len(p) // 2] or 1e-30))


def breath_of_two(head: np.ndarray, light: np.ndarray, fs: float, least: float = 15.0) -> dict:
    """Breathing as the head's nodding and the face's light show it -> breaths, head_breaths, light_breaths; `breaths` only where both
    stand out and agree. Nothing below `least` seconds."""
    if len(head) < least * fs:
        return {}
    (a, rise_a), (b, rise_b) = breath_peak(head, fs), breath_peak(light, fs)
    agreed = a is not None and b is not None and abs(a - b) <= BREATH_AGREE and min(rise_a, rise_b) >= BREATH_RISE
    return {"breaths": (a + b) / 2 if agreed else None, "head_breaths": a, "light_breaths": b}


#: Usable beat intervals (s), how far one may lie from the median of all and of its neighbours, and the half
#: width (Hz) of the band around the rate in which beats are timed.
INTERVALS, FROM_ALL, FROM_NEAR, BEAT_HALF = (0.33, 1.5), 0.30, 0.20, 0.4


def usable_intervals(ibi: np.ndarray, near: bool = True) -> np.ndarray:
    """Which intervals are in range, near the median of all and, with `near`, near that of two usable neighbours on either side."""
    ok = (ibi >= INTERVALS[0]) & (ibi <= INTERVALS[1])
    if ok.sum() < 3:
        return ok
    middle = np.median(ibi[ok])
    ok = ok & (np.abs(ibi - middle) <= FROM_ALL * middle)
    if not near:
        return ok
    some = np.where(ok, ibi, np.nan)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(some, 2, constant_values=np.nan), 5)[:, [0, 1, 3, 4]]
    n = np.isfinite(around).sum(1)
    local = np.array([np.median(a[np.isfinite(a)]) if k >= 2 else np.nan for a, k in zip(around, n, strict=True)])
    return ok & ~(np.abs(ibi - local) > FROM_NEAR * local)  # where too few are known, nothing speaks against it


def beat_figures(at: np.ndarray) -> dict:
    """Beat times -> beats, ok_share, all_share, jumps and, of ten usable intervals and eight pairs, hr_beats, rmssd, sdnn, pnn50, si."""
    ibi = np.diff(at)
    ok, rough = (usable_intervals(ibi), usable_intervals(ibi, near=False)) if len(ibi) else (np.zeros(0, bool),) * 2
    pairs = lambda keep: np.diff(ibi)[keep[1:] & keep[:-1]] if len(ibi) > 1 else np.zeros(0)
    steps, rough_steps = pairs(ok) * 1000, pairs(rough)
    out = {"beats": len(at), "ok_share": float(ok.mean()) if len(ibi) else 0.0, "all_share": float(rough.mean()) if len(ibi) else 0.0}
    out["jumps"] = float((np.abs(rough_steps) > 0.2 * ibi[rough].mean()).mean()) if len(rough_steps) >= 8 else None
    good = ibi[ok]
    if len(good) >= 10 and len(steps) >= 8:
        bins, counts = np.unique(np.floor(good * 20), return_counts=True)
        mode = (bins[counts.argmax()] + 0.5) / 20
        out |= {
            "hr_beats": float(60 / good.mean()), "rmssd": float(np.sqrt((steps**2).mean())), "sdnn": float(good.std(ddof=1) * 1000), "pnn50": float((np.abs(steps) > 50).mean() * 100),
            "si": float(100 * counts.max() / len(good) / (2 * mode * max(np.ptp(good), 0.05))),
        }
    return out


def respiration(series: dict[str, tuple[np.ndarray, np.ndarray]], least: float = 0.3, agree: float = 4.0) -> tuple[float | None, str]:
    """(breaths per minute, trust) of several irregular series: those clear enough that agree with the clearest are averaged; trust is
    high of two or more, mid of one that is very clear, else low."""
    found = [breathing(t, v) for t, v in series.values()]
    good = sorted(((share, rate) for rate, share in found if rate is not None and share >= least), reverse=True)
    if not good:
        return None, "low"
    rates = [rate for _, rate in good if abs(rate - good[0][1]) <= agree]
    return float(np.mean(rates)), "high" if len(rates) >= 2 else "mid" if good[0][0] >= 0.5 else "low"


def scan_vitals_of(t: np.ndarray, rgb: np.ndarray, fs: float = 30.0) -> dict:
    """Everything a face scan tells (see scan_vitals), unrounded."""
    colours = resample(t, rgb, fs)
    pulse = pulse_v2(colours, fs)
    hr, snr = spectrum_peak(pulse, fs)
    y = smooth_detrend(pulse)
    for _ in range(2):
        y = zero_phase(y, fs, max(0.5, hr / 60 - BEAT_HALF), hr / 60 + BEAT_HALF, 1)
    at, height = beats((y - y.mean()) / (y.std() or 1), fs, hr)
    figures = beat_figures(at)
    series = {"light": (np.arange(len(colours)) / fs, colours[:, 1] / colours[:, 1].mean())}
    if len(at) >= 6:
        series["height"] = (at, height)
        ok = usable_intervals(np.diff(at))
        if ok.sum() >= 6:
            series["interval"] = ((at[1:] + at[:-1])[ok] / 2, np.diff(at)[ok])
    rr, rr_conf = respiration(series)
    signal = "high" if snr >= 3 else "mid" if snr >= 0 else "low"
    weak = signal == "low" or "rmssd" not in figures or figures["ok_share"] < 0.7
    hrv_conf = "low" if weak else "high" if signal == "high" and figures["ok_share"] >= 0.85 else "mid"
    judged = signal == "high" and figures["all_share"] >= 0.8 and figures["jumps"] is not None
    shown = {k: figures.get(k) if hrv_conf != "low" else None for k in ("rmssd", "sdnn", "pnn50", "si")}
    return {
        "hr": hr, "snr": snr, "signal": signal, "hr_beats": figures.get("hr_beats"), **shown, "hrv_conf": hrv_conf, "irregular": figures["jumps"] > 0.3 if judged else None,
        "rr": rr if signal != "low" else None, "rr_conf": rr_conf if signal != "low" else "low", "beats": figures["beats"], "ok_share": figures["ok_share"],
    }


# -- Spark forms ---------------------------------------------------------------------------------------------
def per_row(df: DataFrame, keys: list[str], arrays: list[str], kernel: Callable[..., dict], schema: str) -> DataFrame:
    """`keys` and the kernel's outputs for each row: kernel(*arrays as NumPy) -> dict by the schema's names.

    A row with a null array, or for which the kernel gives nothing, has null outputs. No shuffle.
    """
    names, types = zip(*[part.split() for part in schema.split(",")], strict=True)
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for given in zip(*[_row_arrays(batch.column(len(keys) + k)) for k in range(len(arrays))], strict=True):
                got = {} if any(a is None for a in given) else kernel(*given) or {}
                rows.append([got.get(n) for n in names])
            made = [pa.array([r[k] for r in rows], ARROW[kind], from_pandas=True) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], *made], [*keys, *names])

    return df.select(*keys, *arrays).mapInArrow(run, f"{kinds}, {schema}")


#: What a kernel may give.
ARROW = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}


def _row_arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each row's numbers, or rows of as many numbers each, as one array; None for null. They are views of the batch: no number becomes an object."""
    inner, ends, valid = column.values, column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    nested = pa.types.is_list(inner.type)
    numbers = (inner.values if nested else inner).to_numpy(zero_copy_only=False).astype(float, copy=False)
    at = inner.offsets.to_numpy() if nested else None
    for k in range(len(column)):
        a, b = ends[k], ends[k + 1]
        if not valid[k]:
            yield None
        elif not nested:
            yield numbers[a:b].copy()
        else:
            wide = np.unique(np.diff(at[a : b + 1]))
            if len(wide) > 1:
                raise ValueError("the arrays of a row differ in length")
            yield numbers[at[a] : at[b]].reshape(b - a, -1).copy() if b > a else np.zeros(0)


FIGURES = "n_beats bigint, hr double, rmssd double, sdnn double, LF_power double, HF_power double, total_power double"


def near_intervals(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of 0.3 to 1.5 s between beats that lie within 30 % of their median, and when each ends."""
    return near_intervals_of_rows(np.zeros(len(at), int), at)[1:]


def near_intervals_of_rows(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's near_intervals: the row of each, its length and when it ends; a row's beats lie together."""
    ibi = np.diff(at)
    ok = (row[1:] == row[:-1]) & (ibi >= 0.3) & (ibi <= 1.5)
    row, ibi, t = row[1:][ok], ibi[ok], at[1:][ok]
    _, first, of, count = np.unique(row, return_index=True, return_inverse=True, return_counts=True)
    by_size = ibi[np.lexsort((ibi, row))]
    middle = ((by_size[first + (count - 1) // 2] + by_size[first + count // 2]) / 2)[of]
    ok = np.abs(ibi - middle) <= 0.3 * middle
    return row[ok], ibi[ok], t[ok]


def interval_figures(at: np.ndarray) -> dict:
    """FIGURES of the beats at these times (ms but for hr), by their near_intervals."""
    ibi, t = near_intervals(at)
    out = {"n_beats": len(ibi)}
    if len(ibi) > 1:
        d = np.diff(ibi) * 1000
        out |= {"hr": 60 / ibi.mean(), "rmssd": float(np.sqrt((d**2).mean())), "sdnn": float(ibi.std(ddof=1) * 1000)}
    return out | {k: v for k, v in interval_bands(ibi, t).items() if k in ("LF_power", "HF_power", "total_power")}


def interval_features(df: DataFrame, keys: list[str], pulse: str, fs: float) -> DataFrame:
    """Pulse windows -> keys, FIGURES."""
    return per_row(df, keys, [pulse], lambda x: interval_figures(pulse_peaks(zero_phase(x, fs, 0.5, 10.0, 4), fs) / fs), FIGURES)


def ecg_features(df: DataFrame, keys: list[str], ecg: str, fs: float) -> DataFrame:
    """Chest ECG windows -> keys, FIGURES of their R waves, so that chest and wrist are judged alike."""
    return per_row(df, keys, [ecg], lambda x: interval_figures(r_peaks(x, fs) / fs), FIGURES)


def pulse_rhythm(df: DataFrame, keys: list[str], pulse: str, bpm: str, fs: float, known: str | None = None) -> DataFrame:
    """Scan pulses, the rate found for each and perhaps which samples are known -> keys and the figures of `rhythm`."""
    kernel = lambda x, b, *k: rhythm(x, fs, float(b[0]), k[0] > 0 if k else None)
    rows = df.withColumn("_bpm", F.array(F.col(bpm).cast("double")))
    return per_row(rows, keys, [pulse, "_bpm", *([known] if known else [])], kernel, RHYTHM)


def short_scans(df: DataFrame, keys: list[str], t: str, rgb: str, start: float = 0.0, least: int = 8, most: int = 20, fs: float = 30.0) -> DataFrame:
    """What a scan that may stop early would have shown -> keys, hr, snr, seconds, early.

    From `least` seconds after `start` on, the scan so far is estimated every second; it stops when the last three estimates
    lie within 3 bpm of each other and none has an SNR below 0, at `most` seconds otherwise.
    """

    def kernel(t: np.ndarray, rgb: np.ndarray) -> dict:
        seen: list[tuple[float, float]] = []
        for seconds in range(least, most + 1):
            part = (t >= start) & (t < start + seconds)
            if part.sum() > 1 and np.ptp(t[part]) >= 8:
                seen.append(strongest(pulse_v1(resample(t[part], rgb[part], fs), fs), fs))
            rates, snrs = np.array(seen[-3:]).reshape(-1, 2).T
            if len(rates) == 3 and np.ptp(rates) <= 3 and snrs.min() >= 0:
                return {"hr": rates[-1], "snr": snrs[-1], "seconds": seconds, "early": True}
        hr, snr = seen[-1] if seen else (None, None)
        return {"hr": hr, "snr": snr, "seconds": most, "early": False}

    return per_row(df, keys, [t, rgb], kernel, "hr double, snr double, seconds int, early boolean")


def skin_features(df: DataFrame, keys: list[str], eda: str, fs: float) -> DataFrame:
    """Skin-conductance windows -> keys, mean_tonic, std_phasic, n_scr, mean_amplitude, mean_rise, mean_recovery."""

    def kernel(x: np.ndarray) -> dict:
        clean = zero_phase(x, fs, None, 1.0, 4)
        tonic = zero_phase(clean, fs, None, 0.05, 2)
        found = skin_responses(clean - tonic, fs)
        mean = lambda k: float(np.mean([e[k] for e in found])) if found else 0.0
        return {"mean_tonic": float(tonic.mean()), "std_phasic": float((clean - tonic).std(ddof=1)), "n_scr": len(found), "mean_amplitude": mean("amplitude"), "mean_rise": mean("rise"), "mean_recovery": mean("recovery")}

    return per_row(df, keys, [eda], kernel, "mean_tonic double, std_phasic double, n_scr bigint, mean_amplitude double, mean_rise double, mean_recovery double")


def scan_features(df: DataFrame, keys: list[str], t: str, rgb: str, fs: float = 30.0, how: str = "v2") -> DataFrame:
    """Face scans (times in seconds, colours) -> keys, hr, snr, n_beats, rr; null below 8 seconds. Each way has its estimator."""

    def kernel(t: np.ndarray, rgb: np.ndarray) -> dict:
        if len(t) < 2 or t[-1] - t[0] < 8:
            return {}
        x = resample(t, rgb, fs)
        pulse = pulse_v1(x, fs) if how == "v1" else pulse_v2(x, fs)
        hr, snr = strongest(pulse, fs) if how == "v1" else spectrum_peak(pulse, fs)
        y = zero_phase(smooth_detrend(pulse), fs, max(0.5, hr / 60 - 0.4), hr / 60 + 0.4, 1)
        at, _ = beats(y / (y.std() or 1), fs, hr)
        rr, share = breathing(np.arange(len(x)) / fs, x[:, 1] / x[:, 1].mean())
        return {"hr": hr, "snr": snr, "n_beats": len(at), "rr": rr if share >= 0.3 else None}

    return per_row(df, keys, [t, rgb], kernel, "hr double, snr double, n_beats bigint, rr double")


RHYTHM = "n_rr bigint, pairs bigint, mean_rr double, rmssd double, sdnn double, pnn50 double, stress_index double"
BREATHS = "breaths double, head_breaths double, light_breaths double"
VITALS = "hr double, snr double, signal string, hr_beats double, rmssd double, sdnn double, pnn50 double, si double, hrv_conf string, irregular boolean, rr double, rr_conf string, beats bigint, ok_share double"


def scan_vitals(df: DataFrame, keys: list[str], t: str, rgb: str, fs: float = 30.0) -> DataFrame:
    """Face scans (times in seconds, colours) -> keys, VITALS, stress (0 to 100) and stress_zone.

    `signal` grades the SNR, `hrv_conf` the beat intervals; figures of the rhythm are shown above low only. `irregular` is judged on a
    clear signal alone. Breathing is what the skin's light, the beats' heights and their intervals agree on. Null below 8 seconds.
    """
    kernel = lambda t, c: scan_vitals_of(t, c, fs) if len(t) > 1 and t[-1] - t[0] >= 8 else {}
    out = per_row(df, keys, [t, rgb], kernel, VITALS)
    return out.withColumn("stress", scores.stress_score(F.col("si"))).withColumn("stress_zone", scores.stress_zone(F.col("stress")))


def scan_breathing(df: DataFrame, keys: list[str], head: str, light: str, fs: float = 30.0) -> DataFrame:
    """Regular series of the head's height and the face's light -> keys, BREATHS."""
    return per_row(df, keys, [head, light], lambda a, b: breath_of_two(a, b, fs), BREATHS)


#: Columns of a camera sample: time in seconds, three regions' colours, the face's place and size, brightness.
SAMPLE = ("t", "forehead", "left", "right", "x", "y", "width", "brightness")


def scan_figures(scans: DataFrame, keys: list[str], fs: float = 30.0, cancelled: bool = False, extract: Callable = plane_orthogonal, fuse: Callable = fused, clean: Callable = cancel) -> DataFrame:
    """Scans, one row with the arrays SAMPLE -> keys, bpm, snr, agree, motion_amp, motion_frac, light_ratio, light_amp, and what the
    pulse's rhythm (n_rr, pairs, mean_rr, rmssd, sdnn, pnn50, stress_index) and breath_of_two tell.

    The pulses of the mean colour and of each region are fused; `agree` counts the regions within 3 bpm of the result. The
    interference figures are the amplitudes of the face's movement and of the light at the rate found. With `cancelled`,
    what the face's movement predicts is first taken out of each pulse, forward and backward. Null below 60 grid samples.
    Other columns of the scans stay. Other stages may stand in: extract(colours, fs), fuse(pulses, fs) and clean(pulse, references, rate).
    """

    def kernel(t, forehead, left, right, x, y, width, brightness) -> dict:
        if len(t) < 2 or (t[-1] - t[0]) * fs < 60:
            return {}
        passed = lambda v: zero_phase(v, fs, *PULSE_BAND, 1)
        *regions, one = np.split(resample(t, np.column_stack([forehead, left, right, x, y, width, brightness, y / np.maximum(width, 1)]), fs), np.cumsum([c.shape[1] for c in (forehead, left, right)]), axis=1)
        colours = [np.ascontiguousarray(c) for c in regions]
        whole = np.mean(colours, axis=0)
        x, y, width, brightness, head = np.ascontiguousarray(one.T)
        moves = [passed(v / np.maximum(width, 1)) for v in (x, y)]
        pulses = [passed(extract(c, fs)) for c in (whole, *colours)]
        if cancelled:
            refs = np.stack([m / (m.std() or 1) for m in moves], axis=1)
            pulses = [(clean(p, refs, 0.02) + clean(p[::-1], refs[::-1], 0.02)[::-1]) / 2 for p in pulses]
        pulse = fuse(pulses, fs)
        rates, snrs = scan_peaks(np.stack([pulse, *pulses[1:]]), fs)
        bpm, snr = float(rates[0]), float(snrs[0])
        motion = max(amplitude_at(m, fs, bpm / 60) for m in moves)
        relative = lambda v: amplitude_at(passed(v / v.mean() - 1), fs, bpm / 60)[0] if v.mean() else 0.0
        light, green = relative(brightness), relative(whole[:, 1])
        return {
            "bpm": bpm, "snr": snr, "agree": int((np.abs(rates[1:] - bpm) <= 3).sum()), "motion_amp": motion[0], "motion_frac": motion[1],
            "light_ratio": light / green if green > 0 else float("inf"), "light_amp": light,
            **rhythm(pulse, fs, bpm, known_at(t, fs)), **breath_of_two(head, whole[:, 1], fs),
        }

    carried = [] if scans is None else [c for c in scans.columns if c not in (*keys, *SAMPLE)]
    return per_row(scans, [*keys, *carried], list(SAMPLE), kernel, f"bpm double, snr double, agree int, motion_amp double, motion_frac double, light_ratio double, light_amp double, {RHYTHM}, {BREATHS}")
