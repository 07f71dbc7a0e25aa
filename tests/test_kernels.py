"""Kernels that look at many windows or peaks at once, by plain loops over one at a time."""

import numpy as np
import pytest

from tidemark.operators import bundle
from tidemark.operators import signals as sg


def plain_prominence(x, p):
    a, b = p, p
    while a > 0 and x[a - 1] <= x[p]:
        a -= 1
    while b < len(x) - 1 and x[b + 1] <= x[p]:
        b += 1
    return x[p] - max(x[a : p + 1].min(), x[p : b + 1].min())


def plain_peaks(x, distance, prominence):
    tops = [k for k in range(1, len(x) - 1) if x[k] > x[k - 1] and x[k] >= x[k + 1]]
    kept = []
    for k in sorted(tops, key=lambda k: -x[k]):
        if all(abs(k - o) >= distance for o in kept):
            kept.append(k)
    return [k for k in sorted(kept) if prominence is None or plain_prominence(x, k) >= prominence]


@pytest.mark.parametrize("distance", [1, 3, 7.5])
def test_peaks_by_a_plain_climb(distance):
    rng = np.random.default_rng(1)
    for k in range(60):
        x = [rng.normal(size=80), rng.integers(0, 4, 80).astype(float), np.cumsum(rng.normal(size=80))][k % 3]
        for prominence in (None, 0.5, 1.5):
            assert sg.find_peaks(x, distance, prominence).tolist() == plain_peaks(x, distance, prominence)


def plain_scan_peak(x, fs, least):
    size = max(least, 4 << max(0, (len(x) - 1).bit_length()))
    f, p = np.fft.rfftfreq(size, 1 / fs), np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)), size)) ** 2
    f, p = f[(f >= 0.7) & (f <= 4.0)], p[(f >= 0.7) & (f <= 4.0)]
    top = int(p.argmax())
    if 0.75 <= f[top] / 2 <= 0.95:
        near = [k for k in range(1, len(p) - 1) if p[k] >= p[k - 1] and p[k] >= p[k + 1] and abs(f[k] - f[top] / 2) <= 0.05 and p[k] >= 0.2 * p[top]]
        top = max(near, key=lambda k: p[k]) if near else top
    rate = f[top]
    if 0 < top < len(f) - 1:
        rate += (p[top - 1] - p[top + 1]) / (2 * ((p[top - 1] - 2 * p[top] + p[top + 1]) or 1)) * (f[1] - f[0])
    signal = np.array([min(abs(v - k * rate) for k in (1, 2, 3)) <= 0.1 for v in f])
    return rate * 60, 10 * np.log10(max(p[signal].sum(), 1e-12) / max(p[~signal].sum(), 1e-12))


def faces(n=360):
    rng, t = np.random.default_rng(3), np.arange(n) / 30
    return [np.sin(2 * np.pi * rate * t) + rng.normal(0, 0.4, n) for rate in (0.71, 1.2, 1.7, 3.98)] + [np.sin(2 * np.pi * 1.7 * t) + 0.6 * np.sin(2 * np.pi * 0.85 * t), np.full(n, 2.0)]


def test_peaks_of_many_rows_are_those_of_each():
    rates, snrs = sg.scan_peaks(np.stack(faces()), 30.0)
    for x, rate, snr in zip(faces(), rates, snrs, strict=True):
        assert (rate, snr) == pytest.approx(plain_scan_peak(x, 30.0, 4096))
        assert (rate, snr) == pytest.approx(sg.scan_peak(x, 30.0))
    assert rates[4] == pytest.approx(51, abs=0.5)


@pytest.mark.parametrize("n", [100, 360, 2500])  # one window, some, and more than one block of them
def test_fusion_by_a_plain_loop(n):
    pulses = faces(n)
    size = min(n, 180)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(size) + 0.5) / size)
    want, weight = np.zeros(n), np.zeros(n)
    for a in sorted({*range(0, n - size + 1, 30), n - size}):
        for p in (p[a : a + size] for p in pulses):
            if p.std() > 0:
                want[a : a + size] += taper * 10 ** (plain_scan_peak(p, 30.0, 1024)[1] / 10) * p / p.std()
        weight[a : a + size] += taper
    assert sg.fused(pulses, 30.0) == pytest.approx(want / weight, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("how", ["v1", "v2"])
def test_projection_by_a_plain_loop(how):
    rgb = np.random.default_rng(5).uniform(80, 120, (100, 3))
    want = np.zeros(100)
    for a in range(100 - 48 + (how == "v1")):
        c = rgb[a : a + 48] / rgb[a : a + 48].mean(0)
        s1, s2 = c[:, 1] - c[:, 2], c[:, 1] + c[:, 2] - 2 * c[:, 0]
        h = s1 + s1.std() / s2.std() * s2
        want[a : a + 48] += h - h.mean()
    assert sg.plane_orthogonal(rgb, 30.0, how) == pytest.approx(want, abs=1e-12)


def test_minima_of_runs():
    x = np.random.default_rng(6).normal(size=50)
    for n in range(1, 51):
        assert sg.run_minima(x, n).tolist() == [x[k : k + n].min() for k in range(51 - n)]


def transforms(monkeypatch, work):
    """How many spectra `work` takes."""
    taken, rfft = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda *a, **k: taken.append(1) or rfft(*a, **k))
    work()
    return len(taken)


def test_a_scan_takes_few_transforms(monkeypatch):
    """All windows of all pulses share one, and no pulse is transformed for its rate alone."""
    kernels = []
    monkeypatch.setattr(sg, "per_row", lambda df, keys, arrays, kernel, schema: kernels.append(kernel))
    sg.scan_figures(None, [])
    t = np.arange(360) / 30
    colours = [100 + np.stack([0.3 * x, 0.8 * x, 0.5 * x], axis=1) for x in faces()[:3]]
    still = [50 + 0.05 * np.sin(3.1 * t), 40 + 0.05 * np.sin(1.7 * t), np.full(360, 100.0), 120 + np.sin(0.9 * t)]
    assert transforms(monkeypatch, lambda: kernels[0](t, *colours, *still)) <= 12


def test_a_pulse_is_not_searched_anew_for_every_beat(monkeypatch):
    """Prominences come of one pass over the maxima: a window's searches do not grow with its beats."""
    t, seen, plain = np.arange(60 * 64) / 64, [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda a: seen.append(1) or plain(a))
    assert bundle.pulse_features(np.sin(2 * np.pi * 1.3 * t), 64.0)["n_beats"] > 70 and len(seen) <= 4


def sessions(n):
    rng, t = np.random.default_rng(7), np.arange(130 * 64) / 64
    for k in range(n):
        yield {
            "BVP": [(1000.0, 64.0, np.sin(2 * np.pi * (1 + 0.05 * k) * t + np.sin(t / 7)) + rng.normal(0, 0.05, len(t)))], "EDA": [(1000.5, 4.0, 2 + np.cumsum(rng.normal(0, 0.02, 520)))],
            "HR": [(1010.0, 1.0, 70 + rng.normal(0, 3, 120))], "ACC": [(999.75, 32.0, rng.normal(0, 20, (130 * 32, 3)) + [0, 0, 64])],
        }


def test_windows_of_many_sessions_share_their_transforms(monkeypatch):
    """Transforms grow with the lengths of slices and of interval series, not with the windows; and each window's figures are those it has alone."""
    windows = [(pieces, a, a + 60) for pieces in sessions(10) for a in (1004.3, 1034.3, 1064.3)] + [({"HR": [(1000.0, 1.0, np.array([70.0]))], "EDA": [(1000.0, 4.0, np.ones(3))]}, 1000.0, 1060.0), ({}, 0.0, 60.0), ({}, None, 1.0)]
    together = []
    assert transforms(monkeypatch, lambda: together.extend(bundle.features_of(windows))) <= 20
    for k, window in enumerate(windows):
        for name, many, one in zip(bundle.FEATURES, together, bundle.features_of([window]), strict=True):
            assert many[k].as_py() == (one[0].as_py() if one[0].as_py() is None else pytest.approx(one[0].as_py(), rel=1e-9, abs=1e-12)), (k, name)
    monkeypatch.setattr(bundle, "MOST", 10_000)
    cut = bundle.features_of(windows)
    assert all(a.as_py() == b.as_py() or a.as_py() == pytest.approx(b.as_py(), rel=1e-9, abs=1e-12) for x, y in zip(together, cut, strict=True) for a, b in zip(x, y, strict=True))


def test_peaks_of_rows_are_those_of_each_row():
    rng = np.random.default_rng(3)
    x = np.stack([rng.normal(size=90), rng.integers(0, 4, 90).astype(float), np.cumsum(rng.normal(size=90)), np.zeros(90), np.arange(90.0), np.sin(np.arange(90.0))])
    for distance in (1, 5, 7.5):
        least = np.array([0.5, 1.0, 1.5, -np.inf, 0.1, 3.0])
        row, at = sg.peaks_of_rows(x, distance, least)
        assert [at[row == k].tolist() for k in range(len(x))] == [plain_peaks(x[k], distance, least[k]) for k in range(len(x))]
    assert [len(v) for v in sg.peaks_of_rows(x[:, :2], 3, 1.0)] == [0, 0] and len(sg.find_peaks(np.zeros(0))) == 0
