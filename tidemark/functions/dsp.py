"""Numeric kernels on one series: filters, spectra, peaks, beats.  Plain numpy, no Spark.

Zero-phase Butterworth filtering multiplies the spectrum by the squared magnitude of
the bilinear Butterworth response, which is what a forward and a backward pass do
together; the series is extended by odd reflection first.
"""

from __future__ import annotations

import functools

import numpy as np


def fill_gaps(x: np.ndarray) -> np.ndarray:
    """Linear between valid samples, the nearest at the ends, zeros if there are none."""
    x = np.asarray(x, float)
    ok = np.isfinite(x)
    if ok.all():
        return x
    if not ok.any():
        return np.zeros_like(x)
    at = np.arange(len(x))
    return np.interp(at, at[ok], x[ok])


def iqr_clip(x: np.ndarray, k: float) -> np.ndarray:
    ok = x[np.isfinite(x)]
    if len(ok) < 10:
        return x
    q1, q3 = np.percentile(ok, [25, 75])
    return np.clip(x, q1 - k * (q3 - q1), q3 + k * (q3 - q1))


@functools.lru_cache(maxsize=8)  # series after series have one length
def _gain(size: int, fs: float, order: int, low: float | None, high: float | None) -> np.ndarray:
    """The squared response of a Butterworth filter at the frequencies of ``rfft``."""
    warp = lambda f: np.tan(np.pi * np.minimum(f, 0.499999 * fs) / fs)
    w = warp(np.fft.rfftfreq(size, 1 / fs))
    with np.errstate(divide="ignore", over="ignore"):
        if low and high:
            ratio = (w**2 - warp(low) * warp(high)) / (w * (warp(high) - warp(low)))
        elif high:
            ratio = w / warp(high)
        else:
            ratio = warp(low) / w
        gain = 1 / (1 + ratio ** (2 * order))
    return gain


def zero_phase(x: np.ndarray, fs: float, order: int, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Band-pass (low and high), low-pass (high) or high-pass (low) Butterworth of ``order``, there and back."""
    x = np.asarray(x, float)
    if len(x) < 4:
        return x.copy()
    pad = min(len(x) - 1, int(np.ceil(3 * fs / max(low or high, 1e-6))))
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    size = 1 << (len(wide) - 1).bit_length()
    wide = np.concatenate([wide, np.full(size - len(wide), wide[-1])])
    return np.fft.irfft(np.fft.rfft(wide) * _gain(size, fs, order, low, high), size)[pad : pad + len(x)]


def median_filter(x: np.ndarray, kernel: int) -> np.ndarray:
    """Median of an odd kernel, zeros beyond the ends."""
    half = kernel // 2
    padded = np.concatenate([np.zeros(half), x, np.zeros(half)])
    out = np.empty(len(x))
    for at in range(0, len(x), 1 << 16):
        out[at : at + (1 << 16)] = np.median(np.lib.stride_tricks.sliding_window_view(padded[at : at + (1 << 16) + kernel - 1], kernel), axis=1)
    return out


#: Pass band in Hz of each filtered modality.
BANDS = {"ECG": (0.5, 40.0), "PPG": (0.4, 8.0), "Resp": (0.05, 1.0)}


def denoise(x: np.ndarray, fs: int, modality: str, clip: float) -> np.ndarray:
    """Gap filling, clipping, and the modality's filter."""
    x = iqr_clip(fill_gaps(x), clip)
    if modality in BANDS:
        low, high = BANDS[modality]
        return zero_phase(x, fs, 3, low, min(high, 0.95 * fs / 2))
    if modality == "EDA":
        x = median_filter(x, max(3, int(0.5 * fs) | 1))
        high = min(1.0, 0.8 * fs / 2)
        return zero_phase(x, fs, 2, high=high) if 0 < high < fs / 2 and len(x) > 15 else x
    return median_filter(x, max(3, int(3 * fs) | 1))


def skin_temperature(x: np.ndarray, fs: float = 4, cutoff: float = 0.1) -> np.ndarray:
    """Low-pass of order five at 0.1 Hz."""
    return zero_phase(x, fs, 5, high=cutoff)


def welch(x: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density of the last axis: periodic Hann windows, half overlapping, mean removed."""
    segment = min(segment, x.shape[-1])
    if segment < 2:
        return np.zeros(1), np.zeros((*x.shape[:-1], 1))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = np.lib.stride_tricks.sliding_window_view(x, segment, axis=-1)[..., :: max(1, segment - segment // 2), :]
    spectra = np.abs(np.fft.rfft((parts - parts.mean(axis=-1, keepdims=True)) * window)) ** 2
    power = spectra.mean(axis=-2) / (fs * (window**2).sum())
    power[..., 1 : None if segment % 2 else -1] *= 2
    return np.fft.rfftfreq(segment, 1 / fs), power


@functools.lru_cache(maxsize=8)
def _band_waves(segment: int, fs: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """A periodic Hann window, and the waves of the band's frequencies under it, scaled so that squares sum up to one-sided power times the length."""
    at = np.arange(segment)
    window, f = 0.5 - 0.5 * np.cos(2 * np.pi * at / segment), np.fft.rfftfreq(segment, 1 / fs)
    k = np.flatnonzero((f >= low) & (f <= high))
    scale = np.where((k == 0) | (2 * k == segment), 1.0, np.sqrt(2.0))
    angle = 2 * np.pi * (at[:, None] * k % segment) / segment
    return window**2, np.concatenate([np.cos(angle), np.sin(angle)], axis=1) * window[:, None] * np.tile(scale, 2)


def band_shares(x: np.ndarray, fs: float, band: tuple[float, float], segment: int) -> np.ndarray:
    """Share of the ``welch`` power of every row inside the band; 1 without any power.

    Only the band's frequencies are transformed: all the power is that of the windowed samples themselves.
    """
    segment = min(segment, x.shape[-1])
    if segment < 2:
        return np.ones(len(x))
    squares, waves = _band_waves(segment, fs, *band)
    parts = np.lib.stride_tricks.sliding_window_view(x, segment, axis=-1)[..., :: max(1, segment - segment // 2), :]
    parts = (parts - parts.mean(axis=-1, keepdims=True)).reshape(-1, segment)
    total = (np.square(parts) @ squares).reshape(len(x), -1).sum(axis=1) * segment
    inside = np.square(parts @ waves).sum(axis=1).reshape(len(x), -1).sum(axis=1)
    return np.where(total > 0, inside / np.where(total > 0, total, 1), 1.0)


def band_share(x: np.ndarray, fs: float, band: tuple[float, float], segment: int) -> float:
    """Share of the power inside the band; 1 without any power."""
    return float(band_shares(x[None], fs, band, segment)[0])


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    if n == 0:
        return np.zeros(0)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def moving_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Centred mean of an odd size over the samples there are."""
    half = size // 2
    total = np.concatenate([[0.0], np.cumsum(x)])
    low, high = np.maximum(np.arange(len(x)) - half, 0), np.minimum(np.arange(len(x)) + half + 1, len(x))
    return (total[high] - total[low]) / np.maximum(high - low, 1)


def block_means(x: np.ndarray, size: int) -> np.ndarray:
    """Means of adjacent blocks of ``size``; the last has what is left."""
    starts = np.arange(0, len(x), size)
    return np.add.reduceat(x, starts) / np.minimum(size, len(x) - starts) if len(x) else np.zeros(0)


def local_maxima(x: np.ndarray, distance: int, least: float) -> np.ndarray:
    """Maxima of at least ``least``; of those closer than ``distance`` the higher stays."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:])) + 1
    at = at[x[at] >= least]
    free, kept = np.ones(len(x), bool), []
    for i in at[np.argsort(-x[at], kind="stable")]:
        if free[i]:
            kept.append(i)
            free[max(0, i - distance + 1) : i + distance] = False
    return np.sort(np.array(kept, int))


def r_peaks(ecg: np.ndarray, fs: int) -> np.ndarray:
    """Heart beats: maxima of the ECG where its slope energy stands out."""
    steep = np.gradient(zero_phase(ecg, fs, 2, 5.0, min(20.0, 0.45 * fs))) ** 2
    energy = moving_mean(steep, int(0.12 * fs) | 1)
    hills = local_maxima(energy, int(0.3 * fs), 0.3 * np.percentile(energy, 98) if len(energy) else 0)
    reach = int(0.08 * fs)
    return np.unique([max(0, h - reach) + int(np.argmax(ecg[max(0, h - reach) : h + reach + 1])) for h in hills]).astype(int)


def ppg_peaks(ppg: np.ndarray, fs: int) -> np.ndarray:
    return local_maxima(ppg, int(0.35 * fs), float(np.mean(ppg) + 0.3 * np.std(ppg))) if len(ppg) else np.zeros(0, int)


def breaths(resp: np.ndarray, fs: int) -> tuple[np.ndarray, np.ndarray]:
    """Peaks and troughs, two seconds apart at least."""
    if not len(resp):
        return np.zeros(0, int), np.zeros(0, int)
    return local_maxima(resp, 2 * fs, float(resp.mean())), local_maxima(-resp, 2 * fs, float(-resp.mean()))


def sample_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float:
    """-log of the share of matching runs of m that still match at m + 1; NaN where undefined."""
    return float(sample_entropies(x[None], m, share)[0])


def sample_entropies(rows: np.ndarray, m: int = 2, share: float = 0.2) -> np.ndarray:
    """``sample_entropy`` of every row."""
    n, out = rows.shape[1], np.full(len(rows), np.nan)
    if n < m + 2:
        return out
    block = max(1, (1 << 16) // (n * n))  # distances that stay near the processor
    for at in range(0, len(rows), block):
        own = rows[at : at + block]
        r = share * own.std(axis=1)
        far = np.abs(own[:, :, None] - own[:, None, :])
        runs, found = far[:, : n - m, : n - m], []
        for k in range(1, m + 1):
            runs = np.maximum(runs, far[:, k : n - m + k, k : n - m + k])
            if k >= m - 1:
                found.append(np.count_nonzero(runs <= r[:, None, None], axis=(1, 2)) - (n - m))
        b, a = found if m > 1 else (np.count_nonzero(far[:, : n - m, : n - m] <= r[:, None, None], axis=(1, 2)) - (n - m), found[-1])
        ok = (r != 0) & (a != 0) & (b != 0)
        out[at : at + block][ok] = -np.log(a[ok] / b[ok])
    return out


def intervals(peaks: np.ndarray, fs: int) -> np.ndarray:
    """Milliseconds between beats; implausible ones interpolated over their number if over two are valid, else the median."""
    rr = np.diff(peaks) * 1000.0 / fs
    bad = (rr < 300) | (rr > 2000)
    if bad.any():
        good = np.flatnonzero(~bad)
        rr[bad] = np.interp(np.flatnonzero(bad), good, rr[good]) if len(good) > 2 else (np.median(rr[good]) if len(good) else np.nan)
    return rr


def hrv(peaks: np.ndarray, fs: int, window: float, step: float) -> dict[str, np.ndarray]:
    """Heart-rate variability of sliding windows that start at the first beat; NaN where under half a window's beats are there.

    An interval stands at the beat it begins with.
    """
    t = peaks[:-1] / fs
    rr = intervals(peaks, fs)
    names = ("SDNN", "RMSSD", "HF Power", "LF/HF", "SampEn", "pNN50")
    if not len(t):
        return {"t": np.zeros(0), **{n: np.zeros(0) for n in names}}
    starts = np.arange(t[0], t[-1] - window + 1e-9, step)
    first, last = np.searchsorted(t, starts), np.searchsorted(t, starts + window)
    table, sizes = np.full((len(starts), 6), np.nan), last - first
    even, full = {}, []  # windows by the length of their even series, and those that have enough beats
    for size in np.unique(sizes[sizes >= 4]):  # windows of as many beats together
        own = np.flatnonzero(sizes == size)
        rows = rr[first[own, None] + np.arange(size)]
        enough = ~(rows.sum(axis=1) / 1000 < 0.5 * window)
        own, rows = own[enough], rows[enough]
        steps = np.diff(rows, axis=1)
        table[own, 0], table[own, 1] = rows.std(axis=1, ddof=1), np.sqrt(np.mean(steps**2, axis=1))
        table[own, 4], table[own, 5] = sample_entropies(rows), 100 * np.mean(np.abs(steps) > 50, axis=1)
        full.extend(own)
    for k in full:
        at = t[first[k] : last[k]]
        x = np.interp(np.arange(at[0], at[-1], 0.25), at, rr[first[k] : last[k]])
        even.setdefault(len(x), []).append((k, x))
    for own in even.values():
        own, x = np.array([k for k, _ in own]), np.stack([x for _, x in own])
        f, p = welch(x, 4.0, 256)
        width = f[1] - f[0] if len(f) > 1 else 0.0
        lf, hf = (np.ascontiguousarray(p[:, inside]).sum(axis=1) * width for inside in ((f >= 0.04) & (f < 0.15), (f >= 0.15) & (f <= 0.4)))
        table[own, 2], table[own, 3] = hf, np.where(hf > 0, lf / np.where(hf > 0, hf, 1), np.nan)
    return {"t": starts + window / 2, **{n: table[:, k] for k, n in enumerate(names)}}


def tonic_by_high_pass(x: np.ndarray, fs: float, cutoff: float = 0.05) -> np.ndarray:
    """The slow part of skin conductance: what a second-order high-pass at ``cutoff`` Hz takes away."""
    return x - zero_phase(x, fs, 2, low=cutoff)


def scr_peaks(phasic: np.ndarray, fs: int) -> np.ndarray:
    return local_maxima(phasic, max(1, fs), max(0.01, 0.1 * float(phasic.max()))) if len(phasic) else np.zeros(0, int)


def rise_times(phasic: np.ndarray, peaks: np.ndarray, fs: int) -> np.ndarray:
    """Seconds from the onset of each peak, looked for up to five seconds back; NaN outside 0.1 to 5 s."""
    out = []
    for p in peaks:
        j = p - 1
        while j > max(0, p - 5 * fs) and phasic[j] > 0 and phasic[j] <= phasic[j + 1]:
            j -= 1
        rise = (p - j) / fs
        out.append(rise if 0.1 <= rise <= 5 else np.nan)
    return np.array(out, float)


def flat_samples(x: np.ndarray, size: int, least: float = 1e-6) -> np.ndarray:
    """Samples in half-overlapping windows whose standard deviation is below ``least``."""
    out, step = np.zeros(len(x), bool), max(1, size // 2)
    if len(x) < size or not size:
        return out
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
    block = max(1, (1 << 16) // size)
    for first in range(0, len(parts), block):
        for k in np.flatnonzero(parts[first : first + block].std(axis=1) < least):
            out[(first + k) * step : (first + k) * step + size] = True
    return out


def clipped_samples(x: np.ndarray) -> np.ndarray:
    low, high = np.percentile(x, [0.5, 99.5])
    return (x <= low) | (x >= high)


def wild_samples(x: np.ndarray, size: int, limit: float) -> np.ndarray:
    """Samples in adjacent windows whose range is a robust outlier among the windows."""
    out, n = np.zeros(len(x), bool), len(x) // size
    if n < 3:
        return out
    spread = np.ptp(x[: n * size].reshape(n, size), axis=1)
    mad = np.median(np.abs(spread - np.median(spread)))
    if mad >= 1e-10:
        out[: n * size] = np.repeat(np.abs(spread - np.median(spread)) / (1.4826 * mad) > limit, size)
    return out


def beat_quality(x: np.ndarray, peaks: np.ndarray, fs: int) -> np.ndarray:
    """Per sample the correlation of its beat with the mean beat."""
    before, after = int(0.25 * fs), int(0.4 * fs)
    inside = peaks[(peaks >= before) & (peaks + after <= len(x))]
    if len(inside) < 3:
        return np.zeros(len(x))
    beats = np.stack([x[p - before : p + after] for p in inside])
    middle = beats.mean(axis=0)
    centred = beats - beats.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(centred, axis=1) * np.linalg.norm(middle - middle.mean())
    r = np.where(norm > 0, centred @ (middle - middle.mean()) / np.where(norm > 0, norm, 1), 0)
    return np.interp(np.arange(len(x)), inside, r)


def bad_samples(x: np.ndarray, fs: int, modality: str) -> np.ndarray:
    """Any of the modality's checks: flat, clipped, wild, off-template, off-band or faint samples."""
    if len(x) < 2 * fs:
        return np.ones(len(x), bool)
    bad = flat_samples(x, (5 if modality == "Temp" else 1) * fs)
    if modality == "ECG":
        return bad | (beat_quality(x, r_peaks(x, fs), fs) < 0.7)
    if modality == "PPG":
        q = beat_quality(x, ppg_peaks(x, fs), fs)
        return bad | (q < 0.8 * q.mean()) | wild_samples(x, 5 * fs, 4.0) | clipped_samples(x)
    if modality == "Resp":
        for at in range(0, len(x) - 30 * fs + 1, 15 * fs):
            if band_share(x[at : at + 30 * fs], fs, (0.05, 1.0), 512) < 0.4:
                bad[at : at + 30 * fs] = True
        level = moving_mean(envelope(x - x.mean()), 5 * fs | 1)
        return bad | (level < 0.4 * np.median(level)) | wild_samples(x, 10 * fs, 4.0) | clipped_samples(x)
    return bad
