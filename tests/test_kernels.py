"""Numeric kernels against closed forms, tables and naive loops."""

import math
import time
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import dsp, stats
from tidemark.operators import divergence as dv
from tidemark.operators import segment as sg

RNG = np.random.default_rng(5)


def naive_dtw(x, y, slope=1.0, band=None):
    d = np.full((len(x), len(y)), np.inf)
    for i in range(len(x)):
        for j in range(len(y)):
            if band is not None and abs(i - j) > band:
                continue
            c = math.dist(x[i], y[j])
            options = [d[i - 1, j - 1] if i and j else (0 if i == j == 0 else np.inf), slope * d[i - 1, j] if i else np.inf, slope * d[i, j - 1] if j else np.inf]
            d[i, j] = c + min(options)
    return d


@pytest.mark.parametrize(("n", "m"), [(1, 1), (1, 5), (7, 1), (6, 9), (12, 12)])
@pytest.mark.parametrize(("slope", "band"), [(1.0, None), (1.5, None), (1.0, 8), (2.0, 9)])
def test_warping(n, m, slope, band):
    x, y = RNG.random((n, 3)), RNG.random((m, 3))
    want = naive_dtw(x, y, slope, band)
    got = dv.accumulated(dv.local_costs(x, y), band, slope)
    assert np.allclose(got, want)
    path = dv.warping_path(got)
    assert path[0] == (0, 0) and path[-1] == (n - 1, m - 1) and all((b[0] - a[0], b[1] - a[1]) in {(1, 1), (1, 0), (0, 1)} for a, b in zip(path, path[1:]))
    assert dv.dtw_distance(x, x) == 0 and dv.dtw_distance(x, y) == pytest.approx(dv.dtw_distance(y, x))


def test_warping_golden_and_errors():
    x, y = np.array([0.0, 1, 2]), np.array([0.0, 2])
    assert dv.dtw_distance(x, y) == 1 and dv.warping_path(dv.accumulated(dv.local_costs(x, y))) == [(0, 0), (1, 0), (2, 1)]
    with pytest.raises(ValueError, match="band"):
        dv.dtw_distance(x, y, band=0)
    with pytest.raises(ValueError, match="rows"):
        dv.dtw_distance(x[:0], y)
    with pytest.raises(ValueError, match="metric"):
        dv.dtw_distance(x, y, "no")
    assert dv.dtw_distance(x, y, "cityblock") == 1 and dv.dtw_distance(x, y, "sqeuclidean") == 1 and dv.dtw_distance(x, y, lambda a, b: abs(a - b)[0]) == 1


def naive_divergence(ref, test, alpha=0.5):
    both = np.concatenate([test, ref])
    d2 = [((a - b) ** 2).sum() for a, b in combinations(both, 2)]
    sigma2 = 0.5 * np.median([d for d in d2 if d > 0])
    k = lambda a, b: math.exp(-((a - b) ** 2).sum() / (2 * sigma2))
    kd, kn = np.array([[k(c, r) for r in ref] for c in test]), np.array([[k(c, t) for t in test] for c in test])
    h = (1 - alpha) / len(ref) * kd @ kd.T + alpha / len(test) * kn @ kn.T
    theta = np.linalg.solve(h + 0.1 * np.eye(len(test)), kn.mean(1))
    gn, gd = theta @ kn, theta @ kd
    return gn.mean() - 0.5 * (alpha * (gn**2).mean() + (1 - alpha) * (gd**2).mean()) - 0.5


def test_relative_divergence():
    a, b = RNG.random((20, 4)), RNG.random((30, 4)) + 0.7
    assert dv.relative_divergence(a, b) == pytest.approx(naive_divergence(a, b))
    assert dv.segment_divergence(a, a) == 0 and dv.segment_divergence(a, b) > 0.01 and dv.segment_divergence(a[:4], b) == 0
    many = RNG.random((300, 2))
    assert dv.relative_divergence(many[:100], many) == dv.relative_divergence(many[:100], many)
    assert dv.segment_divergence(np.ones((6, 2)), np.ones((6, 2))) == 0


def naive_cost(x, s, e, gamma):
    k = np.exp(-gamma * ((x[s:e, None] - x[None, s:e]) ** 2).sum(-1))
    return np.trace(k) - k.sum() / (e - s)


def naive_cuts(x, penalty, min_size, jump=1):
    d2 = [((a - b) ** 2).sum() for a, b in combinations(x, 2)]
    gamma = 1 / (np.median(d2) or 1.0)
    inner = [c for c in range(jump, len(x), jump) if c >= min_size]
    best, cuts = np.inf, None
    for k in range(len(inner) + 1):
        for chosen in combinations(inner, k):
            ends = [0, *chosen, len(x)]
            if all(b - a >= min_size for a, b in zip(ends, ends[1:])):
                total = sum(naive_cost(x, a, b, gamma) + penalty for a, b in zip(ends, ends[1:]))
                if total < best - 1e-12:
                    best, cuts = total, list(chosen)
    return cuts, best


@pytest.mark.parametrize(("penalty", "min_size", "jump"), [(0.3, 2, 1), (1.0, 3, 1), (0.3, 3, 2), (50.0, 2, 1)])
def test_segmentation_is_exact(penalty, min_size, jump):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = np.concatenate([rng.normal(m, 0.2, (5, 2)) for m in (0, 2, 0.5)])[:14]
        got = sg.best_cuts(sg.Cost(x), len(x), penalty, min_size, jump)
        assert got == naive_cuts(x, penalty, min_size, jump)[0]


def test_segmentation_properties():
    x = np.concatenate([RNG.normal(m, 0.1, (30, 3)) for m in (0, 1, 0, 3)])
    cost = sg.Cost(x)
    counts = [len(sg.best_cuts(cost, len(x), p, 5)) for p in (0.1, 0.5, 1, 5, 20, 100)]
    assert counts == sorted(counts, reverse=True) and sg.best_cuts(cost, len(x), 1.0, 10) == [30, 60, 90]
    assert sg.best_cuts(sg.Cost(x[:5]), 5, 1.0, 10) == [] and sg.best_cuts(sg.Cost(x[:0]), 0, 1.0, 10) == []
    for model in ("l1", "l2"):
        assert sg.best_cuts(sg.Cost(x, model), len(x), 5.0, 10) == [30, 60, 90]
    with pytest.raises(ValueError, match="kernel"):
        sg.Cost(x, "no")
    k = np.array([[1, 0.5], [0.5, 1]])
    assert np.trace(k) - k.sum() / 2 == 0.5


def test_filters_on_sines():
    fs, t = 200, np.arange(4000) / 200
    low, mid = np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 5 * t)
    out = dsp.zero_phase(low + mid, fs, 3, 0.5, 40.0)
    assert np.abs(out - mid)[400:-400].max() < 0.02
    gain = 1 / (1 + (np.tan(np.pi * 10 / fs) / np.tan(np.pi * 10 / fs)) ** 6)
    half = dsp.zero_phase(np.sin(2 * np.pi * 10 * t), fs, 3, high=10.0)
    assert np.abs(half[500:-500]).max() == pytest.approx(gain, abs=0.01)
    steady = dsp.skin_temperature(np.full(200, 33.0))
    assert np.allclose(steady, 33.0, atol=1e-6)
    assert dsp.zero_phase(np.array([1.0, 2.0]), fs, 3, 0.5, 40.0).tolist() == [1, 2]


def test_spectra_and_envelope():
    fs, t = 64, np.arange(64 * 30) / 64
    f, p = dsp.welch(np.sin(2 * np.pi * 8 * t), fs, 256)
    assert f[np.argmax(p)] == 8 and p.sum() * f[1] == pytest.approx(0.5, rel=0.01)
    assert dsp.band_share(np.sin(2 * np.pi * 2 * t), fs, (0.5, 3.0), 256) > 0.99 and dsp.band_share(np.zeros(100), fs, (0, 1), 64) == 1
    assert np.allclose(dsp.envelope(np.cos(2 * np.pi * 4 * t[:640])), 1, atol=1e-6) and len(dsp.envelope(np.zeros(0))) == 0


def test_median_gap_and_clip_goldens():
    assert dsp.median_filter(np.array([5.0, 6, 7]), 3).tolist() == [5, 6, 6]
    assert dsp.fill_gaps(np.array([np.nan, 1, np.nan, 3, np.nan])).tolist() == [1, 1, 2, 3, 3] and dsp.fill_gaps(np.full(3, np.nan)).tolist() == [0, 0, 0]
    x = np.array([*range(20), 1000.0])
    assert dsp.iqr_clip(x, 1.0).max() == 15 + 10 and dsp.iqr_clip(x[:5], 1.0).tolist() == x[:5].tolist()


def test_beats_and_breaths_of_known_rates():
    fs, t = 200, np.arange(200 * 60) / 200
    beat = t % (60 / 72)
    ecg = np.exp(-((beat - 0.3) ** 2) / (2 * 0.012**2)) + 0.01 * RNG.standard_normal(len(t))
    peaks = dsp.r_peaks(ecg, fs)
    assert abs(len(peaks) - 72) <= 1 and np.abs(np.diff(peaks) / fs - 60 / 72).max() < 0.02
    found = dsp.hrv(peaks, fs, 30, 1)
    assert np.abs(60000 / dsp.intervals(peaks, fs) - 72).max() < 2 and len(found["t"]) > 20 and np.nanmax(found["SDNN"]) < 10
    tops, lows = dsp.breaths(np.sin(2 * np.pi * 0.25 * t), 200)
    assert abs(len(tops) - 15) <= 1 and abs(len(lows) - 15) <= 1
    assert len(dsp.ppg_peaks(np.zeros(0), 100)) == 0 and dsp.hrv(np.array([5]), 100, 30, 1)["t"].size == 0


def test_quality_flags():
    x = np.concatenate([np.sin(np.arange(2000) / 7), np.zeros(500), np.sin(np.arange(500) / 7)])
    flat = dsp.flat_samples(x, 100)
    assert flat[2000:2500].all() and not flat[:1900].any()
    wild = x.copy()
    wild[300:320] += 50
    assert dsp.wild_samples(wild, 100, 6.0)[300:320].all() and not dsp.wild_samples(np.ones(500), 100, 4.0).any()
    assert dsp.bad_samples(np.zeros(50), 100, "Temp").all()
    assert dsp.sample_entropy(np.ones(10)) != dsp.sample_entropy(np.ones(10)) and dsp.sample_entropy(np.tile([1.0, 2.0], 20)) < 0.2


def test_tail_probabilities():
    # tabulated: t = 2.228 at 10 degrees of freedom and 12.706 at one are two-sided 5 %
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and stats.t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)
    assert stats.t_two_sided(0, 5) == pytest.approx(1) and math.isnan(stats.t_two_sided(1, 0))
    # exact signed-rank distribution: n = 5, all positive -> 2 / 32; n = 6 -> 2 / 64
    assert stats.signed_rank_p(5, 0, 0) == 2 / 32 and stats.signed_rank_p(6, 2, 0) == pytest.approx(2 * 3 / 64)
    assert stats.signed_rank_p(0, 0, 0) == 1 and stats.signed_rank_p(1, 0, 0) == 1
    assert 0 < stats.signed_rank_p(6, 2.0, 30.0) < 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=2, max_size=12), st.lists(st.floats(-5, 5), min_size=2, max_size=12))
def test_warping_is_symmetric_and_bounded(a, b):
    x, y = np.array(a), np.array(b)
    d = dv.dtw_distance(x, y)
    assert d == pytest.approx(dv.dtw_distance(y, x)) and d >= abs(x[0] - y[0]) - 1e-9
    assert dv.dtw_distance(x, y, band=max(len(a), len(b))) == pytest.approx(d)


def test_many_pairs_are_scored_as_each_alone():
    rng = np.random.default_rng(7)
    pairs = [tuple(rng.random((rng.integers(1, 33), 3)).round(1) * (rng.random((1, 3)) < 0.6) for _ in range(2)) for _ in range(400)]
    pairs += [(rng.random((6, 3)), rng.random((130, 3))), (rng.random((130, 3)), rng.random((6, 3))), (np.full((6, 3), np.nan), rng.random((9, 3)))]
    for metric, band, slope in (("euclidean", None, 1.0), ("cityblock", 2, 1.5), ("sqeuclidean", 0, 1.0), (lambda a, b: float(abs(a - b).max()), 1, 1.0)):
        some = pairs[:60] if callable(metric) else pairs[:-1]
        want = [dv.dtw_distance(a, b, metric, None if band is None else max(band, abs(len(a) - len(b))), slope) for a, b in some]
        np.testing.assert_allclose(dv.dtw_distances(some, metric, band, slope), want, rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(dv.segment_divergences(pairs), [dv.segment_divergence(a, b) for a, b in pairs], rtol=1e-9, atol=1e-12)
    with pytest.raises(ValueError, match="rows in both"):
        dv.dtw_distances([(pairs[0][0][:0], pairs[0][1])])
    many, began = [(rng.random((35, 3)), rng.random((33, 3))) for _ in range(3000)], time.time()
    dv.dtw_distances(many)
    assert time.time() - began < 3  # one by one: 3 ms each
