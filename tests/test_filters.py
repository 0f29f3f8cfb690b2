import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters as op

S = ["subject_id"]


def response(sections, f, fs):
    z = np.exp(-2j * np.pi * f / fs)
    return np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sections])


def test_design():
    assert np.allclose(op.butterworth(2, 2.0, high=0.5), [[0.29289322, 0.58578644, 0.29289322, 1, 0, 0.17157288]])
    assert np.allclose(op.butterworth(1, 2.0, low=0.5), [[0.5, -0.5, 0, 1, 0, 0]])
    for order in (1, 2, 3, 5, 8):
        low, high, band = op.butterworth(order, 100, high=7.0), op.butterworth(order, 100, low=7.0), op.butterworth(order, 100, 3.0, 20.0)
        for f in (0.7, 3.0, 7.0, 12.0, 20.0, 41.0):
            warped = lambda g: np.tan(np.pi * g / 100)
            ratio = warped(f) / warped(7.0)
            centre = (warped(f) ** 2 - warped(3.0) * warped(20.0)) / (warped(f) * (warped(20.0) - warped(3.0)))
            assert np.isclose(abs(response(low, f, 100)) ** 2, 1 / (1 + ratio ** (2 * order)), rtol=1e-6)
            assert np.isclose(abs(response(high, f, 100)) ** 2, 1 / (1 + ratio ** (-2 * order)), rtol=1e-6)
            assert np.isclose(abs(response(band, f, 100)) ** 2, 1 / (1 + centre ** (2 * order)), rtol=1e-6)
        assert op.System.of(low).order == order and op.System.of(band).pad == 3 * (2 * order + 1)
    for bad in ({"high": 50.0}, {"low": 0.0}, {"low": 9.0, "high": 5.0}, {}):
        with pytest.raises(ValueError):
            op.butterworth(2, 100, **bad)


def by_sample(sections, x):
    """There and back, one sample after the other."""
    system = op.System.of(sections)
    pad = min(system.pad, len(x) - 1)
    x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        state, gain = [], 1.0
        for b0, b1, b2, _, a1, a2 in sections:
            y = gain * (b0 + b1 + b2) / (1 + a1 + a2)
            state.append([(y - b0 * gain) * x[0], (b2 * gain - a2 * y) * x[0]])
            gain = y
        out = []
        for v in x:
            for s, (b0, b1, b2, _, a1, a2) in zip(state, sections, strict=True):
                y = b0 * v + s[0]
                s[0], s[1] = b1 * v - a1 * y + s[1], b2 * v - a2 * y
                v = y
            out.append(v)
        x = np.array(out)[::-1]
    return x[pad : len(x) - pad]


@pytest.mark.parametrize("sections", [op.butterworth(5, 4.0, high=0.1), op.butterworth(3, 200.0, 0.5, 40.0), op.butterworth(3, 100.0, 0.05, 1.0)])
def test_blocks_against_one_sample_after_the_other(spark, sections):
    rng = np.random.default_rng(1)
    series = {name: np.cumsum(rng.normal(size=n)) + 30 for name, n in (("a", 1), ("b", 2), ("c", 17), ("d", op.BLOCK - 42), ("e", 3 * op.BLOCK - 42), ("f", 2300))}
    rows = spark.createDataFrame([(k, n, float(v)) for k, x in series.items() for n, v in enumerate(x)], "subject_id string, idx long, value double")
    got = op.zero_phase(rows.repartition(7), S, sections).toPandas()
    for name, x in series.items():
        own = got[got.subject_id == name].sort_values("idx")
        assert own.idx.tolist() == list(range(len(x))) and np.allclose(own.filtered, by_sample(sections, x), rtol=1e-7, atol=1e-7)


def test_a_sine_passes_and_a_drift_does_not(spark):
    n, fs = 300_000, 200.0
    t = F.col("id") / fs
    rows = spark.range(n).select(F.lit("a").alias("subject_id"), F.col("id").alias("idx"), F.when(F.col("id") % 50 != 7, F.sin(2 * np.pi * 10 * t) + 5 + t / 100).alias("value"))
    got = op.band_pass(rows, S, fs, 0.5, 40.0).where("idx BETWEEN 2000 AND 298000").select((F.col("filtered") - F.sin(2 * np.pi * 10 * F.col("idx") / fs)).alias("e"))
    assert got.agg(F.count("e"), F.max(F.abs("e"))).head()[1] < 0.1


def test_denoising_of_short_series_and_gaps(spark):
    rows = spark.createDataFrame([("a", n, None if n == 3 else float(n % 5)) for n in range(12)] + [("b", n, float(n % 7)) for n in range(60)] + [("c", 0, None)], "subject_id string, idx long, value double")
    for modality in ("EDA", "Temp", "Resp"):
        got = op.denoise(rows, S, modality, 4.0, 4.0).toPandas()
        assert len(got) == 73 and got.clean.notna().all()
