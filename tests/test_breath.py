import numpy as np

from tidemark.operators import breath as op

S = ["subject_id"]


def frame(spark, series):
    return spark.createDataFrame([(k, n, None if v is None else float(v)) for k, x in series.items() for n, v in enumerate(x)], "subject_id string, idx long, value double")


def test_volume_of_breaths_of_known_size(spark):
    t = np.arange(1200) / 10.0
    depth = np.where(t < 60, 1.0, 2.0)
    ripple = 0.05 * np.sin(2 * np.pi * 2 * t)  # no breaths
    rows = frame(spark, {"a": 5 + depth * np.sin(2 * np.pi * t / 4) + ripple})
    got = op.volume(rows, S, 10.0).toPandas().sort_values("idx")
    assert (got.period.iloc[20:-20] - 4).abs().max() < 0.5
    assert abs(got.volume.iloc[100:500].mean() - 2 / 4) < 0.06 and abs(got.volume.iloc[700:1100].mean() - 4 / 4) < 0.1
    turns = op.breaths(rows, S).toPandas().sort_values("idx").turn.dropna().tolist()
    assert turns == [1.0, -1.0] * 30


def test_plain_python(spark):
    rng = np.random.default_rng(4)
    series = {k: np.round(np.cumsum(rng.normal(size=n)), 1) for k, n in (("a", 300), ("b", 40), ("c", 1), ("flat", 5))}
    series["flat"] = np.ones(5)
    got = op.volume(frame(spark, series), S, 2.0).toPandas()
    for k, x in series.items():
        state, runs = 0, []
        for n, v in enumerate(x):
            side = 1 if v > x.mean() + 0.3 * x.std() else -1 if v < x.mean() - 0.3 * x.std() else state
            if side != state:
                runs.append((side, []))
                state = side
            if state:
                runs[-1][1].append(n)
        peaks = [min(r, key=lambda n: (-x[n], n)) for s, r in runs if s == 1]
        lows = [min(r, key=lambda n: (x[n], n)) for s, r in runs if s == -1]
        own = got[got.subject_id == k].sort_values("idx")
        if len(peaks) < 2 or not lows:
            assert own.volume.isna().all()
            continue
        at = np.arange(len(x))
        want = (np.interp(at, peaks, x[peaks]) - np.interp(at, lows, x[lows])) / np.interp(at, peaks[1:], np.diff(peaks) / 2.0)
        assert np.allclose(own.volume, want)


def test_gaps_and_empty_table(spark):
    rows = frame(spark, {"a": [None, 0, 5, None, 0, 5, 0, None, 5, 0], "none": [None, None]})
    got = op.volume(rows, S, 1.0).toPandas()
    assert len(got) == 12 and got[got.subject_id == "a"].volume.notna().all() and got[got.subject_id == "none"].volume.isna().all()
    assert op.volume(rows.limit(0), S, 1.0).count() == 0
