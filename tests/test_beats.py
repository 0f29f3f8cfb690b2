import numpy as np

from tidemark.operators import beats as op

S = ["subject_id"]


def regular(n=200, seed=1):
    """Beats about 800 ms apart, breathing slowly."""
    rng = np.random.default_rng(seed)
    return np.cumsum(800 + 30 * np.sin(np.arange(n) / 6) + rng.normal(size=n) * 4)


def frame(spark, series):
    return spark.createDataFrame([(k, float(t)) for k, ts in series.items() for t in ts], "subject_id string, t double")


def corrected(spark, series, **options):
    got = op.correct(frame(spark, series), S, **options).toPandas()
    return {k: np.sort(v.t.to_numpy()) for k, v in got.groupby("subject_id")}


def test_each_kind_is_found_and_repaired(spark):
    t = regular()
    early = t.copy()
    early[80] -= 300
    late = t.copy()
    late[80] += 300
    series = {"clean": t, "missed": np.delete(t, 80), "extra": np.sort(np.append(t, t[80] + 350)), "early": early, "late": late, "many": np.sort(np.append(np.delete(early, [20, 150]), t[120] + 400))}
    kinds = {(r.subject_id, r.kind) for r in op.classify(frame(spark, series), S).where("kind IS NOT NULL").collect()}
    assert not [k for k in kinds if k[0] == "clean"] and {("missed", "missed"), ("extra", "extra"), ("early", "ectopic"), ("late", "ectopic")} <= kinds
    got = corrected(spark, series)
    assert np.array_equal(got["clean"], t)
    for name in ("missed", "extra", "early", "late", "many"):
        assert len(got[name]) == len(t) and np.abs(got[name] - t).max() < 60, name


def test_edges_repeats_nulls_and_a_series_that_does_not_settle(spark):
    rows = frame(spark, {"one": [5.0], "two": [1.0, 2.0], "again": [100.0, 200.0, 200.0, 300.0], "even": list(np.arange(40) * 500.0)})
    rows = rows.union(spark.createDataFrame([("one", None)], "subject_id string, t double"))
    got = {k: list(v) for k, v in corrected(spark, {}, passes=1).items()}
    assert got == {}
    out = op.correct(rows, S).toPandas().groupby("subject_id").t.apply(sorted).to_dict()
    assert out == {"one": [5.0], "two": [1.0, 2.0], "again": [100.0, 200.0, 300.0], "even": list(np.arange(40) * 500.0)}
    wild = np.cumsum(np.random.default_rng(9).choice([300.0, 800.0, 1600.0], 300))
    first = corrected(spark, {"w": wild}, passes=1)["w"]
    assert first[0] == wild[0] and first[-1] == wild[-1]
    assert len(corrected(spark, {"w": wild})["w"]) > 100  # ends


def test_spectrum_of_a_sine_in_each_band(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(0.6 + 0.5 * rng.random(900))
    rows = []
    for name, f, amplitude in (("low", 0.1, 40.0), ("high", 0.25, 30.0)):
        rows += [(name, float(x), float(1000 + amplitude * np.sin(2 * np.pi * f * x + 1))) for x in t]
    got = op.windowed_spectrum(spark.createDataFrame(rows, "subject_id string, t double, rr double"), S, 60.0, 20.0).where("lf IS NOT NULL").toPandas().groupby("subject_id").mean(numeric_only=True)
    assert abs(got.lf["low"] / 800 - 1) < 0.15 and got.lf_hf["low"] > 10
    assert abs(got.hf["high"] / 450 - 1) < 0.15 and got.lf_hf["high"] < 0.1


def test_spectrum_against_a_least_squares_fit(spark):
    rng = np.random.default_rng(3)
    t, rr = np.cumsum(0.5 + rng.random(60)), 900 + 50 * rng.normal(size=60)
    rows = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, rr, strict=True)], "subject_id string, t double, rr double")
    for r in op.windowed_spectrum(rows, S, 20.0, 5.0).where("lf IS NOT NULL").collect():
        own = (t >= t[0] + 5 * r.w) & (t < t[0] + 5 * r.w + 20)
        y = rr[own] - rr[own].mean()
        power = {}
        for k in range(4, 40):
            design = np.stack([np.cos(2 * np.pi * k / 100 * t[own]), np.sin(2 * np.pi * k / 100 * t[own])], axis=1)
            fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
            power[k] = (y @ y - (y - fit) @ (y - fit)) / len(y)
        assert np.isclose(r.lf, 0.2 * sum(power[k] for k in range(4, 15))) and np.isclose(r.hf, 0.2 * sum(power[k] for k in range(15, 40)))
