"""Whole series go to their kernels without a shuffle of their samples where they are made in order, and in any case in order and whole."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import frames
from tidemark.plans import catalogue


@pytest.mark.parametrize("name", ["composite_quality", "signal_quality", "denoised_signals", "full_features"])
def test_made_samples_stay_in_the_task_that_makes_them(spark, name):
    """The samples of a session are many times its events: shuffled, those of 90,000 users filled the disks."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    kernels = [n for n, line in enumerate(plan) if "MapInArrow" in line]
    assert kernels and not any("FlatMapGroups" in line for line in plan)
    for at in kernels:
        below = [line for line in plan[at:] if "Generate explode" in line or "Exchange" in line]
        assert "Generate explode" in below[0]


@pytest.mark.parametrize("together", [False, True])
@pytest.mark.parametrize("size", [1, 3, 100])
def test_series_are_cut_where_keys_change_not_where_batches_do(together, size):
    rows = [("a", "x", 4, 1.0), ("a", "x", 4, None), ("a", "y", 2, 3.0), ("b", "y", 2, 4.0), ("b", "y", 2, 5.0), ("b", "y", 2, 6.0), ("b", "y", 2, 7.0)]
    firsts = {0, 2, 3}
    columns = [[r[c] if c == 3 or n in firsts or not together else None for n, r in enumerate(rows)] for c in range(4)]
    table = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.float64()), strict=True)], names=["s", "m", "fs", "value"])
    batches = [pa.RecordBatch.from_arrays([], names=[])] + table.to_batches(max_chunksize=size)
    got = list(frames.whole_series(iter(batches), ["s", "m"], together))
    assert [(key, fs) for key, fs, _ in got] == [(("a", "x"), 4), (("a", "y"), 2), (("b", "y"), 2)]
    for (_, _, x), want in zip(got, ([1, np.nan], [3], [4, 5, 6, 7]), strict=True):
        np.testing.assert_array_equal(x, want)


def test_samples_in_any_order_give_the_same_features(spark):
    from tidemark.plans.features import raw_features
    from tidemark.sources import synthetic

    samples = synthetic.physiology(spark, 2, 60)
    made, mixed = (raw_features(s, together=t).toPandas().sort_values(["subject_id", "feature", "w"], ignore_index=True) for s, t in ((samples, True), (samples.orderBy("value"), False)))
    assert len(made) and made.equals(mixed)


SMALL = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_store_of_samples_has_few_files_whatever_the_subjects(spark, tmp_path):
    from tidemark import sources

    rows = spark.range(3000).selectExpr("cast(id % 300 AS string) AS subject_id", "'EDA' AS modality", "4 AS fs", "id AS idx", "id * 0.5D AS value")
    sources.save_samples(rows, f"file://{tmp_path}/store")
    files = list((tmp_path / "store").rglob("*.parquet"))
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = sources.read_samples(spark, f"file://{tmp_path}/store")
    assert sorted((r.subject_id, r.idx, r.value) for r in kept.collect()) == sorted((r.subject_id, r.idx, r.value) for r in rows.collect())


@pytest.mark.parametrize("name", ["segment_events", "affective_flag", "event_merge"])
def test_generated_times_are_never_broadcast(spark, name):
    """Their size is guessed from the rows that they are generated of."""
    lines = physical(catalogue.QUERIES[name](spark, SMALL)).splitlines()
    joins = [line for line in lines if "Join" in line and ("start#" in line or "end#" in line)]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_the_streams_files_are_written_by_many_tasks(spark):
    from pathlib import Path

    base = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.glob("stream-*"))
    catalogue.QUERIES["online_rulsif"](spark, SMALL)
    counts = [len(list(f.glob("part-*.parquet"))) for f in set(base.glob("stream-*")) - before if not f.name.startswith(("stream-scores", "stream-state"))]
    assert counts and counts[0] > 3


def test_series_made_by_their_tasks_are_the_samples_of_spark(spark):
    """Made sample by sample in Spark and handed to Python, those of 90,000 users take most of an hour."""
    from tidemark.sources import synthetic

    people = spark.createDataFrame([("7", 1.31, 0.27), (None, 1.0, 0.2), ("a name of more than thirty-two bytes", 1.17, 0.23)], "subject_id string, heart_hz double, breath_hz double")
    want = {k: own.sort_values("idx") for k, own in synthetic.physiology(spark, people, 45).toPandas().groupby(["subject_id", "modality"], dropna=False)}
    rows = synthetic.series(spark, people, 45).toArrow().to_batches()
    got = {(str(s), m): (fs, x) for (s, m), fs, x in synthetic.made_series(rows)}
    assert len(got) == len(want) == 15
    for (subject, m), own in want.items():
        fs, x = got[subject if isinstance(subject, str) else "None", m]
        assert set(own.fs) == {fs}
        np.testing.assert_allclose(x, own["value"], rtol=0, atol=1e-13)


def test_no_row_per_sample_is_made_for_the_features(spark):
    assert "MapInArrow" in physical(catalogue.QUERIES["full_features"](spark, SMALL)) and "sequence(0" not in physical(catalogue.QUERIES["full_features"](spark, SMALL))


def test_windows_of_as_many_beats_are_scored_together(monkeypatch):
    from tidemark.functions import dsp

    calls = []
    one = dsp.sample_entropies
    monkeypatch.setattr(dsp, "sample_entropies", lambda rows: calls.append(len(rows)) or one(rows))
    rng = np.random.default_rng(3)
    peaks = np.cumsum(rng.integers(150, 200, 170))
    found = dsp.hrv(peaks, 200, 30.0, 1.0)
    assert sum(calls) == len(found["t"]) and len(calls) <= 8
    t, rr = peaks[:-1] / 200, np.diff(peaks) * 5.0
    for k, start in enumerate(np.arange(t[0], t[-1] - 30 + 1e-9, 1.0)):
        own = rr[(t >= start) & (t < start + 30)]
        far = lambda n: sum(max(abs(own[i : i + n] - own[j : j + n])) <= 0.2 * own.std() for i in range(len(own) - 2) for j in range(len(own) - 2) if i != j)  # noqa: B023, E731
        assert found["SampEn"][k] == pytest.approx(-np.log(far(3) / far(2)) if far(3) else np.nan, nan_ok=True)
        assert found["SDNN"][k] == pytest.approx(own.std(ddof=1)) and found["pNN50"][k] == pytest.approx(100 * np.mean(abs(np.diff(own)) > 50))


@pytest.mark.parametrize("name", ["signal_quality", "composite_quality", "denoised_signals"])
def test_no_row_per_sample_is_made_for_the_quality(spark, name):
    """One pass over the sessions, a row for every series."""
    plan = physical(catalogue.QUERIES[name](spark, SMALL))
    assert plan.count("MapInArrow") == 1 and "sequence(0" not in plan


@pytest.mark.parametrize("size", [1, 2, 5, 8])
def test_flat_windows_are_found_many_at_a_time(monkeypatch, size):
    from tidemark.functions import dsp

    x = np.repeat(np.random.default_rng(1).normal(size=40), np.arange(40) % 9 + 1)
    want = np.zeros(len(x), bool)
    for at in range(0, len(x) - size + 1, max(1, size // 2)):
        if x[at : at + size].std() < 1e-6:
            want[at : at + size] = True
    stacks, view = [], np.lib.stride_tricks.sliding_window_view
    monkeypatch.setattr(np.lib.stride_tricks, "sliding_window_view", lambda *a: stacks.append(a) or view(*a))
    np.testing.assert_array_equal(dsp.flat_samples(x, size), want)
    assert len(stacks) == 1


def test_no_segment_of_a_run_is_broadcast(spark, monkeypatch):
    """The segments of 540,000 users fill the driver, though their file is small enough to be broadcast."""
    from tidemark.plans import regimes

    plans, real = [], regimes.written
    monkeypatch.setattr(regimes, "written", lambda df, *name: plans.append(physical(df)) or real(df, *name))
    plans.append(physical(catalogue.QUERIES["pipeline_synthetic"](spark, SMALL)))
    joined = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert joined and not any("Broadcast" in line for line in joined)


def test_a_run_from_samples_takes_a_row_for_every_series(spark, monkeypatch):
    from tidemark.plans import regimes

    seen = []
    monkeypatch.setattr(regimes, "run", lambda samples, *_, **how: seen.append((samples, how)) or regimes.Result(*[spark.createDataFrame([("a",)], "subject_id string")] * 7))
    catalogue.QUERIES["run_from_samples"](spark, SMALL)
    samples, how = seen[0]
    assert how["made"] and samples.count() == 5 * samples.select("subject_id").distinct().count()
