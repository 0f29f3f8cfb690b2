"""Series as long as recordings at their raw rate: each operator's work must grow with the samples, not with samples times windows."""

import time

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import frames, joins, quality

S = ["subject_id"]


def long_series(spark, n, rate=1.0):
    rows = spark.range(n).select(F.lit("a").alias("subject_id"), F.col("id").alias("idx"), (F.col("id") / rate).alias("t"), F.sin(F.col("id") / 50.0).alias("value"))
    return rows.withColumn("value", F.when(F.col("idx") % 10 < 7, F.col("value")))


def test_gaps_of_a_long_series(spark):
    n, began = 400_000, time.time()
    got = frames.gap_fill(long_series(spark, n), S).agg(F.count("filled"), F.sum("filled")).head()
    x = np.sin(np.arange(n) / 50.0)
    ok = np.arange(n) % 10 < 7
    want = np.interp(np.arange(n), np.flatnonzero(ok), x[ok])
    assert got[0] == n and abs(got[1] - want.sum()) < 1e-6 and time.time() - began < 60


def test_resampling_a_long_series(spark):
    n, began = 300_000, time.time()
    points = long_series(spark, n).select("subject_id", (F.col("idx") * 0.1).alias("t"), "value")
    got = frames.resample(points, S, 0.25).agg(F.count("value"), F.sum("value")).head()
    t = np.arange(n) * 0.1
    ok = np.arange(n) % 10 < 7
    grid = np.arange(int(np.floor((t[ok][-1] - t[ok][0]) / 0.25)) + 1) * 0.25
    want = np.interp(grid, t[ok], np.sin(np.arange(n) / 50.0)[ok])
    assert got[0] == len(grid) and abs(got[1] - want.sum()) < 1e-5 and time.time() - began < 60


def test_windows_of_thirty_seconds_at_two_hundred_hertz(spark):
    n, window, step, began = 540_000, 6000, 200, time.time()
    x = np.where(np.arange(n) % 10 < 7, np.sin(np.arange(n) / 50.0), np.nan)
    starts = np.arange(0, n - window + 1, step)
    parts = np.lib.stride_tricks.sliding_window_view(x, window)[::step]
    for how, want in (("mean", np.nanmean(parts, axis=1)), ("std", np.nanstd(parts, axis=1)), ("sum", np.nansum(parts, axis=1))):
        got = frames.sliding(long_series(spark, n), S, window, step, 200.0, how).orderBy("w").toPandas()
        assert list(got.t) == list((starts + window / 2) / 200.0) and np.allclose(got.value, want, atol=1e-9)
    assert time.time() - began < 90


def test_panes_of_odd_sizes_and_sparse_windows(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(97) < 0.5, rng.normal(size=97) + 1e6, np.nan)
    rows = spark.createDataFrame([("a", n, None if np.isnan(v) else float(v)) for n, v in enumerate(x)], "subject_id string, idx long, value double")
    for window, step in ((7, 3), (12, 8), (5, 5), (4, 10), (97, 2), (98, 2)):
        got = {r.w: r.value for r in frames.sliding(rows, S, window, step, how="std").collect()}
        want = {k: (np.nanstd(x[s : s + window]) if np.isfinite(x[s : s + window]).sum() >= int(0.5 * window) and np.isfinite(x[s : s + window]).any() else None) for k, s in enumerate(range(0, 97 - window + 1, step))}
        assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-7) for k in want)


def test_flat_windows_of_even_and_odd_length(spark):
    x = np.concatenate([np.arange(9.0), np.full(14, 3.0), np.arange(12.0), np.full(5, 1.0)])
    rows = spark.createDataFrame([("a", n, float(v)) for n, v in enumerate(x)], "subject_id string, idx long, value double")
    for window in (4, 5, 7, 1):
        want = np.zeros(len(x), bool)
        for s in range(0, len(x) - window + 1, max(1, window // 2)):
            if x[s : s + window].std() < 1e-3:
                want[s : s + window] = True
        got = frames.flatline(rows, S, window, 1e-3).orderBy("idx").collect()
        assert [r.flat for r in got] == want.tolist()


def test_transit_and_quality_of_a_long_recording(spark):
    n, fs, began = 400_000, 200, time.time()
    rows = long_series(spark, n, fs).withColumn("value", F.when(F.col("idx") % 160 == 50, 5.0).otherwise(0.0))
    beats = spark.range(0, n, 160).select(F.lit("a").alias("subject_id"), F.col("id").alias("beat"))
    found = joins.first_peak_after(beats, rows, S, fs)
    assert found.agg(F.count("*"), F.min("ptt"), F.max("ptt")).head() == (n // 160 - 1, 250.0, 250.0)
    windows = spark.range(15, n // fs - 15).select(F.lit("a").alias("subject_id"), F.col("id").alias("w"), F.col("id").cast("double").alias("t"))
    q = rows.withColumn("q", (F.col("idx") % 400 < 100).cast("double"))
    got = quality.windowed_quality(windows, q, S, 30.0).agg(F.count("*"), F.min("q"), F.max("q")).head()
    assert got == (n // fs - 30, 0.25, 0.25) and time.time() - began < 90


def test_points_in_overlapping_and_disjoint_spans(spark):
    rng = np.random.default_rng(5)
    points = [(k, float(t), n) for n, (k, t) in enumerate(zip(rng.choice(["a", "b"], 300), rng.integers(0, 400, 300) / 4, strict=True))]
    spans = [(k, float(a), float(a + d), n) for n, (k, a, d) in enumerate(zip(rng.choice(["a", "c"], 80), rng.integers(-20, 400, 80) / 4, rng.integers(0, 21, 80) / 4, strict=True))]
    p, s = spark.createDataFrame(points, "subject_id string, at double, point int"), spark.createDataFrame(spans, "subject_id string, low double, high double, span int")
    got = {(r.point, r.span) for r in joins.within(p, s, S, "at", "low", "high", 5.0).collect()}
    assert got == {(n, m) for k, t, n in points for j, a, b, m in spans if k == j and a <= t < b} and len(got) > 100
    apart = [("a", 10.0 * k, 10.0 * k + 6, k) for k in range(9)] + [("a", 95.0, None, 99)]
    s = spark.createDataFrame(apart, "subject_id string, low double, high double, span int")
    got = {(r.point, r.span) for r in joins.covering(p, s, S, "at", "low", "high", ["span"]).collect()}
    assert got == {(n, m) for k, t, n in points for j, a, b, m in apart if k == j and b is not None and a <= t <= b} and len(got) > 50


def test_pairs_of_three_thousand_segments(spark):
    """Every pair once, and a segment goes to as many tasks as there are blocks."""
    from tidemark.operators import divergence

    began = time.time()
    data = spark.range(3000).select(F.lit("a").alias("subject_id"), F.col("id").cast("int").alias("seg"), F.array(F.array(F.col("id").cast("double"))).alias("data"))
    data = data.unionByName(spark.range(3).select(F.lit("b").alias("subject_id"), (F.col("id") * 10).cast("int").alias("seg"), F.array(F.array(F.col("id").cast("double"))).alias("data")))
    found = divergence.pair_distances(data, S, ("DTW",))
    wrong = F.count(F.when((F.col("d") != F.when(F.col("subject_id") == "a", F.col("seg_j") - F.col("seg_i")).otherwise((F.col("seg_j") - F.col("seg_i")) / 10)) | (F.col("seg_i") >= F.col("seg_j")), 1))
    got = found.where("subject_id = 'b' OR seg_i % 60 = 7").groupBy("subject_id").agg(F.count("*").alias("n"), F.countDistinct("seg_i", "seg_j").alias("m"), wrong.alias("wrong")).collect()
    want = sum(2999 - i for i in range(7, 3000, 60))
    assert {tuple(r) for r in got} == {("a", want, want, 0), ("b", 3, 3, 0)} and time.time() - began < 240


def test_generated_series_are_made_in_all_tasks(spark):
    """Of few subjects, whose table is small, many rows are made: sized by bytes, one task would make them all."""
    from tidemark.plans import catalogue
    from tidemark.sources import synthetic

    people = catalogue.sessions(spark, "/root/testdata/sf0.01")
    for made in (synthetic.regimes(spark, people), synthetic.distance_tables(spark, subjects=people)):
        assert made.select(F.spark_partition_id()).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions")) // 2


def test_recordings_are_read_once(spark, tmp_path):
    """Many small files are dear to open: what is found in them stays when they are gone, also in files that are split."""
    from tidemark import sources

    for name, lines in (("a", 300), ("b.c", 2)):
        (tmp_path / f"{name}.txt").write_text("# header\n" * 2 + "".join(f"{k} {'NaN' if k % 3 else k / 4}\n" for k in range(lines)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        found = sources.read_recordings(spark, f"file://{tmp_path}", 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in ("a", "b.c"):
        (tmp_path / f"{name}.txt").unlink()
    got = {tuple(r) for r in found.collect()}
    assert got == {(name, k, c, float(k) if c == 1 else None if k % 3 else k / 4) for name, lines in (("a", 300), ("b.c", 2)) for k in range(lines) for c in (1, 2)}
