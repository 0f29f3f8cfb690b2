"""Relational operators: hand-derived goldens, edge cases and whole-table comparisons with SQL."""

import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import sources
from tidemark.functions import dsp, stats
from tidemark.operators import detect, divergence, frames, joins, quality, rdi, segment, validate
from tidemark.plans import catalogue, features, regimes
from tidemark.schema import CLIP_RANGES, EVENT_ALIASES, MODALITY_CHANNEL
from tidemark.sources import synthetic
from tidemark.streaming import online_divergence

K = ["k"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def series(spark, values):
    return spark.createDataFrame([("a", i, None if v is None else float(v)) for i, v in enumerate(values)], "k string, idx long, value double")


def column(df, name, order="idx"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_window_goldens(spark):
    assert [(r.t, r.value) for r in frames.sliding(series(spark, [1.0, 2, 3, 4, 5, 6]), K, 3, 2).orderBy("w").collect()] == [(1.5, 2.0), (3.5, 4.0)]
    assert column(frames.gap_fill(series(spark, [None, 1.0, None, 3.0, None]), K), "filled") == [1, 1, 2, 3, 3]
    assert column(frames.gap_fill(series(spark, [None, None]), K), "filled") == [0, 0]
    assert column(frames.gradient(series(spark, [0.0, 1, 4]), K), "gradient") == [1, 2, 3]
    assert column(frames.gradient(series(spark, [7.0]), K), "gradient") == [None]
    assert column(frames.median_filter(series(spark, [5.0, 6, 7]), K, 3), "median") == [5, 6, 6]
    assert column(frames.moving_average(series(spark, [1.0, 2, 3, 10]), K, 3), "tonic") == pytest.approx([4 / 3, 2, 5, 23 / 3])
    assert column(frames.decimate(series(spark, [float(i) for i in range(200)]), 50), "value") == [0, 50, 100, 150]
    assert column(frames.change_from_previous(series(spark, [1.0, 3, 2]), K, "idx", "value"), "spike") == [0, 2, 0]
    assert sorted(column(frames.average_rank(series(spark, [5.0, 7, 5]), K, "value"), "rank")) == [1, 2.5, 2.5]
    few = frames.sliding(series(spark, [1.0, None, None, None, 2, 3, 4, 5]), K, 4, 4).orderBy("w").collect()
    assert [r.value for r in few] == [None, 3.5]


def test_normalisation_edges(spark):
    assert column(frames.robust_normalise(series(spark, [1.0, None, 2, 3]), K), "norm") == [0, 0, 0, 0]
    assert column(frames.robust_normalise(series(spark, [4.0] * 5 + [None]), K), "norm") == [0.5] * 5 + [None]
    assert column(frames.minmax_normalise(series(spark, [2.0, 2, None]), K), "norm") == [0, 0, None]
    assert column(frames.standardise(series(spark, [2.0, 2]), K), "z") == [0, 0]
    assert column(frames.iqr_clip(series(spark, [1.0, 100, 2]), K, 1.0), "clipped") == [1, 100, 2]
    assert column(frames.iqr_clip(series(spark, [None, *map(float, range(20)), 1000.0]), K, 1.0), "clipped")[-1] == pytest.approx(25)
    assert frames.drop_constant(series(spark, [1.0, 1.0]), K).count() == 0 and frames.drop_sparse(series(spark, [1.0] * 9 + [None]), K).count() == 0


def test_quality_goldens(spark):
    q = lambda v: column(quality.step_quality(series(spark, v), K, 20), "q", "w")
    assert q([1.0] * 20) == [0] and q([0.0, 1.0] * 10) == [0] and q([float(i) for i in range(20)]) == [1] and q([0.0, 1.0]) == [1]


def test_events_on_bounds_and_in_gaps(spark):
    times = spark.createDataFrame([("a", w, 15.0 + w) for w in range(6)], "k string, w int, t double")
    segs = spark.createDataFrame([("a", 0, 0, 3), ("a", 1, 3, 6)], "k string, seg int, start int, end int")
    hits = spark.createDataFrame([("a", 17.0, "x"), ("a", 17.5, "gap"), ("a", 18.0, "y"), ("a", 18.0, "y")], "k string, t double, name string")
    assert [r.events for r in joins.events_by_segment(segs, times, hits, K).orderBy("seg").collect()] == [["x"], ["y", "y"]]
    names = spark.createDataFrame([(["Brake 1", "Crash", "Brake 4"],), ([],)], "events array<string>")
    assert [r.merged for r in joins.merge_event_names(names, EVENT_ALIASES).collect()] == [["Brake", "Crash"], []]
    assert [r.is_event for r in joins.affective(names, ["Crash"]).collect()] == [True, False]


def test_label_expansion_and_outliers(spark):
    rec = spark.createDataFrame([("a", i, i == 2) for i in range(6)] + [("b", 0, False)], "k string, idx int, hit boolean")
    assert [(r.k, r.y) for r in joins.expand_labels(rec, K, "idx", "hit", [0, 1, 9]).orderBy("k", "idx").collect()] == [("a", 0), ("a", 0), ("a", 1), ("a", 1), ("a", 0), ("a", 0), ("b", 0)]
    scored = spark.createDataFrame([("a", s, float(s)) for s in range(5)], "k string, seg int, consensus double")
    assert [r.outlier for r in rdi.outliers(scored, K).orderBy("seg").collect()] == [False, False, False, True, True]


def test_paths_bands_and_phases(spark):
    data = spark.createDataFrame([("a", 0, [[0.0], [1.0], [2.0]]), ("a", 1, [[0.0], [2.0]]), ("a", 2, [[5.0]])], "k string, seg int, data array<array<double>>")
    paths = {(r.seg_i, r.seg_j): (r.d, [tuple(c) for c in r.path]) for r in divergence.warping_paths(data, K).collect()}
    assert paths[0, 1] == (1, [(0, 0), (1, 0), (2, 1)]) and paths[1, 2] == (8, [(0, 0), (1, 0)])
    assert {r.d for r in divergence.pair_distances(data, K, ("DTW",), normalise=False, band=0).where("seg_i = 0 AND seg_j = 1").collect()} == {1.0}
    whole = sorted(map(tuple, divergence.pair_distances(data, K).collect()))
    assert len(whole) == 6 and sorted(map(tuple, divergence.pair_distances(data, K, per_task=1).collect())) == whole  # shares of one pair
    assert divergence.pair_distances(data.where("seg = 0"), K).collect() == []
    units = spark.createDataFrame([(i, float(i), i % 2) for i in range(30)], "unit int, score double, phase int")
    found = {r.comparison: r for r in validate.phase_permutations(units, {"late": ("unit >= 15", "unit < 15"), "none": ("phase = 7", "phase = 1")}, 100).collect()}
    assert found["late"].p <= 0.05 and found["none"].p == 1


def test_consensus_golden_and_single_segment(spark):
    d = [("a", i, j, m, x) for m, row in (("DTW", (1, 3, 2)), ("RuLSIF", (0, 0, 0)), ("Cohen's d", (2, 2, 0))) for (i, j), x in zip(((0, 1), (0, 2), (1, 2)), map(float, row))]
    dist = spark.createDataFrame(d, "k string, seg_i int, seg_j int, method string, d double")
    segs = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0)], "k string, seg int")
    got = {(r.k, r.seg): r.consensus for r in rdi.consensus(rdi.mean_distances(dist, segs, K, ("DTW", "RuLSIF", "Cohen's d")), K).collect()}
    assert got == {("a", 0): pytest.approx(0.6), ("a", 1): pytest.approx(0.366667, abs=1e-6), ("a", 2): pytest.approx(0.5), ("b", 0): 0.0}


def test_effect_size_golden(spark):
    rows = [("a", s, w, f, v) for s, vals in ((0, (1.0, 2, 3)), (1, (4.0, 5, 6))) for w, v0 in enumerate(vals) for f, v in (("f", v0), ("g", 1.0))]
    feats = spark.createDataFrame([("a", s * 3 + w, f, float(v)) for _, s, w, f, v in rows], "k string, w int, feature string, norm double")
    segs = spark.createDataFrame([("a", 0, 0, 3), ("a", 1, 3, 6)], "k string, seg int, start int, end int")
    assert divergence.effect_sizes(segment.segment_stats(feats, segs, K), K).head().d == pytest.approx(math.sqrt(9 / 2))


def test_statistics_goldens(spark):
    u = spark.createDataFrame([("a", 3.0, True), ("a", 4.0, True), ("a", 1.0, False), ("a", 3.0, False), ("b", 1.0, True)], "k string, score double, is_event boolean")
    assert [(r.u, r.r) for r in validate.rank_biserial(u, K).collect()] == [(3.5, 0.75)]
    h = validate.holm(spark.createDataFrame([("a", 0, 0.01), ("a", 1, 0.04), ("a", 2, 0.03)], "k string, idx int, p double"), K)
    assert column(h, "p_holm") == pytest.approx([0.03, 0.06, 0.06])
    units = spark.createDataFrame([("a", i, float(i), i >= 15) for i in range(20)] + [("b", i, 1.0, False) for i in range(3)], "k string, unit int, score double, is_event boolean")
    found = {r.k: r for r in validate.permutation_seeded(units, K, 500, 1).collect()}
    assert found["a"].p <= 0.01 and found["a"].delta == 10 and (found["b"].delta, found["b"].p) == (0, 1)
    hashed = {r.k: r for r in validate.permutation_hashed(units, K, 200).collect()}
    assert hashed["a"].p <= 0.02 and hashed["a"].delta == 10 and tuple(hashed["b"]) == ("b", 0, 1, 0)
    t = validate.paired_t(spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, d double"), K).head()
    assert t.t == pytest.approx(2.5 / (np.std([1, 2, 3, 4], ddof=1) / 2)) and 0.02 < t.p < 0.04


def test_auc_and_roc(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(s), int(y)) for s, y in zip(rng.integers(0, 12, 60), rng.integers(0, 2, 60))]
    df = spark.createDataFrame(rows, "k string, score double, y int")
    pairs = [(0.5 if a == b else float(a > b)) for _, a, y in rows if y for _, b, z in rows if not z]
    area = validate.auc(df, K).head().auc
    assert area == pytest.approx(np.mean(pairs))
    assert validate.auc(df.withColumn("score", -F.col("score")), K).head().auc == pytest.approx(1 - area)
    p = validate.roc_points(df, K).orderBy("fpr", "tpr").toPandas()
    assert np.trapezoid([0, *p.tpr], [0, *p.fpr]) == pytest.approx(area) and p.tpr.iloc[-1] == 1


def test_ranks_sum_to_known_fusion(spark):
    rows = [("a", i, i, i >= 0, [] if i else ["E"], float(9 - i), float(9 - i), None, float(9 - i)) for i in range(6)]
    rec = spark.createDataFrame(rows, "subject string, seg_idx int, x int, in_experiment boolean, events array<string>, consensus double, dtw double, rulsif double, cohens_d double")
    first = detect.fuse(detect.score_columns(rec)).orderBy("pos").head()
    assert first.rrf == pytest.approx(8 / 61) and first.rank_fusion == -1
    dedup = detect.keep_strongest_event(rec.withColumn("group", F.lit("g")).withColumn("events", F.array(F.lit("E"))), "E", "g", ["E"])
    assert [r.seg_idx for r in dedup.where("has_affective").collect()] == [0]


def test_peak_transit_window(spark):
    beats = spark.createDataFrame([("a", 100 * b) for b in range(12)], "k string, beat long")
    wave = spark.createDataFrame([("a", i, 1.0 if i % 100 in (25, 26) else 0.0) for i in range(1200)], "k string, idx long, value double")
    got = joins.first_peak_after(beats, wave, K, 100, 0.1, 0.5).collect()
    assert sorted(r.beat for r in got) == [100 * b for b in range(11)] and all(r.ptt == 250 for r in got)  # the last beat has no successor
    assert joins.first_peak_after(beats.limit(5), wave, K, 100).count() == 0


def test_synthetic_regimes_end_to_end(spark):
    table = synthetic.regimes(spark, 2).withColumn("t", F.col("w").cast("double"))
    events = spark.createDataFrame([("S0", 90.0, "Crash"), ("S1", 190.0, "Brake")], "subject_id string, t double, name string")
    result = regimes.run_features(table, events, regimes.Options(n_perm=50))
    cuts = result.boundaries.toPandas()
    for _, own in cuts.groupby("subject_id"):
        assert all(min(abs(own.cp - c)) <= 3 for c in synthetic.REGIME_CUTS)
    fixed = spark.createDataFrame([("S0", s, a, b) for s, (a, b) in enumerate(zip((0, *synthetic.REGIME_CUTS), (*synthetic.REGIME_CUTS, 200)))], "subject_id string, seg int, start int, end int")
    own = table.where("subject_id = 'S0'")
    scored = rdi.score_segments(regimes.all_distances(own, fixed, ["subject_id"], regimes.Options.methods), fixed, ["subject_id"], regimes.Options.methods).orderBy(F.desc("consensus")).collect()
    assert {r.seg for r in scored[:2]} == set(synthetic.REGIME_OUTLIERS) and all(0 <= r.consensus <= 1 for r in scored)
    assert result.events.where("is_event").count() == 2 and {r.p for r in result.permutation.collect()} <= {x / 50 for x in range(51)}


def test_features_of_known_rates(spark):
    samples = synthetic.physiology(spark, 1, 120)
    raw = features.raw_features(samples).toPandas().dropna()
    mean = raw.groupby("feature").raw.mean()
    assert mean["Inst HR"] == pytest.approx(72, abs=1.5) and mean["Pulse Rate"] == pytest.approx(72, abs=1.5)
    assert mean["Breath Rate"] == pytest.approx(15, abs=0.5) and mean["Skin Temp"] == pytest.approx(33.1, abs=0.2) and 100 < mean["PTT"] < 500
    table = features.feature_table(spark.createDataFrame(raw)).toPandas()
    assert table.norm.between(0, 1).all() and table.groupby("feature").w.max().nunique() == 1 and len(set(table.feature)) >= 14


def test_streaming_scores_match_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [("a", w, [float(x) for x in rng.random(2) + (w > 20)]) for w in range(40)]
    batch = spark.createDataFrame(rows, "subject_id string, w long, x array<double>")
    want = {r.w: r.d for r in divergence.sliding_divergence(batch, ["subject_id"], 6).where("d IS NOT NULL").collect()}
    for n in range(4):
        batch.where(f"w div 10 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_divergence(stream, half=6).writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.w: r.d for r in spark.table("online").collect()}
    assert set(want) <= set(got) and all(got[w] == pytest.approx(want[w]) for w in want)


def test_recordings_stamps_ratings_and_store(spark, tmp_path):
    header = "\n".join(f"h{i}" for i in range(20))
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "P01.txt").write_text(header + "\n1 2 3\n 4\t5 \nx 7 8 9\n")
    got = {(r.row_idx, r.channel): r.value for r in sources.read_recordings(spark, str(tmp_path / "r")).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (0, 3): 3, (0, 4): None, (1, 1): 4, (1, 2): 5, (1, 3): None, (1, 4): None, (2, 1): None, (2, 2): 7, (2, 3): 8, (2, 4): 9}
    raw = spark.range(4000).select(F.lit("P").alias("subject_id"), F.col("id").alias("row_idx"), F.lit(MODALITY_CHANNEL["EDA"]).alias("channel"), F.col("id").cast("double").alias("value"))
    assert [r.value for r in sources.modality_samples(raw).orderBy("idx").collect()] == [0, 500, 1000, 1500, 2000, 2500, 3000, 3500]
    window = spark.createDataFrame([("P", 0.5, 1.0)], "subject_id string, t0 double, t1 double")
    assert [r.value for r in sources.modality_samples(raw, window=window).orderBy("idx").collect()] == [1000, 1500]
    stamps = spark.createDataFrame([("P", "Data Start", 2024, 1, 1, 10, 0, 0), ("P", "Video Start", 2024, 1, 1, 10, 0, 30), ("P", "Crash", 2024, 1, 1, 10, 1, None), ("P", "Early", 2024, 1, 1, 10, 0, 5)], "subject_id string, event string, year int, month int, day int, hour int, minute int, second int")
    assert {r.event: r.t for r in sources.relative_stamps(stamps).collect()} == {"Video Start": 0, "Crash": 30}
    (tmp_path / "q.csv").write_text("subject,emotion,condition,rating\nP, Joy ,Before,3\nP,joy,AFTER,4\nP,fear,before,x\nP,fear,after,2\n")
    assert [tuple(r) for r in joins.paired_ratings(sources.read_ratings(spark, str(tmp_path / "q.csv")), "before", "after").collect()] == [("P", "joy", 3, 4)]
    (tmp_path / "c.json").write_text('{"subject": "P", "seg_idx": 0, "events": ["Crash"], "in_experiment": true, "consensus": 0.5, "dtw": 1.0, "cohens_d": 2.0}\n')
    assert sources.read_records(spark, str(tmp_path / "c.json"), "g").head().rulsif is None
    sources.save_scored(spark.createDataFrame([("P", 1.0)], "subject_id string, z double"), str(tmp_path / "store"))
    assert sources.load_scored(spark, str(tmp_path / "store")).head().z == 1


def test_store_of_many_subjects_has_few_files(spark, tmp_path):
    rows = spark.range(600).select(F.concat(F.lit("00"), F.col("id") % 300).alias("subject_id"), F.col("id").cast("double").alias("z")).repartition(4)
    sources.save_scored(rows, str(tmp_path / "store"))
    assert len(list((tmp_path / "store").rglob("*.parquet"))) <= 8
    back = sources.load_scored(spark, str(tmp_path / "store"))
    assert sorted((r.subject_id, r.z) for r in back.collect()) == sorted(map(tuple, rows.collect()))
    assert back.select("subject_id", F.input_file_name()).distinct().count() == 300  # one file each


def test_partitioning_and_order_do_not_matter(spark):
    rows = catalogue.samples(spark, "/root/testdata/sf0.001")
    plain = frames.sliding(rows, ["subject_id"], 10, 2)
    mixed = frames.sliding(rows.orderBy(F.rand(3)).repartition(5), ["subject_id"], 10, 2)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, mixed.collect()))


#: Queries without SQL, and what each is compared with.
BY_HAND = {}


def by_hand(name):
    def register(f):
        BY_HAND[name] = f
        return f

    return register


SMALL = "/root/testdata/sf0.001"


def signals(spark, seconds):
    """Values of the users' sessions in plain arrays: {subject: {modality: (rate, values)}}."""
    out = {}
    for (s, m), own in synthetic.physiology(spark, catalogue.sessions(spark, SMALL), seconds).toPandas().groupby(["subject_id", "modality"]):
        out.setdefault(s, {})[m] = (int(own["fs"].iloc[0]), own.sort_values("idx")["value"].to_numpy(float))
    return out


@by_hand("denoised_signals")
def _(spark, got):
    for subject, own in signals(spark, 60).items():
        for m, (fs, x) in own.items():
            clean = got[(got.subject_id == subject) & (got.modality == m)].sort_values("second").clean.to_numpy(float)
            want = dsp.denoise(x, fs, m, CLIP_RANGES[m])
            np.testing.assert_allclose(clean, want.reshape(60, fs).mean(axis=1), atol=1e-5)
            assert want.std() < x.std() * 1.05  # the reflection at an edge can swing a little further than the signal


@by_hand("signal_quality")
def _(spark, got):
    want = {}
    for subject, own in signals(spark, 90).items():
        for m, band, least, size in (("PPG", (0.5, 3.0), 0.3, 256), ("Resp", (0.05, 1.0), 0.4, 512)):
            fs, x = own[m]
            for w, start in enumerate(range(0, len(x) - 30 * fs + 1, fs)):
                part = x[start : start + 30 * fs]
                starts = range(0, len(part) - size + 1, size // 2)
                power = sum(np.abs(np.fft.rfft((part[a : a + size] - part[a : a + size].mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)))) ** 2 for a in starts)
                power[1:-1] *= 2
                f = np.arange(size // 2 + 1) * fs / size
                want[subject, m, w] = float(power[(f >= band[0]) & (f <= band[1])].sum() >= least * power.sum())
    assert {(r.subject_id, r.modality, r.w): r.q for r in got.itertuples()} == want


@by_hand("composite_quality")
def _(spark, got):
    own = signals(spark, 60)
    want = {(s, m): 1 - dsp.bad_samples(x, fs, m).mean() for s, all_ in own.items() for m, (fs, x) in all_.items() if m != "EDA"}
    assert {(r.subject_id, r.modality): r.good for r in got.itertuples()} == pytest.approx(want, abs=1e-6)


def normalised(raw):
    """{feature: (t, raw, norm)} of a session's features, by plain arrays."""
    raw = {n: (t, v) for n, (t, v) in raw.items() if len(v)}
    short, out = min(len(v) for _, v in raw.values()), {}
    for name, (t, v) in raw.items():
        t, v = t[:short], v[:short]
        ok = v[np.isfinite(v)]
        if not len(ok) or ok.std() < 1e-10:
            continue
        if len(ok) < 5:  # too few to normalise: zeros throughout, and so nothing is missing
            out[name] = (t, v, np.zeros(len(v)))
            continue
        if np.isnan(v).mean() >= 0.1:
            continue
        low, high = np.percentile(ok, [2, 98])
        out[name] = (t, v, dsp.fill_gaps(np.clip((v - low) / (high - low), 0, 1)))
    return out


@by_hand("full_features")
def _(spark, got):
    for subject, own in signals(spark, 120).items():
        want = normalised(features.session_features(own))
        mine = got[got.subject_id == subject]
        assert set(mine.feature) == set(want)
        for name, (t, raw, norm) in want.items():
            rows = mine[mine.feature == name].sort_values("w")
            np.testing.assert_allclose(rows.t, t, atol=1e-6)
            np.testing.assert_allclose(rows.raw.to_numpy(float), raw, atol=1e-5)
            np.testing.assert_allclose(rows.norm.to_numpy(float), norm, atol=1e-5)


def scored(x, cuts):
    """Consensus of the segments of rows x between cuts, by plain loops over the three distances."""
    ends = list(zip([0, *cuts], [*cuts, len(x)]))
    parts = [x[a:b] for a, b in ends]
    k = len(parts)

    def effect(a, b):
        if len(a) < 3 or len(b) < 3:
            return 0.0
        pooled = np.sqrt(((len(a) - 1) * a.var(axis=0, ddof=1) + (len(b) - 1) * b.var(axis=0, ddof=1)) / (len(a) + len(b) - 2))
        return float(np.sqrt(np.mean(np.where(pooled > 1e-12, (a.mean(axis=0) - b.mean(axis=0)) / np.where(pooled > 1e-12, pooled, 1), 0) ** 2)))

    total = np.zeros((3, k))
    for i in range(k):
        for j in range(i + 1, k):
            a, b = parts[i], parts[j]
            for m, d in enumerate((divergence.dtw_distance(a, b) / max(len(a), len(b)), divergence.segment_divergence(a, b), effect(a, b))):
                total[m, i] += d
                total[m, j] += d
    mean = total / max(1, k - 1)
    top = mean.max(axis=1, keepdims=True)
    return ends, np.where(top > 0, mean / np.where(top > 0, top, 1), mean).mean(axis=0)


@by_hand("pipeline_synthetic")
def _(spark, got):
    table = synthetic.regimes(spark, catalogue.sessions(spark, SMALL)).toPandas()
    for subject, own in table.groupby("subject_id"):
        x = own.pivot(index="w", columns="feature", values="norm").sort_index().to_numpy(float)
        ends, want = scored(x, segment.best_cuts(segment.Cost(x), len(x), 1.0, 10))
        mine = got[got.subject_id == subject].sort_values("seg")
        assert list(zip(mine.start, mine.end)) == ends
        np.testing.assert_allclose(mine.consensus, want, atol=1e-5)


@by_hand("run_from_samples")
def _(spark, got):
    when = {r.subject_id: r.t for r in catalogue.session_events(spark, SMALL).collect()}
    for subject, own in signals(spark, 150).items():
        made = normalised(features.session_features(own))
        x = np.column_stack([made[n][2] for n in sorted(made)])
        cuts = segment.best_cuts(segment.Cost(x), len(x), 1.0, 10)
        ends, want = scored(x, cuts)
        mine = got[got.subject_id == subject].sort_values("seg")
        assert list(zip(mine.start, mine.end)) == ends
        np.testing.assert_allclose(mine.consensus, want, atol=1e-4)
        t = made[sorted(made)[0]][0]
        at = when[subject]
        hit = np.array([t[a] <= at <= t[b - 1] for a, b in ends])
        delta = want[hit].mean() - want[~hit].mean() if 0 < hit.sum() < len(hit) else 0.0
        assert mine.delta.iloc[0] == pytest.approx(delta, abs=1e-4) and 0 <= mine.p.iloc[0] <= 1


@by_hand("permutation_test_seeded")
def _(spark, got):
    rows = catalogue.records(spark, "/root/testdata/sf0.001").toPandas()
    for subject, own in rows.groupby("subject"):
        own = own.sort_values("seg_idx")
        x, flag = own.consensus.to_numpy(float), np.array(["Error" in e for e in own.events])
        mine = got[got.subject == subject].iloc[0]
        if not flag.any() or flag.all():
            assert tuple(mine[["delta", "p", "null_mean"]]) == (0, 1, 0)
            continue
        delta = x[flag].mean() - x[~flag].mean()
        # Few units: every choice of the event's places, weighed equally.
        choices = [np.isin(np.arange(len(x)), c) for c in itertools.combinations(range(len(x)), int(flag.sum()))]
        exact = np.mean([x[c].mean() - x[~c].mean() >= delta - 1e-12 for c in choices])
        assert mine.delta == pytest.approx(delta, abs=1e-6) and mine.p == pytest.approx(exact, abs=0.03) and abs(mine.null_mean) < 0.02


@by_hand("synthetic_consensus")
def _(spark, got):
    table = synthetic.distance_tables(spark, subjects=catalogue.sessions(spark, SMALL)).toPandas()
    assert set(got.subject_id) == set(table.subject_id) and len(set(got.subject_id)) > 5
    for subject, own in table.groupby("subject_id"):
        mean = {m: np.array([d.d[(d.seg_i == k) | (d.seg_j == k)].sum() / 5 for k in range(6)]) for m, d in own.groupby("method")}
        want = np.mean([v / v.max() for v in mean.values()], axis=0)
        np.testing.assert_allclose(got[got.subject_id == subject].sort_values("seg").consensus, want, atol=1e-6)
        assert set(np.argsort(want)[-2:]) == {2, 5}


@by_hand("skin_decomposition")
def _(spark, got):
    from tests.test_skin import is_minimum

    rows = catalogue.samples(spark, SMALL).toPandas()
    assert len(got) == len(rows)
    for subject, own in rows.groupby("subject_id"):
        is_minimum(own.sort_values("idx").value.to_numpy() / 100, got[got.subject_id == subject].sort_values("idx"))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_queries_without_sql_against_plain_python(spark, name):
    BY_HAND[name](spark, catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas())


def test_divergence_of_halves_by_hand():
    """The first half is the test side; a direct form of the estimator on six rows."""
    frame = np.array([[0.0, 1.0], [0.2, 0.8], [0.1, 1.1], [2.0, 0.9], [2.1, 1.0], [1.8, 1.2]])
    z = frame / frame.std(axis=0)
    test, ref = z[:3], z[3:]
    gap = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=2)
    both = np.concatenate([test, ref])
    width = np.median([gap(both, both)[i, j] for i in range(6) for j in range(i)])
    kt, kr = np.exp(-gap(test, test) / width), np.exp(-gap(test, ref) / width)
    w = np.linalg.solve(0.5 * kr @ kr.T / 3 + 0.5 * kt @ kt.T / 3 + 0.1 * np.eye(3), kt.mean(axis=1))
    want = (w @ kt).mean() - 0.25 * ((w @ kt) ** 2).mean() - 0.25 * ((w @ kr) ** 2).mean() - 0.5
    assert divergence.frame_divergence(frame, 3) == pytest.approx(want)
    assert divergence.frame_divergence(frame[::-1], 3) != pytest.approx(want, abs=1e-3)


def test_missing_and_ragged_vectors(spark):
    x = [[0.0]] * 10 + [[5.0]] * 10
    rows = [("a", w, [None] if w in (3, 12) else v) for w, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, w int, x array<double>")
    assert [r.cp for r in segment.boundaries(df, K, [0.5], 3).collect()] == [10]
    with pytest.raises(Exception, match="differ in length"):
        segment.boundaries(spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [1.0, 2.0])], "k string, w int, x array<double>"), K).collect()
    spread = lambda rows: float(np.ptp(rows, axis=0).sum()) * len(rows)
    assert [r.cp for r in segment.boundaries(df.where("x[0] IS NOT NULL"), K, [0.5], 3, model=spread).collect()] == [9]


def test_ranges_change_no_statistic(spark):
    rng = np.random.default_rng(8)
    rows = [(k, float(s), bool(y)) for k in "ab" for s, y in zip(rng.integers(0, 40, 300) / 7, rng.integers(0, 2, 300))]
    df = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "k string, score double, hit boolean, n int").repartition(5)
    labelled = df.withColumn("y", F.col("hit").cast("int"))
    for ranges in (1, 3, 50):
        for f in (lambda r: validate.rank_biserial(df, K, "score", "hit", r), lambda r: validate.roc_points(labelled, K, ranges=r), lambda r: validate.signed_rank(df, K, "score", ranges=r)):
            near = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
            assert near(f(ranges)) == near(f(0))
    found = detect.cumulative_detection(labelled, ties=("n",)).orderBy("k").collect()
    best = sorted(labelled.collect(), key=lambda r: (-r.score, -r.n))
    assert [r.k for r in found] == list(range(1, 601)) and [round(r.precision * r.k) for r in found] == list(np.cumsum([r.y for r in best]))
    assert detect.inspection_point(detect.cumulative_detection(labelled, ties=("n",))).head().k == sum(r.y for r in best)


def test_hashed_permutations_take_the_smallest_hashes_at_every_size(spark):
    import hashlib

    rng = np.random.default_rng(3)
    units = [(i, float(x), bool(i % 5 == 0)) for i, x in enumerate(rng.random(700))]
    df = spark.createDataFrame(units, "unit int, score double, is_event boolean").withColumn("k", F.lit("a"))
    want = []
    for p in range(12):
        order = sorted(units, key=lambda u: (hashlib.md5(f"42|{p}|{u[0]}".encode()).hexdigest(), u[0]))
        x = np.array([u[1] for u in order])
        want.append(x[:140].mean() - x[140:].mean())
    for per_range in (5, 60, 10_000):
        got = [r.d for r in validate.null_differences(df, K, 12, per_range=per_range).collect()]
        assert sorted(got) == pytest.approx(sorted(want))


def test_hashed_permutations_read_their_scores_once_and_find_labels_outside_the_fine_ranges(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    units = spark.range(400).select(F.col("id").alias("unit"), F.udf(seen, "double")((F.col("id") * 37 % 101).cast("double")).alias("score"), (F.col("id") % 3).alias("phase"))
    phases = {"first": ("phase = 0", "phase = 1"), "last": ("phase = 2", "phase < 2")}
    want = {r.comparison: (round(r.p, 9), round(r.null_mean, 9)) for r in validate.phase_permutations(units, phases, 50).collect()}
    assert read.value == 400
    monkeypatch.setattr(validate, "REACH", 0.01)  # nearly every permutation's labels run out below or above the fine ranges
    assert {r.comparison: (round(r.p, 9), round(r.null_mean, 9)) for r in validate.phase_permutations(units, phases, 50).collect()} == want


@pytest.fixture(scope="session")
def equal_changes(tmp_path_factory):
    """Events of twelve users whose means rise by 0.5 (six), fall by 0.5 (four) or stay (two), of values in all orders."""
    folder, rows = tmp_path_factory.mktemp("events"), []
    for user in range(12):
        order = list(itertools.permutations(range(3)))[user % 6]
        low, high = [[x, y, z][k] for k in order for x, y, z in [(0.1, 0.2, 0.3)]], [[x, y, z][k] for k in order for x, y, z in [(0.3, 0.8, 1.0)]]
        first, second = (low, high) if user < 6 else (high, low) if user < 10 else (low, low[::-1])
        rows += [(user, pd.Timestamp("2024-01-01") + pd.Timedelta(days=day, seconds=user), float(v)) for day, v in zip((0, 1, 2, 20, 21, 22), first + second)]
    events = pd.DataFrame(rows, columns=["user_id", "ts", "value"]).assign(event_type="click", props="")
    events["ts"] = events.ts.astype("datetime64[us]")
    events.assign(event_id=range(len(events))).to_parquet(folder / "events.parquet")
    return str(folder)


def test_equal_changes_share_a_rank_in_quadrants(spark, equal_changes):
    r = catalogue.QUERIES["quadrant_tests"](spark, equal_changes).head()
    assert (r.quadrant, r.n, r.w, r.p) == ("browse", 10, 22, pytest.approx(stats.signed_rank_p(10, 22, 990), abs=1e-6))


def test_equal_changes_share_a_rank(spark, equal_changes):
    r = catalogue.QUERIES["wilcoxon_stat"](spark, equal_changes).head()
    assert (r.n, r.w_plus, r.w, r.p) == (10, 33, 22, pytest.approx(stats.signed_rank_p(10, 22, 990), abs=1e-6))


def test_equal_changes_share_a_rank_in_paired_tests(spark, equal_changes):
    r = catalogue.QUERIES["paired_tests"](spark, equal_changes).head()
    assert (r.n, r.w_plus, r.w, r.p, r.mark) == (10, 33, 22, pytest.approx(stats.signed_rank_p(10, 22, 990), abs=1e-6), "")


@pytest.fixture(scope="session")
def halved_changes(tmp_path_factory):
    """As ``equal_changes``, of 256 values on either side, so that changes (0.0000390625) end in a half of the ninth place; of values around nothing; of small (error) and large (purchase) ones too."""
    folder, rng, rows = tmp_path_factory.mktemp("events"), np.random.default_rng(6), []
    low = rng.integers(-20_000, 20_000, 256)
    high = low + (np.arange(256) == 0)
    for kind, scale in (("click", 100.0), ("error", 1e14), ("purchase", 1e-7)):
        for user in range(12):
            first, second = (low, high) if user < 6 else (high, low) if user < 10 else (low, low)
            days = [(d, v) for d, side in ((0, first), (20, second)) for v in rng.permutation(side)]
            rows += [(user, pd.Timestamp("2024-01-01") + pd.Timedelta(days=d, seconds=user), kind, v / scale) for d, v in days]
    events = pd.DataFrame(rows, columns=["user_id", "ts", "event_type", "value"]).assign(props="")
    events["ts"] = events.ts.astype("datetime64[us]")
    events.assign(event_id=range(len(events))).to_parquet(folder / "events.parquet")
    return str(folder)


def test_equal_changes_share_a_rank_in_paired_tests_at_any_scale(spark, halved_changes):
    found = {r.emotion: (r.n, r.w_plus, r.w, r.mark) for r in catalogue.QUERIES["paired_tests"](spark, halved_changes).collect()}
    assert found == {kind: (10, 33, 22, "") for kind in ("click", "error", "purchase")}


def test_changes_without_bound_count(spark):
    rows = [("a", x, 1e-9) for x in (1.0, -1.0 - 1e-10, 2.0, 1e-10)] + [("a", float("inf"), 0.0), ("a", float("nan"), 0.0)]
    r = validate.signed_rank(spark.createDataFrame(rows, "k string, d double, error double"), K, error="error").head()
    assert (r.n, r.w_plus) == (5, 1.5 + 3 + 4 + 5)


def test_equal_changes_share_a_rank_in_quadrants_at_any_scale(spark, halved_changes):
    found = {r.quadrant: (r.n, r.w) for r in catalogue.QUERIES["quadrant_tests"](spark, halved_changes).collect()}
    assert found == {"browse": (10, 22), "act": (20, 4 * 5.5 + 4 * 15.5)}


def test_equal_changes_share_a_rank_at_any_scale(spark, halved_changes):
    found = {r.emotion: (r.n, r.w_plus, r.w) for r in catalogue.QUERIES["wilcoxon_stat"](spark, halved_changes).collect()}
    assert found == {kind: (10, 33, 22) for kind in ("click", "error", "purchase")}


def like_its_sql(spark, name, key, *folders):
    """The query's rows and those of its SQL, run by one and by eight threads, on every folder."""
    for folder in folders:
        got = catalogue.QUERIES[name](spark, folder).toPandas().sort_values(key, ignore_index=True)
        for threads in (1, 8):
            con = duckdb.connect(config={"threads": threads})
            con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
            want = con.execute(catalogue.SQL[name]).df().sort_values(key, ignore_index=True)
            pd.testing.assert_frame_equal(got, want[list(got)], check_dtype=False, atol=1.1e-6, rtol=0)


def test_the_sql_of_paired_tests_ranks_equal_changes_together(spark, equal_changes, halved_changes):
    like_its_sql(spark, "paired_tests", "emotion", equal_changes, halved_changes)


def test_the_sql_of_quadrant_tests_ranks_equal_changes_together(spark, equal_changes, halved_changes):
    like_its_sql(spark, "quadrant_tests", "quadrant", equal_changes, halved_changes)


def test_the_sql_of_signed_ranks_puts_equal_changes_together(spark, equal_changes, halved_changes):
    like_its_sql(spark, "wilcoxon_stat", "emotion", equal_changes, halved_changes)


def test_beats_on_the_bounds_of_windows_and_of_one_time(spark):
    # From a first beat at a third on, quotients and sums of doubles disagree about which window some beats on a bound begin.
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        t0 = int(rng.integers(1, 40_000)) / 40_000
        at = sorted([t0, *(t0 + 4.0 * n for n in range(1, 12)), *(t0 + rng.random(40) * 44)])
        at = at[:20] + [at[19]] + at[20:]  # two beats of one time
        rr = np.diff([*at, at[-1] + 1.0]) * 1000
        rows += [(str(k), n, float(t), float(x)) for n, (t, x) in enumerate(zip(at, rr))]
    beats = spark.createDataFrame(rows, "k string, beat int, t double, rr double")
    got = {(r.k, r.w): r for r in frames.windowed_variability(beats.orderBy(F.desc("beat")), K, 12.0, 4.0, tie="beat").collect()}
    want = 0
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        t0, t1 = own[0][2], own[-1][2]
        for w in range(int(math.floor((t1 - t0 - 12) / 4 + 1e-9)) + 1):
            start = t0 + 4.0 * w
            held = [r for r in own if start <= r[2] < start + 12.0]
            steps = [b[3] - a[3] for a, b in zip(own, own[1:]) if a[2] >= start and b in held]
            r = got[k, w]
            assert (r.n, r.rmssd) == (len(held), pytest.approx(np.sqrt(np.mean(np.square(steps)))))
            want += 1
    assert len(got) == want
    sizes = [21103, 32539, 31050, 7484, 1549, 20448, 25334, 22502, 27586, 50405]  # fortieths of 6,000 in all, of which doubles added in order make less
    half = spark.createDataFrame([("a", n, float(n), k / 40) for n, k in enumerate(sizes)] + [("a", 10, 12.0, 0.0)], "k string, beat int, t double, rr double").coalesce(1)
    assert frames.windowed_variability(half, K, 12.0, 4.0, tie="beat").head().hr == pytest.approx(100)


def test_artifact_runs(spark):
    flags = spark.createDataFrame([("a", i, c == "1") for i, c in enumerate("0110111011110")] + [("b", 0, True)], "k string, idx long, flag boolean")
    runs = quality.artifact_runs(flags, K, 3)
    assert sorted(tuple(r) for r in runs.collect()) == [("a", 4, 7), ("a", 8, 12)]
    masked = quality.mask_runs(flags.withColumn("value", F.lit(1.0)), runs, K)
    assert [r.masked is None for r in masked.where("k = 'a'").orderBy("idx").collect()] == [c == "1" for c in "0000111011110"]


def test_rates_stand_where_their_interval_begins():
    peaks = np.array([0, 200, 400, 640, 880, 1080, 1300, 1500, 1740, 1960, 2160, 2400])
    found = dsp.hrv(peaks, 200, 6.0, 1.0)
    assert list(found) == ["t", "SDNN", "RMSSD", "HF Power", "LF/HF", "SampEn", "pNN50"] and found["t"][0] == 3.0
    assert dsp.intervals(peaks, 200)[2] == 1200 and found["SDNN"][0] == pytest.approx(np.std([1000, 1000, 1200, 1200, 1000, 1100], ddof=1))
    x = np.zeros(2400)
    x[peaks[1:-1]] = np.arange(2, 12)
    t, height = features._windows(np.interp(np.arange(2400), peaks[1:-1], x[peaks[1:-1]]), 200, 3.0, 1.0, np.nanstd)
    whole = features._ppg(np.convolve(x, np.hanning(60), "same"), 200, np.zeros(0, int), 200, 3.0, 1.0)
    assert len(whole["PAV"][1]) == len(t) and np.nanmax(whole["PAV"][1]) > 0


def test_tonic_forms(spark):
    fs = 4
    t = np.arange(240 * fs) / fs
    x = 5 + 0.01 * t + 0.3 * np.sin(2 * np.pi * 0.5 * t)
    slow = dsp.tonic_by_high_pass(x, fs)
    assert np.abs(slow[80:-80] - (5 + 0.01 * t)[80:-80]).max() < 0.05
    out = features.session_features({"EDA": (fs, x)}, 30, 1, tonic="high-pass")
    assert np.nanmean(out["SCL"][1]) == pytest.approx(x.mean(), abs=0.1)


def test_caches_and_recordings_of_odd_content(spark, tmp_path):
    rows = spark.createDataFrame([("P1", 0, 1, 1.5), ("P1", 0, 2, None), ("P1", 0, 3, 2.0), ("P1", 1, 1, None), ("P1", 2, 2, -3e-7)], "subject_id string, row_idx long, channel int, value double")
    sources.write_recordings(rows, f"file://{tmp_path}/rec").collect()
    got = {(r.row_idx, r.channel): r.value for r in sources.read_recordings(spark, f"file://{tmp_path}/rec").collect()}
    assert got == {(0, 1): 1.5, (0, 2): None, (0, 3): 2.0, (1, 1): None, (1, 2): None, (1, 3): None, (2, 1): None, (2, 2): -3e-7, (2, 3): None}
    (tmp_path / "n.json").write_text('{"null_aff": [0.5, -0.5, 0.1], "p_pooled": 0.01, "r_rb_pooled": 0.4}\n')
    assert [tuple(r) for r in sources.read_null_distributions(spark, str(tmp_path / "n.json")).collect()] == [("pooled", 3, pytest.approx(0.1 / 3), 0.5, 0.01, 0.4)]
    (tmp_path / "a.json").write_text('{"event": "Crash", "mean_auc": 0.7, "per_subj_sids": ["P1", "P2"], "per_subj_aucs": [0.6, 0.8]}\n{"event": "Brake", "per_subj_sids": [], "per_subj_aucs": []}\n')
    assert [tuple(r) for r in sources.read_ablation(spark, str(tmp_path / "a.json")).collect()] == [(None, "Crash", "P1", 0.6), (None, "Crash", "P2", 0.8)]


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_registered_query(spark, name):
    d = "/root/testdata/sf0.001"
    got = catalogue.QUERIES[name](spark, d)
    if name not in catalogue.SQL:
        assert name in BY_HAND  # compared with plain Python below
        return
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = c.sql(catalogue.SQL[name]).df()
    own = got.toPandas()
    assert sorted(own.columns) == sorted(want.columns) and len(own) == len(want)

    def key(df):
        return sorted(repr(tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row)) for row in df[sorted(df.columns)].itertuples(index=False))

    assert key(own) == key(want)


def test_contract(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
