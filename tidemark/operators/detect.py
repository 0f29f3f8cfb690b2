"""Event detection over a cohort of scored segments.

A record has subject, seg_idx (its place in the subject's session), in_experiment,
events, consensus, dtw, rulsif (consensus where absent) and cohens_d.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import t_p
from tidemark.operators.frames import mid_rank
from tidemark.operators.validate import auc, roc_points, running_sums

BASE = ("cons_z", "dc_z", "spike_z", "all4_z", "spike4_z", "max_z", "level_spike4", "dtwrul_z")
FUSED = ("rank_fusion", "combmax", "combsum", "rrf", "top3mean")
STRATEGIES = (*BASE, *FUSED)
#: Tolerance windows in segments after the event.
WINDOWS = {"Exact": [0], **{f"Exact+{n}": list(range(n + 1)) for n in range(1, 6)}}


def _with_z(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns standardised within the subject (standard deviation 1e-12 at least)."""
    w = Window.partitionBy("subject")
    raw = df.withColumns({f"_raw_{n}": c for n, c in columns.items()})
    z = {n: (F.col(f"_raw_{n}") - F.avg(f"_raw_{n}").over(w)) / F.greatest(F.stddev_pop(f"_raw_{n}").over(w), F.lit(1e-12)) for n in columns}
    return raw.withColumns(z).drop(*[f"_raw_{n}" for n in columns])


def score_columns(records: DataFrame) -> DataFrame:
    """Experiment segments with pos (0, 1, ... among them) and the eight base scores.

    Steps look back to the segment before in the whole session; the first has none.
    """
    order = Window.partitionBy("subject").orderBy("seg_idx")
    rows = records.withColumn("rulsif", F.coalesce("rulsif", "consensus"))
    steps = {f"_d_{m}": F.col(m) - F.coalesce(F.lag(m).over(order), F.col(m)) for m in ("dtw", "consensus", "rulsif", "cohens_d")}
    rows = rows.withColumns(steps).where("in_experiment").withColumn("pos", (F.row_number().over(order) - 1).cast("int"))
    c = F.col
    rows = _with_z(rows, {
        "cons_z": c("consensus"), "dc_z": (c("dtw") + c("cohens_d")) / 2, "_dtw_z": c("dtw"), "_coh_z": c("cohens_d"), "_rul_z": c("rulsif"),
        "all4_z": (c("dtw") + c("cohens_d") + c("consensus") + c("rulsif")) / 4, "dtwrul_z": (c("dtw") + c("rulsif")) / 2,
        **{f"_z{m}": c(f"_d_{m}") for m in ("dtw", "consensus", "rulsif", "cohens_d")},
        **{f"_u{m}": F.greatest(c(f"_d_{m}"), F.lit(0.0)) for m in ("dtw", "consensus", "rulsif", "cohens_d")},
    })
    two = ["_udtw", "_uconsensus", "_zdtw", "_zconsensus"]
    four = ["_udtw", "_uconsensus", "_urulsif", "_ucohens_d", "_zdtw", "_zconsensus", "_zrulsif", "_zcohens_d"]
    add = lambda names: reduce(lambda a, b: a + b, [c(n) for n in names])
    rows = _with_z(rows, {"spike_z": add(two), "spike4_z": add(four)})
    rows = rows.withColumns({"max_z": F.greatest("_dtw_z", "cons_z", "_rul_z", "_coh_z"), "level_spike4": c("all4_z") + c("spike4_z")})
    return rows.drop(*[n for n in rows.columns if n.startswith("_")])


def fuse(scored: DataFrame) -> DataFrame:
    """``scored`` with the five fused scores: ranks are within the subject, from the highest score, ties averaged."""
    ranks = {f"_k_{s}": mid_rank(Window.partitionBy("subject").orderBy(F.desc(s))) for s in BASE}
    rows = scored.withColumns(ranks)
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    top = F.slice(F.sort_array(F.array(*BASE), asc=False), 1, 3)
    return rows.withColumns({
        "rank_fusion": -add([F.col(r) for r in ranks]) / len(BASE), "combmax": F.greatest(*BASE), "combsum": add([F.col(b) for b in BASE]),
        "rrf": add([1.0 / (60 + F.col(r)) for r in ranks]), "top3mean": F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / 3,
    }).drop(*ranks)


def _places(flag: Column, position: str) -> Column:
    """Positions of the flagged rows of the subject; a session has tens of segments."""
    return F.collect_set(F.when(flag, F.col(position))).over(Window.partitionBy("subject"))


def _near(places: Column, position: str, offsets: Column) -> Column:
    """Whether one of ``places`` lies an offset before the row."""
    return F.arrays_overlap(places, F.transform(offsets, lambda o: (F.col(position) - o).cast("int")))


def label_segments(records: DataFrame, names: list[str], offsets: list[int] | None = None) -> DataFrame:
    """``records`` with y: 1 at the affective events of the session, and at ``offsets`` after them."""
    flag = F.arrays_overlap("events", F.array(*[F.lit(n) for n in names]))
    rows = records.withColumn("_at", _places(flag, "seg_idx"))
    return rows.withColumn("y", F.coalesce(_near(F.col("_at"), "seg_idx", F.array(*[F.lit(o) for o in offsets or [0]])), F.lit(False)).cast("int")).drop("_at")


def event_aucs(fused: DataFrame, events: list[str], windows: dict[str, list[int]] = WINDOWS) -> DataFrame:
    """AUC per subject, event, window and strategy, where the subject has the event and both classes are present.

    A row counts as positive at an event and at the window's offsets after it.  A
    row's rank depends on subject and strategy only; it is taken once, and each event
    and window adds up the ranks of its positives.
    """
    session = Window.partitionBy("subject")
    ranks = {f"_k_{s}": mid_rank(session.orderBy(F.asc(s))) for s in STRATEGIES}
    at = F.array(*[F.struct(F.lit(e).alias("event"), _places(F.array_contains("events", e), "pos").alias("at")) for e in events])
    wide = F.array(*[F.struct(F.lit(n).alias("win_ord"), F.lit(w).alias("window"), F.array(*[F.lit(o) for o in offs]).alias("offs")) for n, (w, offs) in enumerate(windows.items())])
    rows = fused.withColumns(ranks).withColumns({"_at": at, "_n": F.count(F.lit(1)).over(session)})
    rows = rows.select("subject", "pos", "_n", *ranks, F.explode("_at").alias("_e")).where(F.size("_e.at") > 0).withColumn("_w", F.explode(wide))
    hits = rows.where(_near(F.col("_e.at"), "pos", F.col("_w.offs"))).select("subject", "_n", *ranks, "_e.event", "_w.win_ord", "_w.window")
    sums = hits.groupBy("subject", "event", "win_ord", "window").agg(F.count(F.lit(1)).alias("n1"), F.first("_n").alias("_n"), *[F.sum(k).alias(k) for k in ranks]).withColumn("n0", F.col("_n") - F.col("n1")).where("n0 > 0")
    each = F.array(*[F.struct(F.lit(n).alias("strat_ord"), F.lit(s).alias("strategy"), ((F.col(f"_k_{s}") - F.col("n1") * (F.col("n1") + 1) / 2.0) / (F.col("n1") * F.col("n0"))).alias("auc")) for n, s in enumerate(STRATEGIES)])
    return sums.select("subject", "event", "win_ord", "window", F.explode(each).alias("_s"), "n1", "n0").select("subject", "event", "win_ord", "window", "_s.*", "n1", "n0")


def best_strategies(aucs: DataFrame) -> DataFrame:
    """Per event the window and strategy of the highest mean AUC; of equals the first window, then the first strategy."""
    means = aucs.groupBy("event", "win_ord", "window", "strat_ord", "strategy").agg(F.avg("auc").alias("mean_auc"), F.count(F.lit(1)).alias("n_subjects"))
    order = Window.partitionBy("event").orderBy(F.desc(F.round("mean_auc", 12)), "win_ord", "strat_ord")
    return means.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "win_ord", "strat_ord")


def _ranges(df: DataFrame) -> int:
    """How many ranges a cohort's scores are cut into: as many as there are shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def detection_eval(fused: DataFrame) -> DataFrame:
    """Pooled AUC per strategy over all subjects; ``fused`` carries the labels of ``label_segments`` as y."""
    ranges = _ranges(fused)
    scores = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("score")) for s in STRATEGIES])
    return auc(fused.select("y", F.explode(scores).alias("_s")).select("y", "_s.*"), ["strategy"], ranges=ranges)


def pooled_roc(fused: DataFrame, event: str, strategy: str, offsets: list[int]) -> DataFrame:
    """ROC points of one strategy for one event over all subjects; offsets stay within a subject."""
    rows = fused.withColumn("_at", _places(F.array_contains("events", event), "pos"))
    y = F.coalesce(_near(F.col("_at"), "pos", F.array(*[F.lit(o) for o in offsets])), F.lit(False)).cast("int")
    return roc_points(rows.select(F.lit(event).alias("event"), F.col(strategy).alias("score"), y.alias("y")), ["event"], ranges=_ranges(fused))


def event_trajectories(records: DataFrame, names: list[str], reach: int = 4) -> DataFrame:
    """off, n, mean and sem of the consensus around event segments, by place among the experiment's segments.

    Looks at reach + 1 before to reach - 1 after and reports places one higher.
    """
    order = Window.partitionBy("subject").orderBy("seg_idx")
    rows = records.where("in_experiment").withColumn("pos", F.row_number().over(order) - 1)
    centre = rows.where(F.arrays_overlap("events", F.array(*[F.lit(n) for n in names])))
    looks = centre.select("subject", F.explode(F.sequence(F.lit(-reach - 1), F.lit(reach - 1))).alias("_o"), F.col("pos").alias("_p")).withColumn("pos", F.col("_p") + F.col("_o"))
    hit = looks.join(rows.select("subject", "pos", "consensus"), ["subject", "pos"])
    return hit.groupBy((F.col("_o") + 1).alias("off")).agg(F.count(F.lit(1)).alias("n"), F.avg("consensus").alias("mean"), (F.stddev_pop("consensus") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("sem"))


def cumulative_detection(scored: DataFrame, score: str = "score", label: str = "y", ties: tuple[str, ...] = ("subject", "pos")) -> DataFrame:
    """k, detection rate and precision among the k highest scores, over the whole cohort; ties by the columns of ``ties``, descending.

    Running counts are taken within score ranges and offset by the ranges before, so
    that no task holds more than one of them.
    """
    rows = scored.select(F.lit(0).alias("_all"), F.col(score).alias("_score"), F.col(label).alias("_y"), F.lit(1).alias("_one"), *[F.col(t).alias(f"_t{n}") for n, t in enumerate(ties)])
    order = [F.desc("_score"), *[F.desc(f"_t{n}") for n in range(len(ties))]]
    rows = running_sums(rows, ["_all"], order, "_score", {"_k0": "_one", "_h0": "_y"}, True, _ranges(scored))
    rows = rows.join(F.broadcast(scored.groupBy(F.lit(0).alias("_all")).agg(F.sum(label).alias("n_pos"))), "_all")
    rows = rows.withColumns({"k": F.col("_k0") + 1, "_h": F.col("_h0") + F.col("_y")})
    return rows.select("k", "n_pos", (F.col("_h") / F.when(F.col("n_pos") > 0, F.col("n_pos"))).alias("detection"), (F.col("_h") / F.col("k")).alias("precision"))


def inspection_point(detections: DataFrame) -> DataFrame:
    """The row of ``cumulative_detection`` at which as many segments are looked at as there are events."""
    return detections.where("k = n_pos")


def keep_strongest_event(records: DataFrame, event: str, group: str, affective: list[str]) -> DataFrame:
    """In one group, an event stays only on the subject's segment of the highest consensus (the first of equals); has_affective follows."""
    holds = (F.col("group") == group) & F.array_contains("events", event)
    order = Window.partitionBy("subject", F.when(holds, 1).otherwise(0)).orderBy(F.desc("consensus"), "seg_idx")
    rows = records.withColumn("_r", F.when(holds, F.row_number().over(order)))
    left = F.when(F.col("_r") > 1, F.array_remove("events", event)).otherwise(F.col("events"))
    rows = rows.withColumn("events", left).drop("_r")
    return rows.withColumn("has_affective", F.arrays_overlap("events", F.array(*[F.lit(n) for n in affective])))


def modality_ablation(solo: DataFrame, baseline: DataFrame) -> DataFrame:
    """modality, event, n, mean_auc, sem, and the mean, t and two-sided p of solo minus baseline over the subjects that both have.

    ``solo``: modality, event, subject, auc; ``baseline``: event, subject, auc.  A cell without subjects has mean 0.
    """
    pairs = solo.join(baseline.withColumnRenamed("auc", "_base"), ["event", "subject"])
    own = solo.groupBy("modality", "event").agg(F.avg("auc").alias("mean_auc"), (F.stddev_pop("auc") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("sem"))
    d = pairs.withColumn("_d", F.col("auc") - F.col("_base")).groupBy("modality", "event").agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.stddev_samp("_d").alias("_sd"))
    events = [r["event"] for r in baseline.select("event").distinct().orderBy("event").collect()]  # a few kinds of event
    grid = solo.select("modality").distinct().withColumn("event", F.explode(F.array(*[F.lit(e) for e in events])))
    t = F.when(F.col("_sd") > 0, F.col("mean_diff") / (F.when(F.col("_sd") > 0, F.col("_sd")) / F.sqrt(F.col("n").cast("double"))))
    rows = grid.join(own, ["modality", "event"], "left").join(d, ["modality", "event"], "left")
    return rows.select("modality", "event", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_auc", F.lit(0.0)).alias("mean_auc"), "sem", "mean_diff", t.alias("t")).withColumn("p", t_p("t", (F.col("n") - 1).cast("double")))


def feature_response(deltas: DataFrame, modality_order: list[str]) -> DataFrame:
    """feature, modality, n, mean and sem of the change at events, with its place: by modality, then by size of the mean."""
    per = deltas.groupBy("modality", "feature").agg(F.count("delta").alias("n"), F.avg("delta").alias("mean"), F.when(F.count("delta") > 1, F.stddev_pop("delta") / F.sqrt(F.count("delta").cast("double"))).otherwise(0.0).alias("sem"))
    place = F.array_position(F.array(*[F.lit(m) for m in modality_order]), F.col("modality"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(place, F.desc(F.abs(F.col("mean"))), "feature")))
