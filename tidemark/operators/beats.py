"""Heart beats as points in time: artifact correction, and spectra of uneven intervals.

Both are windows and aggregations over tables of beats; no series is resampled and no
code runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frames import in_windows
from tidemark.storage import written

#: Published constants of the classification: threshold factor, and the line that parts ectopic beats.
FACTOR, SLOPE, OFFSET, FAR = 5.2, 0.13, 0.17, 3.0
#: Beats on each side over which thresholds adapt, and over which the usual interval is a median.
REACH, NEAR = 45, 5


def classify(beats: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """``beats`` (keys, t in ms, ascending and distinct in a series) with rr and kind.

    rr is the interval that ends with the beat.  ``kind`` is NULL for a normal beat, else

    * ectopic: the interval's change and those around it have opposite signs,
    * missed: the interval is about twice the usual one, so a beat lacks inside it,
    * extra: this interval and the next make about a usual one, so this beat is one too many,
    * long or short: the interval is far from the usual one otherwise.

    Changes of the interval, and distances from the median of eleven intervals, are
    measured by 5.2 times half the interquartile range of 91 of them around the beat.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    around, near = w.rowsBetween(-REACH, REACH), w.rowsBetween(-NEAR, NEAR)
    half_range = lambda c: (F.expr(f"percentile({c}, 0.75D)").over(around) - F.expr(f"percentile({c}, 0.25D)").over(around)) / 2
    over = lambda c, by: F.when(F.col(by) > 0, F.round(F.col(c) / F.when(F.col(by) > 0, F.col(by)), 9)).otherwise(F.when(F.col(c).isNotNull(), 0.0))
    rows = beats.withColumn("rr", F.col(t) - F.lag(t).over(w))
    rows = rows.withColumns({"_d": F.col("rr") - F.lag("rr").over(w), "_med": F.expr("percentile(rr, 0.5D)").over(near)})
    rows = rows.withColumns({"_m": (F.col("rr") - F.col("_med")) * F.when(F.col("rr") < F.col("_med"), 2.0).otherwise(1.0), "_ad": F.abs("_d")})
    rows = rows.withColumn("_am", F.abs("_m")).withColumns({"_t1": FACTOR * half_range("_ad"), "_t2": FACTOR * half_range("_am")})
    rows = rows.withColumns({"_s": over("_d", "_t1"), "_f": over("_m", "_t2"), "_next": F.lead("rr").over(w)})
    side = lambda k: F.coalesce((F.lag("_s") if k < 0 else F.lead("_s", k)).over(w), F.lit(0.0))
    up, s = F.col("_d") >= 0, F.col("_s")
    rows = rows.withColumns({"_s1": F.when(up, F.greatest(side(-1), side(1))).otherwise(F.least(side(-1), side(1))), "_s2": F.when(up, F.least(side(1), side(2))).otherwise(F.greatest(side(1), side(2)))})
    ectopic = ((s > 1) & (F.col("_s1") < -SLOPE * s - OFFSET)) | ((s < -1) & (F.col("_s1") > -SLOPE * s + OFFSET))
    long_ = ((s > 1) & (F.col("_s2") < -1)) | (F.col("_f") > FAR)
    short = ((s < -1) & (F.col("_s2") > 1)) | (F.col("_f") < -FAR)
    close = lambda x: F.round(F.abs(x - F.col("_med")), 9) < F.round("_t2", 9)
    kind = F.when(ectopic, "ectopic").when(long_ & close(F.col("rr") / 2), "missed").when(short & close(F.col("rr") + F.col("_next")), "extra").when(long_, "long").when(short, "short")
    return rows.select(*beats.columns, "rr", kind.alias("kind"))


def correct(beats: DataFrame, keys: list[str], t: str = "t", passes: int = 20) -> DataFrame:
    """keys and ``t`` of the beats after repair.

    In each pass an extra beat goes, a beat is put into the middle of an interval that
    lacks one, and an ectopic beat, or one after a long or short interval, moves to the
    middle of its neighbours.  Of beats in a row that are not normal only every second
    is repaired in one pass.  A series is done when it has no artifact, or as many as
    before its last repair; after ``passes`` the rest stays as it is.  The first and the
    last beat do not move.
    """
    w = Window.partitionBy(*keys).orderBy(t)
    now = beats.select(*keys, F.col(t).cast("double").alias(t)).where(F.col(t).isNotNull()).distinct().withColumn("_left", F.lit(None).cast("long"))
    for turn in range(passes):
        rows = classify(now, keys, t)
        odd = F.col("kind").isNotNull()
        rows = rows.withColumn("_run", F.sum(F.when(odd, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(t)) - F.when(F.col("_run") > 0, 1).otherwise(0)
        rows = rows.withColumns({"_n": F.count(F.when(odd, 1)).over(Window.partitionBy(*keys)), "_k": place, "_b": F.lag(t).over(w), "_a": F.lead(t).over(w)})
        live = (F.col("_n") > 0) & (F.col("_left").isNull() | (F.col("_n") < F.col("_left")))
        chosen = F.when(live & odd & (F.col("_k") % 2 == 1) & F.col("_a").isNotNull(), F.col("kind"))
        rows = rows.withColumns({"_do": chosen, "_live": live})
        middle = (F.col("_b") + F.col("_a")) / 2
        at = F.when(F.col("_do") == "extra", F.array().cast("array<double>")).when(F.col("_do") == "missed", F.array((F.col("_b") + F.col(t)) / 2, F.col(t)))
        at = at.when(F.col("_do").isNotNull(), F.array(middle)).otherwise(F.array(t))
        now = written(rows.select(*keys, F.explode(at).alias(t), F.when(F.col("_live"), F.col("_n")).otherwise(F.lit(0)).alias("_left")), f"beats-{turn}")
        if now.where("_left > 0").isEmpty():
            break
    return now.select(*keys, t)


def windowed_spectrum(beats: DataFrame, keys: list[str], window: float, step: float, t: str = "t", rr: str = "rr", low: tuple[float, float] = (0.04, 0.15), high: tuple[float, float] = (0.15, 0.4), grid: float = 0.01, tie: str | None = None) -> DataFrame:
    """w, t (centre), n, lf, hf and lf_hf: power of the intervals of sliding windows in two bands, as they stand in time.

    A frequency's power is what the best sinusoid of that frequency takes off the sum of
    squares around the window's mean (Lomb and Scargle), from five sums over its beats:
    one aggregation by window and frequency.  Bands hold the multiples of ``grid`` from
    their lower bound up to, not including, their upper bound.  Windows are those of
    ``windowed_variability``, and missing as there.
    """
    steps = {name: range(-int(-(lo / grid - 1e-9) // 1), -int(-(hi / grid - 1e-9) // 1)) for name, (lo, hi) in (("lf", low), ("hf", high))}
    bands = [(name, k * grid) for name, ks in steps.items() for k in ks]
    held = in_windows(beats, keys, window, step, t, tie)
    per = Window.partitionBy(*keys, "w")
    held = held.withColumns({"_y": F.col(rr) - F.avg(rr).over(per), "_r": F.col(t) - F.col("_start")})
    table = F.array(*[F.struct(F.lit(name).alias("band"), F.lit(f).alias("f")) for name, f in bands])
    rows = held.select(*keys, "w", "_start", F.col(rr).alias("_rr"), "_y", "_r", F.inline(table)).withColumns({"_c": F.cos(F.col("f") * 2 * F.pi() * F.col("_r")), "_s": F.sin(F.col("f") * 2 * F.pi() * F.col("_r"))})
    total = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = rows.groupBy(*keys, "w", "band", "f").agg(
        F.min("_start").alias("_start"), F.count("_rr").alias("n"), F.sum("_rr").alias("_sum"), total("_c", "_c").alias("cc"), total("_s", "_s").alias("ss"), total("_c", "_s").alias("cs"), total("_y", "_c").alias("yc"), total("_y", "_s").alias("ys")
    )
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    power = (F.col("yc") * F.col("yc") * F.col("ss") + F.col("ys") * F.col("ys") * F.col("cc") - 2 * F.col("yc") * F.col("ys") * F.col("cs")) / F.when(det > 1e-9, det)
    bands_of = sums.withColumn("_p", power / F.col("n")).groupBy(*keys, "w").agg(
        (F.min("_start") + window / 2).alias("t"), F.max("n").alias("n"), F.max("_sum").alias("_sum"), *[(F.sum(F.when(F.col("band") == b, F.col("_p"))) * grid * window).alias(b) for b in ("lf", "hf")]
    )
    ok = (F.round("_sum", 6) >= 500.0 * window) & (F.col("n") >= 4)
    out = bands_of.withColumns({b: F.when(ok, F.col(b)) for b in ("lf", "hf")})
    return out.select(*keys, "w", "t", "n", "lf", "hf", (F.col("lf") / F.when(F.col("hf") > 1e-12, F.col("hf"))).alias("lf_hf"))
