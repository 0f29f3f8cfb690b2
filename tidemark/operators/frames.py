"""Column, window and aggregate operators over long series tables.

Every function takes a DataFrame, the ``keys`` that name a series, and the names of
its position (``idx``) and ``value`` columns, and returns a DataFrame.  Windows are
partitioned by the keys, so series are independent and spread over the cluster;
per-series constants come from an aggregation that combines before its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], idx: str | None = None):
    w = Window.partitionBy(*keys)
    return w.orderBy(idx) if idx else w


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as there are shuffle partitions.

    For what is dear to compute from few bytes: sized by bytes, the tasks would be
    joined into one.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def in_order(samples: DataFrame, keys: list[str], together: bool = False) -> DataFrame:
    """keys, fs and value of ``samples`` as ``whole_series`` takes them: a series' rows one after the other.

    ``together``: they are so already, each series in order from position 0 on, and
    stay where they are; only its first row then carries keys and rate, which saves
    most of what goes to Python.  Others are shuffled by the first key and sorted.
    """
    if together:
        return samples.select(*[F.when(F.col("idx") == 0, F.col(c)).alias(c) for c in (*keys, "fs")], "value")
    rows = samples.select(*keys, "fs", "idx", "value")
    return spread(rows, keys[:1]).sortWithinPartitions(*keys, "idx").select(*keys, "fs", "value")


def whole_series(batches: Iterator[pa.RecordBatch], keys: list[str], together: bool = False) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """Keys, rate and values (missing as NaN) of one series after the other of the rows of ``in_order``."""
    key, rate, parts = None, 1, []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        if together:
            starts = np.flatnonzero(column["fs"].is_valid().to_numpy(False))
        else:
            codes = [column[k].dictionary_encode("encode").indices.to_numpy() for k in keys]
            starts = np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1])
        values = column["value"].to_numpy(False).astype(float)
        if not len(starts) or starts[0]:
            parts.append(values[: starts[0] if len(starts) else None])
        for at, end in zip(starts, np.append(starts, batch.num_rows)[1:], strict=True):
            own = tuple(column[k][at].as_py() for k in keys)
            if own != key or together:
                if parts:
                    yield key, rate, np.concatenate(parts)
                key, rate, parts = own, int(column["fs"][at].as_py() or 1), []
            parts.append(values[at:end])
    if parts:
        yield key, rate, np.concatenate(parts)


def gathered(tables: Iterator[pa.Table], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """``tables`` as batches, small ones joined until they have ``rows``."""
    held, count = [], 0
    for table in tables:
        held, count = [*held, table] if table.num_rows else held, count + table.num_rows
        if count >= rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, count = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def clipped(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; a missing x stays missing (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def decimate(df: DataFrame, factor: int, idx: str = "idx") -> DataFrame:
    """Every ``factor``-th sample from the first on, renumbered; a factor of 1 or less changes nothing."""
    return df if factor <= 1 else df.where(F.col(idx) % factor == 0).withColumn(idx, F.expr(f"{idx} div {factor}"))


def crop(df: DataFrame, start: float, end: float, buffer: float = 0.0, t: str = "t") -> DataFrame:
    """Samples from ``start - buffer`` (0 at least) up to, not including, ``end + buffer``."""
    return df.where((F.col(t) >= max(0.0, start - buffer)) & (F.col(t) < end + buffer))


def time_mask(df: DataFrame, start: float, end: float, t: str = "t") -> DataFrame:
    """Flags samples in the closed range [start, end]."""
    return df.withColumn("inside", F.col(t).between(start, end))


def minmax_normalise(df: DataFrame, keys: list[str], value: str = "value", out: str = "norm") -> DataFrame:
    """To [0, 1] over each series; a series without range becomes 0."""
    w = _over(keys)
    low, high, x = F.min(value).over(w), F.max(value).over(w), F.col(value)
    return df.withColumn(out, F.when(x.isNotNull(), F.when(high > low, (x - low) / (high - low)).otherwise(0.0)))


def standardise(df: DataFrame, keys: list[str], value: str = "value", out: str = "z", floor: float | None = None) -> DataFrame:
    """Distance from the mean in population standard deviations; 0 without spread, or divided by ``floor`` at least."""
    w = _over(keys)
    mean, sd, x = F.avg(value).over(w), F.stddev_pop(value).over(w), F.col(value)
    if floor is not None:
        return df.withColumn(out, (x - mean) / F.greatest(sd, F.lit(floor)))
    return df.withColumn(out, F.when(x.isNotNull(), F.when(sd >= 1e-12, (x - mean) / sd).otherwise(0.0)))


def with_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of each series, with n_valid, v_min and v_max, as columns of its rows; no join."""
    w = _over(keys)
    own = {name: F.expr(f"percentile({value}, {p}D)").over(w) for name, p in probabilities.items()}
    return df.withColumns({**own, "n_valid": F.count(value).over(w), "v_min": F.min(value).over(w), "v_max": F.max(value).over(w)})


def iqr_clip(df: DataFrame, keys: list[str], k: float | Column, value: str = "value", out: str = "clipped") -> DataFrame:
    """Clip at k interquartile ranges beyond the quartiles; series of under ten valid samples stay as they are."""
    q = with_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75})
    k = k if isinstance(k, Column) else F.lit(float(k))
    spread = k * (F.col("q3") - F.col("q1"))
    fixed = clipped(F.col(value), F.col("q1") - spread, F.col("q3") + spread)
    return q.withColumn(out, F.when(F.col("n_valid") >= 10, fixed).otherwise(F.col(value))).drop("q1", "q3", "n_valid", "v_min", "v_max")


def drop_constant(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Without series that are all missing or whose standard deviation is below 1e-10."""
    w = _over(keys)
    return df.withColumns({"_sd": F.stddev_pop(value).over(w), "_n": F.count(value).over(w)}).where("_n > 0 AND _sd >= 1e-10").drop("_sd", "_n")


def drop_sparse(df: DataFrame, keys: list[str], value: str = "value", limit: float = 0.10) -> DataFrame:
    """Without series of which ``limit`` or more is missing."""
    return df.withColumn("_share", F.avg(F.col(value).isNull().cast("double")).over(_over(keys))).where(F.col("_share") < limit).drop("_share")


def robust_normalise(df: DataFrame, keys: list[str], value: str = "value", out: str = "norm") -> DataFrame:
    """To [0, 1] between the 2nd and 98th percentile, clipped.

    Under five valid samples everything becomes 0, missing ones too; without a
    percentile range the plain range is used, and a constant becomes 0.5.
    """
    q = with_quantiles(df, keys, value, {"p2": 0.02, "p98": 0.98})
    x, range_, full = F.col(value), F.col("p98") - F.col("p2"), F.col("v_max") - F.col("v_min")
    scaled = clipped((x - F.col("p2")) / F.when(range_ > 1e-12, range_), F.lit(0.0), F.lit(1.0))
    plain = F.when(full > 1e-12, (x - F.col("v_min")) / F.when(full > 1e-12, full)).otherwise(F.when(x.isNotNull(), 0.5))
    return q.withColumn(out, F.when(F.col("n_valid") < 5, 0.0).when(range_ > 1e-12, scaled).otherwise(plain)).drop("p2", "p98", "n_valid", "v_min", "v_max")


def truncate_to_shortest(df: DataFrame, subject: list[str], feature: str = "feature", w: str = "w") -> DataFrame:
    """Only positions that every feature of the subject has."""
    rows = df.withColumn("_last", F.max(w).over(_over([*subject, feature]))).withColumn("_last", F.min("_last").over(_over(subject)))
    return rows.where(F.col(w) <= F.col("_last")).drop("_last")


def sliding(df: DataFrame, keys: list[str], window: int, step: int, fs: float = 1.0, how: str = "mean", idx: str = "idx", value: str = "value") -> DataFrame:
    """Full windows of ``window`` samples every ``step`` of a series 0..n-1: w, t (window centre in seconds) and value.

    ``how``: mean or std (NULL where under half the window is valid) or sum.  Samples
    are summed up once, into panes of the largest size that divides both window and
    step; a window then combines its panes, so its cost is theirs and not its samples'.
    """
    pane = math.gcd(window, step)
    per = df.groupBy(*keys, F.expr(f"CAST({idx} AS BIGINT) div {pane}").alias("_p")).agg(
        F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_k"), F.sum(value).alias("_s"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")
    )
    frame = _over(keys, "_p").rowsBetween(0, window // pane - 1)
    columns = {"_n": F.sum("_rows").over(_over(keys)), "_sum": F.sum("_s").over(frame), "_count": F.sum("_k").over(frame)}
    if how == "std":
        columns["_panes"] = F.collect_list(F.when(F.col("_k") > 0, F.struct("_k", "_m", "_v"))).over(frame)
    start = F.col("_p") * pane
    rows = per.withColumns(columns).where((start % step == 0) & (start <= F.col("_n") - window))
    mean = F.col("_sum") / F.when(F.col("_count") > 0, F.col("_count"))
    if how == "std":  # each pane's own spread, and that of its mean around the window's
        squares = F.aggregate("_panes", F.lit(0.0), lambda a, x: a + x["_k"] * (x["_v"] + (x["_m"] - mean) * (x["_m"] - mean)))
        found = F.sqrt(squares / F.when(F.col("_count") > 0, F.col("_count")))
    else:
        found = mean if how == "mean" else F.col("_sum")
    if how != "sum":
        found = F.when(F.col("_count") >= int(0.5 * window), found)
    return rows.select(*keys, F.expr(f"_p * {pane} div {step}").alias("w"), ((start + window / 2) / fs).alias("t"), found.alias("value"))


def gap_fill(df: DataFrame, keys: list[str], idx: str = "idx", value: str = "value", out: str = "filled") -> DataFrame:
    """Linear between valid neighbours, the nearest valid sample at the ends, 0 where a series has none."""
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))
    so_far = (Window.unboundedPreceding, 0)
    before = F.last(point, True).over(_over(keys, idx).rowsBetween(*so_far))
    # The next valid sample is the last so far in the other direction: a frame that grows is updated, one that shrinks is computed anew at every row.
    after = F.last(point, True).over(_over(keys).orderBy(F.desc(idx)).rowsBetween(*so_far))
    rows = df.withColumns({"_p": before, "_q": after})
    span = (F.col("_q.i") - F.col("_p.i")).cast("double")
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col(idx) - F.col("_p.i")) / F.when(span > 0, span)
    return rows.withColumn(out, F.coalesce(F.col(value), line, F.col("_p.v"), F.col("_q.v"), F.lit(0.0))).drop("_p", "_q")


def resample(df: DataFrame, keys: list[str], step: float = 1.0, t: str = "t", value: str = "value") -> DataFrame:
    """Linear interpolation of irregular points on a grid from the first to the last time, ``step`` apart: g, t, value."""
    points = df.where(F.col(value).isNotNull()).select(*keys, F.col(t).cast("double").alias("t"), F.col(value).alias("v"))
    ends = points.groupBy(*keys).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    grid = ends.select(*keys, "t0", F.explode(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / step).cast("int"))).alias("g"))
    grid = grid.select(*keys, "g", (F.col("t0") + F.col("g") * step).alias("t"), F.lit(None).cast("double").alias("v"))
    both = points.select(*keys, F.lit(None).cast("int").alias("g"), "t", "v").unionByName(grid)
    point = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    so_far = (Window.unboundedPreceding, 0)
    before = F.last(point, True).over(_over(keys).orderBy("t", F.col("g").isNotNull()).rowsBetween(*so_far))
    after = F.last(point, True).over(_over(keys).orderBy(F.desc("t"), F.col("g").isNull()).rowsBetween(*so_far))
    rows = both.withColumns({"_p": before, "_q": after}).where("g IS NOT NULL")
    span = F.col("_q.t") - F.col("_p.t")
    line = F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * (F.col("t") - F.col("_p.t")) / F.when(span > 0, span)
    return rows.select(*keys, "g", "t", F.coalesce(F.when(F.col("t") == F.col("_p.t"), F.col("_p.v")), line, F.col("_p.v"), F.col("_q.v")).alias("value"))


def gradient(df: DataFrame, keys: list[str], h: float = 1.0, idx: str = "idx", value: str = "value", out: str = "gradient") -> DataFrame:
    """Central differences, one-sided at the ends; a single sample has none."""
    w, x = _over(keys, idx), F.col(value)
    back, ahead = F.lag(value).over(w), F.lead(value).over(w)
    first, last = F.lag(idx).over(w).isNull(), F.lead(idx).over(w).isNull()
    return df.withColumn(out, F.when(first & last, F.lit(None).cast("double")).when(first, (ahead - x) / h).when(last, (x - back) / h).otherwise((ahead - back) / (2 * h)))


def median_filter(df: DataFrame, keys: list[str], kernel: int, idx: str = "idx", value: str = "value", out: str = "median") -> DataFrame:
    """Median of an odd ``kernel`` of samples around each; beyond the ends stand zeros."""
    half = kernel // 2
    seen = F.collect_list(value).over(_over(keys, idx).rowsBetween(-half, half))
    full = F.sort_array(F.concat(seen, F.array_repeat(F.lit(0.0), F.lit(kernel) - F.size(seen))))
    return df.withColumn(out, F.element_at(full, half + 1))


def moving_average(df: DataFrame, keys: list[str], kernel: int, idx: str = "idx", value: str = "value", out: str = "tonic") -> DataFrame:
    """Mean of an odd ``kernel`` around each sample of a series 0..n-1 that is mirrored at its ends (the edge sample repeated once).

    Series must hold at least ``kernel // 2`` samples, or the mean is of those there are.
    """
    half = kernel // 2
    i = F.col(idx).cast("long")
    sized = df.withColumn("_n", F.count(F.lit(1)).over(_over(keys)).cast("long"))
    copies = F.array(i, F.when(i < half, -1 - i), F.when(i >= F.col("_n") - half, 2 * F.col("_n") - 1 - i))
    placed = sized.withColumn("_at", F.explode(F.filter(copies, lambda x: x.isNotNull())))
    mean = F.avg(value).over(_over(keys, "_at").rowsBetween(-half, half))
    return placed.withColumn(out, mean).where(F.col("_at") == i).drop("_n", "_at")


def local_peaks(df: DataFrame, keys: list[str], least: float, idx: str = "idx", value: str = "value") -> DataFrame:
    """Rows higher than the one before, as high as the one after, and above ``least``."""
    w, x = _over(keys, idx), F.col(value)
    return df.withColumns({"_b": F.lag(value).over(w), "_a": F.lead(value).over(w)}).where((x > F.col("_b")) & (x >= F.col("_a")) & (x > least)).drop("_a", "_b")


def rise_times(df: DataFrame, keys: list[str], fs: float, least: float, reach: float = 5.0, shortest: float = 0.1, idx: str = "idx", value: str = "value", out: str = "rise") -> DataFrame:
    """Peaks above ``least`` with ``out``: seconds from their onset, the last sample before that is not positive or is higher than its successor.

    The onset is looked for up to ``reach`` seconds back; a rise under ``shortest`` or
    without an onset is missing.
    """
    w, x, at = _over(keys, idx), F.col(value), F.col(idx)
    onset = F.when((x <= 0) | (x > F.lead(value).over(w)), at)
    rows = df.withColumns({"_b": F.lag(value).over(w), "_a": F.lead(value).over(w), "_o": onset})
    rows = rows.withColumn("_o", F.last("_o", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).where((x > F.col("_b")) & (x >= F.col("_a")) & (x > least))
    rise = (at - F.col("_o")) / float(fs)
    return rows.withColumn(out, F.when(rise.between(shortest, reach), rise)).drop("_a", "_b", "_o")


def instantaneous_rate(df: DataFrame, keys: list[str], scale: float = 60.0, t: str = "t", out: str = "rate") -> DataFrame:
    """``scale`` over the time to the next point; none for the last point and for points at one time."""
    step = F.lead(t).over(_over(keys, t)) - F.col(t)
    return df.withColumn(out, F.lit(scale) / F.when(step > 0, step))


def change_from_previous(df: DataFrame, keys: list[str], idx: str, value: str, out: str = "spike") -> DataFrame:
    """Positive part of the step from the row before; 0 for the first row."""
    x = F.col(value)
    return df.withColumn(out, F.greatest(x - F.coalesce(F.lag(value).over(_over(keys, idx)), x), F.lit(0.0)))


def mid_rank(order) -> Column:
    """Rank from 1 in an ordered window, ties sharing the mean of their places: the first and the last of them, in one sort."""
    return (F.rank().over(order) + F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2.0


def average_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank", descending: bool = True) -> DataFrame:
    """``mid_rank`` of each series; a series is one task's, so it is for series, not for whole cohorts."""
    return df.withColumn(out, mid_rank(_over(keys).orderBy(F.desc(value) if descending else F.asc(value))))


def flatline(df: DataFrame, keys: list[str], window: int, threshold: float, idx: str = "idx", value: str = "value") -> DataFrame:
    """``flat``: whether a sample lies in one of the half-overlapping full windows whose standard deviation is below the threshold.

    A flat window marks the blocks of half a window that it covers, not its samples: of
    the last block, when ``window`` is odd, the first samples only.
    """
    step = max(1, window // 2)
    stats = sliding(df, keys, window, step, how="std", idx=idx, value=value).where(F.col("value") < threshold)
    covered = F.array(*[F.struct((F.col("w") + k).alias("_b"), F.lit(min(step, window - k * step)).alias("_to")) for k in range(-(-window // step))])
    blocks = stats.select(*keys, F.inline(covered)).groupBy(*keys, "_b").agg(F.max("_to").alias("_to"))
    rows = df.withColumn("_b", F.expr(f"CAST({idx} AS BIGINT) div {step}")).join(blocks, [*keys, "_b"], "left")
    return rows.withColumn("flat", F.coalesce(F.col(idx) % step < F.col("_to"), F.lit(False))).drop("_b", "_to")


def clipping(df: DataFrame, keys: list[str], value: str = "value", low: float = 0.005, high: float = 0.995) -> DataFrame:
    """``clip``: whether a sample is at or beyond the outer percentiles of its series."""
    q = with_quantiles(df, keys, value, {"lo": low, "hi": high})
    return q.withColumn("clip", (F.col(value) <= F.col("lo")) | (F.col(value) >= F.col("hi"))).drop("lo", "hi", "n_valid", "v_min", "v_max")


def amplitude_outliers(df: DataFrame, keys: list[str], window: int, limit: float, idx: str = "idx", value: str = "value") -> DataFrame:
    """Adjacent full windows with their range, robust z score and ``bad``; none is bad under three windows or without spread."""
    per = df.withColumn("w", F.expr(f"{idx} div {window}")).groupBy(*keys, "w").agg((F.max(value) - F.min(value)).alias("amp"), F.count(F.lit(1)).alias("size")).where(F.col("size") == window).drop("size")
    middle = per.groupBy(*keys).agg(F.expr("percentile(amp, 0.5D)").alias("med"), F.count(F.lit(1)).alias("n"))
    off = per.join(middle, keys).withColumn("dev", F.abs(F.col("amp") - F.col("med")))
    mad = off.groupBy(*keys).agg(F.expr("percentile(dev, 0.5D)").alias("mad"))
    ok = (F.col("n") >= 3) & (F.col("mad") >= 1e-10)
    z = F.when(ok, F.col("dev") / (1.4826 * F.when(ok, F.col("mad"))))
    return off.join(mad, keys).select(*keys, "w", "amp", z.alias("robust_z"), F.coalesce(z > limit, F.lit(False)).alias("bad"))


def transition_nearest_middle(df: DataFrame, keys: list[str], flag: str, idx: str = "idx") -> DataFrame:
    """For each series the position where ``flag`` flips that lies nearest to its middle (the earlier of two)."""
    w = _over(keys, idx)
    flips = df.withColumns({"_b": F.lag(flag).over(w), "_n": F.count(F.lit(1)).over(_over(keys))}).where(F.col("_b") != F.col(flag))
    near = F.row_number().over(_over(keys).orderBy(F.abs(F.col(idx) - F.col("_n") / 2.0), idx))
    return flips.withColumn("_r", near).where("_r = 1").select(*keys, F.col(idx).alias("transition"))


def repair_intervals(df: DataFrame, keys: list[str], idx: str = "beat", value: str = "rr", low: float = 300.0, high: float = 2000.0) -> DataFrame:
    """``repaired``: implausible intervals interpolated over the beat number if over two are valid, else the median."""
    ok = df.withColumn("_ok", F.when(F.col(value).between(low, high), F.col(value)))
    filled = gap_fill(ok, keys, idx, "_ok", "_line")
    stats = ok.groupBy(*keys).agg(F.count("_ok").alias("_n"), F.expr("percentile(_ok, 0.5D)").alias("_med"))
    return filled.join(stats, keys).withColumn("repaired", F.when(F.col("_n") > 2, F.col("_line")).otherwise(F.coalesce("_ok", "_med"))).drop("_ok", "_line", "_n", "_med")


def in_windows(beats: DataFrame, keys: list[str], window: float, step: float, t: str = "t", tie: str | None = None) -> DataFrame:
    """``beats`` once for every sliding window that holds them, with w, _start and _pt (the time of the beat before).

    Windows begin at a series' first beat, ``step`` apart, and end with its last; a
    window holds the beats from its start up to, not including, its end, as doubles compare.
    """
    order = _over(keys).orderBy(t, *([tie] if tie else []))
    rows = beats.withColumns({"_t0": F.min(t).over(_over(keys)), "_t1": F.max(t).over(_over(keys)), "_pt": F.lag(t).over(order)})
    # A quotient can fall to the other side of a whole number: a window more at each end, then the comparison itself.
    first = F.greatest(F.lit(0), F.floor((F.col(t) - F.col("_t0") - window) / step))
    last = F.least(F.floor((F.col(t) - F.col("_t0")) / step) + 1, F.floor((F.col("_t1") - F.col("_t0") - window) / step + 1e-9))
    held = rows.where(last >= first).withColumn("w", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    held = held.withColumn("_start", F.col("_t0") + F.col("w") * F.lit(float(step)))
    return held.where((F.col(t) >= F.col("_start")) & (F.col(t) < F.col("_start") + window))


def windowed_variability(beats: DataFrame, keys: list[str], window: float, step: float, t: str = "t", rr: str = "rr", jump: float = 50.0, tie: str | None = None) -> DataFrame:
    """w, t (centre), n, sdnn, rmssd, pnn50 and hr of the intervals in sliding windows from a series' first beat on.

    ``beats``: keys, t (seconds at which an interval begins) and rr (its milliseconds);
    ``tie`` orders beats of one t.  A window holds the beats from its start up to, not
    including, its end, as doubles compare.  Differences count inside a window only.  A
    window whose intervals cover under half of it, or are under four, has missing values;
    one without any has no row, and the last window ends with the last beat.
    """
    held = in_windows(beats.withColumn("_pr", F.lag(rr).over(_over(keys).orderBy(t, *([tie] if tie else [])))), keys, window, step, t, tie)
    start = F.col("_start")
    step_rr = F.when(F.col("_pt") >= start, F.col(rr) - F.col("_pr"))
    per = held.withColumns({"_c": start + window / 2, "_d": step_rr}).groupBy(*keys, "w").agg(
        F.min("_c").alias("t"), F.count(rr).alias("n"), F.sum(rr).alias("_s"), F.stddev_samp(rr).alias("sdnn"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmssd"),
        (100 * F.avg(F.when(F.col("_d").isNotNull(), (F.abs("_d") > jump).cast("double")))).alias("pnn50"), (60000.0 / F.avg(rr)).alias("hr"),
    )
    ok = (F.round("_s", 6) >= 500.0 * window) & (F.col("n") >= 4)
    return per.select(*keys, "w", "t", "n", *[F.when(ok, F.col(c)).alias(c) for c in ("sdnn", "rmssd", "pnn50", "hr")])


def mean_sem(df: DataFrame, keys: list[str], value: str = "value", sample: bool = False) -> DataFrame:
    """n, mean and standard error (of the population, or the sample, standard deviation)."""
    sd = (F.stddev_samp if sample else F.stddev_pop)(value)
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (sd / F.sqrt(F.count(value).cast("double"))).alias("sem"))
