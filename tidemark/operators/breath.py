"""Respiration as windows: breaths with hysteresis, and volume per time between two curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frames import gap_fill


def breaths(samples: DataFrame, keys: list[str], least: float = 0.3, idx: str = "idx", value: str = "value") -> DataFrame:
    """``samples`` with ``turn``: 1 at the peak of a breath in, -1 at the trough of a breath out, else NULL.

    A series is high from where it exceeds its mean by ``least`` standard deviations
    until it falls as far below, and then low until it exceeds it again.  Each high
    stretch has its first highest sample as peak, each low one its first lowest as
    trough, so the two alternate, at least twice that apart, and ripples between the
    two levels make no breath.
    """
    whole, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(idx)
    x, mean, spread = F.col(value), F.avg(value).over(whole), F.stddev_pop(value).over(whole)
    rows = samples.withColumn("_side", F.when(x > mean + least * spread, 1).when(x < mean - least * spread, -1))
    rows = rows.withColumn("_state", F.last("_side", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_state") != F.lag("_state").over(order), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_state", "_run")
    high, low = F.max(F.struct(value, -F.col(idx))).over(run), F.min(F.struct(F.when(x.isNotNull(), x).otherwise(float("inf")), F.col(idx))).over(run)
    rows = rows.withColumn("_at", F.when(F.col("_state") == 1, -high["col2"]).when(F.col("_state") == -1, low[idx]))
    return rows.withColumn("turn", F.when(F.col("_at") == F.col(idx), F.col("_state"))).drop("_side", "_state", "_run", "_at")


def volume(samples: DataFrame, keys: list[str], fs: float, least: float = 0.3, idx: str = "idx", value: str = "value") -> DataFrame:
    """keys, ``idx``, upper, lower, period (s) and volume of every sample.

    The upper curve runs through the peaks, the lower one through the troughs, and the
    period through the times from each peak to the one before, all linearly and level
    beyond their ends; volume is the curves' distance over the period.  A series of
    fewer than two peaks, or without a trough, has no volume.
    """
    turns = breaths(samples.select(*keys, idx, value), keys, least, idx, value)
    peak = F.col("turn") == 1
    before = F.last(F.when(peak, F.col(idx)), True).over(Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1))
    points: dict[str, Column] = {"upper": F.when(peak, F.col(value)), "lower": F.when(F.col("turn") == -1, F.col(value)), "period": F.when(peak, (F.col(idx) - before) / float(fs))}
    rows = turns.withColumns({f"_{name}": c for name, c in points.items()})
    for name in points:
        known = F.count(f"_{name}").over(Window.partitionBy(*keys)) > 0
        rows = gap_fill(rows, keys, idx, f"_{name}", name).withColumn(name, F.when(known, F.col(name)))
    return rows.select(*keys, idx, *points, ((F.col("upper") - F.col("lower")) / F.col("period")).alias("volume"))
