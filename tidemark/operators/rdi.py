"""Regime divergence: from pair distances to one consensus score per segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frames import standardise


def mean_distances(distances: DataFrame, segments: DataFrame, keys: list[str], methods: tuple[str, ...] | list[str]) -> DataFrame:
    """keys, seg, method and md for every one of ``methods``: mean distance to the other segments, 0 for a segment that stands alone.

    ``distances``: keys, seg_i < seg_j, method, d.
    """
    both = distances.select(*keys, F.explode(F.array("seg_i", "seg_j")).alias("seg"), "method", "d")
    sums = both.groupBy(*keys, "seg", "method").agg(F.sum("d").alias("_s"))
    counted = segments.select(*keys, "seg", F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    grid = counted.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
    rows = grid.join(sums.hint("merge"), [*keys, "seg", "method"], "left")
    return rows.select(*keys, "seg", "method", (F.coalesce("_s", F.lit(0.0)) / F.greatest(F.lit(1), F.col("_n") - 1)).alias("md"))


def consensus(means: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seg and consensus: per method the share of its largest mean distance (if that is positive), averaged over methods."""
    top = F.max("md").over(Window.partitionBy(*keys, "method"))
    share = F.when(top > 0, F.col("md") / F.when(top > 0, top)).otherwise(F.col("md"))
    return means.withColumn("_v", share).groupBy(*keys, "seg").agg(F.avg("_v").alias("consensus"))


def score_segments(distances: DataFrame, segments: DataFrame, keys: list[str], methods: tuple[str, ...] | list[str]) -> DataFrame:
    """``segments`` with consensus and z (its distance from the subject's mean in standard deviations)."""
    scored = segments.hint("merge").join(consensus(mean_distances(distances, segments, keys, methods), keys), [*keys, "seg"])
    return standardise(scored, keys, "consensus", "z")


def outliers(scored: DataFrame, keys: list[str], share: float = 0.75) -> DataFrame:
    """``scored`` with threshold (the share's quantile of the subject's consensus) and outlier (at or above it)."""
    limit = scored.groupBy(*keys).agg(F.expr(f"percentile(consensus, {share}D)").alias("threshold"))
    return scored.join(limit, keys).withColumn("outlier", F.col("consensus") >= F.col("threshold"))
