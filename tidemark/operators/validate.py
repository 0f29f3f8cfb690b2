"""Validation statistics: permutation tests, rank statistics, corrections.

Statistics over a whole cohort are made from counts per distinct score.  Where a key
may hold a cohort, ``ranges`` cuts its scores into that many ranges at approximate
percentiles: sums run inside a range, and the sums of the ranges before are added, so
no task holds more than a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import t_p, wilcoxon_p
from tidemark.operators.frames import spread
from tidemark.storage import written

#: Standard errors about the share of labels within which a permutation's units are counted by fine ranges of their hash.
REACH = 6


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], by: str, sums: dict[str, str], descending: bool, ranges: int) -> DataFrame:
    """``rows`` with, for each (out, column) of ``sums``, the column's sum over the rows of the key that come before in ``order``, whose first column is ``by``.

    With ``ranges`` a key's rows are cut at approximate percentiles of ``by``.
    """
    zero = lambda c: F.coalesce(c, F.lit(0))
    if not ranges:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumns({out: zero(F.sum(c).over(w)) for out, c in sums.items()})
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(by, [n / ranges for n in range(1, ranges)] or [0.5], 10_000)).alias("_cuts"))
    placed = rows.join(F.broadcast(cuts), [*keys]).withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col(by) if descending else c < F.col(by))))
    per = placed.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_s_{out}") for out, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*keys, "_range", *[zero(F.sum(f"_s_{out}").over(before)).alias(f"_b_{out}") for out in sums])
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({out: zero(F.sum(c).over(w)) for out, c in sums.items()}).join(F.broadcast(base), [*keys, "_range"])
    return inside.withColumns({out: F.col(out) + F.col(f"_b_{out}") for out in sums}).drop("_cuts", "_range", *[f"_b_{out}" for out in sums])


def permutation_seeded(scores: DataFrame, keys: list[str], n_perm: int = 10_000, seed: int = 42) -> DataFrame:
    """Per group of ``keys`` the observed mean difference (event minus other) and its one-sided p over seeded shuffles.

    ``scores``: keys, unit, score, is_event.  A group is one task's, so it is for the
    segments of a session; cohorts have ``permutation_hashed``.  Shuffles are drawn a
    block of some 2**20 numbers at a time; an empty side gives difference 0 and p 1.
    """
    kinds = {f.name: f.dataType.simpleString() for f in scores.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit")
        x, flag = pdf["score"].to_numpy(float), pdf["is_event"].to_numpy(bool)
        k, rng, hits, total = int(flag.sum()), np.random.default_rng(seed), 0, 0.0
        own = {c: [pdf[c].iloc[0]] for c in keys}
        if k == 0 or k == len(x):
            return pd.DataFrame({**own, "delta": [0.0], "p": [1.0], "null_mean": [0.0]})
        delta = x[flag].mean() - x[~flag].mean()
        block = max(1, (1 << 20) // len(x))
        for at in range(0, n_perm, block):
            drawn = rng.permuted(np.tile(x, (min(block, n_perm - at), 1)), axis=1)
            d = drawn[:, :k].mean(axis=1) - drawn[:, k:].mean(axis=1)
            hits += int((d >= delta - 1e-12).sum())
            total += float(d.sum())
        return pd.DataFrame({**own, "delta": [delta], "p": [hits / n_perm], "null_mean": [total / n_perm]})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "delta double, p double, null_mean double"])
    return spread(scores.select(*keys, "unit", "score", "is_event"), keys).groupBy(*keys).applyInPandas(run, schema)


def phase_permutations(scores: DataFrame, comparisons: dict[str, tuple[str, str]], n_perm: int = 10_000, seed: str = "42") -> DataFrame:
    """comparison, delta, p and null_mean of ``permutation_hashed`` for each named pair of conditions (SQL over ``scores``: the event side, the other side)."""
    sides = [F.struct(F.lit(name).alias("comparison"), F.expr(f"({own}) OR ({other})").alias("taken"), F.expr(own).alias("is_event")) for name, (own, other) in comparisons.items()]
    rows = scores.select("unit", "score", F.explode(F.array(*sides)).alias("_c")).where("_c.taken").select("_c.comparison", "unit", "score", "_c.is_event")
    return permutation_hashed(rows, ["comparison"], n_perm, seed)


def null_differences(scores: DataFrame, keys: list[str], n_perm: int = 10_000, seed: str = "42", per_range: int = 256) -> DataFrame:
    """keys, the observed delta, and the difference d of every permutation, where labels go to the units with the smallest hash of (seed, permutation, unit), for a few groups of any size.

    ``scores``: keys, unit, score, is_event; written once.  The units of a permutation
    are counted and summed by ranges of their hash, read as a fraction: about the share
    that gets a label (``REACH`` standard errors to each side) ranges hold some ``per_range``
    units, below and above one range holds all.  Only the range in which the labels run
    out is ordered, whichever it is.  Groups without one of the sides are left out.
    """
    return _differences(written(scores.select(*keys, "unit", "score", "is_event"), "units"), keys, n_perm, seed, per_range)


def _differences(scores: DataFrame, keys: list[str], n_perm: int, seed: str, per_range: int) -> DataFrame:
    """``null_differences`` of a written table."""
    sides = _sides(scores, keys).where("delta IS NOT NULL")
    share = F.col("_k") / F.col("_n")
    reach = REACH * F.sqrt(share * (1 - share) / F.col("_n"))
    cuts = sides.withColumn("_top", F.ceil(2 * reach * F.col("_n") / per_range)).select(*keys, (share - reach).alias("_low"), (2 * reach / F.col("_top")).alias("_step"), "_top")
    rows = scores.where("score IS NOT NULL").select(*keys, "unit", "score").join(F.broadcast(cuts), keys)
    # A unit's hashes serve all of its groups.
    held = spread(rows, ["unit"]).groupBy("unit").agg(F.collect_list(F.struct(*keys, "score", "_low", "_step", "_top")).alias("_in"))
    drawn = held.select("unit", "_in", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("_perm"))
    drawn = drawn.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("_perm").cast("string"), F.col("unit").cast("string"))))
    drawn = drawn.withColumn("_x", F.conv(F.substring("_h", 1, 13), 16, 10).cast("double") / float(16**13))
    drawn = drawn.select("unit", "_perm", "_h", "_x", F.explode("_in").alias("_in")).select("unit", "_perm", "_h", "_x", "_in.*")
    drawn = drawn.withColumn("_r", F.greatest(F.lit(-1.0), F.least(F.col("_top").cast("double"), F.floor((F.col("_x") - F.col("_low")) / F.col("_step")).cast("double"))).cast("int"))
    per = drawn.groupBy(*keys, "_perm", "_r").agg(F.count("score").alias("_c"), F.sum("score").alias("_s"))
    before = Window.partitionBy(*keys, "_perm").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({"_c0": F.coalesce(F.sum("_c").over(before), F.lit(0)), "_s0": F.coalesce(F.sum("_s").over(before), F.lit(0.0))})
    last = per.join(F.broadcast(sides), keys).where("_c0 < _k AND _k <= _c0 + _c").select(*keys, "_perm", "_r", "_c0", "_s0", "_n", "_k", "_all", "delta")
    order = Window.partitionBy(*keys, "_perm").orderBy("_h", "unit")
    rest = drawn.select(*keys, "_perm", "_r", "_h", "unit", "score").join(F.broadcast(last), [*keys, "_perm", "_r"]).withColumn("_place", F.row_number().over(order)).where("_c0 + _place <= _k")
    picked = rest.groupBy(*keys, "_perm").agg((F.first("_s0") + F.sum("score")).alias("_own"), *[F.first(c).alias(c) for c in ("_n", "_k", "_all", "delta")])
    return picked.select(*keys, "delta", (F.col("_own") / F.col("_k") - (F.col("_all") - F.col("_own")) / (F.col("_n") - F.col("_k"))).alias("d"))


def _sides(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Size, sum and observed difference of each group; delta is NULL without one of the sides."""
    flag = F.col("is_event")
    sides = scores.groupBy(*keys).agg(
        F.count("score").alias("_n"), F.count(F.when(flag, F.col("score"))).alias("_k"), F.sum("score").alias("_all"), F.avg(F.when(flag, F.col("score"))).alias("_m1"), F.avg(F.when(~flag, F.col("score"))).alias("_m0")
    )
    return sides.withColumn("delta", F.col("_m1") - F.col("_m0"))


def permutation_hashed(scores: DataFrame, keys: list[str], n_perm: int = 10_000, seed: str = "42", per_range: int = 256) -> DataFrame:
    """keys, delta, p (one-sided) and null_mean of the test over ``null_differences``; a side without units gives 0, 1 and 0, differences are equal within 1e-9."""
    scores = written(scores.select(*keys, "unit", "score", "is_event"), "units")
    null = _differences(scores, keys, n_perm, seed, per_range)
    found = null.groupBy(*keys).agg(F.avg(F.when(F.col("d") >= F.col("delta") - 1e-9, 1.0).otherwise(0.0)).alias("p"), F.avg("d").alias("null_mean"))
    rows = _sides(scores, keys).select(*keys, "delta").join(found, keys, "left")
    return rows.select(*keys, F.coalesce("delta", F.lit(0.0)).alias("delta"), F.coalesce("p", F.lit(1.0)).alias("p"), F.coalesce("null_mean", F.lit(0.0)).alias("null_mean"))


def rank_biserial(scores: DataFrame, keys: list[str], score: str = "score", flag: str = "is_event", ranges: int = 0) -> DataFrame:
    """Mann-Whitney U of the flagged rows by mid-ranks, and 2 U / (n1 n0) - 1; no row where a side is empty.

    Rows without a flag count on no side; a missing score is the lowest.
    """
    hit = F.col(flag).cast("boolean")
    per = scores.groupBy(*keys, F.col(score).alias("_score")).agg(F.sum(hit.cast("long")).alias("_p"), F.sum((~hit).cast("long")).alias("_q"))
    per = running_sums(per, keys, [F.asc("_score")], "_score", {"_q0": "_q"}, False, ranges)
    sums = per.groupBy(*keys).agg(F.sum("_p").alias("n1"), F.sum("_q").alias("n0"), F.sum(F.col("_p") * (F.col("_q0") + F.col("_q") / 2.0)).alias("u")).where("n1 > 0 AND n0 > 0")
    return sums.select(*keys, "n1", "n0", "u", (2 * F.col("u") / (F.col("n1") * F.col("n0")) - 1).alias("r"))


def auc(scores: DataFrame, keys: list[str], score: str = "score", label: str = "y", ranges: int = 0) -> DataFrame:
    """Area under the ROC curve per group by mid-ranks; no row where a class is missing."""
    found = rank_biserial(scores.withColumn("_f", F.col(label) == 1), keys, score, "_f", ranges)
    return found.select(*keys, (F.col("u") / (F.col("n1") * F.col("n0"))).alias("auc"), "n1", "n0")


def roc_points(scores: DataFrame, keys: list[str], score: str = "score", label: str = "y", ranges: int = 0) -> DataFrame:
    """One point (threshold, fpr, tpr) per distinct score, descending, all collinear ones kept."""
    per = scores.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
    totals = per.groupBy(*keys).agg(F.sum("_p").alias("_all_p"), F.sum("_q").alias("_all_q")).where("_all_p > 0 AND _all_q > 0")
    rows = running_sums(per, keys, [F.desc("threshold")], "threshold", {"_tp": "_p", "_fp": "_q"}, True, ranges).join(totals, keys)
    return rows.select(*keys, "threshold", ((F.col("_fp") + F.col("_q")) / F.col("_all_q")).alias("fpr"), ((F.col("_tp") + F.col("_p")) / F.col("_all_p")).alias("tpr"))


def signed_rank(pairs: DataFrame, keys: list[str], difference: str = "d", least: int = 5, ranges: int = 0, error: str | None = None) -> DataFrame:
    """Wilcoxon signed-rank statistic of the non-zero differences with its two-sided p (1 under ``least`` differences).

    Ranks are those of distinct sizes; the p is exact up to 50 differences without
    ties, else by the normal approximation with the tie correction.  ``error`` names
    the column of what rounding may have made of a difference: one that is no larger
    is none, and neighbouring sizes that are no farther apart share a rank.
    """
    rows = pairs.where(F.abs(difference) > (F.col(error) if error else F.lit(0.0))).withColumn("_a", F.abs(difference))
    per = rows.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_c"), F.sum((F.col(difference) > 0).cast("long")).alias("_up"), F.max(error or F.lit(0.0)).alias("_e"))
    if error:
        order = Window.partitionBy(*keys).orderBy("_a")
        apart = F.col("_a") - F.lag("_a").over(order) > F.greatest("_e", F.lag("_e").over(order))
        size = F.sum("_apart").over(order.rowsBetween(Window.unboundedPreceding, 0))
        per = per.withColumn("_apart", F.coalesce(apart, F.lit(True)).cast("long")).withColumn("_size", size)
        per = per.groupBy(*keys, "_size").agg(F.min("_a").alias("_a"), F.sum("_c").alias("_c"), F.sum("_up").alias("_up"))
    per = running_sums(per, keys, [F.asc("_a")], "_a", {"_c0": "_c"}, False, ranges)
    rank = F.col("_c0") + (F.col("_c") + 1) / 2.0
    per = per.groupBy(*keys).agg(F.sum("_c").alias("n"), F.sum(F.col("_up") * rank).alias("w_plus"), F.sum((F.col("_c") * F.col("_c") * F.col("_c") - F.col("_c")).cast("double")).alias("_ties"))
    w = F.least(F.col("w_plus"), F.col("n") * (F.col("n") + 1) / 2.0 - F.col("w_plus"))
    return per.select(*keys, "n", "w_plus", w.alias("w"), F.when(F.col("n") >= least, wilcoxon_p(F.col("n").cast("long"), w, F.col("_ties"))).otherwise(1.0).alias("p"))


def paired_t(pairs: DataFrame, keys: list[str], difference: str = "d") -> DataFrame:
    """Paired t statistic and its two-sided p; none without spread or under two pairs."""
    per = pairs.groupBy(*keys).agg(F.count(difference).alias("n"), F.avg(difference).alias("mean_d"), F.stddev_samp(difference).alias("_sd"))
    t = F.when(F.col("_sd") > 0, F.col("mean_d") / (F.when(F.col("_sd") > 0, F.col("_sd")) / F.sqrt(F.col("n").cast("double"))))
    return per.select(*keys, "n", "mean_d", t.alias("t")).withColumn("p", t_p("t", (F.col("n") - 1).cast("double")))


def holm(df: DataFrame, keys: list[str], p: str = "p", tie: str | None = None, out: str = "p_holm") -> DataFrame:
    """Holm-Bonferroni corrected p within each group."""
    order = Window.partitionBy(*keys).orderBy(p, *([tie] if tie else []))
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    step = df.withColumn("_h", F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(order) + 1)))
    return step.withColumn(out, F.max("_h").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_h")
