"""Skin conductance as a slow level, responses to sparse impulses, and noise: a convex decomposition.

The conductance y is explained by r + s: r is what a driver p, which is nowhere
negative and mostly zero, leaves through a filter of two exponential decays; s is a
cubic spline with a knot every ten seconds on a straight line.  Both are found together
as the minimum of

    1/2 |r + s - y|^2 + alpha sum(p) + gamma/2 |spline weights|^2,   p >= 0,

a quadratic programme.  What happens at one time hardly matters a few decays and knots
later, so a recording is cut into blocks with an overlap on both sides; blocks are
solved anywhere in the cluster, and of each its inner part is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frames import gap_fill

#: Published values: slow and fast decay (s), distance of knots (s), price of the driver and of the spline.
SLOW, FAST, KNOT, ALPHA, GAMMA = 2.0, 0.7, 10.0, 8e-4, 1e-2


def design(n: int, fs: float, slow: float = SLOW, fast: float = FAST, knot: float = KNOT) -> tuple[np.ndarray, np.ndarray, int]:
    """Columns of the phasic part (a driver's impulse at each sample from the third on, then two for what came before) and of the tonic part (splines, then the line), and the number of splines."""
    step, a, b = 1 / fs, 1 / min(slow, fast), 1 / max(slow, fast)
    poles = np.array([(a * step + 2) * (b * step + 2), 2 * a * b * step**2 - 8, (a * step - 2) * (b * step - 2)]) / ((a - b) * step**2)
    state = np.zeros((n, n))  # the filter's state for each column: an impulse, or 1 at one of the first two samples
    for k in range(min(2, n)):
        state[k, n - 2 + k if n >= 2 else 0] = 1.0
    for i in range(2, n):
        state[i] = (-poles[1] * state[i - 1] - poles[2] * state[i - 2]) / poles[0]
        state[i, i - 2] += 1 / poles[0]
    phasic = np.zeros((n, n))
    phasic[2:] = state[2:] + 2 * state[1:-1] + state[:-2]
    width = max(1, round(knot * fs))
    spline = np.convolve(*[np.concatenate([np.arange(1, width), np.arange(width, 0, -1)])] * 2).astype(float)
    spline /= spline.max()
    half, at = len(spline) // 2, np.arange(n)
    starts = np.arange(-half, n + half, width)
    offset = at[:, None] - starts[None, :] + half
    tonic = np.where((offset >= 0) & (offset < len(spline)), spline[np.clip(offset, 0, len(spline) - 1)], 0.0)
    return phasic, np.column_stack([tonic, np.ones(n), (at + 1) / n]), len(starts)


def solve(y: np.ndarray, fs: float, alpha: float = ALPHA, gamma: float = GAMMA, tolerance: float = 1e-9, steps: int = 80, **shape: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tonic part, phasic part and driver of one stretch, by a primal-dual interior-point method."""
    n = len(y)
    phasic, tonic, splines = design(n, fs, **shape)
    free = n - 2 if n > 2 else 0  # columns whose weights are the driver
    full = np.column_stack([phasic, tonic])
    quadratic, linear = full.T @ full, -(full.T @ y)
    at = np.arange(n, n + splines)
    quadratic[at, at] += gamma
    scale = max(1e-12, np.abs(np.diag(quadratic)).max())
    quadratic[np.diag_indices(len(quadratic))] += 1e-12 * scale  # columns that say the same (a short line and splines) share their weight
    linear[:free] += alpha
    x, price = np.zeros(len(linear)), np.ones(free)
    x[:free] = 1.0
    if not free:
        x = np.linalg.solve(quadratic, -linear)
    for _ in range(steps if free else 0):
        gap = x[:free] @ price / free
        dual = quadratic @ x + linear
        dual[:free] -= price
        if gap < tolerance * alpha and np.abs(dual).max() < tolerance * max(1.0, np.abs(linear).max()):
            break
        newton = quadratic.copy()
        newton[np.arange(free), np.arange(free)] += price / x[:free]
        inverse = np.linalg.inv(newton)

        def direction(centre: np.ndarray, inverse=inverse, dual=dual) -> tuple[np.ndarray, np.ndarray]:
            right = -dual
            right[:free] += centre / x[:free] - price
            dx = inverse @ right
            return dx, (centre - price * dx[:free]) / x[:free] - price

        def longest(dx: np.ndarray, dz: np.ndarray) -> float:
            ratios = [-v[v0 < 0] / v0[v0 < 0] for v, v0 in ((x[:free], dx[:free]), (price, dz))]
            return min(1.0, 0.995 * min((r.min() for r in ratios if len(r)), default=1.0))

        dx, dz = direction(np.zeros(free))
        reach = longest(dx, dz)
        after = (x[:free] + reach * dx[:free]) @ (price + reach * dz) / free
        dx, dz = direction((after / gap) ** 3 * gap - dx[:free] * dz)
        reach = longest(dx, dz)
        x, price = x + reach * dx, price + reach * dz
    driver = np.zeros(n)
    driver[n - free :] = x[:free]
    return tonic @ x[n:], phasic @ x[:n], driver


def decompose(samples: DataFrame, keys: list[str], fs: float, block: float = 60.0, overlap: float = 30.0, idx: str = "idx", value: str = "value", **shape: float) -> DataFrame:
    """keys, ``idx``, tonic, phasic and driver of every series; gaps are filled before (linear, nearest at the ends).

    Blocks are ``block`` seconds long, solved with ``overlap`` seconds on both sides.
    """
    size, beside = max(4, round(block * fs)), max(4, round(overlap * fs))
    rows = gap_fill(samples.select(*keys, F.col(idx).cast("long").alias("i"), F.col(value).cast("double").alias("_x")), keys, "i", "_x", "y").select(*keys, "i", "y")
    reach = F.sequence(F.greatest(F.lit(0), F.expr(f"(i - {beside}) div {size}")), F.expr(f"(i + {beside}) div {size}"))
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i, own = table.column("i").to_numpy(), table.column("block")[0].as_py()
        inner = (i >= own * size) & (i < (own + 1) * size)
        if not inner.any():
            table, parts = table.slice(0, 0), [np.zeros(0)] * 3
            inner = np.zeros(0, bool)
        else:
            parts = solve(table.column("y").to_numpy(), fs, **shape)
        kept = table.filter(pa.array(inner))
        return pa.table({**{k: kept.column(k) for k in keys}, idx: kept.column("i"), **{name: pa.array(v[inner]) for name, v in zip(("tonic", "phasic", "driver"), parts, strict=True)}})

    cut = rows.withColumn("block", F.explode(reach)).repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "block")
    return cut.groupBy(*keys, "block").applyInArrow(run, f"{kinds}, {idx} long, tonic double, phasic double, driver double")
