"""Tail probabilities for the tests: plain Python, and as Arrow functions on columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    total = 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d if abs(1 + term * d) > tiny else tiny)
        c = 1 + term / c if abs(1 + term / c) > tiny else tiny
        total *= c * d
        if k and abs(c * d - 1) < 1e-15:
            break
    return front * (total - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else math.nan


def signed_rank_p(n: int, w: float, ties: float) -> float:
    """Two-sided p of Wilcoxon's W (the smaller rank sum) of ``n`` non-zero differences; ``ties`` sums c**3 - c over groups of c equal sizes.

    Exact up to 50 differences without ties, else by the normal approximation with
    the tie correction.
    """
    if not n:
        return 1.0
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for r in range(1, n + 1):
            for s in range(len(ways) - 1, r - 1, -1):
                ways[s] += ways[s - r]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    z = (w - n * (n + 1) / 4) / sd if sd else 0.0
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([t_two_sided(a, b) if a == a and b == b else None for a, b in zip(t.astype(float), df.astype(float), strict=True)], dtype="Float64")


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided signed-rank p from the number of differences, W and the tie sum."""
    return pd.Series([signed_rank_p(int(a), float(b), float(c)) if a == a and b == b else None for a, b, c in zip(n, w, ties, strict=True)], dtype="Float64")


def stars(p):
    """Significance marks of a p column."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
