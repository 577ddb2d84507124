"""Small-sample p-values and quantiles used on per-pair summary rows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def t_cdf(t: float, df: int) -> float:
    """Student t distribution function for integer degrees of freedom (finite series)."""
    theta = math.atan2(t, math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df % 2:
        total, term = 0.0, c
        for k in range(3, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        area = 2.0 / math.pi * (theta + s * total)
    else:
        total, term = 0.0, 1.0
        for k in range(2, df + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        area = s * total
    return 0.5 * (1.0 + area)


@lru_cache(maxsize=None)
def t_quantile(p: float, df: int) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = 0.5 * (low + high)
        if t_cdf(mid, df) < p:
            low = mid
        else:
            high = mid
    return 0.5 * (low + high)


@lru_cache(maxsize=None)
def _rank_sum_counts(n: int) -> tuple[int, ...]:
    """Number of sign patterns of 1..n for each sum of positive ranks."""
    counts = [1]
    for r in range(1, n + 1):
        grown = counts + [0] * r
        for i, c in enumerate(counts):
            grown[i + r] += c
        counts = grown
    return tuple(counts)


def signed_rank_p(stat: float, n: int, ties: bool, tie_term: float, method: str = "exact") -> float:
    """Two-sided p of min(W+, W-).  ``exact`` counts sign patterns of distinct ranks; tied ranks, and ``normal``, take the normal law."""
    if n == 0:
        return float("nan")
    if not ties and method == "exact":
        counts = _rank_sum_counts(n)
        tail = sum(counts[: int(stat) + 1])
        return min(1.0, 2.0 * tail / 2**n)
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    if var <= 0:
        return float("nan")
    return math.erfc(abs(stat - mean) / math.sqrt(2.0 * var))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [2.0 * (1.0 - t_cdf(abs(a), int(b))) if pd.notna(a) and b >= 1 else np.nan for a, b in zip(t, df)]
    )


@F.pandas_udf(T.DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(float(a), max(int(b), 1)) for a, b in zip(p, df)])


@F.pandas_udf(T.DoubleType())
def wilcoxon_two_sided(stat: pd.Series, n: pd.Series, ties: pd.Series, tie_term: pd.Series) -> pd.Series:
    return pd.Series(
        [
            signed_rank_p(float(s), int(k), bool(t), float(v)) if pd.notna(s) else np.nan
            for s, k, t, v in zip(stat, n, ties, tie_term)
        ]
    )
