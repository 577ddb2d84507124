"""Augmented Dickey-Fuller check for every pixel.

No task ever sees a whole series.  The regression only needs the cross-product
matrix of [constant, y(t-1), dy(t), dy(t-1) .. dy(t-m)]; blocks contribute
partial matrices that are summed, and the small solves run per pixel.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from kelvingrid.operators.blocks import BLOCK, with_halo
from kelvingrid.operators.climate import compacted

MIN_POINTS = 20

#: A regressor is dependent if less than this share of its square sum is left by the earlier ones.
DEPENDENT = 1e-12
#: Series that are solved at a time.
STACK = 1024

# MacKinnon (1994) response surface, constant, one variable.
TAU_STAR = -1.61
TAU_MIN = -18.83
TAU_MAX = 2.74
SMALL_P = [2.1659, 1.4412, 0.038269]
LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]

_PART = "pixel_id string, series_n bigint, max_lag int, pos int, x double"


def default_max_lag(n: int) -> int:
    """Schwert's rule, bounded by the sample."""
    return max(0, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def mackinnon_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    coefs = SMALL_P if stat <= TAU_STAR else LARGE_P
    z = sum(c * stat**i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _design(y: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Rows [1, y(t-1), dy(t), dy(t-1) .. dy(t-m)] for the positions ``at`` of y."""
    dy = np.diff(y)
    cols = [np.ones(len(at)), y[at - 1]]
    cols += [dy[at - 1 - k] for k in range(m + 1)]
    return np.column_stack(cols) if len(at) else np.zeros((0, m + 3))


def _block_products(rows: pd.DataFrame, fixed_lag: int | None) -> pd.DataFrame:
    rows = rows.sort_values("slot")
    n = int(rows["series_n"].iloc[0])
    m = default_max_lag(n) if fixed_lag is None else min(fixed_lag, n // 2 - 2)
    y = rows["d"].to_numpy()
    slot = rows["slot"].to_numpy()
    own = rows["_own"].to_numpy()
    at = np.flatnonzero(own & (slot >= m + 1))
    x = _design(y, at, m)
    gram = (x.T @ x).ravel()
    pos = np.arange(len(gram))
    head = np.flatnonzero(own & (slot <= m))
    pos = np.concatenate([pos, -1 - slot[head]])
    values = np.concatenate([gram, y[head]])
    return pd.DataFrame(
        {"pixel_id": rows["pixel_id"].iloc[0], "series_n": n, "max_lag": m, "pos": pos, "x": values}
    )


def nested_fits(xtx: np.ndarray, xty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(explained, independent) of a stack of regressions, per regressor in the order given.

    One Cholesky factorisation per stack answers every nested regression: the sum of squares explained by the first j
    regressors is the sum of the first j entries.  The square root of an entry, with the sign of its coefficient, over
    the residual deviation is the t statistic of the last regressor.  Regressors that depend on earlier ones explain nothing.
    """
    size = xtx.shape[1]
    low, z, independent = np.zeros(xtx.shape), np.zeros(xty.shape), np.zeros(xty.shape, bool)
    for j in range(size):
        column = xtx[:, j:, j] - (low[:, j:, :j] @ low[:, j, :j, None])[:, :, 0]
        pivot = column[:, 0]
        ok = independent[:, j] = pivot > DEPENDENT * xtx[:, j, j]
        root = np.sqrt(np.where(ok, pivot, 1.0))
        low[:, j:, j] = np.where(ok[:, None], column / root[:, None], 0.0)
        z[:, j] = np.where(ok, (xty[:, j] - (low[:, j, :j] * z[:, :j]).sum(1)) / root, 0.0)
    return z, independent


def _head_products(head: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Cross products of the rows ``lag`` + 1 .. m, which the common sample of all lags leaves out, of a stack of series."""
    count, m = head.shape[0], head.shape[1] - 1
    dy = np.diff(head, axis=1)
    rows = np.zeros((count, m, m + 3))
    rows[:, :, 0], rows[:, :, 1] = 1.0, head[:, :-1]
    for k in range(m):
        rows[:, k:, 2 + k] = dy[:, : m - k]
    rows[np.arange(1, m + 1)[None, :] <= lag[:, None]] = 0.0
    return np.swapaxes(rows, 1, 2) @ rows


def adf_from_products(gram: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, chosen lags) of a stack: AIC on the common sample, then a refit on all rows the lag allows.

    ``gram`` is (series, m + 3, m + 3), ``head`` (series, m + 1) the first values.
    """
    m = gram.shape[1] - 3
    lags = np.arange(3, m + 3)
    order = np.r_[0, 1, lags]
    z, _ = nested_fits(gram[:, order][:, :, order], gram[:, order, 2])
    rows, total = gram[:, 0, 0], gram[:, 2, 2]
    ssr = total[:, None] - np.cumsum(z * z, axis=1)[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        aic = rows[:, None] * (np.log(2 * np.pi * ssr / rows[:, None]) + 1) + 2 * (np.arange(m + 1) + 2)
    best = np.where(ssr > DEPENDENT * total[:, None], aic, np.inf).argmin(1)

    full = gram + _head_products(head, best)
    used = np.arange(m + 3)[None, :] <= best[:, None] + 2  # the other lags count as dependent regressors
    full = np.where(used[:, :, None] & used[:, None, :], full, 0.0)
    order = np.r_[0, lags, 1]
    z, independent = nested_fits(full[:, order][:, :, order], full[:, order, 2])
    left = full[:, 2, 2] - (z * z).sum(1)
    dof = np.rint(full[:, 0, 0]) - (best + 2)
    known = independent[:, -1] & (dof > 0) & (left > DEPENDENT * full[:, 2, 2])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(known, z[:, -1] / np.sqrt(left / dof), np.nan), best


_RESULT = (
    T.StructType().add("adf_stat", T.DoubleType()).add("p_value", T.DoubleType()).add("used_lag", T.IntegerType())
)


@F.pandas_udf(_RESULT)
def _solve(products: pd.Series, head: pd.Series, m: pd.Series) -> pd.DataFrame:
    """Series with one number of lags are solved together, ``STACK`` at a time."""
    stat, used = np.full(len(m), np.nan), np.zeros(len(m), np.int32)
    lags = m.to_numpy()
    for lag in np.unique(lags).tolist():
        rows = np.flatnonzero(lags == lag)
        for lo in range(0, len(rows), STACK):
            at = rows[lo : lo + STACK]
            gram = np.stack([products.iloc[i] for i in at]).astype(float).reshape(-1, lag + 3, lag + 3)
            stat[at], used[at] = adf_from_products(gram, np.stack([head.iloc[i] for i in at]).astype(float))
    p_value = [mackinnon_p(s) if s == s else math.nan for s in stat.tolist()]
    return pd.DataFrame({"adf_stat": stat, "p_value": p_value, "used_lag": used})


def unit_root(obs: DataFrame, max_lag: int | None = None, block: int = BLOCK, min_points: int = MIN_POINTS) -> DataFrame:
    """(pixel_id, adf_stat, p_value, is_stationary_5pct, n_obs_used) for every pixel.

    Nulls are dropped first; fewer than ``min_points`` values give a null verdict.
    """
    rows = compacted(obs, block).withColumn("d", F.col("v") - F.col("series_mean"))
    long_enough = rows.filter(F.col("series_n") >= min_points)
    longest = rows.agg(F.max("series_n")).first()[0] or 0
    reach = (default_max_lag(longest) if max_lag is None else max_lag) + 2
    parts = (
        with_halo(long_enough, reach, 0, block)
        .groupBy("pixel_id", "_block")
        .applyInPandas(lambda pdf: _block_products(pdf, max_lag), _PART)
    )
    summed = parts.groupBy("pixel_id", "series_n", "max_lag", "pos").agg(F.sum("x").alias("x"))
    # at most (max_lag + 3)^2 + max_lag + 1 numbers per pixel
    packed = summed.groupBy("pixel_id", "series_n", "max_lag").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "x")))).alias("g"),
        F.array_sort(F.collect_list(F.when(F.col("pos") < 0, F.struct((-F.col("pos")).alias("pos"), "x")))).alias("h"),
    )
    solved = packed.select(
        "pixel_id",
        _solve(F.transform("g", lambda s: s["x"]), F.transform("h", lambda s: s["x"]), F.col("max_lag")).alias("r"),
    )
    counts = obs.groupBy("pixel_id").agg(
        F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("n_obs_used")
    )
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    return counts.join(solved, "pixel_id", "left").select(
        "pixel_id",
        known("r.adf_stat").alias("adf_stat"),
        known("r.p_value").alias("p_value"),
        (known("r.p_value") < 0.05).alias("is_stationary_5pct"),
        "n_obs_used",
    )


def stationary_count(tests: DataFrame) -> DataFrame:
    return tests.agg(
        F.count_if("is_stationary_5pct").alias("n_stationary"),
        F.count("is_stationary_5pct").alias("n_tested"),
        F.count(F.lit(1)).alias("n_pixels"),
    )
