"""Vectorized helpers over short array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def partial_autocorrelations(r: np.ndarray) -> np.ndarray:
    """Levinson recursion on a stack: row i of ``r`` holds the autocovariances of lag 0..L of one series.

    Lag 0 is 1; a series without variance has NaN elsewhere.
    """
    out = np.full(r.shape, np.nan)
    out[:, :1] = 1.0
    phi, err = np.zeros(r.shape), r[:, 0].copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(1, r.shape[1]):
            back = phi[:, k - 1 : 0 : -1].copy()
            step = (r[:, k] - (phi[:, 1:k] * r[:, k - 1 : 0 : -1]).sum(1)) / err
            phi[:, 1:k] -= step[:, None] * back
            phi[:, k] = out[:, k] = step
            err *= 1.0 - step * step
    out[r[:, 0] == 0, 1:] = np.nan
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def durbin_levinson(sums: pd.Series, n: pd.Series) -> pd.Series:
    """Partial autocorrelations of lag 0..L from lagged product sums, per row; rows of one length are solved together."""
    out = pd.Series([None] * len(sums), index=sums.index, dtype=object)
    for size, rows in sums.groupby(sums.map(len)):
        stack = np.stack(rows.to_list()).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = stack / (n[rows.index].to_numpy(dtype=float)[:, None] - np.arange(size))
        out[rows.index] = pd.Series(list(partial_autocorrelations(r)), index=rows.index, dtype=object)
    return out
