"""Least squares for many nested or overlapping samples from one pass over the rows.

A linear fit only needs the cross products of [1, lag_1 .. lag_w, time terms, target].  Samples that overlap
(window sizes, folds) are unions of disjoint groups, so the products are summed once per group, a few numbers
each, and every fit is solved from sums of groups and from sub-blocks of them.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

#: A column whose share not explained by the constant or by the other columns is below this counts as dependent on them.
TINY = 1e-11


def design(lags: Column, usable: Column | int, sin: Column, cos: Column, target: Column, shift: Column) -> Column:
    """Array [1, lag_1 - shift, .., sin, cos, target - shift]; lags beyond ``usable`` are 0.

    Values are taken relative to ``shift`` (any constant near their mean), which keeps the sums accurate.
    """
    near = F.transform(lags, lambda x, k: F.when(k < usable, x - shift).otherwise(F.lit(0.0)))
    return F.concat(F.array(F.lit(1.0)), near, F.array(sin, cos, target - shift))


def cross_products(rows: DataFrame, vector: Column, by: Sequence[str]) -> DataFrame:
    """(by, m): per group the upper triangle of the summed outer products of ``vector``.

    ``by`` are whole-number columns with few distinct values.  A task sends one row per group it saw.
    """
    by = list(by)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            z = b.column("z")
            z = z.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            keys = np.stack([b.column(k).to_numpy() for k in by], axis=1)
            groups, owner = np.unique(keys, axis=0, return_inverse=True)
            order = np.argsort(owner.ravel(), kind="stable")
            cuts = np.searchsorted(owner.ravel()[order], np.arange(len(groups) + 1))
            for g, lo, hi in zip(map(tuple, groups.tolist()), cuts, cuts[1:]):
                part = z[order[lo:hi]]
                sums[g] = sums.get(g, 0.0) + part.T @ part
        if sums:
            upper = np.triu_indices(len(next(iter(sums.values()))))
            columns = [pa.array([g[i] for g in sums], pa.int64()) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m[upper].tolist() for m in sums.values()], pa.list_(pa.float64()))], names=[*by, "m"])

    slim = rows.select(*[F.col(k).cast("bigint").alias(k) for k in by], vector.alias("z"))
    parts = slim.mapInArrow(run, ", ".join(f"{k} bigint" for k in by) + ", m array<double>")
    return total(parts, by)


def total(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Arrays ``m`` added entry by entry per group; summed in the JVM, so a group's partial rows never meet in one task."""
    entries = parts.select(*by, F.posexplode("m").alias("pos", "x")).groupBy(*by, "pos").agg(F.sum("x").alias("x"))
    packed = entries.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("e"))
    return packed.select(*by, F.transform("e", lambda s: s["x"]).alias("m"))


def _unpacked(m: np.ndarray) -> np.ndarray:
    d = int((np.sqrt(8 * len(m) + 1) - 1) / 2)
    full = np.zeros((d, d))
    full[np.triu_indices(d)] = m
    return full + np.triu(full, 1).T


def solved(gram: np.ndarray, features: Sequence[int], target: int) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of the target on a constant (row 0 of ``gram``) and the features.

    Features without variance get 0; where features depend on each other the shortest solution (in units of their
    standard deviations) is taken.
    """
    features = list(features)
    n = gram[0, 0]
    mean, mean_y = gram[0, features] / n, gram[0, target] / n
    c = gram[np.ix_(features, features)] - n * np.outer(mean, mean)
    cy = gram[features, target] - n * mean * mean_y
    scale = np.sqrt(np.maximum(np.diag(c), 0.0))
    live = np.diag(c) > TINY * np.maximum(np.diag(gram)[features], 1e-300)
    beta = np.zeros(len(features))
    if live.any():
        s = scale[live]
        beta[live] = np.linalg.lstsq(c[np.ix_(live, live)] / np.outer(s, s), cy[live] / s, rcond=TINY)[0] / s
    return float(mean_y - mean @ beta), beta


FIT = (
    T.StructType()
    .add("n_fit", T.LongType())
    .add("lin_intercept", T.DoubleType())
    .add("lin_coefs", T.ArrayType(T.DoubleType()))
    .add("lin_sin", T.DoubleType())
    .add("lin_cos", T.DoubleType())
    .add("ar1_intercept", T.DoubleType())
    .add("ar1_slope", T.DoubleType())
    .add("train_seconds", T.DoubleType())
)


@F.pandas_udf(FIT)
def _fits(m: pd.Series, window: pd.Series, shift: pd.Series) -> pd.DataFrame:
    out = []
    for packed, w, c in zip(m, window, shift):
        begin = time.perf_counter()
        gram = _unpacked(np.asarray(packed, dtype=float))
        d = len(gram)
        lags = list(range(1, int(w) + 1))
        b0, beta = solved(gram, [*lags, d - 3, d - 2], d - 1)
        a0, slope = solved(gram, [1], d - 1)
        varied = gram[1, 1] - gram[0, 1] ** 2 / gram[0, 0] > TINY * gram[1, 1]
        ar1 = (a0 + c - c * slope[0], slope[0]) if varied else (None, None)
        seconds = time.perf_counter() - begin
        out.append((int(round(gram[0, 0])), b0 + c - c * beta[: len(lags)].sum(), beta[: len(lags)][::-1].tolist(), beta[-2], beta[-1], *ar1, seconds))
    return pd.DataFrame(out, columns=FIT.names)


def fits(moments: DataFrame, window: Column, shift: Column) -> DataFrame:
    """The key columns of ``moments`` (few rows) with the fits of a window: linear (oldest lag first) and AR(1).

    ``train_seconds`` is the time of the solve; the pass over the rows is shared by all fits.  AR(1) is null where
    lag_1 does not vary.
    """
    keys = [c for c in moments.columns if c != "m"]
    return moments.select(*keys, _fits("m", window, shift).alias("f")).select(*keys, "f.*")
