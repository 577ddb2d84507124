"""Expanding-window features: one anchor, windows that grow step by step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from kelvingrid.functions.scalars import guarded_ratio
from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.operators.blocks import BLOCK, block_of, series_scan
from kelvingrid.operators.samples import strided, valid_rows

FEATURES = [
    "mean_window",
    "std_window",
    "min_window",
    "max_window",
    "first_value",
    "last_value",
    "delta_first_last",
    "slope",
    "n_points",
]
TARGET = "target_tbb_13"
WINDOW_OFFSET = 4


def sum_of_squares_to(k: Column) -> Column:
    """0^2 + 1^2 + ... + k^2, also right for k = -1."""
    return k * (k + 1) * (2 * k + 1) / 6


def prefix_sums(obs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Running sums of y, y^2 and t*y along each series (t = slot; gaps add 0)."""
    y = F.coalesce(F.col("v"), F.lit(0.0))
    return series_scan(
        obs.select("pixel_id", "slot", "v"),
        {"sum_y": y, "sum_y2": y * y, "sum_ty": F.col("slot") * y},
        block=block,
    )


def features_from_sums(n, s, sy, sy2, sty, first, last, lowest, highest) -> dict[str, Column]:
    """The nine features of a window [s, s+n-1] from its sums."""
    mean = sy / n
    e = s + n - 1
    sum_t = n * (s + e) / 2
    sum_t2 = sum_of_squares_to(e) - sum_of_squares_to(s - 1)
    return {
        "mean_window": mean,
        "std_window": F.sqrt(F.greatest(sy2 / n - mean * mean, F.lit(0.0))),
        "min_window": lowest,
        "max_window": highest,
        "first_value": first,
        "last_value": last,
        "delta_first_last": last - first,
        "slope": guarded_ratio(n * sty - sum_t * sy, n * sum_t2 - sum_t * sum_t),
        "n_points": n,
    }


_SUMS = ("t", "d", "d2", "td", "lo", "hi", "y0")


def _sums_after(acc: Column, x: Column) -> Column:
    """Sums of a prefix extended by one value, taken relative to the first value,
    which keeps the variance and the slope accurate for values far from zero.

    The first value travels in the accumulator: a lambda re-evaluates what it
    refers to outside for every element.
    """
    d = x - acc["y0"]
    new = {
        "t": acc["t"] + 1.0,
        "d": acc["d"] + d,
        "d2": acc["d2"] + d * d,
        "td": acc["td"] + acc["t"] * d,
        "lo": F.least(acc["lo"], x),
        "hi": F.greatest(acc["hi"], x),
        "y0": acc["y0"],
    }
    return F.struct(*[new[c].alias(c) for c in _SUMS])


def _sums_at_start(first: Column) -> Column:
    return F.struct(*[(first if c in ("lo", "hi", "y0") else F.lit(0.0)).alias(c) for c in _SUMS])


def _from_shifted(sums: Column, first: Column, last: Column) -> dict[str, Column]:
    feats = features_from_sums(
        sums["t"], F.lit(0.0), sums["d"], sums["d2"], sums["td"], first, last, sums["lo"], sums["hi"]
    )
    feats["mean_window"] = feats["mean_window"] + first
    return feats


def array_features(values: Column) -> dict[str, Column]:
    """The nine features of one gathered window, in a single pass over the array."""
    first = F.element_at(values, 1)
    sums = F.aggregate(values, _sums_at_start(first), _sums_after)
    return _from_shifted(sums, first, F.element_at(values, -1))


def prefix_sum_array(values: Column) -> Column:
    """Array of the sums after 1, 2, ... values: one pass serves all growing windows."""
    first = F.element_at(values, 1)
    start = F.array(_sums_at_start(first))
    grown = F.aggregate(
        values, start, lambda acc, x: F.array_append(acc, _sums_after(F.element_at(acc, -1), x))
    )
    return F.slice(grown, F.lit(2), F.size(values))


def running_extremes(frames: DataFrame, values: str, first_len: int, last_len: int) -> DataFrame:
    """Min and max of the growing prefixes of a bounded array column."""
    grown = frames.withColumn("n", F.explode(F.sequence(F.lit(first_len), F.lit(last_len))))
    prefix = F.slice(F.col(values), F.lit(1), F.col("n"))
    return grown.withColumns({"min_window": F.array_min(prefix), "max_window": F.array_max(prefix)})


def anchored_spans(obs: DataFrame, span: int, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """(pixel_id, slot, span_values[span]) for every complete span start."""

    def columns(w: WindowSpec):
        return {
            "span_values": F.array(F.col("v"), *[F.lead("v", k).over(w) for k in range(1, span)]),
            "_ok": F.lead("slot", span - 1).over(w) - F.col("slot") == span - 1,
        }

    rows = valid_rows(obs).select("pixel_id", "slot", "v")
    return strided(rows, columns, 0, span - 1, stride, block).drop("v")


_PARTIAL = (
    "pixel_id string, start_slot bigint, end_slot bigint, n bigint, mean double, m2 double, t double, c double, "
    "lowest double, highest double, first double, last double"
)


class RangeExtremes:
    """Sparse table of a block: the extreme of every range whose length is a power of two, so any range needs two look-ups."""

    def __init__(self, values: np.ndarray, pick):
        self.pick, self.levels = pick, [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(pick(below[:-half], below[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Extremes of the ranges [lo, hi]."""
        level = np.floor(np.log2(hi - lo + 1)).astype(np.int64)
        out = np.empty(len(lo))
        for k in np.unique(level):
            at = level == k
            out[at] = self.pick(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << k) + 1])
        return out


def _block_parts(rows: pd.DataFrame, windows: pd.DataFrame) -> pd.DataFrame:
    """Moments and extremes of the part of every window that lies in this block of slots."""
    names = [f.split()[0] for f in _PARTIAL.split(", ")]
    if not len(windows) or not len(rows):
        return pd.DataFrame(columns=names)
    first = int(rows["slot"].min())
    at = (rows["slot"] - first).to_numpy()
    values = np.full(int(at.max()) + 1, np.nan)
    values[at] = rows["v"].to_numpy(dtype=float)
    known = ~np.isnan(values)
    shift = values[known].mean() if known.any() else 0.0
    d = np.where(known, values - shift, 0.0)
    t = np.arange(len(values), dtype=float)
    count, s1, s2, st, std = (np.r_[0.0, np.cumsum(x)] for x in (known, d, d * d, t * known, t * d))
    start, end = windows["start_slot"].to_numpy() - first, windows["end_slot"].to_numpy() - first
    lo, hi = np.maximum(start, 0), np.minimum(end, len(values) - 1)
    keep = lo <= hi
    windows, start, end, lo, hi = windows[keep], start[keep], end[keep], lo[keep], hi[keep]
    over = lambda sums: sums[hi + 1] - sums[lo]
    n = over(count)
    some = np.maximum(n, 1.0)
    inside = lambda where: np.where((where >= 0) & (where < len(values)), values[np.clip(where, 0, len(values) - 1)], np.nan)
    return pd.DataFrame(
        {
            "pixel_id": windows["pixel_id"],
            "start_slot": windows["start_slot"],
            "end_slot": windows["end_slot"],
            "n": n.astype(np.int64),
            "mean": shift + over(s1) / some,
            "m2": over(s2) - over(s1) ** 2 / some,
            "t": over(st) / some - start,
            "c": over(std) - over(st) * over(s1) / some,
            "lowest": RangeExtremes(np.where(known, values, np.inf), np.minimum).of(lo, hi),
            "highest": RangeExtremes(np.where(known, values, -np.inf), np.maximum).of(lo, hi),
            "first": inside(start),
            "last": inside(end),
        }
    )


def windowed_features(obs: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Features of given complete windows (pixel_id, start_slot, end_slot).

    Rows are shuffled once, by (pixel, block of slots), and meet the windows that reach into the block.  A block answers
    from running sums and from sparse tables for minimum and maximum, whatever the length of a window; a window that spans
    several blocks puts their parts together.  Sums are taken relative to the block's mean.
    """
    place = F.explode(F.sequence(block_of(F.col("start_slot"), block), block_of(F.col("end_slot"), block)))
    asked = windows.select("pixel_id", "start_slot", "end_slot").distinct().withColumn("_block", place)
    rows = obs.select("pixel_id", "slot", "v", block_of(F.col("slot"), block).alias("_block"))
    parts = rows.groupBy("pixel_id", "_block").cogroup(asked.groupBy("pixel_id", "_block")).applyInPandas(_block_parts, _PARTIAL)
    n, mean, t = F.col("n"), F.col("mean"), F.col("t")
    known = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    whole = parts.filter("n > 0").groupBy("pixel_id", "start_slot", "end_slot").agg(
        F.sum("n").cast("double").alias("_n"),
        (F.sum(n * mean) / F.sum(n)).alias("_mean"),
        (F.sum(n * t) / F.sum(n)).alias("_t"),
        F.count(F.lit(1)).alias("_parts"),
        F.sum("m2").alias("_m2"),
        F.sum("c").alias("_c"),
        F.sum(n * mean * mean).alias("_mm"),
        F.sum(n * t * mean).alias("_tm"),
        F.min("lowest").alias("_lo"),
        F.max("highest").alias("_hi"),
        known("first").alias("_first"),
        known("last").alias("_last"),
    )
    size = F.col("_n")
    # what the parts' means add; nothing, and no rounding, where a window lies in one block
    between = lambda sums, product: F.when(F.col("_parts") > 1, F.col(sums) - size * product).otherwise(F.lit(0.0))
    spread = F.col("_m2") + between("_mm", F.col("_mean") * F.col("_mean"))
    slope = F.col("_c") + between("_tm", F.col("_t") * F.col("_mean"))
    feats = {
        "mean_window": F.col("_mean"),
        "std_window": F.sqrt(F.greatest(spread / size, F.lit(0.0))),
        "min_window": F.col("_lo"),
        "max_window": F.col("_hi"),
        "first_value": F.col("_first"),
        "last_value": F.col("_last"),
        "delta_first_last": F.col("_last") - F.col("_first"),
        "slope": guarded_ratio(slope, size * (size * size - 1) / 12),
        "n_points": size,
    }
    return whole.filter(size == F.col("end_slot") - F.col("start_slot") + 1).select("pixel_id", "start_slot", "end_slot", *[feats[f].alias(f) for f in FEATURES])


def expanding_samples(
    obs: DataFrame,
    axis: TimeAxis,
    horizon: int = 18,
    offset: int = WINDOW_OFFSET,
    stride: int = 1,
    pixel_dim: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """One row per anchor and step: window [a, a+offset+step], target one slot later."""
    span = horizon + offset + 2
    spans = anchored_spans(obs, span, stride, block)
    y = F.col("span_values")
    sums = spans.withColumn("_sums", prefix_sum_array(F.slice(y, F.lit(1), F.lit(span - 1))))
    grown = F.posexplode(F.slice("_sums", F.lit(offset + 2), F.lit(horizon))).alias("_k", "_s")
    rows = sums.select("pixel_id", "slot", "span_values", grown).withColumn("step", F.col("_k") + 1)
    length = F.col("step") + F.lit(offset + 1)
    rows = rows.withColumn(TARGET, F.element_at(y, length + 1))
    feats = _from_shifted(F.col("_s"), F.element_at(y, 1), F.element_at(y, length))
    keys = ["pixel_id"]
    rows = rows.withColumns(
        {
            "anchor_t0": axis.time(F.col("slot")),
            "target_time": axis.time(F.col("slot") + length),
            **feats,
        }
    )
    if pixel_dim is not None:
        rows = rows.join(pixel_dim.select("pixel_id", "latitude", "longitude"), "pixel_id", "left")
        keys += ["latitude", "longitude"]
    return rows.select(*keys, "slot", "anchor_t0", "step", "target_time", *FEATURES, TARGET)
