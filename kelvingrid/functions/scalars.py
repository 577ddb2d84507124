"""Column expressions: local time, risk classes, errors, damping, formats."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed values of the domain.
LOCAL_OFFSET_HOURS = 7
COLD_LIMIT = 200.0
CLEAR_LIMIT = 270.0
MINUTES_PER_DAY = 1440
SIZE_UNITS = ["B", "KB", "MB", "GB"]


def nan_to_null(v: Column) -> Column:
    """NaN is a gap; Spark would treat it as a value."""
    return F.when(~F.isnan(v), v)


def to_local(ts: Column, hours: int = LOCAL_OFFSET_HOURS) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def local_minute(ts: Column, hours: int = LOCAL_OFFSET_HOURS) -> Column:
    local = to_local(ts, hours)
    return F.hour(local) * 60 + F.minute(local)


def local_hour(ts: Column, hours: int = LOCAL_OFFSET_HOURS) -> Column:
    return F.hour(to_local(ts, hours))


def cyclic_time(ts: Column, hours: int = LOCAL_OFFSET_HOURS) -> tuple[Column, Column]:
    """(hour_sin, hour_cos) of the local time of day."""
    angle = local_minute(ts, hours) * F.lit(2.0 * math.pi / MINUTES_PER_DAY)
    return F.sin(angle), F.cos(angle)


def cyclic_values(seconds: np.ndarray, hours: int = LOCAL_OFFSET_HOURS) -> tuple[np.ndarray, np.ndarray]:
    """``cyclic_time`` of whole seconds since 1970."""
    angle = (seconds + hours * 3600) // 60 % MINUTES_PER_DAY * (2.0 * math.pi / MINUTES_PER_DAY)
    return np.sin(angle), np.cos(angle)


def risk_class(v: Column, low: float = COLD_LIMIT, high: float = CLEAR_LIMIT) -> Column:
    """Half-open classes: below low, [low, high), from high up."""
    return (
        F.when(v < low, "deep_convective")
        .when(v < high, "moderate_cloud")
        .when(v >= high, "clear")
    )


def risk_code(v: Column, low: float = COLD_LIMIT, high: float = CLEAR_LIMIT) -> Column:
    """Map status with a closed middle class: 2 below low, 1 in [low, high], 0 above."""
    return F.when(v < low, 2).when(v <= high, 1).when(v > high, 0)


def signed_error(pred: Column, truth: Column) -> Column:
    return pred - truth


def abs_error(pred: Column, truth: Column) -> Column:
    return F.abs(pred - truth)


def damping_weight(k: Column, rate: float, cap: float) -> Column:
    """Weight of the initial-window mean; ``k`` is 0 for the first step."""
    return F.least(F.lit(float(rate)) * k, F.lit(float(cap)))


def blend(pred: Column, reference: Column, weight: Column) -> Column:
    return (F.lit(1.0) - weight) * pred + weight * reference


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def clipped_std(mean_sq: Column, mean: Column) -> Column:
    """sqrt(E[y^2] - E[y]^2) with rounding noise below zero clipped."""
    return F.sqrt(F.greatest(mean_sq - mean * mean, F.lit(0.0)))


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is exactly 0."""
    return F.when(denominator != 0, numerator / denominator).otherwise(F.lit(0.0))


def pct_change(before: Column, after: Column) -> Column:
    """Null when the base is missing or zero."""
    return F.when(before != 0, (after - before) / F.abs(before) * 100)


def compact_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmm")


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def split_label(spec: Column) -> tuple[Column, Column]:
    """``path:label`` cut at the last colon, both parts trimmed."""
    label = F.substring_index(spec, ":", -1)
    path = F.substring(spec, F.lit(1), F.length(spec) - F.length(label) - 1)
    return F.trim(path), F.trim(label)


def two_decimals(x: Column) -> Column:
    """``%.2f`` as C and Python print it: the exact binary value, ties to the even digit.

    ``format_string`` rounds the shortest decimal form and ties upwards.  The fraction is cut in two parts, each with an exact
    product by 100, so the comparison with one half is exact as well.
    """
    size = F.abs(x)
    whole = F.floor(size)
    fraction = size - whole
    high = F.floor(fraction * F.lit(2.0**26)) / F.lit(2.0**26)
    low = (fraction - high) * 100
    cents = F.floor(high * 100)
    gap = F.lit(0.5) - (high * 100 - cents)
    up = (low > gap) | ((low == gap) & (cents % 2 == 1))
    total = whole * 100 + cents + up.cast("int")
    digits = F.concat(F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))
    exact = F.concat(F.when(x < 0, "-").otherwise(""), digits)
    # from 2^53 on a double has no fraction
    return F.when(size < F.lit(2.0**53), exact).when(x.isNotNull(), F.format_string("%.2f", x))


def human_size(n: Column) -> Column:
    """Byte count with two decimals and a binary unit, rounded as the text formats of C and Python do; null for null."""
    out = F.concat(two_decimals(n / F.lit(float(1024 ** len(SIZE_UNITS)))), F.lit("TB"))
    for power in reversed(range(len(SIZE_UNITS))):
        size = n / F.lit(float(1024**power))
        out = F.when(size < 1024, F.concat(two_decimals(size), F.lit(SIZE_UNITS[power]))).otherwise(out)
    return out
