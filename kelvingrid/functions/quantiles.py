"""Exact interpolated quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kelvingrid.functions.joins import null_safe_join
from kelvingrid.session import written

ACCURACY = 10_000


def running_counts(counted: DataFrame, keys: Sequence[str], order: str, count: str) -> DataFrame:
    """``counted`` plus ``_to``: the sum of ``count`` over the rows of the same keys up to this one in ``order``.

    Rows are dealt by ranges of (keys, order), so a key with many rows lies in many parts; a window adds up the rows
    of one part, and a carry table with one row per (key, part) adds what the parts before hold.  The order must not have ties.
    """
    dealt = counted.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id())
    parts = written(dealt, "ranks")  # a part number holds for the stored rows only
    inside = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.groupBy("_part", *keys).agg(F.sum(count).alias("_sum"))
    carry = carry.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    here = parts.withColumn("_to", F.sum(count).over(inside))
    both = null_safe_join(here, carry, ["_part", *keys])
    return both.withColumn("_to", F.col("_to") + F.col("_before")).drop("_part", "_before")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    accuracy: int = ACCURACY,
    extras: Mapping[str, Column] | None = None,
) -> DataFrame:
    """keys + n + one column per entry of ``probs`` (linear interpolation) + ``extras``.

    ``extras`` are aggregates over ``keys`` (written over the column ``_x``) that
    ride along in the first pass.  Keys with null values only keep a row.

    Pass 1 (partial aggregates): count and approximate quantiles that bracket each
    target rank with a guaranteed error; one row per key, written as a table, so that
    Spark knows its size and broadcasts it only where it is small.  Pass 2: values inside a bracket keep their identity, all values
    between brackets fall into one row with their count, least and greatest; equal values
    are counted before the shuffle, so neither the rows nor their keys are shuffled.  Ranking then
    runs over at most a few rows per thousand of the distinct values, with exact
    counts; the values of one key are ranked in many tasks (``running_counts``).  A rank that no bracket and no edge of a region holds is an error.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("quantiles need at least one key column")
    x = F.col(value)
    extras = dict(extras or {})
    rows = df.select(*keys, x.alias("_x"))
    margin = 3.0 / accuracy
    cuts = sorted({min(max(q + d, 0.0), 1.0) for q in probs.values() for d in (-margin, margin)})
    edges = written(
        rows.groupBy(*keys).agg(
            F.count("_x").alias("n"),
            F.percentile_approx("_x", [float(c) for c in cuts], accuracy).alias("_cuts"),
            F.min("_x").alias("_min"),
            F.max("_x").alias("_max"),
            *[c.alias(name) for name, c in extras.items()],
        ),
        "brackets",
    )

    def cut(q: float, d: float) -> Column:
        c = min(max(q + d, 0.0), 1.0)
        return F.col("_min" if d < 0 else "_max") if c in (0.0, 1.0) else F.element_at("_cuts", cuts.index(c) + 1)

    sides = []
    for i, q in enumerate(probs.values()):
        sides += [cut(q, -margin).alias(f"_lo{i}"), cut(q, margin).alias(f"_hi{i}")]
    brackets = edges.select(*keys, *sides)
    joined = null_safe_join(rows, brackets, keys)
    v = F.col("_x")
    within, below, started = F.lit(False), F.lit(0), F.lit(0)
    for i in range(len(probs)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        within = within | ((v >= lo) & (v <= hi))
        below = below + (hi < v).cast("int")
        started = started + (lo <= v).cast("int")
    region = below * 100 + started
    counted = (
        joined.filter(v.isNotNull())
        .groupBy(*keys, F.when(~within, region).alias("_region"), F.when(within, v).alias("_v"))
        .agg(F.count("_x").alias("_c"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    )
    ranked = null_safe_join(running_counts(counted, keys, "_first", "_c"), edges.select(*keys, "n"), keys)

    def pick(rank: Column) -> Column:
        hit = (rank > F.col("_to") - F.col("_c")) & (rank <= F.col("_to"))
        edge = (
            F.when(F.col("_v").isNotNull(), F.col("_v"))
            .when(rank == F.col("_to") - F.col("_c") + 1, F.col("_first"))
            .when(rank == F.col("_to"), F.col("_last"))
            .otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
        )
        return F.max(F.when(hit, edge))

    h = {name: F.lit(float(q)) * (F.col("n") - 1) for name, q in probs.items()}
    picks = []
    for name in probs:
        picks += [pick(F.floor(h[name]) + 1).alias(f"_f_{name}"), pick(F.ceil(h[name]) + 1).alias(f"_c_{name}")]
    found = ranked.groupBy(*keys).agg(*picks)
    out = null_safe_join(edges.select(*keys, "n", *extras), found, keys, "left")
    mixed = []
    for name in probs:
        low, high = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        mixed.append((low + (high - low) * (h[name] - F.floor(h[name]))).alias(name))
    return out.select(*keys, "n", *extras, *mixed)
