"""Chronological hold-out, blocked folds and the purge rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def chronological_split(
    obs: DataFrame, train_end: int, test_start: int, test_end: int, train_start: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by slot bounds; bad bounds or an empty side are errors."""
    if test_start > test_end:
        raise ValueError("test_start lies after test_end")
    if test_start <= train_end:
        raise ValueError("train and test overlap")
    slot = F.col("slot")
    in_train = slot <= train_end
    if train_start is not None:
        in_train = in_train & (slot >= train_start)
    in_test = slot.between(test_start, test_end)
    n_train, n_test = obs.agg(F.count_if(in_train), F.count_if(in_test)).first()
    if not n_train or not n_test:
        raise ValueError(f"empty side: train={n_train}, test={n_test} rows")
    return obs.filter(in_train), obs.filter(in_test)


def split_label(slot: Column, train_end: Column | int, test_start: Column | int, test_end: Column | int) -> Column:
    """'train', 'test' or null."""
    return F.when(slot <= train_end, "train").when((slot >= test_start) & (slot <= test_end), "test")


def split_metadata(train: DataFrame, test: DataFrame, step_seconds: int) -> DataFrame:
    """One document row: bounds, slot counts and pixel count of both sides."""

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.agg(
            F.min("slot").alias(f"{p}_start"),
            F.max("slot").alias(f"{p}_end"),
            F.count_distinct("slot").alias(f"n_{p}_timesteps"),
            F.count_distinct("pixel_id").alias(f"n_{p}_pixels"),
        )

    a = side(train, "train")
    b = side(test, "test")
    # one subquery for all values, so the test side is read once
    whole = b.select(F.struct(*b.columns).alias("s")).scalar()
    merged = a.select("*", *[whole[c].alias(c) for c in b.columns])
    return merged.select(
        F.lit("chronological").alias("method"),
        F.lit(step_seconds // 60).alias("frequency_minutes"),
        *merged.columns,
    )


def fold_bounds(first: int, last: int, n_folds: int) -> list[tuple[int, int, int]]:
    """(fold, val_start, val_end): equal blocks of positions, remainder to the last, end exclusive."""
    total = last - first + 1
    if total < n_folds:
        raise ValueError(f"{total} slots are too few for {n_folds} folds")
    size = total // n_folds
    starts = [first + k * size for k in range(n_folds)]
    return [(k + 1, a, b) for k, (a, b) in enumerate(zip(starts, [*starts[1:], last + 1]))]


def fold_table(first: int, last: int, n_folds: int, spark) -> DataFrame:
    return spark.createDataFrame(
        fold_bounds(first, last, n_folds), "fold bigint, val_start bigint, val_end bigint"
    )


def fold_rows(obs: DataFrame, n_folds: int) -> DataFrame:
    """``fold_table`` of the slots of ``obs`` without a look at them while the plan is built."""
    ends = obs.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).filter("lo is not null")
    size = _fold_size(F.col("lo"), F.col("hi"), n_folds)
    fold = ends.withColumns({"fold": F.explode(F.sequence(F.lit(1), F.lit(n_folds)).cast("array<bigint>")), "size": size})
    start = F.col("lo") + (F.col("fold") - 1) * F.col("size")
    end = F.when(F.col("fold") == n_folds, F.col("hi") + 1).otherwise(start + F.col("size"))
    return fold.select("fold", start.alias("val_start"), end.alias("val_end"))


def _fold_size(first: Column, last: Column, n_folds: int) -> Column:
    total = last - first + 1
    return F.when(total < n_folds, F.raise_error(F.lit(f"too few slots for {n_folds} folds"))).otherwise(F.floor(total / n_folds))


def fold_of(slot: Column, first: Column, last: Column, n_folds: int) -> Column:
    """1-based fold of a slot, straight from its position; 0 and less before the first slot."""
    size = _fold_size(first, last, n_folds)
    return F.least(F.floor((slot - first) / size), F.lit(n_folds - 1)) + 1


def with_fold_roles(obs: DataFrame, folds: DataFrame, radius: int, n_folds: int) -> DataFrame:
    """Each row once per fold with role 'train', 'val' or (dropped) purged.

    ``folds`` has ``n_folds`` rows, so the broadcast is bounded by that number.
    ``seam_slot`` closes the cut on the training side: it numbers the rows as if
    the purged stretch did not exist.
    """
    slot = F.col("slot")
    crossed = obs.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds)).cast("array<bigint>")))
    tagged = crossed.join(F.broadcast(folds), "fold")
    lo, hi = F.col("val_start") - radius, F.col("val_end") + radius
    role = F.when((slot >= F.col("val_start")) & (slot < F.col("val_end")), "val").when(
        (slot < lo) | (slot >= hi), "train"
    )
    removed = F.when(slot >= hi, hi - F.greatest(lo, F.col("_first"))).otherwise(F.lit(0))
    start = folds.agg(F.min("val_start")).scalar()
    return (
        tagged.withColumn("role", role)
        .filter("role is not null")
        .withColumn("_first", start)
        .withColumn("seam_slot", F.when(F.col("role") == "train", slot - removed).otherwise(slot))
        .drop("_first")
    )
