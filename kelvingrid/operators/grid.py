"""Uniform time grid with explicit gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kelvingrid.functions.scalars import nan_to_null
from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.operators.blocks import BLOCK, block_of


def slotted(obs: DataFrame, axis: TimeAxis, ts: str = "ts") -> DataFrame:
    """Exact-match snapping: off-grid rows are dropped, NaN becomes null."""
    return (
        obs.filter(axis.on_grid(F.col(ts)))
        .withColumn("slot", axis.slot(F.col(ts)))
        .withColumn("v", nan_to_null(F.col("v").cast("double")))
    )


def off_grid_count(obs: DataFrame, axis: TimeAxis, ts: str = "ts") -> DataFrame:
    """How many rows the exact match keeps and drops."""
    hit = axis.on_grid(F.col(ts))
    return obs.agg(F.count_if(hit).alias("n_on_grid"), F.count_if(~hit).alias("n_off_grid"))


def latest_wins(obs: DataFrame, order: str | Column, keys=("pixel_id", "slot"), value: str = "v") -> DataFrame:
    """One row per key: the value that comes last in ``order`` (for files: the path)."""
    order = F.col(order) if isinstance(order, str) else order
    return obs.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def slot_bounds(obs: DataFrame) -> DataFrame:
    return obs.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))


def _slots_between(df: DataFrame, lo: Column, hi: Column, block: int) -> DataFrame:
    """Add ``slot`` for all lo..hi; blocks first, dealt over the cores, so no row carries a long array and no task all slots."""
    parallel = df.sparkSession.sparkContext.defaultParallelism
    return (
        df.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .withColumn("_block", F.explode(F.sequence(block_of(F.col("_lo"), block), block_of(F.col("_hi"), block))))
        .repartition(parallel)
        .withColumn(
            "slot",
            F.explode(
                F.sequence(
                    F.greatest(F.col("_lo"), F.col("_block") * F.lit(block)),
                    F.least(F.col("_hi"), F.col("_block") * F.lit(block) + F.lit(block - 1)),
                )
            ),
        )
        .drop("_lo", "_hi", "_block")
    )


def timeline(obs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All slots from the first to the last observed one."""
    bounds = slot_bounds(obs).filter("lo is not null")
    return _slots_between(bounds, F.col("lo"), F.col("hi"), block).select("slot")


def dense_grid(obs: DataFrame, pixel_dim: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every (slot, pixel) with the value or null.

    Slots are generated per pixel from the two bounds (scalar subqueries), so no
    join builds the product; the value comes in by an equi-join on (pixel, slot).
    """
    bounds = slot_bounds(obs).select(F.struct("lo", "hi").alias("b")).scalar()
    cells = pixel_dim.select("pixel_id")
    frame = _slots_between(cells, bounds["lo"], bounds["hi"], block)
    return frame.join(obs.select("pixel_id", "slot", "v"), ["pixel_id", "slot"], "left")


def bounding_box(pixel_dim: DataFrame, south: float, north: float, west: float, east: float, digits: int = 6) -> DataFrame:
    """Pixels whose rounded centre lies in the box, borders included."""
    inside = F.round("latitude", digits).between(south, north) & F.round("longitude", digits).between(west, east)
    return pixel_dim.filter(inside)


def any_left(rows: DataFrame) -> DataFrame:
    """One row: whether a selection holds anything."""
    return rows.agg((F.count(F.lit(1)) > 0).alias("any_left"))


def pixel_dimension(scene: DataFrame, lats: str = "latitude", lons: str = "longitude") -> DataFrame:
    """Row-major pixel table from one header row with the two coordinate arrays."""
    rows = scene.select(lons, F.posexplode(lats).alias("lat_idx", "latitude_"))
    cells = rows.select("lat_idx", "latitude_", F.posexplode(lons).alias("lon_idx", "longitude_"))
    return cells.select(
        F.concat_ws("_", "lat_idx", "lon_idx").alias("pixel_id"),
        "lat_idx",
        "lon_idx",
        F.col("latitude_").cast("double").alias("latitude"),
        F.col("longitude_").cast("double").alias("longitude"),
    )


def attach_pixels(df: DataFrame, pixel_dim: DataFrame, columns=("latitude", "longitude")) -> DataFrame:
    """Pixel columns by equi-join; Spark broadcasts the dimension when it is small."""
    return df.join(pixel_dim.select("pixel_id", *columns), "pixel_id", "left")


def grid_geometry(pixel_dim: DataFrame) -> DataFrame:
    """Cell step, half-cell padded extent and center latitude."""
    ext = pixel_dim.agg(
        F.min("latitude").alias("lat_min"),
        F.max("latitude").alias("lat_max"),
        F.min("longitude").alias("lon_min"),
        F.max("longitude").alias("lon_max"),
        F.max("lat_idx").alias("a"),
        F.max("lon_idx").alias("b"),
    )
    lat_step = F.when(F.col("a") > 0, (F.col("lat_max") - F.col("lat_min")) / F.col("a")).otherwise(F.lit(0.0))
    lon_step = F.when(F.col("b") > 0, (F.col("lon_max") - F.col("lon_min")) / F.col("b")).otherwise(F.lit(0.0))
    return ext.select(
        lat_step.alias("lat_step"),
        lon_step.alias("lon_step"),
        (F.col("lon_min") - lon_step / 2).alias("west"),
        (F.col("lon_max") + lon_step / 2).alias("east"),
        (F.col("lat_min") - lat_step / 2).alias("south"),
        (F.col("lat_max") + lat_step / 2).alias("north"),
        ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat_center"),
    )


def missing_pixels(rows: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """Cells of an n_lat x n_lon grid without any row."""
    spark = rows.sparkSession
    expected = spark.range(n_lat * n_lon).select(
        F.floor(F.col("id") / n_lon).alias("lat_idx"), (F.col("id") % n_lon).alias("lon_idx")
    )
    present = rows.select(F.col("lat_idx").cast("bigint"), F.col("lon_idx").cast("bigint"))
    return expected.join(present, ["lat_idx", "lon_idx"], "left_anti").select(
        F.concat_ws("_", "lat_idx", "lon_idx").alias("pixel_id"), "lat_idx", "lon_idx"
    )


def grid_rows(rows: DataFrame, value: str, n_lat: int, n_lon: int, by: str = "step") -> DataFrame:
    """Long rows to one row per (by, lat_idx) with a column per lon_idx.

    Indexes outside the grid are an error, as in an array assignment.
    """
    inside = F.col("lat_idx").between(0, n_lat - 1) & F.col("lon_idx").between(0, n_lon - 1)
    checked = rows.withColumn(
        "_ok", F.when(inside, True).otherwise(F.raise_error(F.lit("pixel index outside the grid")).cast("boolean"))
    ).filter("_ok")
    return (
        checked.groupBy(by, "lat_idx")
        .pivot("lon_idx", list(range(n_lon)))
        .agg(F.first(value))
        .select(by, "lat_idx", *[F.col(str(j)).alias(f"lon_{j}") for j in range(n_lon)])
    )
