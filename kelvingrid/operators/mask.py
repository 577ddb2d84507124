"""Boundary polygons and the cell mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

N_SAMPLES = 7


def boundary_edges(rings: DataFrame) -> DataFrame:
    """(ring_id, x1, y1, x2, y2) from outer rings ``ring`` = array of [lon, lat]; rings close themselves."""
    pts = F.col("ring")
    following = F.concat(F.slice(pts, F.lit(2), F.size(pts) - 1), F.slice(pts, 1, 1))
    return (
        rings.filter(F.size("ring") >= 3)
        .select("ring_id", F.explode(F.arrays_zip(pts.alias("p"), following.alias("q"))).alias("e"))
        .select(
            "ring_id",
            F.col("e.p")[0].alias("x1"),
            F.col("e.p")[1].alias("y1"),
            F.col("e.q")[0].alias("x2"),
            F.col("e.q")[1].alias("y2"),
        )
        .filter("y1 <> y2")
    )


def cell_samples(pixel_dim: DataFrame, lat_step: float, lon_step: float, n: int = N_SAMPLES) -> DataFrame:
    """n x n points spread evenly over each cell, edges included."""
    spread = lambda c, step, i: c - step / 2 + i * step / (n - 1)
    grid = F.sequence(F.lit(0), F.lit(n - 1))
    return (
        pixel_dim.select("pixel_id", "latitude", "longitude", F.explode(grid).alias("i"))
        .select("*", F.explode(grid).alias("j"))
        .select(
            "pixel_id",
            "i",
            "j",
            spread(F.col("longitude"), F.lit(lon_step), F.col("j")).alias("x"),
            spread(F.col("latitude"), F.lit(lat_step), F.col("i")).alias("y"),
        )
    )


def _band(y: Column, height: float) -> Column:
    return F.floor(y / F.lit(height)).cast("bigint")


def crossings(rows: DataFrame, edges: DataFrame, band: float) -> DataFrame:
    """(y, ring_id, x): where edges cross the latitude rows ``y``; a row at a lower end is crossed, at an upper end it is not.

    Rows and edges are cut into latitude bands and meet in an equi-join, one candidate per edge and row of its bands.
    """
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    banded = edges.withColumn("band", F.explode(F.sequence(_band(lo, band), _band(hi, band))))
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    x_at = F.col("x1") + (F.col("y") - F.col("y1")) * slope
    met = rows.withColumn("band", _band(F.col("y"), band)).join(banded, "band")
    return met.filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))).select("y", "ring_id", x_at.alias("x"))


def cells_inside(samples: DataFrame, edges: DataFrame, band: float, stretch: float | None = None) -> DataFrame:
    """pixel_ids with at least one sample inside at least one ring.

    Scanlines: every latitude row of samples has its crossing events, never its pairs of sample and edge.  Of a ring's
    events in a row, from the right, each odd one ends a stretch inside the ring and each even one begins it; so rings add
    up to a running count of open rings along the row, which a sample only reads.  The count is a two-level scan: inside
    stretches of longitude of ``stretch`` degrees, plus what the stretches before leave open.
    """
    stretch = 256 * band if stretch is None else stretch
    events = crossings(samples.select("y").distinct(), edges, band)
    from_right = F.row_number().over(Window.partitionBy("y", "ring_id").orderBy(F.desc("x")))
    ends = events.select("y", "x", F.when(from_right % 2 == 1, -1).otherwise(1).alias("opened"), F.lit(0).alias("kind"))
    read = samples.select("y", "x", F.lit(0).alias("opened"), F.lit(1).alias("kind"), "pixel_id")
    marks = ends.unionByName(read, allowMissingColumns=True).withColumn("part", F.floor(F.col("x") / F.lit(stretch)))
    # a stretch is [begin, end): events at a sample's own longitude come before it
    inside = Window.partitionBy("y", "part").orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = marks.withColumn("_open", F.sum("opened").over(inside)).filter("kind = 1")
    before = Window.partitionBy("y").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = marks.groupBy("y", "part").agg(F.sum("opened").alias("_sum"))
    carried = per_part.select("y", "part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return local.join(carried, ["y", "part"]).filter(F.col("_open") + F.col("_before") > 0).select("pixel_id").distinct()


def boundary_mask(
    pixel_dim: DataFrame, rings: DataFrame, lat_step: float, lon_step: float, n: int = N_SAMPLES
) -> DataFrame:
    """(pixel_id, inside); without any ring every cell is inside."""
    if rings.isEmpty():
        return pixel_dim.select("pixel_id", F.lit(True).alias("inside"))
    samples = cell_samples(pixel_dim, lat_step, lon_step, n)
    hit = cells_inside(samples, boundary_edges(rings), max(lat_step, 1e-9))
    marked = hit.withColumn("_hit", F.lit(True))
    return pixel_dim.select("pixel_id").join(marked, "pixel_id", "left").select(
        "pixel_id", F.coalesce("_hit", F.lit(False)).alias("inside")
    )


def masked(rows: DataFrame, mask: DataFrame, value: str = "v") -> DataFrame:
    """Value set to null outside the boundary."""
    out = rows.join(mask, "pixel_id", "left")
    return out.withColumn(value, F.when(F.col("inside"), F.col(value))).drop("inside")


def kept_pixels(mask: DataFrame) -> DataFrame:
    return mask.filter("inside").select("pixel_id")
