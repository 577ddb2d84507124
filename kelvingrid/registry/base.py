"""Registration and the shared input fixtures (Spark side and SQL side)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Added before rounding on both sides, so that exact ties round the same way in both engines.
NUDGE = 3.1e-10

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.DecimalType)


def settle(c, digits: int = 6, nudge: float = NUDGE):
    return F.round(c + F.lit(nudge), digits) + F.lit(0.0)


def tidy(df: DataFrame, digits: int = 6, nudge: float = NUDGE) -> DataFrame:
    """Engine-neutral output: bigint counts, rounded doubles, times as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, INTEGERS):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = settle(c.cast("double"), digits, nudge)
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = 6, nudge: float = NUDGE):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(use_utc(spark), sf_dir), digits, nudge)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def ctes(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + final.strip()


def R(expr: str, digits: int = 6, nudge: float = NUDGE) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + CAST({nudge} AS DOUBLE), {digits}) + 0.0)"


def T_(expr: str) -> str:
    """Timestamp as text."""
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Fixture:
    """A regular grid derived from one of the tables."""

    axis: TimeAxis
    build: Callable[[SparkSession, str], DataFrame]
    sql: str

    def obs(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir)

    def time_sql(self, slot: str) -> str:
        return f"(TIMESTAMP '{self.axis.origin}' + to_seconds(CAST(({slot}) * {self.axis.step_seconds} AS BIGINT)))"


def _cell(p, width: int):
    return F.concat_ws("_", F.floor(p / width), p % width)


def g35(k: int = 7, kelvin: bool = False) -> Fixture:
    """35 cells from lineitem, k-day slots, mean quantity (or a Kelvin-like value)."""
    axis = TimeAxis("1995-01-02 00:00:00", k * 86400)

    def build(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select(
            _cell(F.col("l_partkey") % 35, 7).alias("pixel_id"), axis.slot(F.col("l_shipdate")).alias("slot"), "l_quantity"
        )
        obs = rows.groupBy("pixel_id", "slot").agg(F.avg("l_quantity").alias("v"))
        if kelvin:
            obs = obs.withColumn("v", settle(F.lit(320.0) - F.col("v") * 3))
        return obs

    v = R("320.0 - avg(l_quantity) * 3") if kelvin else "avg(l_quantity)"
    sql = f"""obs AS (
      SELECT concat(CAST((l_partkey % 35) // 7 AS VARCHAR), '_', CAST((l_partkey % 35) % 7 AS VARCHAR)) AS pixel_id,
             CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) // {k} AS BIGINT) AS slot, {v} AS v
      FROM lineitem GROUP BY 1, 2)"""
    return Fixture(axis, build, sql)


def suppliers(k: int = 28) -> Fixture:
    """One cell per supplier (the cell count grows with the data), k-day slots, mean price."""
    axis = TimeAxis("1995-01-02 00:00:00", k * 86400)

    def build(spark, sf_dir):
        rows = table(spark, sf_dir, "lineitem").select(
            F.concat_ws("_", F.floor(F.col("l_suppkey") / 40), F.col("l_suppkey") % 40).alias("pixel_id"),
            axis.slot(F.col("l_shipdate")).alias("slot"),
            "l_extendedprice",
        )
        return rows.groupBy("pixel_id", "slot").agg(settle(F.avg("l_extendedprice")).alias("v"))

    sql = f"""obs AS (
      SELECT concat(CAST(l_suppkey // 40 AS VARCHAR), '_', CAST(l_suppkey % 40 AS VARCHAR)) AS pixel_id,
             CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) // {k} AS BIGINT) AS slot,
             {R("avg(l_extendedprice)")} AS v
      FROM lineitem GROUP BY 1, 2)"""
    return Fixture(axis, build, sql)


def ev5(minutes: int = 60) -> Fixture:
    """Five cells (event types), slots of some minutes, mean value."""
    axis = TimeAxis("2024-01-01 00:00:00", minutes * 60)

    def build(spark, sf_dir):
        rows = table(spark, sf_dir, "events").select(
            F.col("event_type").alias("pixel_id"), axis.slot(F.col("ts")).alias("slot"), "value"
        )
        return rows.groupBy("pixel_id", "slot").agg(settle(F.avg("value")).alias("v"))

    sql = f"""obs AS (
      SELECT event_type AS pixel_id,
             CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) // {minutes * 60_000_000} AS slot,
             {R("avg(value)")} AS v
      FROM events GROUP BY 1, 2)"""
    return Fixture(axis, build, sql)


def dim_of(obs: DataFrame) -> DataFrame:
    """Pixel dimension from cell names: row-major indexes, 0.05 degree cells."""
    lat = F.substring_index("pixel_id", "_", 1).cast("int")
    lon = F.substring_index("pixel_id", "_", -1).cast("int")
    return obs.select("pixel_id").distinct().select(
        "pixel_id",
        lat.alias("lat_idx"),
        lon.alias("lon_idx"),
        (F.lit(-6.8) - lat * 0.05).alias("latitude"),
        (F.lit(107.5) + lon * 0.05).alias("longitude"),
    )


DIM_SQL = """dim AS (
  SELECT pixel_id, CAST(split_part(pixel_id, '_', 1) AS BIGINT) AS lat_idx,
         CAST(split_part(pixel_id, '_', 2) AS BIGINT) AS lon_idx,
         CAST(-6.8 AS DOUBLE) - CAST(split_part(pixel_id, '_', 1) AS BIGINT) * CAST(0.05 AS DOUBLE) AS latitude,
         CAST(107.5 AS DOUBLE) + CAST(split_part(pixel_id, '_', 2) AS BIGINT) * CAST(0.05 AS DOUBLE) AS longitude
  FROM (SELECT DISTINCT pixel_id FROM obs))"""

BOUNDS_SQL = "b AS (SELECT min(slot) AS lo, max(slot) AS hi FROM obs)"
GRID_SQL = """grid AS (
  SELECT d.pixel_id, s.slot, o.v
  FROM (SELECT DISTINCT pixel_id FROM obs) d
  CROSS JOIN (SELECT unnest(generate_series(lo, hi)) AS slot FROM b) s
  LEFT JOIN obs o ON o.pixel_id = d.pixel_id AND o.slot = s.slot)"""
