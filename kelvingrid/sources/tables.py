"""Grid tables, delimited files, metadata, manifest and model storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from kelvingrid.functions.timeaxis import TimeAxis

GRID_SCHEMA = T.StructType(
    [
        T.StructField("pixel_id", T.StringType()),
        T.StructField("slot", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("v", T.FloatType()),
        T.StructField("date", T.DateType()),
    ]
)
DETAIL_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("pixel_id", T.StringType()),
        T.StructField("anchor_t0", T.TimestampNTZType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("target_time", T.TimestampNTZType()),
        T.StructField("y_true", T.DoubleType()),
        T.StructField("y_pred", T.DoubleType()),
        T.StructField("abs_error", T.DoubleType()),
    ]
)
FEATURE_SET = "lag_time_v1"


def write_grid(grid: DataFrame, axis: TimeAxis, path: str, files_per_date: int = 16) -> None:
    """Parquet by date, float32 at rest; a day's files are clustered by pixel."""
    ts = axis.time(F.col("slot"))
    rows = grid.select(
        "pixel_id", "slot", ts.alias("ts"), F.col("v").cast("float").alias("v"), F.to_date(ts).alias("date")
    )
    # date alone would send a whole day to one task; the pixel hash spreads it
    spread = rows.repartition("date", F.pmod(F.xxhash64("pixel_id"), F.lit(files_per_date)))
    spread.sortWithinPartitions("date", "pixel_id", "slot").write.option("compression", "zstd").partitionBy(
        "date"
    ).mode("overwrite").parquet(path)


def read_grid(spark: SparkSession, path: str, schema: T.StructType = GRID_SCHEMA) -> DataFrame:
    """Declared schema, values widened to double; a missing column is an error."""
    found = spark.read.parquet(path)
    missing = [c for c in schema.names if c not in found.columns]
    if missing:
        raise ValueError(f"missing columns in {path}: {missing}")
    return spark.read.schema(schema).parquet(path).withColumn("v", F.col("v").cast("double"))


def read_range(grid: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows with lo <= ts <= hi; both predicates reach the scan, the date one prunes folders."""
    a, b = F.to_timestamp_ntz(F.lit(lo)), F.to_timestamp_ntz(F.lit(hi))
    return grid.filter(F.col("date").between(F.to_date(a), F.to_date(b)) & F.col("ts").between(a, b))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header, declared schema, column check and emptiness check."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in schema.names if c not in header]
    if missing:
        raise ValueError(f"missing columns in {path}: {missing}")
    order = [schema[c] if c in schema.names else T.StructField(c, T.StringType()) for c in header]
    df = (
        spark.read.option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .schema(T.StructType(order))
        .csv(path)
        .select(*schema.names)
    )
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def write_document(row: DataFrame, path: str) -> None:
    """One-row table as a JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def manifest_rows(spark: SparkSession, entries: list[dict]) -> DataFrame:
    schema = (
        "model string, window int, model_path string, feature_columns array<string>, feature_set string, "
        "target_column string, n_train_samples bigint, train_seconds double, train_start string, train_end string, "
        "damping_rate double, damping_cap double"
    )
    return spark.createDataFrame([tuple(e.get(c.split(" ")[0]) for c in schema.split(", ")) for e in entries], schema)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    """Manifest entries by model; one small row per model."""
    schema = manifest_rows(spark, []).schema
    return {r["model"]: r.asDict() for r in spark.read.schema(schema).json(path).collect()}


def check_feature_set(entry: dict, model: str, expected: str = FEATURE_SET) -> None:
    """Refuse a stored model that was fitted on other features."""
    if entry.get("feature_set") != expected:
        raise ValueError(f"model {model} was fitted on {entry.get('feature_set')!r}, expected {expected!r}")


def write_forecast(
    forecast: DataFrame, path: str, model_name: str, window: int, t0: str, run: str
) -> None:
    """Write one run into its own folder model_name/window/t0/run; a run that is there already is an error, so a retry can't double it."""
    folder = f"{path.rstrip('/')}/model_name={model_name}/window={window}/t0={t0}/run={run}"
    forecast.drop("model_name", "window").write.mode("errorifexists").parquet(folder)
