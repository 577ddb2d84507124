"""File catalog, ingest ledger, outcome tally, scene quality, run catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Name formats of the scene files and run folders.
SCENE_TIME = r"NC_H\d+_(\d{8})_(\d{4})_"
SCENE_TOKEN = "R21_FLDK.02801_02401"
SCENE_SUFFIX = ".nc"
SCENE_GLOB = "subset_*.nc"
MIN_BYTES = 10_000
RUN_FOLDER = r"^([A-Za-z0-9]+)_w(\d+)_t0(\d{8}_\d{4})_run(\d{8}_\d{4})$"
STATUSES = ["with_data", "without_data", "skipped", "failed"]


def scene_time(name: Column) -> Column:
    """Observation time from a file name; null when the name does not parse."""
    day = F.regexp_extract(name, SCENE_TIME, 1)
    minute = F.regexp_extract(name, SCENE_TIME, 2)
    return F.try_to_timestamp(F.concat_ws(" ", day, minute), F.lit("yyyyMMdd HHmm")).cast("timestamp_ntz")


def file_catalog(spark: SparkSession, base: str, glob: str = SCENE_GLOB) -> DataFrame:
    """Recursive listing as (path, file_name, length, obs_time), unparseable names left out (see ``unparsed``)."""
    return catalog_of(file_listing(spark, base, glob))


def file_listing(spark: SparkSession, base: str, glob: str = SCENE_GLOB) -> DataFrame:
    """(path, length) of all files below a folder; the content column is pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return files.load(base).select("path", "length")


def catalog_of(listing: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    return (
        listing.select("path", name.alias("file_name"), "length", scene_time(name).alias("obs_time"))
        .filter("obs_time is not null")
        .orderBy("obs_time", "path")
    )


def unparsed(listing: DataFrame) -> DataFrame:
    """Rows of a listing whose name holds no time."""
    name = F.substring_index("path", "/", -1)
    return listing.filter(scene_time(name).isNull())


def wanted_names(listing: DataFrame, token: str = SCENE_TOKEN, suffix: str = SCENE_SUFFIX) -> DataFrame:
    return listing.filter(F.col("file_name").contains(token) & F.col("file_name").endswith(suffix))


def large_enough(listing: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    return listing.filter(F.col("length") >= min_bytes)


def unchecked(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose (dir, file_name) is not in the ledger yet, each once."""
    return listing.dropDuplicates(["dir", "file_name"]).join(
        ledger.select("dir", "file_name"), ["dir", "file_name"], "left_anti"
    )


def append_ledger(checked: DataFrame, path: str) -> None:
    checked.select("dir", "file_name").write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Set of checked names; doubles from repeated runs collapse."""
    return spark.read.schema("dir string, file_name string").parquet(path).dropDuplicates(["dir", "file_name"])


def outcome_tally(outcomes: DataFrame) -> DataFrame:
    """Counts per status for every directory and in total (dir null); ``other`` holds what is no known status."""
    other = F.count_if(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))
    return outcomes.rollup("dir").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], other.alias("other"))


def failed_files(outcomes: DataFrame) -> DataFrame:
    """Names that failed, one row each (a list per directory could grow without bound)."""
    return outcomes.filter("status = 'failed'").select("dir", "file_name")


def scene_quality(scenes: DataFrame, channel: str, n_lat: int, n_lon: int) -> DataFrame:
    """Status per scene: ok, missing_channel, shape_mismatch or error.

    ``scenes`` has one row per (scene, cell) with lat_idx/lon_idx and the channel
    column; a scene flagged ``unreadable`` in the source is an error.
    """
    g = scenes.groupBy("scene").agg(
        F.count(channel).alias("n_values"),
        F.count(F.lit(1)).alias("n_cells"),
        F.max("lat_idx").alias("max_lat"),
        F.max("lon_idx").alias("max_lon"),
        F.max(F.col("unreadable").cast("int")).alias("bad"),
    )
    wrong = (F.col("n_cells") != n_lat * n_lon) | (F.col("max_lat") != n_lat - 1) | (F.col("max_lon") != n_lon - 1)
    status = (
        F.when(F.col("bad") == 1, "error")
        .when(F.col("n_values") == 0, "missing_channel")
        .when(wrong, "shape_mismatch")
        .otherwise("ok")
    )
    return g.select("scene", status.alias("status"))


def channel_grid(scenes: DataFrame, channel: str, quality: DataFrame, fill_value: float | None = None) -> DataFrame:
    """Channel values of good scenes; every other scene becomes a gap."""
    v = F.col(channel).cast("double")
    if fill_value is not None:
        v = F.when(v != fill_value, v)
    return (
        scenes.select("scene", "pixel_id", "slot", v.alias("_v"))
        .join(quality, "scene")
        .select("pixel_id", "slot", F.when((F.col("status") == "ok") & ~F.isnan("_v"), F.col("_v")).alias("v"))
    )


def run_catalog(folders: DataFrame, name: str = "folder") -> DataFrame:
    """Runs parsed from their folder names, others ignored, newest first."""
    part = lambda i: F.regexp_extract(name, RUN_FOLDER, i)
    when = lambda c: F.try_to_timestamp(c, F.lit("yyyyMMdd_HHmm")).cast("timestamp_ntz")
    return (
        folders.filter(F.col(name).rlike(RUN_FOLDER))
        .select(
            F.col(name).alias("folder"),
            part(1).alias("model_name"),
            part(2).cast("int").alias("window"),
            part(3).alias("t0_str"),
            part(4).alias("run_str"),
            when(part(3)).alias("t0_ts"),
            when(part(4)).alias("run_ts"),
        )
        .orderBy(F.desc("run_ts"), "folder")
    )
