"""Forecast-side joins and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kelvingrid.functions.timeaxis import TimeAxis

# Fixed output contract: the columns of a forecast table, in order.
FORECAST_COLUMNS = [
    "pixel_id",
    "lat_idx",
    "lon_idx",
    "latitude",
    "longitude",
    "window_end_time",
    "step",
    "target_time",
    "y_pred",
    "y_true",
    "abs_error",
    "model_name",
    "window",
]


def on_dates(obs: DataFrame, axis: TimeAxis | None, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Only the ``date`` folders of a stored grid that hold slots first..last; a table without that column is left as it is."""
    if axis is None or "date" not in obs.columns:
        return obs
    if first is not None:
        obs = obs.filter(F.col("date") >= F.to_date(axis.time(first)))
    if last is not None:
        obs = obs.filter(F.col("date") <= F.to_date(axis.time(last)))
    return obs


def observations_in_span(obs: DataFrame, forecast: DataFrame, slot: str = "target_slot", axis: TimeAxis | None = None) -> DataFrame:
    """Non-null observations between the first and last forecast slot (inclusive); with ``axis`` a stored grid is pruned by date."""
    # one subquery for both ends, so the forecast plan is not run once per bound
    span = forecast.agg(F.struct(F.min(slot).alias("lo"), F.max(slot).alias("hi")).alias("b")).scalar()
    near = on_dates(obs, axis, span["lo"], span["hi"])
    return near.filter(F.col("v").isNotNull() & (F.col("slot") >= span["lo"]) & (F.col("slot") <= span["hi"]))


def with_actuals(forecast: DataFrame, obs: DataFrame, axis: TimeAxis | None = None) -> DataFrame:
    """Left equi-join on (pixel, target slot); rows without observation stay null."""
    truth = observations_in_span(obs, forecast, axis=axis).select(
        "pixel_id", F.col("slot").alias("target_slot"), F.col("v").alias("y_true")
    )
    return forecast.join(truth, ["pixel_id", "target_slot"], "left").withColumn(
        "abs_error", F.abs(F.col("y_pred") - F.col("y_true"))
    )


def match_counts(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count(F.lit(1)).alias("n_rows"), F.count("y_true").alias("n_matched"))


def input_snapshot(windows: DataFrame, obs: DataFrame) -> DataFrame:
    """Observed value at each pixel's own window end."""
    t0 = windows.select("pixel_id", "slot").distinct()
    return t0.join(obs.select("pixel_id", "slot", "v"), ["pixel_id", "slot"])


def value_ranges(forecast: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Shared value range of input, prediction and truth, and error range, per step."""
    ends = snapshot.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("b")).scalar()
    lo, hi = ends["lo"], ends["hi"]
    g = forecast.groupBy("step").agg(
        F.least(F.min("y_pred"), F.min("y_true")).alias("_lo"),
        F.greatest(F.max("y_pred"), F.max("y_true")).alias("_hi"),
        F.max("abs_error").alias("err_max"),
    )
    return g.select(
        "step",
        F.coalesce(F.least("_lo", lo), F.lit(0.0)).alias("vmin"),
        F.coalesce(F.greatest("_hi", hi), F.lit(1.0)).alias("vmax"),
        F.when(F.col("err_max").isNotNull(), F.lit(0.0)).alias("err_min"),
        "err_max",
    )


def best_window_per_model(results: DataFrame) -> DataFrame:
    """Whole row with the lowest mean MAE per model; the smaller window wins a tie."""
    rows = results.filter(F.col("mae_avg_all_steps").isNotNull())
    best = F.min_by(F.struct(*results.columns), F.struct("mae_avg_all_steps", "window"))
    return rows.groupBy("model").agg(best.alias("_best")).select("_best.*")


def resolve_windows(models: DataFrame, best: DataFrame, override: dict[str, int], fallback: int) -> DataFrame:
    """Window per model: explicit override, else best found, else fallback."""
    pairs = [F.lit(x) for kv in override.items() for x in kv]
    chosen = F.create_map(*pairs)[F.col("model")] if pairs else F.lit(None).cast("int")
    found = best.select("model", F.col("window").alias("best_window"))
    return models.join(found, "model", "left").select(
        "model", F.coalesce(chosen, F.col("best_window"), F.lit(fallback)).cast("int").alias("window")
    )


def assert_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Error when a key occurs twice."""
    dup = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if dup:
        raise ValueError(f"duplicate keys in {what}: {[tuple(r[k] for k in keys) for r in dup]}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def pick_models(df: DataFrame, models: list[str], column: str = "model") -> DataFrame:
    """Rows of the listed models; a name that does not occur is an error."""
    kept = df.filter(F.col(column).isin(models))
    present = {r[0] for r in kept.select(column).distinct().collect()}
    missing = sorted(set(models) - present)
    if missing:
        raise ValueError(f"unknown models: {missing}")
    return kept


def steps_between(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Forecast rows of the steps first..last."""
    return rows.filter(F.col("step").between(first, last))
