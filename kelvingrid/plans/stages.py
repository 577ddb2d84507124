"""The stages a user runs, each a function from tables to tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from kelvingrid.functions.scalars import CLEAR_LIMIT, COLD_LIMIT, cyclic_time, risk_code
from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.operators import climate, correlation, evaluate, forecast as fc, grid, leastsquares, mask, profile, rollout, samples, split
from kelvingrid.operators import significance, unitroot
from kelvingrid.operators.blocks import BLOCK
from kelvingrid.plans import models
from kelvingrid.session import scratch_path, written
from kelvingrid.sources import tables

HORIZON = 18
WINDOWS = tuple(range(1, 25))
VALIDATION_STRIDE = 6
PRIORITY_STEPS = (1, 18)
#: Window of a model that a search has no row for.
FALLBACK_WINDOW = 6


def build_grid(obs: DataFrame, axis: TimeAxis, pixel_dim: DataFrame, max_times: int | None = None) -> DataFrame:
    """Raw observations (pixel_id, ts, v, path) to the gap-filled grid."""
    rows = grid.latest_wins(grid.slotted(obs, axis), "path")
    if max_times is not None:
        rows = samples.first_times(rows, max_times)
    return grid.dense_grid(rows, pixel_dim)


#: Models whose fits come from cross products and whose rollouts are one fold: all windows or folds in one plan.
ONE_PASS = ("persistence", "window_mean", "ar1", "linear")


def one_pass_steps() -> dict[str, rollout.LinearStep]:
    """The steps of ``ONE_PASS``, reading the columns of ``leastsquares.fits``."""
    linear = rollout.LinearStep(F.col("lin_intercept"), time_coefs=(F.col("lin_sin"), F.col("lin_cos")), lag_array=F.col("lin_coefs"))
    return {**closed_form_steps(), "linear": linear}


def _mean_value(obs: DataFrame) -> Column:
    """The mean as a literal: a subquery over a table the caller has cached can't be evaluated inside a lambda on executors."""
    return F.lit(float(samples.valid_rows(obs).agg(F.avg("v")).first()[0] or 0.0))


def window_fits(fit_obs: DataFrame, axis: TimeAxis, windows: Sequence[int], block: int = BLOCK) -> DataFrame:
    """(window, fits): the linear and AR(1) fit of every window size from one pass.

    Cross products of the widest lag vector are summed per length of the complete run; a window's samples are the
    runs that are long enough, its normal equations a sub-block of their sum.
    """
    shift = _mean_value(fit_obs)
    wide = samples.wide_samples(fit_obs, max(windows), block)
    sin, cos = cyclic_time(axis.time(F.col("target_slot")))
    z = leastsquares.design(F.col("lags"), F.col("run"), sin, cos, F.col(samples.TARGET), shift)
    groups = leastsquares.cross_products(wide, z, ["run"])
    held = F.filter(F.array(*[F.lit(n) for n in windows]), lambda n: n <= F.col("run"))
    per_window = leastsquares.total(groups.select(F.explode(held).alias("window"), "m"), ["window"])
    return leastsquares.fits(per_window, F.col("window"), shift)


def _search_columns(horizon: int) -> str:
    return (
        "model string, window int, n_fit_samples bigint, n_val_anchors bigint, train_seconds double, "
        "mae_avg_all_steps double, r2_avg_all_steps double, damping_rate double, damping_cap double, "
        + ", ".join(f"mae_step_{k} double" for k in range(1, horizon + 1))
        + ", "
        + ", ".join(f"r2_step_{k} double" for k in range(1, horizon + 1))
    )


_SEARCH_KEYS = ("model", "window", "n_fit", "train_seconds")


def _search_rows(summary: DataFrame, horizon: int, damping_rate: float, damping_cap: float) -> DataFrame:
    """Errors per (model, window, n_fit, train_seconds, step) to one row per (model, window)."""
    keys = list(_SEARCH_KEYS)
    at = lambda c, k: F.max(F.when(F.col("step") == k, F.col(c))).alias(f"{c}_step_{k}")
    rows = summary.groupBy(*keys).agg(
        F.max("n_samples").alias("n_val_anchors"),
        F.avg("mae").alias("mae_avg_all_steps"),
        F.avg("r2").alias("r2_avg_all_steps"),
        *[at("mae", k) for k in range(1, horizon + 1)],
        *[at("r2", k) for k in range(1, horizon + 1)],
    )
    rows = rows.withColumnRenamed("n_fit", "n_fit_samples").withColumns({"damping_rate": F.lit(damping_rate), "damping_cap": F.lit(damping_cap)})
    target = T._parse_datatype_string(_search_columns(horizon))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target])


def search_windows(
    fit_obs: DataFrame,
    val_obs: DataFrame,
    axis: TimeAxis,
    names: Sequence[str],
    windows: Sequence[int] = WINDOWS,
    horizon: int = HORIZON,
    stride: int = VALIDATION_STRIDE,
    damping_rate: float = 0.0,
    damping_cap: float = 0.6,
    block: int = BLOCK,
    **over,
) -> DataFrame:
    """One row per (model, window) with fit size, anchors and metrics over the rollout.

    Window sizes without samples or anchors are skipped.  The models of ``ONE_PASS`` are one lazy plan for all sizes:
    one pass for the fits, one for the frames.  Tree models are fitted one by one on samples that are written to the
    shared folder once; linear fits with parameters of their own (``over``) are among these.
    """
    quick = [n for n in names if n in ONE_PASS and not (over and n == "linear")]
    slow = [n for n in names if n not in quick]
    found = None
    if quick:
        fits = window_fits(fit_obs, axis, windows, block)
        frames = samples.multi_window_frames(val_obs, windows, horizon, stride, block)
        ready = frames.join(F.broadcast(fits), "window")  # one row per window size
        moments = rollout.window_errors(ready, quick, horizon, axis, damping_rate, damping_cap)
        found = _search_rows(evaluate.pooled_errors(moments, (*_SEARCH_KEYS, "step")), horizon, damping_rate, damping_cap)
    if slow:
        rows = _search_fitted(fit_obs, val_obs, axis, slow, windows, horizon, stride, damping_rate, damping_cap, block, **over)
        found = rows if found is None else found.unionByName(rows)
    return found


def _search_fitted(fit_obs, val_obs, axis, names, windows, horizon, stride, damping_rate, damping_cap, block, **over) -> DataFrame:
    """``search_windows`` for models with a training loop of their own: one fit per model and size, rollouts in one table."""
    spark = fit_obs.sparkSession
    wide = written(samples.wide_samples(fit_obs, max(windows), block), "samples")
    all_frames = written(samples.multi_window_frames(val_obs, windows, horizon, stride, block), "frames")
    runs = {r["run"]: r["count"] for r in wide.groupBy("run").count().collect()}
    anchored = {r["window"] for r in all_frames.select("window").distinct().collect()}
    path = scratch_path(spark, "search")
    keys = ("window", "n_fit", "train_seconds")
    parts = 0
    for window in windows:
        n_fit = sum(c for run, c in runs.items() if run >= window)
        if not n_fit or window not in anchored:
            continue
        dataset = samples.dataset_for_window(wide, window, axis)
        frames = all_frames.filter(F.col("window") == window)
        for name in names:
            model, seconds = models.fit_any(name, dataset, window, **over)
            preds = models.roll(name, model, frames, window, horizon, axis, damping_rate, damping_cap)
            preds = preds.withColumns({"n_fit": F.lit(n_fit).cast("bigint"), "train_seconds": F.lit(float(seconds))})
            rollout.detail_rows(preds, name, axis, extra=keys).write.mode("append").parquet(path)
            parts += 1
    if not parts:
        return spark.createDataFrame([], _search_columns(horizon))
    summary = evaluate.summarize_by_step(spark.read.parquet(path), (*_SEARCH_KEYS, "step"))
    return _search_rows(summary, horizon, damping_rate, damping_cap)


def search_closed_form(
    fit_obs: DataFrame,
    val_obs: DataFrame,
    axis: TimeAxis,
    names: Sequence[str],
    windows: Sequence[int],
    horizon: int,
    stride: int = 1,
    damping_rate: float = 0.0,
    damping_cap: float = 0.6,
    block: int = BLOCK,
) -> DataFrame:
    """Window search for the closed-form models as one lazy plan, no driver round trips.

    One window pass serves all sizes on each side; the AR(1) fits of all sizes
    are one aggregation.
    """
    wide = samples.wide_samples(fit_obs, max(windows), block)
    fits = wide.select(
        F.explode(F.filter(F.array(*[F.lit(n) for n in windows]), lambda n: n <= F.col("run"))).alias("window"),
        F.element_at("lags", 1).alias("lag_1"),
        samples.TARGET,
    )
    coefs = fits.groupBy("window").agg(
        F.count(F.lit(1)).alias("n_fit_samples"),
        F.regr_intercept(samples.TARGET, "lag_1").alias("ar1_intercept"),
        F.regr_slope(samples.TARGET, "lag_1").alias("ar1_slope"),
    )
    frames = samples.multi_window_frames(val_obs, windows, horizon, stride, block)
    # one row per window size
    ready = frames.join(F.broadcast(coefs), "window")
    steps = {n: m for n, m in closed_form_steps().items() if n in names}
    rolled = rollout.rollout_many(ready, steps, horizon, axis, damping_rate, damping_cap)
    detail = rollout.detail_rows(rolled, F.col("model"), axis, extra=("window",))
    summary = evaluate.summarize_by_step(detail, ("model", "window", "step"))
    return summary.groupBy("model", "window").agg(
        F.max("n_samples").alias("n_val_anchors"),
        F.avg("mae").alias("mae_avg_all_steps"),
        F.avg("r2").alias("r2_avg_all_steps"),
    )


def closed_form_steps() -> dict[str, rollout.LinearStep]:
    """The baselines; AR(1) reads its coefficients from the columns ar1_intercept / ar1_slope."""
    return {
        "persistence": rollout.persistence(),
        "window_mean": rollout.window_mean(),
        "ar1": rollout.LinearStep(F.col("ar1_intercept"), [F.col("ar1_slope")]),
    }


def fit_final(
    train_obs: DataFrame,
    axis: TimeAxis,
    windows: dict[str, int],
    folder: str,
    damping_rate: float = 0.0,
    damping_cap: float = 0.6,
    block: int = BLOCK,
    params: dict[str, dict] | None = None,
) -> DataFrame:
    """Fit each model on the whole training side, store models and manifest; returns the manifest."""
    spark = train_obs.sparkSession
    lo, hi = train_obs.agg(F.min("slot"), F.max("slot")).first()
    span = spark.range(1).select(
        axis.time(F.lit(lo)).cast("string").alias("a"), axis.time(F.lit(hi)).cast("string").alias("b")
    ).first()
    entries = []
    for name, window in windows.items():
        dataset = written(samples.window_dataset(train_obs, window, axis, block=block), "samples")
        n = dataset.count()
        if n:
            model, seconds = models.fit_one(name, dataset, window, **(params or {}).get(name, {}))
            path = models.model_path(name, folder)
            models.save_model(model, path)
            entries.append(
                {
                    "model": name,
                    "window": window,
                    "model_path": path,
                    "feature_columns": samples.feature_columns(window),
                    "feature_set": tables.FEATURE_SET,
                    "target_column": samples.TARGET,
                    "n_train_samples": n,
                    "train_seconds": seconds,
                    "train_start": span["a"],
                    "train_end": span["b"],
                    "damping_rate": damping_rate,
                    "damping_cap": damping_cap,
                }
            )
    if not entries:
        raise ValueError("no model could be fitted")
    manifest = tables.manifest_rows(spark, entries)
    tables.write_manifest(manifest, f"{folder.rstrip('/')}/manifest")
    return manifest


def fit_from_search(
    train_obs: DataFrame,
    axis: TimeAxis,
    names: Sequence[str],
    best: DataFrame,
    folder: str,
    override: dict[str, int] | None = None,
    fallback: int = FALLBACK_WINDOW,
    **fit,
) -> DataFrame:
    """``fit_final`` with each model's window: an explicit override, else the one in ``best``, else ``fallback``.

    ``best`` (model, window) is what ``forecast.best_window_per_model`` makes of a search, or such a table read from
    a file; a model with two rows in it is an error, since its window would depend on the order of rows.
    """
    best = fc.assert_unique(best.select("model", "window"), ["model"], "the best windows")
    unknown = sorted(set(override or {}) - set(names))
    if unknown:
        raise ValueError(f"windows given for models that are not fitted: {unknown}")
    wanted = train_obs.sparkSession.createDataFrame([(n,) for n in names], "model string")
    chosen = fc.resolve_windows(wanted, best, override or {}, fallback)
    return fit_final(train_obs, axis, {r["model"]: r["window"] for r in chosen.collect()}, folder, **fit)


def frame_tables(
    forecast: DataFrame,
    obs: DataFrame,
    axis: TimeAxis,
    pixel_dim: DataFrame,
    rings: DataFrame | None = None,
    low: float = COLD_LIMIT,
    high: float = CLEAR_LIMIT,
) -> dict[str, DataFrame]:
    """The tables behind the maps of one stored forecast, by name; drawing is left to the reader.

    ``input``: value at each pixel's own window end.  ``cells``: per (step, pixel) prediction, truth, error and their status
    codes; with ``rings`` the three values and codes are null outside the boundary.  ``steps``: per step the
    value range that input, prediction and truth share, the error range, the cells of each predicted status and the mean error.
    ``geometry``: cell step and padded extent.  ``missing``: cells of the bounding index grid the forecast does not have.
    """
    values = ["y_pred", "y_true", "abs_error"]
    known = forecast.select("pixel_id", "window_end_time", "step", "target_time", *values)
    placed = known.join(pixel_dim.select("pixel_id", "lat_idx", "lon_idx"), "pixel_id")
    taken = fc.input_snapshot(known.select("pixel_id", axis.slot(F.col("window_end_time")).alias("slot")), obs)
    if rings is not None:
        cell = grid.grid_geometry(pixel_dim).first()
        inside = mask.boundary_mask(pixel_dim, rings, cell["lat_step"], cell["lon_step"])
        placed = placed.join(inside, "pixel_id").withColumns({c: F.when(F.col("inside"), F.col(c)) for c in values}).drop("inside")
        taken = mask.masked(taken, inside)
    codes = {"code_pred": risk_code(F.col("y_pred"), low, high), "code_true": risk_code(F.col("y_true"), low, high)}
    size = pixel_dim.agg(F.max("lat_idx") + 1, F.max("lon_idx") + 1).first()
    return {
        "input": taken,
        "cells": placed.withColumns(codes),
        "steps": fc.value_ranges(placed, taken).join(climate.status_counts(placed, low, high), "step"),
        "geometry": grid.grid_geometry(pixel_dim),
        "missing": grid.missing_pixels(placed, *size),
    }


def _stored(spark: SparkSession, folder: str, names: Sequence[str] | None):
    manifest = tables.read_manifest(spark, f"{folder.rstrip('/')}/manifest")
    wanted = list(names) if names else sorted(manifest)
    missing = [n for n in wanted if n not in manifest]
    if missing:
        raise ValueError(f"models not in the manifest: {missing}")
    for name in wanted:
        entry = manifest[name]
        tables.check_feature_set(entry, name)
        # the path is rebuilt from where the manifest lies, so a moved folder still works
        yield name, entry, models.load_model(models.model_path(name, folder))


def evaluate_models(
    test_obs: DataFrame,
    axis: TimeAxis,
    folder: str,
    names: Sequence[str] | None = None,
    horizon: int = HORIZON,
    stride: int = 1,
    max_anchors: int | None = None,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(detail, summary) of stored models over the test side.

    The detail table is written once to the shared folder and read by the
    summary, so the rollouts are not repeated and survive executor loss.
    """
    spark = test_obs.sparkSession
    path = scratch_path(spark, "detail")
    for name, entry, model in _stored(spark, folder, names):
        frames = samples.rollout_frames(test_obs, entry["window"], horizon, stride, block=block)
        if max_anchors is not None:
            frames = samples.earliest_anchor_times(frames, max_anchors)
        rate, cap = entry["damping_rate"], entry["damping_cap"]
        preds = models.roll(name, model, frames, entry["window"], horizon, axis, rate, cap)
        rollout.detail_rows(preds, name, axis).write.mode("append").parquet(path)
    detail = spark.read.parquet(path)
    return detail, evaluate.summarize_by_step(detail)


def run_forecast(
    obs: DataFrame,
    axis: TimeAxis,
    pixel_dim: DataFrame,
    folder: str,
    model_name: str | None = None,
    eval_summary: DataFrame | None = None,
    t0_slot: int | None = None,
    tail: int | None = None,
    horizon: int = HORIZON,
    skip_actual: bool = False,
    steps: tuple[int, int] = PRIORITY_STEPS,
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(forecast, skipped): rows in the fixed column order from the newest complete windows, and the pixels without one.

    ``tail`` reads the last so many observation times only; pixels whose newest window is older are among the skipped.
    Without it a grid stored by date is read backwards until every pixel has a window, any other table whole.
    """
    if model_name is None:
        if eval_summary is None:
            raise ValueError("give a model name or an evaluation summary to choose from")
        best = evaluate.rank_models(eval_summary, *steps).first()
        if best is None:
            raise ValueError(f"no evaluation rows for steps {steps}")
        model_name = best["model"]
    (name, entry, model), = _stored(obs.sparkSession, folder, [model_name])
    window = entry["window"]
    if tail is None and samples.stored_dates(obs):
        newest = samples.newest_windows(obs, window, axis, pixel_dim, t0_slot, block)
    else:
        rows = obs if tail is None else samples.recent_rows(obs, tail, t0_slot, axis)
        newest = samples.latest_windows(rows, window, t0_slot, block)
    if newest.isEmpty():
        raise ValueError("no pixel has a complete window in the rows read")
    rolled = models.roll(name, model, newest, window, horizon, axis, entry["damping_rate"], entry["damping_cap"])
    table = forecast_table(rolled, obs, axis, pixel_dim, name, window, skip_actual)
    return table, samples.skipped_pixels(pixel_dim, newest)


def forecast_table(
    rolled: DataFrame, obs: DataFrame, axis: TimeAxis, pixel_dim: DataFrame, name: str, window: int, skip_actual: bool
) -> DataFrame:
    rows = rollout.forecast_rows(rolled, axis)
    if skip_actual:
        nothing = F.lit(None).cast("double")
        rows = rows.withColumns({"y_true": nothing, "abs_error": nothing})
    else:
        rows = fc.with_actuals(rows, obs, axis)
    rows = rows.join(pixel_dim, "pixel_id").withColumns({"model_name": F.lit(name), "window": F.lit(window)})
    return rows.select(*fc.FORECAST_COLUMNS)


def _fold_samples(obs: DataFrame, axis: TimeAxis, window: int, horizon: int, n_folds: int, seam: str, block: int) -> DataFrame:
    """Training samples (lags, time terms, target) with the folds they are left out of.

    ``seam="time"``: a sample once, left out of the folds ``first`` to ``last`` whose purged block it touches.
    ``seam="row"``: a sample once per ``fold`` it belongs to, the rows joined across the purged stretch.
    """
    radius, slot = window + horizon, F.col("slot")
    if seam == "time":
        rows = _with_ends(samples.window_samples(obs, window, block), obs)
        place = lambda x: split.fold_of(x, F.col("_lo"), F.col("_hi"), n_folds)
        one = F.lit(1).cast("bigint")
        rows = rows.withColumns({"first": F.greatest(place(slot - (window - 1) - radius), one), "last": F.greatest(place(F.col("target_slot") + radius), one)})
    elif seam == "row":
        tagged = split.with_fold_roles(obs.select("pixel_id", "slot", "v"), split.fold_rows(obs, n_folds), radius, n_folds)
        train = tagged.filter("role = 'train'").withColumn("clock", slot).withColumn("slot", F.col("seam_slot"))
        rows = samples.window_samples(train.drop("seam_slot", "role"), window, block, keys=("pixel_id", "fold"), clock="clock")
    else:
        raise ValueError("seam must be 'time' or 'row'")
    sin, cos = cyclic_time(axis.time(F.col("target_slot")))
    return rows.withColumns({"hour_sin": sin, "hour_cos": cos})


def _with_ends(rows: DataFrame, obs: DataFrame) -> DataFrame:
    """Rows with the first and last slot of ``obs`` as ``_lo`` and ``_hi``."""
    ends = obs.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).select(F.struct("lo", "hi").alias("e")).scalar()
    return rows.withColumns({"_lo": ends["lo"], "_hi": ends["hi"]})


def _fold_frames(obs: DataFrame, window: int, horizon: int, n_folds: int, block: int) -> DataFrame:
    """Validation frames that lie in one fold as a whole."""
    frames = _with_ends(samples.rollout_frames(obs, window, horizon, block=block), obs)
    place = lambda x: split.fold_of(x, F.col("_lo"), F.col("_hi"), n_folds)
    fold = place(F.col("slot") - (window - 1))
    return frames.withColumn("fold", F.when(fold == place(F.col("slot") + horizon), fold)).filter("fold is not null").drop("_lo", "_hi")


def fold_fits(obs: DataFrame, axis: TimeAxis, window: int, horizon: int, n_folds: int, seam: str = "time", block: int = BLOCK) -> DataFrame:
    """(fold, fits): the linear and AR(1) fit of every fold from one pass.

    Cross products are summed per range of folds a sample is left out of; a fold's normal equations are the total
    less the ranges that hold it, added up from the other ranges so that nothing cancels.
    """
    shift = _mean_value(obs)
    rows = _fold_samples(obs, axis, window, horizon, n_folds, seam, block)
    lags = F.array(*samples.lag_columns(window))
    z = leastsquares.design(lags, F.lit(window), F.col("hour_sin"), F.col("hour_cos"), F.col(samples.TARGET), shift)
    if seam == "row":
        per_fold = leastsquares.cross_products(rows, z, ["fold"])
    else:
        groups = leastsquares.cross_products(rows, z, ["first", "last"])
        every = groups.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds)).cast("array<bigint>")))
        per_fold = leastsquares.total(every.filter(~F.col("fold").between(F.col("first"), F.col("last"))), ["fold"])
    return leastsquares.fits(per_fold, F.lit(window), shift)


_FOLD_KEYS = ("fold", "n_fit", "train_seconds")


def fold_metrics(summary: DataFrame) -> DataFrame:
    """One row per (model, fold) from step summaries with ``n_fit`` and ``train_seconds``."""
    return summary.groupBy("model", "fold", F.col("n_fit").alias("n_train_samples"), "train_seconds").agg(
        F.max("n_samples").alias("n_val_anchors"),
        F.avg("mae").alias("mae_avg_all_steps"),
        F.avg("rmse").alias("rmse_avg_all_steps"),
        F.avg("r2").alias("r2_avg_all_steps"),
    ).select(
        "model", "fold", "n_train_samples", "n_val_anchors", "mae_avg_all_steps", "rmse_avg_all_steps", "r2_avg_all_steps", "train_seconds"
    )


def blocked_kfold_closed_form(
    obs: DataFrame,
    axis: TimeAxis,
    names: Sequence[str],
    window: int,
    horizon: int = HORIZON,
    n_folds: int = 5,
    seam: str = "time",
    block: int = BLOCK,
) -> DataFrame:
    """``blocked_kfold`` of the baselines, without the seconds."""
    return blocked_kfold(obs, axis, [n for n in names if n in models.CLOSED_FORM], window, horizon, n_folds, seam, block).drop("train_seconds")


def blocked_kfold(
    obs: DataFrame,
    axis: TimeAxis,
    names: Sequence[str],
    window: int,
    horizon: int = HORIZON,
    n_folds: int = 5,
    seam: str = "time",
    block: int = BLOCK,
    **over,
) -> DataFrame:
    """Blocked, purged k-fold: one row per (model, fold).

    The models of ``ONE_PASS`` are one lazy plan for all folds; tree models are fitted per fold on samples that are
    written to the shared folder once.  Folds without training samples or validation frames give no row.
    """
    quick = [n for n in names if n in ONE_PASS and not (over and n == "linear")]
    slow = [n for n in names if n not in quick]
    found = None
    if quick:
        fits = fold_fits(obs, axis, window, horizon, n_folds, seam, block)
        ready = _fold_frames(obs, window, horizon, n_folds, block).join(F.broadcast(fits), "fold")  # n_folds rows
        steps = {n: m for n, m in one_pass_steps().items() if n in quick}
        fitted = F.when(F.col("model").isin("ar1", "linear"), F.col("train_seconds")).otherwise(0.0)
        rolled = rollout.rollout_many(ready, steps, horizon, axis).withColumn("train_seconds", fitted)
        detail = rollout.detail_rows(rolled, F.col("model"), axis, extra=_FOLD_KEYS)
        found = fold_metrics(evaluate.summarize_by_step(detail, ("model", *_FOLD_KEYS, "step")))
    if slow:
        rows = _kfold_fitted(obs, axis, slow, window, horizon, n_folds, seam, block, **over)
        found = rows if found is None else found.unionByName(rows)
    return found


def _kfold_fitted(obs, axis, names, window, horizon, n_folds, seam, block, **over) -> DataFrame:
    """``blocked_kfold`` for models with a training loop of their own."""
    spark = obs.sparkSession
    fit = _fold_samples(obs, axis, window, horizon, n_folds, seam, block)
    if seam == "time":
        every = fit.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n_folds)).cast("array<bigint>")))
        fit = every.filter(~F.col("fold").between(F.col("first"), F.col("last"))).drop("first", "last", "_lo", "_hi")
    fit, frames = written(fit, "samples"), written(_fold_frames(obs, window, horizon, n_folds, block), "frames")
    sizes = {r["fold"]: r["count"] for r in fit.groupBy("fold").count().collect()}
    anchored = {r["fold"] for r in frames.select("fold").distinct().collect()}
    path, parts = scratch_path(spark, "kfold"), 0
    for fold in sorted(anchored & set(sizes)):
        mine, val = fit.filter(F.col("fold") == fold), frames.filter(F.col("fold") == fold)
        for name in names:
            model, seconds = models.fit_any(name, mine, window, **over)
            preds = models.roll(name, model, val, window, horizon, axis)
            preds = preds.withColumns({"n_fit": F.lit(sizes[fold]).cast("bigint"), "train_seconds": F.lit(float(seconds))})
            rollout.detail_rows(preds, name, axis, extra=_FOLD_KEYS).write.mode("append").parquet(path)
            parts += 1
    if not parts:
        return spark.createDataFrame(
            [],
            "model string, fold bigint, n_train_samples bigint, n_val_anchors bigint, mae_avg_all_steps double, "
            "rmse_avg_all_steps double, r2_avg_all_steps double, train_seconds double",
        )
    return fold_metrics(evaluate.summarize_by_step(spark.read.parquet(path), ("model", *_FOLD_KEYS, "step")))


def climatology(obs: DataFrame, axis: TimeAxis, pixel_dim: DataFrame, n_clusters: int = 4, n_lags: int = 24, radius: int | None = None) -> dict:
    """All exploratory tables by name; nothing runs until a table is used (clusters run at once).

    Correlations and clusters are those of all pairs of pixels; with ``radius`` there are no clusters, and
    only pixels at most that many cells apart are correlated, which is linear in the pixels.
    """
    onsets = climate.onset_events(obs)
    tests = unitroot.unit_root(obs)
    if radius is None:
        pairs = {"correlation": correlation.pixel_correlation(obs), "clusters": correlation.pixel_clusters(obs, pixel_dim, n_clusters)}
    else:
        pairs = {"correlation": correlation.neighbour_correlation(obs, pixel_dim, radius)}
    return {
        "diurnal": climate.diurnal_cycle(obs, axis),
        "risk": climate.risk_shares(obs),
        "onsets": onsets,
        "onset_counts": climate.onset_counts(onsets),
        "distribution": climate.distribution(obs),
        "acf_pacf": climate.acf_pacf(obs, n_lags),
        "unit_root": tests,
        **pairs,
    }


def compare_models(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fold summary, pairwise tests)."""
    return significance.summarize_folds(folds), significance.pairwise_significance(folds)


def profile_grid(obs: DataFrame, pixels: Sequence[str], rows: int = 5) -> dict:
    return {
        "columns": profile.column_listing(obs),
        "timeline": profile.timeline_profile(obs),
        "missing": profile.null_profile(obs),
        "preview": profile.preview(obs, pixels, rows),
    }


