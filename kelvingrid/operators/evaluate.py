"""Error, R2 and spatial metrics of forecast detail rows.

Everything comes from one pass: rows are reduced to moments per
(group, step, anchor) with map-side partials, and the tiny second level derives
step metrics and spatial metrics from those moments.

Conventions: ``pred_std``/``true_std`` are sample deviations; the spatial
ratio uses population deviations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

R2_EPS = 1e-12
COLLAPSE_EPS = 1e-6
FLAT_STD = 1e-9


def anchor_moments(detail: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Moments of prediction and truth over the pixels of one (keys, anchor)."""
    p, t = F.col("y_pred"), F.col("y_true")
    return detail.groupBy(*keys, "slot").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("abs_error").alias("sum_ae"),
        F.sum((t - p) * (t - p)).alias("sum_se"),
        F.avg(p).alias("mean_p"),
        F.avg(t).alias("mean_t"),
        F.var_pop(p).alias("var_p"),
        F.var_pop(t).alias("var_t"),
        F.covar_pop(p, t).alias("cov_pt"),
        F.min(t).alias("min_t"),
        F.max(t).alias("max_t"),
    )


def collapse_ratio(std_pred: Column, std_true: Column) -> Column:
    return std_pred / (std_true + F.lit(COLLAPSE_EPS))


def guarded_corr(n: Column, std_pred: Column, std_true: Column, cov: Column) -> Column:
    """0 for fewer than two pixels or a flat field (the built-in corr fails there in ANSI mode)."""
    flat = (n < 2) | (std_pred < FLAT_STD) | (std_true < FLAT_STD)
    return F.when(flat, F.lit(0.0)).otherwise(F.try_divide(cov, std_pred * std_true))


def spatial_by_anchor(detail: DataFrame, keys: Sequence[str] = ("model", "step")) -> DataFrame:
    """Collapse ratio and correlation per (keys, anchor) with at least two pixels."""
    m = anchor_moments(detail, keys).filter("n >= 2")
    sp, st = F.sqrt("var_p"), F.sqrt("var_t")
    return m.select(
        *keys,
        "slot",
        "n",
        collapse_ratio(sp, st).alias("collapse_ratio"),
        guarded_corr(F.col("n"), sp, st, F.col("cov_pt")).alias("correlation"),
    )


def r2_from(sum_se: Column, ss_tot: Column) -> Column:
    return F.lit(1.0) - sum_se / (ss_tot + F.lit(R2_EPS))


def _pooled_m2(n: Column, mean: Column, var: Column) -> Column:
    """Squared deviations of the union of groups from their moments."""
    total, mass = F.sum(n), F.sum(n * mean)
    return F.greatest(F.sum(n * var) + F.sum(n * mean * mean) - mass * mass / total, F.lit(0.0))


def summarize_by_step(detail: DataFrame, keys: Sequence[str] = ("model", "step")) -> DataFrame:
    """mae, rmse, n_samples, pred_std, true_std, r2 and the spatial summary per keys."""
    m = anchor_moments(detail, keys)
    n = F.col("n")
    multi = F.col("n") >= 2
    sp, st = F.sqrt("var_p"), F.sqrt("var_t")
    g = m.groupBy(*keys).agg(
        F.sum("n").alias("n_samples"),
        F.sum("sum_ae").alias("ae"),
        F.sum("sum_se").alias("se"),
        _pooled_m2(n, F.col("mean_p"), F.col("var_p")).alias("m2_p"),
        F.when(F.min("min_t") == F.max("max_t"), F.lit(0.0))
        .otherwise(_pooled_m2(n, F.col("mean_t"), F.col("var_t")))
        .alias("m2_t"),
        F.avg(F.when(multi, collapse_ratio(sp, st))).alias("spatial_collapse_ratio"),
        F.avg(F.when(multi, guarded_corr(n, sp, st, F.col("cov_pt")))).alias("spatial_correlation"),
        F.count_if(multi).alias("groups"),
    )
    rows = F.col("n_samples")
    spread = lambda m2: F.when(rows > 1, F.sqrt(F.col(m2) / (rows - 1)))
    return g.select(
        *keys,
        (F.col("ae") / rows).alias("mae"),
        F.sqrt(F.col("se") / rows).alias("rmse"),
        "n_samples",
        spread("m2_p").alias("pred_std"),
        spread("m2_t").alias("true_std"),
        r2_from(F.col("se"), F.col("m2_t")).alias("r2"),
        "spatial_collapse_ratio",
        "spatial_correlation",
        F.when(F.col("groups") > 0, F.col("groups")).alias("n_t0_groups"),
    )


def pooled_errors(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mae, rmse, n_samples and r2 per keys as in ``summarize_by_step``, from moments of parts of their rows."""
    rows = F.sum("n")
    m2_t = F.when(F.min("min_t") == F.max("max_t"), F.lit(0.0)).otherwise(_pooled_m2(F.col("n"), F.col("mean_t"), F.col("var_t")))
    return moments.groupBy(*keys).agg(
        (F.sum("sum_ae") / rows).alias("mae"),
        F.sqrt(F.sum("sum_se") / rows).alias("rmse"),
        rows.alias("n_samples"),
        r2_from(F.sum("sum_se"), m2_t).alias("r2"),
    )


def step_errors(detail: DataFrame, keys: Sequence[str] = ("model", "step")) -> DataFrame:
    """MAE, RMSE, count and sample deviations only."""
    e = F.col("abs_error")
    return detail.groupBy(*keys).agg(
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.count(F.lit(1)).alias("n_samples"),
        F.stddev_samp("y_pred").alias("pred_std"),
        F.stddev_samp("y_true").alias("true_std"),
    )


def r2_by_group(detail: DataFrame, keys: Sequence[str] = ("model", "step")) -> DataFrame:
    p, t = F.col("y_pred"), F.col("y_true")
    return detail.groupBy(*keys).agg(
        r2_from(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t)).alias("r2")
    )


def step_average(summary: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Null-skipping mean of the step metrics."""
    return summary.groupBy(*keys).agg(
        F.avg("mae").alias("mae_avg_all_steps"),
        F.avg("rmse").alias("rmse_avg_all_steps"),
        F.avg("r2").alias("r2_avg_all_steps"),
    )


def rank_models(summary: DataFrame, first_step: int, last_step: int) -> DataFrame:
    """Mean MAE per model over a step range, best first."""
    rows = summary.filter(F.col("step").between(first_step, last_step))
    return rows.groupBy("model").agg(F.avg("mae").alias("avg_mae_priority_range")).orderBy(
        "avg_mae_priority_range", "model"
    )


def realized_error(forecast: DataFrame) -> DataFrame:
    """MAE and pixel count per step over rows that have a truth value."""
    return (
        forecast.na.drop(subset=["y_true"])
        .groupBy("step")
        .agg(F.avg("abs_error").alias("mae"), F.count(F.lit(1)).alias("n_pixel"))
    )


def first_vs_last(forecast: DataFrame, horizon: int) -> DataFrame:
    """Forecast of the first and the last step side by side per pixel, one aggregation."""
    at = lambda s: F.max(F.when(F.col("step") == s, F.col("y_pred")))
    rows = forecast.filter(F.col("step").isin(1, horizon)).groupBy("pixel_id").agg(
        at(1).alias("y_first"), at(horizon).alias("y_last")
    )
    return rows.filter("y_first is not null and y_last is not null").withColumn(
        "change", F.col("y_last") - F.col("y_first")
    )
