"""Recursive multi-step rollout of one-step models.

Closed-form models run as one fold over the steps inside a single projection;
MLlib models run as ``horizon`` chained transforms.  Neither shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from kelvingrid.functions.scalars import array_mean, array_sum, blend, cyclic_time, cyclic_values, damping_weight
from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.operators.samples import TIME_FEATURES, lag_columns


@dataclass(frozen=True)
class LinearStep:
    """One-step model ``intercept + sum(coef_k * lag_k) + time terms``.

    Coefficients are literals (a fitted model) or columns of the frame (one
    model per group, e.g. per fold).
    """

    intercept: Column | float
    lag_coefs: list[Column | float] = field(default_factory=list)
    time_coefs: tuple[Column | float, Column | float] | None = None
    average: bool = False
    #: an array column of lag coefficients, oldest lag first, where the window differs from row to row
    lag_array: Column | None = None

    def predict(self, history: Column, state: Column, hour_sin: Column, hour_cos: Column) -> Column:
        """Next value; ``history`` ends with ``state``, the current window, oldest first."""
        if self.average:
            return array_mean(state)
        out = _lit(self.intercept)
        if len(self.lag_coefs) == 1:
            out = out + _lit(self.lag_coefs[0]) * F.element_at(history, -1)
        elif self.lag_coefs:
            coefs = F.array(*[_lit(c) for c in reversed(self.lag_coefs)])
            out = out + array_sum(F.zip_with(coefs, state, lambda c, x: c * x))
        elif self.lag_array is not None:
            out = out + array_sum(F.zip_with(self.lag_array, state, lambda c, x: c * x))
        if self.time_coefs is not None:
            out = out + _lit(self.time_coefs[0]) * hour_sin + _lit(self.time_coefs[1]) * hour_cos
        return out


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def persistence() -> LinearStep:
    return LinearStep(0.0, [1.0])


def window_mean() -> LinearStep:
    """Mean of the current window, whatever its length."""
    return LinearStep(0.0, average=True)


def fit_ar1(samples: DataFrame, target: str = "target_tbb") -> DataFrame:
    """One row (intercept, slope) of the regression of the target on lag_1."""
    return samples.agg(
        F.regr_intercept(target, "lag_1").alias("ar1_intercept"), F.regr_slope(target, "lag_1").alias("ar1_slope")
    )


def with_ar1(frames: DataFrame, fit: DataFrame) -> tuple[DataFrame, LinearStep]:
    """Frames with the fitted AR(1) coefficients as a scalar subquery."""
    both = fit.select(F.struct("ar1_intercept", "ar1_slope").alias("f")).scalar()
    out = frames.withColumns({"ar1_intercept": both["ar1_intercept"], "ar1_slope": both["ar1_slope"]})
    return out, LinearStep(F.col("ar1_intercept"), [F.col("ar1_slope")])


def rollout_expr(
    model: LinearStep,
    horizon: int,
    axis: TimeAxis | None = None,
    damping_rate: float = 0.0,
    damping_cap: float = 0.6,
) -> Column:
    """Array of ``horizon`` recursive predictions from the frame columns ``lags`` and ``slot``.

    Each prediction becomes the new lag_1 and the oldest lag drops out; time
    features always come from anchor time + step.  With damping, step k (from 0)
    is pulled to the mean of the observed window with weight min(rate*k, cap).
    """
    lags = F.col("lags")
    window = F.size(lags)
    damped = damping_rate > 0
    # a lambda re-evaluates outside expressions for every element, so the mean of
    # the observed window is computed once and travels in front of the history
    start = F.concat(F.array(array_mean(lags)), F.reverse(lags)) if damped else F.reverse(lags)

    def step(history: Column, k: Column) -> Column:
        # oldest first, so that a prediction is appended and nothing is shifted
        state = F.slice(history, -window, window)
        if model.time_coefs is not None:
            if axis is None:
                raise ValueError("a model with time features needs the time axis")
            sin, cos = cyclic_time(axis.time(F.col("slot") + k + F.lit(1)))
        else:
            sin = cos = F.lit(0.0)
        pred = model.predict(history, state, sin, cos)
        if damped:
            pred = blend(pred, F.element_at(history, 1), damping_weight(k, damping_rate, damping_cap))
        return F.array_append(history, pred)

    steps = F.sequence(F.lit(0), F.lit(horizon - 1))
    return F.slice(F.aggregate(steps, start, step), window + (2 if damped else 1), F.lit(horizon))


def rollout_linear(
    frames: DataFrame,
    model: LinearStep,
    horizon: int,
    axis: TimeAxis | None = None,
    damping_rate: float = 0.0,
    damping_cap: float = 0.6,
    out: str = "preds",
) -> DataFrame:
    return frames.withColumn(out, rollout_expr(model, horizon, axis, damping_rate, damping_cap))


def rollout_many(
    frames: DataFrame,
    models: Mapping[str, LinearStep],
    horizon: int,
    axis: TimeAxis | None = None,
    damping_rate: float = 0.0,
    damping_cap: float = 0.6,
) -> DataFrame:
    """Several closed-form models over one read of the frames: a ``model`` column and ``preds``."""
    runs = [
        F.struct(F.lit(n).alias("model"), rollout_expr(m, horizon, axis, damping_rate, damping_cap).alias("preds"))
        for n, m in models.items()
    ]
    return frames.select("*", F.explode(F.array(*runs)).alias("_m")).select(*frames.columns, "_m.*")


_MOMENTS = ["n", "sum_ae", "sum_se", "mean_t", "var_t", "min_t", "max_t"]
_ERRORS = "model string, window int, n_fit bigint, train_seconds double, step int, n bigint, " + ", ".join(f"{c} double" for c in _MOMENTS[1:])


def window_errors(
    ready: DataFrame,
    names: Sequence[str],
    horizon: int,
    axis: TimeAxis,
    damping_rate: float = 0.0,
    damping_cap: float = 0.6,
) -> DataFrame:
    """Moments of error and truth per (model, window, n_fit, train_seconds, step), several rows of parts each.

    ``ready`` has frames (window, slot, lags, future) and, the same for all rows of a window, the columns of
    ``leastsquares.fits``.  The frames of one Arrow batch and window are rolled out together as matrices, by the rules of
    ``rollout_expr``; only their moments leave the task, not a row per frame and step.
    """
    weights = [min(damping_rate * k, damping_cap) for k in range(horizon)]

    def predicted(model: str, lags: np.ndarray, fit: dict, sin: np.ndarray, cos: np.ndarray) -> np.ndarray | None:
        w = lags.shape[1]
        if model == "ar1" and (fit["ar1_intercept"] is None or fit["ar1_slope"] is None):
            return None
        past = np.concatenate([lags[:, ::-1], np.empty((len(lags), horizon))], axis=1)
        mean = lags.mean(axis=1)
        for k in range(horizon):
            state = past[:, k : k + w]
            if model == "persistence":
                out = state[:, -1]
            elif model == "window_mean":
                out = state.mean(axis=1)
            elif model == "ar1":
                out = fit["ar1_intercept"] + fit["ar1_slope"] * state[:, -1]
            else:
                out = fit["lin_intercept"] + state @ np.array(fit["lin_coefs"]) + fit["lin_sin"] * sin[:, k] + fit["lin_cos"] * cos[:, k]
            past[:, k + w] = (1.0 - weights[k]) * out + weights[k] * mean if damping_rate > 0 else out
        return past[:, w:]

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        windows, slots = batch.column("window").to_numpy(), batch.column("slot").to_numpy()
        lags, future = batch.column("lags"), batch.column("future")
        starts, flat = lags.offsets.to_numpy()[:-1] - lags.offsets[0].as_py(), lags.flatten().to_numpy(zero_copy_only=False)
        truths = future.flatten().to_numpy(zero_copy_only=False).reshape(-1, horizon)  # fails where a future has another length
        for window in np.unique(windows).tolist():
            rows = np.flatnonzero(windows == window)
            fit = {c: batch.column(c)[int(rows[0])].as_py() for c in _FIT_COLUMNS}
            known, truth = flat[starts[rows][:, None] + np.arange(window)], truths[rows]
            sin, cos = cyclic_values(axis.seconds(slots[rows][:, None] + np.arange(1, horizon + 1)))
            of_truth = [truth.mean(axis=0), truth.var(axis=0), truth.min(axis=0), truth.max(axis=0)]
            for model in names:
                preds = predicted(model, known, fit, sin, cos)
                seconds = fit["train_seconds"] if model in ("ar1", "linear") else 0.0
                error = None if preds is None else np.abs(preds - truth)
                for k in range(horizon):
                    sums = (None, None) if error is None else (error[:, k].sum(), (error[:, k] ** 2).sum())
                    yield (model, window, fit["n_fit"], seconds, k + 1, len(rows), *map(_plain, sums), *(float(m[k]) for m in of_truth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = list(zip(*parts(batch)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=fields)

    fields = [c.split()[0] for c in _ERRORS.split(", ")]
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    types = [arrow[c.split()[1]] for c in _ERRORS.split(", ")]
    return ready.select("window", F.col("slot").cast("bigint").alias("slot"), "lags", "future", *_FIT_COLUMNS).mapInArrow(run, _ERRORS)


_FIT_COLUMNS = ["n_fit", "lin_intercept", "lin_coefs", "lin_sin", "lin_cos", "ar1_intercept", "ar1_slope", "train_seconds"]


def _plain(x) -> float | None:
    return None if x is None else float(x)


def rollout_model(
    frames: DataFrame,
    model,
    window: int,
    horizon: int,
    axis: TimeAxis,
    damping_rate: float = 0.0,
    damping_cap: float = 0.6,
    out: str = "preds",
) -> DataFrame:
    """Same contract for any fitted MLlib regressor on the assembled features."""
    keep = frames.columns
    names = lag_columns(window)
    cols = {n: F.element_at("lags", k + 1) for k, n in enumerate(names)}
    state = frames.withColumns(cols)
    if damping_rate > 0:
        state = state.withColumn("_reference", array_mean(F.col("lags")))
    assembler = VectorAssembler(inputCols=names + TIME_FEATURES, outputCol="_features")
    plain = model.copy({model.featuresCol: "_features", model.predictionCol: "_raw"})
    for k in range(horizon):
        sin, cos = cyclic_time(axis.time(F.col("slot") + F.lit(k + 1)))
        scored = plain.transform(assembler.transform(state.withColumns({"hour_sin": sin, "hour_cos": cos})))
        pred = F.col("_raw")
        if damping_rate > 0 and k > 0:
            pred = blend(pred, F.col("_reference"), damping_weight(F.lit(k), damping_rate, damping_cap))
        scored = scored.withColumn(f"_p{k}", pred).drop("_features", "_raw")
        shifted = {names[0]: F.col(f"_p{k}")}
        shifted.update({names[i]: F.col(names[i - 1]) for i in range(1, window)})
        state = scored.withColumns(shifted)
    return state.select(*keep, F.array(*[F.col(f"_p{k}") for k in range(horizon)]).alias(out))


def as_linear(model, window: int) -> LinearStep:
    """Fold form of a fitted MLlib linear regression (w + 2 coefficients)."""
    coefs = [float(c) for c in model.coefficients]
    return LinearStep(float(model.intercept), coefs[:window], (coefs[window], coefs[window + 1]))


def detail_rows(
    rolled: DataFrame, model_name: str | Column, axis: TimeAxis, preds: str = "preds", extra: tuple[str, ...] = ()
) -> DataFrame:
    """Wide predictions to one row per step; unequal array lengths are an error."""
    name = F.lit(model_name) if isinstance(model_name, str) else model_name
    same = F.size(preds) == F.size("future")
    checked = F.when(same, F.arrays_zip(F.col(preds).alias("p"), F.col("future").alias("t"))).otherwise(
        F.raise_error(F.lit("predictions and future differ in length"))
    )
    rows = rolled.select(
        *extra, name.alias("model"), "pixel_id", "slot", F.posexplode(checked).alias("_i", "_z")
    )
    step = F.col("_i") + 1
    pred, truth = F.col("_z.p"), F.col("_z.t")
    return rows.select(
        *extra,
        "model",
        "pixel_id",
        "slot",
        axis.time(F.col("slot")).alias("anchor_t0"),
        step.alias("step"),
        axis.time(F.col("slot") + step).alias("target_time"),
        truth.alias("y_true"),
        pred.alias("y_pred"),
        F.abs(pred - truth).alias("abs_error"),
    )


def forecast_rows(rolled: DataFrame, axis: TimeAxis, preds: str = "preds", extra: tuple[str, ...] = ()) -> DataFrame:
    """Long forecast without truth."""
    rows = rolled.select(*extra, "pixel_id", "slot", F.posexplode(preds).alias("_i", "y_pred"))
    step = F.col("_i") + 1
    return rows.select(
        *extra,
        "pixel_id",
        axis.time(F.col("slot")).alias("window_end_time"),
        step.alias("step"),
        (F.col("slot") + step).alias("target_slot"),
        axis.time(F.col("slot") + step).alias("target_time"),
        "y_pred",
    )
