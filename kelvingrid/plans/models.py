"""Model registry on Spark MLlib plus the closed-form baselines."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.operators import rollout
from kelvingrid.operators.samples import TARGET, feature_columns

# Boosting effort shared by all tree models.
ROUNDS = 300
DEPTH = 6
RATE = 0.05
ROW_SHARE = 0.8
COLUMN_SHARE = "0.8"
SEED = 42


def _gbt(**over):
    params = dict(
        maxIter=ROUNDS,
        maxDepth=DEPTH,
        stepSize=RATE,
        subsamplingRate=ROW_SHARE,
        featureSubsetStrategy=COLUMN_SHARE,
        seed=SEED,
        checkpointInterval=10,
        # trees are shallow: walking one costs less than a cached table of node ids per level; the model is the same
        cacheNodeIds=False,
    )
    return GBTRegressor(**{**params, **over})


def _forest(**over):
    params = dict(numTrees=100, maxDepth=DEPTH, subsamplingRate=ROW_SHARE, featureSubsetStrategy=COLUMN_SHARE, seed=SEED)
    return RandomForestRegressor(**{**params, **over})


def _linear(**over):
    return LinearRegression(**over)


REGISTRY: dict[str, Callable] = {"gbt": _gbt, "random_forest": _forest, "linear": _linear}

try:  # the distributed XGBoost estimator, where it is installed
    from xgboost.spark import SparkXGBRegressor

    def _xgboost(**over):
        params = dict(
            n_estimators=ROUNDS,
            max_depth=DEPTH,
            learning_rate=RATE,
            subsample=ROW_SHARE,
            colsample_bytree=float(COLUMN_SHARE),
            random_state=SEED,
        )
        return SparkXGBRegressor(**{**params, **over})

    REGISTRY["xgboost"] = _xgboost
except ImportError:
    pass

#: Samples below which one more task for a pass over them is not worth its start.
TASK_SAMPLES = 20_000

CLOSED_FORM = ("persistence", "window_mean", "ar1")


def estimator(name: str, **over):
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}, known: {sorted(REGISTRY)}")
    return REGISTRY[name](**over)


def spread(dataset: DataFrame, order: list[str]) -> DataFrame:
    """The samples in equal parts, at most one for every core; which part and place a sample has depends on its values only.

    Boosting passes over the samples six times a round: a part too many, or a larger one, makes cores wait each time.
    """
    cores = dataset.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, dataset.count() // TASK_SAMPLES))
    return dataset.repartition(parts, *dataset.columns).sortWithinPartitions(*order)


def fit_one(name: str, dataset: DataFrame, window: int, **over):
    """(model, seconds): fit a registered model on a window dataset."""
    inputs = feature_columns(window)
    features = VectorAssembler(inputCols=inputs, outputCol="features")
    begin = time.perf_counter()
    held = None
    if name == "gbt":
        # lag windows are built once, for the count and the fit
        held = dataset.drop("anchor_time", "target_time").persist(StorageLevel.DISK_ONLY)
    try:
        model = estimator(name, **over)
        rows = dataset if held is None else spread(held, [*inputs, TARGET])
        model = model.fit(features.transform(rows).select("features", F.col(TARGET).alias("label")))
    finally:
        if held is not None:
            held.unpersist()
    return model, time.perf_counter() - begin


def roll(name: str, model, frames: DataFrame, window: int, horizon: int, axis: TimeAxis, rate=0.0, cap=0.6):
    """Rollout with the cheapest equivalent plan for the model."""
    if name == "persistence":
        return rollout.rollout_linear(frames, rollout.persistence(), horizon, axis, rate, cap)
    if name == "window_mean":
        return rollout.rollout_linear(frames, rollout.window_mean(), horizon, axis, rate, cap)
    if name == "ar1":
        with_fit, step = rollout.with_ar1(frames, model)
        return rollout.rollout_linear(with_fit, step, horizon, axis, rate, cap).drop("ar1_intercept", "ar1_slope")
    if name == "linear":
        return rollout.rollout_linear(frames, rollout.as_linear(model, window), horizon, axis, rate, cap)
    return rollout.rollout_model(frames, model, window, horizon, axis, rate, cap)


def fit_any(name: str, dataset: DataFrame, window: int, **over):
    """Closed-form models need no training pass (AR(1): one aggregation, lazily)."""
    if name in ("persistence", "window_mean"):
        return None, 0.0
    if name == "ar1":
        return rollout.fit_ar1(dataset), 0.0
    return fit_one(name, dataset, window, **over)


def model_path(name: str, folder: str) -> str:
    return f"{folder.rstrip('/')}/model_{name}"


def save_model(model, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path).stages[0]
