"""Streaming twins of the batch operators.

Event time is a zoned timestamp column ``event_time`` (the session runs in UTC).
Rows later than the watermark reach no output; the default is one horizon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelvingrid.functions.scalars import CLEAR_LIMIT, COLD_LIMIT
from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.operators.blocks import BLOCK, block_of
from kelvingrid.operators.rollout import LinearStep, forecast_rows, rollout_linear
from kelvingrid.sources.catalog import large_enough, wanted_names


def with_event_time(rows: DataFrame, axis: TimeAxis, delay: str, slot: str = "slot", name: str = "event_time") -> DataFrame:
    return rows.withColumn(name, axis.time(F.col(slot)).cast("timestamp")).withWatermark(name, delay)


def incremental_ingest(listing: DataFrame) -> DataFrame:
    """New catalog rows that pass the name and size rules; the checkpoint is the ledger."""
    return large_enough(wanted_names(listing))


def unique_observations(rows: DataFrame) -> DataFrame:
    """First row of each (pixel, slot) within the watermark."""
    return rows.dropDuplicatesWithinWatermark(["pixel_id", "event_time"])


def windowed_shares(
    rows: DataFrame, length: str = "1 hour", slide: str | None = None, low: float = COLD_LIMIT, high: float = CLEAR_LIMIT
) -> DataFrame:
    """Risk shares and mean per tumbling or sliding window."""
    v = F.col("v")
    span = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    share = lambda c: F.avg(c.cast("double"))
    return rows.groupBy(span.alias("w")).agg(
        share(v < low).alias("deep_convective"),
        share((v >= low) & (v < high)).alias("moderate_cloud"),
        share(v >= high).alias("clear"),
        F.avg("v").alias("mean_v"),
        F.count("v").alias("n_obs"),
    ).select(F.col("w.start").alias("window_start"), "deep_convective", "moderate_cloud", "clear", "mean_v", "n_obs")


_STATE = T.StructType().add("slots", T.ArrayType(T.LongType())).add("values", T.ArrayType(T.DoubleType()))

#: Slots that a row may be late: one horizon.
DELAY_SLOTS = 18


def _keyed(rows: DataFrame, axis: TimeAxis, reach: int, delay_slots: int, block: int) -> DataFrame:
    """Rows by (pixel, block of slots); a row is copied to the next block when a result there reaches back to it.

    A backlog of one pixel is thus spread over its blocks instead of meeting in one group.
    """
    timed = with_event_time(rows.select("pixel_id", "slot", "v"), axis, f"{delay_slots * axis.step_seconds} seconds")
    home, later = block_of(F.col("slot"), block), block_of(F.col("slot") + F.lit(reach), block)
    return timed.withColumn("part", F.explode(F.array_distinct(F.array(home, later)))).select("pixel_id", "part", "slot", "v", "event_time")


def _merged(pdfs: Iterator[pd.DataFrame], state: GroupState) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remembered and new rows of one group in slot order, and which are new; of doubles the first to arrive stays."""
    new = pd.concat(list(pdfs))
    new = new[new["v"].notna()].drop_duplicates("slot")
    old_slots, old_values = state.get if state.exists else ([], [])
    known = np.asarray(old_slots, dtype=np.int64)
    new = new[~np.isin(new["slot"].to_numpy(np.int64), known)]
    slots = np.concatenate([known, new["slot"].to_numpy(np.int64)])
    values = np.concatenate([np.asarray(old_values, dtype=float), new["v"].to_numpy(float)])
    fresh = np.arange(len(slots)) >= len(known)
    order = np.argsort(slots, kind="stable")
    return slots[order], values[order], fresh[order]


def _remember(state: GroupState, slots: np.ndarray, values: np.ndarray, span: int, axis: TimeAxis, delay_slots: int) -> None:
    """Keep what a row inside the watermark can still meet; a group that stays silent for as long goes."""
    keep = slots >= slots[-1] - span
    state.update((slots[keep].tolist(), values[keep].tolist()))
    newest = int(pd.Timestamp(axis.origin).timestamp()) + int(slots[-1]) * axis.step_seconds
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, 1000 * (newest + 2 * (span + delay_slots) * axis.step_seconds)))


def onset_alerts(rows: DataFrame, axis: TimeAxis, drop: float = 15.0, steps: int = 3, delay_slots: int = DELAY_SLOTS, block: int = BLOCK) -> DataFrame:
    """Falls of at least ``drop`` over ``steps`` slots, in whichever order the two rows arrive.

    A fall is reported once, when the later of its rows to arrive is there.  Rows older than the watermark (``delay_slots``)
    are left out; the state of a (pixel, block) is the last ``steps + delay_slots`` slots and times out.
    """
    schema = "pixel_id string, onset_slot long, ctt_before double, ctt_after double, drop_k double"

    def update(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        slots, values, fresh = _merged(pdfs, state)
        if not len(slots):
            return
        at = np.minimum(np.searchsorted(slots, slots - steps), len(slots) - 1)
        fall = values[at] - values
        hit = (slots[at] == slots - steps) & (fall >= drop) & (fresh | fresh[at]) & (slots // block == key[1])
        _remember(state, slots, values, steps + delay_slots, axis, delay_slots)
        yield pd.DataFrame(
            {"pixel_id": key[0], "onset_slot": slots[hit], "ctt_before": values[at][hit], "ctt_after": values[hit], "drop_k": fall[hit]}
        )

    return (
        _keyed(rows, axis, steps, delay_slots, block)
        .groupBy("pixel_id", "part")
        .applyInPandasWithState(update, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def rolling_windows(rows: DataFrame, axis: TimeAxis, window: int, delay_slots: int = DELAY_SLOTS, block: int = BLOCK) -> DataFrame:
    """(pixel_id, slot, lags) as soon as ``window`` adjacent slots are there, in whichever order they arrive.

    A window is given out once, with the last of its rows to arrive; state and lateness as in ``onset_alerts``.
    """
    schema = "pixel_id string, slot long, lags array<double>"

    def update(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        slots, values, fresh = _merged(pdfs, state)
        if not len(slots):
            return
        index = np.arange(window - 1, len(slots))
        news = np.r_[0, np.cumsum(fresh)]
        whole = slots[index] - slots[index - window + 1] == window - 1
        ready = index[whole & (news[index + 1] > news[index - window + 1]) & (slots[index] // block == key[1])]
        _remember(state, slots, values, window - 1 + delay_slots, axis, delay_slots)
        yield pd.DataFrame(
            {"pixel_id": key[0], "slot": slots[ready], "lags": [values[i - window + 1 : i + 1][::-1].tolist() for i in ready]}
        )

    return (
        _keyed(rows, axis, window - 1, delay_slots, block)
        .groupBy("pixel_id", "part")
        .applyInPandasWithState(update, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def rolling_forecast(rows: DataFrame, window: int, model: LinearStep, horizon: int, axis: TimeAxis) -> DataFrame:
    """A forecast for every newly completed window; the rollout is a plain projection."""
    return forecast_rows(rollout_linear(rolling_windows(rows, axis, window), model, horizon, axis), axis)


def verified(forecasts: DataFrame, observations: DataFrame, horizon_span: str) -> DataFrame:
    """Forecast rows joined to the observation of their target slot.

    Both sides carry watermarks; the time bound lets old state go.
    """
    obs = observations.select(
        F.col("pixel_id").alias("_pixel"), F.col("slot").alias("_slot"), F.col("v").alias("y_true"), "event_time"
    )
    bound = (F.col("event_time") >= F.col("made_at")) & (
        F.col("event_time") <= F.col("made_at") + F.expr(f"INTERVAL {horizon_span}")
    )
    same = (F.col("pixel_id") == F.col("_pixel")) & (F.col("target_slot") == F.col("_slot"))
    return forecasts.join(obs, same & bound).select(
        "pixel_id", "target_slot", "step", "y_pred", "y_true", F.abs(F.col("y_pred") - F.col("y_true")).alias("abs_error")
    )


def gap_free_runs(rows: DataFrame, axis: TimeAxis, span: int) -> DataFrame:
    """Sessions of adjacent slots with their length and number of valid span starts."""
    gap = f"{axis.step_seconds * 3 // 2} seconds"
    n = F.count(F.lit(1))
    return rows.groupBy("pixel_id", F.session_window("event_time", gap).alias("w")).agg(
        F.min("slot").alias("first_slot"), n.alias("n_slots")
    ).select(
        "pixel_id", "first_slot", "n_slots", F.greatest(F.col("n_slots") - (span - 1), F.lit(0)).alias("n_anchors")
    )
