"""Lag windows, anchors and rollout frames.

Rows with a null value are left out first.  On the remaining rows a span of
``n`` slots is complete exactly when the slot distance between its two ends is
``n - 1``, so completeness costs two offsets and no gap-filled grid is needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from kelvingrid.functions.scalars import cyclic_time
from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.operators.blocks import BLOCK, framed
from kelvingrid.session import written

TARGET = "target_tbb"
TIME_FEATURES = ["hour_sin", "hour_cos"]


def strided(rows: DataFrame, columns, back: int, ahead: int, stride: int, block: int, keys=("pixel_id",)) -> DataFrame:
    """``framed`` rows with ``_ok``, of those every ``stride``-th per series by position."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    if stride == 1:
        return framed(rows, columns, back, ahead, keys, block, keep=ok).drop("_ok")
    found = framed(rows, columns, back, ahead, keys, block, keep=ok, number={"_pos": ok})
    return found.filter(F.col("_pos") % stride == 0).drop("_ok", "_pos")


def lag_columns(window: int) -> list[str]:
    return [f"lag_{k}" for k in range(1, window + 1)]


def feature_columns(window: int) -> list[str]:
    """The one feature order used for fitting and for rollouts."""
    return lag_columns(window) + TIME_FEATURES


def valid_rows(obs: DataFrame) -> DataFrame:
    return obs.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def _complete(w: WindowSpec, back: int, ahead: int) -> Column:
    first = F.lag("slot", back).over(w) if back else F.col("slot")
    last = F.lead("slot", ahead).over(w) if ahead else F.col("slot")
    return last - first == back + ahead


def _lags(w: WindowSpec, window: int) -> list[Column]:
    return [F.col("v") if k == 0 else F.lag("v", k).over(w) for k in range(window)]


def _leads(w: WindowSpec, horizon: int) -> list[Column]:
    return [F.lead("v", k).over(w) for k in range(1, horizon + 1)]


def window_samples(
    obs: DataFrame,
    window: int,
    block: int = BLOCK,
    keys: tuple[str, ...] = ("pixel_id",),
    clock: str = "slot",
) -> DataFrame:
    """(keys, slot, lag_1..lag_w, target_slot, target_tbb) per complete window + target.

    ``lag_1`` is the value at the anchor slot, ``lag_w`` the oldest one.
    ``clock`` names the column that holds the true slot when ``slot`` was renumbered.
    """

    def columns(w: WindowSpec):
        out = {name: expr for name, expr in zip(lag_columns(window), _lags(w, window))}
        out["target_slot"] = F.lead("_clock", 1).over(w)
        out[TARGET] = F.lead("v", 1).over(w)
        out["_ok"] = _complete(w, window - 1, 1)
        return out

    rows = valid_rows(obs).select(*keys, "slot", F.col(clock).alias("_clock"), "v")
    return strided(rows, columns, window - 1, 1, 1, block, keys).drop("_clock", "v")


def window_dataset(
    obs: DataFrame,
    window: int,
    axis: TimeAxis,
    pixel_dim: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Training table: lags, time features of the target time, keys, target."""
    samples = window_samples(obs, window, block)
    target_time = axis.time(F.col("target_slot"))
    hour_sin, hour_cos = cyclic_time(target_time)
    out = samples.withColumns(
        {
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "anchor_time": axis.time(F.col("slot")),
            "target_time": target_time,
        }
    )
    keys = ["pixel_id"]
    if pixel_dim is not None:
        out = out.join(pixel_dim.select("pixel_id", "latitude", "longitude"), "pixel_id", "left")
        keys += ["latitude", "longitude"]
    return out.select(*feature_columns(window), *keys, "slot", "anchor_time", "target_time", TARGET)


def anchors(obs: DataFrame, window: int, horizon: int, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """(pixel_id, slot) whose window and whole horizon are complete."""
    rows = valid_rows(obs).select("pixel_id", "slot")
    return strided(rows, lambda w: {"_ok": _complete(w, window - 1, horizon)}, window - 1, horizon, stride, block)


def span_starts(obs: DataFrame, span: int, stride: int = 1, block: int = BLOCK) -> DataFrame:
    """(pixel_id, slot) where ``span`` complete slots begin."""
    rows = valid_rows(obs).select("pixel_id", "slot")
    return strided(rows, lambda w: {"_ok": _complete(w, 0, span - 1)}, 0, span - 1, stride, block)


def rollout_frames(
    obs: DataFrame,
    window: int,
    horizon: int,
    stride: int = 1,
    block: int = BLOCK,
    keys: tuple[str, ...] = ("pixel_id",),
) -> DataFrame:
    """(pixel_id, slot, lags[w], future[h]); ``horizon=0`` gives windows only."""

    def columns(w: WindowSpec):
        return {
            "lags": F.array(*_lags(w, window)),
            "future": F.array(*_leads(w, horizon)) if horizon else F.array().cast("array<double>"),
            "_ok": _complete(w, window - 1, horizon),
        }

    rows = valid_rows(obs).select(*keys, "slot", "v")
    return strided(rows, columns, window - 1, horizon, stride, block, keys).drop("v")


def _run_length(w: WindowSpec, widest: int) -> Column:
    """Complete slots ending here, capped at ``widest`` (the flags are monotone in k)."""
    flags = [F.coalesce((F.col("slot") - F.lag("slot", k).over(w) == k).cast("int"), F.lit(0)) for k in range(1, widest)]
    return sum(flags, F.lit(1))


def multi_window_frames(
    obs: DataFrame, windows: Sequence[int], horizon: int, stride: int = 1, block: int = BLOCK
) -> DataFrame:
    """(window, pixel_id, slot, lags, future) for several window sizes in one pass.

    One window pass computes the widest lag array and how many of its entries
    are complete; each size takes a prefix of it.  Positions for the stride are
    counted per size before the rows are expanded.
    """
    widest = max(windows)

    def columns(w: WindowSpec):
        return {
            "lags": F.array(*_lags(w, widest)),
            "future": F.array(*_leads(w, horizon)) if horizon else F.array().cast("array<double>"),
            "run": _run_length(w, widest),
            "_ahead": _complete(w, 0, horizon),
        }

    ok = {f"pos_{n}": F.coalesce(F.col("_ahead"), F.lit(False)) & (F.col("run") >= n) for n in windows}
    rows = valid_rows(obs).select("pixel_id", "slot", "v")
    anyone = F.coalesce(F.col("_ahead"), F.lit(False)) & (F.col("run") >= min(windows))
    numbered = {} if stride == 1 else ok
    found = framed(rows, columns, widest - 1, horizon, block=block, keep=anyone, number=numbered)
    hit = lambda n: ok[f"pos_{n}"] if stride == 1 else ok[f"pos_{n}"] & (F.col(f"pos_{n}") % stride == 0)
    sizes = F.array(*[F.when(hit(n), F.lit(n)) for n in windows])
    return found.select(
        F.explode(F.filter(sizes, lambda x: x.isNotNull())).alias("window"), "pixel_id", "slot", "lags", "future"
    ).select("window", "pixel_id", "slot", F.slice("lags", F.lit(1), F.col("window")).alias("lags"), "future")


def wide_samples(obs: DataFrame, widest: int, block: int = BLOCK) -> DataFrame:
    """(pixel_id, slot, lags[widest], run, target_slot, target): rows with ``run >= w``
    are exactly the samples of window ``w``; entries beyond ``run`` are not complete."""

    def columns(w: WindowSpec):
        return {
            "lags": F.array(*_lags(w, widest)),
            "run": _run_length(w, widest),
            TARGET: F.lead("v", 1).over(w),
            "_ok": _complete(w, 0, 1),
        }

    rows = valid_rows(obs).select("pixel_id", "slot", "v")
    return strided(rows, columns, widest - 1, 1, 1, block).withColumn("target_slot", F.col("slot") + 1).drop("v")


def dataset_for_window(wide: DataFrame, window: int, axis: TimeAxis) -> DataFrame:
    """Training table of one window size cut from ``wide_samples``."""
    hour_sin, hour_cos = cyclic_time(axis.time(F.col("target_slot")))
    lags = [F.element_at("lags", k + 1).alias(n) for k, n in enumerate(lag_columns(window))]
    return wide.filter(F.col("run") >= window).select(
        *lags, hour_sin.alias("hour_sin"), hour_cos.alias("hour_cos"), "pixel_id", "slot", TARGET
    )


def frames_at(obs: DataFrame, wanted: DataFrame, window: int, horizon: int, block: int = BLOCK) -> DataFrame:
    """Frames at requested (pixel_id, slot) keys."""
    keys = wanted.select("pixel_id", "slot").distinct()
    return rollout_frames(obs, window, horizon, block=block).join(keys, ["pixel_id", "slot"], "left_semi")


def earliest_anchor_times(frames: DataFrame, n: int) -> DataFrame:
    """Frames at the ``n`` earliest distinct anchor times, all pixels kept."""
    last = frames.select("slot").distinct().orderBy("slot").limit(n).agg(F.max("slot").alias("last"))
    return frames.filter(F.col("slot") <= last.scalar())


def latest_windows(obs: DataFrame, window: int, t0_slot: Column | int | None = None, block: int = BLOCK) -> DataFrame:
    """Per pixel the newest complete window ending at or before ``t0_slot``."""
    rows = obs if t0_slot is None else obs.filter(F.col("slot") <= t0_slot)
    frames = rollout_frames(rows, window, 0, block=block)
    newest = frames.groupBy("pixel_id").agg(F.max_by(F.struct("slot", "lags"), "slot").alias("w"))
    return newest.select("pixel_id", F.col("w.slot").alias("slot"), F.col("w.lags").alias("lags"))


def stored_dates(grid: DataFrame) -> list[date]:
    """The ``date`` folders of a stored grid, from the file listing alone; none where it is not stored by date."""
    found = {m.group(1) for m in (re.search(r"/date=(\d{4}-\d{2}-\d{2})/", f) for f in grid.inputFiles()) if m}
    return sorted(date.fromisoformat(d) for d in found) if "date" in grid.columns else []


def backward_starts(dates: Sequence[date]) -> Iterator[date]:
    """First dates of growing ranges that end at the newest date: 1, 3, 7, ... folders, all of them last."""
    n = 1
    while dates:
        yield dates[max(0, len(dates) - n)]
        if n >= len(dates):
            return
        n = 2 * n + 1


def newest_windows(grid: DataFrame, window: int, axis: TimeAxis, pixel_dim: DataFrame, t0_slot: int | None = None, block: int = BLOCK) -> DataFrame:
    """``latest_windows`` of the pixels in ``pixel_dim`` from a grid stored by date, read from the newest folder backwards.

    Each round reads about twice as many folders as the one before, for pixels without a window so far, and the rounds end when
    every pixel has one: what is read grows with the longest gap, not with the history.  All windows have one length, so
    those that begin before the folders read so far end before any window inside them; a round reads only as far
    forward as such windows reach.  Pixels and windows of a round are tables in the shared folder.
    """
    dates = stored_dates(grid)
    if not dates:
        raise ValueError("the grid is not stored by date")
    rows = grid if t0_slot is None else grid.filter(F.col("slot") <= t0_slot)
    if t0_slot is not None:
        newest = axis.moment(t0_slot).date()
        dates = [d for d in dates if d <= newest] or dates[:1]
    wanted, found, until = written(pixel_dim.select("pixel_id").distinct(), "wanted"), None, dates[-1]
    for first in backward_starts(dates):
        near = rows.filter(F.col("date").between(F.lit(first), F.lit(until))).join(wanted, "pixel_id", "left_semi")
        got = written(latest_windows(near.select("pixel_id", "slot", "v"), window, block=block), "newest")
        found = got if found is None else found.unionByName(got)
        wanted = written(wanted.join(got, "pixel_id", "left_anti"), "wanted")
        if wanted.isEmpty():
            break
        reach = datetime.combine(first, time.min) + timedelta(seconds=(window - 1) * axis.step_seconds)
        until = min(reach.date(), dates[-1])
    return found


def skipped_pixels(pixel_dim: DataFrame, windows: DataFrame) -> DataFrame:
    return pixel_dim.join(windows.select("pixel_id"), "pixel_id", "left_anti")


def recent_rows(obs: DataFrame, n: int, t0_slot: int | None = None, axis: TimeAxis | None = None) -> DataFrame:
    """Rows of the last ``n`` distinct observation times, optionally up to ``t0_slot``.

    With ``axis`` a grid stored by date is read from the newest folder backwards until that many times are found.
    """
    if n < 1:
        raise ValueError("the number of recent times must be at least 1")
    rows = obs if t0_slot is None else obs.filter(F.col("slot") <= t0_slot)
    if axis is not None:
        for start in backward_starts(stored_dates(obs)):
            near = rows.filter(F.col("date") >= F.lit(start))
            if near.select("slot").distinct().limit(n).count() == n:
                rows = near
                break
    newest = rows.select("slot").distinct().orderBy(F.desc("slot")).limit(n)
    first = newest.agg(F.min("slot")).scalar()
    if axis is not None and "date" in obs.columns:
        rows = rows.filter(F.col("date") >= F.to_date(axis.time(first)))
    return rows.filter(F.col("slot") >= first)


def first_times(obs: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` distinct observation times (smoke runs)."""
    oldest = obs.select("slot").distinct().orderBy("slot").limit(n)
    return obs.filter(F.col("slot") <= oldest.agg(F.max("slot")).scalar())
