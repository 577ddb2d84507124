"""Mapping between timestamps and integer slots of a uniform time axis."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class TimeAxis:
    """Uniform axis: slot ``s`` covers ``origin + s * step_seconds``."""

    origin: str
    step_seconds: int = 600

    @property
    def origin_col(self) -> Column:
        return F.to_timestamp_ntz(F.lit(self.origin))

    def moment(self, slot: int) -> datetime:
        """Start time of one slot as a Python value."""
        return datetime.fromisoformat(self.origin) + timedelta(seconds=slot * self.step_seconds)

    def seconds(self, slot):
        """Whole seconds from 1970 to the start of a slot, for numbers and arrays."""
        return (datetime.fromisoformat(self.origin) - datetime(1970, 1, 1)) // timedelta(seconds=1) + slot * self.step_seconds

    def slot(self, ts: Column) -> Column:
        """Slot that contains ``ts`` (floor)."""
        seconds = F.timestamp_diff("SECOND", self.origin_col, ts)
        return F.floor(seconds / F.lit(self.step_seconds)).cast("bigint")

    def on_grid(self, ts: Column) -> Column:
        """True where ``ts`` is exactly a slot start."""
        micros = F.timestamp_diff("MICROSECOND", self.origin_col, ts)
        return micros % F.lit(self.step_seconds * 1_000_000) == 0

    def time(self, slot: Column) -> Column:
        """Start time of a slot."""
        return F.timestamp_add("SECOND", slot * F.lit(self.step_seconds), self.origin_col)

    def offset(self, ts: Column, steps: Column) -> Column:
        """``ts`` moved by a number of slots."""
        return F.timestamp_add("SECOND", steps * F.lit(self.step_seconds), ts)
