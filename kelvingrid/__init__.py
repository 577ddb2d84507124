"""Gridded time-series analytics and recursive forecasting on Spark DataFrames.

The working table everywhere is ``obs``: one row per (pixel_id, slot) with a
double ``v``.  A *slot* is the integer position of a timestamp on a uniform
:class:`~kelvingrid.functions.timeaxis.TimeAxis`; a missing row or a null ``v``
is a gap.
"""

from kelvingrid.functions.timeaxis import TimeAxis
from kelvingrid.session import get_session, scratch_path

__all__ = ["TimeAxis", "get_session", "scratch_path"]
