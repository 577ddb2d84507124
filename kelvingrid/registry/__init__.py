"""Registered queries on the given tables, each with a SQL twin where SQL can say it."""

from kelvingrid.registry import (  # noqa: F401
    climate_queries,
    evaluation_queries,
    forecast_queries,
    grid_queries,
    ingest_queries,
    model_queries,
    profile_queries,
    stream_queries,
    window_queries,
)
from kelvingrid.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
