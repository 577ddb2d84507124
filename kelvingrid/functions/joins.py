"""Join helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys appear once."""
    renamed = right.select(*[F.col(c).alias(f"_k_{c}" if c in keys else c) for c in right.columns])
    cond = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = same if cond is None else cond & same
    return left.join(renamed, cond, how).drop(*[f"_k_{k}" for k in keys])
