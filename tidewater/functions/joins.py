"""Joins on group keys that keep the NULL group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` where every key is equal or both are NULL; the keys appear once.

    Without keys both sides are one group: ``right`` must then be a single row, and its columns are
    attached as scalar subqueries (no constant-key or nested-loop join)."""
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    if not keys:
        return left.withColumns({c: right.select(c).scalar() for c in rest})
    other = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *rest)
    on = [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    return left.join(other, on, how).drop(*[f"__right_{k}" for k in keys])
