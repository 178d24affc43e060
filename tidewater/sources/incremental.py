"""Incremental landing (survey S09, J10, J11).

Progress is data, not driver state: the already-landed keys are read back
from the output and new work is the anti join of the candidates against
them (or everything after the output's max date, the watermark variant).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["pending_keys", "after_watermark", "land_increment"]


def pending_keys(candidates: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate keys not yet processed (left anti join)."""
    return candidates.select(*keys).distinct().join(processed.select(*keys).distinct(), list(keys), "left_anti")


def after_watermark(candidates: DataFrame, existing: DataFrame, date: str) -> DataFrame:
    """S09 variant: rows strictly after max(date) of the existing output
    (everything when the output is empty).  The max is a one-row aggregate
    joined back, not a driver value."""
    j = candidates.withColumn("__wm", existing.agg(F.max(date)).scalar())
    return j.where(F.col("__wm").isNull() | (F.col(date) > F.col("__wm"))).drop("__wm")


def land_increment(source: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Source rows whose key is not processed yet (semi join on the pending set)."""
    todo = pending_keys(source, processed, [key])
    return source.join(todo, key, "left_semi")
