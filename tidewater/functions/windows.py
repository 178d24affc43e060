"""Window-spec helpers with pandas-compatible ``min_periods`` semantics.

pandas ``rolling(n)`` covers the last ``n`` rows including the current one
and yields NULL unless at least ``min_periods`` non-null values are in the
frame.  ``rolling`` reproduces that with a ROWS frame and a ``count`` guard.
All windows partition by the series key, so each task holds whole series;
a daily panel has at most one row per business day per series, which bounds
the per-partition sort by the calendar length rather than by data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

__all__ = ["series_window", "rolling", "expanding", "lag", "lead"]


def series_window(keys="series_id", order="date") -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else list(keys)
    orders = [order] if isinstance(order, str) else list(order)
    if keys:
        return Window.partitionBy(*keys).orderBy(*orders)
    return Window.orderBy(*orders)


def rolling(agg, x, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    """Aggregate ``agg`` (a function Column → Column) over the last ``n`` rows."""
    mp = n if min_periods is None else min_periods
    x = F.col(x) if isinstance(x, str) else x
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= mp, agg(x).over(frame))


def expanding(agg, x, w: WindowSpec, min_periods: int = 1) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(x).over(frame) >= min_periods, agg(x).over(frame))


def lag(x, k: int, w: WindowSpec, default=None) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.lag(x, k, default).over(w)


def lead(x, k: int, w: WindowSpec) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.lead(x, k).over(w)
