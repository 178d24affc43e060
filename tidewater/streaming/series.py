"""Ordered per-key state in a stream (survey ST06): last value and exponential mean, late rows included.

Each key keeps what its closed rows (older than the watermark) come to, and its open rows one by one.  A row
that arrives late, but within the watermark's delay, takes its place among the open rows; results
from there on are put out again, so the last version of every row equals the batch result.  A
timer in event time removes a key's state when the watermark has passed its last row by ``keep``.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

__all__ = ["STATE_STORE", "series_state"]

#: State store that keyed state with timers needs; pass it to ``run_available_now``.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Series(StatefulProcessor):
    """Closed rows as one value, open rows as a list in the order (time, id)."""

    def __init__(self, key: str, ident: str, value: str, id_type: str, alpha: float, keep_ms: int):
        self.key, self.ident, self.value, self.id_type, self.alpha, self.keep_ms = key, ident, value, id_type, alpha, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "mean double, last double")
        self.open = handle.getListState("open", f"at long, id {self.id_type}, x double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        old = [tuple(r) for r in self.open.get()]
        merged = [(r[0], r[1], None if pd.isna(r[2]) else float(r[2]), False) for r in old]
        merged += [(int(a), i, None if pd.isna(x) else float(x), True) for a, i, x in zip(new["tw_at"], new[self.ident], new[self.value])]
        merged.sort(key=lambda r: (r[0], r[1]))
        first = next(n for n, r in enumerate(merged) if r[3])
        mean, last = self.closed.get() if self.closed.exists() else (None, None)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        left, out, state = [], [], (mean, last)
        for n, (at, ident, x, _) in enumerate(merged):
            if x is not None:
                mean = x if mean is None or pd.isna(mean) else self.alpha * x + (1 - self.alpha) * mean
                last = x
            if n >= first:
                out.append((key[0], ident, at, x, None if x is None else mean, last))
            if at < watermark:
                state = (mean, last)  # no row can come before it any more
            else:
                left.append((at, ident, x))
        self.closed.update(state)
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(merged[-1][0] // 1000 + self.keep_ms)
        yield pd.DataFrame(out, columns=[self.key, self.ident, "at", self.value, "ewm", "filled"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.closed.clear()
        self.open.clear()
        yield pd.DataFrame(columns=[self.key, self.ident, "at", self.value, "ewm", "filled"])

    def close(self) -> None:
        pass


def series_state(stream: DataFrame, key: str, ts: str, ident: str, value: str, alpha: float, delay: str = "1 day",
                 keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """(key, ident, at, value, ewm, filled) for every row: the exponential mean (``adjust=False``; a null value gets null and
    does not advance it) and the last non-null value of the key, in the order of (``ts``, ``ident``).  ``at`` is the
    time in microseconds.  A row may be put out several times; the last version (by micro-batch) counts.  Rows older
    than the watermark are dropped, as in every event-time operator; a key without rows for ``keep_ms`` starts anew."""
    types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    s = stream.select(key, F.col(ts).cast("timestamp").alias("tw_time"), ident, F.col(value).cast("double").alias(value))
    s = s.where(F.col("tw_time").isNotNull()).withColumn("tw_at", F.unix_micros("tw_time")).withWatermark("tw_time", delay)
    schema = f"{key} {types[key]}, {ident} {types[ident]}, at long, {value} double, ewm double, filled double"
    return s.groupBy(key).transformWithStateInPandas(
        _Series(key, ident, value, types[ident], float(alpha), int(keep_ms)), schema, "Update", "eventTime")
