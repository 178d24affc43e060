"""Incremental ingest and stateful daily aggregates as streaming queries.

* ST01: a file source with ``Trigger.AvailableNow``; the checkpoint replaces
  the reference's "processed dates" bookkeeping (exactly-once progress).
* ST02/ST04: daily aggregates with a watermark; the event day itself is the
  watermarked column, so state for closed days is evicted and the day keys
  do not depend on the session time zone.
* ST03: ``dropDuplicatesWithinWatermark`` on the event id.
* ST05: sliding 7-day windows (``window(ts, "7 days", "1 day")``; windows
  are aligned to UTC, pin ``spark.sql.session.timeZone=UTC`` for local days).
* ST06: last-known value per key carried in state
  (``applyInPandasWithState``).
* ST07: stream–static join that only attaches features already available
  at event time.

Results are written with ``foreachBatch`` in update mode, each micro-batch's
changed rows into a folder of its own (``batch_id=N``), which a retried batch
replaces; readers keep the last version per key.  Sinks and checkpoints live under the session's shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators.calendar import roll_to_trading_day
from tidewater.session import checkpoint_dir, read_table

__all__ = [
    "file_stream", "table_stream", "with_event_day", "daily_aggregate", "sliding_sum", "run_available_now", "latest_versions",
    "forward_fill_state", "availability_join", "scratch_paths",
]


def scratch_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """(sink, checkpoint) folders for one run under the shared checkpoint dir."""
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")
    return os.path.join(base, "sink"), os.path.join(base, "checkpoint")


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """ST01: streaming file source with an explicit schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """ST01: the files of a table as a stream, whether ``name``.parquet is one file or a folder of part files.

    A file source lists folders only, so a single file is found by its name in ``sf_dir``."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    schema = read_table(spark, sf_dir, name).schema
    return file_stream(spark, path, schema) if folder else file_stream(spark, sf_dir, schema, glob=f"{name}.parquet")


def with_event_day(stream: DataFrame, ts: str = "ts", roll_weekends: bool = False,
                   friday_is_trading: bool = True, out: str = "event_day") -> DataFrame:
    """Event time (TIMESTAMP) truncated to the day; optional weekend roll (ST04)."""
    t = F.col(ts).cast("timestamp")
    day = F.date_trunc("day", t)
    if roll_weekends:
        day = F.date_trunc("day", F.to_timestamp(roll_to_trading_day(F.to_date(day), friday_is_trading)))
    return stream.withColumn(out, day)


def daily_aggregate(stream: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", delay: str = "1 day",
                    dedup_on: Sequence[str] | None = None, roll_weekends: bool = False) -> DataFrame:
    """ST02/ST03/ST04: per (day, keys) count and sum of ``value`` with late
    data accepted up to ``delay`` after the day closes."""
    s = with_event_day(stream, ts, roll_weekends).withWatermark("event_day", delay)
    if dedup_on:
        s = s.dropDuplicatesWithinWatermark(list(dedup_on))
    return s.groupBy("event_day", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value_sum"))


def sliding_sum(stream: DataFrame, keys: Sequence[str], value: str, ts: str = "ts", size: str = "7 days",
                slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """ST05: sliding-window sum per key."""
    s = stream.withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", delay)
    return s.groupBy(F.window("__et", size, slide).alias("window"), *keys).agg(F.sum(value).alias("value_sum"))


def run_available_now(agg: DataFrame, sink: str, checkpoint: str, mode: str = "update", state_store: str | None = None) -> None:
    """Run a streaming query to completion over the data available now, however long it takes.

    A batch that is run again after a failure overwrites what its first run wrote.  ``state_store`` names the
    state store provider of this query."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    conf, name = agg.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if state_store:
        conf.set(name, state_store)
    try:
        q = (agg.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        conf.set(name, before)
    if q.exception() is not None:
        raise q.exception()


def latest_versions(spark: SparkSession, sink: str, keys: Sequence[str]) -> DataFrame:
    """Last written version of every key in an update-mode sink."""
    d = spark.read.parquet(sink)
    cols = [c for c in d.columns if c not in keys and c != "batch_id"]
    best = d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("__v"))
    return best.select(*keys, *[F.col("__v").getField(c).alias(c) for c in cols])


def forward_fill_state(stream: DataFrame, key: str, ts: str, value: str, timeout: str = "7 days") -> DataFrame:
    """ST06: emit every event with ``value`` forward-filled from the last
    non-null value of its key at or before its time.

    State is that value and its time.  All rows of a key in a micro-batch are
    ordered together with the state's row (a key may come in several Arrow
    batches), so a late row is filled from earlier rows only."""
    out_schema = f"{key} {stream.schema[key].dataType.simpleString()}, {ts} timestamp, {value} double, " \
                 f"{value}_filled double"
    state_schema = "at timestamp, last double"

    def fn(k, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([p[[key, ts, value]] for p in pdfs], ignore_index=True)
        rows[value] = rows[value].astype("float64")
        rows["__own"] = True
        if state.exists:
            at, last = state.get
            rows = pd.concat([pd.DataFrame({key: rows[key].iloc[:1], ts: [pd.Timestamp(at)], value: [last], "__own": False}), rows],
                             ignore_index=True)
        rows = rows.sort_values(ts, kind="stable", ignore_index=True)
        rows[f"{value}_filled"] = rows[value].ffill()
        known = rows[rows[value].notna()]
        if len(known):
            state.update((known[ts].iloc[-1].to_pydatetime(), float(known[value].iloc[-1])))
        yield rows.loc[rows["__own"].astype(bool), [key, ts, value, f"{value}_filled"]]

    s = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return s.groupBy(key).applyInPandasWithState(fn, out_schema, state_schema, "append",
                                                 GroupStateTimeout.NoTimeout)


def availability_join(stream: DataFrame, static: DataFrame, ts: str, available_at: str,
                      on: Sequence[str] = ()) -> DataFrame:
    """ST07: attach to every event the latest static row of its key that is already
    released at event time (``available_at <= event day``), or NULLs.

    The versions of a key become one row (a sorted array), so the join is an
    equi-join that never multiplies events; without keys the array is a scalar."""
    on = list(on)
    values = [c for c in static.columns if c not in on]
    version = F.struct(F.col(available_at).alias("__at"), F.struct(*[F.col(c) for c in values]).alias("__row"))
    packed = F.array_sort(F.collect_list(version)).alias("__versions")
    known = static.where(F.col(available_at).isNotNull())
    day = F.to_date(F.col(ts))
    if on:
        keyed = known.groupBy(*[F.col(k).alias(f"__{k}") for k in on]).agg(packed)
        cond = F.lit(True)
        for k in on:
            cond = cond & (F.col(k) == F.col(f"__{k}"))
        s = stream.join(keyed, cond, "left").drop(*[f"__{k}" for k in on])
    else:
        s = stream.withColumn("__versions", known.agg(packed).scalar())
    released = F.filter("__versions", lambda v: v["__at"].cast("date") <= day)
    s = s.withColumn("__row", F.try_element_at(released, F.lit(-1))["__row"])
    return s.select(*[c for c in s.columns if not c.startswith("__")], *[F.col("__row")[c].alias(c) for c in values])
