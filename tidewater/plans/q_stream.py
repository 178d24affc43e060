"""Registered query: the daily event aggregate computed by a streaming job."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.plans.registry import finish, register
from tidewater.streaming import ingest


@register("stream_daily_agg", """
SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, sum(value) AS value_sum
FROM events GROUP BY 1, 2""", dbl="value_sum")
def q_stream_daily_agg(spark, sf):
    """ST01-ST03: events landed with AvailableNow, de-duplicated within the
    watermark, aggregated per day and type; the update-mode sink is read back
    keeping the last version per key."""
    stream = ingest.table_stream(spark, sf, "events")
    agg = ingest.daily_aggregate(stream, ["event_type"], "value", dedup_on=["event_id"])
    sink, ck = ingest.scratch_paths(spark, "daily_events")
    ingest.run_available_now(agg, sink, ck)
    out = ingest.latest_versions(spark, sink, ["event_day", "event_type"])
    return finish(out.select(F.to_date("event_day").alias("date"), "event_type", "n", "value_sum"))
