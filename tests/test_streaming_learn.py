"""Streaming operators on a folder of parquet files, and model bundles."""

import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.scalar import extract_timestamp_text
from tidewater.operators import learn as ln
from tidewater.streaming import ingest


def _events(spark, folder):
    rows = [(1, "2024-01-05 10:00:00", "a", 1.0), (2, "2024-01-06 09:00:00", "a", 2.0),
            (3, "2024-01-08 11:00:00", "a", 4.0), (3, "2024-01-08 11:00:00", "a", 4.0),
            (4, "2024-01-08 12:00:00", "b", None), (5, "2024-01-09 12:00:00", "b", 5.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, k string, v double") \
        .withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    df.write.mode("overwrite").parquet(folder)
    return df.schema


def test_daily_aggregate_dedup_and_roll(spark):
    d = tempfile.mkdtemp(prefix="tw-st-")
    schema = _events(spark, os.path.join(d, "in"))
    s = ingest.file_stream(spark, os.path.join(d, "in"), schema)
    agg = ingest.daily_aggregate(s, ["k"], "v", dedup_on=["event_id"], roll_weekends=True)
    sink, ck = ingest.scratch_paths(spark, "t1")
    ingest.run_available_now(agg, sink, ck)
    out = {(str(r["event_day"])[:10], r["k"]): (r["n"], r["value_sum"])
           for r in ingest.latest_versions(spark, sink, ["event_day", "k"]).collect()}
    # Sat and Mon events of key a land on Monday; the duplicate event 3 counts once; Friday stays
    assert out[("2024-01-05", "a")] == (1, 1.0)
    assert out[("2024-01-08", "a")] == (2, 6.0)
    assert out[("2024-01-08", "b")] == (1, None)


def test_sliding_sum(spark):
    d = tempfile.mkdtemp(prefix="tw-st-")
    schema = _events(spark, os.path.join(d, "in"))
    s = ingest.file_stream(spark, os.path.join(d, "in"), schema)
    agg = ingest.sliding_sum(s, ["k"], "v", size="7 days", slide="1 day")
    sink, ck = ingest.scratch_paths(spark, "t2")
    ingest.run_available_now(agg.select(F.col("window.start").alias("start"), "k", "value_sum"), sink, ck)
    res = ingest.latest_versions(spark, sink, ["start", "k"])
    r = res.where((F.col("k") == "a") & (F.col("start") == F.lit("2024-01-08").cast("timestamp"))).first()
    assert r["value_sum"] == 8.0  # events 3 (twice, no dedup here) within [01-08, 01-15)


def test_forward_fill_state(spark):
    d = tempfile.mkdtemp(prefix="tw-st-")
    schema = _events(spark, os.path.join(d, "in"))
    s = ingest.file_stream(spark, os.path.join(d, "in"), schema)
    ff = ingest.forward_fill_state(s, "k", "ts", "v")
    sink, ck = os.path.join(d, "ff"), os.path.join(d, "ffck")
    q = (ff.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.read.parquet(sink).where("k = 'b'").orderBy("ts").collect()
    assert [r["v_filled"] for r in got] == [None, 5.0]


def test_availability_join(spark):
    d = tempfile.mkdtemp(prefix="tw-st-")
    schema = _events(spark, os.path.join(d, "in"))
    s = ingest.file_stream(spark, os.path.join(d, "in"), schema)
    static = spark.createDataFrame([("2024-01-07", 9.0)], "available_at string, feat double") \
        .withColumn("available_at", F.to_date("available_at"))
    j = ingest.availability_join(s, static, "ts", "available_at")
    sink, ck = os.path.join(d, "aj"), os.path.join(d, "ajck")
    q = (j.writeStream.outputMode("append").format("parquet").option("path", sink)
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r["event_id"]: r["feat"] for r in spark.read.parquet(sink).collect()}
    assert got[1] is None and got[5] == 9.0


def test_bundle_roundtrip_and_batch_scoring(spark):
    rng = pd.Series(range(200))
    df = spark.createDataFrame([(float(i % 7), float((i * 3) % 11), int(i % 7 > 3)) for i in rng],
                               "a double, b double, y int")
    m = ln.fit_model(df, ["a", "b"], "y", "logreg")
    d = tempfile.mkdtemp(prefix="tw-ml-")
    ln.save_bundle(m, d, {"features": ["a", "b"], "threshold": 0.42})
    m2, meta = ln.load_bundle(d)
    assert meta["threshold"] == 0.42
    p1 = [r["proba_up"] for r in ln.predict_proba(m, df, "logreg").collect()]
    p2 = [r["proba_up"] for r in ln.predict_proba(m2, df, "logreg").collect()]
    assert p1 == pytest.approx(p2)


def test_timestamp_extraction(spark):
    df = spark.createDataFrame([("built 2024-05-01 12:30:00 UTC",), ("no date here",)], "t string")
    got = [r[0] for r in df.select(extract_timestamp_text("t")).collect()]
    assert got == ["2024-05-01 12:30:00", None]
