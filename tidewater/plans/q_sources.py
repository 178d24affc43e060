"""Registered queries: parsing, filters, incremental landing, manifests, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.sources import files as src
from tidewater.sources import incremental as inc
from tidewater.plans import inputs
from tidewater.plans.registry import finish, register
from tidewater.session import read_table


@register("json_extract_agg", """
SELECT event_type, count(*) AS n, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k, avg(CAST(k AS DOUBLE)) AS avg_k, max(k) AS max_k
FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
GROUP BY 1""", dbl="avg_k")
def q_json_extract_agg(spark, sf):
    e = read_table(spark, sf, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return finish(e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("k").alias("n_k"), F.sum("k").alias("sum_k"),
        F.avg(F.col("k").cast("double")).alias("avg_k"), F.max("k").alias("max_k")))


CODES = ["error", "purchase"]
USERS = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]


@register("code_set_filter", f"""
SELECT CAST(ts AS DATE) AS date, count(*) AS n_events, sum(value) AS value_sum FROM events
WHERE event_type IN ({", ".join(repr(c) for c in CODES)}) OR user_id IN ({", ".join(map(str, USERS))})
GROUP BY 1""", dbl="value_sum")
def q_code_set_filter(spark, sf):
    e = read_table(spark, sf, "events")
    f = e.where(src.code_set_filter(e, ["event_type"], CODES) | src.code_set_filter(e, ["user_id"], USERS))
    return finish(f.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n_events"),
                                                                F.sum("value").alias("value_sum")))


@register("incremental_anti_join", """
WITH processed AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'),
pending AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events
            WHERE CAST(ts AS DATE) NOT IN (SELECT date FROM processed))
SELECT CAST(ts AS DATE) AS date, count(*) AS n_events, sum(value) AS severity_sum
FROM events WHERE CAST(ts AS DATE) IN (SELECT date FROM pending) GROUP BY 1""", dbl="severity_sum")
def q_incremental_anti_join(spark, sf):
    ev = inputs.event_log(spark, sf)
    processed = ev.where(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("date")
    new = inc.land_increment(ev, processed, "date")
    return finish(new.groupBy("date").agg(F.count(F.lit(1)).alias("n_events"), F.sum("severity").alias("severity_sum")))


@register("manifest_check", """
SELECT md5(text) AS content_hash, count(*) AS n_docs, min(doc_id) AS first_doc_id, CAST(sum(n_chars) AS BIGINT) AS total_chars
FROM documents GROUP BY 1""")
def q_manifest_check(spark, sf):
    d = read_table(spark, sf, "documents")
    m = src.content_manifest(d, "doc_id", "text", carry=["n_chars"])
    return m.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc_id"),
                                         F.sum("n_chars").alias("total_chars"))


@register("dataset_summary", """
SELECT 'orders' AS dataset, count(*) AS rows, 6 AS cols, CAST(min(o_orderdate) AS DATE) AS start,
       CAST(max(o_orderdate) AS DATE) AS "end" FROM orders
UNION ALL
SELECT 'lineitem', count(*), 11, CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE) FROM lineitem
UNION ALL
SELECT 'events', count(*), 6, CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM events""")
def q_dataset_summary(spark, sf):
    return src.dataset_summary({
        "orders": (read_table(spark, sf, "orders"), "o_orderdate"),
        "lineitem": (read_table(spark, sf, "lineitem"), "l_shipdate"),
        "events": (read_table(spark, sf, "events"), "ts")})
