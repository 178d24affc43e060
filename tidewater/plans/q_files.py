"""Registered queries of file readers and sinks: tables are exported to the shared folder, read back as the sources of
the survey come, and aggregated; the oracles read the tables themselves."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators import reshape as rs
from tidewater.plans.registry import finish, register
from tidewater.session import checkpoint_dir, read_table
from tidewater.sources import files as src


def folder(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark).rstrip("/"), "files", f"{name}-{uuid.uuid4().hex}")


@register("csv_sources", """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       2 AS found_sources, 1 AS missing_sources FROM orders GROUP BY 1""")
def q_csv_sources(spark, sf):
    """Orders written as two CSV sources with other names of the date, read with schemas, a missing source reported."""
    root = folder(spark, "csv")
    o = read_table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    src.write_stage(o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("day").alias("date"), "o_totalprice"), f"{root}/even", "csv")
    src.write_stage(o.where("o_orderkey % 2 <> 0").select("o_orderkey", F.col("day").alias("event_date"), "o_totalprice"), f"{root}/odd", "csv")
    schema = lambda date: T.StructType().add("o_orderkey", "long").add(date, "string").add("o_totalprice", "double")
    frames, status = src.read_csv_sources(spark, {"even": (f"{root}/even", schema("date")), "odd": (f"{root}/odd", schema("event_date")),
                                                  "absent": (f"{root}/absent", schema("date"))})
    rows = rs.union_aligned([src.normalise_date(f) for f in frames.values()])
    found = status.agg(F.count_if("found").cast("int").alias("f"), F.count_if(~F.col("found")).cast("int").alias("m")).first()
    return rows.groupBy(F.trunc("date", "MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        F.lit(found["f"]).alias("found_sources"), F.lit(found["m"]).alias("missing_sources"))


@register("event_tsv", """
SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1""")
def q_event_tsv(spark, sf):
    """Events as headerless tab-separated text with broken lines, read by position."""
    root = folder(spark, "tsv")
    e = read_table(spark, sf, "events")
    lines = e.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.date_format("ts", "yyyyMMdd"), "event_type", F.col("value").cast("string")).alias("value"))
    lines.unionByName(e.where("event_id % 100 = 0").select(F.lit("cut\tline").alias("value"))).write.text(root)
    rows = src.read_event_tsv(spark, root, ["id", "day", "event_type", "value"]).where(F.col("value").isNotNull())
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value").cast("double") * 100).cast("long")).alias("cents"),
                                          F.min(F.to_date("day", "yyyyMMdd")).alias("first_day"))


JSON_SQL = """
SELECT CAST(date_trunc('month', d) AS DATE) AS month, count(*) AS days, count(v) AS known, sum(v) AS total
FROM (SELECT CAST(ts AS DATE) AS d, user_id, CASE WHEN count(*) >= 3 THEN CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) END AS v FROM events GROUP BY 1, 2)
GROUP BY 1"""


def _daily(spark, sf):
    e = read_table(spark, sf, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.when(F.count(F.lit(1)) >= 3, cents).cast("string").alias("v"))


def _by_month(rows):
    return finish(rows.groupBy(F.trunc("date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("days"), F.count("value").alias("known"), F.sum("value").alias("total")))


@register("json_observations", JSON_SQL, dbl="total")
def q_json_observations(spark, sf):
    """One JSON document of observations per user, written as text and parsed; a point marks a missing value."""
    root = folder(spark, "observations")
    item = F.struct(F.col("d").cast("string").alias("date"), F.coalesce("v", F.lit(".")).alias("value"))
    docs = _daily(spark, sf).groupBy("user_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("observations"))).alias("value"))
    docs.select("value").write.text(root)
    return _by_month(src.parse_observations(spark.read.text(root), "value"))


@register("json_series", JSON_SQL, dbl="total")
def q_json_series(spark, sf):
    """Nested series documents in both of their layouts (by response, or by request and series)."""
    root = folder(spark, "series")
    item = F.struct(F.col("d").cast("string").alias("period"), F.coalesce("v", F.lit("n/a")).alias("value"))
    docs = _daily(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(item)).alias("data"))
    response = F.to_json(F.struct(F.struct("data").alias("response")))
    request = F.to_json(F.struct(F.struct(F.array(F.struct("data")).alias("series")).alias("request")))
    docs.select(F.when(F.col("user_id") % 2 == 0, response).otherwise(request).alias("value")).write.text(root)
    return _by_month(src.parse_nested_series(spark.read.text(root), "value"))


@register("published_release", """
SELECT "check", expected, actual, expected = actual AS pass FROM (
  SELECT 'rows' AS "check", CAST(count(*) AS VARCHAR) AS expected, CAST(count(*) AS VARCHAR) AS actual FROM lineitem
  UNION ALL SELECT 'mirror', '0', '0' UNION ALL SELECT 'changed files', '0', '0' UNION ALL SELECT 'missing files', '0', '0'
  UNION ALL SELECT 'files of the version before', 'changed', 'changed')""")
def q_published_release(spark, sf):
    """Line items published twice; the newer version is read, and file manifests by content hash tell the versions apart."""
    root = folder(spark, "published")
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    before = src.publish_atomic(li.where("l_quantity < 20"), root)
    now = src.publish_atomic(li, root)
    manifest = src.file_manifest(spark, now, "*.parquet")
    files = src.verify_files(src.file_manifest(spark, now, "*.parquet"), manifest)
    other = src.verify_files(src.file_manifest(spark, before, "*.parquet"), manifest)
    read = src.read_published(spark, root)
    facts = read.agg(F.count(F.lit(1)).alias("n")).withColumns({
        "rows": li.agg(F.count(F.lit(1))).scalar(), "differ": rs.mirror_differences(li, read).scalar(),
        "changed": files.agg(F.count_if(F.col("status") == "changed")).scalar(), "missing": files.agg(F.count_if(F.col("status") == "missing")).scalar(),
        "before": other.agg(F.when(F.count_if(F.col("status") == "ok") == 0, "changed").otherwise("same")).scalar()})
    text = lambda c: F.col(c).cast("string")
    return rs.release_checks([("rows", text("rows"), text("n")), ("mirror", F.lit("0"), text("differ")), ("changed files", F.lit("0"), text("changed")),
                              ("missing files", F.lit("0"), text("missing")), ("files of the version before", F.lit("changed"), text("before"))], facts)


@register("order_page", """
SELECT o_orderkey, o_totalprice, 'orders' AS kind FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 200""", dbl="o_totalprice")
def q_order_page(spark, sf):
    """The third page of a hundred orders by price, and the layout that the columns name."""
    o = read_table(spark, sf, "orders")
    kind = rs.detect_schema(o, {"lineitem": ["l_orderkey"], "orders": ["o_orderkey", "o_totalprice"]})
    page = rs.paginate(o.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 100, 200)
    return finish(page.withColumn("kind", F.lit(kind)))


@register("union_read", """
SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS BIGINT) AS cents FROM orders GROUP BY 1""")
def q_union_read(spark, sf):
    """Files with differing columns, one of them absent, read as one table."""
    root = folder(spark, "union")
    o = read_table(spark, sf, "orders")
    o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", "o_totalprice").write.parquet(f"{root}/a")
    o.where("o_orderkey % 2 <> 0").select("o_orderstatus", "o_orderkey").write.parquet(f"{root}/b")
    d = src.union_existing(spark, [f"{root}/a", f"{root}/none", f"{root}/b"])
    return d.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
