"""Registered queries: panel building, calendar alignment, fills, as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import calendar as cal
from tidewater.plans import inputs
from tidewater.plans.registry import MONTHLY, PANEL, WEEKLY, finish, register, with_


@register("daily_panel", with_(PANEL) + "SELECT * FROM panel", dbl="close")
def q_daily_panel(spark, sf):
    return finish(inputs.daily_panel(spark, sf))


CAL_SQL = PANEL + """,
bounds AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1),
cal AS (SELECT * FROM (
          SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds)
        WHERE isodow(date) <= 5),
aligned AS (
  SELECT c.series_id, c.date, p.close, p.n_orders, CASE WHEN p.date IS NULL THEN 1 ELSE 0 END AS is_gap
  FROM cal c LEFT JOIN panel p ON c.series_id = p.series_id AND c.date = p.date)"""


def aligned_panel(spark, sf):
    return cal.align_to_calendar(inputs.daily_panel(spark, sf), "series_id", "date")


@register("calendar_align", with_(CAL_SQL) + "SELECT * FROM aligned", dbl="close")
def q_calendar_align(spark, sf):
    return finish(aligned_panel(spark, sf))


FFILL_SQL = CAL_SQL + """,
filled AS (
  SELECT series_id, date,
         last_value(close IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date
                                              ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close,
         coalesce(n_orders, 0) AS n_orders,
         CAST(close IS NULL AS INTEGER) AS close_imputed, is_gap
  FROM aligned)"""


def filled_panel(spark, sf, limit: int = 3):
    a = aligned_panel(spark, sf)
    a = cal.imputed_flags(a, ["close"])
    a = cal.ffill(a, ["close"], "series_id", "date", limit=limit)
    return cal.fill_constant(a, ["n_orders"], 0).select(
        "series_id", "date", "close", "n_orders", "close_imputed", "is_gap")


@register("ffill_limit", with_(FFILL_SQL) + "SELECT * FROM filled", dbl="close")
def q_ffill_limit(spark, sf):
    return finish(filled_panel(spark, sf))


@register("asof_join", with_(PANEL, WEEKLY) + """
SELECT p.series_id, p.date, p.close, w.qty, w.week AS supply_week
FROM panel p ASOF LEFT JOIN weekly w ON p.date >= w.week""", dbl="close qty")
def q_asof_join(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date", "close")
    wk = inputs.weekly_supply(spark, sf)
    return finish(cal.asof_join(p, wk, "date", "week", ["qty"], by=(), bucket="month",
                                matched_col="supply_week"))


@register("asof_release_lag", with_(PANEL, MONTHLY) + """
SELECT series_id, date, close,
       CASE WHEN date - available_at <= 62 THEN level END AS level,
       CASE WHEN date - available_at <= 62 THEN available_at END AS released_at
FROM panel p ASOF LEFT JOIN monthly m ON p.date >= m.available_at""", dbl="close level")
def q_asof_release_lag(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date", "close")
    m = inputs.monthly_macro(spark, sf)
    return finish(cal.asof_join(p, m, "date", "available_at", ["level"], tolerance_days=62,
                                bucket="month", matched_col="released_at"))


ROLL_SQL = """
daily AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, sum(value) AS s FROM events GROUP BY 1),
rolled AS (
  SELECT 'reference' AS mode,
         CASE isodow(d) WHEN 5 THEN d + 3 WHEN 6 THEN d + 2 WHEN 7 THEN d + 1 ELSE d END AS date, n, s FROM daily
  UNION ALL
  SELECT 'friday_trading' AS mode,
         CASE isodow(d) WHEN 6 THEN d + 2 WHEN 7 THEN d + 1 ELSE d END AS date, n, s FROM daily)"""


@register("weekend_roll", with_(ROLL_SQL) + """
SELECT mode, date, CAST(sum(n) AS BIGINT) AS n_events, sum(s) AS severity_sum FROM rolled GROUP BY 1, 2""", dbl="severity_sum")
def q_weekend_roll(spark, sf):
    ev = inputs.event_log(spark, sf)
    # pre-aggregate per day first (map-side combine), then move and re-aggregate
    daily = ev.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("severity").alias("s"))
    out = None
    for mode, fri in (("reference", False), ("friday_trading", True)):
        part = daily.select(F.lit(mode).alias("mode"), cal.roll_to_trading_day("date", fri).alias("date"), "n", "s")
        out = part if out is None else out.unionByName(part)
    return finish(out.groupBy("mode", "date").agg(F.sum("n").alias("n_events"), F.sum("s").alias("severity_sum")))


@register("event_daily_agg", """
WITH daily AS (
  SELECT CAST(ts AS DATE) AS date, count(*) AS n_events,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS severity_mean,
         sum(value) AS severity_sum, count(DISTINCT user_id) AS n_users
  FROM events GROUP BY 1),
cal AS (SELECT * FROM (
          SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily)
        WHERE isodow(date) <= 5)
SELECT c.date, d.n_events, d.severity_mean, d.severity_sum, d.n_users
FROM cal c LEFT JOIN daily d USING (date)""", dbl="severity_mean severity_sum")
def q_event_daily_agg(spark, sf):
    ev = inputs.event_log(spark, sf)
    # mean from an exact integer-cent sum: identical doubles in every engine
    cents = F.sum(F.round(F.col("severity") * 100).cast("long")).cast("double")
    daily = ev.groupBy("date").agg(F.count(F.lit(1)).alias("n_events"),
                                   (cents / F.count(F.lit(1)) / F.lit(100.0)).alias("severity_mean"),
                                   F.sum("severity").alias("severity_sum"),
                                   F.count_distinct("user_id").alias("n_users"))
    bounds = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date")) \
        .where(F.weekday("date") < 5)
    return finish(calendar.join(daily, "date", "left"))
