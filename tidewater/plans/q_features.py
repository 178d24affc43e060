"""Registered queries: returns, rolling statistics, technical indicators,
targets, streaks, weights, folds, encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.scalar import log1p_clip, signed_log1p
from tidewater.functions.windows import series_window
from tidewater.operators import calendar as cal
from tidewater.operators import features as ft
from tidewater.plans import inputs
from tidewater.plans.registry import RETURNS, finish, register, with_

W = "PARTITION BY series_id ORDER BY date"


def _f(n: int) -> str:
    return f"(PARTITION BY series_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(agg: str, x: str, n: int, mp: int | None = None) -> str:
    mp = n if mp is None else mp
    return f"CASE WHEN count({x}) OVER {_f(n)} >= {mp} THEN {agg}({x}) OVER {_f(n)} END"


@register("returns", with_(RETURNS) + f"""
SELECT series_id, date, close, ret,
       close / lag(close, 5) OVER ({W}) - 1.0 AS ret5,
       close / lag(close, 10) OVER ({W}) - 1.0 AS ret10,
       close - lag(close, 1) OVER ({W}) AS diff1,
       close - lag(close, 7) OVER ({W}) AS diff7
FROM rp""", dbl="close ret ret5 ret10 diff1 diff7")
def q_returns(spark, sf):
    p = inputs.returns_panel(spark, sf)
    w = series_window("series_id", "date")
    p = ft.add_returns(p, "close", (5, 10), prefix="ret")
    p = p.withColumns({"diff1": ft.diff("close", 1, w), "diff7": ft.diff("close", 7, w)})
    return finish(p.select("series_id", "date", "close", "ret", "ret5", "ret10", "diff1", "diff7"))


@register("rolling_stats", with_(RETURNS) + f"""
SELECT series_id, date,
       {_roll('avg', 'ret', 7)} AS ret_mean7,
       {_roll('stddev_samp', 'ret', 7)} AS ret_std7,
       {_roll('stddev_pop', 'ret', 7, 1)} AS ret_std_pop7,
       CAST({_roll('sum', 'n_orders', 7)} AS BIGINT) AS n_orders_sum7,
       {_roll('avg', 'close', 20, 10)} AS close_mean20,
       {_roll('max', 'close', 30)} AS close_max30,
       CASE WHEN count(ret) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING
            AND CURRENT ROW) >= 5 THEN avg(ret) OVER (PARTITION BY series_id ORDER BY date
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS ret_exp_mean
FROM rp""", dbl="ret_mean7 ret_std7 ret_std_pop7 close_mean20 close_max30 ret_exp_mean")
def q_rolling_stats(spark, sf):
    p = inputs.returns_panel(spark, sf)
    w = series_window("series_id", "date")
    from tidewater.functions.windows import expanding
    p = ft.add_rolling(p, "ret", 7, ("mean", "std"))
    p = ft.add_rolling(p, "ret", 7, ("std_pop",), min_periods=1)
    p = ft.add_rolling(p, "n_orders", 7, ("sum",))
    p = ft.add_rolling(p, "close", 20, ("mean",), min_periods=10)
    p = ft.add_rolling(p, "close", 30, ("max",))
    p = p.withColumn("ret_exp_mean", expanding(F.avg, "ret", w, 5))
    return finish(p.select("series_id", "date", "ret_mean7", "ret_std7", F.col("ret_std_pop7"),
                           "n_orders_sum7", "close_mean20", "close_max30", "ret_exp_mean"))


@register("rolling_quantile_spike", with_(RETURNS) + f"""
SELECT series_id, date, x, q95, CAST(coalesce(x > q95, false) AS INTEGER) AS spike FROM (
  SELECT series_id, date, x,
         CASE WHEN count(x) OVER w >= 30 THEN quantile_cont(x, 0.95) OVER w END AS q95
  FROM (SELECT series_id, date, ln(1 + greatest(n_orders, 0)) AS x FROM rp)
  WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))
""", dbl="x q95")
def q_rolling_quantile_spike(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date", log1p_clip("n_orders").alias("x"))
    p = ft.rolling_quantile_flag(p, "x", 0.95, 90, 30, qcol="q95", flag="spike")
    return finish(p)


@register("zscore_fallback", with_(RETURNS) + f"""
SELECT series_id, date, close,
       coalesce(
         (close - {_roll('avg', 'close', 252, 30)}) / nullif({_roll('stddev_samp', 'close', 252, 30)}, 0),
         CASE WHEN count(close) OVER e >= 5
              THEN (close - avg(close) OVER e) / nullif(stddev_pop(close) OVER e, 0) END,
         0.0) AS close_z
FROM rp WINDOW e AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""", dbl="close close_z")
def q_zscore_fallback(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date", "close")
    return finish(ft.zscore_fallback(p, "close", "close_z", 252, 30, 5))


EWM_SQL = RETURNS + """,
seq AS (SELECT series_id, date, close, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn FROM rp),
ewm AS (
  SELECT series_id, rn, date, close AS e12, close AS e26, 0.0::DOUBLE AS sig FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.series_id, s.rn, s.date,
         (2.0::DOUBLE / 13.0::DOUBLE) * s.close + (1.0 - 2.0::DOUBLE / 13.0::DOUBLE) * e.e12,
         (2.0::DOUBLE / 27.0::DOUBLE) * s.close + (1.0 - 2.0::DOUBLE / 27.0::DOUBLE) * e.e26,
         (2.0::DOUBLE / 10.0::DOUBLE) *
           (((2.0::DOUBLE / 13.0::DOUBLE) * s.close + (1.0 - 2.0::DOUBLE / 13.0::DOUBLE) * e.e12)
          - ((2.0::DOUBLE / 27.0::DOUBLE) * s.close + (1.0 - 2.0::DOUBLE / 27.0::DOUBLE) * e.e26))
         + (1.0 - 2.0::DOUBLE / 10.0::DOUBLE) * e.sig
  FROM ewm e JOIN seq s ON s.series_id = e.series_id AND s.rn = e.rn + 1),
macd_raw AS (SELECT series_id, date, e12 - e26 AS m, sig FROM ewm)"""


@register("ewm_macd", "WITH RECURSIVE " + EWM_SQL + f"""
SELECT series_id, date,
       lag(m) OVER ({W}) AS macd, lag(sig) OVER ({W}) AS macd_signal,
       lag(m - sig) OVER ({W}) AS macd_hist, lag(CAST(m > sig AS DOUBLE)) OVER ({W}) AS macd_cross
FROM macd_raw""", dbl="macd macd_signal macd_hist macd_cross")
def q_ewm_macd(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date", "close")
    return finish(ft.macd(p, "close").select("series_id", "date", "macd", "macd_signal", "macd_hist", "macd_cross"))


@register("rsi", with_(RETURNS) + f"""
, d AS (SELECT series_id, date, close - lag(close) OVER ({W}) AS delta FROM rp),
g AS (SELECT series_id, date, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0.0) END AS gain,
             CASE WHEN delta IS NOT NULL THEN -least(delta, 0.0) END AS loss FROM d),
r AS (SELECT series_id, date,
             100.0 - 100.0 / (1.0 + ({_roll('avg', 'gain', 14)}) / (({_roll('avg', 'loss', 14)}) + 1e-10)) AS rsi
      FROM g)
SELECT series_id, date, lag(rsi) OVER ({W}) AS rsi_14 FROM r""", dbl="rsi_14")
def q_rsi(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date", "close")
    return finish(ft.rsi(p, "close").select("series_id", "date", "rsi_14"))


@register("bollinger", with_(RETURNS) + f"""
, b AS (SELECT series_id, date, close, {_roll('avg', 'close', 20)} AS sma, {_roll('stddev_samp', 'close', 20)} AS sd FROM rp),
s AS (SELECT series_id, date, lag(sma) OVER ({W}) AS sma, lag(sd) OVER ({W}) AS sd, lag(close) OVER ({W}) AS prev FROM b),
u AS (SELECT *, sma + 2.0 * sd AS bb_upper, sma - 2.0 * sd AS bb_lower FROM s)
SELECT series_id, date, bb_upper, bb_lower,
       (bb_upper - bb_lower) / (sma + 1e-10) AS bb_width,
       (prev - bb_lower) / (bb_upper - bb_lower + 1e-10) AS bb_position
FROM u""", dbl="bb_upper bb_lower bb_width bb_position")
def q_bollinger(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date", "close")
    return finish(ft.bollinger(p, "close").select("series_id", "date", "bb_upper", "bb_lower", "bb_width",
                                                  "bb_position"))


@register("lag_lead_target", with_(RETURNS) + f"""
SELECT * FROM (
  SELECT series_id, date, ret,
         lag(ret, 1) OVER ({W}) AS ret_lag1, lag(ret, 2) OVER ({W}) AS ret_lag2,
         lag(ret, 3) OVER ({W}) AS ret_lag3, lag(ret, 5) OVER ({W}) AS ret_lag5,
         lead(ret, 1) OVER ({W}) AS ret_fwd1, lead(date, 1) OVER ({W}) AS ret_fwd1_date
  FROM rp) WHERE ret_fwd1 IS NOT NULL""", dbl="ret ret_lag1 ret_lag2 ret_lag3 ret_lag5 ret_fwd1")
def q_lag_lead_target(spark, sf):
    p = inputs.returns_panel(spark, sf).select("series_id", "date", "ret")
    p = ft.add_lags(p, ["ret"], (1, 2, 3, 5))
    return finish(ft.add_forward_target(p, "ret"))


@register("streaks", with_(RETURNS) + f"""
, lab AS (SELECT series_id, date, CAST(ret > 0 AS INTEGER) AS direction FROM rp WHERE ret IS NOT NULL),
chg AS (SELECT *, CASE WHEN lag(direction) OVER ({W}) = direction THEN 0 ELSE 1 END AS c FROM lab),
runs AS (SELECT series_id, direction, sum(c) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id FROM chg),
len AS (SELECT series_id, run_id, min(direction) AS direction, count(*) AS length FROM runs GROUP BY 1, 2)
SELECT series_id, direction, count(*) AS n_runs, avg(length) AS mean_length, max(length) AS max_length,
       quantile_cont(length, 0.5) AS median_length
FROM len GROUP BY 1, 2""", dbl="mean_length median_length")
def q_streaks(spark, sf):
    p = inputs.returns_panel(spark, sf).where(F.col("ret").isNotNull())
    p = p.withColumn("direction", (F.col("ret") > 0).cast("int"))
    runs = ft.streak_runs(p, "direction")
    return finish(ft.streak_summary(runs, "direction", ["series_id"]))


@register("recency_weights", with_(RETURNS) + """
, r AS (SELECT series_id, date,
               CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS DOUBLE) AS i,
               CAST(count(*) OVER (PARTITION BY series_id) AS DOUBLE) AS n FROM rp),
raw AS (SELECT *, exp((-ln(2.0) / 250.0) * (n - 1.0 - i)) AS e,
               CASE WHEN n > 1 THEN 0.1 + 0.9 * i / (n - 1.0) ELSE 0.1 END AS l,
               CASE WHEN i >= floor(n * 0.5) THEN 2.0 ELSE 1.0 END AS s FROM r)
SELECT series_id, date, e / avg(e) OVER (PARTITION BY series_id) AS w_exp,
       l / avg(l) OVER (PARTITION BY series_id) AS w_linear,
       s / avg(s) OVER (PARTITION BY series_id) AS w_step
FROM raw""", dbl="w_exp w_linear w_step")
def q_recency_weights(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date")
    p = ft.recency_weight_set(p, {"w_exp": dict(scheme="exponential", half_life=250.0), "w_linear": dict(scheme="linear", min_weight=0.1),
                                  "w_step": dict(scheme="step", recent_ratio=0.5, recent_weight=2.0)})
    return finish(p)


@register("rolling_folds", with_(RETURNS) + """
, r AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS i,
               count(*) OVER (PARTITION BY series_id) AS n FROM rp),
f AS (SELECT r.*, fold, n - (5 - fold) * (n // 6) AS lo, n - (5 - fold) * (n // 6) + (n // 6) AS hi
      FROM r, range(0, 5) t(fold)),
g AS (SELECT series_id, date, CAST(fold AS INTEGER) AS fold,
             CASE WHEN i >= lo AND i < hi THEN 'test' WHEN i < lo THEN 'train' END AS role FROM f)
SELECT series_id, fold, role, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
FROM g WHERE role IS NOT NULL GROUP BY 1, 2, 3""")
def q_rolling_folds(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date")
    f = ft.rolling_origin_folds(p, 5)
    return finish(f.groupBy("series_id", "fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")))


@register("regime_codes", """
WITH m AS (
  SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
         CAST((2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 1024.0 / 100.0
           AS rate
  FROM orders GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date) = 1 THEN rate
                     ELSE lag(rate) OVER (PARTITION BY series_id ORDER BY date) END AS prev FROM m)
SELECT series_id, date, rate,
       CASE WHEN rate IS NULL OR rate - prev IS NULL THEN NULL
            WHEN rate < 0.5 THEN 0 WHEN rate - prev > 0.1 THEN 1
            WHEN rate > 3.0 AND abs(rate - prev) < 0.1 THEN 2 ELSE 3 END AS rate_regime
FROM p""", dbl="rate")
def q_regime_codes(spark, sf):
    from tidewater.session import read_table
    o = read_table(spark, sf, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("series_id"), F.trunc(F.to_date("o_orderdate"), "MM").alias("date")) \
        .agg((inputs._cents_avg("o_totalprice") / F.lit(100.0)).alias("rate"))
    return finish(ft.regime_series(m, "rate"))


@register("cyclical_encoding", with_(RETURNS) + """
SELECT series_id, date, CAST(year(date) AS INTEGER) AS year,
       sin(2 * pi() * CAST(isodow(date) - 1 AS DOUBLE) / 5.0) AS day_of_week_sin,
       cos(2 * pi() * CAST(isodow(date) - 1 AS DOUBLE) / 5.0) AS day_of_week_cos,
       sin(2 * pi() * CAST(month(date) - 1 AS DOUBLE) / 12.0) AS month_sin,
       cos(2 * pi() * CAST(month(date) - 1 AS DOUBLE) / 12.0) AS month_cos
FROM rp""", dbl="day_of_week_sin day_of_week_cos month_sin month_cos")
def q_cyclical_encoding(spark, sf):
    p = inputs.daily_panel(spark, sf).select("series_id", "date")
    return finish(ft.cyclical_calendar(p, "date"))


@register("signed_log", with_(RETURNS) + """
SELECT series_id, date, sign(ret) * ln(1 + abs(ret)) AS ret_slog1p,
       ln(1 + greatest(n_orders, 0)) AS n_orders_log1p
FROM rp""", dbl="ret_slog1p n_orders_log1p")
def q_signed_log(spark, sf):
    p = inputs.returns_panel(spark, sf)
    return finish(p.select("series_id", "date", signed_log1p("ret").alias("ret_slog1p"),
                           log1p_clip("n_orders").alias("n_orders_log1p")))


@register("rolling_corr", with_(RETURNS) + f"""
SELECT series_id, date,
       CASE WHEN count(CASE WHEN ret IS NOT NULL AND n_orders IS NOT NULL THEN 1 END) OVER {_f(90)} >= 90
            THEN corr(ret, n_orders) OVER {_f(90)} END AS corr_ret_orders_90
FROM rp""", dbl="corr_ret_orders_90")
def q_rolling_corr(spark, sf):
    p = inputs.returns_panel(spark, sf).withColumn("n_orders", F.col("n_orders").cast("double"))
    return finish(ft.rolling_corr(p, "ret", "n_orders", 90, "corr_ret_orders_90").select(
        "series_id", "date", "corr_ret_orders_90"))


@register("autocorrelation", with_(RETURNS) + """
, c AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn,
               ret - avg(ret) OVER (PARTITION BY series_id) AS c FROM rp WHERE ret IS NOT NULL),
den AS (SELECT series_id, sum(c * c) AS den FROM c GROUP BY 1),
num AS (SELECT a.series_id, k AS lag, sum(a.c * b.c) AS num
        FROM c a, range(1, 11) t(k), c b
        WHERE b.series_id = a.series_id AND b.rn = a.rn - k GROUP BY 1, 2)
SELECT num.series_id, CAST(lag AS INTEGER) AS lag, num / den AS acf FROM num JOIN den USING (series_id)""",
          dbl="acf")
def q_autocorrelation(spark, sf):
    p = inputs.returns_panel(spark, sf)
    return finish(ft.autocorrelation(p, "ret", 10))


PANEL_FEATURES_SQL = RETURNS + """,
bounds AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM panel GROUP BY 1),
cal AS (SELECT * FROM (
          SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bounds)
        WHERE isodow(date) <= 5),
al AS (SELECT c.series_id, c.date, p.close FROM cal c LEFT JOIN panel p USING (series_id, date)),
fi AS (SELECT series_id, date, CAST(close IS NULL AS INTEGER) AS close_imputed,
              last_value(close IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date
                                                   ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close FROM al),
r1 AS (SELECT *, close / lag(close) OVER (PARTITION BY series_id ORDER BY date) - 1.0 AS ret FROM fi),
r2 AS (SELECT *, """ + _roll('avg', 'ret', 7) + """ AS ret_mean7, """ + _roll('stddev_samp', 'ret', 7) + """ AS ret_std7,
              lag(ret) OVER (PARTITION BY series_id ORDER BY date) AS ret_lag1,
              lead(ret) OVER (PARTITION BY series_id ORDER BY date) AS ret_fwd1,
              lead(date) OVER (PARTITION BY series_id ORDER BY date) AS ret_fwd1_date FROM r1)"""


@register("panel_features", with_(PANEL_FEATURES_SQL) + """
SELECT series_id, date, close, close_imputed, ret, ret_mean7, ret_std7, ret_lag1, ret_fwd1, ret_fwd1_date,
       CASE WHEN ret_fwd1_date < DATE '1999-01-01' THEN 'train'
            WHEN ret_fwd1_date < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split
FROM r2 WHERE ret_fwd1 IS NOT NULL""", dbl="close ret ret_mean7 ret_std7 ret_lag1 ret_fwd1")
def q_panel_features(spark, sf):
    """Flagship slice: panel → calendar → bounded fill → returns, rolling, lag,
    forward target → chronological split by target date."""
    a = cal.align_to_calendar(inputs.daily_panel(spark, sf).select("series_id", "date", "close"), flag_col=None)
    a = cal.imputed_flags(a, ["close"])
    a = cal.ffill(a, ["close"], limit=3)
    a = ft.add_returns(a, "close", (1,))
    a = ft.add_rolling(a, "ret", 7, ("mean", "std"))
    a = ft.add_lags(a, ["ret"], (1,))
    a = ft.add_forward_target(a, "ret")
    split = (F.when(F.col("ret_fwd1_date") < F.lit(inputs.TRAIN_END).cast("date"), "train")
             .when(F.col("ret_fwd1_date") < F.lit(inputs.VAL_END).cast("date"), "val").otherwise("test"))
    return finish(a.withColumn("split", split).select(
        "series_id", "date", "close", "close_imputed", "ret", "ret_mean7", "ret_std7", "ret_lag1", "ret_fwd1",
        "ret_fwd1_date", "split"))


def _sub(name: str) -> str:
    from tidewater.plans.registry import ORACLE
    return "(" + ORACLE[name] + ")"


TECH_COLS = ["ma_5", "ma_10", "ma_20", "ma_50", "ma_5_10_cross", "ma_10_20_cross", "ma_20_50_cross", "price_vs_ma20",
             "price_vs_ma50", "rsi_14", "macd", "macd_signal", "macd_hist", "macd_cross", "bb_upper", "bb_lower",
             "bb_width", "bb_position", "momentum_5", "momentum_10", "momentum_20", "ret_std_5", "ret_std_20",
             "ret_mean_5", "ret_mean_20", "ret_lag1", "ret_lag2", "ret_lag3", "ret_lag5"]

_TECH_SQL = with_(RETURNS) + f""",
m0 AS (SELECT series_id, date, close, ret,
              {_roll('avg', 'close', 5)} AS r5, {_roll('avg', 'close', 10)} AS r10,
              {_roll('avg', 'close', 20)} AS r20, {_roll('avg', 'close', 50)} AS r50,
              close / lag(close, 5) OVER ({W}) - 1.0 AS mo5, close / lag(close, 10) OVER ({W}) - 1.0 AS mo10,
              close / lag(close, 20) OVER ({W}) - 1.0 AS mo20,
              {_roll('stddev_samp', 'ret', 5)} AS sd5, {_roll('stddev_samp', 'ret', 20)} AS sd20,
              {_roll('avg', 'ret', 5)} AS mn5, {_roll('avg', 'ret', 20)} AS mn20
       FROM rp),
m1 AS (SELECT series_id, date, close, ret,
              lag(r5) OVER ({W}) AS ma_5, lag(r10) OVER ({W}) AS ma_10, lag(r20) OVER ({W}) AS ma_20,
              lag(r50) OVER ({W}) AS ma_50, lag(close) OVER ({W}) AS prev,
              lag(mo5) OVER ({W}) AS momentum_5, lag(mo10) OVER ({W}) AS momentum_10, lag(mo20) OVER ({W}) AS momentum_20,
              lag(sd5) OVER ({W}) AS ret_std_5, lag(sd20) OVER ({W}) AS ret_std_20,
              lag(mn5) OVER ({W}) AS ret_mean_5, lag(mn20) OVER ({W}) AS ret_mean_20,
              lag(ret, 1) OVER ({W}) AS ret_lag1, lag(ret, 2) OVER ({W}) AS ret_lag2,
              lag(ret, 3) OVER ({W}) AS ret_lag3, lag(ret, 5) OVER ({W}) AS ret_lag5
       FROM m0),
m2 AS (SELECT *, CAST(coalesce(ma_5 > ma_10, false) AS INTEGER) AS ma_5_10_cross,
              CAST(coalesce(ma_10 > ma_20, false) AS INTEGER) AS ma_10_20_cross,
              CAST(coalesce(ma_20 > ma_50, false) AS INTEGER) AS ma_20_50_cross,
              (prev - ma_20) / (ma_20 + 1e-10) AS price_vs_ma20, (prev - ma_50) / (ma_50 + 1e-10) AS price_vs_ma50
       FROM m1)
SELECT m2.series_id, m2.date, close, ret, {", ".join(TECH_COLS)}
FROM m2 JOIN RSI_SQL r USING (series_id, date) JOIN MACD_SQL m USING (series_id, date)
     JOIN BB_SQL b USING (series_id, date)
WHERE {" AND ".join(c + " IS NOT NULL" for c in ["close", "ret"] + TECH_COLS)}"""


@register("technical_features", _TECH_SQL.replace("RSI_SQL", _sub("rsi")).replace("MACD_SQL", _sub("ewm_macd"))
          .replace("BB_SQL", _sub("bollinger")),
          dbl="close ret ma_5 ma_10 ma_20 ma_50 price_vs_ma20 price_vs_ma50 rsi_14 macd macd_signal macd_hist macd_cross "
              "bb_upper bb_lower bb_width bb_position momentum_5 momentum_10 momentum_20 ret_std_5 ret_std_20 "
              "ret_mean_5 ret_mean_20 ret_lag1 ret_lag2 ret_lag3 ret_lag5")
def q_technical_features(spark, sf):
    """The whole shifted technical feature set; rows with any
    missing feature dropped."""
    p = inputs.returns_panel(spark, sf).select("series_id", "date", "close", "ret")
    return finish(ft.technical_features(p).select("series_id", "date", "close", "ret", *TECH_COLS))
