"""Registered queries: backtests of a momentum signal on the daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import backtest as bt
from tidewater.plans import inputs
from tidewater.plans.registry import BACKTEST, finish, register, with_

THRESHOLD = 0.05
COST = 0.0015
K = ["series_id"]
WS = "PARTITION BY series_id ORDER BY date"


def _sim_sql(src: str, part: str = "series_id", thr: str = str(THRESHOLD), extra_sel: str = "") -> str:
    w = f"PARTITION BY {part} ORDER BY date"
    return f"""
s1 AS (SELECT *, CASE WHEN predicted_return > {thr} THEN 1 WHEN predicted_return < -({thr}) THEN -1 ELSE 0 END
              AS raw_signal FROM {src}),
s2 AS (SELECT *, coalesce(lag(raw_signal, 1) OVER ({w}), 0) AS position FROM s1),
s3 AS (SELECT *, abs(position - coalesce(lag(position, 1) OVER ({w}), 0)) AS turnover FROM s2),
s4 AS (SELECT *, position * actual_return AS gross_return, turnover * {COST}::DOUBLE AS cost FROM s3),
s5 AS (SELECT *, gross_return - cost AS net_return FROM s4),
daily AS (SELECT *,
  product(greatest(0.0, 1.0 + net_return)) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity,
  product(greatest(0.0, 1.0 + gross_return)) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS zero_cost_equity FROM s5)"""


def _metrics_sql(src: str, group: str) -> str:
    part = group
    return f"""
pk AS (SELECT *, max(equity) OVER (PARTITION BY {part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS peak FROM {src}),
agg AS (SELECT {group}, count(*) AS n_days, arg_max(equity, date) - 1.0 AS total_return,
          avg(net_return) AS mu, stddev_pop(net_return) AS sd,
          sqrt(avg(least(net_return, 0.0) * least(net_return, 0.0))) AS dsd,
          least(0.0, coalesce(min(CASE WHEN peak > 0 THEN equity / peak - 1.0 END), 0.0)) AS max_drawdown,
          CAST(count_if(turnover > 0) AS BIGINT) AS trades, CAST(sum(turnover) AS BIGINT) AS turnover,
          avg(CAST(abs(position) AS DOUBLE)) AS exposure,
          arg_max(zero_cost_equity, date) - 1.0 AS zero_cost_return
        FROM pk GROUP BY {group}),
met AS (SELECT {group}, n_days, total_return,
          CASE WHEN sd > 0 THEN mu / sd * sqrt(252.0) END AS sharpe,
          CASE WHEN dsd > 0 THEN mu / dsd * sqrt(252.0) END AS sortino,
          max_drawdown, trades, turnover, exposure, zero_cost_return, zero_cost_return - total_return AS cost_drag
        FROM agg)"""


MET_DBL = "total_return sharpe sortino max_drawdown exposure zero_cost_return cost_drag"

DAILY_COLS = ("series_id, date, target_date, predicted_return, actual_return, raw_signal, position, turnover, "
              "gross_return, cost, net_return, equity, zero_cost_equity")


@register("backtest_daily", with_(BACKTEST, _sim_sql("bt_in")) + f"SELECT {DAILY_COLS} FROM daily",
          dbl="predicted_return actual_return gross_return cost net_return equity zero_cost_equity")
def q_backtest_daily(spark, sf):
    b = inputs.backtest_input(spark, sf)
    d = bt.simulate(b, K, "date", "predicted_return", "actual_return", THRESHOLD, COST, 1)
    return finish(d.select(*[c.strip() for c in DAILY_COLS.split(",")]))


@register("backtest_metrics", with_(BACKTEST, _sim_sql("bt_in"), _metrics_sql("daily", "series_id"))
          + "SELECT * FROM met", dbl=MET_DBL)
def q_backtest_metrics(spark, sf):
    b = inputs.backtest_input(spark, sf)
    d = bt.simulate(b, K, "date", "predicted_return", "actual_return", THRESHOLD, COST, 1)
    return finish(bt.strategy_metrics(d, K))


VAL = "target_date >= DATE '1999-01-01' AND target_date < DATE '2000-01-01'"

CAND_SQL = f"""
v AS (SELECT * FROM bt_in WHERE {VAL}),
ranked AS (SELECT series_id, abs(predicted_return) AS a,
                  row_number() OVER (PARTITION BY series_id ORDER BY abs(predicted_return)) - 1 AS i,
                  count(*) OVER (PARTITION BY series_id) AS n FROM v),
cand AS (
  SELECT DISTINCT series_id, threshold FROM (
    SELECT r.series_id, r.a AS threshold FROM ranked r, range(5, 96, 5) t(k)
    WHERE r.i = least(r.n - 1, CAST(floor(r.n * k / 100) AS BIGINT))
    UNION ALL
    SELECT s.series_id, CAST(c AS DOUBLE) FROM (SELECT DISTINCT series_id FROM v) s,
      (VALUES (0.0), {", ".join(f"({c})" for c in bt.FIXED_CANDIDATES)}) t(c))),
fan AS (SELECT v.*, cand.threshold FROM v JOIN cand USING (series_id))"""


@register("threshold_optimise", with_(BACKTEST, CAND_SQL,
                                      _sim_sql("fan", "series_id, threshold", "threshold"),
                                      _metrics_sql("daily", "series_id, threshold")) + """
SELECT * EXCLUDE (rk) FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id
                               ORDER BY round(coalesce(sharpe, -999.0), 9) DESC, round(total_return, 9) DESC,
                                        turnover ASC, threshold ASC) AS rk
  FROM met) WHERE rk = 1""", dbl="threshold " + MET_DBL)
def q_threshold_optimise(spark, sf):
    b = inputs.backtest_input(spark, sf)
    v = b.where((F.col("target_date") >= F.lit(inputs.TRAIN_END).cast("date")) &
                (F.col("target_date") < F.lit(inputs.VAL_END).cast("date")))
    best = bt.optimise_threshold(v, K, "date", "predicted_return", "actual_return", COST, 1)
    return finish(best.select("series_id", "threshold", "n_days", "total_return", "sharpe", "sortino",
                              "max_drawdown", "trades", "turnover", "exposure", "zero_cost_return", "cost_drag"))


@register("buy_hold", with_(BACKTEST) + f""",
s3 AS (SELECT *, 1 AS position,
              CASE WHEN row_number() OVER ({WS}) = 1 THEN 1 ELSE 0 END AS turnover,
              CAST(actual_return AS DOUBLE) AS gross_return FROM bt_in),
s4 AS (SELECT *, turnover * {COST}::DOUBLE AS cost FROM s3),
s5 AS (SELECT *, gross_return - cost AS net_return FROM s4),
daily AS (SELECT *,
  product(greatest(0.0, 1.0 + net_return)) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity,
  product(greatest(0.0, 1.0 + gross_return)) OVER ({WS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS zero_cost_equity FROM s5), {_metrics_sql("daily", "series_id")}
SELECT * FROM met""", dbl=MET_DBL)
def q_buy_hold(spark, sf):
    b = inputs.backtest_input(spark, sf)
    return finish(bt.strategy_metrics(bt.buy_and_hold(b, K, "date", "actual_return", COST), K))


@register("yearly_metrics", with_(BACKTEST) + f""",
y AS (SELECT *, CAST(year(target_date) AS INTEGER) AS year FROM bt_in), {_sim_sql("y", "series_id, year")},
{_metrics_sql("daily", "series_id, year")}
SELECT * FROM met""", dbl=MET_DBL)
def q_yearly_metrics(spark, sf):
    b = inputs.backtest_input(spark, sf)
    return finish(bt.yearly_metrics(b, K, "date", "target_date", "predicted_return", "actual_return",
                                    THRESHOLD, COST, 1))
