"""Signal backtests (survey B01-B13).

A backtest runs per strategy series: windows partition by the series keys
(plus threshold / year where a sweep or a breakdown needs it), so a
parameter sweep is a fan-out over a bounded candidate table joined on the
series key, never a cross join of rows.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.joins import join_null_safe
from tidewater.operators.calendar import time_bucket
from tidewater.operators.scan import running

__all__ = [
    "calibrate_linear", "threshold_signal", "simulate", "strategy_metrics", "threshold_candidates",
    "optimise_threshold", "selection_key", "buy_and_hold", "yearly_metrics", "FIXED_CANDIDATES",
]

# Constant candidate thresholds added to the order statistics
# of |score| when searching a trading threshold.
FIXED_CANDIDATES = [0.0005, 0.001, 0.0015, 0.002, 0.0025, 0.003, 0.004, 0.005, 0.0075, 0.01, 0.015, 0.02]
ANNUAL = math.sqrt(252.0)


def calibrate_linear(df: DataFrame, group: Sequence[str], x: str, y: str, min_var: float = 1e-12) -> DataFrame:
    """OLS ``y = intercept + slope * x`` per group; var(x) <= min_var gives (mean y, 0)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xv, yv = F.when(both, F.col(x)), F.when(both, F.col(y))
    a = df.groupBy(*group).agg(F.count(F.when(both, 1)).alias("n"), F.var_pop(xv).alias("__vx"),
                               F.covar_pop(yv, xv).alias("__cxy"), F.avg(xv).alias("__mx"), F.avg(yv).alias("__my"))
    slope = F.when(F.col("__vx") <= min_var, F.lit(0.0)).otherwise(F.col("__cxy") / F.col("__vx"))
    icpt = F.when(F.col("__vx") <= min_var, F.col("__my")).otherwise(
        F.col("__my") - F.col("__cxy") / F.col("__vx") * F.col("__mx"))
    return a.select(*group, "n", icpt.alias("intercept"), slope.alias("slope"))


def threshold_signal(score, threshold) -> Column:
    """1 above +t, -1 below -t, else 0."""
    s = F.col(score) if isinstance(score, str) else score
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(s > t, 1).when(s < -t, -1).otherwise(0)


def simulate(df: DataFrame, keys: Sequence[str], order: str, score: str, actual: str, threshold=0.0,
             cost_rate: float = 0.0015, lag_days: int = 1) -> DataFrame:
    """Raw signal, execution-lagged position (0 before), turnover,
    gross/cost/net returns and the net and zero-cost equity curves
    (running product of max(0, 1 + r))."""
    keys, signal = list(keys), threshold_signal(score, threshold)
    # the position and the one before it are both lags of the signal
    d = running(df.withColumn("raw_signal", signal),
                {"position": ("lag", "raw_signal", lag_days, 0), "__held": ("lag", "raw_signal", lag_days + 1, 0)}, keys, order, bucket=_stretch(order))
    d = d.withColumn("turnover", F.abs(F.col("position") - F.col("__held"))).drop("__held")
    d = d.withColumns({"gross_return": F.col("position") * F.col(actual),
                       "cost": F.col("turnover") * F.lit(float(cost_rate))})
    d = d.withColumn("net_return", F.col("gross_return") - F.col("cost"))
    return _curves(d, keys, order)


def _stretch(order: str) -> Column:
    """Trading days are bounded by the calendar, so scans are cut by year and need no counts of rows."""
    return time_bucket(order, "year")


def _curves(d: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Net and zero-cost equity: running products of max(0, 1 + r), in one scan."""
    growth = lambda r: F.greatest(F.lit(0.0), F.lit(1.0) + F.col(r))
    return running(d, {"equity": ("product", growth("net_return")), "zero_cost_equity": ("product", growth("gross_return"))}, keys, order,
                   bucket=_stretch(order))


def strategy_metrics(daily: DataFrame, keys: Sequence[str], order: str = "date", ret: str = "net_return",
                     equity: str = "equity") -> DataFrame:
    """Total return, Sharpe (population std, sqrt(252), NULL if 0),
    Sortino (downside RMS), max drawdown with the peak starting at the first
    equity value, plus trades, turnover, exposure, zero-cost return and cost
    drag."""
    keys = list(keys)
    d = running(daily, {"__peak": ("max", equity)}, keys, order, bucket=_stretch(order))
    d = d.withColumn("__dd", F.when(F.col("__peak") > 0, F.col(equity) / F.col("__peak") - F.lit(1.0)))
    r = F.col(ret)
    down = F.least(r, F.lit(0.0))
    m = d.groupBy(*keys).agg(
        (F.max_by(equity, order) - F.lit(1.0)).alias("total_return"),
        F.avg(r).alias("__mu"), F.stddev_pop(r).alias("__sd"), F.sqrt(F.avg(down * down)).alias("__dsd"),
        F.least(F.lit(0.0), F.coalesce(F.min("__dd"), F.lit(0.0))).alias("max_drawdown"),
        F.count_if(F.col("turnover") > 0).alias("trades"), F.sum("turnover").cast("long").alias("turnover"),
        F.avg(F.abs(F.col("position")).cast("double")).alias("exposure"),
        (F.max_by("zero_cost_equity", order) - F.lit(1.0)).alias("zero_cost_return"),
        F.count(F.lit(1)).alias("n_days"))
    return m.select(
        *keys, "n_days", "total_return",
        F.when(F.col("__sd") > 0, F.col("__mu") / F.col("__sd") * F.lit(ANNUAL)).alias("sharpe"),
        F.when(F.col("__dsd") > 0, F.col("__mu") / F.col("__dsd") * F.lit(ANNUAL)).alias("sortino"),
        "max_drawdown", "trades", "turnover", "exposure", "zero_cost_return",
        (F.col("zero_cost_return") - F.col("total_return")).alias("cost_drag"))


def threshold_candidates(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """0, the order statistics |s|[min(n-1, int(n*k/100))] for k = 5..95
    step 5, and the fixed constants; distinct per group."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("__a")
    d = df.select(*keys, F.abs(score).alias("__a")).withColumns({
        "__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    ks = F.array(*[F.lit(k) for k in range(5, 96, 5)])
    want = F.exists(ks, lambda k: F.least(F.col("__n") - 1, F.floor(F.col("__n") * k / F.lit(100)).cast("long")) == F.col("__i"))
    stats = d.where(want).select(*keys, F.col("__a").alias("threshold"))
    consts = df.select(*keys).distinct().select(
        *keys, F.explode(F.array(*[F.lit(float(c)) for c in [0.0] + FIXED_CANDIDATES])).alias("threshold"))
    return stats.unionByName(consts).distinct()


def optimise_threshold(df: DataFrame, keys: Sequence[str], order: str, score: str, actual: str,
                       cost_rate: float = 0.0015, lag_days: int = 1, candidates: DataFrame | None = None) -> DataFrame:
    """Simulate every candidate threshold and keep the best by
    (Sharpe with NULL as -999, total return, -turnover); lowest threshold on
    ties.  Rows fan out only to their own group's candidates."""
    keys = list(keys)
    cand = candidates if candidates is not None else threshold_candidates(df, keys, score)
    fan = df.join(cand, keys)
    daily = simulate(fan, keys + ["threshold"], order, score, actual, F.col("threshold"), cost_rate, lag_days)
    met = strategy_metrics(daily, keys + ["threshold"], order)
    key = F.struct(*selection_key(), -F.col("threshold"))
    best = met.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in met.columns if c not in keys]), key).alias("b"))
    return best.select(*keys, "b.*")


def selection_key(digits: int = 9) -> list[Column]:
    """B09 ranking key (larger is better): Sharpe with NULL as -999, total
    return, then fewer trades.  Metrics are compared at ``digits`` decimals so
    that mathematically equal strategies (same positions, different
    thresholds) tie exactly instead of being ordered by float noise."""
    return [F.round(F.coalesce(F.col("sharpe"), F.lit(-999.0)), digits), F.round(F.col("total_return"), digits),
            -F.col("turnover")]


def buy_and_hold(df: DataFrame, keys: Sequence[str], order: str, actual: str, cost_rate: float = 0.0015) -> DataFrame:
    """Always long, one entry cost on the first row."""
    keys = list(keys)
    first = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    d = join_null_safe(df, first, keys)
    d = d.withColumns({"position": F.lit(1), "turnover": F.when(F.col(order) == F.col("__first"), 1).otherwise(0),
                       "gross_return": F.col(actual).cast("double")}).drop("__first")
    d = d.withColumn("cost", F.col("turnover") * F.lit(float(cost_rate)))
    return _curves(d.withColumn("net_return", F.col("gross_return") - F.col("cost")), keys, order)


def yearly_metrics(df: DataFrame, keys: Sequence[str], order: str, year_of: str, score: str, actual: str,
                   threshold=0.0, cost_rate: float = 0.0015, lag_days: int = 1) -> DataFrame:
    """The strategy restarted every calendar year of ``year_of``."""
    d = df.withColumn("year", F.year(year_of))
    keys = list(keys) + ["year"]
    return strategy_metrics(simulate(d, keys, order, score, actual, threshold, cost_rate, lag_days), keys, order)
