"""Registered queries: reshapes, regimes, pair correlations, decision logs,
strategy comparisons, regression metrics, diagnostics and series tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import backtest as bt
from tidewater.operators import evaluate as ev
from tidewater.operators import features as ft
from tidewater.operators import reshape as rs
from tidewater.operators import stats as st
from tidewater.plans import inputs
from tidewater.plans.q_backtest import COST, THRESHOLD, _sim_sql
from tidewater.plans.q_evaluate import METRIC_SQL, counts_sql
from tidewater.plans.registry import (BACKTEST, FEATURES_SQL, PREDICTIONS, RETURNS, finish, register, with_)

MODELS = list(inputs.MODEL_MULTIPLIERS)


@register("predictions_wide", with_(PREDICTIONS) + """
SELECT Split, o_orderkey, date, target, """ + ", ".join(
    f"max(CASE WHEN Model = '{m}' THEN proba_up END) AS {m}" for m in MODELS) + """
FROM preds GROUP BY 1, 2, 3, 4""", dbl=" ".join(MODELS))
def q_predictions_wide(spark, sf):
    p = inputs.predictions(spark, sf)
    return finish(rs.pivot_wide(p, ["Split", "o_orderkey", "date", "target"], "Model", MODELS, "proba_up"))


# Named date regimes of the panel period, half-open [start, end).
REGIMES = [("early", "1995-01-01", "1997-01-01"), ("middle", "1997-01-01", "1999-07-01"),
           ("late", "1999-07-01", "2002-01-01")]


@register("date_regimes", with_(FEATURES_SQL) + """,
rg AS (SELECT *, CASE """ + " ".join(
    f"WHEN date >= DATE '{lo}' AND date < DATE '{hi}' THEN '{n}'" for n, lo, hi in REGIMES) + """ END AS regime FROM fm)
SELECT regime, count(*) AS n, 100.0 * avg(CAST(direction AS DOUBLE)) AS up_pct, avg(target_ret) AS mean_ret,
       stddev_samp(target_ret) AS volatility
FROM rg WHERE regime IS NOT NULL GROUP BY 1""", dbl="up_pct mean_ret volatility")
def q_date_regimes(spark, sf):
    fm = inputs.feature_matrix(spark, sf).withColumn("regime", rs.date_regimes("date", REGIMES))
    return finish(fm.where(F.col("regime").isNotNull()).groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), (F.lit(100.0) * F.avg(F.col("direction").cast("double"))).alias("up_pct"),
        F.avg("target_ret").alias("mean_ret"), F.stddev_samp("target_ret").alias("volatility")))


@register("quantile_regime", with_(FEATURES_SQL) + """,
q AS (SELECT quantile_cont(vol7, 0.25) AS q1, quantile_cont(vol7, 0.75) AS q3 FROM fm WHERE split = 'train'),
r AS (SELECT *, CASE WHEN vol7 IS NULL THEN NULL WHEN vol7 <= q1 THEN 'low' WHEN vol7 >= q3 THEN 'high'
                     ELSE 'medium' END AS regime FROM fm, q)
SELECT regime, count(*) AS n, avg(target_ret) AS mean_ret, 100.0 * avg(CAST(direction AS DOUBLE)) AS up_pct
FROM r WHERE regime IS NOT NULL GROUP BY 1""", dbl="mean_ret up_pct")
def q_quantile_regime(spark, sf):
    fm = inputs.feature_matrix(spark, sf)
    r = rs.quantile_regimes(fm, "vol7", fit_where=F.col("split") == "train")
    return finish(r.where(F.col("regime").isNotNull()).groupBy("regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("target_ret").alias("mean_ret"),
        (F.lit(100.0) * F.avg(F.col("direction").cast("double"))).alias("up_pct")))


FE = inputs.FEATURES
PAIRS = [(a, b) for i, a in enumerate(FE) for b in FE[i + 1:]]


@register("corr_top_pairs", with_(FEATURES_SQL) + """,
pr AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM fm "
    f"WHERE split = 'train' AND {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS) + """),
rk AS (SELECT f1, f2,
              rank() OVER (PARTITION BY f1, f2 ORDER BY x) + (count(*) OVER (PARTITION BY f1, f2, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY f1, f2 ORDER BY y) + (count(*) OVER (PARTITION BY f1, f2, y) - 1) / 2.0 AS ry
       FROM pr),
c AS (SELECT f1, f2, count(*) AS n, corr(rx, ry) AS spearman_r FROM rk GROUP BY 1, 2)
SELECT f1, f2, n, spearman_r, abs(spearman_r) AS abs_r,
       CAST(row_number() OVER (ORDER BY abs(spearman_r) DESC, f1, f2) AS INTEGER) AS rank,
       CAST(abs(spearman_r) > 0.8 AS INTEGER) AS high
FROM c""", dbl="spearman_r abs_r")
def q_corr_top_pairs(spark, sf):
    """T-02/R03/O04: pairwise-complete Spearman matrix (upper triangle) ranked by |rho|."""
    fm = inputs.feature_matrix(spark, sf).where(F.col("split") == "train")
    pr = rs.feature_pairs(fm, ["series_id", "date"], FE)
    rx = st.average_ranks(pr, ["f1", "f2"], "x").select("f1", "f2", "x", F.col("avg_rank").alias("rx"))
    ry = st.average_ranks(pr, ["f1", "f2"], "y").select("f1", "f2", "y", F.col("avg_rank").alias("ry"))
    j = pr.join(rx, ["f1", "f2", "x"]).join(ry, ["f1", "f2", "y"])
    c = j.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), ft.corr_expr("rx", "ry").alias("spearman_r"))
    w = Window.orderBy(F.abs("spearman_r").desc(), "f1", "f2")  # one row per pair: p(p-1)/2 rows
    return finish(c.select("f1", "f2", "n", "spearman_r", F.abs("spearman_r").alias("abs_r"),
                           F.row_number().over(w).alias("rank"), (F.abs("spearman_r") > 0.8).cast("int").alias("high")))


@register("decision_log", with_(PREDICTIONS) + """
SELECT Model, date, o_orderkey, target, proba_up,
       CASE WHEN proba_up >= 0.5 THEN 'UP' ELSE 'DOWN' END AS decision,
       CAST(CAST(proba_up >= 0.5 AS INTEGER) = target AS INTEGER) AS correct, abs(proba_up - 0.5) AS margin
FROM preds WHERE Split = 'test'
QUALIFY row_number() OVER (PARTITION BY Model, date ORDER BY o_orderkey) = 1""", dbl="proba_up margin")
def q_decision_log(spark, sf):
    p = inputs.predictions(spark, sf).where(F.col("Split") == "test")
    d = ev.decision_log(p, ["Model", "date"], "o_orderkey")
    return finish(d.select("Model", "date", "o_orderkey", "target", "proba_up", "decision", "correct", "margin"))


BH_SQL = f"""
b3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY date) = 1 THEN 1 ELSE 0 END AS bto
       FROM bt_in),
b4 AS (SELECT *, CAST(actual_return AS DOUBLE) - bto * {COST}::DOUBLE AS bnet FROM b3),
bh AS (SELECT series_id, target_date, product(greatest(0.0, 1.0 + bnet)) OVER (PARTITION BY series_id ORDER BY date
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity_buy_hold FROM b4)"""


@register("strategy_comparison", with_(BACKTEST, _sim_sql("bt_in"), BH_SQL) + """
SELECT d.series_id, d.target_date, d.equity AS equity_momentum, bh.equity_buy_hold
FROM daily d JOIN bh ON d.series_id = bh.series_id AND d.target_date = bh.target_date""",
          dbl="equity_momentum equity_buy_hold")
def q_strategy_comparison(spark, sf):
    """Equity curves of two strategies aligned on the target date (not row position)."""
    b = inputs.backtest_input(spark, sf)
    mo = bt.simulate(b, ["series_id"], "date", "predicted_return", "actual_return", THRESHOLD, COST) \
        .select("series_id", "target_date", F.lit("momentum").alias("strategy"), "equity")
    bh = bt.buy_and_hold(b, ["series_id"], "date", "actual_return", COST) \
        .select("series_id", "target_date", F.lit("buy_hold").alias("strategy"), "equity")
    wide = rs.pivot_wide(mo.unionByName(bh), ["series_id", "target_date"], "strategy", ["momentum", "buy_hold"],
                         "equity")
    return finish(wide.select("series_id", "target_date", F.col("momentum").alias("equity_momentum"),
                              F.col("buy_hold").alias("equity_buy_hold"))
                  .where(F.col("equity_momentum").isNotNull() & F.col("equity_buy_hold").isNotNull()))


@register("regression_metrics", with_(BACKTEST) + """,
cal AS (SELECT series_id,
               CASE WHEN var_pop(predicted_return) <= 1e-12 THEN avg(actual_return)
                    ELSE avg(actual_return) - covar_pop(actual_return, predicted_return) / var_pop(predicted_return)
                         * avg(predicted_return) END AS a,
               CASE WHEN var_pop(predicted_return) <= 1e-12 THEN 0.0
                    ELSE covar_pop(actual_return, predicted_return) / var_pop(predicted_return) END AS b
        FROM bt_in WHERE target_date >= DATE '1999-01-01' AND target_date < DATE '2000-01-01' GROUP BY 1),
t AS (SELECT series_id, actual_return AS y, a + b * predicted_return AS yhat
      FROM bt_in JOIN cal USING (series_id) WHERE target_date >= DATE '2000-01-01')
SELECT series_id, avg(abs(yhat - y)) AS MAE, sqrt(avg((yhat - y) * (yhat - y))) AS RMSE,
       1.0 - sum((yhat - y) * (yhat - y)) / (sum(y * y) - sum(y) * sum(y) / count(y)) AS R2,
       avg(CASE WHEN y <> 0 THEN abs((yhat - y) / y) END) AS MAPE,
       avg(CAST(sign(y) = sign(yhat) AS DOUBLE)) AS DirAcc, count(*) AS N,
       avg(yhat - y) AS resid_mean, stddev_samp(yhat - y) AS resid_std
FROM t GROUP BY 1""", dbl="MAE RMSE R2 MAPE DirAcc resid_mean resid_std")
def q_regression_metrics(spark, sf):
    """B01 + E10/E11: calibration fitted on val, applied to test; error metrics and residual profile."""
    b = inputs.backtest_input(spark, sf)
    val = b.where((F.col("target_date") >= F.lit(inputs.TRAIN_END).cast("date")) &
                  (F.col("target_date") < F.lit(inputs.VAL_END).cast("date")))
    cal = bt.calibrate_linear(val, ["series_id"], "predicted_return", "actual_return")
    t = b.where(F.col("target_date") >= F.lit(inputs.VAL_END).cast("date")).join(cal, "series_id")
    t = t.withColumn("yhat", F.col("intercept") + F.col("slope") * F.col("predicted_return"))
    m = ev.regression_metrics(t, ["series_id"], "actual_return", "yhat")
    r = t.groupBy("series_id").agg(F.avg(F.col("yhat") - F.col("actual_return")).alias("resid_mean"),
                                   F.stddev_samp(F.col("yhat") - F.col("actual_return")).alias("resid_std"))
    return finish(m.join(r, "series_id"))


@register("threshold_diagnostics", with_(PREDICTIONS) + f"""
, grid AS (SELECT CAST(i AS DOUBLE) * ((0.7::DOUBLE - 0.3::DOUBLE) / 160.0::DOUBLE) + 0.3::DOUBLE AS threshold
           FROM range(0, 161) t(i)),
c AS (SELECT Model, threshold,
        count_if(proba_up >= threshold AND target = 1) AS TP, count_if(proba_up >= threshold AND target <> 1) AS FP,
        count_if(proba_up < threshold AND target <> 1) AS TN, count_if(proba_up < threshold AND target = 1) AS FN
      FROM preds, grid WHERE Split = 'val' GROUP BY 1, 2),
m AS (SELECT Model, threshold, {METRIC_SQL} FROM c),
best AS (SELECT Model, threshold AS best_threshold FROM m
         QUALIFY row_number() OVER (PARTITION BY Model ORDER BY F1_macro DESC, threshold) = 1),
tb AS (SELECT Model, any_value(best_threshold) AS best_threshold,
        count_if(proba_up >= best_threshold AND target = 1) AS TP, count_if(proba_up >= best_threshold AND target <> 1) AS FP,
        count_if(proba_up < best_threshold AND target <> 1) AS TN, count_if(proba_up < best_threshold AND target = 1) AS FN
      FROM preds JOIN best USING (Model) WHERE Split = 'test' GROUP BY 1),
tf AS ({counts_sql("preds WHERE Split = 'test'", "Model")}),
mb AS (SELECT Model, best_threshold, {METRIC_SQL} FROM tb),
mf AS (SELECT Model, {METRIC_SQL} FROM tf)
SELECT Model, best_threshold, mf.F1_macro AS F1_fixed, mb.F1_macro AS F1_val_best,
       mb.F1_macro - mf.F1_macro AS delta_F1
FROM mb JOIN mf USING (Model)""", dbl="best_threshold F1_fixed F1_val_best delta_F1")
def q_threshold_diagnostics(spark, sf):
    """Test F1-macro at the fixed 0.5 threshold vs at the validation-best threshold."""
    p = inputs.predictions(spark, sf)
    best = ev.best_threshold(ev.threshold_sweep(p.where(F.col("Split") == "val"), ["Model"]), ["Model"])
    # test predictions reduced once to a score histogram; both thresholds are evaluated on it
    h = ev.score_histogram(p.where(F.col("Split") == "test"), ["Model"])
    hb = h.join(best.select("Model", "best_threshold"), "Model")
    mb = ev.metrics_from_counts(ev.counts_from_histogram(hb, ["Model"], threshold=F.col("best_threshold"))) \
        .select("Model", F.col("F1_macro").alias("F1_val_best"))
    mf = ev.metrics_from_counts(ev.counts_from_histogram(h, ["Model"])).select("Model", F.col("F1_macro").alias("F1_fixed"))
    out = best.select("Model", "best_threshold").join(mf, "Model").join(mb, "Model")
    return finish(out.withColumn("delta_F1", F.col("F1_val_best") - F.col("F1_fixed")))


@register("class_monthly_counts", with_(FEATURES_SQL) + """
SELECT CAST(date_trunc('month', target_date) AS DATE) AS month,
       CAST(count_if(direction = 0) AS BIGINT) AS down, CAST(count_if(direction = 1) AS BIGINT) AS up
FROM fm GROUP BY 1""")
def q_class_monthly_counts(spark, sf):
    """Monthly class counts pivoted on the label."""
    fm = inputs.feature_matrix(spark, sf).withColumn("month", F.trunc("target_date", "MM"))
    pv = fm.groupBy("month").pivot("direction", [0, 1]).count().fillna(0, ["0", "1"])
    return pv.select("month", F.col("0").cast("long").alias("down"), F.col("1").cast("long").alias("up"))


@register("ljung_box", with_(RETURNS) + """
, c AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY date) AS rn,
               ret * ret - avg(ret * ret) OVER (PARTITION BY series_id) AS c FROM rp WHERE ret IS NOT NULL),
den AS (SELECT series_id, sum(c * c) AS den, count(*) AS n FROM c GROUP BY 1),
num AS (SELECT a.series_id, k AS lag, sum(a.c * b.c) AS num
        FROM c a, range(1, 31) t(k), c b WHERE b.series_id = a.series_id AND b.rn = a.rn - k GROUP BY 1, 2),
acf AS (SELECT num.series_id, lag, num / den AS acf, n FROM num JOIN den USING (series_id)),
lb AS (SELECT series_id, CAST(h AS INTEGER) AS lags,
       any_value(CAST(n AS DOUBLE)) * (any_value(CAST(n AS DOUBLE)) + 2.0)
         * sum(acf * acf / (CAST(n AS DOUBLE) - CAST(lag AS DOUBLE))) AS lb_q
FROM acf, (VALUES (10), (20), (30)) v(h) WHERE lag <= h GROUP BY 1, 2),
-- upper tail with 2m degrees of freedom: the first m Poisson terms of mean q / 2
tail AS (SELECT series_id, lags, sum(exp(i * ln(greatest(lb_q, 1e-300) / 2) - lb_q / 2 - lgamma(i + 1))) AS lb_p
         FROM lb, range(0, 15) t(i) WHERE i < lags / 2 GROUP BY 1, 2)
SELECT series_id, lags, lb_q, lb_p FROM lb JOIN tail USING (series_id, lags)""", dbl="lb_q lb_p")
def q_ljung_box(spark, sf):
    """T-16: Ljung-Box Q and its p on squared returns at 10, 20 and 30 lags."""
    p = inputs.returns_panel(spark, sf)
    acf = ft.autocorrelation(p, "ret", 30, squared=True)
    n = p.where(F.col("ret").isNotNull()).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return finish(st.ljung_box(acf, n, ["series_id"], [10, 20, 30]))
