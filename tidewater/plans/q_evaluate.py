"""Registered queries: classification evaluation, sweeps, leaderboards, ensembles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import evaluate as ev
from tidewater.plans import inputs
from tidewater.plans.registry import BACKTEST, PREDICTIONS, finish, register, with_

G = ["Model", "Split"]

METRIC_SQL = """
  CAST(TP + FP + TN + FN AS BIGINT) AS N,
  coalesce((CAST(TP AS DOUBLE) + TN) / nullif(CAST(TP AS DOUBLE) + FP + TN + FN, 0), 0) AS Accuracy,
  coalesce(CAST(TP AS DOUBLE) / nullif(CAST(TP AS DOUBLE) + FP, 0), 0) AS Precision_UP,
  coalesce(CAST(TP AS DOUBLE) / nullif(CAST(TP AS DOUBLE) + FN, 0), 0) AS Recall_UP,
  coalesce(CAST(TN AS DOUBLE) / nullif(CAST(TN AS DOUBLE) + FN, 0), 0) AS Precision_DOWN,
  coalesce(CAST(TN AS DOUBLE) / nullif(CAST(TN AS DOUBLE) + FP, 0), 0) AS Recall_DOWN,
  coalesce(2.0 * TP / nullif(2.0 * TP + FP + FN, 0), 0) AS F1_binary,
  (coalesce(2.0 * TP / nullif(2.0 * TP + FP + FN, 0), 0) + coalesce(2.0 * TN / nullif(2.0 * TN + FN + FP, 0), 0)) / 2.0 AS F1_macro,
  (coalesce(CAST(TP AS DOUBLE) / nullif(CAST(TP AS DOUBLE) + FN, 0), 0)
   + coalesce(CAST(TN AS DOUBLE) / nullif(CAST(TN AS DOUBLE) + FP, 0), 0)) / 2.0 AS BalancedAcc,
  coalesce((CAST(TP AS DOUBLE) * TN - CAST(FP AS DOUBLE) * FN)
           / nullif(sqrt((CAST(TP AS DOUBLE) + FP) * (CAST(TP AS DOUBLE) + FN) * (CAST(TN AS DOUBLE) + FP)
                         * (CAST(TN AS DOUBLE) + FN)), 0), 0) AS MCC,
  coalesce((CAST(TP AS DOUBLE) + FP) / nullif(CAST(TP AS DOUBLE) + FP + TN + FN, 0), 0) AS PosRate,
  coalesce((CAST(TP AS DOUBLE) + FN) / nullif(CAST(TP AS DOUBLE) + FP + TN + FN, 0), 0) AS TargetUpRate"""

METRIC_DBL = ("Accuracy Precision_UP Recall_UP Precision_DOWN Recall_DOWN F1_binary F1_macro BalancedAcc MCC "
              "PosRate TargetUpRate")


def counts_sql(src: str, group: str, thr: str = "0.5", score: str = "proba_up") -> str:
    return f"""SELECT {group},
  CAST(count_if({score} >= {thr} AND target = 1) AS BIGINT) AS TP, CAST(count_if({score} >= {thr} AND target <> 1) AS BIGINT) AS FP,
  CAST(count_if({score} < {thr} AND target <> 1) AS BIGINT) AS TN, CAST(count_if({score} < {thr} AND target = 1) AS BIGINT) AS FN
FROM {src} GROUP BY {group}"""


def auc_sql(src: str, group: str, score: str = "proba_up") -> str:
    part = ", ".join(g.strip() for g in group.split(","))
    return f"""SELECT {group},
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0
       THEN sum(CAST(pos AS DOUBLE) * (CAST(neg_below AS DOUBLE) + CAST(neg AS DOUBLE) / 2.0))
            / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS AUC
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {part} ORDER BY {score}
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT {group}, {score}, count_if(target = 1) AS pos, count_if(target <> 1) AS neg
            FROM {src} GROUP BY {group}, {score}))
GROUP BY {group}"""


@register("confusion_metrics", with_(PREDICTIONS) + f"""
SELECT Model, Split, TP, FP, TN, FN, {METRIC_SQL}
FROM ({counts_sql('preds', 'Model, Split')})""", dbl=METRIC_DBL)
def q_confusion_metrics(spark, sf):
    p = inputs.predictions(spark, sf)
    return finish(ev.classification_metrics(p, G))


@register("roc_auc", with_(PREDICTIONS) + auc_sql("preds", "Model, Split"), dbl="AUC")
def q_roc_auc(spark, sf):
    return finish(ev.roc_auc(inputs.predictions(spark, sf), G))


@register("logloss_brier", with_(PREDICTIONS) + """
SELECT Model, Split,
       avg(-(target * ln(pc) + (1 - target) * ln(1.0 - pc))) AS LogLoss,
       avg((pc - target) * (pc - target)) AS Brier
FROM (SELECT *, least(greatest(proba_up, 1e-6), 1.0 - 1e-6) AS pc FROM preds)
GROUP BY 1, 2""", dbl="LogLoss Brier")
def q_logloss_brier(spark, sf):
    return finish(ev.logloss_brier(inputs.predictions(spark, sf), G))


SWEEP_COLS = "Model, threshold, TP, FP, TN, FN, N, Accuracy, F1_macro, BalancedAcc, MCC"


@register("threshold_sweep", with_(PREDICTIONS) + f"""
, grid AS (SELECT CAST(i AS DOUBLE) * ((0.7::DOUBLE - 0.3::DOUBLE) / 160.0::DOUBLE) + 0.3::DOUBLE AS threshold
           FROM range(0, 161) t(i)),
c AS (SELECT Model, threshold,
        CAST(count_if(proba_up >= threshold AND target = 1) AS BIGINT) AS TP, CAST(count_if(proba_up >= threshold AND target <> 1) AS BIGINT) AS FP,
        CAST(count_if(proba_up < threshold AND target <> 1) AS BIGINT) AS TN, CAST(count_if(proba_up < threshold AND target = 1) AS BIGINT) AS FN
      FROM preds, grid WHERE Split = 'val' GROUP BY 1, 2),
m AS (SELECT Model, threshold, TP, FP, TN, FN, {METRIC_SQL} FROM c)
SELECT {SWEEP_COLS},
       CASE WHEN row_number() OVER (PARTITION BY Model ORDER BY F1_macro DESC, threshold) = 1 THEN 1 ELSE 0 END AS is_best
FROM m""", dbl="threshold Accuracy F1_macro BalancedAcc MCC")
def q_threshold_sweep(spark, sf):
    p = inputs.predictions(spark, sf).where(F.col("Split") == "val")
    s = ev.threshold_sweep(p, ["Model"])
    w = Window.partitionBy("Model").orderBy(F.col("F1_macro").desc(), F.col("threshold"))
    s = s.withColumn("is_best", (F.row_number().over(w) == 1).cast("int"))
    return finish(s.select(*[c.strip() for c in SWEEP_COLS.split(",")], "is_best"))


MARGINS = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]
CURVE_COLS = "Model, Margin, TP, FP, TN, FN, N, Accuracy, F1_macro, Coverage"


@register("confidence_curve", with_(PREDICTIONS) + f"""
, mg AS (SELECT CAST(m AS DOUBLE) AS Margin FROM (VALUES {", ".join(f"({m})" for m in MARGINS)}) t(m)),
tot AS (SELECT Model, count(*) AS n_all FROM preds WHERE Split = 'test' GROUP BY 1),
c AS (SELECT Model, Margin,
        CAST(count_if(proba_up >= 0.5 AND target = 1) AS BIGINT) AS TP, CAST(count_if(proba_up >= 0.5 AND target <> 1) AS BIGINT) AS FP,
        CAST(count_if(proba_up < 0.5 AND target <> 1) AS BIGINT) AS TN, CAST(count_if(proba_up < 0.5 AND target = 1) AS BIGINT) AS FN
      FROM preds, mg WHERE Split = 'test' AND abs(proba_up - 0.5) >= Margin GROUP BY 1, 2
      HAVING count(*) >= 30),
m AS (SELECT c.*, n_all, {METRIC_SQL} FROM c JOIN tot USING (Model))
SELECT Model, Margin, TP, FP, TN, FN, N, Accuracy, F1_macro, CAST(N AS DOUBLE) / CAST(n_all AS DOUBLE) AS Coverage
FROM m""", dbl="Margin Accuracy F1_macro Coverage")
def q_confidence_curve(spark, sf):
    p = inputs.predictions(spark, sf).where(F.col("Split") == "test")
    c = ev.confidence_curve(p, ["Model"], MARGINS)
    return finish(c.select(*[x.strip() for x in CURVE_COLS.split(",")]))


@register("leaderboard", with_(PREDICTIONS) + f"""
, m AS (SELECT Model, Split, {METRIC_SQL} FROM ({counts_sql('preds', 'Model, Split')})),
a AS ({auc_sql('preds', 'Model, Split')})
SELECT Split, CAST(row_number() OVER (PARTITION BY Split ORDER BY F1_macro DESC, Accuracy DESC, AUC DESC NULLS LAST,
                                      Model) AS INTEGER) AS rank,
       Model, F1_macro, Accuracy, AUC
FROM m JOIN a USING (Model, Split)""", dbl="F1_macro Accuracy AUC")
def q_leaderboard(spark, sf):
    m = ev.metrics_and_auc(inputs.predictions(spark, sf), G)
    w = Window.partitionBy("Split").orderBy(F.col("F1_macro").desc(), F.col("Accuracy").desc(),
                                            F.col("AUC").desc_nulls_last(), "Model")
    return finish(m.select("Split", F.row_number().over(w).alias("rank"), "Model", "F1_macro", "Accuracy", "AUC"))


@register("ensemble_average", with_(PREDICTIONS) + f"""
, va AS ({auc_sql("preds WHERE Split = 'val'", 'Model')}),
top AS (SELECT Model FROM va QUALIFY row_number() OVER (ORDER BY AUC DESC NULLS LAST, Model) <= 2),
mem AS (SELECT 'ENS_ALL' AS Ensemble, Model FROM (SELECT DISTINCT Model FROM preds)
        UNION ALL SELECT 'ENS_TOP2', Model FROM top),
e AS (SELECT Ensemble, Split, o_orderkey, min(target) AS target,
             avg(round(proba_up * 1008)) / 1008.0 AS proba_up
      FROM preds JOIN mem USING (Model) GROUP BY 1, 2, 3),
m AS (SELECT Ensemble, Split, {METRIC_SQL} FROM ({counts_sql('e', 'Ensemble, Split')})),
a AS ({auc_sql('e', 'Ensemble, Split')})
SELECT Ensemble, Split, N, Accuracy, F1_macro, AUC FROM m JOIN a USING (Ensemble, Split)""",
          dbl="Accuracy F1_macro AUC")
def q_ensemble_average(spark, sf):
    p = inputs.predictions(spark, sf)
    va = ev.roc_auc(p.where(F.col("Split") == "val"), ["Model"])
    w = Window.orderBy(F.col("AUC").desc_nulls_last(), "Model")  # one row per model: tiny
    top = va.withColumn("__r", F.row_number().over(w)).where("__r <= 2").select(F.lit("ENS_TOP2").alias("Ensemble"), "Model")
    members = va.select(F.lit("ENS_ALL").alias("Ensemble"), "Model").unionByName(top)
    # average integer numerators (proba = k/1008) so the mean is exact in both engines;
    # target depends only on the order, so it rides along as a grouping key (no re-join)
    num = p.withColumn("proba_up", F.round(F.col("proba_up") * 1008))
    e = ev.ensemble_average(num, members, ["Split", "o_orderkey", "target"])
    e = e.withColumn("proba_up", F.col("proba_up") / F.lit(1008.0))
    m = ev.metrics_and_auc(e, ["Ensemble", "Split"])
    return finish(m.select("Ensemble", "Split", "N", "Accuracy", "F1_macro", "AUC"))


@register("calibrate_return", with_(BACKTEST) + """
SELECT series_id, count(*) AS n,
       CASE WHEN var_pop(predicted_return) <= 1e-12 THEN avg(actual_return)
            ELSE avg(actual_return) - covar_pop(actual_return, predicted_return) / var_pop(predicted_return)
                 * avg(predicted_return) END AS intercept,
       CASE WHEN var_pop(predicted_return) <= 1e-12 THEN 0.0
            ELSE covar_pop(actual_return, predicted_return) / var_pop(predicted_return) END AS slope
FROM bt_in WHERE target_date >= DATE '1999-01-01' AND target_date < DATE '2000-01-01'
GROUP BY 1""", dbl="intercept slope")
def q_calibrate_return(spark, sf):
    from tidewater.operators.backtest import calibrate_linear
    b = inputs.backtest_input(spark, sf)
    val = b.where((F.col("target_date") >= F.lit(inputs.TRAIN_END).cast("date")) &
                  (F.col("target_date") < F.lit(inputs.VAL_END).cast("date")))
    return finish(calibrate_linear(val, ["series_id"], "predicted_return", "actual_return"))


@register("artifact_status", with_(PREDICTIONS) + """
SELECT Experiment, regexp_replace(Model, '_th05$', '') AS Model,
       CAST(count_if(Split = 'train') AS BIGINT) AS n_train, CAST(count_if(Split = 'val') AS BIGINT) AS n_val,
       CAST(count_if(Split = 'test') AS BIGINT) AS n_test, count(DISTINCT date) AS n_dates
FROM preds GROUP BY 1, 2""")
def q_artifact_status(spark, sf):
    """Row counts per split and distinct dates per experiment and (suffix-stripped) model."""
    from tidewater.functions.scalar import strip_suffix
    p = inputs.predictions(spark, sf)
    return p.groupBy("Experiment", strip_suffix("Model").alias("Model")).agg(
        F.count_if(F.col("Split") == "train").alias("n_train"), F.count_if(F.col("Split") == "val").alias("n_val"),
        F.count_if(F.col("Split") == "test").alias("n_test"), F.count_distinct("date").alias("n_dates"))
