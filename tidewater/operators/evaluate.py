"""Evaluation of probability predictions (survey E01-E13, M20).

Everything is an aggregate over a long prediction table
``(group..., label, score)``.  Global-order metrics (AUC, ROC, threshold
sweeps) first reduce rows to a histogram of distinct scores per group and
then scan that histogram, so no task ever sorts the raw rows of a group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import clip_prob
from tidewater.functions.joins import join_null_safe
from tidewater.operators.scan import prefix_sum

__all__ = [
    "confusion_counts", "metrics_from_counts", "classification_metrics", "score_histogram",
    "counts_from_histogram", "auc_from_histogram", "metrics_and_auc", "roc_auc", "logloss_brier",
    "roc_curve", "linspace_grid", "threshold_sweep", "best_threshold", "confidence_curve",
    "regression_metrics", "ensemble_average", "decision_log",
]


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def confusion_counts(df: DataFrame, group: Sequence[str], label: str = "target", score: str = "proba_up",
                     threshold=0.5) -> DataFrame:
    """TP/FP/TN/FN with ``pred = score >= threshold`` (threshold may be a column)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    return df.groupBy(*group).agg(
        F.count_if(pred & y).alias("TP"), F.count_if(pred & ~y).alias("FP"),
        F.count_if(~pred & ~y).alias("TN"), F.count_if(~pred & y).alias("FN"))


def metrics_from_counts(df: DataFrame, zero_division=0.0) -> DataFrame:
    """Accuracy, balanced accuracy, F1 (binary, macro), precision/recall
    per class, MCC, positive and target rate.  ``zero_division`` is the value
    of an undefined ratio (0.0 like scikit-learn, or None)."""
    tp, fp, tn, fn = (_d(c) for c in ("TP", "FP", "TN", "FN"))
    zd = F.lit(zero_division).cast("double")

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), zd)

    n = tp + fp + tn + fn
    cols = {
        "N": (F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN")).cast("long"),
        "Accuracy": ratio(tp + tn, n),
        "Precision_UP": ratio(tp, tp + fp), "Recall_UP": ratio(tp, tp + fn),
        "Precision_DOWN": ratio(tn, tn + fn), "Recall_DOWN": ratio(tn, tn + fp),
        "F1_binary": ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
        "F1_down": ratio(F.lit(2.0) * tn, F.lit(2.0) * tn + fn + fp),
        "MCC": F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
                          F.lit(0.0)),
        "PosRate": ratio(tp + fp, n), "TargetUpRate": ratio(tp + fn, n),
    }
    out = df.withColumns(cols)
    return out.withColumns({
        "F1_macro": (F.col("F1_binary") + F.col("F1_down")) / F.lit(2.0),
        "BalancedAcc": (F.col("Recall_UP") + F.col("Recall_DOWN")) / F.lit(2.0),
    }).drop("F1_down")


def classification_metrics(df: DataFrame, group: Sequence[str], label="target", score="proba_up",
                           threshold=0.5, zero_division=0.0) -> DataFrame:
    return metrics_from_counts(confusion_counts(df, group, label, score, threshold), zero_division)


def _histogram(df: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*group, score).agg(
        F.count_if(F.col(label) == 1).alias("__pos"), F.count_if(F.col(label) != 1).alias("__neg"))


def score_histogram(df: DataFrame, group: Sequence[str], label: str = "target", score: str = "proba_up") -> DataFrame:
    """Reduced form of a prediction table: (group, score, __pos, __neg).

    Confusion counts at any threshold and the AUC are both functions of this
    histogram, so branchy reports reduce once and share it instead of
    re-reading (or caching) the raw predictions."""
    return _histogram(df, list(group), label, score)


def counts_from_histogram(h: DataFrame, group: Sequence[str], score: str = "proba_up", threshold=0.5) -> DataFrame:
    """E01 from a score histogram: TP/FP/TN/FN with ``pred = score >= threshold``."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t

    def tot(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")

    return h.groupBy(*group).agg(tot(pred, "__pos").alias("TP"), tot(pred, "__neg").alias("FP"),
                                 tot(~pred, "__neg").alias("TN"), tot(~pred, "__pos").alias("FN"))


def auc_from_histogram(h: DataFrame, group: Sequence[str], score: str = "proba_up", bucket: Column | None = None,
                       out: str = "AUC") -> DataFrame:
    """E03 from a score histogram (see ``roc_auc``)."""
    group = list(group)
    if bucket is None:
        from tidewater.operators.stats import value_bucket
        h, b = value_bucket(h, group, score), F.col("__vb")
    else:
        b = bucket
    h = prefix_sum(h, group, [score], b, {"__neg_below": "__neg"}, inclusive=False)
    part = F.col("__pos").cast("double") * (F.col("__neg_below").cast("double") + F.col("__neg").cast("double") / 2.0)
    agg = h.groupBy(*group).agg(F.sum(part).alias("__num"), F.sum("__pos").alias("__np"), F.sum("__neg").alias("__nn"))
    return agg.select(*group, F.when((F.col("__np") > 0) & (F.col("__nn") > 0),
                                     F.col("__num") / (F.col("__np").cast("double") * F.col("__nn").cast("double")))
                      .alias(out))


def roc_auc(df: DataFrame, group: Sequence[str], label: str = "target", score: str = "proba_up",
            bucket: Column | None = None, out: str = "AUC") -> DataFrame:
    """ROC AUC by the tie-averaged rank sum; NULL when a class is absent.

    AUC = sum_v pos_v * (neg_below_v + neg_v / 2) / (n_pos * n_neg), evaluated
    on the distinct-score histogram.  ``neg_below`` is a running sum computed
    with ``prefix_sum`` over score buckets (default: approximate-quantile
    buckets of the group's scores), so one group's scores are spread over
    many tasks even when they crowd around one value.
    """
    return auc_from_histogram(_histogram(df, list(group), label, score), group, score, bucket, out)


def metrics_and_auc(df: DataFrame, group: Sequence[str], label: str = "target", score: str = "proba_up",
                    threshold=0.5, zero_division=0.0) -> DataFrame:
    """E01-E03 from one score histogram per group, which feeds both the
    confusion metrics and the AUC (equal exchanges are reused)."""
    group = list(group)
    h = score_histogram(df, group, label, score)
    m = metrics_from_counts(counts_from_histogram(h, group, score, threshold), zero_division)
    return join_null_safe(m, auc_from_histogram(h, group, score), group)


def logloss_brier(df: DataFrame, group: Sequence[str], label="target", score="proba_up",
                  eps: float = 1e-6) -> DataFrame:
    """Mean log loss and Brier score with probabilities clipped to [eps, 1-eps]."""
    p = clip_prob(score, eps)
    y = _d(label)
    ll = -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
    return df.groupBy(*group).agg(F.avg(ll).alias("LogLoss"), F.avg((p - y) * (p - y)).alias("Brier"))


def roc_curve(df: DataFrame, group: Sequence[str], label="target", score="proba_up",
              bucket: Column | None = None) -> DataFrame:
    """(fpr, tpr) at every distinct score, thresholds descending."""
    group = list(group)
    h = _histogram(df, group, label, score).withColumn("__ns", -F.col(score))
    if bucket is None:
        from tidewater.operators.stats import value_bucket
        h, b = value_bucket(h, group, "__ns"), F.col("__vb")
    else:
        b = bucket
    h = prefix_sum(h, group, ["__ns"], b, {"__tp": "__pos", "__fp": "__neg"}, inclusive=True)
    # totals: one row per group joined back, not a window over all distinct scores
    tot = _histogram(df, group, label, score).groupBy(*group).agg(F.sum("__neg").alias("__nn"), F.sum("__pos").alias("__np"))
    h = join_null_safe(h, tot, group)
    return h.select(*group, F.col(score).alias("threshold"),
                    F.try_divide(F.col("__fp").cast("double"), F.col("__nn").cast("double")).alias("fpr"),
                    F.try_divide(F.col("__tp").cast("double"), F.col("__np").cast("double")).alias("tpr"))


def linspace_grid(lo: float, hi: float, n: int) -> list[float]:
    """numpy-compatible ``linspace`` values: ``i * ((hi - lo) / (n - 1)) + lo``."""
    step = (hi - lo) / (n - 1)
    return [i * step + lo for i in range(n)]


def threshold_sweep(df: DataFrame, group: Sequence[str], label="target", score="proba_up",
                    lo: float = 0.30, hi: float = 0.70, n: int = 161, zero_division=0.0) -> DataFrame:
    """Confusion counts and metrics at every threshold of a regular grid.

    Instead of crossing rows with thresholds, each row is assigned the index
    of the largest grid threshold <= score (arithmetic with an exact
    correction against the grid values), counts are taken per
    (group, index, label) and suffix sums over the index give TP/FP at every
    threshold — O(rows + groups*n) work, independent of the grid size.
    """
    group = list(group)
    if not group:
        out = threshold_sweep(df.withColumn("__g", F.lit(1)), ["__g"], label, score, lo, hi, n, zero_division)
        return out.drop("__g")
    step = (hi - lo) / (n - 1)

    def grid(j):
        return j.cast("double") * F.lit(step) + F.lit(lo)

    p = F.col(score)
    j0 = F.floor((p - F.lit(lo)) / F.lit(step)).cast("long")
    j0 = F.least(F.greatest(j0, F.lit(-1)), F.lit(n - 1))
    j1 = (F.when((j0 + 1 <= n - 1) & (p >= grid(j0 + 1)), j0 + 1)
          .when((j0 >= 0) & (p < grid(j0)), j0 - 1).otherwise(j0))
    d = df.where(p.isNotNull()).withColumn("__j", j1)
    cnt = d.groupBy(*group, "__j").agg(F.count_if(F.col(label) == 1).alias("__pos"),
                                        F.count_if(F.col(label) != 1).alias("__neg"))
    # complete grid per group so every threshold has a row (groups x n rows)
    gkeys = cnt.select(*group).distinct()
    idx = gkeys.select(*group, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__j"))
    full = join_null_safe(idx, cnt.where(F.col("__j") >= 0), [*group, "__j"], "left").fillna(0, ["__pos", "__neg"])
    below = cnt.where(F.col("__j") < 0).groupBy(*group).agg(F.sum("__pos").alias("__bp"), F.sum("__neg").alias("__bn"))
    wsuf = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(F.col("__j").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumns({"TP": F.sum("__pos").over(wsuf), "FP": F.sum("__neg").over(wsuf)})
    tot = Window.partitionBy(*group) if group else Window.partitionBy()
    full = join_null_safe(full, below, group, "left").fillna(0, ["__bp", "__bn"])
    full = full.withColumns({
        "FN": F.sum("__pos").over(tot) + F.col("__bp") - F.col("TP"),
        "TN": F.sum("__neg").over(tot) + F.col("__bn") - F.col("FP"),
        "threshold": grid(F.col("__j")),
    })
    out = metrics_from_counts(full.select(*group, "__j", "threshold", "TP", "FP", "TN", "FN"), zero_division)
    return out


def best_threshold(sweep: DataFrame, group: Sequence[str], metric: str = "F1_macro") -> DataFrame:
    """First maximum of ``metric`` (lowest threshold wins ties)."""
    return sweep.groupBy(*group).agg(
        F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).alias("best_threshold"),
        F.max(metric).alias(f"best_{metric}"))


def confidence_curve(df: DataFrame, group: Sequence[str], margins: Sequence[float], label="target",
                     score="proba_up", min_rows: int = 30, threshold: float = 0.5) -> DataFrame:
    """Metrics on rows with ``|p - 0.5| >= margin`` for each margin,
    skipped below ``min_rows`` rows.  Rows are bucketed by how many margins
    they pass; suffix sums over that bucket give the counts per margin."""
    group = list(group)
    if not group:
        out = confidence_curve(df.withColumn("__g", F.lit(1)), ["__g"], margins, label, score, min_rows, threshold)
        return out.drop("__g")
    ms = sorted(float(m) for m in margins)
    arr = F.array(*[F.lit(m) for m in ms])
    dist = F.abs(F.col(score) - F.lit(threshold))
    d = df.where(F.col(score).isNotNull()).withColumn("__j", F.size(F.filter(arr, lambda m: m <= dist)) - 1)
    pred = F.col(score) >= F.lit(threshold)
    y = F.col(label) == 1
    cnt = d.where(F.col("__j") >= 0).groupBy(*group, "__j").agg(
        F.count_if(pred & y).alias("__tp"), F.count_if(pred & ~y).alias("__fp"),
        F.count_if(~pred & ~y).alias("__tn"), F.count_if(~pred & y).alias("__fn"))
    total = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__all"))
    idx = total.select(*group, "__all", F.posexplode(arr).alias("__j", "Margin"))
    full = join_null_safe(idx, cnt, [*group, "__j"], "left").fillna(0, ["__tp", "__fp", "__tn", "__fn"])
    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(F.col("__j").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    full = full.select(*group, "Margin", "__all", *[F.sum(f"__{c.lower()}").over(w).alias(c) for c in ("TP", "FP", "TN", "FN")])
    full = full.where((F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN")) >= min_rows)
    out = metrics_from_counts(full)
    return out.withColumn("Coverage", F.col("N").cast("double") / F.col("__all").cast("double")).drop("__all")


def regression_metrics(df: DataFrame, group: Sequence[str], y: str, yhat: str) -> DataFrame:
    """MAE, RMSE, R2 = 1 - SSE/SST, MAPE over y != 0, directional accuracy, over
    the rows that have both y and a prediction.  SST is the population variance
    times the count, which does not cancel for large y."""
    df = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    e = _d(yhat) - _d(y)
    sst = F.var_pop(_d(y)) * F.count(F.lit(1)).cast("double")
    return df.groupBy(*group).agg(
        F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), sst)).alias("R2"),
        F.avg(F.when(F.col(y) != 0, F.abs(F.try_divide(e, _d(y))))).alias("MAPE"),
        F.avg((F.signum(y) == F.signum(yhat)).cast("double")).alias("DirAcc"),
        F.count(F.lit(1)).alias("N"))


def ensemble_average(preds: DataFrame, members: DataFrame, keys: Sequence[str], model: str = "Model",
                     score: str = "proba_up", name_col: str = "Ensemble") -> DataFrame:
    """Soft-voting ensembles.  ``members`` is a small table
    (Ensemble, Model) naming the members of each ensemble; it is joined on
    the model name and the probabilities averaged per key."""
    j = preds.join(F.broadcast(members), model)  # members: one row per (ensemble, model) — tiny
    return j.groupBy(name_col, *keys).agg(F.avg(score).alias(score), F.count(F.lit(1)).alias("n_members"))


def decision_log(preds: DataFrame, keys: Sequence[str], order: str, label="target", score="proba_up",
                 threshold: float = 0.5) -> DataFrame:
    """First row per group of ``keys`` (in ``order``) with its decision, correctness and margin."""
    rest = [c for c in preds.columns if c not in keys]
    d = preds.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__first")).select(*keys, "__first.*")
    pred = (F.col(score) >= threshold).cast("int")
    return d.withColumns({"decision": F.when(pred == 1, "UP").otherwise("DOWN"),
                          "correct": (pred == F.col(label)).cast("int"),
                          "margin": F.abs(F.col(score) - F.lit(threshold))})
