"""Registered queries: MLlib fits on the chronological feature matrix (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.joins import join_null_safe
from tidewater.operators import evaluate as ev
from tidewater.operators import learn as ln
from tidewater.plans import inputs
from tidewater.plans.registry import finish, register

KEYS = ["series_id", "date"]
GBT = {"maxIter": 20, "maxDepth": 3}


@register("logreg_fit_score")
def q_logreg_fit_score(spark, sf):
    """Logistic regression, threshold tuned on val, refit, test."""
    fm = inputs.feature_matrix(spark, sf)
    rows, _ = ln.evaluate_candidate(fm, inputs.FEATURES, "direction", "logreg", KEYS, regParam=0.01)
    return finish(rows)


@register("gbt_fit_score")
def q_gbt_fit_score(spark, sf):
    """Gradient-boosted trees, same protocol."""
    fm = inputs.feature_matrix(spark, sf)
    rows, _ = ln.evaluate_candidate(fm, inputs.FEATURES, "direction", "gbt", KEYS, **GBT)
    return finish(rows)


@register("stacking")
def q_stacking(spark, sf):
    """OOF stacking of logistic regression and GBT with a logistic meta model."""
    fm = inputs.feature_matrix(spark, sf)
    p = ln.stacking(fm, inputs.FEATURES, "direction", KEYS, n_splits=3)
    m = join_null_safe(ev.classification_metrics(p, []), ev.roc_auc(p, []), [])
    return finish(m)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """Accuracy drop per permuted feature on the test split."""
    fm = inputs.feature_matrix(spark, sf)
    model = ln.fit_model(fm.where(F.col("split") == "train"), inputs.FEATURES, "direction", "gbt", **GBT)
    return finish(ln.permutation_importance(model, "gbt", fm.where(F.col("split") == "test"), inputs.FEATURES,
                                            "direction", KEYS, repeats=2))


@register("feature_importance")
def q_feature_importance(spark, sf):
    """Normalised tree importances averaged over RF and GBT."""
    fm = inputs.feature_matrix(spark, sf).where(F.col("split") == "train")
    models = {"rf": ln.fit_model(fm, inputs.FEATURES, "direction", "random_forest", numTrees=20, maxDepth=4),
              "gbt": ln.fit_model(fm, inputs.FEATURES, "direction", "gbt", **GBT)}
    return finish(ln.feature_importance(models, inputs.FEATURES))


@register("cv_search")
def q_cv_search(spark, sf):
    """Regularisation grid scored on expanding-window folds of the training period."""
    fm = inputs.feature_matrix(spark, sf).where(F.col("split") == "train")
    return finish(ln.rolling_cv_search(fm, inputs.FEATURES, "direction", "logreg",
                                       {"regParam": [0.0, 0.1]}, n_splits=3))


@register("random_search")
def q_random_search(spark, sf):
    """Seeded draws of the penalty and its mix, scored on expanding-window folds by concurrent fits."""
    fm = inputs.feature_matrix(spark, sf).where(F.col("split") == "train")
    return finish(ln.random_search(fm, inputs.FEATURES, "direction", "logreg",
                                   {"regParam": ("loguniform", 1e-4, 1.0), "elasticNetParam": [0.0, 0.5, 1.0]}, n_iter=4, n_splits=3))


@register("pca_variance")
def q_pca_variance(spark, sf):
    """T-18: explained / cumulative variance and components per threshold."""
    return finish(ln.pca_variance(inputs.feature_matrix(spark, sf), inputs.FEATURES))
