"""Registered queries: the remaining estimators, the ridge grid and subset comparison (rows-only checks)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import evaluate as ev
from tidewater.operators import learn as ln
from tidewater.plans import inputs
from tidewater.plans.q_learn import KEYS
from tidewater.plans.registry import finish, register
from tidewater.session import cut_lineage

CLASSIFIERS = {
    "linear_svm": {"regParam": 0.01, "maxIter": 20},
    "random_forest": {"numTrees": 20, "maxDepth": 4},
    "mlp": {"layers": [len(inputs.FEATURES), 8, 2], "maxIter": 30},
}
REGRESSORS = {
    "lasso": ("linreg", {"regParam": 0.0001, "elasticNetParam": 1.0}),
    "elastic_net": ("linreg", {"regParam": 0.0001, "elasticNetParam": 0.5}),
    "rf_reg": ("rf_reg", {"numTrees": 20, "maxDepth": 4}),
    "gbt_reg": ("gbt_reg", {"maxIter": 10, "maxDepth": 3}),
}
RIDGE = (0.01, 0.1, 1.0, 10.0)
SUBSETS = {"RETURNS": ["ret", "ret5"], "ACTIVITY": ["vol7", "n_orders"], "ALL_5": inputs.FEATURES}


@register("classifier_zoo")
def q_classifier_zoo(spark, sf):
    """Linear SVM (logistic of its decision value), random forest and MLP under one protocol."""
    fm = cut_lineage(inputs.feature_matrix(spark, sf))
    out = None
    for kind, params in CLASSIFIERS.items():
        rows, _ = ln.evaluate_candidate(fm, inputs.FEATURES, "direction", kind, KEYS, **params)
        out = rows if out is None else out.unionByName(rows)
    return finish(out)


@register("selective_rows")
def q_selective_rows(spark, sf):
    """A candidate's test metrics on the rows whose margin is large enough."""
    fm = inputs.feature_matrix(spark, sf)
    _, preds = ln.evaluate_candidate(fm, inputs.FEATURES, "direction", "logreg", KEYS, regParam=0.01)
    return finish(ev.confidence_curve(preds.where("Split = 'test'"), ["Model"], [0.0, 0.01, 0.02, 0.05], min_rows=30))


@register("regressor_zoo")
def q_regressor_zoo(spark, sf):
    """Regressors of the next return, ridge with its penalty picked by validation RMSE."""
    fm = cut_lineage(inputs.feature_matrix(spark, sf))
    train, rest = fm.where("split = 'train'"), fm.where("split <> 'train'")
    out = None

    def score(name, kind, params):
        model = ln.fit_model(train, inputs.FEATURES, "target_ret", kind, **params)
        p = ln.predict_proba(model, rest, kind, "predicted").withColumn("Model", F.lit(name))
        return ev.regression_metrics(p, ["Model", "split"], "target_ret", "predicted")

    for name, (kind, params) in REGRESSORS.items():
        rows = score(name, kind, params)
        out = rows if out is None else out.unionByName(rows)
    ridge = None
    for a in RIDGE:
        rows = score("ridge", "linreg", {"regParam": a, "elasticNetParam": 0.0}).withColumn("alpha", F.lit(a))
        ridge = rows if ridge is None else ridge.unionByName(rows)
    # one row per penalty and split
    best = Window.partitionBy("split").orderBy("RMSE", "alpha")
    alpha = ridge.where("split = 'val'").withColumn("k", F.row_number().over(best)).where("k = 1").select("alpha").scalar()
    chosen = ridge.where(F.col("alpha") == alpha)
    return finish(out.withColumn("alpha", F.lit(None).cast("double")).unionByName(chosen))


@register("subset_cv")
def q_subset_cv(spark, sf):
    """Feature subsets compared over the same expanding folds of the training period."""
    fm = cut_lineage(inputs.feature_matrix(spark, sf).where("split = 'train'"))
    out = None
    for name, features in SUBSETS.items():
        rows = ln.rolling_cv_search(fm, features, "direction", "logreg", {"regParam": [0.01]}, n_splits=2)
        rows = rows.withColumn("case", F.lit(name)).withColumn("n", F.lit(len(features)))
        out = rows if out is None else out.unionByName(rows)
    return finish(out)
