"""Model fitting on chronological splits with Spark MLlib (survey M09-M22, T-18).

A driver loop orchestrates MLlib fits (each fit is a distributed job); the
prediction table ``(Experiment, Model, Split, keys..., target, proba_up)``
is the intermediate result and every metric is computed by
``operators.evaluate`` in SQL.  All fitted state (imputer medians, scaler,
model) is learned on the rows selected by the caller, never on test rows.
"""

from __future__ import annotations

import functools
import itertools
import math
import zlib
from concurrent.futures import ThreadPoolExecutor
from typing import Sequence

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import Imputer, PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.joins import join_null_safe
from tidewater.functions.scalar import logistic
from tidewater.operators import evaluate as ev
from tidewater.operators.scan import prefix_sum
from tidewater.operators.stats import default_buckets
from tidewater.session import cut_lineage

__all__ = [
    "make_estimator", "feature_pipeline", "fit_model", "predict_proba", "evaluate_candidate", "rolling_cv_search", "random_search", "draw_params",
    "feature_importance", "dense_index", "permutation_importance", "stacking", "pca_variance", "save_bundle",
    "load_bundle", "date_folds",
]


def make_estimator(kind: str, label: str = "label", features: str = "features", weight: str | None = None,
                   seed: int = 42, **params):
    """Estimator by name with the label/feature/weight columns set."""
    common = dict(labelCol=label, featuresCol=features)
    if kind == "logreg":
        e = LogisticRegression(**common, maxIter=params.pop("maxIter", 100), **params)
    elif kind == "linear_svm":
        e = LinearSVC(**common, maxIter=params.pop("maxIter", 100), **params)
    elif kind == "random_forest":
        e = RandomForestClassifier(**common, seed=seed, **params)
    elif kind == "gbt":
        e = GBTClassifier(**common, seed=seed, **params)
    elif kind == "mlp":
        e = MultilayerPerceptronClassifier(**common, seed=seed, **params)
    elif kind == "linreg":
        e = LinearRegression(**common, **params)
    elif kind == "rf_reg":
        e = RandomForestRegressor(**common, seed=seed, **params)
    elif kind == "gbt_reg":
        e = GBTRegressor(**common, seed=seed, **params)
    else:
        raise ValueError(kind)
    if weight and e.hasParam("weightCol"):
        e.setWeightCol(weight)
    return e


def feature_pipeline(features: Sequence[str], scale: bool = True) -> list:
    """Median imputation (fitted on the fit rows) → vector → optional scaling."""
    feats = list(features)
    imp = [f"{c}__imp" for c in feats]
    stages = [Imputer(inputCols=feats, outputCols=imp, strategy="median"),
              VectorAssembler(inputCols=imp, outputCol="__raw" if scale else "features")]
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    return stages


def fit_model(train: DataFrame, features: Sequence[str], label: str, kind: str, weight: str | None = None,
              scale: bool = True, **params) -> PipelineModel:
    d = _labelled(train, label)
    est = make_estimator(kind, weight=weight, **params)
    return Pipeline(stages=feature_pipeline(features, scale) + [est]).fit(d)


def predict_proba(model, df: DataFrame, kind: str, out: str = "proba_up") -> DataFrame:
    """Probability of class 1; decision values go through the logistic map."""
    p = model.transform(df)
    if kind == "linear_svm":
        score = logistic(vector_to_array("rawPrediction")[1])
    elif kind in ("linreg", "rf_reg", "gbt_reg"):
        score = F.col("prediction")
    else:
        score = vector_to_array("probability")[1]
    keep = [c for c in df.columns]
    return p.select(*keep, score.alias(out))


def evaluate_candidate(df: DataFrame, features: Sequence[str], label: str, kind: str, keys: Sequence[str],
                       split: str = "split", name: str | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """Fit on train → best F1-macro threshold on val → refit on
    train+val → score test.  Returns (metric rows, prediction table)."""
    name = name or kind
    df = cut_lineage(df)  # read by every fit: files in the shared folder, no executor cache
    tr = df.where(F.col(split) == "train")
    m1 = fit_model(tr, features, label, kind, **params)
    val = predict_proba(m1, df.where(F.col(split) == "val"), kind).withColumn("target", F.col(label))
    sweep = ev.threshold_sweep(val, [])
    best = ev.best_threshold(sweep, []).select("best_threshold")
    m2 = fit_model(df.where(F.col(split).isin("train", "val")), features, label, kind, **params)
    test = predict_proba(m2, df.where(F.col(split) == "test"), kind).withColumn("target", F.col(label))
    preds = (val.withColumn("Split", F.lit("val")).unionByName(test.withColumn("Split", F.lit("test")))
             .withColumn("Model", F.lit(name)))
    # four reports read the predictions: both models score once
    preds = cut_lineage(join_null_safe(preds, best, []).select("Model", "Split", *keys, "target", "proba_up", "best_threshold"))
    at_best = ev.classification_metrics(preds, ["Model", "Split"], threshold=F.col("best_threshold")) \
        .withColumn("ThresholdMode", F.lit("val_best"))
    at_half = ev.classification_metrics(preds, ["Model", "Split"], threshold=0.5) \
        .withColumn("ThresholdMode", F.lit("fixed_0.5"))
    auc = ev.roc_auc(preds, ["Model", "Split"])
    rows = at_best.unionByName(at_half).join(auc, ["Model", "Split"])
    return rows, preds


def date_folds(df: DataFrame, date: str, n_splits: int = 5) -> DataFrame:
    """W27 on the panel's distinct dates (one row per date: bounded by the
    calendar): (date, fold, role) for an expanding-window split."""
    dates = df.select(date).distinct()
    w = Window.orderBy(date)  # distinct dates only
    d = dates.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy()))
    t = F.floor(F.col("__n") / F.lit(n_splits + 1))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    lo = F.col("__n") - (F.lit(n_splits) - F.col("fold")) * t
    role = F.when((F.col("__i") >= lo) & (F.col("__i") < lo + t), "test").when(F.col("__i") < lo, "train")
    return d.withColumn("role", role).where(F.col("role").isNotNull()).select(date, "fold", "role")


def rolling_cv_search(df: DataFrame, features: Sequence[str], label: str, kind: str, grid: dict,
                      date: str = "date", n_splits: int = 5) -> DataFrame:
    """Grid search scored by mean / std of F1-macro over
    expanding-window folds (CrossValidator's random folds would leak)."""
    return _search(df, features, label, kind, [dict(zip(grid, c)) for c in itertools.product(*grid.values())], date, n_splits)


def draw_params(distributions: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """Seeded draws of parameter sets: a distribution is ``("uniform", low, high)``, ``("loguniform", low, high)``,
    ``("int", low, high)`` (both ends included) or a list of values, each as likely."""
    rng = np.random.default_rng(seed)

    def draw(d):
        if isinstance(d, list):
            return d[int(rng.integers(len(d)))]
        kind, low, high = d
        if kind == "int":
            return int(rng.integers(low, high + 1))
        if kind == "loguniform":
            return float(math.exp(rng.uniform(math.log(low), math.log(high))))
        if kind == "uniform":
            return float(rng.uniform(low, high))
        raise ValueError(kind)

    return [{name: draw(d) for name, d in distributions.items()} for _ in range(n_iter)]


def random_search(df: DataFrame, features: Sequence[str], label: str, kind: str, distributions: dict, n_iter: int = 10, seed: int = 42,
                  date: str = "date", n_splits: int = 5, parallelism: int = 4) -> DataFrame:
    """Like ``rolling_cv_search`` over ``n_iter`` seeded draws from parameter distributions."""
    return _search(df, features, label, kind, draw_params(distributions, n_iter, seed), date, n_splits, parallelism)


def concurrently(spark, calls: Sequence, parallelism: int = 4) -> list:
    """Results of functions that run Spark jobs, in order, ``parallelism`` of them at a time."""
    with ThreadPoolExecutor(max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def _search(df: DataFrame, features: Sequence[str], label: str, kind: str, candidates: list[dict], date: str, n_splits: int,
            parallelism: int = 4) -> DataFrame:
    """Every candidate on every fold as concurrent jobs over one written table of folds.  A fold's preparation is fitted
    once for all candidates; its metric comes back as one number."""
    spark = df.sparkSession
    parts = cut_lineage(df.join(date_folds(df, date, n_splits), date))

    def prepared(k: int):
        part = parts.where(F.col("fold") == k)
        steps = Pipeline(stages=feature_pipeline(features)).fit(_labelled(part.where(F.col("role") == "train"), label))
        return cut_lineage(_labelled(steps.transform(part), label).select(label, "label", "role", "features"))

    folds = concurrently(spark, [functools.partial(prepared, k) for k in range(n_splits)], parallelism)

    def score(params: dict, k: int) -> float:
        m = make_estimator(kind, **params).fit(folds[k].where(F.col("role") == "train"))
        p = predict_proba(m, folds[k].where(F.col("role") == "test"), kind).withColumn("target", F.col(label))
        return ev.classification_metrics(p, []).select("F1_macro").first()[0]

    calls = [(c, k) for c in candidates for k in range(n_splits)]
    scores = concurrently(spark, [functools.partial(score, c, k) for c, k in calls], parallelism)
    rows = spark.createDataFrame([(str(c), v) for (c, _), v in zip(calls, scores)], "params string, F1_macro double")
    return rows.groupBy("params").agg(F.avg("F1_macro").alias("CV_F1_macro"), F.stddev_samp("F1_macro").alias("CV_F1_macro_std"),
                                      F.count(F.lit(1)).alias("folds"))


def _labelled(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double")).where(F.col("label").isNotNull())


def feature_importance(models: dict[str, PipelineModel], features: Sequence[str]) -> DataFrame:
    """Importances normalised per model, averaged over models, sorted."""
    rows = []
    for name, m in models.items():
        est = m.stages[-1]
        imp = est.featureImportances.toArray() if hasattr(est, "featureImportances") else None
        if imp is None:
            continue
        tot = float(imp.sum()) or 1.0
        rows += [(name, f, float(v) / tot) for f, v in zip(features, imp)]  # p values per model
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    t = s.createDataFrame(rows, "Model string, feature string, importance double")
    return t.groupBy("feature").agg(F.avg("importance").alias("importance")) \
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))


def dense_index(df: DataFrame, order: Column, out: str, buckets: int | None = None) -> DataFrame:
    """0-based dense position of each row in ``order`` (a double in [0,1)
    or any monotone key), computed with bucketed prefix counts — no global
    single-partition window.  ``buckets`` defaults to twice the session's
    shuffle partitions."""
    buckets = buckets or default_buckets(df)
    d = df.withColumn("__ord", order).withColumn("__cnt1", F.lit(1))
    b = F.floor(F.col("__ord") * F.lit(float(buckets))).cast("long")
    d = prefix_sum(d, [], ["__ord"], b, {out: "__cnt1"}, inclusive=False)
    return d.drop("__ord", "__cnt1")


def _hash01(cols: Sequence[str], seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])
    return (F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52)))


def permutation_importance(model: PipelineModel, kind: str, test: DataFrame, features: Sequence[str], label: str,
                           keys: Sequence[str], repeats: int = 3, seed: int = 42) -> DataFrame:
    """Accuracy drop when one feature's values are randomly permuted
    among the test rows; mean and std over ``repeats``.

    The permutation pairs the dense index of each row under a hash order of
    its keys with the dense index of the values under a seeded hash order.
    """
    test = cut_lineage(test)
    base_pred = predict_proba(model, test, kind).withColumn("target", F.col(label))
    base = ev.classification_metrics(base_pred, []).select(F.col("Accuracy").alias("__base"))
    rows_idx = dense_index(test, _hash01(keys, 7), "__pos")
    out = []
    for f in features:
        for r in range(repeats):
            vals = dense_index(test.select(*keys, f), _hash01(keys, seed + 1000 * r + zlib.crc32(f.encode()) % 997), "__pos") \
                .select("__pos", F.col(f).alias("__perm"))
            perm = rows_idx.join(vals, "__pos").drop(f, "__pos").withColumnRenamed("__perm", f)
            p = predict_proba(model, perm, kind).withColumn("target", F.col(label))
            acc = ev.classification_metrics(p, []).select(F.col("Accuracy").alias("__acc"))
            out.append(acc.withColumn("feature", F.lit(f)).withColumn("repeat", F.lit(r)))
    allr = out[0]
    for o in out[1:]:
        allr = allr.unionByName(o)
    allr = join_null_safe(allr, base, [])  # scalars
    drop = F.col("__base") - F.col("__acc")
    return allr.groupBy("feature").agg(F.avg(drop).alias("importance_mean"), F.stddev_samp(drop).alias("importance_std"))


def stacking(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str], date: str = "date",
             bases: Sequence[str] = ("logreg", "gbt"), n_splits: int = 5, split: str = "split") -> DataFrame:
    """Out-of-fold base probabilities on the training period (expanding
    folds), a logistic meta model on them, bases refit on all training rows,
    meta applied to the test rows.  Returns test predictions."""
    df = cut_lineage(df)
    spark, keys = df.sparkSession, list(keys)
    params = {"gbt": {"maxIter": 20, "maxDepth": 3}}
    train = df.where(F.col(split).isin("train", "val"))
    parts = cut_lineage(train.join(date_folds(train, date, n_splits), date))
    whole = df.withColumn("role", F.when(F.col(split) == "test", "test").otherwise("train")).where(F.col(split).isin("train", "val", "test"))

    def prepared(part: DataFrame) -> DataFrame:
        """Imputed and scaled by the part's training rows, once for all bases."""
        steps = Pipeline(stages=feature_pipeline(features)).fit(_labelled(part.where("role = 'train'"), label))
        return cut_lineage(steps.transform(part).select(*keys, label, "role", "features"))

    tables = concurrently(spark, [functools.partial(prepared, parts.where(F.col("fold") == k)) for k in range(n_splits)]
                          + [functools.partial(prepared, whole)])

    def scored(table: DataFrame, base: str) -> DataFrame:
        m = make_estimator(base, **params.get(base, {})).fit(_labelled(table.where("role = 'train'"), label))
        p = predict_proba(m, table.where("role = 'test'"), base, out="__p").select(*keys, label, "__p").withColumn("__base", F.lit(base))
        return cut_lineage(p)

    # one written column of probabilities a table and base; the bases of a row come together by its keys
    columns = concurrently(spark, [functools.partial(scored, t, b) for t in tables for b in bases])
    wide = lambda some: functools.reduce(DataFrame.unionByName, some).groupBy(*keys).agg(
        F.first(label).alias(label), *[F.max(F.when(F.col("__base") == b, F.col("__p"))).alias(f"p_{b}") for b in bases])
    n = len(bases)
    meta = fit_model(cut_lineage(wide(columns[:-n])), [f"p_{b}" for b in bases], label, "logreg", scale=False)
    return predict_proba(meta, wide(columns[-n:]), "logreg").withColumn("target", F.col(label))


def pca_variance(df: DataFrame, features: Sequence[str], thresholds=(0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """T-18: explained and cumulative variance of standardised features
    (complete rows) and the components needed per threshold."""
    feats = list(features)
    d = df.select(*[F.col(c).cast("double") for c in feats]).dropna()
    va = VectorAssembler(inputCols=feats, outputCol="__v").transform(d)
    sc = StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True).fit(va).transform(va)
    pca = PCA(k=len(feats), inputCol="__s", outputCol="__p").fit(sc)
    ev_ = [float(x) for x in pca.explainedVariance.toArray()]
    cum, rows = 0.0, []
    for i, v in enumerate(ev_):
        cum += v
        rows.append((i + 1, v, cum))
    s = df.sparkSession
    t = s.createDataFrame(rows, "component int, explained double, cumulative double")
    need = [(float(th), next((c for c, _, cu in rows if cu >= th - 1e-12), len(rows))) for th in thresholds]
    n = s.createDataFrame(need, "threshold double, components int")
    return join_null_safe(t, n.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("threshold", "components")))
                                             .alias("needed")), [])


def save_bundle(model: PipelineModel, path: str, meta: dict) -> None:
    """The fitted pipeline plus a sidecar JSON row (features, threshold…)."""
    import json
    model.write().overwrite().save(path + "/model")
    from pyspark.sql import SparkSession
    SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string") \
        .coalesce(1).write.mode("overwrite").json(path + "/meta")


def load_bundle(path: str) -> tuple[PipelineModel, dict]:
    """Load a saved bundle for batch scoring."""
    import json
    from pyspark.sql import SparkSession
    m = PipelineModel.load(path + "/model")
    meta = json.loads(SparkSession.getActiveSession().read.json(path + "/meta").first()["meta"])
    return m, meta
