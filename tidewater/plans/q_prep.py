"""Registered queries: leak-safe scalers and nearest-neighbour scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import neighbors as nb
from tidewater.operators import prep
from tidewater.plans import inputs
from tidewater.plans.registry import FEATURES_SQL, finish, register, with_
from tidewater.session import read_table

def TRAIN_ROWS():
    return F.col("split") == "train"


@register("minmax_train", with_(FEATURES_SQL) + """,
p AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM fl WHERE split = 'train' GROUP BY 1)
SELECT series_id, date, feature, value,
       CASE WHEN value IS NULL THEN NULL WHEN hi - lo IS NULL OR hi - lo = 0 THEN 0.0
            ELSE (value - lo) / (hi - lo) END AS scaled
FROM fl LEFT JOIN p USING (feature)""", dbl="value scaled")
def q_minmax_train(spark, sf):
    lg = inputs.feature_long(spark, sf)
    out = prep.apply_minmax(lg, prep.fit_minmax(lg, TRAIN_ROWS()))
    return finish(out.select("series_id", "date", "feature", "value", "scaled"))


@register("robust_scale", with_(FEATURES_SQL) + """,
p AS (SELECT feature, quantile_cont(value, 0.5) AS med,
             CASE WHEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) = 0 THEN 1.0
                  ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END AS iqr
      FROM fl WHERE split = 'train' GROUP BY 1)
SELECT series_id, date, feature, (value - med) / iqr AS scaled FROM fl LEFT JOIN p USING (feature)""", dbl="scaled")
def q_robust_scale(spark, sf):
    lg = inputs.feature_long(spark, sf)
    out = prep.apply_robust(lg, prep.fit_robust(lg, TRAIN_ROWS()))
    return finish(out.select("series_id", "date", "feature", "scaled"))


@register("standard_scale", with_(FEATURES_SQL) + """,
p AS (SELECT feature, avg(value) AS m,
             CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE stddev_pop(value) END AS s
      FROM fl WHERE split = 'train' GROUP BY 1)
SELECT series_id, date, feature, (value - m) / s AS scaled FROM fl LEFT JOIN p USING (feature)""", dbl="scaled")
def q_standard_scale(spark, sf):
    lg = inputs.feature_long(spark, sf)
    out = prep.apply_standard(lg, prep.fit_standard(lg, TRAIN_ROWS()))
    return finish(out.select("series_id", "date", "feature", "scaled"))


@register("median_impute", with_(FEATURES_SQL) + """,
fa AS (SELECT series_id, date, split, feature, value
       FROM fm UNPIVOT INCLUDE NULLS (value FOR feature IN (ret, ret5, vol7, n_orders, close_z))),
p AS (SELECT feature, quantile_cont(value, 0.5) AS med FROM fa WHERE split = 'train' AND value IS NOT NULL GROUP BY 1)
SELECT series_id, date, feature, CAST(coalesce(value, med, 0.0) AS DOUBLE) AS imputed,
       CAST(value IS NULL AS INTEGER) AS was_missing
FROM fa LEFT JOIN p USING (feature)""", dbl="imputed")
def q_median_impute(spark, sf):
    from tidewater.operators.quality import to_long
    fm = inputs.feature_matrix(spark, sf)
    lg = to_long(fm, ["series_id", "date", "split"], inputs.FEATURES, keep_nulls=True)
    out = prep.apply_impute(lg, prep.fit_median(lg, TRAIN_ROWS()))
    return finish(out.select("series_id", "date", "feature", "imputed", "was_missing"))


@register("yeo_johnson")
def q_yeo_johnson(spark, sf):
    """Grid-MLE lambda per feature (train rows) and standardised output;
    rows-only (no SQL optimiser to compare against)."""
    lg = inputs.feature_long(spark, sf)
    params = prep.fit_yeo_johnson(lg, TRAIN_ROWS())
    return finish(prep.apply_yeo_johnson(lg, params).select("series_id", "date", "feature", "scaled"))


KNN_SQL = """
e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
refs AS (SELECT vec_id, label, dim, CAST(x AS DOUBLE) AS x FROM e),
qs AS (SELECT vec_id, dim, CAST(x AS DOUBLE) AS x FROM e WHERE vec_id % 20 = 0),
st AS (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1.0 ELSE stddev_pop(x) END AS s FROM refs GROUP BY dim),
d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, any_value(r.label) AS label,
             sqrt(avg(((q.x - st.m) / st.s - (r.x - st.m) / st.s) * ((q.x - st.m) / st.s - (r.x - st.m) / st.s)))
               AS distance
      FROM qs q JOIN refs r ON q.dim = r.dim AND q.vec_id <> r.vec_id JOIN st ON st.dim = q.dim GROUP BY 1, 2),
top AS (SELECT *, 1.0 / greatest(distance, 0.05) AS w, CAST(label >= 1 AS DOUBLE) AS y FROM d
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) <= 5)"""


def _every_twentieth(spark, sf):
    """All vectors as references, and those with vec_id divisible by 20 as queries; a query's own row is not its neighbour."""
    refs = read_table(spark, sf, "embeddings").withColumn("outcome", (F.col("label") >= 1).cast("int"))
    qs = refs.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("own_id"), "embedding")
    return refs, qs


@register("knn_score", with_(KNN_SQL) + """
SELECT query_id, sum(w * y) / sum(w) AS score, count(*) AS k, avg(distance) AS mean_distance FROM top GROUP BY 1""",
          dbl="score mean_distance")
def q_knn_score(spark, sf):
    refs, qs = _every_twentieth(spark, sf)
    return finish(nb.knn_score(refs, qs, 5, "vec_id", "embedding", "outcome", self_id="own_id"))


@register("knn_neighbors", with_(KNN_SQL) + """
SELECT query_id, ref_id AS vec_id, distance, CAST(y AS INTEGER) AS outcome,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS INTEGER) AS rank FROM top""",
          dbl="distance")
def q_knn_neighbors(spark, sf):
    refs, qs = _every_twentieth(spark, sf)
    return finish(nb.knn_topk(refs, qs, 5, "vec_id", "embedding", "outcome", self_id="own_id"))


@register("loo_attribution")
def q_loo_attribution(spark, sf):
    """Rows-only here; tests/ compares it with a NumPy brute force."""
    refs, qs = _every_twentieth(spark, sf)
    return finish(nb.loo_attribution(refs, qs, 5, "vec_id", "embedding", "outcome", self_id="own_id"))


@register("local_surrogate")
def q_local_surrogate(spark, sf):
    """Kernel-weighted ridge surrogate around each query vector; rows-only."""
    refs, qs = _every_twentieth(spark, sf)
    return finish(nb.local_surrogate(refs, qs, "vec_id", "embedding", "outcome", self_id="own_id"))


# Scaler per feature (column-group preprocessor), others standard.
SCALER_OF = {"ret": "robust", "ret5": "robust", "vol7": "minmax", "n_orders": "minmax", "close_z": "passthrough"}


def _grouped_sql() -> str:
    case = "CASE " + " ".join(f"WHEN feature = '{f}' THEN '{s}'" for f, s in SCALER_OF.items()) + " ELSE 'standard' END"
    return with_(FEATURES_SQL) + f""",
a AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi,
             quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3,
             {case} AS scaler
      FROM fl WHERE split = 'train' GROUP BY 1),
p AS (SELECT feature, scaler,
             CASE scaler WHEN 'standard' THEN m WHEN 'robust' THEN q2 WHEN 'minmax' THEN lo ELSE 0.0 END AS loc,
             CASE scaler WHEN 'standard' THEN CASE WHEN s = 0 THEN 1.0 ELSE s END
                         WHEN 'robust' THEN CASE WHEN q3 - q1 = 0 THEN 1.0 ELSE q3 - q1 END
                         WHEN 'minmax' THEN CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END ELSE 1.0 END AS scale
      FROM a),
sc AS (SELECT fl.series_id, fl.date, fl.split, fl.feature, fl.value, p.scaler, (fl.value - p.loc) / p.scale AS scaled
       FROM fl LEFT JOIN p USING (feature))"""


@register("grouped_scaling", _grouped_sql() + "\nSELECT series_id, date, feature, scaler, scaled FROM sc",
          dbl="scaled")
def q_grouped_scaling(spark, sf):
    """Per-feature scaler chosen by a column-group table, fitted on train only."""
    lg = inputs.feature_long(spark, sf)
    out = prep.apply_grouped(lg, prep.fit_grouped(lg, SCALER_OF, TRAIN_ROWS()))
    return finish(out.select("series_id", "date", "feature", "scaler", "scaled"))


@register("processing_report", _grouped_sql() + """
SELECT feature, any_value(scaler) AS scaler, skewness(value) AS skew_before, skewness(scaled) AS skew_after,
       CASE WHEN abs(skewness(value)) > 1.0 THEN 'power' ELSE 'standard' END AS suggested
FROM sc GROUP BY 1""", dbl="skew_before skew_after")
def q_processing_report(spark, sf):
    """Sample skewness before and after the grouped scaling, with a suggested scaler."""
    from tidewater.operators.quality import sample_skew_kurt
    lg = inputs.feature_long(spark, sf)
    sc = prep.apply_grouped(lg, prep.fit_grouped(lg, SCALER_OF, TRAIN_ROWS()))
    a = sc.groupBy("feature").agg(F.first("scaler").alias("scaler"), F.count("value").alias("__n"),
                                  F.skewness("value").alias("__b"), F.skewness("scaled").alias("__a"))
    b, _ = sample_skew_kurt(F.col("__n"), F.col("__b"), F.lit(0.0))
    a_, _ = sample_skew_kurt(F.col("__n"), F.col("__a"), F.lit(0.0))
    r = a.select("feature", "scaler", b.alias("skew_before"), a_.alias("skew_after"))
    return finish(r.withColumn("suggested", F.when(F.abs("skew_before") > 1.0, "power").otherwise("standard")))


@register("mean_impute_names", with_(FEATURES_SQL) + """,
mu AS (SELECT """ + ", ".join(f"avg({f}) AS m_{f}" for f in inputs.FEATURES) + """ FROM fm WHERE split = 'train')
SELECT series_id, date, """ + ", ".join(f"coalesce({f}, m_{f}) AS {f}" for f in inputs.FEATURES) + """,
       coalesce(concat_ws('|', """ + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in inputs.FEATURES) + """), '')
         AS imputed
FROM fm, mu WHERE split = 'test'""", dbl=" ".join(inputs.FEATURES))
def q_mean_impute_names(spark, sf):
    """test rows with missing features filled by train means, plus the imputed names."""
    from tidewater.operators.quality import to_long
    fm = inputs.feature_matrix(spark, sf)
    lg = to_long(fm, ["series_id", "date", "split"], inputs.FEATURES, keep_nulls=True)
    fit = F.col("split") == "train"
    w = prep.impute_with_names(lg.where(fit | (F.col("split") == "test")), ["series_id", "date", "split"],
                               inputs.FEATURES, fit_where=fit)
    t = w.where(F.col("split") == "test")
    return finish(t.select("series_id", "date", *inputs.FEATURES, F.array_join("imputed", "|").alias("imputed")))
