"""Registered queries: stationarity tests, PACF, Q-Q points, overview and
recommendation tables, redundancy, lag audit, sweeps across splits, sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import backtest as bt
from tidewater.operators import features as ft
from tidewater.operators import quality as qa
from tidewater.operators import reshape as rs
from tidewater.operators import stats as st
from tidewater.plans import inputs
from tidewater.plans.q_backtest import COST, _metrics_sql, _sim_sql
from tidewater.plans.q_profile import KS_SQL
from tidewater.plans.registry import BACKTEST, FEATURES_SQL, PANEL, RETURNS, finish, register, with_

W = "PARTITION BY series_id ORDER BY date"


@register("kpss_test", with_(RETURNS) + f""",
k1 AS (SELECT series_id, date, ret - avg(ret) OVER (PARTITION BY series_id) AS e,
              count(*) OVER (PARTITION BY series_id) AS n, row_number() OVER ({W}) AS rn
       FROM rp WHERE ret IS NOT NULL),
k2 AS (SELECT *, sum(e) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
              CAST(floor(12.0 * pow(CAST(n AS DOUBLE) / 100.0, 0.25)) AS INTEGER) AS l FROM k1),
base AS (SELECT series_id, any_value(n) AS n, any_value(l) AS lags, sum(s * s) AS ss, sum(e * e) AS g0
         FROM k2 GROUP BY 1),
ak AS (SELECT series_id, rn, e, l, unnest(range(1, l + 1)) AS k FROM k2),
g AS (SELECT ak.series_id, ak.k, sum(ak.e * b.e) AS gk, any_value(ak.l) AS l
      FROM ak JOIN k2 b ON b.series_id = ak.series_id AND b.rn = ak.rn - ak.k GROUP BY 1, 2),
ws AS (SELECT series_id, sum((1.0 - k / (l + 1.0)) * gk) AS wg FROM g GROUP BY 1),
r AS (SELECT base.*, coalesce(wg, 0.0) AS wg FROM base LEFT JOIN ws USING (series_id))
SELECT series_id, n, lags,
       ss / (CAST(n AS DOUBLE) * CAST(n AS DOUBLE)) / ((g0 + 2.0 * wg) / CAST(n AS DOUBLE)) AS kpss_stat,
       CAST(ss / (CAST(n AS DOUBLE) * CAST(n AS DOUBLE)) / ((g0 + 2.0 * wg) / CAST(n AS DOUBLE)) < 0.463 AS INTEGER)
         AS stationary_5pct
FROM r""", dbl="kpss_stat")
def q_kpss_test(spark, sf):
    """T-14: KPSS level test of daily returns per series."""
    return finish(st.kpss_level(inputs.returns_panel(spark, sf), "ret"))


ADF_SQL = """
a0 AS (SELECT {keys}, date, {x} AS x, lag({x}) OVER (PARTITION BY {keys} ORDER BY date) AS x1 FROM {rows}),
a1 AS (SELECT *, x - x1 AS dy FROM a0),
a2 AS (SELECT *, lag(dy) OVER (PARTITION BY {keys} ORDER BY date) AS dy1 FROM a1),
a3 AS (SELECT * FROM a2 WHERE dy IS NOT NULL AND x1 IS NOT NULL AND dy1 IS NOT NULL),
a4 AS (SELECT {keys}, count(*) AS n, regr_slope(dy, dy1) AS b_y, regr_slope(x1, dy1) AS b_x, avg(dy) AS my, avg(x1) AS mx, avg(dy1) AS md
       FROM a3 GROUP BY ALL),
a5 AS (SELECT {keys}, n, dy - my - b_y * (dy1 - md) AS ey, x1 - mx - b_x * (dy1 - md) AS ex FROM a3 JOIN a4 USING ({keys})),
a6 AS (SELECT {keys}, any_value(n) AS n, sum(ex * ey) AS sxy, sum(ex * ex) AS sxx, sum(ey * ey) AS syy FROM a5 GROUP BY ALL),
adf AS (SELECT {keys}, n, sxy / sxx AS adf_gamma, sxy / sxx / sqrt((syy - sxy * sxy / sxx) / (n - 3) / sxx) AS adf_stat FROM a6)"""


@register("adf_test", with_(PANEL) + "," + ADF_SQL.format(keys="series_id", x="close", rows="panel") + """
SELECT series_id, n, adf_gamma, adf_stat, coalesce(CAST(adf_stat < -2.86 AS INTEGER), 0) AS stationary_5pct FROM adf""", dbl="adf_gamma adf_stat")
def q_adf_test(spark, sf):
    """T-13 (re-aimed): fixed-lag Dickey-Fuller t statistic of the close level per series."""
    return finish(st.adf_fixed_lag(inputs.daily_panel(spark, sf), "close"))


def _cdf(z: str) -> str:
    """The normal distribution by the fixed rational erfc, in SQL."""
    t = f"(1.0 / (1.0 + 0.5 * abs({z}) / sqrt(2.0)))"
    poly = "::DOUBLE + ".join(f"{c} * pow({t}, {i})" for i, c in enumerate(st.ERFC))
    half = f"least(1.0, {t} * exp(-{z} * {z} / 2.0 + {poly})) / 2.0"
    return f"CASE WHEN {z} > 0 THEN 1.0 - {half} ELSE {half} END"


def _surface(c: tuple) -> str:
    return _cdf("(" + " + ".join(f"{a}::DOUBLE * pow(adf_stat, {i})" for i, a in enumerate(c)) + ")")


@register("stationarity_verdict", with_(RETURNS) + """,
lv AS (SELECT series_id, date, 'close' AS feature, CAST(close AS DOUBLE) AS v FROM rp UNION ALL SELECT series_id, date, 'ret', ret FROM rp WHERE ret IS NOT NULL
       UNION ALL SELECT series_id, date, 'flat', 1.0 FROM rp),
vv AS (SELECT * FROM lv WHERE feature <> 'flat'),""" + ADF_SQL.format(keys="series_id, feature", x="v", rows="vv") + """,
k1 AS (SELECT series_id, feature, v - avg(v) OVER p AS e, count(*) OVER p AS n, row_number() OVER (PARTITION BY series_id, feature ORDER BY date) AS rn
       FROM vv WINDOW p AS (PARTITION BY series_id, feature)),
k2 AS (SELECT *, sum(e) OVER (PARTITION BY series_id, feature ORDER BY rn ROWS UNBOUNDED PRECEDING) AS s,
              CAST(floor(12.0 * pow(n / 100.0, 0.25)) AS INTEGER) AS l FROM k1),
k3 AS (SELECT series_id, feature, any_value(n) AS n, sum(s * s) AS ss, sum(e * e) AS g0 FROM k2 GROUP BY 1, 2),
k4 AS (SELECT a.series_id, a.feature, sum(a.e * b.e * (1.0 - (a.rn - b.rn) / (a.l + 1.0))) AS wg
       FROM k2 a JOIN k2 b ON a.series_id = b.series_id AND a.feature = b.feature AND b.rn BETWEEN a.rn - a.l AND a.rn - 1 GROUP BY 1, 2),
kpss AS (SELECT series_id, feature, ss / n / (g0 + 2.0 * wg) AS kpss_stat FROM k3 JOIN k4 USING (series_id, feature)),
pv AS (SELECT series_id, feature, adf_stat, CASE WHEN adf_stat > 2.74 THEN 1.0 WHEN adf_stat < -18.83 THEN 0.0 WHEN adf_stat <= -1.61 THEN """
          + _surface(st.ADF_SMALL_P) + " ELSE " + _surface(st.ADF_LARGE_P) + """ END AS adf_p, kpss_stat,
              CASE WHEN kpss_stat <= 0.347 THEN 0.1 WHEN kpss_stat <= 0.463 THEN 0.1 - (kpss_stat - 0.347) / 0.116 * 0.05
                   WHEN kpss_stat <= 0.574 THEN 0.05 - (kpss_stat - 0.463) / 0.111 * 0.025 WHEN kpss_stat <= 0.739 THEN 0.025 - (kpss_stat - 0.574) / 0.165 * 0.015
                   ELSE 0.01 END AS kpss_p
       FROM adf JOIN kpss USING (series_id, feature))
SELECT series_id, feature, count(v) AS n, any_value(adf_stat) AS adf_stat, any_value(CAST(adf_p AS DOUBLE)) AS adf_p, any_value(kpss_stat) AS kpss_stat,
       any_value(CAST(kpss_p AS DOUBLE)) AS kpss_p,
       CASE WHEN feature = 'flat' THEN 'Constant' WHEN any_value(adf_p) < 0.05 THEN CASE WHEN any_value(kpss_p) < 0.05 THEN 'Trend-stationary' ELSE 'Stationary' END
            WHEN any_value(kpss_p) < 0.05 THEN 'NON-STATIONARY' ELSE 'Uncertain' END AS verdict
FROM lv LEFT JOIN pv USING (series_id, feature) GROUP BY series_id, feature""", dbl="adf_stat adf_p kpss_stat kpss_p")
def q_stationarity_verdict(spark, sf):
    """T-13/T-14: both tests with p-values and the verdict, for levels, returns and a constant of every series."""
    p = inputs.returns_panel(spark, sf).select("series_id", "date", F.col("close").cast("double").alias("close"), "ret", F.lit(1.0).alias("flat"))
    long = p.unpivot(["series_id", "date"], ["close", "ret", "flat"], "feature", "v").where("v IS NOT NULL")
    return finish(st.stationarity_verdict(long, "v", ["series_id", "feature"]))


@register("feature_clusters")
def q_feature_clusters(spark, sf):
    """T-12: average-linkage clusters of correlated features and the best member of each; tests compare with plain agglomeration."""
    from tidewater.plans.q_profile import q_feature_score
    from tidewater.plans.q_reports import q_corr_top_pairs
    return st.feature_clusters(q_corr_top_pairs(spark, sf), q_feature_score(spark, sf), 0.3)


@register("pacf")
def q_pacf(spark, sf):
    """T-15: PACF (Durbin-Levinson) of daily returns, lags 1..20; rows-only check."""
    acf = ft.autocorrelation(inputs.returns_panel(spark, sf), "ret", 20)
    return finish(st.pacf_from_acf(acf))


@register("qq_points")
def q_qq_points(spark, sf):
    """T-19: normal Q-Q points per feature (train rows); rows-only check."""
    lg = inputs.feature_long(spark, sf).where(F.col("split") == "train")
    return finish(st.qq_points(lg, ["feature"], "value"))


@register("corr_prune")
def q_corr_prune(spark, sf):
    """T-12 (re-aimed): greedy pruning of correlated features by research score; rows-only."""
    from tidewater.plans.q_profile import q_feature_score
    from tidewater.plans.q_reports import q_corr_top_pairs
    return st.greedy_prune(q_corr_top_pairs(spark, sf), q_feature_score(spark, sf), 0.7)


@register("data_overview", with_(FEATURES_SQL) + KS_SQL + """,
fa AS (SELECT series_id, date, split, direction, feature, value
       FROM fm UNPIVOT INCLUDE NULLS (value FOR feature IN (ret, ret5, vol7, n_orders, close_z))),
qq AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS nn
      FROM fa GROUP BY 1),
oo AS (SELECT fa.feature,
             CASE WHEN any_value(nn) < 10 OR any_value(q3 - q1) = 0 THEN 0.0
                  ELSE CAST(count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS DOUBLE)
                       / CAST(any_value(nn) AS DOUBLE) END AS outlier_pct_iqr
      FROM fa JOIN qq USING (feature) GROUP BY 1),
pp AS (SELECT feature, 100.0 * CAST(count_if(value IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS missing_pct,
             count(DISTINCT value) AS n_unique,
             avg(CASE WHEN split = 'train' THEN value END) AS train_mean,
             stddev_samp(CASE WHEN split = 'train' THEN value END) AS train_std,
             avg(CASE WHEN split = 'test' THEN value END) AS test_mean,
             stddev_samp(CASE WHEN split = 'test' THEN value END) AS test_std,
             skewness(value) AS skew, kurtosis(value) AS kurtosis
      FROM fa GROUP BY 1)
SELECT pp.*, oo.outlier_pct_iqr, ks.ks_stat AS train_test_ks, ks.ks_p AS train_test_ks_p
FROM pp JOIN oo USING (feature) JOIN ks USING (feature)""",
          dbl="missing_pct train_mean train_std test_mean test_std skew kurtosis outlier_pct_iqr train_test_ks "
              "train_test_ks_p")
def q_data_overview(spark, sf):
    """T-22: one row per feature composing A03-A11 and the train/test KS (T-03)."""
    fm = inputs.feature_matrix(spark, sf)
    lg = qa.to_long(fm, ["series_id", "date", "split", "direction"], inputs.FEATURES, keep_nulls=True)
    v = F.col("value")
    tr, te = F.when(F.col("split") == "train", v), F.when(F.col("split") == "test", v)
    a = lg.groupBy("feature").agg(
        (F.lit(100.0) * F.count_if(v.isNull()).cast("double") / F.count(F.lit(1)).cast("double")).alias("missing_pct"),
        F.count_distinct(v).alias("n_unique"), F.avg(tr).alias("train_mean"), F.stddev_samp(tr).alias("train_std"),
        F.avg(te).alias("test_mean"), F.stddev_samp(te).alias("test_std"),
        F.count(v).alias("__n"), F.skewness(v).alias("__g1"), F.kurtosis(v).alias("__g2"))
    g1, g2 = qa.sample_skew_kurt(F.col("__n"), F.col("__g1"), F.col("__g2"))
    a = a.withColumns({"skew": g1, "kurtosis": g2}).drop("__n", "__g1", "__g2")
    nn = lg.where(v.isNotNull())
    o = qa.iqr_outliers(nn).select("feature", "outlier_pct_iqr")
    ks = st.ks_two_sample(nn, ["feature"], "value", "split", "train", "test") \
        .select("feature", F.col("ks_stat").alias("train_test_ks"), F.col("ks_p").alias("train_test_ks_p"))
    return finish(a.join(o, "feature").join(ks, "feature"))


@register("redundancy_check", with_(FEATURES_SQL) + """,
pr AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS pearson_r FROM fm WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for i, a in enumerate(inputs.FEATURES) for b in inputs.FEATURES[i + 1:]) + """)
SELECT f1, f2, pearson_r, CAST(abs(pearson_r) > 0.98 AS INTEGER) AS redundant FROM pr""", dbl="pearson_r")
def q_redundancy_check(spark, sf):
    """Pearson correlation of every feature pair, flagged above 0.98."""
    fm = inputs.feature_matrix(spark, sf)
    pr = rs.feature_pairs(fm, ["series_id", "date"], inputs.FEATURES)
    c = pr.groupBy("f1", "f2").agg(ft.corr_expr("x", "y").alias("pearson_r"))
    return finish(c.withColumn("redundant", (F.abs("pearson_r") > 0.98).cast("int")))


@register("lag_consistency", with_(RETURNS) + f""",
l AS (SELECT series_id, date, ret, lag(ret, 1) OVER ({W}) AS ret_lag1 FROM rp),
c AS (SELECT series_id, ret_lag1, lag(ret, 1) OVER ({W}) AS expected FROM l)
SELECT series_id, count(*) AS n,
       CAST(count_if(coalesce(abs(ret_lag1 - expected) > 0.001 * greatest(abs(expected), 1e-12), false)) AS BIGINT)
         AS mismatches
FROM c GROUP BY 1""")
def q_lag_consistency(spark, sf):
    """A stored one-row lag audited against the shift of its base (0 mismatches expected)."""
    p = ft.add_lags(inputs.returns_panel(spark, sf), ["ret"], (1,))
    a = ft.lag_consistency(p, "ret", "ret_lag1", 1)
    return a.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"),
                                      F.sum("lag_mismatch").cast("long").alias("mismatches"))


@register("sliding_sequences")
def q_sliding_sequences(spark, sf):
    """10-row sequences of (ret, n_orders) per row with full history; rows-only."""
    p = inputs.returns_panel(spark, sf).where(F.col("ret").isNotNull())
    s = ft.sliding_sequences(p, ["ret", "n_orders"], 10)
    return s.select("series_id", "date", "sequence")


VAL_TEST = """
vt AS (SELECT *, CASE WHEN target_date < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split
       FROM bt_in WHERE target_date >= DATE '1999-01-01'),
cand2 AS (SELECT DISTINCT series_id, threshold FROM cand),
fan2 AS (SELECT vt.*, cand2.threshold FROM vt JOIN cand2 USING (series_id))"""


@register("sweep_val_test", with_(BACKTEST) + """,
v AS (SELECT * FROM bt_in WHERE target_date >= DATE '1999-01-01' AND target_date < DATE '2000-01-01'),
ranked AS (SELECT series_id, abs(predicted_return) AS a,
                  row_number() OVER (PARTITION BY series_id ORDER BY abs(predicted_return)) - 1 AS i,
                  count(*) OVER (PARTITION BY series_id) AS n FROM v),
cand AS (
  SELECT DISTINCT series_id, threshold FROM (
    SELECT r.series_id, r.a AS threshold FROM ranked r, range(5, 96, 5) t(k)
    WHERE r.i = least(r.n - 1, CAST(floor(r.n * k / 100) AS BIGINT))
    UNION ALL
    SELECT s.series_id, CAST(c AS DOUBLE) FROM (SELECT DISTINCT series_id FROM v) s,
      (VALUES (0.0), """ + ", ".join(f"({c})" for c in bt.FIXED_CANDIDATES) + """) t(c))),""" + VAL_TEST + "," +
          _sim_sql("fan2", "series_id, split, threshold", "threshold") + "," +
          _metrics_sql("daily", "series_id, split, threshold") + """,
sel AS (SELECT series_id, split, threshold,
               row_number() OVER (PARTITION BY series_id, split ORDER BY round(coalesce(sharpe, -999.0), 9) DESC,
                                  round(total_return, 9) DESC, turnover ASC, threshold ASC) AS rk FROM met)
SELECT met.series_id, met.split, met.threshold, total_return, 10000.0 * total_return AS profit, sharpe, turnover,
       CAST(EXISTS (SELECT 1 FROM sel s WHERE s.series_id = met.series_id AND s.split = 'val' AND s.rk = 1
                    AND s.threshold = met.threshold) AS INTEGER) AS is_selected,
       CAST(EXISTS (SELECT 1 FROM sel s WHERE s.series_id = met.series_id AND s.split = 'test' AND s.rk = 1
                    AND s.threshold = met.threshold) AS INTEGER) AS is_oracle
FROM met""", dbl="threshold total_return profit sharpe")
def q_sweep_val_test(spark, sf):
    """Every candidate threshold (chosen from val) simulated on val and
    test; the val-best is 'selected', the test-best is flagged 'oracle'."""
    b = inputs.backtest_input(spark, sf).where(F.col("target_date") >= F.lit(inputs.TRAIN_END).cast("date"))
    b = b.withColumn("split", F.when(F.col("target_date") < F.lit(inputs.VAL_END).cast("date"), "val")
                     .otherwise("test"))
    b = b
    cand = bt.threshold_candidates(b.where(F.col("split") == "val"), ["series_id"], "predicted_return")
    fan = b.join(cand, "series_id")
    g = ["series_id", "split", "threshold"]
    met = bt.strategy_metrics(bt.simulate(fan, g, "date", "predicted_return", "actual_return", F.col("threshold"),
                                          COST, 1), g)
    key = [k.desc() for k in bt.selection_key()] + [F.col("threshold").asc()]
    w = Window.partitionBy("series_id", "split").orderBy(*key)
    met = met.withColumn("__rk", F.row_number().over(w))
    best = met.where("__rk = 1").groupBy("series_id").agg(
        F.max(F.when(F.col("split") == "val", F.col("threshold"))).alias("__sel"),
        F.max(F.when(F.col("split") == "test", F.col("threshold"))).alias("__orc"))
    out = met.join(best, "series_id").select(
        "series_id", "split", "threshold", "total_return", (F.lit(10000.0) * F.col("total_return")).alias("profit"),
        "sharpe", "turnover", (F.col("threshold") == F.col("__sel")).cast("int").alias("is_selected"),
        (F.col("threshold") == F.col("__orc")).cast("int").alias("is_oracle"))
    return finish(out)


@register("adf_auto_lag")
def q_adf_auto_lag(spark, sf):
    """T-13: ADF with AIC lag selection (0..5) on the close level per series; rows-only."""
    return finish(st.adf_auto(inputs.daily_panel(spark, sf), "close", max_lag=5))
