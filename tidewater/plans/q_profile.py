"""Registered queries: profiling, quality gate, association and drift statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import quality as qa
from tidewater.operators import stats as st
from tidewater.plans import inputs
from tidewater.plans.registry import FEATURES_SQL, finish, register, with_

FEATS = inputs.FEATURES
UNPIVOT_ALL = """,
fa AS (SELECT series_id, date, split, direction, feature, value
       FROM fm UNPIVOT INCLUDE NULLS (value FOR feature IN (ret, ret5, vol7, n_orders, close_z)))"""


def long_all(spark, sf):
    fm = inputs.feature_matrix(spark, sf)
    return qa.to_long(fm, ["series_id", "date", "split", "direction"], FEATS, keep_nulls=True)


@register("profile_columns", with_(FEATURES_SQL) + UNPIVOT_ALL + """
SELECT feature, count(value) AS count, CAST(count_if(value IS NULL) AS BIGINT) AS missing,
       avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75,
       max(value) AS max, count(DISTINCT value) AS n_unique,
       CAST(count_if(value = 0) AS DOUBLE) / nullif(CAST(count(value) AS DOUBLE), 0) AS zero_pct,
       skewness(value) AS skew, kurtosis(value) AS kurtosis
FROM fa GROUP BY 1""", dbl="mean std min q25 q50 q75 max zero_pct skew kurtosis")
def q_profile_columns(spark, sf):
    return finish(qa.describe_long(long_all(spark, sf)))


@register("outliers_iqr", with_(FEATURES_SQL) + """,
q AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n
      FROM fl GROUP BY 1),
s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM fl GROUP BY 1),
c AS (SELECT fl.feature, any_value(q.n) AS n, any_value(q3 - q1) AS iqr,
             CAST(count_if(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_out,
             CAST(count_if(abs(value - m) / nullif(sd, 0) > 3.0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS outlier_pct_z
      FROM fl JOIN q USING (feature) JOIN s USING (feature) GROUP BY 1)
SELECT feature, n, n_out,
       CASE WHEN n < 10 OR iqr = 0 THEN 0.0 ELSE CAST(n_out AS DOUBLE) / CAST(n AS DOUBLE) END AS outlier_pct_iqr,
       outlier_pct_z
FROM c""", dbl="outlier_pct_iqr outlier_pct_z")
def q_outliers_iqr(spark, sf):
    lg = inputs.feature_long(spark, sf)
    return finish(qa.iqr_outliers(lg).join(qa.zscore_outliers(lg), "feature"))


@register("class_balance_by_year", with_(FEATURES_SQL) + """
SELECT CAST(year(target_date) AS INTEGER) AS year, count(*) AS n,
       100.0 * CAST(count_if(direction = 0) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS down_pct,
       100.0 * CAST(count_if(direction = 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS up_pct
FROM fm GROUP BY 1""", dbl="down_pct up_pct")
def q_class_balance_by_year(spark, sf):
    fm = inputs.feature_matrix(spark, sf)
    return finish(fm.groupBy(F.year("target_date").alias("year")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.lit(100.0) * F.count_if(F.col("direction") == 0).cast("double") / F.count(F.lit(1)).cast("double")).alias("down_pct"),
        (F.lit(100.0) * F.count_if(F.col("direction") == 1).cast("double") / F.count(F.lit(1)).cast("double")).alias("up_pct")))


MONTHS = [f"m{m:02d}" for m in range(1, 13)]


@register("year_month_matrix", with_(FEATURES_SQL) + """
SELECT CAST(year(date) AS INTEGER) AS year, """ + ", ".join(
    f"avg(CASE WHEN month(date) = {m} THEN ret END) AS m{m:02d}" for m in range(1, 13)) + """
FROM fm GROUP BY 1""", dbl=" ".join(MONTHS))
def q_year_month_matrix(spark, sf):
    fm = inputs.feature_matrix(spark, sf)
    pv = fm.withColumn("__m", F.month("date")).groupBy(F.year("date").alias("year")) \
        .pivot("__m", list(range(1, 13))).agg(F.avg("ret"))
    return finish(pv.select("year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)]))


@register("winsorize_train", with_(FEATURES_SQL) + """,
caps AS (SELECT feature, quantile_cont(value, 0.99) AS cap FROM fl WHERE split = 'train' GROUP BY 1)
SELECT series_id, date, feature, value, cap, least(value, cap) AS value_w
FROM fl JOIN caps USING (feature)""", dbl="value cap value_w")
def q_winsorize_train(spark, sf):
    lg = inputs.feature_long(spark, sf)
    w = qa.winsorize(lg, 0.99, F.col("split") == "train")
    return finish(w.select("series_id", "date", "feature", "value", "cap", "value_w"))


@register("quality_report", with_(FEATURES_SQL) + UNPIVOT_ALL + """
SELECT 'rows' AS "check", split AS subject, CAST(count(*) AS DOUBLE) AS value, 'OK' AS status FROM fm GROUP BY split
UNION ALL
SELECT 'missing', feature, CAST(count_if(value IS NULL) AS DOUBLE),
       CASE WHEN count_if(value IS NULL) = 0 THEN 'OK' ELSE 'WARNING' END FROM fa GROUP BY feature
UNION ALL
SELECT 'infinite', feature, CAST(count_if(isinf(value)) AS DOUBLE),
       CASE WHEN count_if(isinf(value)) = 0 THEN 'OK' ELSE 'WARNING' END FROM fa GROUP BY feature
UNION ALL
SELECT 'duplicate_keys', 'series_id,date', CAST(coalesce(sum(c - 1), 0) AS DOUBLE),
       CASE WHEN coalesce(sum(c - 1), 0) = 0 THEN 'OK' ELSE 'WARNING' END
FROM (SELECT series_id, date, count(*) AS c FROM fm GROUP BY 1, 2)
UNION ALL
SELECT 'forward_columns_in_features', 'features', 0.0, 'OK'""", dbl="value")
def q_quality_report(spark, sf):
    fm = inputs.feature_matrix(spark, sf)
    lg = qa.to_long(fm, ["series_id", "date", "split", "direction"], FEATS, keep_nulls=True)
    rows = fm.groupBy(F.col("split").alias("subject")).agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select(F.lit("rows").alias("check"), "subject", "value", F.lit("OK").alias("status"))
    miss = lg.groupBy(F.col("feature").alias("subject")).agg(F.count_if(F.col("value").isNull()).alias("value"))
    inf = lg.groupBy(F.col("feature").alias("subject")).agg(
        F.count_if(F.abs("value") == F.lit(float("inf"))).alias("value"))
    dup = qa.duplicate_report(fm, ["series_id", "date"]).select(F.lit("series_id,date").alias("subject"),
                                                                F.col("duplicates").alias("value"))

    def status(df, name):
        return df.select(F.lit(name).alias("check"), "subject", "value",
                         F.when(F.col("value") == 0, "OK").otherwise("WARNING").alias("status"))

    leak = [c for c in FEATS if c.endswith("_fwd1") or c in ("target_ret", "direction")]
    lk = spark.range(1).select(F.lit("forward_columns_in_features").alias("check"), F.lit("features").alias("subject"),
                               F.lit(float(len(leak))).alias("value"),
                               F.lit("OK" if not leak else "RISK").alias("status"))
    return finish(qa.quality_gate([rows, status(miss, "missing"), status(inf, "infinite"),
                                   status(dup, "duplicate_keys"), lk]))


TRAIN = "split = 'train'"


@register("pearson_spearman", with_(FEATURES_SQL) + f""",
r AS (SELECT feature, value, direction,
             rank() OVER (PARTITION BY feature ORDER BY value)
               + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY feature ORDER BY direction)
               + (count(*) OVER (PARTITION BY feature, direction) - 1) / 2.0 AS ry
      FROM fl WHERE {TRAIN})
SELECT feature, count(*) AS n, corr(value, direction) AS pearson, corr(rx, ry) AS spearman FROM r GROUP BY 1""",
          dbl="pearson spearman")
def q_pearson_spearman(spark, sf):
    lg = inputs.feature_long(spark, sf).where(F.col("split") == "train")
    return finish(st.pearson_spearman(lg, ["feature"], "value", "direction"))


KS_SQL = """,
h AS (SELECT feature, value, count_if(split = 'train') AS ca, count_if(split = 'test') AS cb
      FROM fl WHERE split IN ('train', 'test') GROUP BY 1, 2),
c AS (SELECT feature, sum(ca) OVER w AS fa, sum(cb) OVER w AS fb,
             sum(ca) OVER (PARTITION BY feature) AS na, sum(cb) OVER (PARTITION BY feature) AS nb FROM h
      WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT feature, max(abs(CAST(fa AS DOUBLE) / CAST(na AS DOUBLE) - CAST(fb AS DOUBLE) / CAST(nb AS DOUBLE))) AS dd,
             CAST(any_value(na) AS BIGINT) AS n_a, CAST(any_value(nb) AS BIGINT) AS n_b FROM c GROUP BY 1),
l AS (SELECT *, (sqrt(CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE) / CAST(n_a + n_b AS DOUBLE)) + 0.12
                 + 0.11 / sqrt(CAST(n_a AS DOUBLE) * CAST(n_b AS DOUBLE) / CAST(n_a + n_b AS DOUBLE))) * dd AS lam FROM d),
p AS (SELECT feature, 2.0 * sum(pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)) AS s
      FROM l, range(1, 101) t(k) GROUP BY 1),
ks AS (SELECT feature, n_a, n_b,
              CASE WHEN n_a >= 2 AND n_b >= 2 THEN dd END AS ks_stat,
              CASE WHEN n_a >= 2 AND n_b >= 2 THEN
                   CASE WHEN lam < 0.3 THEN 1.0 ELSE least(1.0, greatest(0.0, s)) END END AS ks_p
       FROM l JOIN p USING (feature))"""


@register("ks_two_sample", with_(FEATURES_SQL) + KS_SQL + "\nSELECT * FROM ks", dbl="ks_stat ks_p")
def q_ks_two_sample(spark, sf):
    lg = inputs.feature_long(spark, sf)
    return finish(st.ks_two_sample(lg, ["feature"], "value", "split", "train", "test"))


MW_SQL = f""",
h AS (SELECT feature, value, count(*) AS cnt, count_if(direction = 1) AS c1 FROM fl WHERE {TRAIN} GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY feature ORDER BY value
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h),
a AS (SELECT feature, sum(CAST(c1 AS DOUBLE) * (CAST(below AS DOUBLE) + (CAST(cnt AS DOUBLE) + 1.0) / 2.0)) AS r1,
             CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(cnt - c1) AS BIGINT) AS n0,
             sum(CAST(cnt AS DOUBLE) * CAST(cnt AS DOUBLE) * CAST(cnt AS DOUBLE) - CAST(cnt AS DOUBLE)) AS ties
      FROM r GROUP BY 1),
u AS (SELECT *, r1 - CAST(n1 AS DOUBLE) * (CAST(n1 AS DOUBLE) + 1.0) / 2.0 AS mw_u,
             CAST(n1 AS DOUBLE) * CAST(n0 AS DOUBLE) / 2.0 AS mu,
             sqrt(CAST(n1 AS DOUBLE) * CAST(n0 AS DOUBLE) / 12.0 * ((CAST(n1 AS DOUBLE) + CAST(n0 AS DOUBLE) + 1.0)
                  - ties / nullif((CAST(n1 AS DOUBLE) + CAST(n0 AS DOUBLE)) * (CAST(n1 AS DOUBLE) + CAST(n0 AS DOUBLE) - 1.0), 0))) AS sig
      FROM a),
mw AS (SELECT feature, n1, n0, mw_u, (mw_u - mu - 0.5 * sign(mw_u - mu)) / nullif(sig, 0) AS mw_z FROM u)"""


# two-sided p by Simpson's rule on the normal density between -|z| and |z|
@register("mann_whitney_u", with_(FEATURES_SQL) + MW_SQL + """,
mp AS (SELECT feature, 1.0 - sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                             * exp(-0.5 * pow(abs(mw_z) * (i / 2000.0 - 1.0), 2))) * abs(mw_z) / 6000.0 / sqrt(2 * pi()) AS mw_p
       FROM mw, range(0, 4001) t(i) GROUP BY feature, mw_z)
SELECT mw.*, mw_p FROM mw JOIN mp USING (feature)""", dbl="mw_u mw_z mw_p")
def q_mann_whitney_u(spark, sf):
    lg = inputs.feature_long(spark, sf).where(F.col("split") == "train")
    return finish(st.mann_whitney(lg, ["feature"], "value", "direction"))


CD_SQL = f""",
cd0 AS (SELECT feature, avg(CASE WHEN direction = 1 THEN value END) AS m1, avg(CASE WHEN direction = 0 THEN value END) AS m0,
               var_samp(CASE WHEN direction = 1 THEN value END) AS v1, var_samp(CASE WHEN direction = 0 THEN value END) AS v0
        FROM fl WHERE {TRAIN} GROUP BY 1),
cd AS (SELECT feature, CASE WHEN sqrt((v1 + v0) / 2.0) = 0 THEN 0.0 ELSE (m1 - m0) / sqrt((v1 + v0) / 2.0) END AS cohens_d
       FROM cd0)"""


@register("cohens_d", with_(FEATURES_SQL) + CD_SQL + "\nSELECT feature, cohens_d, abs(cohens_d) AS abs_d FROM cd",
          dbl="cohens_d abs_d")
def q_cohens_d(spark, sf):
    lg = inputs.feature_long(spark, sf).where(F.col("split") == "train")
    return finish(st.cohens_d(lg, ["feature"], "value", "direction"))


MI_SQL = f""",
t AS (SELECT * FROM fl WHERE {TRAIN}),
mm AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM t GROUP BY 1),
b AS (SELECT t.feature, direction,
             CAST(least(floor(coalesce((value - lo) / nullif(hi - lo, 0), 0.0) * 10.0), 9.0) AS INTEGER) AS bin
      FROM t JOIN mm USING (feature)),
c AS (SELECT feature, bin, direction, count(*) AS nby FROM b GROUP BY 1, 2, 3),
c2 AS (SELECT *, sum(nby) OVER (PARTITION BY feature) AS n, sum(nby) OVER (PARTITION BY feature, bin) AS nb,
              sum(nby) OVER (PARTITION BY feature, direction) AS ny FROM c),
mi AS (SELECT feature, sum(CAST(nby AS DOUBLE) / CAST(n AS DOUBLE)
                       * ln(CAST(nby AS DOUBLE) * CAST(n AS DOUBLE) / (CAST(nb AS DOUBLE) * CAST(ny AS DOUBLE)))) AS MI
       FROM c2 GROUP BY 1)"""


@register("binned_mi", with_(FEATURES_SQL) + MI_SQL + "\nSELECT * FROM mi", dbl="MI")
def q_binned_mi(spark, sf):
    lg = inputs.feature_long(spark, sf).where(F.col("split") == "train")
    return finish(st.binned_mi(lg, ["feature"], "value", "direction", 10))


def two_sample_ks_sql(name: str, where: str, first: str, second: str) -> str:
    """D of two samples straight from the definition: the largest gap of the two empirical
    distribution functions over all values (a correlated count per value, not a running sum)."""
    return f""",
{name}_v AS (SELECT DISTINCT feature, value FROM fl WHERE ({where}) AND ({first} OR {second})),
{name}_n AS (SELECT feature, count_if({first}) AS na, count_if({second}) AS nb FROM fl WHERE {where} GROUP BY 1),
{name}_c AS (SELECT v.feature, v.value, count_if(({first}) AND x.value <= v.value) AS ca, count_if(({second}) AND x.value <= v.value) AS cb
         FROM {name}_v v JOIN (SELECT * FROM fl WHERE {where}) x ON x.feature = v.feature GROUP BY 1, 2),
{name} AS (SELECT feature, CASE WHEN any_value(na) >= 2 AND any_value(nb) >= 2
                            THEN max(abs(CAST(ca AS DOUBLE) / nullif(na, 0) - CAST(cb AS DOUBLE) / nullif(nb, 0))) END AS d
         FROM {name}_c JOIN {name}_n USING (feature) GROUP BY 1)"""


def _term(c: str) -> str:
    """x / max(x) over the features; 0 where the maximum is not positive or x is missing."""
    return f"coalesce(CASE WHEN max({c}) OVER () > 0 THEN {c} / max({c}) OVER () ELSE 0.0 END, 0.0)"


@register("feature_score", with_(FEATURES_SQL) + KS_SQL.replace("h AS", "kh AS").replace("FROM h", "FROM kh")
          .replace("c AS (", "kc AS (").replace("FROM c GROUP", "FROM kc GROUP").replace("d AS (", "kd AS (")
          .replace("FROM d)", "FROM kd)").replace("p AS (", "kp AS (").replace("JOIN p USING", "JOIN kp USING")
          + MI_SQL + CD_SQL + f""",
uh AS (SELECT feature, value, count_if(direction = 1) AS ca, count_if(direction = 0) AS cb FROM fl WHERE {TRAIN} GROUP BY 1, 2),
uc AS (SELECT feature, sum(ca) OVER w / sum(ca) OVER f - sum(cb) OVER w / sum(cb) OVER f AS gap, sum(ca) OVER f AS na, sum(cb) OVER f AS nb
       FROM uh WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY feature)),
up AS (SELECT feature, CASE WHEN any_value(na) >= 2 AND any_value(nb) >= 2 THEN max(abs(gap)) END AS class_ks FROM uc GROUP BY 1),
sp AS (SELECT feature, corr(value, direction) AS rpb, corr(rx, ry) AS spearman FROM (
         SELECT feature, value, direction, rank() OVER (PARTITION BY feature ORDER BY value)
                  + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rx,
                rank() OVER (PARTITION BY feature ORDER BY direction)
                  + (count(*) OVER (PARTITION BY feature, direction) - 1) / 2.0 AS ry
         FROM fl WHERE {TRAIN}) GROUP BY 1),
terms AS (SELECT feature, abs(rpb) AS arpb, abs(spearman) AS ars, MI, class_ks, abs(cohens_d) AS abs_d, ks_stat
      FROM sp JOIN mi USING (feature) JOIN cd USING (feature) JOIN up USING (feature) JOIN ks USING (feature)),
sc AS (SELECT *, ({_term("arpb")} + {_term("MI")} + {_term("class_ks")} + {_term("abs_d")}) / 4.0 AS signal_score,
              1.0 - {_term("ks_stat")} AS stability_score, ({_term("MI")} + {_term("ars")}) / 2.0 AS mix_score FROM terms),
rs AS (SELECT *, 0.7 * signal_score + 0.3 * stability_score AS research_score FROM sc)
SELECT feature, signal_score, stability_score, research_score, mix_score, ks_stat,
       CASE WHEN MI > 0.01 AND ars < 0.05 THEN 'NONLINEAR' WHEN MI > 0.01 THEN 'LINEAR+NL' ELSE 'WEAK' END AS relation,
       CAST(row_number() OVER (ORDER BY research_score DESC, signal_score DESC, feature) AS INTEGER) AS rank_research,
       CAST(row_number() OVER (ORDER BY ars DESC, MI DESC, feature) AS INTEGER) AS rank_spearman,
       CAST(row_number() OVER (ORDER BY MI DESC, ars DESC, feature) AS INTEGER) AS rank_mi,
       CAST(row_number() OVER (ORDER BY mix_score DESC, MI DESC, ars DESC, feature) AS INTEGER) AS rank_mi_spearman
FROM rs""", dbl="signal_score stability_score research_score mix_score ks_stat")
def q_feature_score(spark, sf):
    """T-09/T-10/T-20: four-term signal, stability, research score, rankings and relation tags."""
    return finish(st.feature_scores(_associations(spark, sf)))


def _associations(spark, sf):
    lg = inputs.feature_long(spark, sf)
    tr = lg.where(F.col("split") == "train")
    key = ["feature"]
    return (st.pearson_spearman(tr, key, "value", "direction").select("feature", F.col("pearson").alias("rpb"), "spearman")
            .join(st.binned_mi(tr, key, "value", "direction", 10), "feature")
            .join(st.cohens_d(tr, key, "value", "direction").select("feature", "abs_d"), "feature")
            .join(st.ks_two_sample(tr, key, "value", "direction", 1, 0).select("feature", F.col("ks_stat").alias("class_ks")), "feature")
            .join(st.ks_two_sample(lg, key, "value", "split", "train", "test").select("feature", "ks_stat"), "feature"))


@register("ks_by_class", with_(FEATURES_SQL) + two_sample_ks_sql("ud", TRAIN, "direction = 1", "direction = 0")
          + two_sample_ks_sql("us", "direction = 1", "split = 'train'", "split = 'test'")
          + two_sample_ks_sql("ds", "direction = 0", "split = 'train'", "split = 'test'") + """
SELECT feature, ud.d AS class_ks, us.d AS up_shift_ks, ds.d AS down_shift_ks
FROM ud JOIN us USING (feature) JOIN ds USING (feature)""", dbl="class_ks up_shift_ks down_shift_ks")
def q_ks_by_class(spark, sf):
    """T-03: KS of up against down, and train against test within each class."""
    lg = inputs.feature_long(spark, sf)

    def ks(rows, side, a, b, name):
        return st.ks_two_sample(rows, ["feature"], "value", side, a, b).select("feature", F.col("ks_stat").alias(name))

    return finish(ks(lg.where(F.col("split") == "train"), "direction", 1, 0, "class_ks")
                  .join(ks(lg.where("direction = 1"), "split", "train", "test", "up_shift_ks"), "feature")
                  .join(ks(lg.where("direction = 0"), "split", "train", "test", "down_shift_ks"), "feature"))


@register("normality_tests", with_(FEATURES_SQL) + """,
mo AS (SELECT feature, count(*) AS n, avg(value) AS m FROM fl GROUP BY 1),
c AS (SELECT fl.feature, any_value(n) AS n,
             avg(pow(value - m, 2)) AS m2, avg(pow(value - m, 3)) AS m3, avg(pow(value - m, 4)) AS m4
      FROM fl JOIN mo USING (feature) GROUP BY 1),
g AS (SELECT feature, n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3.0 AS g2 FROM c)
SELECT feature, n, g1 AS skew_pop, ln(CAST(n AS DOUBLE) / 6.0 * (g1 * g1 + g2 * g2 / 4.0)) AS log_jb,
       exp(-(CAST(n AS DOUBLE) / 6.0 * (g1 * g1 + g2 * g2 / 4.0)) / 2.0) AS jb_p
FROM g""", dbl="skew_pop log_jb jb_p")
def q_normality_tests(spark, sf):
    """T-17; JB is reported as ln(JB) because heavy tails push it to ~1e8."""
    j = st.jarque_bera(inputs.feature_long(spark, sf), ["feature"], "value")
    return finish(j.select("feature", "n", "skew_pop", F.log("jb").alias("log_jb"), "jb_p"))


@register("vif_table")
def q_vif_table(spark, sf):
    """T-07: rows-only check (the p x p inverse has no SQL form)."""
    return st.vif(inputs.feature_matrix(spark, sf), FEATS)
