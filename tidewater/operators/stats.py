"""Association, separability, drift and diagnostic statistics (survey T-01..T-22).

Inputs are long tables ``(group..., value, label/side)``.  Rank-based
statistics never sort raw rows of a feature in one task: values are first
reduced to a histogram of distinct values per group, cumulative counts come
from ``prefix_sum`` over value buckets (equal-width buckets between the
group's min and max, joined from a one-row-per-group table), and the
per-value results are joined back where rows need them.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.joins import join_null_safe
from tidewater.operators.features import corr_expr
from tidewater.operators.scan import prefix_sum

__all__ = [
    "value_bucket", "average_ranks", "pearson_spearman", "ks_two_sample", "kolmogorov_p", "mann_whitney",
    "normal_two_sided_p", "cohens_d", "binned_mi", "jarque_bera", "ljung_box", "vif", "max_normalise",
    "feature_scores", "kpss_level", "adf_fixed_lag", "adf_auto", "pacf_from_acf", "qq_points", "greedy_prune", "inverse_normal",
    "adf_p", "kpss_p", "stationarity_verdict", "average_linkage", "feature_clusters",
]


#: Most buckets of a group; a bucket is the stretch of distinct values that one task scans.
MOST_BUCKETS = 512


def default_buckets(df: DataFrame) -> int:
    """Buckets per group: two a shuffle partition of the session, between 128 and ``MOST_BUCKETS``.  The cuts are an array that
    every row is compared with, so their number must not follow the size of a cluster."""
    return max(128, min(MOST_BUCKETS, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def value_bucket(df: DataFrame, group: Sequence[str], value: str, buckets: int | None = None,
                 method: str = "quantile", accuracy: int = 10_000) -> DataFrame:
    """Attach ``__vb``, a bucket index monotone in ``value`` within its group.

    ``method="quantile"`` (default) cuts at approximate quantiles of the
    group's values, so buckets hold similar numbers of distinct values even
    for heavily skewed distributions (a single outlier cannot push every
    value into one bucket).  ``"width"`` uses equal-width buckets between
    the group's min and max.  Either way the boundaries are one small row per
    group joined back, and equal values always share a bucket.  ``buckets``
    defaults to twice the session's shuffle partitions.
    """
    group = list(group)
    buckets = buckets or default_buckets(df)
    if method == "quantile":
        qs = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        mm = df.groupBy(*group).agg(F.percentile_approx(value, qs, accuracy).alias("__cuts"))
        j = join_null_safe(df, mm, group)  # one row per group on the right side
        v = F.col(value)
        b = F.size(F.filter("__cuts", lambda c: c < v)).cast("long")
        return j.withColumn("__vb", b).drop("__cuts")
    else:
        mm = df.groupBy(*group).agg(F.min(value).alias("__vlo"), F.max(value).alias("__vhi"))
        j = join_null_safe(df, mm, group)
        b = F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("__vlo"), F.col("__vhi") - F.col("__vlo")),
                               F.lit(0.0)) * F.lit(float(buckets - 1))).cast("long")
        return j.withColumn("__vb", b).drop("__vlo", "__vhi")


def average_ranks(df: DataFrame, group: Sequence[str], value: str, counts: dict[str, Column] | None = None,
                  buckets: int | None = None) -> DataFrame:
    """Histogram of distinct values per group with tie-averaged ranks.

    Returns ``group, value, __cnt, __below, avg_rank`` (1-based) plus any
    extra conditional counts given in ``counts`` (name → boolean column).
    """
    group = list(group)
    aggs = [F.count(F.lit(1)).alias("__cnt")] + [F.count_if(c).alias(n) for n, c in (counts or {}).items()]
    h = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(*aggs)
    h = value_bucket(h, group, value, buckets)
    h = prefix_sum(h, group, [value], F.col("__vb"), {"__below": "__cnt"}, inclusive=False)
    return h.withColumn("avg_rank", F.col("__below").cast("double") + (F.col("__cnt").cast("double") + 1.0) / 2.0) \
        .drop("__vb")


def pearson_spearman(long: DataFrame, group: Sequence[str], value: str, target: str) -> DataFrame:
    """T-01/T-05: Pearson and Spearman correlation with a target on
    pairwise-complete rows; Spearman = Pearson on tie-averaged ranks."""
    group = list(group)
    d = long.where(F.col(value).isNotNull() & F.col(target).isNotNull())
    # Spearman needs only the joint histogram: rows are reduced before any join
    h = d.groupBy(*group, value, target).agg(F.count(F.lit(1)).alias("__n"))

    def ranks(c: str, out: str) -> DataFrame:
        k = h.groupBy(*group, c).agg(F.sum("__n").alias("__cnt"))
        k = prefix_sum(value_bucket(k, group, c), group, [c], F.col("__vb"), {"__below": "__cnt"}, inclusive=False)
        return k.select(*group, c, (F.col("__below") + (F.col("__cnt") + 1.0) / 2.0).alias(out))

    j = join_null_safe(h, ranks(value, "__rx"), [*group, value])
    j = join_null_safe(j, ranks(target, "__ry"), [*group, target])
    n = F.col("__n").cast("double")
    x, y = F.col("__rx"), F.col("__ry")
    # ranks are halves of integers, centred on (n + 1) / 2, so these sums are exact up to 2 ** 53
    s = j.groupBy(*group).agg(F.sum(n).alias("__t"), F.sum(n * x * y).alias("__xy"), F.sum(n * x * x).alias("__xx"),
                              F.sum(n * y * y).alias("__yy"))
    t = F.col("__t")
    mid = t * (t + 1.0) * (t + 1.0) / 4.0
    rho = F.try_divide(F.col("__xy") - mid, F.sqrt((F.col("__xx") - mid) * (F.col("__yy") - mid)))
    p = d.withColumn("__y", F.col(target).cast("double")).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), corr_expr(value, "__y").alias("pearson"))
    return join_null_safe(p, s.select(*group, rho.alias("spearman")), group)


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided KS p-value (Kolmogorov series with the
    Stephens small-sample factor), clamped to [0, 1]; JVM-side expression."""
    ne = n1.cast("double") * n2.cast("double") / (n1 + n2).cast("double")
    lam = (F.sqrt(ne) + F.lit(0.12) + F.lit(0.11) / F.sqrt(ne)) * d
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                    lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < 0.3, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * s)))


def ks_two_sample(long: DataFrame, group: Sequence[str], value: str, side: str, a, b) -> DataFrame:
    """T-03: two-sample KS statistic D = max |F_a - F_b| per group, sample
    sizes and asymptotic p; NULL when a side has fewer than 2 values."""
    group = list(group)
    d = long.where(F.col(value).isNotNull() & F.col(side).isin(a, b))
    h = d.groupBy(*group, value).agg(F.count_if(F.col(side) == a).alias("__ca"),
                                     F.count_if(F.col(side) == b).alias("__cb"))
    h = value_bucket(h, group, value)
    h = prefix_sum(h, group, [value], F.col("__vb"), {"__Fa": "__ca", "__Fb": "__cb"}, inclusive=True)
    # totals: one row per group joined back, not a window over all distinct values
    tot = d.groupBy(*group).agg(F.count_if(F.col(side) == a).alias("__na"), F.count_if(F.col(side) == b).alias("__nb"))
    h = join_null_safe(h, tot, group)
    diff = F.abs(F.col("__Fa").cast("double") / F.col("__na").cast("double")
                 - F.col("__Fb").cast("double") / F.col("__nb").cast("double"))
    r = h.groupBy(*group).agg(F.max(diff).alias("__d"), F.first("__na").alias("n_a"), F.first("__nb").alias("n_b"))
    ok = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    return r.select(*group, "n_a", "n_b", F.when(ok, F.col("__d")).alias("ks_stat"),
                    F.when(ok, kolmogorov_p(F.col("__d"), F.col("n_a"), F.col("n_b"))).alias("ks_p"))


#: Coefficients of the published rational approximation of erfc (error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_two_sided_p(z: Column) -> Column:
    """p = erfc(|z| / sqrt 2) as a JVM-side expression."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + x / 2.0)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return F.least(F.lit(1.0), t * F.exp(-x * x + poly))


def chi2_p(q: Column, dof: int) -> Column:
    """Upper tail of the chi-squared distribution for an even number of degrees of freedom (closed form)."""
    half, term, total = q / 2.0, F.lit(1.0), F.lit(1.0)
    for i in range(1, dof // 2):
        term = term * half / F.lit(float(i))
        total = total + term
    return F.exp(-half) * total


def mann_whitney(long: DataFrame, group: Sequence[str], value: str, label: str, continuity: bool = True) -> DataFrame:
    """T-04: Mann-Whitney U of label==1 vs label==0, tie-corrected normal z.

    U1 = R1 - n1(n1+1)/2 with tie-averaged ranks in the pooled sample;
    sigma^2 = n1 n0 / 12 * ((n+1) - sum(t^3 - t) / (n(n-1))).
    """
    group = list(group)
    d = long.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    h = average_ranks(d, group, value, {"__c1": F.col(label) == 1})
    t = F.col("__cnt").cast("double")
    a = h.groupBy(*group).agg(
        F.sum(F.col("__c1").cast("double") * F.col("avg_rank")).alias("__r1"),
        F.sum("__c1").alias("n1"), F.sum(F.col("__cnt") - F.col("__c1")).alias("n0"),
        F.sum(t * t * t - t).alias("__ties"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("__r1") - n1 * (n1 + 1.0) / 2.0
    mu = n1 * n0 / 2.0
    sig = F.sqrt(n1 * n0 / 12.0 * ((n + 1.0) - F.try_divide(F.col("__ties"), n * (n - 1.0))))
    num = u - mu - (F.lit(0.5) * F.signum(u - mu) if continuity else F.lit(0.0))
    z = F.try_divide(num, sig)
    return a.select(*group, "n1", "n0", u.alias("mw_u"), z.alias("mw_z"), normal_two_sided_p(z).alias("mw_p"))


def cohens_d(long: DataFrame, group: Sequence[str], value: str, label: str) -> DataFrame:
    """T-06: (mean1 - mean0) / sqrt((s1^2 + s0^2)/2), sample std; 0 if pooled is 0."""
    v = F.col(value)
    one, zero = F.when(F.col(label) == 1, v), F.when(F.col(label) == 0, v)
    a = long.where(v.isNotNull()).groupBy(*group).agg(
        F.avg(one).alias("__m1"), F.avg(zero).alias("__m0"),
        F.var_samp(one).alias("__v1"), F.var_samp(zero).alias("__v0"))
    pooled = F.sqrt((F.col("__v1") + F.col("__v0")) / 2.0)
    d = F.when(pooled == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("__m1") - F.col("__m0"), pooled))
    return a.select(*group, d.alias("cohens_d"), F.abs(d).alias("abs_d"))


def binned_mi(long: DataFrame, group: Sequence[str], value: str, label: str, bins: int = 10) -> DataFrame:
    """T-08 (re-aimed): plug-in mutual information (nats) between an
    equal-width binned value and the label; sum p(b,y) ln(p(b,y) / (p(b) p(y))).
    Differs from a k-NN estimator by design."""
    group = list(group)
    v = F.col(value)
    d = long.where(v.isNotNull() & F.col(label).isNotNull())
    mm = d.groupBy(*group).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    d = join_null_safe(d, F.broadcast(mm), group)  # one row per feature
    b = F.least(F.floor(F.coalesce(F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
                        * F.lit(float(bins))), F.lit(float(bins - 1)))
    c = d.withColumn("__bin", b.cast("int")).groupBy(*group, "__bin", label).agg(F.count(F.lit(1)).alias("__nby"))
    wg = Window.partitionBy(*group)
    c = c.withColumns({"__n": F.sum("__nby").over(wg),
                       "__nb": F.sum("__nby").over(Window.partitionBy(*group, "__bin")),
                       "__ny": F.sum("__nby").over(Window.partitionBy(*group, label))})
    nby, n, nb, ny = (F.col(x).cast("double") for x in ("__nby", "__n", "__nb", "__ny"))
    term = nby / n * F.log(nby * n / (nb * ny))
    return c.groupBy(*group).agg(F.sum(term).alias("MI"))


def jarque_bera(long: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """T-17: JB = n/6 (g1^2 + g2^2/4) with population moments; p = exp(-JB/2)."""
    v = F.col(value)
    a = long.where(v.isNotNull()).groupBy(*group).agg(F.count(v).alias("n"), F.skewness(v).alias("__g1"),
                                                      F.kurtosis(v).alias("__g2"))
    jb = F.col("n").cast("double") / 6.0 * (F.col("__g1") * F.col("__g1") + F.col("__g2") * F.col("__g2") / 4.0)
    return a.select(*group, "n", F.col("__g1").alias("skew_pop"), jb.alias("jb"), F.exp(-jb / 2.0).alias("jb_p"))


def ljung_box(acf: DataFrame, n: DataFrame, keys: Sequence[str], max_lags: Sequence[int]) -> DataFrame:
    """T-16: Q(h) = n(n+2) sum_{k<=h} acf_k^2 / (n-k) from an ACF table
    (keys, lag, acf) and the series lengths (keys, n); p for even h, else NULL."""
    keys = list(keys)
    j = acf.join(n, keys)
    hs = F.array(*[F.lit(h) for h in max_lags])
    j = j.withColumn("h", F.explode(F.filter(hs, lambda h: h >= F.col("lag"))))
    nn = F.col("n").cast("double")
    q = j.groupBy(*keys, "h").agg(F.first(nn).alias("__n"),
                                  F.sum(F.col("acf") * F.col("acf") / (nn - F.col("lag").cast("double"))).alias("__s"))
    q = q.select(*keys, F.col("h").alias("lags"), (F.col("__n") * (F.col("__n") + 2.0) * F.col("__s")).alias("lb_q"))
    even = [h for h in max_lags if h % 2 == 0]
    p = F.coalesce(*[F.when(F.col("lags") == h, chi2_p(F.col("lb_q"), h)) for h in even]) if even else F.lit(None).cast("double")
    return q.withColumn("lb_p", p)


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """T-07: VIF_j = diag(inv(R)) from the correlation matrix R of complete rows.

    R is p x p (p = number of features) and computed by Spark in one pass;
    only that small matrix is inverted on the driver.  R^2 >= 0.999999 →
    infinite VIF; > 10 critical, > 5 warning."""
    feats = list(features)
    d = df.select(*[F.col(c).cast("double") for c in feats]).dropna()
    pairs = [(a, b) for i, a in enumerate(feats) for b in feats[i + 1:]]
    row = d.agg(*[corr_expr(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    p = len(feats)
    r = np.eye(p)
    for (a, b) in pairs:
        i, j = feats.index(a), feats.index(b)
        r[i, j] = r[j, i] = row[f"{a}|{b}"] if row[f"{a}|{b}"] is not None else 0.0
    try:
        diag = np.diag(np.linalg.inv(r))
    except np.linalg.LinAlgError:
        diag = np.full(p, np.inf)
    rows = []
    for f, v in zip(feats, diag):
        r2 = 1.0 - 1.0 / v if v != 0 else 0.0
        val = float("inf") if r2 >= 0.999999 else float(v)
        status = "critical" if val > 10 else ("warning" if val > 5 else "ok")
        rows.append((f, val, status))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, status string")


def max_normalise(df: DataFrame, col: str, out: str) -> DataFrame:
    """T-09: x / max(x) over the (one-row-per-feature) table; max <= 0 → 0."""
    m = F.max(col).over(Window.partitionBy())
    return df.withColumn(out, F.when(m > 0, F.col(col) / m).otherwise(F.lit(0.0)))


def feature_scores(assoc: DataFrame) -> DataFrame:
    """T-09/T-10/T-20: signal, stability and research scores, ranks and the relation tag.

    ``assoc`` has one row per feature with rpb (point-biserial r), spearman, MI,
    class_ks (up against down), abs_d and ks_stat (train against test).  The signal is
    the mean of the four max-normalised terms |rpb|, MI, class KS and |d|; stability is one minus
    the max-normalised drift; research is 0.7 signal + 0.3 stability.  Missing terms count 0.
    """
    d = assoc.withColumns({"__arpb": F.abs("rpb"), "__ars": F.abs("spearman")})
    for c in ("__arpb", "__ars", "MI", "class_ks", "abs_d", "ks_stat"):
        d = max_normalise(d, c, f"__n_{c}")
    n = {c: F.coalesce(F.col(f"__n_{c}"), F.lit(0.0)) for c in ("__arpb", "__ars", "MI", "class_ks", "abs_d", "ks_stat")}
    d = d.withColumns({"signal_score": (n["__arpb"] + n["MI"] + n["class_ks"] + n["abs_d"]) / 4.0,
                       "stability_score": F.lit(1.0) - n["ks_stat"],
                       "mix_score": (n["MI"] + n["__ars"]) / 2.0})
    d = d.withColumn("research_score", F.lit(0.7) * F.col("signal_score") + F.lit(0.3) * F.col("stability_score"))
    informative = F.col("MI") > 0.01
    tag = (F.when(informative & (F.col("__ars") < 0.05), "NONLINEAR").when(informative, "LINEAR+NL").otherwise("WEAK"))
    desc = lambda *cs: Window.orderBy(*[F.col(c).desc_nulls_last() for c in cs], "feature")
    rank = lambda *cs: F.row_number().over(desc(*cs))
    return d.select("feature", "signal_score", "stability_score", "research_score", "mix_score", "ks_stat",
                    tag.alias("relation"), rank("research_score", "signal_score").alias("rank_research"),
                    rank("__ars", "MI").alias("rank_spearman"), rank("MI", "__ars").alias("rank_mi"),
                    rank("mix_score", "MI", "__ars").alias("rank_mi_spearman"))


# ----------------------------------------------------------------- series tests
# KPSS level-stationarity critical values (10%, 5%, 2.5%, 1%).
KPSS_CRITICAL = {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}
# Dickey-Fuller (constant, no trend) asymptotic critical values (1%, 5%, 10%).
ADF_CRITICAL = {0.01: -3.43, 0.05: -2.86, 0.10: -2.57}


def kpss_level(df: DataFrame, x: str, keys: Sequence[str] = ("series_id",), order: str = "date") -> DataFrame:
    """T-14: KPSS level statistic per series.

    e = x - mean, S_t = cumulative sum of e, eta = sum(S_t^2) / n^2 / s2 with
    the Newey-West long-run variance s2 = g0 + 2 sum_{k<=L} (1 - k/(L+1)) g_k,
    g_k = sum e_t e_{t-k} / n and L = floor(12 (n/100)^(1/4)).  The lagged
    products come from a self join on the row index fanned out to L lags per
    row (L grows like n^(1/4)).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    wall = Window.partitionBy(*keys)
    d = df.where(F.col(x).isNotNull()).select(*keys, order, F.col(x).cast("double").alias("__x"))
    d = d.withColumns({"__n": F.count(F.lit(1)).over(wall), "__rn": F.row_number().over(w),
                       "__e": F.col("__x") - F.avg("__x").over(wall)})
    d = d.withColumn("__S", F.sum("__e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__L", F.floor(F.lit(12.0) * F.pow(F.col("__n") / 100.0, 0.25)).cast("int"))
    base = d.groupBy(*keys).agg(F.first("__n").alias("n"), F.first("__L").alias("lags"),
                                F.sum(F.col("__S") * F.col("__S")).alias("__ss"),
                                F.sum(F.col("__e") * F.col("__e")).alias("__g0"))
    a = d.select(*keys, "__rn", "__e", F.explode(F.sequence(F.lit(1), F.greatest(F.col("__L"), F.lit(1)))).alias("__k"),
                 "__L")
    a = a.where(F.col("__k") <= F.col("__L")).withColumn("__rb", F.col("__rn") - F.col("__k"))
    b = d.select(*keys, F.col("__rn").alias("__rb"), F.col("__e").alias("__eb"))
    g = a.join(b, keys + ["__rb"]).groupBy(*keys, "__k").agg(F.sum(F.col("__e") * F.col("__eb")).alias("__gk"),
                                                            F.first("__L").alias("__L"))
    wsum = g.groupBy(*keys).agg(F.sum((F.lit(1.0) - F.col("__k") / (F.col("__L") + 1.0)) * F.col("__gk")).alias("__wg"))
    r = base.join(wsum, keys, "left").fillna(0.0, ["__wg"])
    nn = F.col("n").cast("double")
    s2 = (F.col("__g0") + F.lit(2.0) * F.col("__wg")) / nn
    stat = F.col("__ss") / (nn * nn) / s2
    return r.select(*keys, "n", "lags", stat.alias("kpss_stat"),
                    (stat < KPSS_CRITICAL[0.05]).cast("int").alias("stationary_5pct"))


def _ols3_expr(prefix: str = "") -> dict[str, str]:
    """Closed-form 3x3 OLS pieces (symmetric X'X via cofactors) as SQL text
    shared by Spark and the oracle: returns expressions for b1 (the lagged
    level coefficient) and its t statistic from the moment columns
    n, s1, s2, s11, s22, s12, sy, sy1, sy2, syy (regressors 1, x1, x2)."""
    p = prefix
    a00, a01, a02 = f"{p}n", f"{p}s1", f"{p}s2"
    a11, a12, a22 = f"{p}s11", f"{p}s12", f"{p}s22"
    c00 = f"({a11}*{a22} - {a12}*{a12})"
    c01 = f"-({a01}*{a22} - {a12}*{a02})"
    c02 = f"({a01}*{a12} - {a11}*{a02})"
    c11 = f"({a00}*{a22} - {a02}*{a02})"
    c12 = f"-({a00}*{a12} - {a01}*{a02})"
    c22 = f"({a00}*{a11} - {a01}*{a01})"
    det = f"({a00}*{c00} + {a01}*{c01} + {a02}*{c02})"
    y0, y1, y2 = f"{p}sy", f"{p}sy1", f"{p}sy2"
    b0 = f"(({c00})*{y0} + ({c01})*{y1} + ({c02})*{y2}) / {det}"
    b1 = f"(({c01})*{y0} + ({c11})*{y1} + ({c12})*{y2}) / {det}"
    b2 = f"(({c02})*{y0} + ({c12})*{y1} + ({c22})*{y2}) / {det}"
    ssr = f"({p}syy - ({b0})*{y0} - ({b1})*{y1} - ({b2})*{y2})"
    se = f"sqrt({ssr} / ({a00} - 3) * ({c11}) / {det})"
    return {"b1": b1, "t": f"({b1}) / {se}"}


def adf_fixed_lag(df: DataFrame, x: str, keys: Sequence[str] = ("series_id",), order: str = "date") -> DataFrame:
    """T-13 (re-aimed): Dickey-Fuller regression with a constant and one
    lagged difference, dy_t = a + b x_{t-1} + c dy_{t-1}, fitted per series
    from aggregated moments (closed-form 3x3 solve); the t statistic of b is
    compared with the asymptotic 5% critical value.  Lag order is fixed (no
    AIC search) — stated deviation."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.where(F.col(x).isNotNull()).select(*keys, order, F.col(x).cast("double").alias("__x"))
    d = d.withColumn("__x1", F.lag("__x", 1).over(w))
    d = d.withColumn("__dy", F.col("__x") - F.col("__x1"))
    d = d.withColumn("__dy1", F.lag("__dy", 1).over(w))
    d = d.where(F.col("__dy").isNotNull() & F.col("__x1").isNotNull() & F.col("__dy1").isNotNull())
    # centre the regressors (the constant absorbs the means): avoids the
    # cancellation of raw level moments in the closed-form solve
    wall = Window.partitionBy(*keys)
    d = d.withColumns({"__x1": F.col("__x1") - F.avg("__x1").over(wall),
                       "__dy1": F.col("__dy1") - F.avg("__dy1").over(wall)})
    y, x1, x2 = F.col("__dy"), F.col("__x1"), F.col("__dy1")
    m = d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x1).alias("s1"), F.sum(x2).alias("s2"),
        F.sum(x1 * x1).alias("s11"), F.sum(x2 * x2).alias("s22"), F.sum(x1 * x2).alias("s12"),
        F.sum(y).alias("sy"), F.sum(y * x1).alias("sy1"), F.sum(y * x2).alias("sy2"), F.sum(y * y).alias("syy"))
    e = _ols3_expr()
    out = m.select(*keys, F.col("n").cast("long").alias("n"), F.expr(e["b1"]).alias("adf_gamma"),
                   F.expr(e["t"]).alias("adf_stat"))
    return out.withColumn("stationary_5pct", F.coalesce((F.col("adf_stat") < ADF_CRITICAL[0.05]).cast("int"), F.lit(0)))


def pacf_from_acf(acf: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """T-15: partial autocorrelations by Durbin-Levinson on each series' ACF
    (one small group per series: at most max-lag rows)."""
    keys = list(keys)
    schema = acf.select(*keys).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    schema = f"{schema}, lag int, pacf double"

    def dl(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        rho = pdf["acf"].to_numpy(dtype=float)
        K = len(rho)
        out, phi_prev = [], np.zeros(0)
        for k in range(1, K + 1):
            if k == 1:
                phi_kk = rho[0]
                phi = np.array([phi_kk])
            else:
                num = rho[k - 1] - np.dot(phi_prev, rho[k - 2::-1][:k - 1])
                den = 1.0 - np.dot(phi_prev, rho[:k - 1])
                phi_kk = num / den if den != 0 else np.nan
                phi = np.append(phi_prev - phi_kk * phi_prev[::-1], phi_kk)
            out.append(phi_kk)
            phi_prev = phi
        res = pd.DataFrame({k_: pdf[k_].iloc[0] for k_ in keys}, index=range(K))
        res["lag"] = np.arange(1, K + 1, dtype="int32")
        res["pacf"] = out
        return res

    return acf.groupBy(*keys).applyInPandas(dl, schema)


#: The published rational approximations of the inverse normal (algorithm AS 241, about 16 digits):
#: numerator and denominator by rising powers, for the middle, the shoulders and the tails.
INVERSE_NORMAL = (
    ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457,
      67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
     (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610,
      28729.085735721942674, 5226.4952788528545610)),
    ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
      0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
      0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930,
      1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4,
      1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1 (else NULL), as a JVM-side expression."""
    def ratio(part: int, x: Column) -> Column:
        top, bottom = (F.lit(c[-1]) for c in INVERSE_NORMAL[part])
        for a, b in zip(reversed(INVERSE_NORMAL[part][0][:-1]), reversed(INVERSE_NORMAL[part][1][:-1])):
            top, bottom = top * x + a, bottom * x + b
        return top / bottom

    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1.0 - p)))
    tail = F.when(r <= 5.0, ratio(1, r - 1.6)).otherwise(ratio(2, r - 5.0))
    value = F.when(F.abs(q) <= 0.425, q * ratio(0, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * tail)
    return F.when((p > 0) & (p < 1), value)


def qq_points(long: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """T-19: (value, plotting position (rank - 0.5)/n, normal quantile) per
    distinct value and group, on the reduced distinct-value table."""
    group = list(group)
    h = average_ranks(long, group, value)
    n = long.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    h = join_null_safe(h, n, group).withColumn("p", (F.col("avg_rank") - 0.5) / F.col("__n"))
    return h.select(*group, value, F.col("__cnt").alias("count"), "p", inverse_normal(F.col("p")).alias("normal_quantile"))


#: Published response surface of the Dickey-Fuller p-value (constant, one series): limits of the statistic,
#: the border of its two branches, and their coefficients by rising powers; the normal distribution of the polynomial is p.
ADF_LOW, ADF_HIGH, ADF_BORDER = -18.83, 2.74, -1.61
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)


def normal_cdf(z: Column) -> Column:
    return F.when(z > 0, 1.0 - normal_two_sided_p(z) / 2.0).otherwise(normal_two_sided_p(z) / 2.0)


def adf_p(stat: Column) -> Column:
    """T-13: p-value of a Dickey-Fuller statistic with a constant, by its response surface."""
    def surface(c: tuple) -> Column:
        out = F.lit(c[-1])
        for a in reversed(c[:-1]):
            out = out * stat + a
        return normal_cdf(out)
    return (F.when(stat.isNull() | F.isnan(stat), F.lit(None).cast("double")).when(stat > ADF_HIGH, F.lit(1.0)).when(stat < ADF_LOW, F.lit(0.0))
            .when(stat <= ADF_BORDER, surface(ADF_SMALL_P)).otherwise(surface(ADF_LARGE_P)))


def kpss_p(stat: Column) -> Column:
    """T-14: p-value between the tabulated critical values, by linear interpolation; 0.1 or 0.01 beyond them."""
    points = sorted((c, p) for p, c in KPSS_CRITICAL.items())
    out = F.when(stat.isNull() | F.isnan(stat), F.lit(None).cast("double")).when(stat <= points[0][0], F.lit(points[0][1]))
    for (c0, p0), (c1, p1) in zip(points, points[1:]):
        out = out.when(stat <= c1, F.lit(p0) + (stat - c0) * ((p1 - p0) / (c1 - c0)))
    return out.otherwise(F.lit(points[-1][1]))


def stationarity_verdict(df: DataFrame, x: str, keys: Sequence[str] = ("series_id",), order: str = "date", level: float = 0.05) -> DataFrame:
    """T-13/T-14: both unit-root tests with p-values and what they say together: Stationary (only ADF rejects), NON-STATIONARY (only
    KPSS rejects), Trend-stationary (both), Uncertain (neither) or Constant (no spread: no test)."""
    keys = list(keys)
    spread = df.groupBy(*keys).agg(F.count(x).alias("n"), F.coalesce(F.max(x) > F.min(x), F.lit(False)).alias("__varies"))
    d = join_null_safe(df, spread.select(*keys, "__varies"), keys).where("__varies").drop("__varies")
    a = adf_fixed_lag(d, x, keys, order).select(*keys, "adf_stat", adf_p(F.col("adf_stat")).alias("adf_p"))
    k = kpss_level(d, x, keys, order).select(*keys, "kpss_stat", kpss_p(F.col("kpss_stat")).alias("kpss_p"))
    j = join_null_safe(join_null_safe(spread, a, keys, "left"), k, keys, "left")
    root, level_ = F.col("adf_p") < level, F.col("kpss_p") < level
    verdict = (F.when(~F.col("__varies"), "Constant").when(root & ~level_, "Stationary").when(~root & level_, "NON-STATIONARY")
               .when(root & level_, "Trend-stationary").otherwise("Uncertain"))
    return j.select(*keys, "n", "adf_stat", "adf_p", "kpss_stat", "kpss_p", verdict.alias("verdict"))


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a member of each side, height) of average-linkage clustering, by rising height, with a chain of nearest
    neighbours: the ends of the chain are joined once they are nearest to each other, in p squared steps for p items."""
    d = np.array(distance, dtype=float)
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(len(d)), list(range(len(d)))
    chain, merges = [], []
    while len(alive) > 1:
        if not chain:
            chain = [alive[0]]
        tip = chain[-1]
        near = min(alive, key=lambda k: (d[tip, k], k))
        if len(chain) > 1 and d[tip, chain[-2]] <= d[tip, near]:
            near = chain[-2]
            chain = chain[:-2]
            a, b = min(tip, near), max(tip, near)
            merges.append((a, b, float(d[a, b])))
            rest = [k for k in alive if k not in (a, b)]
            d[a, rest] = d[rest, a] = (size[a] * d[a, rest] + size[b] * d[b, rest]) / (size[a] + size[b])
            size[a] += size[b]
            alive.remove(b)
        else:
            chain.append(near)
    return sorted(merges, key=lambda m: m[2])


def feature_clusters(pairs: DataFrame, scores: DataFrame, threshold: float = 0.3, f1: str = "f1", f2: str = "f2", r: str = "spearman_r",
                     feature: str = "feature", score: str = "research_score") -> DataFrame:
    """T-12: features clustered by average linkage of 1 - |r| (a missing correlation counts 0) and cut at ``threshold``; the member
    with the best score represents its cluster (the first by name of equal ones).  Returns (feature, cluster, score, selected);
    a cluster is named by its first feature.  Runs on the p x p pair table, which the number of features bounds."""
    scored = {row[feature]: row[score] for row in scores.select(feature, score).collect()}
    names = sorted(scored)
    at = {f: i for i, f in enumerate(names)}
    d = np.ones((len(names), len(names)))
    for row in pairs.select(f1, f2, r).collect():
        if row[f1] in at and row[f2] in at and row[r] is not None:
            d[at[row[f1]], at[row[f2]]] = d[at[row[f2]], at[row[f1]]] = 1.0 - abs(row[r])
    label = list(range(len(names)))
    for a, b, height in average_linkage(d) if names else []:
        if height <= threshold:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    best = {}
    for i, f in enumerate(names):
        value = -math.inf if scored[f] is None else scored[f]
        if label[i] not in best or value > best[label[i]][0]:
            best[label[i]] = (value, f)
    rows = [(f, names[label[i]], scored[f], best[label[i]][1] == f) for i, f in enumerate(names)]
    return scores.sparkSession.createDataFrame(rows, f"{feature} string, cluster string, {score} double, selected boolean")


def greedy_prune(pairs: DataFrame, scores: DataFrame, threshold: float = 0.7, f1: str = "f1", f2: str = "f2",
                 r: str = "spearman_r", feature: str = "feature", score: str = "research_score") -> DataFrame:
    """T-12 (re-aimed from average linkage): walk features by descending
    score; drop a feature when an already kept one has |r| > threshold with
    it.  Runs on the p x p pair table and p scores (bounded by the number of
    features, collected)."""
    sc = [(row[feature], row[score]) for row in scores.select(feature, score).collect()]
    sc.sort(key=lambda t: (-(t[1] if t[1] is not None else -1e300), t[0]))
    strong = {}
    for row in pairs.where(F.abs(F.col(r)) > threshold).select(f1, f2, r).collect():
        strong.setdefault(row[f1], {})[row[f2]] = row[r]
        strong.setdefault(row[f2], {})[row[f1]] = row[r]
    kept, rows = [], []
    for f, s in sc:
        blocker = next((g for g in kept if g in strong.get(f, {})), None)
        if blocker is None:
            kept.append(f)
        rows.append((f, s, blocker is None, blocker))
    return scores.sparkSession.createDataFrame(rows, f"{feature} string, {score} double, kept boolean, "
                                                      f"dropped_for string")


def adf_auto(df: DataFrame, x: str, keys: Sequence[str] = ("series_id",), order: str = "date",
             max_lag: int = 5) -> DataFrame:
    """T-13: augmented Dickey-Fuller with AIC lag selection (0..max_lag).

    All lag orders are fitted on the common sample (rows with max_lag
    lagged differences), as an AIC search requires.  Spark aggregates the
    cross-product moments of [1, x_{t-1}, dy_{t-1..t-max_lag}, dy_t] per
    series in one pass; a grouped pandas function on that one-row-per-series
    table solves each lag order, keeps the lowest AIC and reports its
    t statistic on x_{t-1} (compared with the asymptotic 5% value)."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.where(F.col(x).isNotNull()).select(*keys, order, F.col(x).cast("double").alias("__x"))
    d = d.withColumn("__x1", F.lag("__x", 1).over(w))
    d = d.withColumn("__dy", F.col("__x") - F.col("__x1"))
    d = d.withColumns({f"__l{i}": F.lag("__dy", i).over(w) for i in range(1, max_lag + 1)})
    cols = ["__x1"] + [f"__l{i}" for i in range(1, max_lag + 1)]
    d = d.where(F.col("__dy").isNotNull() & F.col(cols[-1]).isNotNull())
    # centre by the series mean (the constant absorbs it) to keep moments well conditioned
    wall = Window.partitionBy(*keys)
    d = d.withColumns({c: F.col(c) - F.avg(c).over(wall) for c in cols})
    z = ["__dy"] + cols
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(c).alias(f"s_{c}") for c in z]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(z) for b in z[i:]]
    m = d.groupBy(*keys).agg(*aggs)
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in m.schema.fields if f.name in keys)
    schema = f"{key_schema}, n long, adf_lag int, adf_stat double, aic double, stationary_5pct int"
    crit = ADF_CRITICAL[0.05]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            n = float(r["n"])
            k_all = len(z)
            M = np.zeros((k_all + 1, k_all + 1))  # [1, z...]
            M[0, 0] = n
            for i, a in enumerate(z):
                M[0, i + 1] = M[i + 1, 0] = r[f"s_{a}"]
                for j, b in enumerate(z[i:], start=i):
                    M[i + 1, j + 1] = M[j + 1, i + 1] = r[f"p_{a}_{b}"]
            # index 1 is dy (the response); regressors: 0 (const), 2 (x1), 3.. (lags)
            best = None
            for lag in range(0, max_lag + 1):
                idx = [0, 2] + list(range(3, 3 + lag))
                A = M[np.ix_(idx, idx)]
                b = M[idx, 1]
                try:
                    beta = np.linalg.solve(A, b)
                    inv = np.linalg.inv(A)
                except np.linalg.LinAlgError:
                    continue
                ssr = M[1, 1] - beta @ b
                k = len(idx)
                if ssr <= 0 or n <= k:
                    continue
                aic = n * np.log(ssr / n) + 2 * k
                t = beta[1] / np.sqrt(ssr / (n - k) * inv[1, 1])
                if best is None or aic < best[2] - 1e-12:
                    best = (lag, t, aic)
            row = {c: r[c] for c in keys}
            if best is None:
                row.update(n=int(n), adf_lag=None, adf_stat=None, aic=None, stationary_5pct=0)
            else:
                row.update(n=int(n), adf_lag=best[0], adf_stat=float(best[1]), aic=float(best[2]),
                           stationary_5pct=int(best[1] < crit))
            out.append(row)
        return pd.DataFrame(out, columns=keys + ["n", "adf_lag", "adf_stat", "aic", "stationary_5pct"])

    return m.groupBy(*keys).applyInPandas(solve, schema)
