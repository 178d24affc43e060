"""Profiling and data-quality checks (survey A01-A27, V01).

Per-column loops of the reference become one pass over a long
``(feature, value)`` table produced by ``unpivot`` (R02): a single
aggregation keyed by ``feature`` replaces p separate scans.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

__all__ = [
    "pct", "to_long", "describe_long", "sample_skew_kurt", "missing_report", "infinity_report", "duplicate_report",
    "dedup_first", "iqr_outliers", "zscore_outliers", "histogram", "value_counts", "split_balance",
    "quality_gate", "range_check", "winsorize", "group_stats",
]


def pct(col, q, exact: bool = True, accuracy: int = 10000) -> Column:
    """Linear-interpolated percentile(s); ``exact=False`` switches to
    ``percentile_approx`` (bounded memory per group) — explicit, never silent."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(q, (list, tuple)):
        arr = F.array(*[F.lit(float(x)) for x in q])
        return F.percentile(c, arr) if exact else F.percentile_approx(c, arr, accuracy)
    return F.percentile(c, F.lit(float(q))) if exact else F.percentile_approx(c, F.lit(float(q)), accuracy)


def to_long(df: DataFrame, ids: Sequence[str], features: Sequence[str], keep_nulls: bool = True,
            feature: str = "feature", value: str = "value") -> DataFrame:
    """Wide → long ``(ids..., feature, value)`` with double values."""
    d = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in features])
    out = d.unpivot(list(ids), list(features), feature, value)
    return out if keep_nulls else out.where(F.col(value).isNotNull())


def sample_skew_kurt(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness G1 (n >= 3) and excess kurtosis G2 (n >= 4)
    from Spark's population moments g1, g2."""
    nd = n.cast("double")
    G1 = F.when(n >= 3, g1 * F.sqrt(nd * (nd - 1.0)) / (nd - 2.0))
    G2 = F.when(n >= 4, (nd - 1.0) / ((nd - 2.0) * (nd - 3.0)) * ((nd + 1.0) * g2 + 6.0))
    return G1, G2


def describe_long(long: DataFrame, group: Sequence[str] = ("feature",), value: str = "value",
                  exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Count, missing, mean, std (ddof 1), min, quartiles,
    max, distinct count, zero share, sample skewness and kurtosis.

    ``exact=False`` switches the quartiles to ``percentile_approx`` and the
    distinct count to ``approx_count_distinct`` (bounded memory per group);
    the switch is explicit, never silent.
    """
    v = F.col(value)
    qs = pct(v, [0.25, 0.5, 0.75], exact, accuracy)
    nu = F.count_distinct(v) if exact else F.approx_count_distinct(v)
    a = long.groupBy(*group).agg(
        F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), qs.alias("__q"),
        F.max(v).alias("max"), nu.alias("n_unique"),
        F.try_divide(F.count_if(v == 0).cast("double"), F.count(v).cast("double")).alias("zero_pct"),
        F.skewness(v).alias("__g1"), F.kurtosis(v).alias("__g2"))
    G1, G2 = sample_skew_kurt(F.col("count"), F.col("__g1"), F.col("__g2"))
    return a.select(*group, "count", "missing", "mean", "std", "min",
                    F.col("__q")[0].alias("q25"), F.col("__q")[1].alias("q50"), F.col("__q")[2].alias("q75"),
                    "max", "n_unique", "zero_pct", G1.alias("skew"), G2.alias("kurtosis"))


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percentage per column, in one pass."""
    cols = list(cols or df.columns)
    row = df.select(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = row.unpivot(["__n"], cols, "column", "missing")
    return long.select("column", "missing", (F.col("missing") * 100.0 / F.col("__n")).alias("missing_pct"))


def infinity_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count of +-Infinity per numeric column."""
    inf = F.lit(float("inf"))
    row = df.select(*[F.count_if(F.abs(F.col(c).cast("double")) == inf).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column", "inf_count")


def duplicate_report(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Number of surplus duplicate rows (all columns, or a key)."""
    cols = list(key or df.columns)
    return df.groupBy(*cols).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long")
                                        .alias("duplicates"))


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """Keep the first row per key by an explicit total order (not
    ``dropDuplicates``, which keeps an arbitrary row)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def iqr_outliers(long: DataFrame, group: Sequence[str] = ("feature",), value: str = "value",
                 k: float = 1.5, min_n: int = 10, exact: bool = True) -> DataFrame:
    """Share of values outside [q1 - k IQR, q3 + k IQR]; 0 when n < min_n
    or IQR = 0.  Quartiles are one row per group, joined back."""
    v = F.col(value)
    q = long.where(v.isNotNull()).groupBy(*group).agg(
        pct(v, [0.25, 0.75], exact).alias("__q"), F.count(v).alias("__n"))
    j = long.where(v.isNotNull()).join(F.broadcast(q), list(group))  # one row per feature
    iqr = F.col("__q")[1] - F.col("__q")[0]
    out = (v < F.col("__q")[0] - F.lit(k) * iqr) | (v > F.col("__q")[1] + F.lit(k) * iqr)
    a = j.groupBy(*group).agg(F.first("__n").alias("n"), F.first(iqr).alias("iqr"), F.count_if(out).alias("n_out"))
    rate = F.when((F.col("n") < min_n) | (F.col("iqr") == 0), F.lit(0.0)) \
        .otherwise(F.col("n_out").cast("double") / F.col("n").cast("double"))
    return a.select(*group, "n", "n_out", rate.alias("outlier_pct_iqr"))


def zscore_outliers(long: DataFrame, group: Sequence[str] = ("feature",), value: str = "value",
                    z: float = 3.0) -> DataFrame:
    """Share of |x - mean| / std_pop > z."""
    v = F.col(value)
    s = long.where(v.isNotNull()).groupBy(*group).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"))
    j = long.where(v.isNotNull()).join(F.broadcast(s), list(group))  # one row per feature
    zz = F.try_divide(F.abs(v - F.col("__m")), F.col("__s"))
    return j.groupBy(*group).agg((F.count_if(zz > z).cast("double") / F.count(v).cast("double")).alias("outlier_pct_z"))


def histogram(long: DataFrame, group: Sequence[str] = ("feature",), value: str = "value", bins: int = 10,
              by: Sequence[str] = ()) -> DataFrame:
    """Fixed-count equal-width histogram per group over its [min, max]."""
    v = F.col(value)
    mm = long.where(v.isNotNull()).groupBy(*group).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    j = long.where(v.isNotNull()).join(F.broadcast(mm), list(group))  # one row per feature
    b = F.least(F.floor(F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo")) * F.lit(float(bins))),
                F.lit(bins - 1))
    j = j.withColumn("bin", F.coalesce(b, F.lit(0)).cast("int"))
    return j.groupBy(*group, *by, "bin").agg(F.count(F.lit(1)).alias("count"),
                                            F.first("__lo").alias("lo"), F.first("__hi").alias("hi"))


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts and proportions per value (within ``by``)."""
    c = df.groupBy(*by, col).count()
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return c.withColumn("proportion", F.col("count") / F.sum("count").over(w))


def split_balance(df: DataFrame, split: str, date: str) -> DataFrame:
    """Rows, first/last date and share of rows per split."""
    c = df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("start"), F.max(date).alias("end"))
    return c.withColumn("ratio", F.col("rows") / F.sum("rows").over(Window.partitionBy()))


def group_stats(df: DataFrame, by: Sequence[str], value: str, exact: bool = True) -> DataFrame:
    """mean/std/median/min/max/quartiles of ``value`` per group."""
    v = F.col(value)
    a = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                            pct(v, [0.5, 0.25, 0.75], exact).alias("__q"), F.min(v).alias("min"), F.max(v).alias("max"))
    return a.select(*by, "mean", "std", F.col("__q")[0].alias("median"), "min", "max",
                    F.col("__q")[1].alias("q25"), F.col("__q")[2].alias("q75"))


def range_check(long: DataFrame, expected: DataFrame, group: str = "feature", value: str = "value") -> DataFrame:
    """Observed min/max against expected (feature, lo, hi) → OK / WARNING."""
    obs = long.groupBy(group).agg(F.min(value).alias("min"), F.max(value).alias("max"))
    j = obs.join(expected, group, "left")
    ok = (F.col("min") >= F.col("lo")) & (F.col("max") <= F.col("hi"))
    return j.withColumn("status", F.when(ok, "OK").otherwise("WARNING"))


def winsorize(long: DataFrame, q: float = 0.99, fit_where: Column | None = None, group: Sequence[str] = ("feature",),
              value: str = "value", out: str = "value_w", exact: bool = True) -> DataFrame:
    """Cap at the upper ``q`` quantile fitted on ``fit_where`` rows only
    (leak-safe), applied to every row.  Returns rows plus the cap."""
    v = F.col(value)
    fit = long if fit_where is None else long.where(fit_where)
    caps = fit.where(v.isNotNull()).groupBy(*group).agg(pct(v, q, exact).alias("cap"))
    j = long.join(F.broadcast(caps), list(group), "left")  # one row per feature
    return j.withColumn(out, F.when(v.isNotNull() & F.col("cap").isNotNull(), F.least(v, F.col("cap"))).otherwise(v))


def quality_gate(checks: Sequence[DataFrame]) -> DataFrame:
    """Union of tidy (check, subject, value, status) tables."""
    out = None
    for c in checks:
        c = c.select(F.col("check").cast("string"), F.col("subject").cast("string"),
                     F.col("value").cast("double"), F.col("status").cast("string"))
        out = c if out is None else out.unionByName(c)
    return out
