"""Leak-safe preprocessing (survey M01-M08, F08-F10).

Every fitted transform has two steps: ``fit_*`` aggregates parameters from
the rows selected by ``fit_where`` (default: the training split) into a
small table with one row per feature, and ``apply_*`` joins that table back
on ``feature`` (a one-row-per-feature dimension) and evaluates a built-in
expression.  The parameter table is the persisted artefact.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.joins import join_null_safe
from tidewater.session import cut_lineage

__all__ = [
    "fit_minmax", "apply_minmax", "fit_standard", "apply_standard", "fit_robust", "apply_robust",
    "fit_median", "apply_impute", "yeo_johnson", "fit_yeo_johnson", "apply_yeo_johnson", "split_by_date",
    "processing_report", "fit_grouped", "apply_grouped", "impute_with_names",
]


def _fit_rows(long: DataFrame, fit_where: Column | None, value: str) -> DataFrame:
    d = long if fit_where is None else long.where(fit_where)
    return d.where(F.col(value).isNotNull())


def split_by_date(df: DataFrame, date: str, val_start: str, test_start: str, out: str = "split") -> DataFrame:
    """Time-ordered 3-way split (train < val_start <= val < test_start <= test)."""
    d = F.col(date)
    return df.withColumn(out, F.when(d < F.lit(val_start).cast("date"), "train")
                         .when(d < F.lit(test_start).cast("date"), "val").otherwise("test"))


def fit_minmax(long: DataFrame, fit_where: Column | None = None, group=("feature",), value="value") -> DataFrame:
    """Train min / max per feature."""
    return _fit_rows(long, fit_where, value).groupBy(*group).agg(F.min(value).alias("min"), F.max(value).alias("max"))


def apply_minmax(long: DataFrame, params: DataFrame, group=("feature",), value="value", out="scaled") -> DataFrame:
    """(x - min) / (max - min); values may leave [0, 1]; a constant or
    unfitted feature gives 0; NULL stays NULL."""
    j = long.join(F.broadcast(params), list(group), "left")  # one row per feature
    rng = F.col("max") - F.col("min")
    s = F.when(F.col(value).isNull(), F.lit(None).cast("double")) \
        .when(rng.isNull() | (rng == 0), F.lit(0.0)).otherwise((F.col(value) - F.col("min")) / rng)
    return j.withColumn(out, s).drop("min", "max")


def fit_standard(long: DataFrame, fit_where: Column | None = None, group=("feature",), value="value") -> DataFrame:
    """Mean and population std (ddof 0; 0 → 1)."""
    a = _fit_rows(long, fit_where, value).groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("__s"))
    return a.select(*group, "mean", F.when(F.col("__s") == 0, F.lit(1.0)).otherwise(F.col("__s")).alias("std"))


def apply_standard(long: DataFrame, params: DataFrame, group=("feature",), value="value", out="scaled") -> DataFrame:
    j = long.join(F.broadcast(params), list(group), "left")  # one row per feature
    return j.withColumn(out, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def fit_robust(long: DataFrame, fit_where: Column | None = None, group=("feature",), value="value",
               exact: bool = True) -> DataFrame:
    """Median and IQR (linear quantiles); IQR 0 → 1."""
    qs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    q = F.percentile(value, qs) if exact else F.percentile_approx(value, qs, 10000)
    a = _fit_rows(long, fit_where, value).groupBy(*group).agg(q.alias("__q"))
    iqr = F.col("__q")[2] - F.col("__q")[0]
    return a.select(*group, F.col("__q")[1].alias("median"),
                    F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("iqr"))


def apply_robust(long: DataFrame, params: DataFrame, group=("feature",), value="value", out="scaled") -> DataFrame:
    j = long.join(F.broadcast(params), list(group), "left")  # one row per feature
    return j.withColumn(out, (F.col(value) - F.col("median")) / F.col("iqr")).drop("median", "iqr")


def fit_median(long: DataFrame, fit_where: Column | None = None, group=("feature",), value="value",
               exact: bool = True) -> DataFrame:
    """train median per feature (``exact=False``: approximate)."""
    from tidewater.operators.quality import pct
    return _fit_rows(long, fit_where, value).groupBy(*group).agg(pct(value, 0.5, exact).alias("median"))


def apply_impute(long: DataFrame, params: DataFrame, group=("feature",), value="value", out="imputed",
                 fallback: float | None = 0.0) -> DataFrame:
    """NULL → train median, then ``fallback``; flag column
    ``was_missing``."""
    j = long.join(F.broadcast(params), list(group), "left")  # one row per feature
    fill = F.coalesce(F.col(value), F.col("median"), F.lit(fallback) if fallback is not None else F.lit(None))
    return j.withColumns({out: fill.cast("double"), "was_missing": F.col(value).isNull().cast("int")}).drop("median")


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson transform for a given lambda (column or literal)."""
    pos = x >= 0
    eps = 1e-12
    t_pos = F.when(F.abs(lam) < eps, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    t_neg = F.when(F.abs(lam - 2.0) < eps, -F.log1p(-x)).otherwise(-(F.pow(-x + 1.0, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(pos, t_pos).otherwise(t_neg)


def fit_yeo_johnson(long: DataFrame, fit_where: Column | None = None, group=("feature",), value="value",
                    low: float = -5.0, high: float = 5.0, points: int = 17, tolerance: float = 2e-5) -> DataFrame:
    """Lambda maximising the Yeo-Johnson profile log-likelihood
    ``-n/2 ln(var(y)) + (lambda - 1) sum(sign(x) ln(|x| + 1))`` between ``low`` and ``high``.

    The likelihood has one maximum, so it is bracketed: every round evaluates ``points`` equally spaced lambdas of
    each group's bracket in one aggregation over all groups and keeps the two intervals around the best one,
    until a bracket is narrower than ``tolerance`` (7 rounds by default).  Fit rows are written once; a round's trials fan out inside
    its map stage and collapse in the partial aggregation.
    """
    group = list(group)
    d = cut_lineage(_fit_rows(long, fit_where, value).select(*group, F.col(value).cast("double").alias("__x")))
    brackets = d.groupBy(*group).agg(F.count("__x").alias("__n"), F.sum(F.signum("__x") * F.log1p(F.abs("__x"))).alias("__s"))
    brackets = cut_lineage(brackets.withColumns({"__lo": F.lit(float(low)), "__hi": F.lit(float(high))}))
    width = high - low
    while width > tolerance:
        step = (F.col("__hi") - F.col("__lo")) / (points - 1)
        trial = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda j: F.col("__lo") + step * j))
        # a row per group meets the rows; trials are summed up before anything is shuffled
        spread = (join_null_safe(d, brackets.withColumn("__step", step), group).withColumn("__lam", trial)
                  .groupBy(*group, "__lam").agg(F.var_pop(yeo_johnson(F.col("__x"), F.col("__lam"))).alias("__v"),
                                                *[F.first(c).alias(c) for c in ("__n", "__s", "__lo", "__hi", "__step")]))
        fit = F.when(F.col("__v") > 0, -F.col("__n") / 2.0 * F.log("__v") + (F.col("__lam") - 1.0) * F.col("__s"))
        best = F.max(F.struct(fit.alias("fit"), (-F.col("__lam")).alias("lam"), "__n", "__s", "__lo", "__hi", "__step")).alias("b")
        lam = -F.col("b.lam")
        brackets = cut_lineage(spread.groupBy(*group).agg(best).select(
            *group, "b.__n", "b.__s", F.greatest("b.__lo", lam - F.col("b.__step")).alias("__lo"), F.least("b.__hi", lam + F.col("b.__step")).alias("__hi")))
        width = width * 2 / (points - 1)
    best = brackets.select(*group, ((F.col("__lo") + F.col("__hi")) / 2).alias("lambda"))
    # standardisation parameters of the transformed train values
    ty = yeo_johnson(F.col("__x"), F.col("lambda"))
    s = join_null_safe(d, best, group).groupBy(*group).agg(F.first("lambda").alias("lambda"), F.avg(ty).alias("mean"), F.stddev_pop(ty).alias("__s"))
    return s.select(*group, "lambda", "mean", F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")).alias("std"))


def apply_yeo_johnson(long: DataFrame, params: DataFrame, group=("feature",), value="value", out="scaled") -> DataFrame:
    j = long.join(F.broadcast(params), list(group), "left")  # one row per feature
    return j.withColumn(out, (yeo_johnson(F.col(value), F.col("lambda")) - F.col("mean")) / F.col("std")) \
        .drop("lambda", "mean", "std")


def processing_report(before: DataFrame, after: DataFrame, group=("feature",), value="value", out_value="scaled") -> DataFrame:
    """Skew before / after per feature and a suggested scaler
    (|skew| > 1 → power, else standard)."""
    b = before.groupBy(*group).agg(F.skewness(value).alias("skew_before"))
    a = after.groupBy(*group).agg(F.skewness(out_value).alias("skew_after"))
    r = b.join(a, list(group), "left")
    return r.withColumn("suggested", F.when(F.abs("skew_before") > 1.0, "power").otherwise("standard"))


def fit_grouped(long: DataFrame, scaler_of: dict[str, str], fit_where: Column | None = None,
                default: str = "standard", feature: str = "feature", value: str = "value") -> DataFrame:
    """One parameter table (feature, scaler, loc, scale) with the
    scaler chosen per feature (standard / robust / minmax / passthrough),
    fitted on ``fit_where`` rows in a single aggregation."""
    from tidewater.operators.quality import pct
    rows = _fit_rows(long, fit_where, value)
    mapping = F.create_map(*[x for k, v in scaler_of.items() for x in (F.lit(k), F.lit(v))]) if scaler_of else None
    sc = F.coalesce(mapping[F.col(feature)], F.lit(default)) if mapping is not None else F.lit(default)
    a = rows.groupBy(feature).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"),
                                  F.min(value).alias("__lo"), F.max(value).alias("__hi"),
                                  pct(value, [0.25, 0.5, 0.75]).alias("__q"))
    a = a.withColumn("scaler", sc)
    iqr = F.col("__q")[2] - F.col("__q")[0]
    rng = F.col("__hi") - F.col("__lo")
    loc = (F.when(F.col("scaler") == "standard", F.col("__m")).when(F.col("scaler") == "robust", F.col("__q")[1])
           .when(F.col("scaler") == "minmax", F.col("__lo")).otherwise(F.lit(0.0)))
    scale = (F.when(F.col("scaler") == "standard", F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__s")))
             .when(F.col("scaler") == "robust", F.when(iqr == 0, 1.0).otherwise(iqr))
             .when(F.col("scaler") == "minmax", F.when(rng == 0, 1.0).otherwise(rng)).otherwise(F.lit(1.0)))
    return a.select(feature, "scaler", loc.alias("loc"), scale.alias("scale"))


def apply_grouped(long: DataFrame, params: DataFrame, feature: str = "feature", value: str = "value",
                  out: str = "scaled") -> DataFrame:
    """(x - loc) / scale with the per-feature parameters (one join)."""
    j = long.join(F.broadcast(params), feature, "left")
    return j.withColumn(out, (F.col(value) - F.col("loc")) / F.col("scale"))


def impute_with_names(long: DataFrame, ids: Sequence[str], features: Sequence[str],
                      fit_where: Column | None = None, feature: str = "feature", value: str = "value",
                      out_list: str = "imputed") -> DataFrame:
    """fill missing request features with their (fitted) means and list
    the imputed names, per row of a long (ids, feature, value) table.

    Means are one row per feature joined on ``feature`` (no constant-key
    join); the rows are folded back to wide form with one groupBy on the
    ids, the imputed names in ``features`` order."""
    ids = list(ids)
    means = _fit_rows(long, fit_where, value).groupBy(feature).agg(F.avg(value).alias("__mean"))
    j = long.join(F.broadcast(means), feature, "left")
    j = j.withColumns({"__filled": F.coalesce(F.col(value), F.col("__mean")),
                       "__miss": F.col(value).isNull()})
    pos = F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(f), F.lit(i))])
    agg = [F.max(F.when(F.col(feature) == f, F.col("__filled"))).alias(f) for f in features]
    agg.append(F.array_sort(F.collect_list(F.when(F.col("__miss"), F.struct(pos[F.col(feature)].alias("i"),
                                                                              F.col(feature).alias("n")))))
               .alias("__names"))
    w = j.groupBy(*ids).agg(*agg)  # one group per row id: at most len(features) values
    return w.withColumn(out_list, F.transform("__names", lambda x: x["n"])).drop("__names")
