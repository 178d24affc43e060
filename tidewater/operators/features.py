"""Lag, rolling, exponential, technical and calendar features.

Every function takes a panel keyed by ``keys`` (default ``series_id``) and
ordered by ``order`` (default ``date``) and returns it with new columns.
All windows share one partitioning, so Catalyst plans one exchange and one
sort per key for a whole feature block; Spark's ``Window`` operator is
evaluated once per distinct frame inside the same stage.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import cyclical, eps_ratio, null_safe_flag, regime_code
from tidewater.functions.windows import rolling, series_window
from tidewater.operators.scan import alpha_from_span, ewm_mean
from tidewater.operators.scan import running, volume_bucket

__all__ = [
    "pct_change", "diff", "add_returns", "add_lags", "add_forward_target", "add_rolling",
    "zscore_fallback", "rolling_quantile_flag", "rsi", "macd", "bollinger", "momentum",
    "technical_features", "streak_runs", "streak_summary", "equity_curve", "recency_weights", "recency_weight_set",
    "rolling_origin_folds", "sliding_sequences", "lag_consistency", "autocorrelation",
    "cyclical_calendar", "regime_series", "rolling_corr", "corr_expr", "pair_mask",
]


def _k(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def pct_change(x, k: int, w) -> Column:
    """``x / lag(x, k) - 1``; zero or missing base gives NULL (no padding)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(x, F.lag(x, k).over(w)) - F.lit(1.0)


def diff(x, k: int, w) -> Column:
    """``x - lag(x, k)``."""
    x = F.col(x) if isinstance(x, str) else x
    return x - F.lag(x, k).over(w)


def add_returns(df: DataFrame, x: str, periods: Sequence[int] = (1,), keys="series_id", order="date",
                prefix: str = "ret") -> DataFrame:
    w = series_window(_k(keys), order)
    return df.withColumns({(f"{prefix}{k}" if k != 1 else prefix): pct_change(x, k, w) for k in periods})


def add_lags(df: DataFrame, cols: Sequence[str], lags: Sequence[int], keys="series_id", order="date") -> DataFrame:
    """``{c}_lag{k}``."""
    w = series_window(_k(keys), order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags})


def add_forward_target(df: DataFrame, x: str, keys="series_id", order="date", drop_missing: bool = True,
                       out: str | None = None) -> DataFrame:
    """Next-row value and its date; rows without a target are dropped."""
    w = series_window(_k(keys), order)
    out = out or f"{x}_fwd1"
    d = df.withColumns({out: F.lead(x, 1).over(w), f"{out}_date": F.lead(order, 1).over(w)})
    return d.where(F.col(out).isNotNull()) if drop_missing else d


def add_rolling(df: DataFrame, x: str, n: int, stats: Sequence[str] = ("mean",), keys="series_id",
                order="date", min_periods: int | None = None) -> DataFrame:
    """Rolling mean/sum/std (sample ``std``, population ``std_pop``),
    min/max, with pandas ``min_periods`` semantics."""
    w = series_window(_k(keys), order)
    fns = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "std_pop": F.stddev_pop,
           "min": F.min, "max": F.max}
    return df.withColumns({f"{x}_{s}{n}": rolling(fns[s], x, n, w, min_periods) for s in stats})


def zscore_fallback(df: DataFrame, x: str, out: str, n: int = 252, min_periods: int = 30,
                    exp_min_periods: int = 5, keys="series_id", order="date") -> DataFrame:
    """Rolling z (n rows, sample std, min_periods) falling back to an
    expanding z (population std, std 0 → NULL), then 0.  A zero rolling std
    also falls back (pandas would produce +-inf there, which the reference
    never fills)."""
    w = series_window(_k(keys), order)
    xc = F.col(x)
    zr = F.try_divide(xc - rolling(F.avg, x, n, w, min_periods), rolling(F.stddev_samp, x, n, w, min_periods))
    ef = w.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.count(xc).over(ef) >= exp_min_periods
    sd = F.stddev_pop(xc).over(ef)
    ze = F.when(ok, F.try_divide(xc - F.avg(xc).over(ef), F.when(sd != 0, sd)))
    return df.withColumn(out, F.coalesce(zr, ze, F.lit(0.0)))


def rolling_quantile_flag(df: DataFrame, x: str, q: float = 0.95, n: int = 90, min_periods: int = 30,
                          keys="series_id", order="date", qcol: str | None = None,
                          flag: str | None = None) -> DataFrame:
    """Rolling linear-interpolated quantile and ``x > q`` spike flag
    (missing → 0).  ``percentile`` over a bounded ROWS frame keeps at most
    ``n`` values per row in memory."""
    w = series_window(_k(keys), order)
    qcol = qcol or f"{x}_q{int(round(q * 100))}_{n}"
    flag = flag or f"{x}_spike"
    d = df.withColumn(qcol, rolling(lambda c: F.percentile(c, F.lit(q)), x, n, w, min_periods))
    return d.withColumn(flag, null_safe_flag(F.col(x) > F.col(qcol)))


def rolling_corr(df: DataFrame, a: str, b: str, n: int, out: str, keys="series_id", order="date") -> DataFrame:
    """Pairwise rolling Pearson correlation, NULL until n complete pairs."""
    w = series_window(_k(keys), order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.when(F.count(pair_mask(a, b)).over(w) >= n, corr_expr(a, b, w)))


def pair_mask(a: str, b: str) -> Column:
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(1))


def corr_expr(a: str, b: str, w=None) -> Column:
    """Pearson r on pairwise-complete rows, NULL when a side is constant.

    Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI mode for a constant
    input, so r is assembled from covariance and standard deviations with
    ``try_divide``.  ``w`` makes it a window expression.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    ov = (lambda e: e.over(w)) if w is not None else (lambda e: e)
    sx, sy = ov(F.stddev_pop(x)), ov(F.stddev_pop(y))
    return F.try_divide(ov(F.covar_pop(x, y)), sx * sy)


def rsi(df: DataFrame, price: str, n: int = 14, out: str = "rsi_14", shift: int = 1,
        keys="series_id", order="date") -> DataFrame:
    """Simple-mean RSI with epsilon 1e-10, shifted ``shift`` rows."""
    w = series_window(_k(keys), order)
    d = df.withColumn("__delta", diff(price, 1, w))
    d = d.withColumns({"__gain": F.when(F.col("__delta").isNotNull(), F.greatest("__delta", F.lit(0.0))),
                       "__loss": F.when(F.col("__delta").isNotNull(), -F.least("__delta", F.lit(0.0)))})
    rs = F.try_divide(rolling(F.avg, "__gain", n, w), rolling(F.avg, "__loss", n, w) + F.lit(1e-10))
    d = d.withColumn("__rsi", F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs))
    d = d.withColumn(out, F.lag("__rsi", shift).over(w) if shift else F.col("__rsi"))
    return d.drop("__delta", "__gain", "__loss", "__rsi")


def macd(df: DataFrame, price: str, fast: int = 12, slow: int = 26, signal: int = 9, shift: int = 1,
         keys="series_id", order="date", bucket="month") -> DataFrame:
    """MACD line, signal, histogram and cross flag, shifted ``shift`` rows."""
    keys = _k(keys)
    d = ewm_mean(df, price, {"__ef": alpha_from_span(fast), "__es": alpha_from_span(slow)}, None, keys, order, bucket)
    d = d.withColumn("__macd", F.col("__ef") - F.col("__es"))
    d = ewm_mean(d, "__macd", "__sig", alpha_from_span(signal), keys, order, bucket)
    w = series_window(keys, order)
    sh = (lambda c: F.lag(c, shift).over(w)) if shift else (lambda c: c)
    d = d.withColumns({
        "macd": sh(F.col("__macd")),
        "macd_signal": sh(F.col("__sig")),
        "macd_hist": sh(F.col("__macd") - F.col("__sig")),
        "macd_cross": sh((F.col("__macd") > F.col("__sig")).cast("double")),
    })
    return d.drop("__ef", "__es", "__macd", "__sig")


def bollinger(df: DataFrame, price: str, n: int = 20, k: float = 2.0, shift: int = 1,
              keys="series_id", order="date") -> DataFrame:
    """Bollinger bands on sample std, shifted; width and position with ε 1e-10."""
    w = series_window(_k(keys), order)
    d = df.withColumns({"__sma": rolling(F.avg, price, n, w), "__sd": rolling(F.stddev_samp, price, n, w)})
    d = d.withColumns({"__sma": F.lag("__sma", shift).over(w), "__sd": F.lag("__sd", shift).over(w),
                       "__prev": F.lag(price, shift).over(w)})
    up = F.col("__sma") + F.lit(k) * F.col("__sd")
    lo = F.col("__sma") - F.lit(k) * F.col("__sd")
    d = d.withColumns({"bb_upper": up, "bb_lower": lo})
    d = d.withColumns({
        "bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("__sma") + F.lit(1e-10)),
        "bb_position": F.try_divide(F.col("__prev") - F.col("bb_lower"),
                                    F.col("bb_upper") - F.col("bb_lower") + F.lit(1e-10)),
    })
    return d.drop("__sma", "__sd", "__prev")


def momentum(df: DataFrame, price: str, ret: str, shift: int = 1, keys="series_id", order="date") -> DataFrame:
    """Momentum 5/10/20 and return mean/std 5/20, all shifted."""
    w = series_window(_k(keys), order)
    raw = {f"momentum_{k}": pct_change(price, k, w) for k in (5, 10, 20)}
    raw.update({f"ret_std_{n}": rolling(F.stddev_samp, ret, n, w) for n in (5, 20)})
    raw.update({f"ret_mean_{n}": rolling(F.avg, ret, n, w) for n in (5, 20)})
    d = df.withColumns({f"__{c}": e for c, e in raw.items()})
    return d.withColumns({c: F.lag(f"__{c}", shift).over(w) for c in raw}).drop(*[f"__{c}" for c in raw])


def technical_features(df: DataFrame, price: str = "close", ret: str = "ret", keys="series_id",
                       order="date", drop_incomplete: bool = True) -> DataFrame:
    """Moving averages and crossovers, price vs MA, RSI, MACD,
    Bollinger, momentum and return lags; rows with any NULL feature dropped."""
    keys = _k(keys)
    w = series_window(keys, order)
    ma = {n: rolling(F.avg, price, n, w) for n in (5, 10, 20, 50)}
    d = df.withColumns({f"__ma{n}": e for n, e in ma.items()})
    d = d.withColumns({f"ma_{n}": F.lag(f"__ma{n}", 1).over(w) for n in ma})
    d = d.withColumns({
        "ma_5_10_cross": null_safe_flag(F.col("ma_5") > F.col("ma_10")),
        "ma_10_20_cross": null_safe_flag(F.col("ma_10") > F.col("ma_20")),
        "ma_20_50_cross": null_safe_flag(F.col("ma_20") > F.col("ma_50")),
        "__prev": F.lag(price, 1).over(w),
    })
    d = d.withColumns({"price_vs_ma20": eps_ratio("__prev", "ma_20"), "price_vs_ma50": eps_ratio("__prev", "ma_50")})
    d = rsi(d, price, keys=keys, order=order)
    d = macd(d, price, keys=keys, order=order)
    d = bollinger(d, price, keys=keys, order=order)
    d = momentum(d, price, ret, keys=keys, order=order)
    d = d.withColumns({f"{ret}_lag{k}": F.lag(ret, k).over(w) for k in (1, 2, 3, 5)})
    d = d.drop("__prev", *[f"__ma{n}" for n in ma])
    return d.dropna("any") if drop_incomplete else d


def streak_runs(df: DataFrame, label: str, keys="series_id", order="date") -> DataFrame:
    """Gaps-and-islands run lengths of equal consecutive labels.

    Returns one row per run: keys, run_id, label, length, start, end.
    """
    keys = _k(keys)
    first = [order] if isinstance(order, str) else list(order)
    d = volume_bucket(df.where(F.col(label).isNotNull()), keys, first[0], out="__stretch")
    d = running(d, {"__was": ("lag", label, 1)}, keys, order, bucket=F.col("__stretch"))
    d = d.withColumn("__chg", F.when(F.col("__was") == F.col(label), 0).otherwise(1))
    d = running(d, {"run_id": ("sum", "__chg")}, keys, order, bucket=F.col("__stretch"))
    return d.groupBy(*keys, "run_id").agg(F.first(label).alias(label), F.count(F.lit(1)).alias("length"),
                                          F.min(order).alias("start"), F.max(order).alias("end"))


def streak_summary(runs: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean / max / median run length per label."""
    return runs.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n_runs"), F.avg("length").alias("mean_length"),
        F.max("length").alias("max_length"), F.percentile("length", 0.5).alias("median_length"))


def equity_curve(df: DataFrame, ret: str, keys="series_id", order="date", equity: str = "equity",
                 drawdown: str = "drawdown") -> DataFrame:
    """equity = running product of max(0, 1+r); drawdown vs running
    peak, the peak starting at the first equity value (not 1).  Two scans."""
    growth = F.greatest(F.lit(0.0), F.lit(1.0) + F.coalesce(F.col(ret), F.lit(0.0)))
    first = [order] if isinstance(order, str) else list(order)
    d = running(volume_bucket(df, keys, first[0], out="__stretch"), {equity: ("product", growth)}, keys, order, bucket=F.col("__stretch"))
    d = running(d, {"__peak": ("max", equity)}, keys, order, bucket=F.col("__stretch"))
    peak = F.col("__peak")
    return d.withColumn(drawdown, F.when(peak > 0, F.col(equity) / peak - F.lit(1.0)).otherwise(F.lit(0.0))).drop("__peak", "__stretch")


def recency_weights(df: DataFrame, scheme: str, keys="series_id", order="date", out: str = "weight",
                    half_life: float = 250.0, min_weight: float = 0.1, recent_ratio: float = 0.5,
                    recent_weight: float = 2.0) -> DataFrame:
    """Per-series sample weights by row position, normalised to mean 1.

    exponential: exp(-ln2/h*(n-1-i)); linear: min+(1-min)*i/(n-1);
    step: recent_weight from int(n*(1-r)) on; uniform: 1.
    """
    return recency_weight_set(df, {out: dict(scheme=scheme, half_life=half_life, min_weight=min_weight, recent_ratio=recent_ratio,
                                             recent_weight=recent_weight)}, keys, order)


def recency_weight_set(df: DataFrame, weights: dict[str, dict], keys="series_id", order="date") -> DataFrame:
    """Several weights of ``recency_weights`` (its arguments by output name) from one scan.  The means that
    normalise them follow from the number of rows."""
    keys = _k(keys)
    first = [order] if isinstance(order, str) else list(order)
    d = volume_bucket(df, keys, first[0], out="__stretch", count="__rows")
    d = running(d, {"__at": ("row",)}, keys, order, bucket=F.col("__stretch"))
    i, n = (F.col("__at") - 1).cast("double"), F.col("__rows").cast("double")

    def weight(scheme: str, half_life: float = 250.0, min_weight: float = 0.1, recent_ratio: float = 0.5, recent_weight: float = 2.0) -> Column:
        if scheme == "exponential":
            rate = math.log(2.0) / half_life
            mean = -F.expm1(F.lit(-rate) * n) / (n * F.lit(-math.expm1(-rate)))
            return F.exp(F.lit(-rate) * (n - F.lit(1.0) - i)) / mean
        if scheme == "linear":
            raw = F.lit(min_weight) + F.lit(1.0 - min_weight) * i / (n - F.lit(1.0))
            return F.when(n > 1, raw / F.lit((1.0 + min_weight) / 2.0)).otherwise(F.lit(1.0))
        if scheme == "step":
            start = F.floor(n * F.lit(1.0 - recent_ratio))
            mean = (start + (n - start) * F.lit(recent_weight)) / n
            return F.when(i >= start, F.lit(recent_weight)).otherwise(F.lit(1.0)) / mean
        if scheme == "uniform":
            return F.lit(1.0)
        raise ValueError(f"unknown scheme {scheme}")

    return d.withColumns({out: weight(**w) for out, w in weights.items()}).drop("__at", "__rows", "__stretch")


def rolling_origin_folds(df: DataFrame, n_splits: int = 5, keys="series_id", order="date") -> DataFrame:
    """Expanding-window folds per series (scikit-learn TimeSeriesSplit).

    test size t = n // (n_splits+1); fold k (0-based) tests rows
    [n-(n_splits-k)t, n-(n_splits-1-k)t) and trains on every earlier row.
    Returns the input rows exploded to (fold, role) with role train/test.
    """
    keys = _k(keys)
    w = series_window(keys, order)
    wall = Window.partitionBy(*keys) if keys else Window.partitionBy()
    d = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(wall)})
    t = F.floor(F.col("__n") / F.lit(n_splits + 1))
    d = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    lo = F.col("__n") - (F.lit(n_splits) - F.col("fold")) * t
    hi = lo + t
    role = F.when((F.col("__i") >= lo) & (F.col("__i") < hi), "test").when(F.col("__i") < lo, "train")
    return d.withColumn("role", role).where(F.col("role").isNotNull()).drop("__i", "__n")


def sliding_sequences(df: DataFrame, cols: Sequence[str], length: int, keys="series_id", order="date",
                      out: str = "sequence") -> DataFrame:
    """Last ``length`` feature vectors per row (oldest first); rows without
    full history dropped.  Bounded frame: each row holds ``length`` vectors."""
    w = series_window(_k(keys), order).rowsBetween(-(length - 1), 0)
    d = df.withColumn(out, F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w))
    return d.where(F.size(out) == length)


def lag_consistency(df: DataFrame, base: str, lagged: str, k: int = 1, rtol: float = 1e-3,
                    keys="series_id", order="date") -> DataFrame:
    """Rows where a stored lag differs from the shift of its base."""
    w = series_window(_k(keys), order)
    exp = F.lag(base, k).over(w)
    d = df.withColumn("__exp", exp)
    bad = F.abs(F.col(lagged) - F.col("__exp")) > F.lit(rtol) * F.greatest(F.abs("__exp"), F.lit(1e-12))
    return d.withColumn("lag_mismatch", null_safe_flag(bad)).drop("__exp")


def autocorrelation(df: DataFrame, x: str, max_lag: int, keys="series_id", order="date",
                    squared: bool = False) -> DataFrame:
    """W29/T-15: sample ACF per series, lags 1..max_lag.

    acf(k) = sum((x_t-m)(x_{t-k}-m)) / sum((x_t-m)^2) with the series mean m.
    Lags are generated by ``lag`` over the same window (one sort), the
    products are unpivoted and aggregated per (series, lag).
    """
    keys = _k(keys)
    w = series_window(keys, order)
    wall = Window.partitionBy(*keys) if keys else Window.partitionBy()
    v = F.col(x) * F.col(x) if squared else F.col(x)
    d = df.where(F.col(x).isNotNull()).withColumn("__v", v)
    d = d.withColumn("__c", F.col("__v") - F.avg("__v").over(wall))
    d = d.withColumn("__lags", F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("__c", k).over(w).alias("c"))
                                         for k in range(1, max_lag + 1)]))
    den = d.groupBy(*keys).agg(F.sum(F.col("__c") * F.col("__c")).alias("__den"))
    num = (d.select(*keys, "__c", F.explode("__lags").alias("__l"))
           .groupBy(*keys, F.col("__l.lag").alias("lag"))
           .agg(F.sum(F.col("__c") * F.col("__l.c")).alias("__num")))
    return num.join(den, keys).select(*keys, "lag", F.try_divide(F.col("__num"), F.col("__den")).alias("acf"))


def cyclical_calendar(df: DataFrame, date: str = "date", drop_source: bool = True) -> DataFrame:
    """day_of_week (Mon=0, period 5) and month (phase month-1, period 12)
    encoded as sin/cos."""
    d = df.withColumns({"day_of_week": F.weekday(date), "month": F.month(date), "year": F.year(date)})
    ds, dc = cyclical("day_of_week", 5)
    ms, mc = cyclical(F.col("month") - 1, 12)
    d = d.withColumns({"day_of_week_sin": ds, "day_of_week_cos": dc, "month_sin": ms, "month_cos": mc})
    return d.drop("day_of_week", "month") if drop_source else d


def regime_series(df: DataFrame, rate: str, out: str = "rate_regime", keys="series_id", order="date") -> DataFrame:
    """Regime code from the rate and its one-row change (first row: change 0)."""
    w = series_window(_k(keys), order)
    prev = F.when(F.row_number().over(w) == 1, F.col(rate)).otherwise(F.lag(rate, 1).over(w))
    return df.withColumn("__prev", prev).withColumn(out, regime_code(rate, F.col(rate) - F.col("__prev"))) \
        .drop("__prev")


def calendar_rolling(df: DataFrame, x: str, days: int, stats: Sequence[str] = ("sum",), keys="series_id", order="date") -> DataFrame:
    """Statistics over the last ``days`` calendar days (a RANGE frame on the date), so gaps
    in the series shorten the window instead of reaching further back."""
    day = F.datediff(F.col(order).cast("date"), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*_k(keys)).orderBy(day).rangeBetween(-(days - 1), 0)
    fns = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}
    return df.withColumns({f"{x}_{s}{days}d": fns[s](x).over(w) for s in stats})


def below_trailing_mean(df: DataFrame, x: str, n: int = 30, drop: float = 1.0, out: str | None = None, min_periods: int = 1,
                        keys="series_id", order="date") -> DataFrame:
    """1 where ``x`` is more than ``drop`` below its trailing ``n``-row mean; missing is 0."""
    w = series_window(_k(keys), order)
    mean = rolling(F.avg, x, n, w, min_periods)
    return df.withColumn(out or f"{x}_below{n}", null_safe_flag(F.col(x) < mean - F.lit(drop)))
