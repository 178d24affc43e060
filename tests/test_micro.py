"""Hand-written micro panels (FIXTURES.md) with expected values computed by hand
or by pandas / NumPy brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.scalar import nan_to_null, regime_code
from tidewater.operators import backtest as bt
from tidewater.operators import calendar as cal
from tidewater.operators import evaluate as ev
from tidewater.operators import features as ft
from tidewater.operators import prep
from tidewater.operators import quality as qa
from tidewater.operators.scan import ewm_mean


def _panel(spark, values, start="2024-01-01", sid="a", col="x"):
    dates = pd.bdate_range(start, periods=len(values))
    rows = [(sid, d.date(), None if v is None else float(v)) for d, v in zip(dates, values)]
    return spark.createDataFrame(rows, f"series_id string, date date, {col} double")


def _col(df, c, order="date"):
    return [r[c] for r in df.orderBy("series_id", order).collect()]


def test_ffill_limit_leaves_fifth_null(spark):
    p = _panel(spark, [1, None, None, None, None, 6])
    out = cal.ffill(p, ["x"], limit=3)
    assert _col(out, "x") == [1.0, 1.0, 1.0, 1.0, None, 6.0]
    flags = cal.imputed_flags(p, ["x"])
    assert _col(flags, "x_imputed") == [0, 1, 1, 1, 1, 0]


def test_single_row_series(spark):
    p = _panel(spark, [5.0])
    d = ft.add_returns(p, "x", (1,), prefix="ret")
    d = ft.add_rolling(d, "x", 3, ("mean", "std"))
    r = d.first()
    assert r["ret"] is None and r["x_mean3"] is None and r["x_std3"] is None
    assert ewm_mean(p, "x", "e", 0.3).first()["e"] == 5.0


def test_zero_denominator_and_constant_scalers(spark):
    p = _panel(spark, [0.0, 1.0, 2.0])
    d = ft.add_returns(p, "x", (1,), prefix="ret")
    assert _col(d, "ret")[1] is None  # 1 / 0 → NULL, not an error
    long = spark.createDataFrame([("c", 3.0, "train"), ("c", 3.0, "train"), ("c", 4.0, "test")],
                                 "feature string, value double, split string")
    fit = F.col("split") == "train"
    mm = prep.apply_minmax(long, prep.fit_minmax(long, fit))
    assert [r["scaled"] for r in mm.collect()] == [0.0, 0.0, 0.0]
    st = prep.apply_standard(long, prep.fit_standard(long, fit)).orderBy("value").collect()
    assert [r["scaled"] for r in st] == [0.0, 0.0, 1.0]
    rb = prep.apply_robust(long, prep.fit_robust(long, fit)).orderBy("value").collect()
    assert [r["scaled"] for r in rb] == [0.0, 0.0, 1.0]


def test_rank_ties_auc_and_spearman(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 200)
    p = np.round(rng.random(200), 1)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "target int, proba_up double")
    auc = ev.roc_auc(df.withColumn("g", F.lit(1)), ["g"]).first()["AUC"]
    pos, neg = p[y == 1], p[y == 0]
    brute = (sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)) / (len(pos) * len(neg))
    assert auc == pytest.approx(brute, abs=1e-12)
    from tidewater.operators.stats import average_ranks
    r = average_ranks(df.withColumn("g", F.lit(1)), ["g"], "proba_up")
    tot = r.agg(F.sum(F.col("avg_rank") * F.col("__cnt"))).first()[0]
    assert tot == pytest.approx(200 * 201 / 2)
    pr = pd.Series(p).rank(method="average")
    got = {row["proba_up"]: row["avg_rank"] for row in r.collect()}
    assert all(got[v] == pytest.approx(rk) for v, rk in zip(p, pr))


def test_weekend_roll_reference_and_correct(spark):
    days = ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08"]  # Fri Sat Sun Mon
    df = spark.createDataFrame([(d, 1.0) for d in days], "d string, v double").withColumn("d", F.to_date("d"))
    ref = df.select(cal.roll_to_trading_day("d").alias("r")).collect()
    assert {str(r["r"]) for r in ref} == {"2024-01-08"}
    ok = df.select(cal.roll_to_trading_day("d", friday_is_trading=True).alias("r")).collect()
    assert sorted(str(r["r"]) for r in ok) == ["2024-01-05", "2024-01-08", "2024-01-08", "2024-01-08"]


def test_asof_first_of_month_on_weekend(spark):
    # 2022-10-01 is a Saturday: an exact-date join loses it, the as-of join keeps it
    left = spark.createDataFrame([("a", "2022-09-30"), ("a", "2022-10-03"), ("a", "2022-10-04")],
                                 "series_id string, d string").withColumn("date", F.to_date("d")).drop("d")
    right = spark.createDataFrame([("2022-09-01", 1.0), ("2022-10-01", 2.0)], "m string, level double") \
        .withColumn("month", F.to_date("m")).drop("m")
    out = cal.asof_join(left, right, "date", "month", ["level"])
    assert _col(out, "level") == [1.0, 2.0, 2.0]
    tol = cal.asof_join(left, right, "date", "month", ["level"], tolerance_days=2)
    assert _col(tol, "level") == [None, 2.0, None]


def test_asof_matches_pandas_merge_asof(spark):
    rng = np.random.default_rng(0)
    lt = pd.DataFrame({"k": rng.integers(0, 3, 300), "t": pd.to_datetime("2020-01-01") +
                       pd.to_timedelta(rng.integers(0, 900, 300), "D")})
    rt = pd.DataFrame({"k": rng.integers(0, 3, 80), "t": pd.to_datetime("2020-01-01") +
                       pd.to_timedelta(rng.choice(900, 80, replace=False), "D"), "v": rng.random(80)})
    rt = rt.drop_duplicates(["k", "t"])
    exp = pd.merge_asof(lt.sort_values("t"), rt.sort_values("t"), on="t", by="k", direction="backward")
    L = spark.createDataFrame([(int(a), b.date()) for a, b in zip(lt.k, lt.t)], "k int, date date")
    R = spark.createDataFrame([(int(a), b.date(), float(c)) for a, b, c in zip(rt.k, rt.t, rt.v)],
                              "k int, rdate date, v double")
    got = cal.asof_join(L, R, "date", "rdate", ["v"], by=["k"]).toPandas()
    e = sorted(zip(exp.k, exp.t.dt.date, exp.v.fillna(-1)))
    g = sorted(zip(got.k, got.date, got.v.fillna(-1)))
    assert e == g


def test_regime_boundaries(spark):
    rows = [(None, 0.0), (0.4, 0.0), (0.5, 0.1), (0.5, 0.10001), (3.0, 0.0), (3.01, 0.05), (3.01, -0.1)]
    df = spark.createDataFrame(rows, "r double, d double")
    got = [r[0] for r in df.select(regime_code("r", "d")).collect()]
    assert got == [None, 0, 3, 1, 3, 2, 3]
    s = _panel(spark, [1.0, 1.2, 1.25], col="rate")
    assert _col(ft.regime_series(s, "rate"), "rate_regime") == [3, 1, 3]


def test_drawdown_peak_starts_at_first_equity(spark):
    p = _panel(spark, [-0.1, 0.05, -0.2], col="net_return")
    p = p.withColumns({"turnover": F.lit(0), "position": F.lit(1), "zero_cost_equity": F.lit(1.0)})
    w = ft.equity_curve(p, "net_return")
    eq = _col(w, "equity")
    assert eq == pytest.approx([0.9, 0.945, 0.756])
    m = bt.strategy_metrics(w.drop("drawdown"), ["series_id"]).first()
    assert m["max_drawdown"] == pytest.approx(0.756 / 0.945 - 1)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "target int, proba_up double").withColumn("g", F.lit(1))
    assert ev.roc_auc(df, ["g"]).first()["AUC"] is None


def test_step_weights_odd_n(spark):
    p = _panel(spark, [1, 2, 3, 4, 5])
    w = _col(ft.recency_weights(p, "step", recent_ratio=0.5, recent_weight=2.0), "weight")
    raw = np.array([1, 1, 2, 2, 2.0])
    assert w == pytest.approx(list(raw / raw.mean()))
    e = _col(ft.recency_weights(p, "exponential", half_life=2.0), "weight")
    raw = np.exp(-math.log(2) / 2.0 * (4 - np.arange(5)))
    assert e == pytest.approx(list(raw / raw.mean()))


def test_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(nan_to_null("x")).collect()].count(None) == 1
    assert qa.infinity_report(df, ["x"]).first()["inf_count"] == 2


def test_lag_signal_longer_than_series(spark):
    p = _panel(spark, [0.5, -0.5, 0.5], col="predicted_return").withColumn("actual_return", F.lit(0.01))
    d = bt.simulate(p, ["series_id"], "date", "predicted_return", "actual_return", 0.1, 0.001, lag_days=5)
    assert _col(d, "position") == [0, 0, 0]
    assert _col(d, "equity") == [1.0, 1.0, 1.0]


def test_ewm_matches_pandas_across_buckets(spark):
    rng = np.random.default_rng(1)
    vals = list(rng.normal(100, 5, 130))
    vals[7] = None
    p = _panel(spark, vals)
    got = _col(ewm_mean(p, "x", "e", 2 / 13), "e")
    exp = pd.Series(vals, dtype="float64").ewm(alpha=2 / 13, adjust=False, ignore_na=True).mean()
    exp[pd.Series(vals, dtype="float64").isna()] = np.nan
    for g, e in zip(got, exp):
        assert (g is None and np.isnan(e)) or g == pytest.approx(e, rel=1e-12)


def test_threshold_sweep_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "target int, proba_up double")
    sw = ev.threshold_sweep(df, []).orderBy("threshold").collect()
    grid = ev.linspace_grid(0.3, 0.7, 161)
    assert len(sw) == 161
    for r, t in zip(sw, grid):
        assert r["threshold"] == t
        assert r["TP"] == int(((p >= t) & (y == 1)).sum())
        assert r["FP"] == int(((p >= t) & (y == 0)).sum())
        assert r["TN"] == int(((p < t) & (y == 0)).sum())


def test_rolling_quantile_matches_pandas(spark):
    rng = np.random.default_rng(4)
    vals = list(rng.random(60))
    p = _panel(spark, vals)
    got = _col(ft.rolling_quantile_flag(p, "x", 0.95, 20, 5, qcol="q", flag="f"), "q")
    exp = pd.Series(vals).rolling(20, min_periods=5).quantile(0.95)
    for g, e in zip(got, exp):
        assert (g is None and np.isnan(e)) or g == pytest.approx(e, rel=1e-12)


def test_sample_skew_kurt_match_pandas(spark):
    rng = np.random.default_rng(5)
    vals = rng.gamma(2.0, size=50)
    long = spark.createDataFrame([("f", float(v)) for v in vals], "feature string, value double")
    r = qa.describe_long(long).first()
    s = pd.Series(vals)
    assert r["skew"] == pytest.approx(s.skew(), rel=1e-9)
    assert r["kurtosis"] == pytest.approx(s.kurt(), rel=1e-9)
    assert r["q25"] == pytest.approx(s.quantile(0.25))


def test_rolling_folds_disjoint(spark):
    p = _panel(spark, list(range(30)))
    f = ft.rolling_origin_folds(p, 5).collect()
    for k in range(5):
        tr = {r["date"] for r in f if r["fold"] == k and r["role"] == "train"}
        te = {r["date"] for r in f if r["fold"] == k and r["role"] == "test"}
        assert not tr & te and len(te) == 5 and max(tr) < min(te)
