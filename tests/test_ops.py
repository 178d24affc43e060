"""Operator checks against NumPy brute force and hand-made inputs."""

import json
import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import features as ft
from tidewater.operators import neighbors as nb
from tidewater.operators import reshape as rs
from tidewater.operators import stats as st
from tidewater.sources import files as src
from tidewater.sources import incremental as inc


def test_knn_and_loo_match_numpy(spark):
    rng = np.random.default_rng(7)
    refs = rng.normal(size=(60, 4))
    ys = rng.integers(0, 2, 60)
    qs = rng.normal(size=(3, 4))
    R = spark.createDataFrame([(i, [float(v) for v in refs[i]], int(ys[i])) for i in range(60)],
                              "id long, v array<double>, y int")
    Q = spark.createDataFrame([(100 + j, [float(v) for v in qs[j]]) for j in range(3)], "query_id long, v array<double>")
    mu, sd = refs.mean(0), refs.std(0)

    def score(q):
        d = np.sqrt((((q - mu) / sd - (refs - mu) / sd) ** 2).mean(1))
        idx = np.lexsort((np.arange(60), d))[:5]
        w = 1 / np.maximum(d[idx], 0.05)
        return (w * ys[idx]).sum() / w.sum()

    got = {r["query_id"]: r["score"] for r in nb.knn_score(R, Q, 5, "id", "v", "y").collect()}
    for j in range(3):
        assert got[100 + j] == pytest.approx(score(qs[j]), rel=1e-12)
    att = nb.loo_attribution(R, Q, 5, "id", "v", "y", top=4).collect()
    for r in att:
        q = qs[r["query_id"] - 100].copy()
        q[r["dim"]] = mu[r["dim"]]
        assert r["attribution"] == pytest.approx(score(qs[r["query_id"] - 100]) - score(q), abs=1e-12)


def test_vif_matches_numpy(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=200)
    b = a + rng.normal(scale=0.5, size=200)
    c = rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)], "a double, b double, c double")
    got = {r["feature"]: r["vif"] for r in st.vif(df, ["a", "b", "c"]).collect()}
    exp = np.diag(np.linalg.inv(np.corrcoef(np.vstack([a, b, c]))))
    for f, e in zip("abc", exp):
        assert got[f] == pytest.approx(e, rel=1e-9)


def test_kolmogorov_p_and_mann_whitney(spark):
    one = spark.range(1).select(st.kolmogorov_p(F.lit(0.1), F.lit(200), F.lit(200)).alias("p")).first()["p"]
    lam = (math.sqrt(100) + 0.12 + 0.11 / math.sqrt(100)) * 0.1
    exp = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    assert one == pytest.approx(exp, rel=1e-12)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=80), 1)
    y = rng.integers(0, 2, 80)
    df = spark.createDataFrame([("f", float(a), int(b)) for a, b in zip(x, y)], "feature string, value double, d int")
    r = st.mann_whitney(df, ["feature"], "value", "d").first()
    x1, x0 = x[y == 1], x[y == 0]
    u = sum((a > b) + 0.5 * (a == b) for a in x1 for b in x0)
    assert r["mw_u"] == pytest.approx(u)


def test_kpss_matches_numpy(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=150).cumsum() * 0.1 + rng.normal(size=150)
    dates = pd.bdate_range("2020-01-01", periods=150)
    df = spark.createDataFrame([("s", d.date(), float(v)) for d, v in zip(dates, x)], "series_id string, date date, x double")
    got = st.kpss_level(df, "x").first()
    n = len(x)
    e = x - x.mean()
    S = e.cumsum()
    L = int(math.floor(12 * (n / 100) ** 0.25))
    g = [np.dot(e[k:], e[:n - k]) / n for k in range(L + 1)]
    s2 = g[0] + 2 * sum((1 - k / (L + 1)) * g[k] for k in range(1, L + 1))
    assert got["lags"] == L
    assert got["kpss_stat"] == pytest.approx((S ** 2).sum() / n ** 2 / s2, rel=1e-10)


def test_adf_matches_lstsq(spark):
    rng = np.random.default_rng(11)
    x = np.cumsum(rng.normal(size=120)) + 50
    dates = pd.bdate_range("2020-01-01", periods=120)
    df = spark.createDataFrame([("s", d.date(), float(v)) for d, v in zip(dates, x)], "series_id string, date date, x double")
    got = st.adf_fixed_lag(df, "x").first()
    dy = np.diff(x)
    Y = dy[1:]
    X = np.column_stack([np.ones(len(Y)), x[1:-1], dy[:-1]])
    beta, res, *_ = np.linalg.lstsq(X, Y, rcond=None)
    sigma2 = ((Y - X @ beta) ** 2).sum() / (len(Y) - 3)
    se = math.sqrt(sigma2 * np.linalg.inv(X.T @ X)[1, 1])
    assert got["adf_gamma"] == pytest.approx(beta[1], rel=1e-8)
    assert got["adf_stat"] == pytest.approx(beta[1] / se, rel=1e-8)


def test_pacf_matches_yule_walker(spark):
    rho = [0.5, 0.2, -0.1, 0.05]
    acf = spark.createDataFrame([("s", k + 1, r) for k, r in enumerate(rho)], "series_id string, lag int, acf double")
    got = [r["pacf"] for r in st.pacf_from_acf(acf).orderBy("lag").collect()]
    full = [1.0] + rho
    for k in range(1, 5):
        T = np.array([[full[abs(i - j)] for j in range(k)] for i in range(k)])
        phi = np.linalg.solve(T, np.array(full[1:k + 1]))
        assert got[k - 1] == pytest.approx(phi[-1], rel=1e-10)


def test_greedy_prune(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.8)], "f1 string, f2 string, spearman_r double")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.4)], "feature string, research_score double")
    got = {r["feature"]: (r["kept"], r["dropped_for"]) for r in st.greedy_prune(pairs, scores).collect()}
    assert got == {"b": (True, None), "a": (False, "b"), "c": (False, "b")}


def test_sources_parsers(spark):
    obs = spark.createDataFrame([(json.dumps({"observations": [{"date": "2024-01-01", "value": "1.5"},
                                                               {"date": "2024-02-01", "value": "."}]}),)], "json string")
    rows = src.parse_observations(obs).orderBy("date").collect()
    assert [r["value"] for r in rows] == [1.5, None]
    nested = spark.createDataFrame([(json.dumps({"request": {"series": [{"data": [{"period": "2024-01-05", "value": "7"}]}]}}),),
                                    (json.dumps({"response": {"data": [{"period": "2024-01-12", "value": "8"}]}}),)],
                                   "json string")
    assert sorted(r["value"] for r in src.parse_nested_series(nested).collect()) == [7.0, 8.0]
    t = spark.createDataFrame([("",), ("TRUE",), ("-12",), ("1.5e3",), ("abc",)], "s string")
    kinds = [r["k"]["kind"] for r in t.select(src.coerce_text("s").alias("k")).collect()]
    assert kinds == ["null", "bool", "int", "float", "string"]


def test_tsv_publish_manifest_union(spark):
    d = tempfile.mkdtemp(prefix="tw-src-")
    p = os.path.join(d, "e.tsv")
    with open(p, "w") as fh:
        fh.write("20240101\tUSA\t1.5\n20240102\tFRA\t2.0\nbroken line without tabs and extra\t\t\t\t\n")
    df = src.read_event_tsv(spark, p, ["Day", "Actor", "Tone"])
    assert df.count() == 2
    root = os.path.join(d, "pub")
    src.publish_atomic(df, root)
    src.publish_atomic(df.limit(1), root)
    assert src.read_published(spark, root).count() == 1
    m = src.content_manifest(df, "Day", "Actor")
    changed = df.withColumn("Actor", F.when(F.col("Day") == "20240102", "DEU").otherwise(F.col("Actor")))
    diff = src.verify_manifest(src.content_manifest(changed, "Day", "Actor"), m, "Day").collect()
    assert [(r["Day"], r["status"]) for r in diff] == [("20240102", "changed")]
    df.write.parquet(os.path.join(d, "a"))
    df.withColumn("extra", F.lit(1)).write.parquet(os.path.join(d, "b"))
    u = src.union_existing(spark, [os.path.join(d, x) for x in ("a", "missing", "b")])
    assert u.count() == 4 and "extra" in u.columns


def test_incremental_landing(spark):
    src_df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")], "id int, d string") \
        .withColumn("d", F.to_date("d"))
    done = src_df.where("id = 1")
    assert sorted(r["id"] for r in inc.land_increment(src_df, done, "d").collect()) == [2, 3]
    assert sorted(r["id"] for r in inc.after_watermark(src_df, src_df.where("id <= 2"), "d").collect()) == [3]
    empty = src_df.where("id > 10")
    assert inc.after_watermark(src_df, empty, "d").count() == 3


def test_reshape_helpers(spark):
    df = spark.createDataFrame([(1, "x", 0.3), (1, "y", 0.9), (2, "x", 0.5)], "k int, m string, v double")
    w = rs.pivot_wide(df, ["k"], "m", ["x", "y"], "v").orderBy("k").collect()
    assert (w[0]["x"], w[0]["y"], w[1]["y"]) == (0.3, 0.9, None)
    assert rs.paginate(df, ["k", "m"], 5000, -3).count() == 3
    assert rs.detect_schema(df, {"wide": ["x"], "long": ["k", "m"]}) == "long"
    a = rs.argmax_row(df, ["k"], F.col("v")).orderBy("k").collect()
    assert [r["m"] for r in a] == ["y", "x"]
    clean, rep = rs.drop_contaminated(df, spark.createDataFrame([("v", "future", "uses next-day data")],
                                                                "column string, category string, reason string"))
    assert clean.columns == ["k", "m"] and rep.count() == 1
    assert rs.overlap_count(df.select("k"), df.where("k = 2").select("k"), ["k"]).first()["overlap"] == 1
    one = df.agg(F.count(F.lit(1)).alias("c"), F.max("m").alias("mm"))
    res = {r["check"]: r["pass"] for r in rs.release_checks([("n", F.lit(3), F.col("c")),
                                                              ("best", F.lit("y"), F.col("mm"))], one).collect()}
    assert res == {"n": True, "best": True}


def test_local_surrogate_matches_numpy(spark):
    rng = np.random.default_rng(12)
    refs = rng.normal(size=(40, 3))
    ys = (refs[:, 0] + 0.1 * rng.normal(size=40) > 0).astype(int)
    q = rng.normal(size=(1, 3))
    R = spark.createDataFrame([(i, [float(v) for v in refs[i]], int(ys[i])) for i in range(40)],
                              "id long, v array<double>, y int")
    Q = spark.createDataFrame([(7, [float(v) for v in q[0]])], "query_id long, v array<double>")
    got = nb.local_surrogate(R, Q, "id", "v", "y", min_rows=25, rows_per_dim=1).orderBy("dim").collect()
    mu, sd = refs.mean(0), refs.std(0)
    Z, qz = (refs - mu) / sd, (q[0] - mu) / sd
    d = np.sqrt(((Z - qz) ** 2).mean(1))
    idx = np.lexsort((np.arange(40), d))[:25]
    w = np.exp(-d[idx] ** 2 / 0.75 ** 2)
    A = np.column_stack([np.ones(25), Z[idx]])
    P = np.eye(4) * 0.05
    P[0, 0] = 0
    beta = np.linalg.solve(A.T @ (A * w[:, None]) + P, A.T @ (w * ys[idx]))
    assert [r["coef"] for r in got] == pytest.approx(list(beta[1:]), rel=1e-8)
    assert got[0]["intercept"] == pytest.approx(beta[0], rel=1e-8)


def test_adf_auto_matches_lstsq(spark):
    rng = np.random.default_rng(13)
    e = rng.normal(size=300)
    x = np.zeros(300)
    for t in range(2, 300):
        x[t] = 0.9 * x[t - 1] + 0.3 * (x[t - 1] - x[t - 2]) + e[t]
    dates = pd.bdate_range("2020-01-01", periods=300)
    df = spark.createDataFrame([("s", d.date(), float(v)) for d, v in zip(dates, x)], "series_id string, date date, x double")
    got = st.adf_auto(df, "x", max_lag=3).first()
    dy = np.diff(x)
    L = 3
    Y = dy[L:]
    best = None
    for lag in range(L + 1):
        X = np.column_stack([np.ones(len(Y)), x[L:-1]] + [dy[L - i:-i] for i in range(1, lag + 1)])
        beta, *_ = np.linalg.lstsq(X, Y, rcond=None)
        ssr = ((Y - X @ beta) ** 2).sum()
        aic = len(Y) * np.log(ssr / len(Y)) + 2 * X.shape[1]
        t = beta[1] / np.sqrt(ssr / (len(Y) - X.shape[1]) * np.linalg.inv(X.T @ X)[1, 1])
        if best is None or aic < best[2]:
            best = (lag, t, aic)
    assert got["adf_lag"] == best[0]
    assert got["adf_stat"] == pytest.approx(best[1], rel=1e-7)
