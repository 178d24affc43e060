"""Scans, nearest neighbours, sketches, information, regression and keyed streams against plain versions."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidewater.operators import calendar as cal
from tidewater.operators import features as ft
from tidewater.operators import information as im
from tidewater.operators import linear
from tidewater.operators import neighbors as nb
from tidewater.operators import prep, scan, sketch
from tidewater.streaming import ingest, series

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- scans
def hot_frame(n=600, seed=1):
    """One key with two thirds of the rows, a null key, null values, times far apart."""
    r = np.random.default_rng(seed)
    k = np.where(r.random(n) < 0.66, "hot", np.where(r.random(n) < 0.5, "b", "c")).astype(object)
    k[:20] = None
    t = np.sort(r.choice(10_000, n, replace=False)) ** 2
    return pd.DataFrame({"k": k, "t": t.astype("int64"), "x": np.where(r.random(n) < 0.3, np.nan, r.normal(size=n))})


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("x", F.when(F.isnan("x"), None).otherwise(F.col("x"))).repartition(5)


@pytest.mark.parametrize("rows", [7, 10_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_is_the_plain_scan(spark, rows, descending):
    pdf = hot_frame()
    specs = {"s": ("sum", "x"), "n": ("count", "x"), "p": ("product", F.col("x") + 1), "hi": ("max", "x"), "lo": ("min", "x"),
             "x": ("last", "x"), "r": ("row",), "l1": ("lag", "x", 1), "l9": ("lag", "t", 9, -1), "b": ("before", "t", 9)}
    got = scan.running(spark_frame(spark, pdf), specs, "k", "t", rows=rows, descending=descending).toPandas()
    assert list(got.columns) == ["k", "t", "x", "s", "n", "p", "hi", "lo", "r", "l1", "l9", "b"]
    for key, g in pdf.groupby("k", dropna=False):
        g = g.sort_values("t", ascending=not descending)
        h = got[got["k"].isna() if pd.isna(key) else got["k"] == key].set_index("t").loc[g["t"]]
        x = g["x"].reset_index(drop=True)
        want = {"s": x.cumsum().ffill(), "n": x.notna().cumsum(), "p": (x + 1).cumprod().ffill(), "hi": x.cummax().ffill(), "lo": x.cummin().ffill(),
                "x": x.ffill(), "r": pd.Series(range(1, len(x) + 1)), "l1": x.shift(1), "l9": g["t"].reset_index(drop=True).shift(9, fill_value=-1)}
        for c, w in want.items():
            np.testing.assert_allclose(h[c].to_numpy(float), w.to_numpy(float), rtol=1e-9, err_msg=f"{key} {c}")
        assert [list(b) for b in h["b"]] == [g["t"].tolist()[max(0, i - 9):i][::-1] for i in range(len(g))]


def test_running_on_dates_times_and_without_rows(spark):
    d = spark.createDataFrame(pd.DataFrame({"k": "a", "ts": pd.date_range("2024-03-30", periods=500, freq="11min"), "x": range(500)}))
    for frame, t in ((d, "ts"), (d.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts")):
        out = scan.running(frame, {"s": ("sum", "x")}, "k", t, rows=40).orderBy(t).toPandas()
        assert out["s"].tolist() == np.cumsum(range(500)).tolist()
    assert scan.running(d.limit(0), {"s": ("sum", "x"), "l": ("lag", "x", 2)}, "k", "ts").collect() == []
    whole = scan.running(d, {"s": ("sum", "x")}, [], "ts", rows=40).agg(F.max("s")).first()[0]
    assert whole == sum(range(500))


def test_scans_of_a_series_sort_buckets_only(spark):
    """Every window over rows is partitioned by the bucket too; the one by the key alone reads bucket totals."""
    d = spark_frame(spark, hot_frame()).withColumnRenamed("k", "series_id").withColumnRenamed("t", "date")
    for out in (cal.ffill(d, ["x"], "series_id", "date"), ft.equity_curve(d, "x"), ft.recency_weights(d, "linear")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in (x for x in plan.split("\n") if "Window [" in x):
            assert "__b#" in line.split("], [")[-2] or "__t" in line or "__b#" in line, line
        assert "__b" in plan


# ---------------------------------------------------------------- neighbours
def cloud(n=900, dims=6, seed=3):
    r = np.random.default_rng(seed)
    x = np.repeat(r.normal(size=(12, dims)) * 6, n // 12, axis=0) + r.normal(size=(n, dims)) * 0.4
    x[:n // 3] = x[0]  # a third of the rows are copies of one vector
    return x


def test_pivot_join_is_brute_force_with_fewer_distances(spark):
    x = cloud()
    refs = spark.createDataFrame([(i, v.tolist(), float(i % 2)) for i, v in enumerate(x)] + [(9999, None, 0.0)], "id long, v array<double>, y double")
    queries = refs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("own"), "v")
    args = dict(k=7, id_col="id", vec="v", outcome="y", self_id="own", ref_rows=40, query_rows=16)
    got = nb.knn_topk(refs, queries, **args).toPandas()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for q in range(0, len(x), 20):
        d = np.sqrt(((z - z[q]) ** 2).mean(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:7]
        have = got[got.query_id == q].sort_values("rank")
        assert have["id"].tolist() == want
        np.testing.assert_allclose(have["distance"], d[want], atol=1e-12)
    work = nb.knn_evaluations(refs, queries, **args).agg(F.sum("evaluated")).first()[0]
    assert work < 0.6 * len(x) * len(range(0, len(x), 20))


def test_pivot_join_odd_tables(spark):
    refs = spark.createDataFrame([(i, [float(i), 1.0], 1.0) for i in range(5)], "id long, v array<double>, y double")
    queries = refs.select(F.col("id").alias("query_id"), "v")
    assert nb.knn_topk(refs, queries, 9, "id", "v", "y").count() == 25  # fewer references than k
    assert nb.knn_topk(refs.limit(0), queries, 3, "id", "v", "y").count() == 0
    assert nb.knn_topk(refs, queries.limit(0), 3, "id", "v", "y").count() == 0


def test_a_query_travels_once_to_a_slab_in_rows_of_its_own(spark):
    """No row holds a group, and what is shuffled follows the slabs and chunks, not the cells (30 here)."""
    x = cloud()
    refs = spark.createDataFrame([(i, v.tolist(), float(i % 2)) for i, v in enumerate(x)], "id long, v array<double>, y double")
    queries = refs.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("own"), "v")
    meet, _ = nb._meetings(refs, queries, 5, "id", "v", "y", "query_id", True, "own", nb.QUERY_ROWS, nb.REF_ROWS)
    assert not [t for _, t in meet.dtypes if "struct" in t]
    assert meet.count() == len(x) + queries.count()


def test_neighbours_beyond_a_slab_with_null_outcomes_and_text_ids(spark):
    x = cloud(n=480, dims=5)
    rows = [(f"r{i:03d}", v.tolist(), None if i % 7 == 0 else i) for i, v in enumerate(x)]
    refs = spark.createDataFrame(rows, "id string, v array<float>, y long")
    queries = refs.where("y % 20 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("own"), "v")
    got = nb.knn_topk(refs, queries, 130, "id", "v", "y", self_id="own", ref_rows=25, query_rows=4).toPandas()
    f = x.astype(np.float32).astype(float)
    z = (f - f.mean(axis=0)) / f.std(axis=0)
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((z - z[int(q[1:])]) ** 2).mean(axis=1))
        want = [i for i in np.lexsort((np.arange(len(x)), np.round(d, 12))) if i != int(q[1:])][:130]
        have = part.sort_values("rank")
        np.testing.assert_allclose(have["distance"], d[want], atol=1e-12)
        assert all((int(r.id[1:]) % 7 == 0) == np.isnan(r.y) for r in have.itertuples())
    assert got["query_id"].nunique() == queries.count()


# ---------------------------------------------------------------- sketches
def test_sketches_keep_their_bounds_when_merged(spark):
    r = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 20_000), "day": np.tile(np.arange(20), 2_000),
                        "v": np.concatenate([r.lognormal(size=20_000), r.integers(0, 50, 20_000).astype(float)])})
    fine = sketch.value_sketches(spark.createDataFrame(pdf), ["g", "day"], "v")
    est = {x.g: x for x in sketch.sketch_estimates(sketch.merge_sketches(fine, ["g"]), ["g"], (0.1, 0.5, 0.99)).collect()}
    for g, part in pdf.groupby("g"):
        v = part["v"].to_numpy()
        for q, p in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
            assert (v < est[g][q]).mean() <= p + sketch.rank_error() and (v <= est[g][q]).mean() >= p - sketch.rank_error()
        assert abs(est[g].n_unique - len(np.unique(v))) <= sketch.distinct_error() * len(np.unique(v)) + 1
        assert (est[g]["count"], est[g].low, est[g].high) == (len(v), v.min(), v.max())
    empty = spark.createDataFrame([("x", None)], "g string, v double")
    row = sketch.sketch_estimates(sketch.value_sketches(empty, ["g"], "v"), ["g"]).first()
    assert (row["count"], row.missing, row.q50, row.n_unique) == (0, 1, None, 0)


def test_heavy_hitters_miss_none_and_count_exactly(spark):
    r = np.random.default_rng(6)
    v = np.concatenate([r.integers(0, 5_000, 30_000), np.repeat([7, 8, 9], [400, 900, 5_000])])
    d = spark.createDataFrame(pd.DataFrame({"g": "a", "v": r.permutation(v)})).repartition(7)
    n = pd.Series(v).value_counts()
    want = {int(k): int(c) for k, c in n.items() if c / len(v) >= 0.01}
    assert {x.v: x["count"] for x in sketch.heavy_hitters(d, ["g"], "v", 0.01).collect()} == want
    top = sketch.most_frequent(d, ["g"], "v").first()
    assert (top.top_value, top.top_count) == (9, n.iloc[0])


# ---------------------------------------------------------------- information
def plain_psi(n):
    return sum(1.0 / j for j in range(1, n)) - im.EULER


def plain_mi(x, y, k):
    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    terms = []
    for i in range(len(x)):
        own = np.sort(np.abs(x[y == y[i]] - x[i]))[1:]  # without itself
        d = own[min(k, len(own)) - 1]
        m = (np.abs(x - x[i]) < d).sum() if d > 0 else (x == x[i]).sum()
        terms.append(plain_psi(min(k, len(own))) - plain_psi(len(own) + 1) - plain_psi(int(m)))
    return max(0.0, plain_psi(len(x)) + float(np.mean(terms)))


@pytest.mark.parametrize("ties", [False, True])
def test_knn_information_is_the_plain_estimator(spark, ties):
    r = np.random.default_rng(7)
    rows = []
    for f in ("related", "noise", "skewed"):
        y = r.integers(0, 3, 240)
        x = r.normal(size=240) + (y if f == "related" else 0)
        x = np.exp(4 * x) if f == "skewed" else x
        x = np.round(x * 4) / 4 if ties else x
        y[:3] = [7, 8, 8]  # a class of one row, and one of two
        rows += [(f, int(c), float(v), i) for i, (v, c) in enumerate(zip(x, y))]
    long = spark.createDataFrame(rows + [("noise", 1, None, 999), ("noise", None, 1.0, 998)], "feature string, label int, value double, id long")
    got = {x.feature: x.MI for x in im.knn_mutual_information(long, ["feature"], "value", "label", ["id"]).collect()}
    for f in got:
        own = [(v, c) for g, c, v, _ in rows if g == f]
        want = plain_mi(np.array([v for v, _ in own]), np.array([c for _, c in own]), 5)
        assert got[f] == pytest.approx(want, abs=1e-9), f


def test_digamma(spark):
    d = spark.range(1, 400).select("id", im.digamma(F.col("id")).alias("p")).collect()
    assert all(abs(r.p - plain_psi(r.id)) < 1e-12 for r in d)


# ---------------------------------------------------------------- regression, lambda, releases
def test_ridge_path_is_the_normal_equations(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(400, 3)) * [1, 50, 0.01] + [0, 1000, 5]
    y = x @ [1.0, 0.02, -30] + r.normal(size=400)
    x[::17, 1] = np.nan
    split = np.where(np.arange(400) < 300, "train", "val")
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y, split=split)
    d = spark.createDataFrame(pdf).withColumn("b", F.when(F.isnan("b"), None).otherwise(F.col("b")))
    got = linear.ridge_path(d, list("abc"), "y").toPandas()
    tr = split == "train"
    mean, std = np.nanmean(x[tr], axis=0), np.nanstd(x[tr], axis=0)
    z = np.column_stack([np.ones(400), np.nan_to_num((x - mean) / std)])
    best = None
    for alpha, part in got.groupby("alpha"):
        beta = np.linalg.solve(z[tr].T @ z[tr] + alpha * np.diag([0, 1, 1, 1]), z[tr].T @ y[tr])
        np.testing.assert_allclose(part.set_index("term").loc[["intercept", "a", "b", "c"], "coefficient"], beta, rtol=1e-7)
        rmse = math.sqrt(((y - z @ beta)[~tr] ** 2).mean())
        assert part["rmse_val"].iloc[0] == pytest.approx(rmse, rel=1e-7)
        best = min(best or (rmse, alpha), (rmse, alpha))
    assert set(got[got.picked]["alpha"]) == {best[1]}
    assert linear.ridge_path(d.where("split = 'none'"), list("abc"), "y").count() == 0


def test_yeo_johnson_lambda_is_the_optimum(spark):
    r = np.random.default_rng(9)
    sets = {"right": np.exp(r.normal(size=500)), "both": r.normal(size=500) ** 3, "left": -np.exp(r.normal(size=500) / 2), "flat": r.uniform(-1, 3, 500)}

    def loglik(x, lam):
        pos, out = x >= 0, np.empty_like(x)
        out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
        out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
        return -len(x) / 2 * np.log(out.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    def optimum(x, lo=-5.0, hi=5.0):  # golden section
        g = (math.sqrt(5) - 1) / 2
        while hi - lo > 1e-7:
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if loglik(x, a) > loglik(x, b) else (a, hi)
        return (lo + hi) / 2

    d = spark.createDataFrame([(k, float(v)) for k, x in sets.items() for v in x], "feature string, value double")
    got = {x.feature: x["lambda"] for x in prep.fit_yeo_johnson(d).collect()}
    for k, x in sets.items():
        assert got[k] == pytest.approx(optimum(x), abs=1e-4), k


def test_release_calendar_shows_the_latest_period_in_its_latest_revision(spark):
    r = np.random.default_rng(10)
    rel = [(k, int(p), int(p * 10 + r.integers(5, 90)), float(r.normal())) for k in "ab" for p in range(30) for _ in range(r.integers(1, 4))]
    rel = list({(k, p, t): (k, p, t, v) for k, p, t, v in rel}.values())
    left = [(k, int(t)) for k in "abz" for t in r.choice(400, 60, replace=False)]
    out = cal.release_asof(spark.createDataFrame(left, "k string, t int"), spark.createDataFrame([*rel, ("a", None, 3, 1.0), ("a", 3, None, 1.0)], "k string, p int, at int, v double"),
                           "t", "at", "p", ["v"], ["k"]).collect()
    assert len(out) == len(left)
    for row in out:
        known = [x[1:] for x in rel if x[0] == row.k and x[2] <= row.t]
        assert (row.period, row.released_at, row.v) == (max(known) if known else (None, None, None))


# ---------------------------------------------------------------- streams
def folder():
    return tempfile.mkdtemp(prefix="tw-stream-")


def batch_ewm(pdf, alpha):
    out = []
    for k, g in pdf.sort_values(["t", "i"]).groupby("k"):
        m = last = None
        for _, row in g.iterrows():
            if not math.isnan(row.v):
                m, last = (row.v if m is None else alpha * row.v + (1 - alpha) * m), row.v
            out.append((k, row.i, None if math.isnan(row.v) else m, last))
    return {(k, i): (m, last) for k, i, m, last in out}


def write_files(spark, pdf, path, parts):
    for n, part in enumerate(np.array_split(np.arange(len(pdf)), parts)):
        f = spark.createDataFrame(pdf.iloc[part]).withColumn("v", F.when(F.isnan("v"), None).otherwise(F.col("v")))
        f.coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, x) for x in os.listdir(path) if x.startswith("part-")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + 60 * n, 1_700_000_000 + 60 * n))


def stream_rows(spark, path, **options):
    stream = ingest.file_stream(spark, path, "k string, i long, t timestamp, v double", max_files_per_trigger=1)
    return series.series_state(stream, "k", "t", "i", "v", 0.3, **options)


def test_stream_ewm_equals_the_batch_with_late_rows(spark):
    r = np.random.default_rng(11)
    n = 120
    at = np.arange(n) * 3600 + r.integers(0, 20 * 3600, n)  # up to 20 hours late
    pdf = pd.DataFrame({"k": r.choice(["a", "b", "c"], n), "i": np.arange(n), "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, unit="s"),
                        "v": np.where(r.random(n) < 0.2, np.nan, r.normal(size=n))})
    d = folder()
    write_files(spark, pdf, f"{d}/in", 5)
    rows = stream_rows(spark, f"{d}/in", delay="2 days")
    ingest.run_available_now(rows, f"{d}/out", f"{d}/ck", state_store=series.STATE_STORE)
    got = ingest.latest_versions(spark, f"{d}/out", ["k", "i"]).collect()
    want = batch_ewm(pdf, 0.3)
    assert len(got) == n
    for row in got:
        m, last = want[row.k, row.i]
        assert row.ewm == (None if m is None else pytest.approx(m)) and row.filled == (None if last is None else pytest.approx(last))
    versions = spark.read.parquet(f"{d}/out").count()
    assert versions > n  # late rows did correct results that were out already


def test_stream_state_of_a_closed_key_is_removed(spark):
    day = lambda n: pd.Timestamp("2024-01-01") + pd.Timedelta(days=n)
    pdf = pd.DataFrame({"k": ["a", "b", "b", "a"], "i": [0, 1, 2, 3], "t": [day(0), day(20), day(40), day(60)], "v": [1.0, 2.0, 3.0, 5.0]})
    d = folder()
    write_files(spark, pdf, f"{d}/in", 4)
    rows = stream_rows(spark, f"{d}/in", delay="1 day", keep_ms=5 * 86_400_000)
    ingest.run_available_now(rows, f"{d}/out", f"{d}/ck", state_store=series.STATE_STORE)
    got = {x.i: x.ewm for x in ingest.latest_versions(spark, f"{d}/out", ["k", "i"]).collect()}
    assert got[3] == 5.0  # starts anew after its state left


def test_a_retried_batch_replaces_what_it_wrote(spark):
    """The driver is lost after a batch is written and before it is committed."""
    d = folder()
    spark.range(1000).selectExpr("id AS i", "id % 7 AS k").coalesce(1).write.parquet(f"{d}/in")
    stream = lambda: ingest.file_stream(spark, f"{d}/in", "i long, k long")
    ingest.run_available_now(stream(), f"{d}/out", f"{d}/ck", mode="append")
    assert spark.read.parquet(f"{d}/out").count() == 1000
    for name in os.listdir(f"{d}/ck/commits"):
        os.rename(f"{d}/ck/commits/{name}", f"{d}/lost-{name}")
    ingest.run_available_now(stream(), f"{d}/out", f"{d}/ck", mode="append")
    assert spark.read.parquet(f"{d}/out").count() == 1000


def test_queries_of_this_file_are_registered():
    names = {"frequent_values", "heavy_values", "sketch_profile", "knn_information", "ridge_path", "release_calendar", "stream_ewm",
             "hot_ffill", "hot_equity", "hot_weights", "yeo_johnson_lambda", "knn_evaluations"}
    assert names <= set(E.queries())


# ---------------------------------------------------------------- tests, clusters, draws
def test_inverse_normal_and_unit_root_p_values(spark):
    from statistics import NormalDist

    from tidewater.operators import stats as st
    p = [1e-300, 1e-12, 1e-3, 0.05, 0.074, 0.076, 0.3, 0.5, 0.7, 0.95, 0.999, 1 - 1e-12, 0.0, 1.0, None]
    got = [r.z for r in spark.createDataFrame([(x,) for x in p], "p double").select(st.inverse_normal(F.col("p")).alias("z")).collect()]
    assert got[-3:] == [None] * 3
    assert all(z == pytest.approx(NormalDist().inv_cdf(x), rel=1e-12, abs=1e-15) for z, x in zip(got[:-3], p[:-3]))
    stats = [-19.0, -3.43, -2.86, -2.57, -1.61, -1.0, 0.0, 2.8, None]
    rows = spark.createDataFrame([(x,) for x in stats], "s double").select(st.adf_p(F.col("s")).alias("p")).collect()
    for row, s in zip(rows, stats):
        if s in (-3.43, -2.86, -2.57):  # the asymptotic critical values
            assert row.p == pytest.approx({-3.43: 0.01, -2.86: 0.05, -2.57: 0.1}[s], rel=0.03)
    assert (rows[0].p, rows[-2].p, rows[-1].p) == (0.0, 1.0, None)
    assert all(a.p < b.p for a, b in zip(rows[1:7], rows[2:7]))
    k = [r.p for r in spark.createDataFrame([(0.1,), (0.347,), (0.405,), (0.463,), (0.6,), (2.0,)], "s double").select(st.kpss_p(F.col("s")).alias("p")).collect()]
    assert k == pytest.approx([0.1, 0.1, 0.075, 0.05, 0.025 - 0.026 / 0.165 * 0.015, 0.01])


def test_stationarity_verdicts(spark):
    from tidewater.operators import stats as st
    r = np.random.default_rng(12)
    noise, walk = r.normal(size=400), np.cumsum(r.normal(size=400))
    rows = [(k, i, float(v)) for k, x in (("noise", noise), ("walk", walk), ("flat", np.ones(400))) for i, v in enumerate(x)]
    out = {x.k: x for x in st.stationarity_verdict(spark.createDataFrame(rows, "k string, t int, x double"), "x", ["k"], "t").collect()}
    assert (out["noise"].verdict, out["walk"].verdict, out["flat"].verdict) == ("Stationary", "NON-STATIONARY", "Constant")
    assert out["flat"].adf_p is None and out["noise"].adf_p < 0.01


def test_average_linkage_is_plain_agglomeration(spark):
    from tidewater.operators import stats as st
    r = np.random.default_rng(13)

    def plain(d, cut):
        groups = [[i] for i in range(len(d))]
        while len(groups) > 1:
            pairs = [(np.mean([d[x, y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
            h, i, j = min(pairs)
            if h > cut:
                break
            groups[i] += groups.pop(j)
        return sorted(sorted(g) for g in groups)

    for n in (1, 2, 9, 25):
        d = r.random((n, n))
        d = (d + d.T) / 2
        names = [f"f{i:02d}" for i in range(n)]
        pairs = spark.createDataFrame([(names[i], names[j], float(1 - d[i, j])) for i in range(n) for j in range(i + 1, n)] or [("x", "y", 0.1)],
                                      "f1 string, f2 string, spearman_r double")
        scores = spark.createDataFrame([(f, float(k % 4)) for k, f in enumerate(names)], "feature string, research_score double")
        for cut in (0.2, 0.4, 0.6):
            rows = st.feature_clusters(pairs, scores, cut).collect()
            got = {}
            for x in rows:
                got.setdefault(x.cluster, []).append(names.index(x.feature))
            assert sorted(sorted(g) for g in got.values()) == plain(d, cut)
            for x in rows:
                best = max(got[x.cluster], key=lambda i: (i % 4, -i))
                assert x.selected == (names.index(x.feature) == best)


def test_random_draws_are_seeded_and_searched(spark):
    from tidewater.operators import learn as ln
    space = {"regParam": ("loguniform", 1e-4, 1.0), "maxIter": ("int", 5, 9), "elasticNetParam": [0.0, 1.0], "tol": ("uniform", 1e-6, 1e-3)}
    draws = ln.draw_params(space, 50, 3)
    assert draws == ln.draw_params(space, 50, 3) != ln.draw_params(space, 50, 4)
    assert all(1e-4 <= d["regParam"] <= 1 and d["maxIter"] in range(5, 10) and d["elasticNetParam"] in (0.0, 1.0) for d in draws)
    r = np.random.default_rng(14)
    x = r.normal(size=(240, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": (x[:, 0] + 0.3 * r.normal(size=240) > 0).astype(int), "date": pd.date_range("2024-01-01", periods=240)})
    out = ln.random_search(spark.createDataFrame(pdf), ["a", "b"], "y", "logreg", {"regParam": ("loguniform", 1e-3, 0.1)}, 2, n_splits=2).collect()
    assert len(out) == 2 and all(o.folds == 2 and o.CV_F1_macro > 0.8 for o in out)
