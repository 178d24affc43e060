"""Cases that once gave wrong results, each with its hand-made input."""

import math
import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tidewater.operators import evaluate as ev
from tidewater.operators import neighbors as nb
from tidewater.operators import scan
from tidewater.operators import stats as st
from tidewater.operators.calendar import asof_join
from tidewater.session import checkpoint_dir
from tidewater.sources import files as src
from tidewater.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_asof_ignores_right_rows_without_a_time(spark):
    left = spark.sql("select * from values (date'2020-01-05', 1), (cast(null as date), 2), (date'2020-03-01', 3) t(d, k)")
    right = spark.sql("select * from values (cast(null as date), 99.0D), (date'2020-02-01', 5.0D) t(at, v)")
    got = {r.k: (r.v, r.matched_date) for r in asof_join(left, right, "d", "at", ["v"]).collect()}
    assert got[1] == (None, None) and got[2] == (None, None) and got[3][0] == 5.0


@pytest.mark.parametrize("span", [2, 12, 200])
def test_ewm_of_a_dense_series_is_finite_and_right(spark, span):
    x = np.random.default_rng(1).normal(size=2000)
    pdf = pd.DataFrame({"series_id": "a", "date": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(2000) * 30, unit="s"), "x": x})
    got = scan.ewm_mean(spark.createDataFrame(pdf), "x", "y", scan.alpha_from_span(span)).toPandas().sort_values("date")
    assert np.allclose(got["y"], pdf["x"].ewm(span=span, adjust=False).mean(), atol=1e-9)


def scored(spark):
    rows = [(g, y, p) for g in ("a", None) for y, p in [(1, 0.9), (0, 0.2), (1, 0.6), (0, 0.7), (1, 0.4)]]
    return spark.createDataFrame(rows, "g string, target int, proba_up double")


def test_the_null_group_keeps_its_metrics(spark):
    p = scored(spark)
    auc = {r.g: r.AUC for r in ev.roc_auc(p, ["g"]).collect()}
    assert auc["a"] == auc[None] == pytest.approx(4 / 6)
    sweep = {(r.g, round(r.threshold, 4)): (r.TP, r.FP, r.TN, r.FN) for r in ev.threshold_sweep(p, ["g"]).collect()}
    assert sweep[None, 0.5] == sweep["a", 0.5] == (2, 1, 1, 1)
    both = {r.g: (r.Accuracy, r.AUC) for r in ev.metrics_and_auc(p, ["g"]).collect()}
    assert both["a"] == both[None]
    assert ev.metrics_and_auc(p.where("g = 'a'"), []).first().AUC == pytest.approx(4 / 6)
    assert {(r.g, r.threshold): r.tpr for r in ev.roc_curve(p, ["g"]).collect()}[None, 0.6] == pytest.approx(2 / 3)


def test_r2_of_large_values_and_missing_predictions(spark):
    rows = [(1e8 + i, 1e8 + i + (1e-4 if i % 2 else -1e-4)) for i in range(100)] + [(5.0, None), (None, 3.0)]
    r = ev.regression_metrics(spark.createDataFrame(rows, "y double, p double"), [], "y", "p").first()
    assert r.N == 100 and r.R2 == pytest.approx(1.0, abs=1e-9) and r.RMSE == pytest.approx(1e-4, rel=1e-3)


def folder():
    return tempfile.mkdtemp(prefix="tw-defects-")


def test_availability_join_takes_the_latest_released_version(spark):
    d = folder()
    events = spark.sql("select * from values (1, 'a', timestamp'2024-01-10 08:00:00'), (2, 'a', timestamp'2024-01-02 08:00:00'),"
                       " (3, 'b', timestamp'2024-01-10 08:00:00') t(id, k, ts)")
    events.write.parquet(f"{d}/in")
    static = spark.sql("select * from values ('a', date'2024-01-05', 1.0D), ('a', date'2024-01-09', 2.0D), ('a', date'2024-01-20', 3.0D)"
                       " t(k, available_at, v)")
    for on, third in ((["k"], None), ([], 2.0)):
        stream = ingest.file_stream(spark, f"{d}/in", events.schema)
        out = ingest.availability_join(stream, static if on else static.drop("k"), "ts", "available_at", on)
        q = out.writeStream.format("parquet").option("path", f"{d}/out{len(on)}").option("checkpointLocation", f"{d}/ck{len(on)}")
        q.trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.id, r.v) for r in spark.read.parquet(f"{d}/out{len(on)}").collect())
        assert got == [(1, 2.0), (2, None), (3, third)]


def test_forward_fill_of_a_key_larger_than_an_arrow_batch(spark):
    d, n = folder(), 25_000
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="s"),
                        "v": np.where(rng.random(n) < 0.1, np.arange(n, dtype=float), np.nan)})
    spark.createDataFrame(pdf.sample(frac=1, random_state=3)).withColumn("v", F.nanvl("v", F.lit(None))).coalesce(1).write.parquet(f"{d}/in")
    stream = ingest.file_stream(spark, f"{d}/in", spark.read.parquet(f"{d}/in").schema)
    q = ingest.forward_fill_state(stream, "k", "ts", "v").writeStream.format("parquet").option("path", f"{d}/out")
    q.option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{d}/out").toPandas().sort_values("ts")
    assert len(got) == n and np.array_equal(got["v_filled"].to_numpy(float), pdf["v"].ffill().to_numpy(), equal_nan=True)


def test_publish_switches_to_the_last_complete_version(spark):
    root = folder()
    for n in (3, 5):
        src.publish_atomic(spark.range(n).toDF("x"), root)
        assert src.read_published(spark, root).count() == n
    os.makedirs(f"{root}/v-99999999999999999999-half.parquet")  # no _SUCCESS: not finished
    assert src.read_published(spark, root).count() == 5


def test_knn_of_many_queries_is_exact_with_text_ids(spark):
    rng = np.random.default_rng(4)
    ref, q = rng.normal(size=(300, 4)), rng.normal(size=(5200, 4))
    refs = spark.createDataFrame([(f"r{i:03d}", v.tolist(), float(i)) for i, v in enumerate(ref)], "id string, v array<double>, y double")
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_id string, v array<double>")
    got = nb.knn_topk(refs, queries, 3, "id", "v", "y", query_rows=700, ref_rows=90).toPandas()
    mu, sd = ref.mean(axis=0), ref.std(axis=0)
    d = np.sqrt(((((q - mu) / sd)[:, None, :] - ((ref - mu) / sd)[None, :, :]) ** 2).mean(axis=2))
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    have = {(r.query_id, r.rank): r.id for r in got.itertuples()}
    assert len(have) == 3 * len(q)
    assert all(have[f"q{i}", k + 1] == f"r{want[i, k]:03d}" for i in range(len(q)) for k in range(3))
    att = nb.loo_attribution(refs, queries.limit(3), 5, "id", "v", "y").collect()
    assert {r.query_id for r in att} == {"q0", "q1", "q2"} and len(att) == 12


def test_attribution_and_surrogate_take_every_twentieth_vector(spark, tmp_path):
    rng = np.random.default_rng(6)
    x, label = rng.normal(size=(610, 4)), rng.integers(0, 2, 610)
    rows = [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    at = np.arange(0, 610, 20)
    z = x.astype(np.float32).astype(float)
    mu, sd = z.mean(axis=0), z.std(axis=0)

    def score(v, own):
        d = np.sqrt((((v - mu) / sd - (z - mu) / sd) ** 2).mean(axis=1))
        d[own] = np.inf  # a query's own row is not its neighbour
        top = np.argsort(d, kind="stable")[:5]
        w = 1 / np.maximum(d[top], 0.05)
        return (w * label[top]).sum() / w.sum()

    got = E.queries()["loo_attribution"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in got} == set(at.tolist()) and len(got) == 4 * len(at)
    for r in got:
        masked = z[r.query_id].copy()
        masked[r.dim] = mu[r.dim]
        assert abs(r.base_score - score(z[r.query_id], r.query_id)) < 1e-5 and abs(r.masked_score - score(masked, r.query_id)) < 1e-5
    fits = E.queries()["local_surrogate"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in fits} == set(at.tolist()) and {r.n for r in fits} == {120}


def test_masked_queries_are_not_shuffled(spark, monkeypatch):
    """Masked copies are made inside the tasks: vectors travel once a chunk (references) or once a group (queries)."""
    rng = np.random.default_rng(8)
    ref = rng.normal(size=(300, 16))
    refs = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(ref)], "id long, v array<double>, y int")
    queries = refs.limit(40).select(F.col("id").alias("query_id"), F.col("id").alias("own"), "v")
    rows, frame = [], type(refs)
    plain = frame.repartition

    def counted(self, *args):
        if "v" in self.columns:
            rows.append(self.count())
        return plain(self, *args)

    monkeypatch.setattr(frame, "repartition", counted)
    assert nb.loo_attribution(refs, queries, 5, "id", "v", "y", self_id="own").count() == 40 * 10
    assert sum(rows) <= 300 + 40


def test_masked_neighbours_are_exact(spark, monkeypatch):
    """Against brute force: several chunks and groups, copies of vectors, text ids, repeated, missing and foreign ids."""
    rng = np.random.default_rng(9)
    ref = np.round(rng.normal(size=(900, 5)), 1)
    ref[300:500] = ref[0]  # copies
    ids = [f"r{i * 7 % 900:03d}" for i in range(900)]
    rows = [(n, v.tolist(), None if i % 9 == 0 else i % 3) for i, (n, v) in enumerate(zip(ids, ref))]
    refs = spark.createDataFrame([*rows, ("none", None, 1)], "id string, v array<double>, y int").repartition(3)
    asked = [*range(0, 900, 30), 2, 2]
    q = [(i, ids[i] if i % 60 else None, ref[i].tolist()) for i in asked]
    q += [(-1, "r000", [0.0, None, 0.0, 0.0, 0.0]), (-2, "r001", None), (2, None, None)]
    queries = spark.createDataFrame(q, "query_id long, own string, v array<double>").repartition(2)
    monkeypatch.setattr(nb, "LEAST_ROWS", 100)
    monkeypatch.setattr(nb, "KEPT_ROWS", 50)
    monkeypatch.setattr(nb, "BLOCK", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = nb.masked_topk(refs, queries, 4, "id", "v", "y", self_id="own", masked_rows=80).collect()
        att = nb.loo_attribution(refs, queries, 4, "id", "v", "y", self_id="own", top=5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mu, sd = ref.mean(axis=0), ref.std(axis=0)
    z = (ref - mu) / sd
    want, wanted_scores = {}, {}
    for i in dict.fromkeys(asked):
        for dim in range(-1, 5):
            a = z[i].copy()
            if dim >= 0:
                a[dim] = 0
            d = np.sqrt(((a - z) ** 2).mean(axis=1))
            near = sorted((round(x, 9), n, y) for x, (n, _, y) in zip(d, rows) if not (i % 60 and n == ids[i]))
            near = [x for x in near for _ in range(asked.count(i))][:4]  # rows of one id count as one query
            want[i, dim] = near
            wgt = [1 / max(x, 0.05) for x, _, _ in near]
            wanted_scores[i, dim] = sum(w * y for w, (_, _, y) in zip(wgt, near) if y is not None) / sum(wgt) if any(
                y is not None for _, _, y in near) else None
    have = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        have.setdefault((r.query_id, r.dim), []).append((round(r.distance, 9), r.id, r.y))
    assert have.keys() == want.keys()
    assert all([x[1:] for x in have[key]] == [x[1:] for x in want[key]] for key in want)
    assert all(abs(x[0] - y[0]) < 1e-7 for key in want for x, y in zip(have[key], want[key]))
    assert {r.query_id for r in att} == set(asked)
    # three rows name query 2, so each of its dimensions is there nine times
    assert len(att) == 5 * len(set(asked)) and {r.dim for r in att if r.query_id == 2} == {att_dim for att_dim in [
        r.dim for r in sorted(att, key=lambda r: r["rank"]) if r.query_id == 2][:1]}
    for r in att:
        for have_score, dim in ((r.base_score, -1), (r.masked_score, r.dim)):
            score = wanted_scores[r.query_id, dim]
            assert (have_score is None) == (score is None) and (score is None or abs(have_score - score) < 1e-6)


def test_feature_scores_by_hand(spark):
    rows = [("a", 0.5, -0.04, 0.02, 0.4, 1.0, 0.2), ("b", -1.0, 0.8, 0.04, 0.2, 0.5, 0.4), ("c", 0.25, 0.4, 0.005, 0.1, 0.25, 0.1),
            ("d", 0.0, 0.0, 0.0, 0.0, 0.0, None)]
    t = spark.createDataFrame(rows, "feature string, rpb double, spearman double, MI double, class_ks double, abs_d double, ks_stat double")
    got = {r.feature: r for r in st.feature_scores(t).collect()}
    assert got["a"].signal_score == pytest.approx((0.5 + 0.5 + 1 + 1) / 4) and got["a"].stability_score == pytest.approx(0.5)
    assert got["b"].signal_score == pytest.approx((1 + 1 + 0.5 + 0.5) / 4) and got["b"].stability_score == pytest.approx(0.0)
    assert got["a"].research_score == pytest.approx(0.7 * 0.75 + 0.15) and got["b"].mix_score == pytest.approx(1.0)
    assert [got[f].relation for f in "abcd"] == ["NONLINEAR", "LINEAR+NL", "WEAK", "WEAK"]
    assert [got[f].rank_research for f in "abcd"] == [1, 2, 3, 4]
    assert [got[f].rank_spearman for f in "abcd"] == [3, 1, 2, 4] and [got[f].rank_mi for f in "abcd"] == [2, 1, 3, 4]
    # mixed: b (1 + 1) / 2, c (0.125 + 0.5) / 2, a (0.5 + 0.05) / 2, d 0
    assert [got[f].rank_mi_spearman for f in "abcd"] == [3, 1, 2, 4]


def test_p_values(spark):
    row = spark.range(1).select(st.normal_two_sided_p(F.lit(1.959964)).alias("z"), st.normal_two_sided_p(F.lit(-3.0)).alias("t"),
                                st.chi2_p(F.lit(18.307), 10).alias("c")).first()
    assert row.z == pytest.approx(0.05, abs=1e-6) and row.t == pytest.approx(math.erfc(3 / math.sqrt(2)), abs=1e-6)
    assert row.c == pytest.approx(0.05, abs=1e-5)


def test_no_query_leaves_a_cache(spark):
    for name in ("feature_score", "roc_auc", "ewm_macd", "standard_scale", "data_overview", "corr_top_pairs", "sweep_val_test"):
        E.queries()[name](spark, SF).write.format("noop").mode("overwrite").save()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_feature_parameters_are_broadcast(spark):
    for name in ("outliers_iqr", "standard_scale", "robust_scale", "minmax_train", "winsorize_train"):
        plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan, name


def test_the_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


@pytest.mark.parametrize("name", ["stream_sliding", "stream_weekend_roll", "stream_availability", "stream_ffill", "stream_daily_agg"])
def test_streams_read_a_table_of_part_files(spark, tmp_path, name):
    small = "/root/testdata/sf0.001"
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    rows = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else str(x) for x in r) for r in E.queries()[name](spark, d).collect())
    whole = rows(small)
    assert whole and rows(str(tmp_path)) == whole
