"""Registered queries: ROC curve, feature groups and recommendations, histograms,
outlier and example tables, de-duplication, value counts, subsets, lookups, replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import evaluate as ev
from tidewater.plans import q_profile  # noqa: F401  (registers feature_score first)
from tidewater.operators import quality as qa
from tidewater.operators import reshape as rs
from tidewater.plans import inputs
from tidewater.plans.registry import (FEATURES_SQL, ORACLE, PANEL, PREDICTIONS, QUERIES, finish, register, with_)
from tidewater.session import read_table
from tidewater.sources import files as src


@register("roc_curve", with_(PREDICTIONS) + """,
h AS (SELECT Model, proba_up AS threshold, count_if(target = 1) AS pos, count_if(target <> 1) AS neg
      FROM preds WHERE Split = 'test' GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
             sum(pos) OVER (PARTITION BY Model) AS p_all, sum(neg) OVER (PARTITION BY Model) AS n_all FROM h
      WINDOW w AS (PARTITION BY Model ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT Model, threshold, CAST(fp AS DOUBLE) / CAST(n_all AS DOUBLE) AS fpr, CAST(tp AS DOUBLE) / CAST(p_all AS DOUBLE) AS tpr
FROM c""", dbl="threshold fpr tpr")
def q_roc_curve(spark, sf):
    """ROC points at every distinct score of the test split."""
    p = inputs.predictions(spark, sf).where(F.col("Split") == "test")
    return finish(ev.roc_curve(p, ["Model"]))


# Name rules that group features and flag leakage risk.
GROUP_RULES = [("startswith", "ret", "returns"), ("contains", "vol", "volatility"), ("startswith", "n_", "activity"),
               ("endswith", "_z", "zscore")]
RISK_RULES = [("contains", "fwd", "high"), ("contains", "target", "high"), ("contains", "5", "medium")]


def _group_sql(col: str, rules, default: str) -> str:
    parts = []
    for kind, pat, lab in rules:
        cond = {"startswith": f"starts_with({col}, '{pat}')", "endswith": f"ends_with({col}, '{pat}')",
                "contains": f"contains({col}, '{pat}')"}[kind]
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + f" ELSE '{default}' END"


def _wrap(name: str) -> str:
    """An already registered oracle as a sub-select (its own WITH is kept)."""
    return "(" + ORACLE[name] + ")"


@register("feature_groups", f"""
WITH fs AS {_wrap("feature_score")},
g AS (SELECT *, {_group_sql("feature", GROUP_RULES, "other")} AS "group",
             {_group_sql("feature", RISK_RULES, "low")} AS risk FROM fs)
SELECT "group", count(*) AS n_features, CAST(count_if(rank_research <= 3) AS BIGINT) AS n_selected,
       CAST(count_if(risk = 'low') AS BIGINT) AS n_low_risk,
       array_to_string(list_slice(list(feature ORDER BY rank_research), 1, 6), '|') AS first_features
FROM g GROUP BY 1""")
def q_feature_groups(spark, sf):
    """Features grouped and risk-tagged by name rules, summarised per group."""
    fs = QUERIES["feature_score"](spark, sf)
    g = rs.classify_names(fs, "feature", GROUP_RULES, "other", "group")
    g = rs.classify_names(g, "feature", RISK_RULES, "low", "risk")
    names = F.array_sort(F.collect_list(F.struct("rank_research", "feature")))
    return g.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if(F.col("rank_research") <= 3).alias("n_selected"),
        F.count_if(F.col("risk") == "low").alias("n_low_risk"),
        F.array_join(F.transform(F.slice(names, 1, 6), lambda s: s["feature"]), "|").alias("first_features"))


#: Rows listed for "keep" and "caution".
LISTED = 10


@register("feature_recommendation", f"""
WITH fs AS {_wrap("feature_score")},
r AS (SELECT *, {_group_sql("feature", RISK_RULES, "low")} AS risk FROM fs),
m AS (SELECT *, (SELECT quantile_cont(ks_stat, 0.5) FROM r) AS mid FROM r),
c AS (SELECT 'keep' AS recommendation, * FROM m WHERE risk = 'low'
      UNION ALL SELECT 'caution', * FROM m WHERE ks_stat > mid OR risk = 'medium'
      UNION ALL SELECT 'drop', * FROM m WHERE risk = 'high')
SELECT recommendation, feature, risk, research_score, ks_stat FROM c
QUALIFY recommendation = 'drop' OR row_number() OVER (PARTITION BY recommendation ORDER BY rank_research) <= {LISTED}""",
          dbl="research_score ks_stat")
def q_feature_recommendation(spark, sf):
    """T-21: keep the best low-risk features; caution for drift above its median or medium risk;
    drop high risk.  A feature may be kept with caution."""
    fs = rs.classify_names(QUERIES["feature_score"](spark, sf), "feature", RISK_RULES, "low", "risk")
    mid = F.percentile("ks_stat", 0.5).over(Window.partitionBy())  # one row per feature
    risk, drift = F.col("risk"), F.col("ks_stat") > F.col("__mid")
    rules = F.array_compact(F.array(F.when(risk == "low", F.lit("keep")), F.when(drift | (risk == "medium"), F.lit("caution")),
                                    F.when(risk == "high", F.lit("drop"))))
    c = fs.withColumn("__mid", mid).withColumn("recommendation", F.explode(rules))
    place = F.row_number().over(Window.partitionBy("recommendation").orderBy("rank_research"))
    c = c.withColumn("__place", place).where((F.col("recommendation") == "drop") | (F.col("__place") <= LISTED))
    return finish(c.select("recommendation", "feature", "risk", "research_score", "ks_stat"))


@register("histogram_features", with_(FEATURES_SQL) + """,
mm AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM fl GROUP BY 1)
SELECT feature, CAST(coalesce(least(floor((value - lo) / nullif(hi - lo, 0) * 10.0), 9), 0) AS INTEGER) AS bin,
       count(*) AS count, any_value(lo) AS lo, any_value(hi) AS hi
FROM fl JOIN mm USING (feature) GROUP BY 1, 2""", dbl="lo hi")
def q_histogram_features(spark, sf):
    """10-bin equal-width histogram per feature."""
    return finish(qa.histogram(inputs.feature_long(spark, sf), bins=10))


@register("outlier_top10", with_(FEATURES_SQL) + """,
s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd FROM fl GROUP BY 1),
z AS (SELECT fl.feature, series_id, date, value, abs(value - m) / nullif(sd, 0) AS abs_z FROM fl JOIN s USING (feature))
SELECT *, CAST(row_number() OVER (PARTITION BY feature ORDER BY abs_z DESC NULLS LAST, series_id, date) AS INTEGER) AS rank
FROM z QUALIFY rank <= 10""", dbl="value abs_z")
def q_outlier_top10(spark, sf):
    """The 10 largest |z| rows per feature."""
    lg = inputs.feature_long(spark, sf)
    s = lg.groupBy("feature").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__sd"))
    z = lg.join(s, "feature").withColumn("abs_z", F.try_divide(F.abs(F.col("value") - F.col("__m")), F.col("__sd")))
    top = rs.top_per_group(z, ["feature"], [F.col("abs_z").desc_nulls_last(), F.col("series_id"), F.col("date")], 10)
    return finish(top.select("feature", "series_id", "date", "value", "abs_z", "rank"))


LI_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]


@register("lineitem_dedup", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY """ + ", ".join(LI_ORDER) + """)
                  AS rn FROM lineitem)
SELECT l_returnflag, l_linestatus, count(*) AS rows_before, CAST(count_if(rn = 1) AS BIGINT) AS rows_after,
       sum(CASE WHEN rn = 1 THEN l_quantity END) AS qty_after
FROM d GROUP BY 1, 2""", dbl="qty_after")
def q_lineitem_dedup(spark, sf):
    """Duplicate (order, line) keys resolved by keeping the first row
    in an explicit total order."""
    li = read_table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LI_ORDER)
    d = li.withColumn("__rn", F.row_number().over(w))  # same rule as quality.dedup_first, one pass
    first = F.col("__rn") == 1
    return finish(d.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(first).alias("rows_after"),
        F.sum(F.when(first, F.col("l_quantity"))).alias("qty_after")))


@register("class_by_split", with_(FEATURES_SQL) + """
SELECT split, direction, count(*) AS count,
       CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY split) AS DOUBLE) AS proportion
FROM fm GROUP BY 1, 2""", dbl="proportion")
def q_class_by_split(spark, sf):
    """Label value counts with proportions per split."""
    vc = qa.value_counts(inputs.feature_matrix(spark, sf), "direction", ["split"])
    return finish(vc.withColumn("proportion", F.col("count").cast("double") /
                                F.sum("count").over(Window.partitionBy("split")).cast("double")))


@register("calendar_means", with_(FEATURES_SQL) + """
SELECT 'day_of_week' AS kind, CAST(isodow(date) - 1 AS INTEGER) AS k, avg(ret) AS mean_ret, count(ret) AS n FROM fm GROUP BY 2
UNION ALL
SELECT 'month', CAST(month(date) AS INTEGER), avg(ret), count(ret) FROM fm GROUP BY 2""", dbl="mean_ret")
def q_calendar_means(spark, sf):
    """Mean return by day of week (Mon=0) and by month."""
    fm = inputs.feature_matrix(spark, sf)
    a = fm.groupBy(F.weekday("date").alias("k")).agg(F.avg("ret").alias("mean_ret"), F.count("ret").alias("n")) \
        .select(F.lit("day_of_week").alias("kind"), "k", "mean_ret", "n")
    b = fm.groupBy(F.month("date").alias("k")).agg(F.avg("ret").alias("mean_ret"), F.count("ret").alias("n")) \
        .select(F.lit("month").alias("kind"), "k", "mean_ret", "n")
    return finish(a.unionByName(b))


SIZES = [2, 3, 5]


RANKINGS = ["spearman", "mi", "mi_spearman"]


@register("topn_subsets", f"""
WITH fs AS {_wrap("feature_score")},
r AS (SELECT 'spearman' AS ranking, feature, rank_spearman AS rk FROM fs
      UNION ALL SELECT 'mi', feature, rank_mi FROM fs
      UNION ALL SELECT 'mi_spearman', feature, rank_mi_spearman FROM fs),
s AS (SELECT ranking, n, feature, rk FROM r, (VALUES {", ".join(f"({n})" for n in SIZES)}) t(n)
      WHERE rk <= n AND n < (SELECT count(*) FROM fs))
SELECT upper(ranking) || '_TOP_' || CAST(n AS VARCHAR) AS "case", ranking, CAST(n AS INTEGER) AS n,
       array_to_string(list(feature ORDER BY rk), '|') AS features
FROM s GROUP BY ranking, n
UNION ALL
SELECT 'ALL_' || CAST(count(*) AS VARCHAR), 'all', CAST(count(*) AS INTEGER), array_to_string(list(feature ORDER BY feature), '|')
FROM fs""")
def q_topn_subsets(spark, sf):
    """T-11: top-N feature subsets per ranking (Spearman, MI, their mix), smaller than all, and ALL."""
    fs = QUERIES["feature_score"](spark, sf)
    size = F.count(F.lit(1)).over(Window.partitionBy())  # one row per feature
    cases = [F.struct(F.lit(r).alias("ranking"), F.lit(n).alias("n"), F.col(f"rank_{r}").alias("rk"))
             for r in RANKINGS for n in SIZES]
    everything = F.struct(F.lit("all").alias("ranking"), F.col("__p").alias("n"), F.col("__at").alias("rk"))
    c = (fs.withColumns({"__p": size.cast("int"), "__at": F.row_number().over(Window.orderBy("feature"))})
         .select("feature", "__p", F.explode(F.array(*cases, everything)).alias("c")).select("feature", "__p", "c.*")
         .where((F.col("rk") <= F.col("n")) & ((F.col("n") < F.col("__p")) | (F.col("ranking") == "all"))))
    agg = c.groupBy("ranking", "n").agg(F.array_sort(F.collect_list(F.struct("rk", "feature"))).alias("__f"))
    name = F.when(F.col("ranking") == "all", F.concat(F.lit("ALL_"), F.col("n").cast("string"))).otherwise(
        F.concat(F.upper("ranking"), F.lit("_TOP_"), F.col("n").cast("string")))
    return agg.select(name.alias("case"), "ranking", "n",
                      F.array_join(F.transform("__f", lambda x: x["feature"]), "|").alias("features"))


EXAMPLE_RULES_SQL = [
    ("confident_up_correct", "pred = 1 AND pred = target", "margin DESC"),
    ("confident_down_correct", "pred = 0 AND pred = target", "margin DESC"),
    ("uncertain", "true", "margin ASC"),
    ("false_up", "pred = 1 AND pred <> target", "margin DESC"),
    ("false_down", "pred = 0 AND pred <> target", "margin DESC"),
    ("recent_up", "target = 1", "date DESC"),
    ("recent_down", "target = 0", "date DESC"),
]


@register("pick_examples", with_(PREDICTIONS) + """,
t AS (SELECT Model, o_orderkey, date, proba_up, target, CAST(proba_up >= 0.5 AS INTEGER) AS pred,
             abs(proba_up - 0.5) AS margin FROM preds WHERE Split = 'test'),
c AS (""" + "\n      UNION ALL\n      ".join(
    f"(SELECT '{n}' AS example, {i} AS pri, * FROM t WHERE {cond} QUALIFY row_number() OVER (PARTITION BY Model ORDER BY {order}, o_orderkey) = 1)"
    for i, (n, cond, order) in enumerate(EXAMPLE_RULES_SQL)) + """)
SELECT Model, example, o_orderkey, date, proba_up, target FROM c
QUALIFY row_number() OVER (PARTITION BY Model, o_orderkey ORDER BY pri) = 1""", dbl="proba_up")
def q_pick_examples(spark, sf):
    """Showcase predictions — best confident hits, a coin flip, false
    signals and the most recent actual UP/DOWN — de-duplicated by id."""
    p = inputs.predictions(spark, sf).where(F.col("Split") == "test")
    p = p.select("Model", "o_orderkey", "date", "proba_up", "target",
                 (F.col("proba_up") >= 0.5).cast("int").alias("pred"), F.abs(F.col("proba_up") - 0.5).alias("margin"))
    pred, tgt, m = F.col("pred"), F.col("target"), F.col("margin")
    rules = [("confident_up_correct", (pred == 1) & (pred == tgt), m, True),
             ("confident_down_correct", (pred == 0) & (pred == tgt), m, True),
             ("uncertain", F.lit(True), m, False),
             ("false_up", (pred == 1) & (pred != tgt), m, True),
             ("false_down", (pred == 0) & (pred != tgt), m, True),
             ("recent_up", tgt == 1, F.col("date"), True),
             ("recent_down", tgt == 0, F.col("date"), True)]
    ex = rs.pick_examples(p, "o_orderkey", rules, ["Model"])
    return finish(ex.select("Model", "example", "o_orderkey", "date", "proba_up", "target"))


@register("lookup_fallback", with_(PANEL) + """
SELECT o.o_orderkey, coalesce(CASE WHEN p.date IS NOT NULL THEN p.close END, f.close) AS close,
       CASE WHEN p.date IS NOT NULL THEN 'primary' WHEN f.date IS NOT NULL THEN 'fallback' END AS matched_on
FROM (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 1 AS t
      FROM orders) o
LEFT JOIN panel p ON p.series_id = o.o_orderpriority AND p.date = o.t
LEFT JOIN panel f ON f.series_id = o.o_orderpriority AND f.date = o.d""", dbl="close")
def q_lookup_fallback(spark, sf):
    """Attach the series close of the next day (target date), else of the order date."""
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("d"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("t"))
    panel = inputs.daily_panel(spark, sf)
    out = rs.lookup_with_fallback(o, panel, {"o_orderpriority": "series_id", "t": "date"},
                                  {"o_orderpriority": "series_id", "d": "date"}, ["close"])
    return finish(out.select("o_orderkey", "close", "matched_on"))


@register("typed_props", """
WITH v AS (SELECT trim(regexp_extract(props, ':\\s*([^}]*)', 1)) AS s FROM events),
k AS (SELECT s, CASE WHEN s IS NULL OR s = '' THEN 'null' WHEN lower(s) IN ('true', 'false') THEN 'bool'
                     WHEN regexp_matches(s, '^[+-]?[0-9]+$') THEN 'int'
                     WHEN regexp_matches(s, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float'
                     ELSE 'string' END AS kind FROM v)
SELECT kind, count(*) AS n, CAST(sum(CASE WHEN kind = 'int' THEN TRY_CAST(s AS BIGINT) END) AS BIGINT) AS sum_long
FROM k GROUP BY 1""")
def q_typed_props(spark, sf):
    """The scalar inside each props document coerced by the null/bool/int/float/string ladder."""
    e = read_table(spark, sf, "events").select(F.regexp_extract("props", r":\s*([^}]*)", 1).alias("s"))
    t = e.select(src.coerce_text("s").alias("t"))
    return t.groupBy(F.col("t.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"),
                                                         F.sum("t.long").cast("long").alias("sum_long"))


# Expected value ranges per feature for the range check.
EXPECTED = [("ret", -1.0, 10.0), ("ret5", -1.0, 100.0), ("vol7", 0.0, 100.0), ("n_orders", 1.0, 1000.0),
            ("close_z", -10.0, 10.0)]


@register("range_check", with_(FEATURES_SQL) + """,
e AS (SELECT * FROM (VALUES """ + ", ".join(f"('{f}', {lo}::DOUBLE, {hi}::DOUBLE)" for f, lo, hi in EXPECTED) + """)
      t(feature, lo, hi)),
o AS (SELECT feature, min(value) AS min, max(value) AS max FROM fl GROUP BY 1)
SELECT o.feature, o.min, o.max, e.lo, e.hi,
       CASE WHEN o.min >= e.lo AND o.max <= e.hi THEN 'OK' ELSE 'WARNING' END AS status
FROM o LEFT JOIN e USING (feature)""", dbl="min max lo hi")
def q_range_check(spark, sf):
    """Observed min/max of each feature against its expected range."""
    exp = spark.createDataFrame(EXPECTED, "feature string, lo double, hi double")
    return finish(qa.range_check(inputs.feature_long(spark, sf), exp))


@register("group_stats_by_class", with_(FEATURES_SQL) + """
SELECT feature, direction, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, 0.5) AS median,
       min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
FROM fl GROUP BY 1, 2""", dbl="mean std median min max q25 q75")
def q_group_stats_by_class(spark, sf):
    """Distribution of every feature per label class."""
    return finish(qa.group_stats(inputs.feature_long(spark, sf), ["feature", "direction"], "value"))


@register("replay_by_id", with_(PREDICTIONS) + """
SELECT r.l_orderkey AS o_orderkey, p.Model, p.proba_up, p.target, CASE WHEN p.o_orderkey IS NULL THEN 0 ELSE 1 END AS found
FROM (SELECT DISTINCT l_orderkey FROM lineitem) r
LEFT JOIN preds p ON p.o_orderkey = r.l_orderkey""", dbl="proba_up")
def q_replay_by_id(spark, sf):
    """Replay every model's stored prediction for every order id referenced by lineitem (found flag, no error)."""
    req = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    stored = inputs.predictions(spark, sf).select("o_orderkey", "Model", "proba_up", "target")
    return finish(rs.replay(req, stored, "o_orderkey"))
