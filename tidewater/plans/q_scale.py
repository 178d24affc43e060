"""Registered queries of the operators that work in several passes over distributed state: mergeable sketches,
nearest-neighbour information, cross-product regression, release calendars and keyed series in a stream."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import calendar as cal
from tidewater.operators import information as im
from tidewater.operators import linear
from tidewater.operators import neighbors as nb
from tidewater.operators import prep, sketch
from tidewater.plans import inputs
from tidewater.plans.q_prep import TRAIN_ROWS, _every_twentieth
from tidewater.plans.registry import FEATURES_SQL, finish, register, with_
from tidewater.session import cut_lineage, read_table
from tidewater.streaming import ingest, series

F5 = ["ret", "ret5", "vol7", "n_orders", "close_z"]
LONG_SQL = ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT series_id, date, split, direction, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM fm WHERE {f} IS NOT NULL" for f in F5) + ")"


@register("frequent_values", with_(FEATURES_SQL) + LONG_SQL + """,
c AS (SELECT feature, value, count(*) AS n FROM long GROUP BY 1, 2)
SELECT feature, arg_max(value, (n, -value)) AS top_value, max(n) AS top_count, max(n) * 100.0 / sum(n) AS top_pct FROM c GROUP BY 1""",
          dbl="top_value top_pct")
def q_frequent_values(spark, sf):
    """Most frequent value and its share per feature, exactly."""
    return finish(sketch.most_frequent(inputs.feature_long(spark, sf), ["feature"], "value"))


@register("heavy_values", """
WITH l AS (SELECT 'quantity' AS feature, l_quantity AS value FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem
           UNION ALL SELECT 'price', l_extendedprice FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem),
c AS (SELECT feature, value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT feature, value, count, count / sum(count) OVER (PARTITION BY feature) AS share FROM c) WHERE share >= 0.019""", dbl="value share")
def q_heavy_values(spark, sf):
    """All values that hold 1.9 % of a column, candidates by a frequent-items sketch, counts exact."""
    li = read_table(spark, sf, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
                                                  F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    long = li.unpivot([], li.columns, "feature", "value")
    return finish(sketch.heavy_hitters(long, ["feature"], "value", 0.019))


@register("sketch_profile", with_(FEATURES_SQL) + LONG_SQL + """
SELECT feature, count(*) AS count, avg(value) AS mean, min(value) AS low, max(value) AS high, true AS quartiles_hold, true AS distinct_holds
FROM long GROUP BY 1""", dbl="mean low high")
def q_sketch_profile(spark, sf):
    """Profile from sketches per split and series, merged; do estimates keep their bounds against exact counts?"""
    long = inputs.feature_long(spark, sf)
    fine = sketch.value_sketches(long, ["feature", "split", "series_id"], "value")
    est = cut_lineage(sketch.sketch_estimates(sketch.merge_sketches(fine, ["feature"]), ["feature"]))
    # exact side: rank of each estimated quartile (equal values span a range of ranks), and the distinct values
    j = long.select("feature", "value").join(F.broadcast(est.select("feature", "q25", "q50", "q75")), "feature")
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    exact = j.groupBy("feature").agg(*[share(F.col("value") < F.col(q)).alias(f"{q}_lo") for q in ("q25", "q50", "q75")],
                                     *[share(F.col("value") <= F.col(q)).alias(f"{q}_hi") for q in ("q25", "q50", "q75")])
    unique = long.select("feature", "value").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("exact_unique"))
    e = sketch.rank_error()
    holds = F.lit(True)
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        holds = holds & (F.col(f"{q}_lo") <= p + e) & (F.col(f"{q}_hi") >= p - e)
    near = F.abs(F.col("n_unique") - F.col("exact_unique")) <= sketch.distinct_error() * F.col("exact_unique") + 1
    return finish(est.join(exact, "feature").join(unique, "feature").select(
        "feature", "count", "mean", "low", "high", holds.alias("quartiles_hold"), near.alias("distinct_holds")))


@register("knn_information", with_(FEATURES_SQL) + LONG_SQL + """,
r AS (SELECT feature, direction, value AS v, series_id, date, count(*) OVER (PARTITION BY feature, direction) AS size,
             [""" + ", ".join(f"value - lag(value, {j}) OVER w" for j in range(1, 6)) + ", " + ", ".join(
              f"lead(value, {j}) OVER w - value" for j in range(1, 6)) + """] AS gaps,
             [""" + ", ".join(f"lag(value, {j}) OVER w" for j in range(1, 6)) + ", " + ", ".join(
              f"lead(value, {j}) OVER w" for j in range(1, 6)) + """] AS ends
      FROM long WHERE split = 'train' WINDOW w AS (PARTITION BY feature, direction ORDER BY value, series_id, date)),
d AS (SELECT *, least(5, size - 1) AS k, list_sort(list_filter(gaps, lambda g: g IS NOT NULL))[least(5, size - 1)] AS d FROM r WHERE size > 1),
b AS (SELECT *, coalesce(list_filter(list_zip(gaps[1:5], ends[1:5]), lambda z: z[1] = d)[1][2], v - d) AS lo,
             coalesce(list_filter(list_zip(gaps[6:10], ends[6:10]), lambda z: z[1] = d)[1][2], v + d) AS hi FROM d),
h AS (SELECT feature, v AS x, sum(count(*)) OVER (PARTITION BY feature ORDER BY v) AS upto, count(*) AS n FROM d GROUP BY 1, 2),
lt AS (SELECT b.*, coalesce(h.upto, 0) AS below FROM b ASOF LEFT JOIN h ON b.feature = h.feature AND b.hi > h.x),
le AS (SELECT lt.*, coalesce(h.upto, 0) AS upto FROM lt ASOF LEFT JOIN h ON lt.feature = h.feature AND lt.lo >= h.x),
m AS (SELECT le.feature, k, size, CASE WHEN d = 0 THEN h.n ELSE below - le.upto END AS m FROM le JOIN h ON h.feature = le.feature AND h.x = le.v),
psi AS (SELECT n, coalesce(sum(1.0 / (n - 1)) FILTER (n > 1) OVER (ORDER BY n), 0.0) - 0.5772156649015329 AS psi
        FROM (SELECT unnest(range(1, (SELECT max(c) + 2 FROM (SELECT count(*) AS c FROM d GROUP BY feature)))) AS n))
SELECT m.feature, count(*) AS n, greatest(0.0, any_value(pn.psi) + avg(pk.psi - ps.psi - pm.psi)) AS "MI"
FROM m JOIN psi pk ON pk.n = m.k JOIN psi ps ON ps.n = m.size JOIN psi pm ON pm.n = m.m
JOIN (SELECT feature, count(*) AS c FROM d GROUP BY 1) f ON f.feature = m.feature JOIN psi pn ON pn.n = f.c GROUP BY 1""", dbl="MI")
def q_knn_information(spark, sf):
    """T-08: mutual information of every feature and the direction by five nearest neighbours (train rows)."""
    long = inputs.feature_long(spark, sf).where("split = 'train'")
    return finish(im.knn_mutual_information(long, ["feature"], "value", "direction", ["series_id", "date"]))


def _ridge_sql() -> str:
    p = len(F5) + 1
    z = ["1.0", *[f"coalesce(({f} - m_{f}) / s_{f}, 0.0)" for f in F5], "target_ret"]
    names = [f"z{i}" for i in range(p + 1)]
    gram = ", ".join(f"sum({names[min(i, j)]} * {names[max(i, j)]})" for i in range(p) for j in range(p + 1))
    full = ", ".join(f"sum({names[min(i, j)]} * {names[max(i, j)]})" for i in range(p + 1) for j in range(p + 1))
    w = p + 1  # width of the augmented system, flattened by rows
    sweep = (f"list_transform(range(1, {p * w + 1}), lambda c: CASE WHEN (c - 1) // {w} = k THEN g[c] / g[k * {w} + k + 1] "
             f"ELSE g[c] - g[((c - 1) // {w}) * {w} + k + 1] * g[k * {w} + (c - 1) % {w} + 1] / g[k * {w} + k + 1] END)")
    terms = ", ".join(f"'{t}'" for t in ["intercept", *F5])
    sse = " + ".join(f"({'-1.0' if i == p else f'b[{i + 1}]'}) * ({'-1.0' if j == p else f'b[{j + 1}]'}) * v[{i * (p + 1) + j + 1}]"
                     for i in range(p + 1) for j in range(p + 1))
    return f""",
st AS (SELECT {", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in F5)} FROM fm WHERE split = 'train'),
zs AS (SELECT split, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip(z, names))} FROM fm, st),
tr AS (SELECT [{gram}] AS g FROM zs WHERE split = 'train'),
va AS (SELECT [{full}] AS v, count(*) AS n FROM zs WHERE split = 'val'),
al AS (SELECT unnest([0.0, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0])::DOUBLE AS alpha),
sw AS (SELECT alpha, 0 AS k, list_transform(range(1, {p * w + 1}), lambda c: g[c] + CASE WHEN (c - 1) // {w} = (c - 1) % {w} AND c > 1 THEN alpha ELSE 0.0 END) AS g
       FROM al, tr
       UNION ALL SELECT alpha, k + 1, {sweep} FROM sw WHERE k < {p}),
be AS (SELECT alpha, list_transform(range(0, {p}), lambda r: g[r * {w} + {w}]) AS b FROM sw WHERE k = {p}),
er AS (SELECT alpha, b, sqrt(({sse}) / n) AS rmse_val FROM be, va),
pk AS (SELECT arg_min(alpha, (rmse_val, alpha)) AS best FROM er)
SELECT alpha, unnest([{terms}]) AS term, unnest(b) AS coefficient, rmse_val, alpha = best AS picked FROM er, pk"""


@register("ridge_path", "WITH RECURSIVE " + with_(FEATURES_SQL).removeprefix("WITH ") + _ridge_sql(), dbl="alpha coefficient rmse_val")
def q_ridge_path(spark, sf):
    """OLS and ridge over the penalty grid from one table of cross products; the penalty picked on validation."""
    return finish(linear.ridge_path(inputs.feature_matrix(spark, sf), F5, "target_ret"))


RELEASES_SQL = """
per AS (SELECT l_returnflag AS flag, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS full_qty,
               CAST(sum(CASE WHEN l_linenumber <= 3 THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS first_qty
        FROM lineitem GROUP BY 1, 2),
rel AS (SELECT flag, period, CAST(period + INTERVAL 1 MONTH AS DATE) + CASE WHEN month(period) % 4 = 0 THEN 70 ELSE 12 END AS released, first_qty AS qty FROM per
        UNION ALL SELECT flag, period, CAST(period + INTERVAL 3 MONTH AS DATE) + 20, full_qty FROM per)"""


@register("release_calendar", "WITH " + RELEASES_SQL + """,
q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, flag FROM orders, (SELECT DISTINCT flag FROM per)),
best AS (SELECT q.flag, q.date, max((rel.period, rel.released, rel.qty)) AS b FROM q JOIN rel ON rel.flag = q.flag AND rel.released <= q.date GROUP BY 1, 2)
SELECT q.flag, q.date, b[1] AS period, b[2] AS released_at, b[3] AS qty FROM q LEFT JOIN best USING (flag, date)""")
def q_release_calendar(spark, sf):
    """The latest period known on each order date, in its latest revision, with late first releases."""
    li = read_table(spark, sf, "lineitem")
    qty = F.col("l_quantity").cast("long")
    per = li.groupBy(F.col("l_returnflag").alias("flag"), F.trunc("l_shipdate", "MM").alias("period")).agg(
        F.sum(qty).alias("full_qty"), F.sum(F.when(F.col("l_linenumber") <= 3, qty)).alias("first_qty"))
    first = F.date_add(F.add_months("period", 1), F.when(F.month("period") % 4 == 0, 70).otherwise(12))
    rel = per.select("flag", "period", first.alias("released"), F.col("first_qty").alias("qty")).unionByName(
        per.select("flag", "period", F.date_add(F.add_months("period", 3), 20).alias("released"), F.col("full_qty").alias("qty")))
    flags = F.explode(per.select("flag").distinct().agg(F.array_sort(F.collect_list("flag"))).scalar())  # one value per flag
    days = read_table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().withColumn("flag", flags)
    return cal.release_asof(days, rel, "date", "released", "period", ["qty"], ["flag"]).select("flag", "date", "period", "released_at", "qty")


@register("yeo_johnson_lambda")
def q_yeo_johnson_lambda(spark, sf):
    """Bracketed lambda per feature on train rows; SQL has no optimiser, tests compare it with one."""
    return finish(prep.fit_yeo_johnson(inputs.feature_long(spark, sf), TRAIN_ROWS()).select("feature", F.round("lambda", 4).alias("lambda"), "mean", "std"))


@register("knn_evaluations")
def q_knn_evaluations(spark, sf):
    """Distances that the second round of the nearest-neighbour join computes for each query."""
    refs, qs = _every_twentieth(spark, sf)
    return nb.knn_evaluations(refs, qs, 5, "vec_id", "embedding", "outcome", self_id="own_id")


@register("stream_ewm", """
WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
e AS (SELECT user_id, event_id, k, value, value AS ewm FROM o WHERE k = 1
      UNION ALL SELECT o.user_id, o.event_id, o.k, o.value, 0.2 * o.value + 0.8 * e.ewm FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
SELECT user_id, event_id, value, ewm, value AS filled FROM e""", dbl="value ewm filled")
def q_stream_ewm(spark, sf):
    """ST06: exponential mean and last value per user from keyed state with timers; the last version of each row."""
    stream = ingest.table_stream(spark, sf, "events")
    rows = series.series_state(stream, "user_id", "ts", "event_id", "value", 0.2, delay="30 days", keep_ms=60 * 86_400_000)
    sink, mark = ingest.scratch_paths(spark, "stream_ewm")
    ingest.run_available_now(rows, sink, mark, state_store=series.STATE_STORE)
    out = ingest.latest_versions(spark, sink, ["user_id", "event_id"])
    return finish(out.select("user_id", "event_id", "value", "ewm", "filled"))
