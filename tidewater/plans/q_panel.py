"""Registered queries on a panel with one series per user (its keys and rows grow with the events table),
on continuous scores, and for operators that no other query calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import scalar as sc
from tidewater.operators import calendar as cal
from tidewater.operators import evaluate as ev
from tidewater.operators import features as ft
from tidewater.operators import quality as qa
from tidewater.operators import reshape as rs
from tidewater.operators import scan
from tidewater.plans import inputs
from tidewater.plans.registry import FEATURES_SQL, PANEL, finish, register, with_
from tidewater.session import read_table
from tidewater.streaming import ingest

USERS = """users AS (
  SELECT user_id AS series_id, CAST(ts AS DATE) AS date, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 1024.0 AS x,
         count(*) AS n FROM events GROUP BY 1, 2)"""


def user_panel(spark, sf):
    """(series_id, date, x, n): per user and day the summed value in cents over 1024 (exact) and the event count."""
    e = read_table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("series_id"), F.to_date("ts").alias("date")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.lit(1024.0)).alias("x"),
        F.count(F.lit(1)).alias("n"))


@register("user_rolling", with_(USERS) + """
SELECT series_id, date, x, x - lag(x) OVER w AS x_diff, avg(x) OVER r3 AS x_mean3,
       CASE WHEN count(x) OVER r3 >= 3 THEN stddev_samp(x) OVER r3 END AS x_std3,
       sum(x) OVER d7 AS x_sum7d, count(x) OVER d7 AS x_count7d, CAST(coalesce(x < avg(x) OVER r5 - 1.0, false) AS INTEGER) AS low
FROM users WINDOW w AS (PARTITION BY series_id ORDER BY date),
  r3 AS (PARTITION BY series_id ORDER BY date ROWS 2 PRECEDING), r5 AS (PARTITION BY series_id ORDER BY date ROWS 4 PRECEDING),
  d7 AS (PARTITION BY series_id ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""",
          dbl="x x_diff x_mean3 x_std3 x_sum7d")
def q_user_rolling(spark, sf):
    """W01/W03/W06/W07/W12 on many series: differences, row and calendar windows, drop below the trailing mean."""
    d = user_panel(spark, sf)
    d = ft.add_rolling(d, "x", 3, ("mean",), min_periods=1)
    d = ft.add_rolling(d, "x", 3, ("std",))
    d = ft.calendar_rolling(d, "x", 7, ("sum", "count"))
    d = ft.below_trailing_mean(d, "x", 5, 1.0, "low")
    w = Window.partitionBy("series_id").orderBy("date")
    return finish(d.withColumn("x_diff", F.col("x") - F.lag("x").over(w)).select(
        "series_id", "date", "x", "x_diff", "x_mean3", "x_std3", "x_sum7d", "x_count7d", "low"))


@register("user_ewm", "WITH RECURSIVE " + USERS + """,
o AS (SELECT series_id, date, x, row_number() OVER (PARTITION BY series_id ORDER BY date) AS k FROM users),
e AS (SELECT series_id, date, k, x AS fast, x AS slow FROM o WHERE k = 1
      UNION ALL SELECT o.series_id, o.date, o.k, 0.5 * o.x + 0.5 * e.fast, 0.2 * o.x + 0.8 * e.slow
      FROM e JOIN o ON o.series_id = e.series_id AND o.k = e.k + 1)
SELECT series_id, date, fast, slow FROM e""", dbl="fast slow")
def q_user_ewm(spark, sf):
    """W14 on many series: spans 3 and 9 in one scan."""
    d = scan.ewm_mean(user_panel(spark, sf), "x", {"fast": 0.5, "slow": 0.2})
    return finish(d.select("series_id", "date", "fast", "slow"))


@register("user_streaks", with_(USERS) + """,
u AS (SELECT series_id, date, CAST(x > lag(x) OVER (PARTITION BY series_id ORDER BY date) AS INTEGER) AS up FROM users),
g AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date)
                - row_number() OVER (PARTITION BY series_id, up ORDER BY date) AS run FROM u WHERE up IS NOT NULL),
s AS (SELECT series_id, up, run, count(*) AS length FROM g GROUP BY 1, 2, 3)
SELECT series_id, up, max(length) AS longest, count(*) AS runs FROM s GROUP BY 1, 2""")
def q_user_streaks(spark, sf):
    """W22 on many series: longest run of rises and of falls per user."""
    w = Window.partitionBy("series_id").orderBy("date")
    d = user_panel(spark, sf).withColumn("up", (F.col("x") > F.lag("x").over(w)).cast("int"))
    s = ft.streak_runs(d, "up")
    return s.groupBy("series_id", "up").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("runs"))


@register("user_equity", with_(USERS) + """,
r AS (SELECT series_id, date, sum(x - 8) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS total FROM users),
m AS (SELECT *, total - max(total) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS below FROM r)
SELECT series_id, arg_max(total, date) AS last_total, min(below) AS max_below, count(*) AS days FROM m GROUP BY 1""",
          dbl="last_total max_below")
def q_user_equity(spark, sf):
    """W23 on many series: running total and the deepest fall below its maximum so far."""
    w = Window.partitionBy("series_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    r = user_panel(spark, sf).withColumn("total", F.sum(F.col("x") - 8).over(w))
    m = r.withColumn("below", F.col("total") - F.max("total").over(w))
    return finish(m.groupBy("series_id").agg(F.max_by("total", "date").alias("last_total"), F.min("below").alias("max_below"),
                                             F.count(F.lit(1)).alias("days")))


HOT = """hot AS (
  SELECT CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id END AS series_id, ts, event_type, value,
         CASE WHEN event_type = 'purchase' THEN value END AS paid, (value - 50.0) / 10000.0 AS ret FROM events)"""


def hot_events(spark, sf):
    """Events as series of one row per event; one series holds about a third of the table."""
    e = read_table(spark, sf, "events")
    return e.select(F.when(F.col("user_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")).cast("long").alias("series_id"), "ts", "event_type",
                    "value", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"),
                    ((F.col("value") - F.lit(50.0)) / F.lit(10000.0)).alias("ret"))


@register("hot_ffill", with_(HOT) + """,
f AS (SELECT *, last_value(paid IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS last_paid FROM hot)
SELECT series_id, event_type, count(last_paid) AS filled, CAST(sum(CAST(round(last_paid * 100) AS BIGINT)) AS BIGINT) AS cents FROM f GROUP BY 1, 2""")
def q_hot_ffill(spark, sf):
    """F02 on a hot series: the last purchase before every event, by a two-level scan."""
    d = cal.ffill(hot_events(spark, sf), ["paid"], order="ts")
    return d.groupBy("series_id", "event_type").agg(
        F.count("paid").alias("filled"), F.sum(F.round(F.col("paid") * 100).cast("long")).alias("cents"))


@register("hot_equity", with_(HOT) + """,
q AS (SELECT *, product(greatest(0.0, 1.0 + ret)) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM hot),
d AS (SELECT *, equity / max(equity) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1.0 AS below FROM q)
SELECT series_id, arg_max(equity, ts) AS equity, min(below) AS max_drawdown, count(*) AS n FROM d GROUP BY 1""", dbl="equity max_drawdown")
def q_hot_equity(spark, sf):
    """W23/B05 on a hot series: compounded value and deepest fall below its peak."""
    d = ft.equity_curve(hot_events(spark, sf), "ret", order="ts")
    return finish(d.groupBy("series_id").agg(F.max_by("equity", "ts").alias("equity"), F.min("drawdown").alias("max_drawdown"),
                                             F.count(F.lit(1)).alias("n")))


@register("hot_weights", with_(HOT) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM hot),
w AS (SELECT *, exp(-ln(2.0) / 250.0 * (n - 1 - i)) AS raw, lag(event_type) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM r),
s AS (SELECT *, raw / avg(raw) OVER (PARTITION BY series_id) AS weight FROM w)
SELECT series_id, sum(weight * value) / sum(weight) AS mean_value, max(weight) AS top_weight,
       CAST(count_if(before = event_type) AS BIGINT) AS repeats FROM s GROUP BY 1""", dbl="mean_value top_weight")
def q_hot_weights(spark, sf):
    """W26/W04 on a hot series: recency-weighted mean value, and events that repeat the type before them."""
    d = ft.recency_weights(hot_events(spark, sf), "exponential", order="ts")
    d = scan.running(d, {"before": ("lag", "event_type", 1)}, "series_id", "ts")
    return finish(d.groupBy("series_id").agg(
        (F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("mean_value"), F.max("weight").alias("top_weight"),
        F.count_if(F.col("before") == F.col("event_type")).alias("repeats")))


SCORED = USERS + """,
p AS (SELECT series_id % 7 AS grp, CAST(lead(x) OVER (PARTITION BY series_id ORDER BY date) > x AS INTEGER) AS target,
             1.0 / (1.0 + exp((x - 9.0) / 4.0)) AS proba_up FROM users)"""


def continuous_scores(spark, sf):
    """(grp, target, proba_up): does a user's next day rise, scored by today's level (a continuous score)."""
    w = Window.partitionBy("series_id").orderBy("date")
    d = user_panel(spark, sf).withColumn("target", (F.lead("x").over(w) > F.col("x")).cast("int")).where(F.col("target").isNotNull())
    return d.select((F.col("series_id") % 7).alias("grp"), "target", sc.logistic((F.lit(9.0) - F.col("x")) / 4.0).alias("proba_up"))


@register("user_auc", with_(SCORED) + """,
r AS (SELECT grp, target, rank() OVER (PARTITION BY grp ORDER BY proba_up) + (count(*) OVER (PARTITION BY grp, proba_up) - 1) / 2.0 AS rk
      FROM p WHERE target IS NOT NULL),
a AS (SELECT grp, count_if(target = 1) AS n1, count_if(target = 0) AS n0, sum(CASE WHEN target = 1 THEN rk END) AS s FROM r GROUP BY 1)
SELECT grp, (s - n1 * (n1 + 1) / 2.0) / (CAST(n1 AS DOUBLE) * n0) AS AUC FROM a""", dbl="AUC")
def q_user_auc(spark, sf):
    """E03/X10 with continuous scores: the histogram has about as many rows as the table."""
    return finish(ev.roc_auc(continuous_scores(spark, sf), ["grp"]))


@register("user_threshold_counts", with_(SCORED) + """
SELECT grp, j * 0.1 AS threshold, CAST(count_if(target = 1 AND proba_up >= j * 0.1) AS BIGINT) AS TP,
       CAST(count_if(target = 0 AND proba_up >= j * 0.1) AS BIGINT) AS FP
FROM p, range(1, 10) t(j) WHERE target IS NOT NULL GROUP BY 1, 2""", dbl="threshold")
def q_user_threshold_counts(spark, sf):
    """E06 with continuous scores on a coarse grid."""
    s = ev.threshold_sweep(continuous_scores(spark, sf), ["grp"], lo=0.1, hi=0.9, n=9)
    return finish(s.select("grp", "threshold", "TP", "FP"))


@register("user_three_way", with_(USERS) + """,
r AS (SELECT series_id, (x - lag(x) OVER (PARTITION BY series_id ORDER BY date)) / 100.0 AS d FROM users)
SELECT CASE WHEN d > 0.03 THEN 1 WHEN d < -0.03 THEN 0 ELSE -1 END AS label, count(*) AS n FROM r GROUP BY 1""")
def q_user_three_way(spark, sf):
    """Rise, fall or dead band; a missing change is in the band."""
    w = Window.partitionBy("series_id").orderBy("date")
    d = user_panel(spark, sf).withColumn("d", (F.col("x") - F.lag("x").over(w)) / 100.0)
    return d.groupBy(sc.three_way_label(F.col("d"), 0.03).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("severity_index", """
WITH d AS (SELECT CAST(ts AS DATE) AS date, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 1024.0 AS total, count(*) AS n,
                  count_if(event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT date, total / (n + 1.0) AS severity, CAST(n AS DOUBLE) - errors AS net, CAST(n AS DOUBLE) - errors - users AS pressure,
       0.40 * (total / (n + 1.0)) + 0.35 * (errors / 10.0) + 0.25 * (users / 10.0) AS weighted FROM d""",
          dbl="severity net pressure weighted")
def q_severity_index(spark, sf):
    """Severity, differences of differences and a weighted index per day."""
    e = read_table(spark, sf, "events")
    d = e.groupBy(F.to_date("ts").alias("date")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.lit(1024.0)).alias("total"),
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("event_type") == "error").cast("double").alias("errors"),
        F.countDistinct("user_id").cast("double").alias("users"))
    d = d.withColumns({"severity": sc.severity("total", "n"), "net": sc.difference("n", "errors"),
                       "a": F.col("errors") / 10.0, "b": F.col("users") / 10.0})
    d = d.withColumns({"pressure": sc.difference("net", "users"), "weighted": sc.weighted_index(["severity", "a", "b"], [0.40, 0.35, 0.25])})
    return finish(d.select("date", "severity", "net", "pressure", "weighted"))


@register("user_ffill", with_(USERS) + """,
b AS (SELECT series_id, min(date) AS lo, max(date) AS hi FROM users GROUP BY 1),
c AS (SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b),
a AS (SELECT c.series_id, c.date, x, n FROM c LEFT JOIN users u ON u.series_id = c.series_id AND u.date = c.date WHERE isodow(c.date) < 6)
SELECT series_id, date, last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS x, n FROM a""", dbl="x")
def q_user_ffill(spark, sf):
    """unlimited forward fill on each user's business days; the excluded column is left alone."""
    a = cal.align_to_calendar(user_panel(spark, sf), flag_col=None)
    return finish(cal.ffill(a, ["x", "n"], limit=None, exclude=["n"]).select("series_id", "date", "x", "n"))


@register("monthly_first_value", with_(PANEL) + """
SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_min(close, date) FILTER (n_orders > 1) AS close
FROM panel GROUP BY 1, 2""", dbl="close")
def q_monthly_first_value(spark, sf):
    """first non-missing value of each month (days with one order count as missing)."""
    p = inputs.daily_panel(spark, sf).withColumn("close", F.when(F.col("n_orders") > 1, F.col("close")))
    return finish(cal.monthly_first(p, ["close"]))


@register("union_overlap", """
WITH u AS (SELECT 'order' AS kind, CAST(o_orderdate AS DATE) AS date, o_totalprice AS price, NULL AS qty FROM orders
           UNION ALL SELECT 'ship', CAST(l_shipdate AS DATE), NULL, l_quantity FROM lineitem)
SELECT kind, count(*) AS rows, count(price) AS prices, count(qty) AS quantities, min(date) AS first_seen,
       (SELECT count(*) FROM (SELECT date FROM u WHERE kind = 'order' INTERSECT SELECT date FROM u WHERE kind = 'ship')) AS overlap
FROM u GROUP BY 1""")
def q_union_overlap(spark, sf):
    """Two sources aligned by column name, kinds in order of first appearance, shared dates."""
    o = read_table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.to_date("o_orderdate").alias("date"),
                                               F.col("o_totalprice").alias("price"))
    s = read_table(spark, sf, "lineitem").select(F.lit("ship").alias("kind"), F.to_date("l_shipdate").alias("date"),
                                                 F.col("l_quantity").alias("qty"))
    u = rs.union_aligned([o, s])
    c = u.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count("price").alias("prices"), F.count("qty").alias("quantities"))
    return (c.join(rs.ordered_distinct(u, "kind", "date"), "kind")
            .withColumn("overlap", rs.overlap_count(o, s, ["date"]).scalar()))


@register("split_balance", with_(FEATURES_SQL) + """
SELECT split, count(*) AS rows, min(date) AS start, max(date) AS "end",
       CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS ratio FROM fm GROUP BY 1""", dbl="ratio")
def q_split_balance(spark, sf):
    """Rows, dates and share of every split."""
    return finish(qa.split_balance(inputs.feature_matrix(spark, sf), "split", "date"))


@register("column_rules", with_(FEATURES_SQL) + """
SELECT series_id, count(ret) AS n_ret, avg(close_z) AS close_z_lag, 'n_orders=count' AS dropped FROM fm GROUP BY 1""", dbl="close_z_lag")
def q_column_rules(spark, sf):
    """Rename as lag, drop what exists, drop by a rules table with a report, reorder."""
    fm = inputs.feature_matrix(spark, sf)
    rules = spark.createDataFrame([("n_orders", "volume", "count"), ("absent", "x", "y")], "column string, category string, reason string")
    clean, report = rs.drop_contaminated(rs.drop_existing(rs.rename_as_lag(fm, ["close_z"]), ["ret5", "missing", "ret5"]), rules)
    clean = rs.reorder(clean, ["date", "series_id"])
    text = report.agg(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws("=", "column", "reason")))))
    return finish(clean.groupBy("series_id").agg(F.count("ret").alias("n_ret"), F.avg("close_z_lag").alias("close_z_lag"))
                  .withColumn("dropped", text.scalar()))


@register("props_numeric", """
SELECT event_type, count(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS numeric, count(*) AS rows,
       sum(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS total FROM events GROUP BY 1""", dbl="total")
def q_props_numeric(spark, sf):
    """Text to number, malformed to NULL."""
    e = read_table(spark, sf, "events").withColumn("t", F.get_json_object("props", "$.k"))
    v = sc.to_double(F.col("t"))
    return finish(e.groupBy("event_type").agg(F.count(v).alias("numeric"), F.count(F.lit(1)).alias("rows"), F.sum(v).alias("total")))


@register("relabel_risk", """
SELECT CASE WHEN o_orderpriority = '3-MEDIUM' AND contains(o_orderstatus, 'O') THEN 'eod_only' ELSE o_orderpriority END AS risk, count(*) AS n
FROM orders GROUP BY 1""")
def q_relabel_risk(spark, sf):
    """Medium rows whose reason contains a text are relabelled."""
    o = read_table(spark, sf, "orders")
    return o.groupBy(sc.relabel("o_orderpriority", "o_orderstatus", "O", "3-MEDIUM").alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@register("release_mirror", """
SELECT "check", expected, actual, expected = actual AS pass FROM (
  SELECT 'rows' AS "check", CAST(count(*) AS VARCHAR) AS expected, CAST(count(*) AS VARCHAR) AS actual FROM supplier
  UNION ALL SELECT 'mirror', '0', CAST(count(*) AS VARCHAR) FROM (SELECT * FROM supplier EXCEPT SELECT * FROM supplier)
  UNION ALL SELECT 'balance', CAST(count(*) AS VARCHAR), CAST(count_if(s_acctbal >= 0) AS VARCHAR) FROM supplier)""")
def q_release_mirror(spark, sf):
    """Expected against actual values, and equality of a mirror both ways."""
    s = read_table(spark, sf, "supplier")
    other = read_table(spark, sf, "supplier").select(*s.columns)
    facts = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s_acctbal") >= 0).alias("good"))
    facts = facts.withColumn("differ", rs.mirror_differences(s, other).scalar())
    n = F.col("n").cast("string")
    return rs.release_checks([("rows", n, n), ("mirror", F.lit("0"), F.col("differ").cast("string")),
                              ("balance", n, F.col("good").cast("string"))], facts)


def _events(spark, sf):
    return ingest.table_stream(spark, sf, "events")


def _drained(spark, stream, name, keys):
    sink, mark = ingest.scratch_paths(spark, name)
    ingest.run_available_now(stream, sink, mark)
    return ingest.latest_versions(spark, sink, keys)


@register("stream_sliding", """
SELECT CAST(unnest(generate_series(CAST(ts AS DATE) - INTERVAL 6 DAYS, CAST(ts AS DATE), INTERVAL 1 DAY)) AS DATE) AS start, event_type,
       sum(value) AS value_sum FROM events GROUP BY 1, 2""", dbl="value_sum")
def q_stream_sliding(spark, sf):
    """ST05: seven-day windows sliding by a day, from the stream."""
    agg = ingest.sliding_sum(_events(spark, sf), ["event_type"], "value").select(
        F.to_date("window.start").alias("start"), "event_type", "value_sum")
    return finish(_drained(spark, agg, "sliding", ["start", "event_type"]))


@register("stream_weekend_roll", """
SELECT CAST(ts AS DATE) + CASE isodow(CAST(ts AS DATE)) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS date, count(*) AS n, sum(value) AS value_sum
FROM events GROUP BY 1""", dbl="value_sum")
def q_stream_weekend_roll(spark, sf):
    """ST04: weekend events counted on the next Monday, from the stream."""
    agg = ingest.daily_aggregate(_events(spark, sf), [], "value", roll_weekends=True)
    out = _drained(spark, agg, "weekend", ["event_day"])
    return finish(out.select(F.to_date("event_day").alias("date"), "n", "value_sum"))


RELEASES = """rel AS (SELECT event_type, CAST(ts AS DATE) + 1 AS available_at, count(*) AS known FROM events GROUP BY 1, 2)"""


@register("stream_availability", with_(RELEASES) + """
SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n, any_value(known) AS known
FROM (SELECT e.event_type, e.ts, known FROM events e ASOF LEFT JOIN rel r ON e.event_type = r.event_type AND CAST(e.ts AS DATE) >= r.available_at)
GROUP BY 1, 2""")
def q_stream_availability(spark, sf):
    """ST07: each event with the latest daily count of its type released by then."""
    static = read_table(spark, sf, "events").groupBy("event_type", F.date_add(F.to_date("ts"), 1).alias("available_at")).agg(
        F.count(F.lit(1)).alias("known"))
    s = ingest.availability_join(_events(spark, sf), static, "ts", "available_at", ["event_type"])
    sink, mark = ingest.scratch_paths(spark, "availability")
    ingest.run_available_now(s.select("event_type", F.to_date("ts").alias("date"), "known"), sink, mark, mode="append")
    return spark.read.parquet(sink).groupBy("event_type", "date").agg(F.count(F.lit(1)).alias("n"), F.first("known").alias("known"))


@register("stream_ffill", """
SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS ts_us, last_value(CASE WHEN value > 5 THEN value END IGNORE NULLS) OVER (
         PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value_filled FROM events""", dbl="value_filled")
def q_stream_ffill(spark, sf):
    """ST06: last known value per user carried in state, from the stream."""
    s = _events(spark, sf).withColumn("value", F.when(F.col("value") > 5, F.col("value")))
    sink, mark = ingest.scratch_paths(spark, "ffill")
    ingest.run_available_now(ingest.forward_fill_state(s, "user_id", "ts", "value"), sink, mark, mode="append")
    return finish(spark.read.parquet(sink).select("user_id", F.unix_micros("ts").alias("ts_us"), "value_filled"))
