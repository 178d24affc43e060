"""Logical inputs of the engine, derived from the driver tables.

Every registered query starts from one of these, so its work grows with the
source tables.  Monetary sums are done in integer cents so that Spark and
the SQL oracle produce bit-identical doubles (an exact integer sum followed
by the same IEEE divisions), which keeps downstream hashes stable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import read_table

# Split boundaries of the feature matrix (by target date).
TRAIN_END = "1999-01-01"
VAL_END = "2000-01-01"
# Probability multipliers of the three synthetic models m1..m3.
MODEL_MULTIPLIERS = {"m1": 37, "m2": 101, "m3": 613}


def _cents_avg(c: str) -> F.Column:
    """Average of ``c`` in whole cents (half-up, integer arithmetic) / 1024.

    The value is an integer over a power of two, so any window sum of it is
    exact in binary and identical in every engine and summation order.
    """
    s = F.sum(F.round(F.col(c) * 100).cast("long"))
    n = F.count(F.lit(1))
    cents = F.floor((s * 2 + n) / (n * 2)).cast("long")
    return cents.cast("double") / F.lit(1024.0)


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, close, n_orders): one series per order priority.

    ``close`` is the day's average order value in cents divided by 1024.
    """
    o = read_table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"),
                      F.to_date("o_orderdate").alias("date"))
            .agg(_cents_avg("o_totalprice").alias("close"),
                 F.count(F.lit(1)).alias("n_orders")))


def weekly_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(week, qty): shipped quantity per ISO week (Monday start)."""
    li = read_table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.trunc(F.to_date("l_shipdate"), "week").alias("week"))
            .agg(F.sum("l_quantity").alias("qty")))


def monthly_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, level, available_at): monthly level published one month later."""
    o = read_table(spark, sf_dir, "orders")
    return (o.groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("month"))
            .agg(_cents_avg("o_totalprice").alias("level"))
            .withColumn("available_at", F.add_months("month", 1)))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, date, ts, user_id, event_type, severity, props)."""
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.to_date("ts").alias("date"), "ts", "user_id", "event_type",
                    F.col("value").alias("severity"), "props")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table: one row per (Model, order).

    ``target = (o_orderstatus = 'F')``, ``proba_up = pmod(o_orderkey*c, 1009)/1008``
    for a fixed multiplier per model (deterministic, with ties).
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"))
    # one row per model via explode of a literal array: no join needed
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("Model"), F.lit(c).cast("long").alias("mult"))
                                 for m, c in MODEL_MULTIPLIERS.items()])).alias("__m")
    p = o.select("*", models).select("*", "__m.Model", "__m.mult")
    split = (F.when(F.col("date") < F.lit(TRAIN_END).cast("date"), "train")
             .when(F.col("date") < F.lit(VAL_END).cast("date"), "val").otherwise("test"))
    return p.select(
        F.lit("synthetic").alias("Experiment"), "Model", split.alias("Split"), "o_orderkey", "date", "target",
        (F.pmod(F.col("o_orderkey") * F.col("mult"), F.lit(1009)).cast("double") / F.lit(1008.0)).alias("proba_up"))


def returns_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel with one-row return, direction label and split."""
    p = daily_panel(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy("date")
    return p.withColumn("ret", F.try_divide(F.col("close"), F.lag("close", 1).over(w)) - F.lit(1.0))


def backtest_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, target_date, predicted_return, actual_return).

    score = previous day's return (a momentum signal), actual = next return.
    """
    p = returns_panel(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy("date")
    return (p.select("series_id", "date",
                     F.lead("date", 1).over(w).alias("target_date"),
                     F.lag("ret", 1).over(w).alias("predicted_return"),
                     F.lead("ret", 1).over(w).alias("actual_return"))
            .where(F.col("predicted_return").isNotNull() & F.col("actual_return").isNotNull()))


FEATURES = ["ret", "ret5", "vol7", "n_orders", "close_z"]


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide feature matrix per (series_id, date) with label and split.

    Features: ret (1-day return), ret5 (5-row return), vol7 (7-row sample
    std of ret), n_orders, close_z (close minus 20-row mean, over the 20-row
    population std).  direction = next return > 0; split by target date.
    """
    p = returns_panel(spark, sf_dir)
    w = Window.partitionBy("series_id").orderBy("date")
    f7 = w.rowsBetween(-6, 0)
    f20 = w.rowsBetween(-19, 0)
    out = p.select(
        "series_id", "date", "ret",
        (F.try_divide(F.col("close"), F.lag("close", 5).over(w)) - F.lit(1.0)).alias("ret5"),
        F.when(F.count("ret").over(f7) >= 7, F.stddev_samp("ret").over(f7)).alias("vol7"),
        F.col("n_orders").cast("double").alias("n_orders"),
        F.when(F.count("close").over(f20) >= 20,
               F.try_divide(F.col("close") - F.avg("close").over(f20), F.stddev_pop("close").over(f20))).alias("close_z"),
        F.lead("ret", 1).over(w).alias("target_ret"),
        F.lead("date", 1).over(w).alias("target_date"))
    out = out.where(F.col("target_ret").isNotNull())
    split = (F.when(F.col("target_date") < F.lit(TRAIN_END).cast("date"), "train")
             .when(F.col("target_date") < F.lit(VAL_END).cast("date"), "val").otherwise("test"))
    return out.withColumn("direction", (F.col("target_ret") > 0).cast("int")).withColumn("split", split)


def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix unpivoted to (series_id, date, split, direction, feature, value)."""
    fm = feature_matrix(spark, sf_dir)
    return fm.unpivot(["series_id", "date", "split", "direction"], FEATURES, "feature", "value") \
        .where(F.col("value").isNotNull())
