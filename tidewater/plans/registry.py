"""Query registry: every entry pairs a Spark plan with its SQL oracle.

The SQL text is written for DuckDB over the raw driver tables; the common
table expressions below rebuild the logical inputs of ``inputs.py`` the
same way (integer-cent sums, same IEEE operation order).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def register(name: str, sql: str | None = None, dbl: str = ""):
    """Register a query; ``dbl`` names its floating columns (rounded in SQL)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = rounded_sql(sql, dbl.split())
        return fn
    return deco


def half_up(c: str, digits: int = DIGITS) -> str:
    """Spark's ``round`` on doubles: HALF_UP on the shortest decimal repr."""
    return (f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) AND abs(CAST({c} AS DOUBLE)) < 1e19 "
            f"THEN CAST(round(CAST(CAST(CAST({c} AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE) "
            f"ELSE CAST({c} AS DOUBLE) END")


def rounded_sql(sql: str, doubles: list[str], digits: int = DIGITS) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"{half_up(c, digits)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column so results hash identically across engines."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------- SQL inputs
PANEL = """panel AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
         CAST((2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 1024.0 AS close,
         count(*) AS n_orders
  FROM orders GROUP BY 1, 2)"""

RETURNS = PANEL + """,
rp AS (
  SELECT *, close / lag(close, 1) OVER (PARTITION BY series_id ORDER BY date) - 1.0 AS ret FROM panel)"""

WEEKLY = """weekly AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS qty
  FROM lineitem GROUP BY 1)"""

MONTHLY = """monthly AS (
  SELECT month, level, CAST(month + INTERVAL 1 MONTH AS DATE) AS available_at FROM (
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
           CAST((2 * sum(CAST(round(o_totalprice * 100) AS BIGINT)) + count(*)) // (2 * count(*)) AS DOUBLE) / 1024.0 AS level
    FROM orders GROUP BY 1))"""

PREDICTIONS = """preds AS (
  SELECT 'synthetic' AS Experiment, m.Model,
         CASE WHEN CAST(o_orderdate AS DATE) < DATE '1999-01-01' THEN 'train'
              WHEN CAST(o_orderdate AS DATE) < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS Split,
         o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(o_orderstatus = 'F' AS INTEGER) AS target,
         CAST(((o_orderkey * m.mult) % 1009 + 1009) % 1009 AS DOUBLE) / 1008.0 AS proba_up
  FROM orders, (VALUES ('m1', 37), ('m2', 101), ('m3', 613)) AS m(Model, mult))"""

BACKTEST = RETURNS + """,
bt_in AS (
  SELECT * FROM (
    SELECT series_id, date,
           lead(date, 1) OVER w AS target_date,
           lag(ret, 1) OVER w AS predicted_return,
           lead(ret, 1) OVER w AS actual_return
    FROM rp WINDOW w AS (PARTITION BY series_id ORDER BY date))
  WHERE predicted_return IS NOT NULL AND actual_return IS NOT NULL)"""

FEATURES_SQL = RETURNS + """,
fm0 AS (
  SELECT series_id, date, ret,
         close / lag(close, 5) OVER w - 1.0 AS ret5,
         CASE WHEN count(ret) OVER w7 >= 7 THEN stddev_samp(ret) OVER w7 END AS vol7,
         CAST(n_orders AS DOUBLE) AS n_orders,
         CASE WHEN count(close) OVER w20 >= 20
              THEN (close - avg(close) OVER w20) / nullif(stddev_pop(close) OVER w20, 0) END AS close_z,
         lead(ret, 1) OVER w AS target_ret,
         lead(date, 1) OVER w AS target_date
  FROM rp
  WINDOW w AS (PARTITION BY series_id ORDER BY date),
         w7 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w20 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fm AS (
  SELECT *, CAST(target_ret > 0 AS INTEGER) AS direction,
         CASE WHEN target_date < DATE '1999-01-01' THEN 'train'
              WHEN target_date < DATE '2000-01-01' THEN 'val' ELSE 'test' END AS split
  FROM fm0 WHERE target_ret IS NOT NULL),
fl AS (
  SELECT series_id, date, split, direction, feature, value FROM (
    UNPIVOT fm ON ret, ret5, vol7, n_orders, close_z INTO NAME feature VALUE value)
  WHERE value IS NOT NULL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
