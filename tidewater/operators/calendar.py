"""Calendars, gap handling, fills and as-of joins (survey F01-F12, J02-J06).

Design notes for scale
----------------------
* Calendars are generated per series with ``sequence`` + ``explode``; the
  row count per series is bounded by the date span, not by data volume.
* The as-of join never sorts a whole series in one task: both sides are
  split into (key, time-bucket) partitions and a small bucket-level table
  carries the last right value across bucket borders (a two-level scan).
  A hot key is therefore spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import col_of
from tidewater.operators.scan import running

__all__ = [
    "business_days", "series_calendar", "align_to_calendar", "ffill", "imputed_flags",
    "roll_to_trading_day", "monthly_first", "asof_join", "release_asof", "time_bucket", "fill_constant",
]


def _as_list(x) -> list:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def business_days(spark, start: str, end: str, holidays: DataFrame | None = None,
                  col: str = "date") -> DataFrame:
    """Mon–Fri calendar between two dates, optional holiday anti-join."""
    cal = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)),
                             F.expr("interval 1 day"))).alias(col)
    ).where(F.weekday(col) < 5)
    if holidays is not None:
        cal = cal.join(holidays.select(F.col(holidays.columns[0]).cast("date").alias(col)), col, "left_anti")
    return cal


def series_calendar(df: DataFrame, keys="series_id", date: str = "date",
                    business_only: bool = True) -> DataFrame:
    """Per-series calendar from each series' first to last date."""
    keys = _as_list(keys)
    bounds = df.groupBy(*keys).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    cal = bounds.select(*keys, F.explode(F.sequence("__lo", "__hi", F.expr("interval 1 day"))).alias(date))
    if business_only:
        cal = cal.where(F.weekday(date) < 5)
    return cal


def align_to_calendar(df: DataFrame, keys="series_id", date: str = "date",
                      calendar: DataFrame | None = None, flag_col: str | None = "is_gap") -> DataFrame:
    """Every calendar day survives; rows outside it are dropped.

    With ``calendar=None`` each series gets its own business-day calendar
    between its first and last date.  Gaps get NULL values and
    ``flag_col = 1``.
    """
    keys = _as_list(keys)
    if calendar is None:
        calendar = series_calendar(df, keys, date)
    marked = df.withColumn("__present", F.lit(1))
    out = calendar.join(marked, keys + [date], "left")
    if flag_col:
        out = out.withColumn(flag_col, F.when(F.col("__present").isNull(), 1).otherwise(0))
    return out.drop("__present")


def imputed_flags(df: DataFrame, cols: Iterable[str], suffix: str = "_imputed") -> DataFrame:
    """1 where the value was missing before filling."""
    return df.withColumns({f"{c}{suffix}": F.col(c).isNull().cast("int") for c in cols})


def ffill(df: DataFrame, cols: Iterable[str], keys="series_id", order: str = "date",
          limit: int | None = None, exclude: Iterable[str] = ()) -> DataFrame:
    """forward fill per series, optionally only ``limit`` rows deep.

    ``last(x, ignorenulls)`` over ``ROWS BETWEEN limit PRECEDING AND CURRENT
    ROW`` fills a NULL run for its first ``limit`` rows only, exactly like
    pandas ``ffill(limit=k)``.  Without a limit the last value is carried by
    a two-level scan, so a long series is no single sort.
    """
    keys = _as_list(keys)
    ex = set(exclude)
    if limit is None:
        return running(df, {c: ("last", c) for c in cols if c not in ex}, keys, order)
    w = Window.partitionBy(*keys).orderBy(order)
    frame = w.rowsBetween(-int(limit), 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in cols if c not in ex})


def fill_constant(df: DataFrame, cols: Iterable[str], value=0) -> DataFrame:
    """constant fill of sparse counts."""
    return df.fillna({c: value for c in cols})


def roll_to_trading_day(d, friday_is_trading: bool = False) -> Column:
    """move a non-trading day forward to the next Monday.

    Reference behaviour (default): Friday +3, Saturday +2, Sunday +1.
    ``friday_is_trading=True`` keeps Friday (the correct Mon–Fri calendar).
    """
    d = col_of(d)
    wd = F.weekday(d)
    shift = (F.when(wd == 5, 2).when(wd == 6, 1)
             .when((wd == 4) & F.lit(not friday_is_trading), 3).otherwise(0))
    return F.date_add(d, shift)


def monthly_first(df: DataFrame, value_cols: Sequence[str], keys="series_id",
                  date: str = "date", out_date: str = "month") -> DataFrame:
    """monthly resample keeping the first non-null value per month."""
    keys = _as_list(keys)
    aggs = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in value_cols]
    return df.groupBy(*keys, F.trunc(date, "MM").alias(out_date)).agg(*aggs)


def time_bucket(t, bucket) -> Column:
    """Coarse monotone bucket of a date column, used to split ordered scans.

    ``bucket`` is ``"week"``, ``"month"``, ``"quarter"``, ``"year"`` or a
    number of days.
    """
    t = col_of(t).cast("date")
    if isinstance(bucket, int):
        return F.floor(F.datediff(t, F.lit("1970-01-01").cast("date")) / F.lit(bucket)).cast("long")
    fmt = {"week": "week", "month": "MM", "quarter": "quarter", "year": "year"}[bucket]
    return F.trunc(t, fmt)


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str,
              values: Sequence[str], by: Sequence[str] = (), tolerance_days: int | None = None,
              bucket="month", matched_col: str | None = "matched_date") -> DataFrame:
    """Backward as-of join (latest right row with time <= left time).

    ``values`` from the right side are attached to every left row.  The
    match carries the whole right row as a struct, so a legitimately NULL
    right value is not skipped over.  Ties on the right time resolve to the
    greatest right payload (deterministic).  ``tolerance_days`` nulls the
    match when the left time is more than that many days after it.  Right
    rows without a time never match; left rows without one get a NULL match.

    Execution: left and right rows are unioned and scanned inside
    (by, bucket) partitions; a bucket-level table (one row per key and
    bucket, independent of row volume) provides the value carried in from
    earlier buckets.
    """
    by = list(by)
    payload_cols = [F.col(right_on).alias("__mt")] + [F.col(v).alias(v) for v in values]
    r = right.where(F.col(right_on).isNotNull()).select(
        *[F.col(k) for k in by], F.col(right_on).alias("__t"), F.struct(*payload_cols).alias("__r"))
    r = r.withColumn("__b", time_bucket("__t", bucket))

    lcols = left.columns
    l = left.withColumn("__t", F.col(left_on)).withColumn("__b", time_bucket("__t", bucket))

    # bucket-level carry: last right row of every earlier bucket
    rb = r.groupBy(*by, "__b").agg(F.max(F.struct("__t", "__r")).getField("__r").alias("__last"))
    lb = l.select(*by, "__b").distinct()
    kinds = (lb.withColumn("__k", F.lit(0)).withColumn("__last", F.lit(None).cast(rb.schema["__last"].dataType))
             .unionByName(rb.withColumn("__k", F.lit(1))))
    wb = (Window.partitionBy(*by).orderBy("__b", "__k") if by else Window.orderBy("__b", "__k"))
    carry = (kinds.withColumn("__r", F.last("__last", ignorenulls=True).over(
        wb.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("__k") == 0).where(F.col("__r").isNotNull())
        .select(*by, "__b", "__r", F.lit(-1).alias("__side")))

    rows = (l.withColumn("__side", F.lit(1))
            .unionByName(r.withColumn("__side", F.lit(0)), allowMissingColumns=True)
            .unionByName(carry, allowMissingColumns=True))
    # carry rows first, then by time; at equal time right rows precede left rows
    w = Window.partitionBy(*by, "__b").orderBy(
        (F.col("__side") != -1).cast("int"), "__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where(F.col("__side") == 1)
    m = F.when(F.col("__t").isNotNull(), F.col("__m"))
    rows = rows.withColumn("__m", m)
    if tolerance_days is not None:
        m = F.when(F.datediff(F.col("__t").cast("date"), F.col("__m.__mt").cast("date")) <= tolerance_days, m)
    rows = rows.withColumn("__m", m)
    out_cols = [F.col(c) for c in lcols] + [F.col("__m").getField(v).alias(v) for v in values]
    if matched_col:
        out_cols.append(F.col("__m.__mt").alias(matched_col))
    return rows.select(*out_cols)


def release_asof(left: DataFrame, releases: DataFrame, left_on: str, released: str, period: str, values: Sequence[str],
                 by: Sequence[str] = (), matched_period: str = "period", matched_release: str = "released_at") -> DataFrame:
    """What a release calendar showed at each left time: of all periods released by then the latest one, in the
    latest of its revisions released by then.

    A revision of an old period, or its late first release, does not hide a newer period.  That is the running maximum
    of (period, release) over the releases in order of their time, so one two-level scan over the union of both sides
    finds it, and neither a key nor a long history is sorted in one task.  A release on the left row's own time counts.
    Releases without a period or time are left out; several rows of one (period, release) must agree.
    """
    by = list(by)
    known = F.struct(F.col(period).alias("p"), F.col(released).alias("r"), F.struct(*[F.col(v) for v in values]).alias("v"))
    right = releases.where(F.col(released).isNotNull() & F.col(period).isNotNull()).select(
        *by, F.col(released).alias("__t"), F.lit(0).alias("__side"), known.alias("__known"), F.lit(None).cast(left.schema).alias("__row"))
    kind = right.schema["__known"].dataType
    rows = left.select(*by, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__known"),
                       F.struct(*left.columns).alias("__row"))
    scanned = running(right.unionByName(rows), {"__seen": ("max", "__known")}, by, ["__t", "__side"]).where(F.col("__side") == 1)
    return scanned.select("__row.*", F.col("__seen.p").alias(matched_period), F.col("__seen.r").alias(matched_release), "__seen.v.*")
