"""Ordered scans that do not sort a whole series in one task (survey §7.4).

``ewm_mean`` evaluates the recurrence ``y_t = a*x_t + (1-a)*y_{t-1}``
(``adjust=False``, ``y_0 = x_0``) as a two-level scan:

1. rows are split into (key, time-bucket) partitions; inside a bucket the
   zero-start response ``B_t = sum_i a(1-a)^(k_t-k_i) x_i`` is a plain
   running window sum (exponents stay within one bucket);
2. one row per bucket (``(1-a)^n_b``, ``B_last``) forms a small table —
   its size depends on the time span, not on the row volume — which is
   folded per key with ``aggregate`` into the state entering every bucket;
3. the state is joined back: ``y_t = (1-a)^(k_t+1) S_b + B_t``.

``prefix_sum`` applies the same idea to running sums over any monotone
bucket expression (used for global ranks and ECDFs), ``running`` to any
associative scan (sum, product, running extremes, last non-null value, row
number, lag) with buckets that follow the rows of each key.

The scans read their partitioned input twice (summary and join back).
Nothing is persisted: equal exchanges are reused by the planner, and callers
reduce their input (histograms, daily panels) before a scan.
"""

from __future__ import annotations

import math
import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.joins import join_null_safe

__all__ = ["ewm_mean", "prefix_sum", "running", "volume_bucket", "alpha_from_span"]

#: Rows of a key that one task scans at most (about), where buckets follow the rows.
ROWS_PER_BUCKET = 100_000


def alpha_from_span(span: float) -> float:
    return 2.0 / (span + 1.0)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def ewm_mean(df: DataFrame, x: str, out, alpha: float | None = None, keys="series_id", order: str = "date",
             bucket="month") -> DataFrame:
    """Exponentially weighted means with ``adjust=False``.

    ``out`` is a column name (with ``alpha``) or a dict ``{out: alpha}``: all
    smoothings of the same input share one scan (one sort, one summary, one
    fold).  Rows with NULL ``x`` get NULL and do not advance the recursion
    (pandas ``ignore_na=True``).  A time bucket is cut further into runs of so
    many rows that ``(1-alpha)^-rows`` stays finite, so series of any density
    give finite results.
    """
    from tidewater.operators.calendar import time_bucket
    keys = _keys(keys)
    specs = dict(out) if isinstance(out, dict) else {out: alpha}
    direct = {o: a for o, a in specs.items() if a >= 1.0}
    specs = {o: float(a) for o, a in specs.items() if a < 1.0}
    d = df.withColumns({o: F.col(x).cast("double") for o in direct})
    if not specs:
        return d
    names = list(specs)
    base = d.withColumn("__b", time_bucket(order, bucket)).withColumn("__ok", F.col(x).isNotNull())
    wb = Window.partitionBy(*keys, "__b", "__ok").orderBy(order)
    # rows of a run: the largest power of the steepest smoothing stays below 1e120
    run = max(1, int(120 * math.log(10) / -math.log(1.0 - max(specs.values()))))
    base = base.withColumn("__row", F.row_number().over(wb) - 1)
    base = base.withColumns({"__b": F.struct(F.col("__b").alias("t"), F.floor(F.col("__row") / run).alias("r")),
                             "__k": F.when(F.col("__ok"), F.col("__row") % run)}).drop("__row")
    wrun = Window.partitionBy(*keys, "__b", "__ok").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # zero-start response inside the bucket, one per smoothing
    base = base.withColumns({
        f"__resp{i}": F.when(F.col("__ok"), F.pow(F.lit(1.0 - a), F.col("__k")) *
                             F.sum(F.lit(a) * F.col(x) * F.pow(F.lit(1.0 - a), -F.col("__k"))).over(wrun))
        for i, a in enumerate(specs.values())})
    ok = base.where("__ok")
    last = F.max(F.struct("__k", *[F.col(f"__resp{i}").alias(f"r{i}") for i in range(len(names))]))
    summ = ok.groupBy(*keys, "__b").agg(
        F.count(F.lit(1)).alias("__n"), last.alias("__rlast"),
        F.min(F.struct(F.col(order), F.col(x).cast("double").alias("__x"))).alias("__first"))
    # fold per key over its time-ordered bucket summaries (size ~ time span / bucket)
    arr = summ.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col("__b"), F.col("__n"), F.col("__rlast"), F.col("__first")))).alias("__summ"))
    btype = summ.schema["__b"].dataType.simpleString()
    sfields = ",".join(f"s{i}:double" for i in range(len(names)))
    init = F.struct(*[F.lit(None).cast("double").alias(f"s{i}") for i in range(len(names))],
                    F.array().cast(f"array<struct<b:{btype},{sfields}>>").alias("acc"))

    def step(st, e):
        s_in = [F.coalesce(st[f"s{i}"], e["__first"]["__x"]) for i in range(len(names))]
        nxt = [(F.pow(F.lit(1.0 - a), e["__n"]) * s_in[i] + e["__rlast"][f"r{i}"]).alias(f"s{i}")
               for i, a in enumerate(specs.values())]
        entry = F.struct(e["__b"].alias("b"), *[s_in[i].alias(f"s{i}") for i in range(len(names))])
        return F.struct(*nxt, F.array_append(st["acc"], entry).alias("acc"))

    states = arr.select(*keys, F.explode(F.aggregate("__summ", init, step)["acc"]).alias("__st")) \
        .select(*keys, F.col("__st.b").alias("__b"),
                *[F.col(f"__st.s{i}").alias(f"__state{i}") for i in range(len(names))])
    res = join_null_safe(base, states, [*keys, "__b"], "left")
    res = res.withColumns({
        o: F.when(F.col("__ok"), F.pow(F.lit(1.0 - a), F.col("__k") + 1) * F.col(f"__state{i}") + F.col(f"__resp{i}"))
        for i, (o, a) in enumerate(specs.items())})
    return res.drop("__b", "__ok", "__k", *[f"__resp{i}" for i in range(len(names))],
                    *[f"__state{i}" for i in range(len(names))])


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
               sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Running sums ``sums = {out: col}`` per ``keys`` in ``order``.

    ``bucket`` must be monotone in ``order``.  Inside each (keys, bucket)
    partition a window computes the local running sum; the totals of all
    earlier buckets come from a bucket-level table (one row per key and
    bucket) scanned with a window that only holds bucket rows.
    """
    keys = list(keys)
    d = df.withColumn("__pb", bucket)
    wl = Window.partitionBy(*keys, "__pb").orderBy(*order)
    frame = wl.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    for o, c in sums.items():
        d = d.withColumn(f"__loc_{o}", F.coalesce(F.sum(c).over(frame), F.lit(0)))
    tot = d.groupBy(*keys, "__pb").agg(*[F.sum(c).alias(f"__tot_{o}") for o, c in sums.items()])
    wt = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("__pb") \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = tot.select(*keys, "__pb", *[F.coalesce(F.sum(f"__tot_{o}").over(wt), F.lit(0)).alias(f"__car_{o}")
                                        for o in sums])
    d = join_null_safe(d, carry, [*keys, "__pb"], "left")
    for o in sums:
        d = d.withColumn(o, F.col(f"__car_{o}") + F.col(f"__loc_{o}"))
    return d.drop("__pb", *[f"__loc_{o}" for o in sums], *[f"__car_{o}" for o in sums])


def monotone(df: DataFrame, col: str) -> Column:
    """A number that rises with a date, timestamp or numeric column."""
    kind = df.schema[col].dataType.typeName()
    c = F.col(col)
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "timestamp_ntz":  # by its fields: no time zone, so no repeated hours
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date"))
        return days * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return c.cast("double")


def volume_bucket(df: DataFrame, keys: Sequence[str], order: str, rows: int = ROWS_PER_BUCKET, out: str = "__b",
                  count: str | None = None) -> DataFrame:
    """Adds ``out``: buckets of the order column, rising with it, of about ``rows`` rows in every key.

    Only keys with more than ``rows`` rows are cut (into equal stretches of the order column), so the joined
    table has at most one row per ``rows`` input rows; all rows of another key are bucket 0, those
    without an order value bucket -1.  With ``count`` the rows of each key are added under that name, and the joined
    table has a row per key."""
    x, keys = monotone(df, order), _keys(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    d = join_null_safe(df, sizes if count else sizes.where(F.col("__n") > rows), keys, "left")
    parts = F.ceil(F.col("__n") / rows)
    part = F.floor(F.try_divide(x - F.col("__lo"), F.col("__hi") - F.col("__lo")) * parts)
    bucket = F.when(x.isNull(), F.lit(-1)).when(F.col("__n").isNull() | (F.col("__n") <= rows), F.lit(0)).otherwise(
        F.coalesce(F.least(part, parts - 1), F.lit(0)))
    d = d.withColumn(out, bucket.cast("long"))
    return (d.withColumn(count, F.col("__n")) if count else d).drop("__lo", "__hi", "__n")


#: kind -> (local aggregate over the rows so far, aggregate of a bucket, how the buckets before and the bucket combine)
_MONOIDS = {
    "sum": (F.sum, F.sum, lambda before, here: F.coalesce(before + here, here, before)),
    "count": (F.count, F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here),
    "product": (F.product, F.product, lambda before, here: F.coalesce(before * here, here, before)),
    "max": (F.max, F.max, lambda before, here: F.greatest(before, here)),
    "min": (F.min, F.min, lambda before, here: F.least(before, here)),
}


def running(df: DataFrame, specs: dict[str, tuple], keys="series_id", order="date", bucket=None,
            descending: bool = False, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Associative scans of a series that no task has to sort as a whole.

    ``specs`` names the outputs: ``(kind, column)`` with kind sum, count, product, max, min or last (the last
    non-null value so far, this row included), ``("row",)`` for the row number from 1, ``("lag", column, k, default)`` for the value
    k rows before and ``("before", column, k)`` for the array of up to k values before, the nearest first.  Rows are scanned inside (keys, bucket); one row per bucket carries the result of the
    buckets before.  ``bucket`` is a column that never falls along ``order``; without it buckets hold about
    ``rows`` rows.  All outputs share one sort.  The carrying window sees one row per bucket only.
    ``descending`` scans from the end.  Null keys are a series; nulls of the first order column come first (last when descending).
    """
    keys, order = _keys(keys), _keys(order)
    taken = [c for c in specs if c in df.columns]
    d = df.withColumn("__b", bucket) if bucket is not None else volume_bucket(df, keys, order[0], rows)
    # inputs by number: an output may have the name of a column that it reads
    value = lambda s: F.col(s[1]) if isinstance(s[1], str) else s[1]
    names = list(specs)
    d = d.withColumns({f"__x{i}": value(specs[o]) for i, o in enumerate(names) if specs[o][0] != "row"})
    by = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    w = Window.partitionBy(*keys, "__b").orderBy(*by)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    local, total = {}, []
    if any(specs[o][0] in ("lag", "before") for o in names):
        back = [F.col(c).asc() if descending else F.col(c).desc() for c in order]
        local = {"__p0": F.row_number().over(w), "__e0": F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*back))}
    for i, o in enumerate(names):
        kind, x = specs[o][0], F.col(f"__x{i}")
        if kind == "row":
            local[f"__l{i}"] = F.row_number().over(w).cast("long")
            total.append(F.count(F.lit(1)).alias(f"__t{i}"))
        elif kind == "last":
            local[f"__l{i}"] = F.last(x, ignorenulls=True).over(so_far)
            at = F.struct(*[F.col(c) for c in order], x.alias("__v"))
            total.append((F.min if descending else F.max)(F.when(x.isNotNull(), at))["__v"].alias(f"__t{i}"))
        elif kind in ("lag", "before"):
            k, cell = specs[o][2], F.struct(x.alias("v"))
            local[f"__l{i}"] = F.lag(cell, k).over(w) if kind == "lag" else F.collect_list(cell).over(w.rowsBetween(-k, -1))
            # the last k rows of a bucket, first to last
            tail = F.sort_array(F.collect_list(F.when(F.col("__e0") <= k, F.struct((-F.col("__e0")).alias("e"), x.alias("v")))))
            total.append(tail.alias(f"__t{i}"))
        else:
            local[f"__l{i}"] = _MONOIDS[kind][0](x).over(so_far)
            total.append((F.count(x) if kind == "count" else _MONOIDS[kind][1](x)).alias(f"__t{i}"))
    d = d.withColumns(local)
    next_bucket = F.col("__b").desc() if descending else F.col("__b").asc()
    of_key = Window.partitionBy(*keys).orderBy(next_bucket)  # one row per bucket
    before = of_key.rowsBetween(Window.unboundedPreceding, -1)
    carry = []
    for i, o in enumerate(names):
        kind, t = specs[o][0], F.col(f"__t{i}")
        if kind == "last":
            carry.append(F.last(t, ignorenulls=True).over(before))
        elif kind in ("lag", "before"):  # each bucket has a row at least, so the k rows before lie in the k buckets before
            carry.append(F.flatten(F.collect_list(t).over(of_key.rowsBetween(-specs[o][2], -1))))
        else:
            carry.append((F.sum if kind == "row" else _MONOIDS[kind][1])(t).over(before))
    carry = [c.alias(f"__c{i}") for i, c in enumerate(carry)]
    states = d.groupBy(*keys, "__b").agg(*total).select(*keys, "__b", *carry)
    d = join_null_safe(d, states, [*keys, "__b"], "left")
    out = {}
    for i, o in enumerate(names):
        kind, here, prior = specs[o][0], F.col(f"__l{i}"), F.col(f"__c{i}")
        if kind == "row":
            out[o] = F.coalesce(prior, F.lit(0)) + here
        elif kind == "last":
            out[o] = F.coalesce(here, prior)
        elif kind == "lag":
            _, _, k, *default = specs[o]
            at = F.size(prior) - k + F.col("__p0")  # from 1, in the tail of the rows before
            far = F.when(at >= 1, F.get(prior, at - 1)["v"]).otherwise(F.lit(default[0] if default else None))
            out[o] = F.when(F.col("__p0") > k, here["v"]).otherwise(far)
        elif kind == "before":
            value_of = lambda a: F.transform(a, lambda c: c["v"])
            out[o] = F.slice(F.reverse(F.concat(value_of(prior), value_of(here))), 1, specs[o][2])
        else:
            out[o] = _MONOIDS[kind][2](prior, here)
    d = d.withColumns({f"__o{i}": out[o] for i, o in enumerate(names)})
    scratch = re.compile(r"__(b|[xlpectx]\d+)$")
    kept = [c for c in d.columns if not scratch.match(c) and c not in taken and not re.match(r"__o\d+$", c)]
    columns = [c for c in df.columns if c in kept or c in taken]
    return d.select(*[F.col(f"__o{names.index(c)}").alias(c) if c in taken else F.col(c) for c in columns],
                    *[F.col(f"__o{i}").alias(o) for i, o in enumerate(names) if o not in taken])
