"""Mutual information of a continuous value and a class by nearest neighbours (survey T-08)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.joins import join_null_safe
from tidewater.operators.scan import running
from tidewater.operators.stats import value_bucket
from tidewater.session import cut_lineage

__all__ = ["digamma", "knn_mutual_information"]

EULER = 0.5772156649015329


def digamma(n: Column) -> Column:
    """The digamma function of a positive whole number: a harmonic sum below 12, its asymptotic series beyond."""
    x = n.cast("double")
    small = F.array(*[F.lit(sum(1.0 / j for j in range(1, m)) - EULER) for m in range(1, 12)])
    y = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - y * (1.0 / 12 - y * (1.0 / 120 - y * (1.0 / 252 - y * (1.0 / 240 - y / 132.0))))
    return F.when(n < 12, F.get(small, (n - 1).cast("int"))).otherwise(series)


def _nearest(rows: DataFrame, keys: list[str], value: str, ids: Sequence[str], k: int) -> DataFrame:
    """Adds ``before`` and ``after``: up to k values on either side in the order (value, ids) within the keys, nearest
    first.  Two scans in buckets of the value; borders carry k values."""
    order, vb = [value, *ids], F.col("__vb")
    rows = value_bucket(rows, keys, value)
    rows = running(rows, {"before": ("before", value, k)}, keys, order, bucket=vb)
    return running(rows, {"after": ("before", value, k)}, keys, order, bucket=vb, descending=True).drop("__vb")


def knn_mutual_information(long: DataFrame, group: Sequence[str], value: str, label: str, ids: Sequence[str],
                           k: int = 5) -> DataFrame:
    """T-08: (group, n, MI) in nats, by the estimator of Ross (2014) without added noise.

    For each row the distance d to its k-th neighbour of the same class (fewer in small classes) is found,
    then m, the rows of any class nearer than d (itself included; at its very value where d is 0).
    MI = psi(N) + mean psi(k) - mean psi(class size) - mean psi(m), not below 0.  Null values and labels and
    classes of one row are left out; ``ids`` make rows distinct.  Neighbours come from scans over value buckets
    and m from running counts at the borders of each row's interval, so no group or class is sorted in one task."""
    group, ids = list(group), list(ids)
    rows = long.where(F.col(value).isNotNull() & F.col(label).isNotNull()).select(*group, *ids, label, F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy(*group, label).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = cut_lineage(join_null_safe(rows, sizes, [*group, label]))  # read by the cuts and by the scans
    near = _nearest(rows, [*group, label], "v", ids, k).withColumn("k", F.least(F.lit(k), F.col("size") - 1).cast("int"))
    v = F.col("v")
    gaps = F.concat(F.transform("before", lambda x: v - x), F.transform("after", lambda x: x - v))
    d = F.get(F.sort_array(F.filter(gaps, lambda x: x.isNotNull())), F.col("k") - 1)
    near = near.withColumn("d", d)
    # the neighbour at distance d bounds its side by its own value; the other side by v -+ d
    left = F.coalesce(F.get(F.filter("before", lambda x: v - x == F.col("d")), F.lit(0)), v - F.col("d"))
    right = F.coalesce(F.get(F.filter("after", lambda x: x - v == F.col("d")), F.lit(0)), v + F.col("d"))
    near = cut_lineage(near.select(*group, label, *ids, "v", "k", "size", "d", left.alias("lo"), right.alias("hi")))
    values = near.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    # counts below hi (asked before equal values) and up to lo (asked after them); with d = 0 the row's own value counts
    zero = F.col("d") == 0
    ask = F.explode(F.array(F.struct(F.when(zero, F.col("lo")).otherwise(F.col("hi")).alias("x"), F.when(zero, 2).otherwise(0).alias("at"), F.lit(1).alias("sign")),
                            F.struct(F.col("lo").alias("x"), F.when(zero, 0).otherwise(2).alias("at"), F.lit(-1).alias("sign"))))
    asked = near.select(*group, label, *ids, "k", "size", ask.alias("a")).select(*group, label, *ids, "k", "size", "a.x", "a.at", "a.sign", F.lit(0).cast("long").alias("n"))
    known = values.select(*group, F.lit(None).cast(near.schema[label].dataType).alias(label),
                          *[F.lit(None).cast(near.schema[c].dataType).alias(c) for c in ids], F.lit(None).cast("int").alias("k"),
                          F.lit(None).cast("long").alias("size"), F.col("v").alias("x"), F.lit(1).alias("at"), F.lit(0).alias("sign"), "n")
    both = cut_lineage(value_bucket(asked.unionByName(known), group, "x"))
    counted = running(both, {"upto": ("sum", "n")}, group, ["x", "at"], bucket=F.col("__vb")).where("sign <> 0")
    m = counted.groupBy(*group, label, *ids, "k", "size").agg(F.sum(F.col("upto") * F.col("sign")).alias("m"))
    out = m.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(digamma(F.col("k")) - digamma(F.col("size")) - digamma(F.col("m"))).alias("mean"))
    return out.select(*group, "n", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("mean")).alias("MI"))
