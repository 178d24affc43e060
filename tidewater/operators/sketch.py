"""Mergeable profiles (survey A03/A08/A10): quantile, distinct-count and frequent-value sketches.

A sketch is a small binary value per group: sketches of days, splits or files are
merged into the sketch of any range without reading rows again, and memory does not
grow with the distinct values of a feature.  Their errors are bounds, stated by the
functions; exact forms stand beside them.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.joins import join_null_safe

__all__ = ["value_sketches", "merge_sketches", "sketch_estimates", "rank_error", "distinct_error", "heavy_hitters", "most_frequent"]

#: Size of the quantile sketch, and log2 of the registers of the distinct-count sketch.
QUANTILE_K = 400
DISTINCT_BITS = 14


def rank_error(k: int = QUANTILE_K) -> float:
    """Error of a quantile's normalised rank, not exceeded with 99 % confidence, for a sketch of size ``k``
    (the published fit of the algorithm for single quantiles)."""
    return 2.296 / k ** 0.9021


def distinct_error(bits: int = DISTINCT_BITS) -> float:
    """Three standard errors of the distinct count, as a share of it."""
    return 3 * 1.04 / math.sqrt(1 << bits)


def value_sketches(df: DataFrame, by: Sequence[str], value: str, k: int = QUANTILE_K, bits: int = DISTINCT_BITS) -> DataFrame:
    """One row per group: ``count``, ``missing``, ``total``, ``low``, ``high`` and two sketches of the non-null values."""
    v = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count(v).alias("count"), F.count_if(v.isNull()).alias("missing"), F.sum(v).alias("total"), F.min(v).alias("low"),
        F.max(v).alias("high"), F.kll_sketch_agg_double(v, k).alias("quantiles"),
        F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), bits).alias("distinct"))


def merge_sketches(sketches: DataFrame, by: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """Sketches of a coarser grouping from those of a finer one."""
    return sketches.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("count", "missing", "total")], F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles", k).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def sketch_estimates(sketches: DataFrame, by: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``mean``, ``low``, ``high``, ``n_unique`` and one ``q``-column per share, e.g. ``q25`` (null for an empty group)."""
    some = F.col("count") > 0
    # the quantile sketch of an empty group has no quantile to ask for
    quantile = {f"q{round(100 * p)}": F.when(some, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))) for p in shares}
    return sketches.select(*by, "count", "missing", F.try_divide("total", "count").alias("mean"), "low", "high",
                           F.hll_sketch_estimate("distinct").alias("n_unique"), *[c.alias(n) for n, c in quantile.items()])


def heavy_hitters(df: DataFrame, by: Sequence[str], value: str, share: float = 0.01) -> DataFrame:
    """(group, value, count, share): every value that holds at least ``share`` of its group's non-null rows, with exact counts.

    A frequent-items sketch with enough entries that no such value can be missed names the candidates; a second
    pass counts only those.  Candidates are at most ``4 / share`` a group, so the table that is joined back is
    bounded by the groups."""
    by = list(by)
    entries = 1 << max(4, math.ceil(math.log2(8.0 / share)))  # the sketch's error is below 3.5 / entries of the rows
    d = df.where(F.col(value).isNotNull()).select(*by, value)
    top = d.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(`{value}`, {math.ceil(4 / share)}, {entries})").alias("top"))
    candidates = top.select(*by, "rows", F.explode("top.item").alias(value))
    counted = join_null_safe(d, candidates, [*by, value]).groupBy(*by, value).agg(F.count(F.lit(1)).alias("count"), F.first("rows").alias("rows"))
    part = F.col("count") / F.col("rows")
    return counted.where(part >= share).select(*by, value, "count", part.alias("share"))


def most_frequent(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(group, top_value, top_count, top_pct): the most frequent non-null value (the least of equal ones) and
    its share in percent, exactly: values are counted before groups meet, so no group is held by one task."""
    by = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy(*by).agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b"))
    return best.select(*by, F.col("b.v").alias("top_value"), (-F.col("b.n")).alias("top_count"), (-F.col("b.n") * 100.0 / F.col("rows")).alias("top_pct"))
