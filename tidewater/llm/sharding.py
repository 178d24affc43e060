"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table

#: Rows that a bucket of a rank aims at, and the most buckets (as a power of two); they place work only.
ROWS_PER_BUCKET = 2_000
MOST_BITS = 16
SEED = 20260


def _numbered(rows: DataFrame, group: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """Adds ``n`` (rows of the group) and ``rank`` (1, 2, ... within the group in ``order``), where
    ``bucket`` rises with ``order``: ranks are taken inside buckets and shifted by the counts
    of the buckets before, so that no group is sorted in one task."""
    sizes = rows.groupBy(*group, bucket).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
             .withColumn("n", F.sum("__rows").over(Window.partitionBy(*group))).drop("__rows"))
    here = Window.partitionBy(*group, bucket).orderBy(*order)
    ranked = rows.withColumn("__rank", F.row_number().over(here))
    return (ranked.join(sizes, [*group, bucket])
            .withColumn("rank", F.col("__before") + F.col("__rank")).drop("__before", "__rank"))


def stratified_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                      source_col: str = "source", seed: int = SEED, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per input row: id, ``stratum`` source, ``size`` (UTF-8 bytes plus 1), ``text_crc32``,
    ``shard`` and ``slot`` (0, 1, ... within the shard).

    Rows of a source are shuffled by a seeded hash; rank r of n becomes the fraction (r - 1/2) / n;
    all rows sorted by fraction are cut into ``n_shards`` runs whose lengths differ by at most one.
    Each run then holds every source in its share of the whole, to within one or two rows.

    Null texts have size 1 and checksum 0; a null source is a source of its own; null ids are
    ordered first; ties (repeated rows) are ordered by size and checksum, and rows equal in all of
    these are interchangeable.  With fewer rows than shards the last shards are empty; an empty table
    gives an empty result.  Other columns are ignored.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = shared_table(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("stratum"), F.col(source_col).isNull().alias("none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("crc")), "shard-rows")
    total = rows.count()
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(1, total) / rows_per_bucket))))
    # hash order; the top bits of the hash, read as unsigned, are its bucket
    mix = F.xxhash64(F.lit(seed), F.col("id"), F.col("crc"))
    rows = rows.withColumn("mix", mix).withColumn(
        "bucket", F.shiftright("mix", 64 - bits) if bits else F.lit(0).cast("long"))
    ranked = _numbered(rows, ["none", "source"], "bucket",
                       [F.col("mix"), F.col("id"), F.col("size"), F.col("crc")]).drop("mix", "bucket")
    spread = shared_table(
        ranked.withColumn("fraction", (F.col("rank") - F.lit(0.5)) / F.col("n"))
        .withColumn("bucket", F.floor(F.col("fraction") * (1 << bits))).drop("rank", "n"), "shard-ranks")
    placed = _numbered(spread.withColumn("all", F.lit(0)), ["all"], "bucket",
                       [F.col("fraction"), F.col("none"), F.col("source")])
    return (placed.withColumn("shard", F.expr(f"(rank - 1) * {n_shards} div n").cast("int"))
            # shard s starts at the least position whose quotient is s: ceil(s * n / shards)
            .withColumn("slot", F.expr(f"(rank - 1) - (shard * n + {n_shards - 1}) div {n_shards}").cast("long"))
            .select(F.col("id").alias(id_col), "stratum", "size", F.col("crc").alias("text_crc32"), "shard", "slot"))
