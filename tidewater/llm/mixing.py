"""Mixing sources to target weights by exact block quotas, in DataFrame operations only.

Each source is read in a seeded random order, once or (up to ``most`` times) again, until its target is met; that
stretch is cut into blocks of equal width.  A splitting tree divides the source quotas (in blocks) among the output
shards: at each node a random half of the tickets goes left, so a child's quotas are a multivariate hypergeometric
draw.  Each source's blocks are then permuted and handed out disjointly by these quotas, and rows
are shuffled inside their shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20261
#: Blocks over all sources (one a source besides); rows that a bucket of a running sum aims at.
BLOCKS = 16_384
ROWS_PER_BUCKET = 2_000
MOST_DIGITS = 5


def _key(*parts) -> Column:
    """Seeded hash of values, as 32 hex digits in random order."""
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def _running(rows: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before, within the group in ``order``, where ``bucket`` rises
    with it.  Sums are taken inside buckets and shifted by the buckets before, so no group is sorted in one task."""
    here = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.groupBy(*group, bucket).agg(F.sum(value).alias("__sum"))
             .select(*group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before")))
    inside = rows.withColumn("__inside", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return inside.join(carry, [*group, bucket]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3) -> DataFrame:
    """Adds ``target`` to (none, source, source_size): sources in code-point order, null last, take the weights in turn and share
    ``share`` of all sizes by weight; a target stops at ``most`` times its source, and the excess is shared again
    by weight.  Sources are filled in the order in which they meet their limit, so one running sum over
    the table of sources (a row each) finds those that do."""
    place = F.row_number().over(Window.orderBy("none", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)) + 1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = (sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
            .withColumn("whole", F.sum("source_size").over(everything) * F.lit(float(share))))
    by_fill = Window.orderBy(F.col("limit") / F.col("weight"), "none", "source")
    ahead = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (rows.withColumn("turn", F.row_number().over(by_fill))
            .withColumn("level", (F.col("whole") - F.coalesce(F.sum("limit").over(ahead), F.lit(0.0))) / F.sum("weight").over(onward))
            .withColumn("free", F.when(F.col("limit") > F.col("weight") * F.col("level"), F.col("turn"))))
    first = F.min(F.struct(F.coalesce("free", F.lit(1 << 30)).alias("turn"), "level")).over(everything)
    return (rows.withColumn("first", first)
            .withColumn("target", F.when(F.col("turn") < F.col("first.turn"), F.col("limit"))
                        .otherwise(F.least("limit", F.col("weight") * F.col("first.level"))))
            .select("none", "source", "source_size", "whole", "target"))


def split_tree(tickets: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """Adds ``shard`` to tickets (one a block): every node of the tree halves its shards and sends a random part of its
    tickets, in proportion, to the left half."""
    rows = tickets.withColumn("low", F.lit(0)).withColumn("high", F.lit(n_shards))
    for level in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        node = Window.partitionBy("low", "high")
        half = F.expr("(low + high) div 2")
        quota = F.expr("(2 * n * (mid - low) + (high - low)) div (2 * (high - low))")  # to the nearest ticket
        rows = (rows.withColumn("n", F.count(F.lit(1)).over(node)).withColumn("mid", half.cast("int"))
                .withColumn("place", F.row_number().over(node.orderBy(_key(seed, "tree", level, F.col("none"), F.col("source"), F.col("block")),
                                                                      "none", "source", "block")))
                .withColumn("left", (F.col("mid") > F.col("low")) & (F.col("place") <= quota))
                .withColumn("stays", F.col("mid") == F.col("low"))
                .select("none", "source", "block",
                        F.when(F.col("left") | F.col("stays"), F.col("low")).otherwise(F.col("mid")).alias("low"),
                        F.when(F.col("left"), F.col("mid")).otherwise(F.col("high")).alias("high")))
    return rows.select("none", "source", "block", F.col("low").alias("shard"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, n_shards: int = 8,
        blocks: int = BLOCKS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document and pass (at least one): ``row`` (a number for each input row), id, source, ``size`` in words,
    ``source_size``, ``target``, ``pass`` (0, 1, ...), and for those drawn ``block`` of the source, ``shard``
    and ``slot`` (0, 1, ... within the shard); the others have nulls there.

    A document is drawn in a pass where the middle of its words lies before the target, so a source's words differ from
    its target by at most half its largest document, and no document is drawn more than ``most`` times.
    A null text has size 0; a null source is one of its own; null ids are seeded as empty text; rows of
    equal id and size are interchangeable; a source without words has target 0 and nothing drawn; an empty table gives
    an empty result.  Other columns are ignored.
    """
    rows = shared_table(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).isNull().alias("none"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size")), "mix-rows")
    total = rows.count()
    digits = min(MOST_DIGITS, max(0, math.ceil(math.log(max(1, total) / rows_per_bucket, 16))))
    bucket = (lambda key: F.substring(key, 1, digits)) if digits else (lambda key: F.lit(""))
    sizes = rows.groupBy("none", "source").agg(F.sum("size").alias("source_size"))
    quota = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(F.col("target") / F.col("whole") * blocks).cast("int"))).otherwise(0)
    sources = shared_table(targets(sizes, weights, share, most).withColumn("quota", quota), "mix-sources")

    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1))
    passes = F.when(F.col("target") > 0, passes).otherwise(F.array(F.lit(0)))
    # one row a pass; the hash order of a pass is its own
    copies = (rows.join(sources, ["none", "source"]).withColumn("pass", F.explode(passes))
              .withColumn("key", _key(seed, F.col("pass"), F.col("id"))).withColumn("bucket", bucket(F.col("key"))))
    placed = _running(copies, ["none", "source", "pass"], "bucket", ["key", "size", "row"], F.col("size"), "start")
    middle = F.col("pass") * F.col("source_size") + F.col("start") + F.col("size") / 2
    drawn = F.col("middle") < F.col("target")
    block = F.least(F.floor(F.col("middle") * F.col("quota") / F.col("target")).cast("int"), F.col("quota") - 1)
    placed = placed.withColumn("middle", middle).select(
        "row", "id", "none", "source", "size", "source_size", "target", "pass", F.when(drawn, block).alias("block"))

    tickets = sources.where("quota > 0").select("none", "source", F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("block"))
    by_source = Window.partitionBy("none", "source")
    shards = split_tree(tickets, n_shards, seed).withColumn("place", F.row_number().over(by_source.orderBy("shard", "block"))).drop("block")
    permuted = tickets.withColumn("place", F.row_number().over(by_source.orderBy(_key(seed, "block", F.col("source"), F.col("block")), "block")))
    assigned = permuted.join(shards, ["none", "source", "place"]).drop("place")
    dealt = shared_table(placed.join(assigned, ["none", "source", "block"], "left"), "mix-shards")
    shuffled = (dealt.where("shard IS NOT NULL").withColumn("key", _key(seed, "shuffle", F.col("pass"), F.col("id")))
                .withColumn("bucket", bucket(F.col("key"))))
    slots = _running(shuffled, ["shard"], "bucket", ["key", "source", "size", "row"], F.lit(1), "slot").drop("key", "bucket")
    left = dealt.where("shard IS NULL").withColumn("slot", F.lit(None).cast("long"))
    return slots.unionByName(left).select(
        "row", F.col("id").alias(id_col), F.when(~F.col("none"), F.col("source")).alias("source"), "size", "source_size",
        "target", "pass", "block", "shard", F.col("slot").cast("long").alias("slot"))


def oracle() -> str:
    """Targets by sharing again until none is above its limit; words by whole-source running sums."""
    return rf"""WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS most,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
rounds AS (
  SELECT 0 AS n, source, source_size, most, weight, 0.0::DOUBLE AS target, false AS capped FROM s
  UNION ALL
  SELECT n + 1, source, source_size, most, weight, CASE WHEN capped THEN target ELSE least(most, fresh) END, capped OR fresh >= most
  FROM (SELECT *, weight * ((sum(source_size) OVER () - coalesce(sum(target) FILTER (capped) OVER (), 0))
                            / sum(weight) FILTER (NOT capped) OVER ()) AS fresh FROM rounds WHERE n < 40)),
t AS (SELECT source, source_size, target FROM rounds WHERE n = 40),
c AS (
  SELECT k, d.doc_id, size, source_size, target, p, d.source, md5('{SEED}:' || p || ':' || coalesce(d.doc_id::VARCHAR, '')) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, unnest([0, 1, 2]) AS u(p)),
placed AS (
  SELECT *, p * source_size + coalesce(sum(size) OVER (PARTITION BY source, p ORDER BY key, size, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + size / 2.0::DOUBLE AS middle FROM c)
SELECT doc_id, size, source_size, target, coalesce(sum(size) FILTER (middle < target), 0)::BIGINT AS taken
FROM placed GROUP BY k, doc_id, size, source_size, target"""
