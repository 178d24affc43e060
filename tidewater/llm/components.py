"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's neighbours (larger ones: large star; smaller ones and itself: small
    star) to the smallest node of its neighbourhood."""
    around = (_both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    low = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    if large:
        moved = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = (around.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))))
    return moved.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node that a row of ``edges`` (a, b) names: label is the smallest node
    of its component.  Each round is one large and one small star, written to the shared folder;
    rounds grow with the logarithm of the longest path.  An empty table gives an empty result."""
    now = shared_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct(), "stars")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = shared_table(_star(_star(now, True), False), "stars")
        before, state = state, _state(now)
    # now every edge is (member, smallest node of its component)
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        now.select(F.col("b"), F.col("b"))).distinct()
