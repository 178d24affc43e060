"""Exact dedup by content sort: range partitioning on sampled splitters, an external sort of whole texts and
comparison of neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table, text_slices

SLICE_BYTES = 8 << 20
#: Characters of the text that splitters hold, before its digest.
PREFIX = 32


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Over one partition sorted by whole text and id: a row per document with its run (equal neighbours), and at the
    end a row, with the text, for the runs of the least and of the greatest partition key (start of the text,
    digest): only these can go on in other partitions."""
    part = TaskContext.get().partitionId()
    text, key, ids, run = None, None, [], -1
    low: list[tuple] = []
    high: list[tuple] = []

    def close() -> tuple:
        meta = part, run, key[1], ids[0], len(ids)
        for ends, beyond in ((low, not low or key < low[0][0]), (high, not high or key > high[0][0])):
            if beyond:
                ends.clear()
            if not ends or key == ends[0][0]:
                ends.append((key, meta, text))
        return meta

    def rows(runs: list[tuple[tuple, list]]) -> pa.RecordBatch:
        flat = [(i, *meta) for meta, members in runs for i in members]
        cols = list(zip(*flat))
        return pa.RecordBatch.from_arrays(
            [pa.array(["row"] * len(flat)), pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()),
             pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4], id_type),
             pa.array(cols[5], pa.int64()), pa.nulls(len(flat), pa.binary())], names=_NAMES)

    for batch in batches:
        for piece in text_slices(batch, 1, SLICE_BYTES):
            done = []
            for i, body, digest, start in zip(*(c.to_pylist() for c in piece.columns)):
                if body != text:
                    if text is not None:
                        done.append((close(), ids))
                    text, key, ids, run = body, (start, digest), [], run + 1
                ids.append(i)
            if done:
                yield rows(done)
    if text is not None:
        yield rows([(close(), ids)])
        for meta, body in {meta[1]: (meta, body) for _, meta, body in low + high}.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(["edge"]), pa.nulls(1, id_type), pa.array([meta[0]], pa.int32()), pa.array([meta[1]], pa.int64()), pa.array([meta[2]]),
                 pa.array([meta[3]], id_type), pa.array([meta[4]], pa.int64()), pa.array([body], pa.binary())], names=_NAMES)


_NAMES = ["kind", "id", "part", "run", "sha", "first", "n", "body"]


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per input row: id, ``keep_id`` (smallest id of the rows with an equal normalised
    text), ``group_size``, ``kept`` and ``text_sha256`` (of the normalised UTF-8 text).

    Rows are range-partitioned by (start of the text, digest, id), splitters of bounded size, and sorted by whole text
    and id inside a partition, so equal texts are neighbours, neighbours are compared in full (equal digests
    don't make texts equal), and a text that any share of the rows has spreads over
    as many partitions as it fills.  Only the outermost runs of partitions meet again, grouped by whole text.
    Ids are long, int, short or string.  Null and empty texts are equal.  Ids sort before null; a group with no id
    keeps null.  Of repeated rows of the smallest id all are marked kept, as they are one
    document.  An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body")).withColumn("sha", digest(F.col("body")))
    kind = base.schema["id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]
    # splitters are sampled rows that go to the driver, so they hold the start of a text and its digest
    base = base.withColumn("start", F.substring("body", 1, PREFIX).cast("binary")).withColumn("body", F.col("body").cast("binary"))
    ordered = (base.repartitionByRange("start", "sha", F.col("id").asc_nulls_last())
               .sortWithinPartitions("body", F.col("id").asc_nulls_last()).select("id", "body", "sha", "start"))
    out = shared_table(
        ordered.mapInArrow(lambda it: _runs(it, arrow),
                           f"kind string, id {kind}, part int, run long, sha string, first {kind}, n long, body binary"),
        "exact", ("kind",))
    rows = out.where("kind = 'row'").select("id", "part", "run", "sha", "first", "n")

    # outermost runs with equal whole texts are one group; a group lists its runs, without the text
    groups = out.where("kind = 'edge'").groupBy("body").agg(
        F.min("first").alias("all_first"), F.sum("n").alias("all_n"), F.collect_list(F.struct("part", "run")).alias("runs"))
    # two rows a partition: a size bound that does not depend on the rows
    fixed = F.broadcast(groups.where(F.size("runs") > 1).select("all_first", "all_n", F.explode("runs").alias("r")).select("all_first", "all_n", "r.part", "r.run"))
    return (rows.join(fixed, ["part", "run"], "left")
            .select(F.col("id").alias(id_col),
                    F.when(F.col("all_n").isNotNull(), F.col("all_first")).otherwise(F.col("first")).alias("keep_id"),
                    F.coalesce("all_n", "n").alias("group_size"), F.col("sha").alias("text_sha256"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
            .select(id_col, "keep_id", "group_size", "kept", "text_sha256"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
WINDOW g AS (PARTITION BY body)
"""
