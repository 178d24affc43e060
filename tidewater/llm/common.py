"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import checkpoint_dir, read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shared_table(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: the lineage ends in
    files that every executor sees, so a lost executor costs a re-read and no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tidewater-{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table.written_to = path
    return table


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, for rows that grow with the input: Spark sizes a table by its
    packed files and the width of its rows, and counts neither what unpacking adds nor the rows that a function or an
    explode makes of one."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``shared_table`` whose readers have all been written."""
    for table in tables:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges whose sizes sum to about ``limit``; one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows holding about ``limit`` bytes of ``column``."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    for a, b in slices(lengths, limit):
        yield batch.slice(a, b - a)
