"""File sources and sinks.

Readers always take an explicit schema (no inference on large inputs) and
use permissive parsing where the reference coerces bad values to missing.
"""

from __future__ import annotations

import os
import time
import uuid
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.scalar import to_date_safe

__all__ = [
    "read_csv_sources", "normalise_date", "read_event_tsv", "parse_observations", "parse_nested_series",
    "coerce_text", "typed_text_column", "write_stage", "write_documents", "publish_atomic", "read_published",
    "content_manifest", "verify_manifest", "file_manifest", "verify_files", "dataset_summary", "union_existing", "code_set_filter",
]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_csv_sources(spark: SparkSession, sources: dict[str, tuple[str, T.StructType]],
                     strict: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Load several CSV sources (header, explicit schema).

    A missing file is reported in the returned status table (source, path,
    found) and skipped; ``strict=True`` raises instead."""
    frames, status = {}, []
    for name, (path, schema) in sources.items():
        ok = _exists(spark, path)
        status.append((name, path, ok))
        if not ok:
            if strict:
                raise FileNotFoundError(path)
            continue
        frames[name] = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    rep = spark.createDataFrame(status, "source string, path string, found boolean")
    return frames, rep


def normalise_date(df: DataFrame, candidates: Sequence[str] = ("date", "event_date"), out: str = "date") -> DataFrame:
    """First present candidate column becomes ``date`` (DATE); bad values → NULL."""
    for c in candidates:
        if c in df.columns:
            d = df.withColumn("__d", to_date_safe(c))
            d = d.drop(c) if c != out else d.drop(out)
            return d.withColumnRenamed("__d", out)
    raise ValueError(f"none of {candidates} in {df.columns}")


def read_event_tsv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Headerless tab-separated file with a positional all-string schema;
    malformed lines are dropped."""
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    df = (spark.read.schema(schema).option("sep", "\t").option("header", False)
          .option("mode", "DROPMALFORMED").csv(path))
    # reference every column so pruned plans (e.g. count()) still parse and drop malformed lines
    return df.where(F.length(F.concat_ws("\u0001", *[F.col(n) for n in names])) >= 0)


def parse_observations(df: DataFrame, col: str = "json", missing_token: str = ".") -> DataFrame:
    """``{"observations": [{"date": .., "value": ..}]}`` → (date, value);
    the token "." and other non-numbers become NULL."""
    sch = "observations array<struct<date:string,value:string>>"
    e = df.select(F.explode(F.from_json(col, sch)["observations"]).alias("o"))
    v = F.col("o.value")
    return e.select(to_date_safe(F.col("o.date")).alias("date"),
                    F.when(v == missing_token, None).otherwise(v.try_cast("double")).alias("value"))


def parse_nested_series(df: DataFrame, col: str = "json") -> DataFrame:
    """``response.data[]`` with fallback ``request.series[0].data[]``;
    period / value names with ``date`` as a fallback name."""
    item = "array<struct<period:string,date:string,value:string>>"
    sch = f"response struct<data:{item}>, request struct<series:array<struct<data:{item}>>>"
    p = F.from_json(col, sch)
    rows = F.coalesce(p["response"]["data"], F.element_at(p["request"]["series"], 1)["data"])
    e = df.select(F.explode(rows).alias("o"))
    return e.select(to_date_safe(F.coalesce(F.col("o.period"), F.col("o.date"))).alias("date"),
                    F.col("o.value").try_cast("double").alias("value"))


def coerce_text(c) -> Column:
    """Text scalar → struct(kind, bool, long, double, string): empty → null,
    true/false → bool, integer pattern → long, float pattern (with exponent)
    → double, else string."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    low = F.lower(s)
    is_null = s.isNull() | (s == "")
    is_bool = low.isin("true", "false")
    is_int = s.rlike(r"^[+-]?\d+$")
    is_float = s.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$")
    kind = (F.when(is_null, "null").when(is_bool, "bool").when(is_int, "int").when(is_float, "float")
            .otherwise("string"))
    return F.struct(kind.alias("kind"), F.when(is_bool, low == "true").alias("bool"),
                    F.when(is_int, s.try_cast("long")).alias("long"),
                    F.when(is_int | is_float, s.try_cast("double")).alias("double"),
                    F.when(~is_null, s).alias("string"))


def typed_text_column(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(f"{c}_typed", coerce_text(c))


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """One output per stage; Parquet by default, CSV with header on request."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_documents(doc: DataFrame, targets: Iterable[str]) -> None:
    """The same JSON payload to several targets, computed once (persisted)."""
    doc = doc.persist()
    try:
        for t in targets:
            doc.write.mode("overwrite").json(t)
    finally:
        doc.unpersist()


def publish_atomic(df: DataFrame, root: str, fmt: str = "parquet") -> str:
    """Write a fresh version folder whose name sorts after all earlier ones.

    A version counts once its ``_SUCCESS`` marker exists, which the commit
    creates last: readers see the old version or the new one, never neither.
    Earlier versions stay as backups until a retention job removes them."""
    target = os.path.join(root, f"v-{time.time_ns():020d}-{uuid.uuid4().hex}.{fmt}")
    df.write.mode("errorifexists").format(fmt).save(target)
    return target


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The latest complete version under ``root``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), reverse=True)
    for name in names:
        if name.startswith("v-") and _exists(spark, os.path.join(root, name, "_SUCCESS")):
            return spark.read.format(name.rpartition(".")[2]).load(os.path.join(root, name))
    raise FileNotFoundError(f"no published version under {root}")


def content_manifest(df: DataFrame, key: str, content: str, algo: str = "md5", carry: Sequence[str] = ()) -> DataFrame:
    """Per-row content hash (md5 / sha256), row-level xxhash64 and the columns ``carry``."""
    h = F.md5(F.col(content)) if algo == "md5" else F.sha2(F.col(content), 256)
    return df.select(key, h.alias("content_hash"), F.xxhash64(content).alias("row_hash"), *carry)


def verify_manifest(current: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows whose hash differs from, or is missing in, the manifest."""
    j = current.alias("c").join(manifest.alias("m"), key, "full_outer")
    status = (F.when(F.col("m.content_hash").isNull(), "new").when(F.col("c.content_hash").isNull(), "missing")
              .when(F.col("c.content_hash") != F.col("m.content_hash"), "changed").otherwise("ok"))
    return j.select(key, status.alias("status")).where(F.col("status") != "ok")


def file_manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(file, length, content_hash) of every file under ``root``, its path relative to it, hashed where it is read.

    A file is one row, so one of more than 2 GB can't be read; part files of a table are smaller."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    at = F.locate(top + "/", F.col("path"))
    return d.select(F.substring("path", at + len(top) + 1, F.lit(1 << 20)).alias("file"), "length", F.sha2("content", 256).alias("content_hash"))


def verify_files(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, status) of every file of either manifest: ok, changed, missing (in the manifest only) or new."""
    c = current.select("file", F.col("content_hash").alias("__now"))
    m = manifest.select("file", F.col("content_hash").alias("__then"))
    status = (F.when(F.col("__now").isNull(), "missing").when(F.col("__then").isNull(), "new")
              .when(F.col("__now") != F.col("__then"), "changed").otherwise("ok"))
    return c.join(m, "file", "full_outer").select("file", status.alias("status"))


def dataset_summary(frames: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, columns, first and last date per dataset, unioned."""
    out = None
    for name, (df, date) in frames.items():
        r = df.agg(F.count(F.lit(1)).alias("rows"), F.min(F.to_date(date)).alias("start"),
                   F.max(F.to_date(date)).alias("end")).select(
            F.lit(name).alias("dataset"), "rows", F.lit(len(df.columns)).alias("cols"), "start", "end")
        out = r if out is None else out.unionByName(r)
    return out


def union_existing(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame | None:
    """Union-read of files that may be missing or have differing columns."""
    out = None
    for p in paths:
        if not _exists(spark, p):
            continue
        d = spark.read.format(fmt).option("header", True).load(p)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def code_set_filter(df: DataFrame, cols: Sequence[str], codes: Sequence) -> Column:
    """Any of the columns in the code set (small literal sets; large sets
    belong in a semi join)."""
    cond = None
    for c in cols:
        e = F.col(c).isin(list(codes))
        cond = e if cond is None else (cond | e)
    return cond
