"""Registered queries of the training-data operators: thin digests over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontam, dialogue, exact, importance, langid, licenses, linedup, mixing, quality, sharding, simhash, toxicity
from tidewater.llm.common import documents, remainder
from tidewater.plans.registry import rounded_sql
from tidewater.session import read_table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=3)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 5) == 0
    model = langid.fit(docs, ~held)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score", "lang_shares")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder("doc_id", 4) == 2
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(documents(spark, sf_dir))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    coded = bpe.transcode(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.digests(coded)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = linedup.repeated_lines(documents(spark, sf_dir))
    copy = ~F.col("doc_id").eqNullSafe(F.col("first_id")) | (F.col("line") != F.col("first_line"))
    mark = F.struct("line", "first_id", "first_line")
    found = lines.groupBy(F.col("doc_id").alias("id")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("links").alias("links"),
        F.sort_array(F.collect_set(F.when(copy, mark))).alias("dropped"))
    docs = documents(spark, sf_dir).select("doc_id").distinct()
    none = F.lit(0).cast("long")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", F.coalesce("lines", none).alias("lines"), F.coalesce("links", none).alias("links"),
        F.coalesce(F.transform("dropped", lambda d: d["line"]), F.array().cast("array<int>")).alias("dropped_lines"),
        F.coalesce(F.transform("dropped", lambda d: d["first_id"]), F.array().cast("array<bigint>")).alias("class_doc_ids"),
        F.coalesce(F.transform("dropped", lambda d: d["first_line"]), F.array().cast("array<int>")).alias("class_lines"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(documents(spark, sf_dir), n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("stratum").alias("source"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"), mean_gain=True)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("size"))), F.lit(0))
    return (mixing.mix(documents(spark, sf_dir)).groupBy("row", "doc_id", "size", "source_size", "target")
            .agg(taken.alias("taken")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = dialogue.damage(read_table(spark, sf_dir, "conversations"))
    return dialogue.repair(rows, copies=copies)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_licenses": op7_licenses,
    "op8_bpe": op8_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_sharding": op10_sharding,
    "op11_resampling": op11_resampling,
    "op12_mixing": op12_mixing,
    "op13_conversations": op13_conversations,
}

ORACLE: dict[str, str] = {"op5_exact_dedup": exact.ORACLE, "op7_licenses": licenses.oracle(),
                          "op11_resampling": importance.oracle(), "op12_mixing": rounded_sql(mixing.oracle(), ["target"]),
                          "op13_conversations": dialogue.oracle()}
