"""Training-corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; ``run`` writes every
stage's result to the shared folder and reads it again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import bpe, decontam, langid, linedup, simhash
from tidewater.llm.common import documents, remainder, shared_table
from tidewater.llm.queries import VOCABULARY
from tidewater.session import read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a dominant language: null and letterless texts, and mixtures in which no
    language has half of the text.  Labels come from the rows that op2 may learn from."""
    model = langid.fit(docs, remainder("doc_id", 5) != 0)
    return langid.keep_identified(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated and nearly repeated lines out of the texts; the first line of each class stays, and
    ``n_chars`` follows the text."""
    return linedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each SimHash group, with op1's shingles and bit distance."""
    return simhash.keep_first(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item is found."""
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as token ids, with the digests of ids and of the decoded bytes."""
    import public_tokenizers
    coded = bpe.transcode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.digests(coded, keep=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", tokenize),
]

#: SQL can't express the fitted, fuzzy and tokenizing stages; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = shared_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
