"""Bounded, seeded samples of labelled rows for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table

STEPS = 1 << 30


def below(id_col: str, seed: int, rate: float | Column) -> Column:
    """True for a share ``rate`` of the ids, the same ones on either side of a join; a smaller
    rate keeps a subset of the rows that a larger one keeps."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), F.lit(STEPS)) < F.lit(STEPS) * rate


def rates(rows: DataFrame, label: str, max_rows: int) -> dict:
    """For each label value the share of its rows that gives about ``max_rows`` of them."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per label value
    return {r[label]: min(1.0, max_rows / r["n"]) for r in counts}


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, max_rows: int, seed: int,
                   id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(id, text, label) of about ``max_rows`` rows a label value among those where ``allowed`` (a
    condition on the id) holds, and the rates.  The labels are thinned by the id's hash first, so what is
    broadcast to the documents has about ``max_rows`` rows a label value whatever the input; the
    texts of the sample are written once.  Of several labels of an id the largest counts."""
    known = (labels.where(allowed & F.col(id_col).isNotNull() & F.col(label).isNotNull())
             .groupBy(id_col).agg(F.max(label).cast("int").alias("label")))
    share = rates(known, "label", max_rows)
    some = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not share:
        return some.select("id", "text", F.lit(0).alias("label")).limit(0), {}
    rate = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in share.items()])
    known = known.where(below(id_col, seed, rate)).withColumnRenamed(id_col, "id")
    some = some.join(F.broadcast(known), "id").dropDuplicates(["id"]).select("id", "text", "label")
    return shared_table(some, "labelled"), share
