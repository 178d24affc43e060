"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document,
and a softmax over the two labels, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_slices
from tidewater.llm.sampling import labelled_texts

BITS = 15
DIM = 16
SEED = 23
#: Labelled rows a label value that the vectors are trained on.
MAX_ROWS = 2500
EPOCHS = 8
SLICE_BYTES = 4 << 20
_WORD = np.uint64(0x9E3779B97F4A7C15)
_CHAR = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)
_SHAPE: list[np.ndarray] = []


def _shapes() -> np.ndarray:
    """Code point to shape: lower case, upper case, other letter, digit, white space; a mark is itself."""
    if not _SHAPE:
        table = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = 2 if c.isupper() else 1 if c.islower() else 3
            elif c.isdigit():
                table[i] = 4
            elif c.isspace():
                table[i] = 5
        _SHAPE.append(table)
    return _SHAPE[0]


def _bucket(h: np.ndarray, space: int) -> np.ndarray:
    mixed = (h.astype(np.uint64) + np.uint64(space)) * _WORD
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def feature_ids(text: str | None) -> np.ndarray:
    """Hashed features of the whole text: words, pairs of neighbouring words (equal neighbours share
    one feature), 3-grams of characters and 4-grams of character shapes.  [] for an empty text."""
    raw = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    shape = _shapes()[raw]
    code = np.frombuffer((text or "").casefold().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = []
    for space, values, order in ((1, code, 3), (2, shape, 4)):
        if len(values) >= order:
            h = sum(values[i:len(values) - order + 1 + i] * _CHAR[i] for i in range(order))
            out.append(_bucket(h, space))
    # words: a polynomial hash of each run between white space, from running sums
    blank = _shapes()[code] == 5
    inside = np.concatenate([[False], ~blank, [False]]).astype(np.int8)
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(start):
        mixed = (code.astype(np.uint64) + np.uint64(1)) * _WORD
        # position in its word, counted from the last word start
        place = np.arange(len(code)) - np.maximum.accumulate(np.where(edge[:-1] == 1, np.arange(len(code)), 0))
        mixed ^= mixed >> np.uint64(29)
        mixed = mixed * (2 * place.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
        word = total[end] - total[start]
        out.append(_bucket(word, 3))
        if len(word) > 1:
            pair = np.where(word[1:] == word[:-1], np.uint64(7), word[1:] * np.uint64(31) + word[:-1])
            out.append(_bucket(pair, 4))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a text and their shares."""
    n = np.bincount(feature_ids(text), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at.astype(np.int32), (n[at] / max(1, n.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, dim: int = DIM,
          epochs: int = EPOCHS, rate: float = 20.0, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent over documents with a linearly falling rate; returns, for each bucket,
    its vector times the difference of the two output vectors, and the intercept."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    output = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, share = bags[k]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[ids] if len(ids) else np.zeros(dim, dtype=np.float32)
            logit = hidden @ output + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weights[k]
            back = output @ p
            output -= 0.01 * lr * np.outer(hidden, p)
            bias -= 0.001 * lr * p
            if len(ids):
                vectors[ids] -= lr * share[:, None] * back
    return vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0])


class QualityModel:
    """Score table of the hashed features: the averaged vectors and the softmax are linear up to the
    last step, so a document's margin is the mean of its features' entries."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table.astype(np.float64), bias

    def score(self, text: str | None) -> float:
        ids = feature_ids(text)
        margin = self.bias + (self.table[ids].mean() if len(ids) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", max_rows: int = MAX_ROWS, seed: int = SEED) -> QualityModel:
    """Learn from labelled rows whose id satisfies ``allowed``: about ``max_rows`` of each label value,
    weighted back to their share of all labelled rows.  Tasks turn the texts into feature shares; the
    driver gets these (at most 2 ** 15 entries a row) and trains."""
    some, share = labelled_texts(docs, labels, label, allowed, max_rows, seed, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shares = zip(*map(bag, batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())),
                 batch.column(2)], ["label", "ids", "shares", "id"])

    kind = some.schema["id"].dataType.simpleString()
    got = (some.select("text", "label", "id")
           .mapInArrow(run, f"label int, ids array<int>, shares array<float>, id {kind}").toArrow().sort_by("id"))
    if not got.num_rows:
        return QualityModel(np.zeros(1 << BITS), 0.0)
    bags = [(np.asarray(i.values), np.asarray(s.values)) for i, s in zip(got["ids"], got["shares"])]
    y = got["label"].to_numpy().astype(int).clip(0, 1)
    weight = np.array([1 / share[v] for v in got["label"].to_pylist()])
    return QualityModel(*train(bags, y, weight / weight.mean(), seed=seed))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1 from the whole text.  Null and empty texts get
    the probability of the intercept.  Other columns are ignored; repeated rows give repeated results;
    an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                found = [shared.value.score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], ["id", "score"])

    return (kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, score double")
            .withColumnRenamed("id", id_col))
