"""Language identification as multilingual mixture inference.

Every language has a distribution over hashed character 2- and 3-grams, learned from labelled rows.
A document is a mixture: expectation-maximisation estimates the share of each language from the
likelihoods of the document's n-grams, and the set of languages grows one by one as long as the
log-likelihood gains more than a penalty proportional to the log of the number of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_slices
from tidewater.llm.sampling import below, rates

BITS = 16
ORDERS = (2, 3)
SEED = 17
#: Labelled rows of each language that the n-gram counts are taken from.
MAX_ROWS = 4000
SMOOTHING = 0.5
PENALTY = 6.0
SLICE_BYTES = 4 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def ngram_ids(text: str | None) -> np.ndarray:
    """Hashed n-gram ids of the whole lower-cased text, runs of non-letters as one blank; the n-th
    order's ids follow the previous order's.  Empty when the text has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    code = np.concatenate([[0], np.where(letter, code, 0), [0]]).astype(np.uint32)
    code = code[(code > 0) | np.concatenate([[True], code[:-1] > 0])]
    out = []
    for k, order in enumerate(ORDERS):
        h = sum(code[i:len(code) - order + 1 + i] * _MIX[i] for i in range(order))
        out.append((h >> np.uint32(32 - BITS)).astype(np.int64) + (k << BITS))
    return np.concatenate(out)


def _counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) counted in the tasks first and then summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(len(ORDERS) << BITS, dtype=np.int64)
                held[lang] += np.bincount(ngram_ids(text), minlength=len(ORDERS) << BITS)
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])],
                                             ["lang", "gram", "n"])

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class MixtureModel:
    """Languages and the probability of each hashed n-gram, (grams x languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = PENALTY):
        self.languages, self.penalty = languages, penalty
        part = counts.reshape(len(ORDERS), 1 << BITS, -1) + SMOOTHING
        prob = part / part.sum(axis=1, keepdims=True)
        # a common factor keeps the numbers near 1 and changes no share
        self.prob = (prob * (1 << BITS)).reshape(len(ORDERS) << BITS, -1).astype(np.float32)
        self.log = np.log(self.prob)

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """(dominant language, its share, shares); ``und`` with share 0 when there is no letter."""
        ids = ngram_ids(text)
        if not len(ids) or not self.languages:
            return "und", 0.0, {}
        prob = self.prob[ids]
        alone = self.log[ids].sum(axis=0, dtype=np.float64)
        chosen = [int(alone.argmax())]
        share, best = np.ones(1, dtype=np.float32), float(alone.max())
        price = self.penalty * np.log(len(ids))
        while len(chosen) < len(self.languages):
            mix = prob[:, chosen] @ share
            gain = (1 / mix) @ prob / len(ids)
            gain[chosen] = 0
            grown = None
            for k in np.flatnonzero(gain > 1):  # the likelihood can't rise where the slope is not positive
                trial, now, like = [*chosen, int(k)], np.append(share * np.float32(0.8), np.float32(0.2)), best
                own = prob[:, trial]
                for _ in range(12):
                    mix = own @ now
                    now = now * ((1 / mix) @ own) / len(ids)
                like = float(np.log(own @ now).sum(dtype=np.float64))
                if like - best > price and (grown is None or like > grown[2]):
                    grown = trial, now, like
            if grown is None:
                break
            chosen, share, best = grown
        top = int(share.argmax())
        shares = {self.languages[k]: float(s) for k, s in zip(chosen, share)}
        return self.languages[chosen[top]], min(1.0, float(share[top])), shares


def fit(docs: DataFrame, allowed: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS, seed: int = SEED, penalty: float = PENALTY) -> MixtureModel:
    """Learn from the rows where ``allowed`` holds and the language is known: about ``max_rows`` of each
    language, picked by a seeded hash of the id."""
    known = docs.where(allowed & F.col(lang_col).isNotNull())
    share = rates(known, lang_col, max_rows)
    if not share:
        return MixtureModel([], np.zeros((len(ORDERS) << BITS, 0)), penalty)
    rate = F.coalesce(*[F.when(F.col(lang_col) == k, F.lit(v)) for k, v in share.items()])
    some = known.where(below(id_col, seed, rate)).select(
        F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = _counts(some).toArrow()  # at most 2 x 65,536 rows a language
    languages = sorted(set(map(str, share)))
    counts = np.zeros((len(ORDERS) << BITS, len(languages)))
    where = {v: k for k, v in enumerate(languages)}
    counts[found["gram"].to_numpy(), [where[x] for x in found["lang"].to_pylist()]] = found["n"].to_numpy()
    return MixtureModel(languages, counts, penalty)


def predict(docs: DataFrame, model: MixtureModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of that language, 0 to 1) and ``lang_shares``
    (a map) added; all columns pass through, names that clash are replaced.

    Only the text is read.  Null, empty and letterless texts give ``und``, score 0 and an empty map.
    Repeated rows give repeated results; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "lang_shares")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, at, SLICE_BYTES):
                found = [shared.value.infer(t) for t in part.column(at).to_pylist()]
                lang, score, shares = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang), pa.array(score, pa.float64()),
                     pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))],
                    [*part.schema.names, "lang_pred", "score", "lang_shares"])

    schema = docs.limit(0).selectExpr("*", "'' lang_pred", "0D score", "cast(map() as map<string,double>) lang_shares").schema
    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: MixtureModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (columns unchanged) that have a dominant language: not ``und``, and a share
    of at least ``least``."""
    names = docs.columns
    return predict(docs, model, text_col).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*names)
