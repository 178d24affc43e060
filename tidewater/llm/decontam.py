"""Benchmark decontamination by latent semantic retrieval.

Documents become sequences of benchmark word numbers.  Passages (windows of words) and pieces of benchmark items are
TF-IDF vectors over the benchmark's words.  A randomised singular value decomposition of the passage matrix, computed by
sums over all tasks, gives a latent basis; a random projection of what the basis leaves out
keeps products right on average however many pieces there are.  Pieces are indexed by their rarest words, so many of them
that nothing that the check accepts can lack them all; a window meets the pieces of which it has one.  Of these, candidates are the pieces whose latent product with the window is a large enough part of the piece's own
square: the cosine without the window's length, so that neither other words of the window nor the popularity of a
piece matter.  A candidate counts when the longest common subsequence of words covers enough of the piece, and
enough of its answer (its last sentence), so edits and paraphrases are found and shared vocabulary alone is not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table, slices, text_slices

WINDOW, STRIDE = 64, 32
#: Benchmark words in one piece; longer items are cut into pieces that are searched alone.
PIECE = 48
#: Dimensions of the latent basis, and of the random projection of the rest.
RANK, REST = 48, 32
#: Columns of the passage matrix; more benchmark words than that share columns by number.
MOST_COLUMNS = 1 << 16
#: Pairs of window and piece whose products are taken at a time.
PAIRS = 50_000
#: Part of a piece's own square that its product with a window has to reach.
NEAR = 0.4
COVER, ANSWER = 0.6, 0.5
SLICE_BYTES = 2 << 20
SLICE_WORDS = 100_000
SEED = 11
#: Bytes of benchmark text handled at a time; a larger benchmark is searched in as many rounds.
BENCH_BYTES = 64 << 20
_WORD = re.compile(r"\w+")
_END = re.compile(r"(?<=[.!?])\s+|\n+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def answer_words(text: str) -> int:
    """Number of words in the answer: the last sentence, or with fewer than three words the last sentences
    that have three."""
    n = 0
    for part in reversed([p for p in _END.split(text) if p]):
        n += len(words(part))
        if n >= 3:
            break
    return n


@dataclass
class Benchmark:
    """Pieces of benchmark items as word numbers."""
    items: list
    unigrams: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.pieces: list[tuple[int, np.ndarray, int]] = []  # item, words, words of the answer
        for k, (_, text) in enumerate(self.items):
            ids = np.array([self.unigrams.setdefault(w, len(self.unigrams)) for w in words(text)], dtype=np.int64)
            tail = answer_words(text)
            count = max(1, -(-len(ids) // PIECE))
            for i, part in enumerate(np.array_split(ids, count)):
                if len(part):
                    self.pieces.append((k, part, min(tail, len(part)) if i == count - 1 else 0))
        self.terms = len(self.unigrams)


def joined(packed: list[bytes], stride: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts one after the other as (words, start of each text, number of the first text), about SLICE_WORDS at a
    time.  Each starts at a multiple of ``stride`` and is followed by so many blanks (-1) that no window
    holds words of two texts."""
    for a, b in slices([len(p) // 4 for p in packed], SLICE_WORDS):
        texts = [np.frombuffer(p, dtype=np.int32) for p in packed[a:b]]
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        room = -(-(size + WINDOW - stride) // stride) * stride
        start = np.cumsum(room) - room
        out = np.full(int(room.sum()), -1, dtype=np.int64)
        for s, t in zip(start.tolist(), texts):
            out[s:s + len(t)] = t
        yield out, start, a


def encoded(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(id, ids): the words of every text as packed 32-bit benchmark word numbers, -1 for others."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(F.col("body").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.unigrams
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                ids = [np.fromiter((known.get(w, -1) for w in words(t)), dtype=np.int32).tobytes()
                       for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["id", "ids"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, ids binary")


def total(parts: DataFrame) -> np.ndarray:
    """Sum of the packed float64 vectors in ``parts`` (part, sum), by a tree of grouped sums, so that no
    task adds more than 32 of them."""
    def add(key: tuple, rows: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(x) for x in rows.column("sum").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sum": pa.array([summed.tobytes()], pa.binary())})

    rows = parts.count()
    while rows > 1:
        parts = shared_table(parts.groupBy((F.col("part") / 32).cast("int").alias("group"))
                             .applyInArrow(add, "part int, sum binary"), "decontam-sums")
        rows = parts.count()
    found = parts.first()  # a vector whose size follows the benchmark
    return np.frombuffer(found["sum"]).copy() if found else np.zeros(0)


def _summed(coded: DataFrame, width: int, add) -> np.ndarray:
    """``add(vector, words)`` over all texts of a task in whole disjoint windows, then over all tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width)
        seen = False
        for batch in batches:
            for ids, _, _ in joined(batch.column(0).to_pylist(), WINDOW):
                add(held, ids)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([held.tobytes()], pa.binary())], ["part", "sum"])

    out = total(shared_table(coded.select("ids").mapInArrow(run, "part int, sum binary"), "decontam-parts"))
    return out if len(out) else np.zeros(width)


class Basis:
    """Latent space of passages and pieces, and the index of the pieces' rarest words."""

    def __init__(self, bench: Benchmark, frequency: np.ndarray, passages: float, near: float):
        self.bench, self.least = bench, near
        # products of two vectors sum inverse passage frequencies
        self.weight = np.sqrt(np.log((1 + passages) / (1 + frequency)) + 1)
        self.width = min(bench.terms, MOST_COLUMNS)
        rows = [np.unique(ids) for _, ids, _ in bench.pieces]
        self.own = np.array([(self.weight[r] ** 2).sum() for r in rows])
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        self.need = np.array([needed(len(ids)) for _, ids, _ in bench.pieces])
        self.stretch = np.array([stretch_length(len(ids)) for _, ids, _ in bench.pieces])
        self.held = self.rows[0] * bench.terms + self.rows[1]  # ascending: (piece, word)
        # a stretch with ``needed`` words of a piece lacks fewer distinct ones than this, so it has one of its rarest
        rarest = [r[np.argsort(frequency[r], kind="stable")[:min(len(r), int(len(ids) - needed(len(ids))) + 1)]]
                  for r, (_, ids, _) in zip(rows, bench.pieces)]
        owner, word = np.repeat(np.arange(len(rarest)), [len(r) for r in rarest]), np.concatenate(rarest)
        order = np.argsort(word, kind="stable")
        self.posted = owner[order]
        self.first = np.searchsorted(word[order], np.arange(bench.terms + 1))

    def products(self, row: np.ndarray, term: np.ndarray, n: int, onto: np.ndarray) -> np.ndarray:
        """The n vectors with words ``term`` in rows ``row`` (ascending), times the columns of ``onto``."""
        out = np.zeros((n, onto.shape[1]), dtype=onto.dtype)
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[first]] = np.add.reduceat(onto[term % self.width] * self.weight[term].astype(onto.dtype)[:, None], first, axis=0)
        return out

    def back(self, row: np.ndarray, term: np.ndarray, values: np.ndarray, held: np.ndarray) -> None:
        """Adds to ``held`` the transposed product: every word gets its rows' values."""
        if len(row):
            order = np.argsort(term % self.width, kind="stable")
            row, term = row[order], term[order]
            column = term % self.width
            first = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
            held[column[first]] += np.add.reduceat(values[row] * self.weight[term].astype(values.dtype)[:, None], first, axis=0)

    def fit(self, coded: DataFrame, shared_self) -> None:
        """Randomised range finder over the passages, and the principal directions of its range.  Pieces join the
        passage matrix with the weight of the corpus, and what the range leaves out is projected at random, so one pass
        over the passages is enough."""
        rank = min(RANK, self.width)
        rng = np.random.default_rng(SEED)
        space = rng.normal(size=(self.width, rank)).astype(np.float32)
        sent = coded.sparkSession.sparkContext.broadcast(space)

        def add(held: np.ndarray, ids: np.ndarray) -> None:
            basis, at = shared_self.value, np.flatnonzero(ids >= 0)
            row, term = at // WINDOW, ids[at]
            basis.back(row, term, basis.products(row, term, len(ids) // WINDOW, sent.value), held[:-1].reshape(-1, sent.value.shape[1]))
            held[-1] += (basis.weight[term] ** 2).sum()

        summed = _summed(coded, self.width * rank + 1, add)
        drawn = summed[:-1].reshape(self.width, rank)
        boost = max(1.0, summed[-1] / max(1e-9, self.own.sum()))
        self.back(*self.rows, boost * self.products(*self.rows, len(self.own), space), drawn)
        space, triangle = np.linalg.qr(drawn)
        space = space @ np.linalg.svd(triangle)[0]
        rest = rng.normal(size=(self.width, REST)) / math.sqrt(REST)
        self.aim(np.hstack([space, rest - space @ (space.T @ rest)]))

    def aim(self, space: np.ndarray) -> None:
        """Pieces in the space, divided by their own squares."""
        self.space = space.astype(np.float32)
        self.near = (self.products(*self.rows, len(self.own), space) / np.maximum(self.own, 1e-12)[:, None]).astype(np.float32)

    def met(self, at: np.ndarray, term: np.ndarray) -> np.ndarray:
        """(stride, piece) numbers as stride * pieces + piece, where the stride has one of the piece's rarest words."""
        count = self.first[term + 1] - self.first[term]
        start = np.cumsum(count) - count
        piece = self.posted[np.repeat(self.first[term] - start, count) + np.arange(count.sum())]
        return np.unique(np.repeat(at // STRIDE, count) * len(self.own) + piece)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(window start, piece) in order: pieces that a window meets, with a large enough product."""
        at = np.flatnonzero(ids >= 0)
        term, strides, pieces = ids[at], -(-len(ids) // STRIDE), len(self.own)
        parts = self.products(at // STRIDE, term, strides, self.space)
        windows = parts.copy()
        for k in range(1, WINDOW // STRIDE):
            windows[:-k] += parts[k:]
        keys = self.met(at, term)
        keys = [keys - k * pieces for k in range(WINDOW // STRIDE)]  # windows that hold the stride
        keys = np.unique(np.concatenate(keys))
        keys = keys[keys >= 0]
        out = []
        for a in range(0, len(keys), PAIRS):
            row, piece = np.divmod(keys[a:a + PAIRS], pieces)
            near = np.einsum("ij,ij->i", windows[row], self.near[piece]) >= self.least
            row, piece = row[near], piece[near]
            enough = self.words_around(ids, row, piece) >= self.need[piece]  # fewer can't be in order
            out += zip((row[enough] * STRIDE).tolist(), piece[enough].tolist())
        return out

    def words_around(self, ids: np.ndarray, row: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Most words of the piece in any stretch of its verified length around each window."""
        before, after = WINDOW // 2 // STRIDE, (WINDOW + WINDOW // 2) // STRIDE
        width = (before + after) * STRIDE
        padded = np.full(width + -(-len(ids) // STRIDE) * STRIDE, -1, dtype=np.int64)
        padded[before * STRIDE:before * STRIDE + len(ids)] = ids
        around = np.lib.stride_tricks.sliding_window_view(padded, width)[::STRIDE][row]
        key = np.where(around >= 0, piece[:, None] * self.bench.terms + around, -1)
        slot = np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)
        count = np.zeros((len(row), width + 1), dtype=np.int32)
        np.cumsum(self.held[slot] == key, axis=1, out=count[:, 1:])
        size = np.minimum(self.stretch[piece], width)
        best = np.zeros(len(row), dtype=np.int64)
        for n in np.unique(size):
            some = np.flatnonzero(size == n)
            best[some] = (count[some, n:] - count[some, :width + 1 - n]).max(axis=1)
        return best


# ------------------------------------------------------------------ verification
def needed(size: int) -> float:
    """Words of a piece of ``size`` words that have to be found in order."""
    return max(COVER * size, min(8, size))


def stretch_length(size: int) -> int:
    """Words of the stretch in which a piece of ``size`` words is looked for."""
    return size * 3 // 2 + 4


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def stretch(piece: np.ndarray, ids: np.ndarray, start: int) -> tuple[int, np.ndarray, int] | None:
    """(words of the piece in order, the stretch, its place) for the stretch of about one and a half piece
    lengths around the window that has most of the piece's words; None where they are too few."""
    low, high = max(0, start - WINDOW // 2), min(len(ids), start + WINDOW + WINDOW // 2)
    near = ids[low:high]
    size = min(len(near), stretch_length(len(piece)))
    hits = np.concatenate([[0], np.cumsum((near[:, None] == piece).any(axis=1))])
    at = int((hits[size:] - hits[:len(hits) - size]).argmax())
    need = needed(len(piece))
    if hits[at + size] - hits[at] < need:
        return None
    found = lcs(piece, near[at:at + size])
    return (found, near[at:at + size], low + at) if found >= need else None


def answered(piece: np.ndarray, tail: int, region: np.ndarray) -> float:
    """Share of the piece's answer in the stretch (1 where the piece holds none)."""
    return lcs(piece[-tail:], region) / tail if tail else 1.0


def verify(piece: np.ndarray, tail: int, ids: np.ndarray, start: int) -> tuple[float, float, int] | None:
    """(share of the piece, share of its answer, place) where both are large enough around the window."""
    got = stretch(piece, ids, start)
    if got is None:
        return None
    answer = answered(piece, tail, got[1])
    return (got[0] / len(piece), answer, got[2]) if answer >= ANSWER else None


def verify_around(piece: np.ndarray, tail: int, ids: np.ndarray, start: int) -> tuple[float, float, int] | None:
    """``verify``; where only the answer is missing, also at the neighbouring windows, whose stretch may hold it."""
    got = verify(piece, tail, ids, start)
    if got is None and stretch(piece, ids, start) is not None:
        got = next(filter(None, (verify(piece, tail, ids, s) for s in (start + STRIDE, start - STRIDE) if s >= 0)), None)
    return got


# ------------------------------------------------------------------ operator
def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", near: float = NEAR) -> DataFrame:
    """One row per document and benchmark item found in it: id, item, ``cover`` (largest share of a piece of the
    item in word order), ``answer`` (share of the answer) and ``start`` (word number of that place).

    ``near`` is the part of a piece's own square that its latent product with a window has to reach: less finds more and costs
    more (tests measure the recall against checking every window with every piece).  A benchmark of more than
    BENCH_BYTES is searched in several passes over the documents, which bounds what tasks hold of it.
    Null and empty texts match nothing, nor do items without a word.  Equal items each get their
    rows; rows that repeat an id give one row for each item.  Documents without an id are left out.
    An empty table on either side gives an empty result; other columns are ignored."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text).alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    rounds = -(-size // BENCH_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema["item"].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, cover double, answer double, start int"
    found = docs.sparkSession.createDataFrame([], schema)
    for k in range(rounds):  # one round for any benchmark of up to BENCH_BYTES
        mine = items.where(F.pmod(F.xxhash64("item", "body"), F.lit(rounds)) == k) if rounds > 1 else items
        rows = sorted(((r["item"], r["body"]) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        found = found.union(_search(docs, Benchmark(rows), id_col, text_col, schema, near))
    best = F.max(F.struct("cover", "answer", (-F.col("start")).alias("back"))).alias("best")
    return (found.where(F.col("id").isNotNull()).groupBy("id", "item").agg(best)
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.cover", "best.answer",
                    (-F.col("best.back")).alias("start")))


def _search(docs: DataFrame, bench: Benchmark, id_col: str, text_col: str, schema: str, near: float) -> DataFrame:
    context = docs.sparkSession.sparkContext
    if not bench.pieces:
        return docs.sparkSession.createDataFrame([], schema)
    shared = context.broadcast(bench)
    coded = shared_table(encoded(docs, shared, id_col, text_col), "decontam-words")

    terms = bench.terms

    def count(held: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero(ids >= 0)
        once = np.unique(at // WINDOW * terms + ids[at])
        held[:-1] += np.bincount(once % terms, minlength=terms)
        held[-1] += len(ids) // WINDOW

    summed = _summed(coded, bench.terms + 1, count)
    basis = Basis(bench, summed[:-1], summed[-1], near)
    basis.fit(coded, context.broadcast(basis))
    ready = context.broadcast(basis)
    names = [i for i, _ in bench.items]
    item_type = pa.schema([pa.field("x", pa.array([n for n in names if n is not None] or [0]).type)]).field(0).type
    parts = schema.split(", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = ready.value
        for batch in batches:
            out = []
            packed = batch.column(1).to_pylist()
            for ids, starts, first in joined(packed, STRIDE):
                for at, piece in b.candidates(ids):
                    k = int(np.searchsorted(starts, at, side="right")) - 1
                    item, own, tail = b.bench.pieces[piece]
                    text = ids[starts[k]:starts[k] + len(packed[first + k]) // 4]
                    got = verify_around(own, tail, text, at - int(starts[k]))
                    if got:
                        out.append((first + k, b.bench.items[item][0], *got))
            if out:
                k, item, cover, answer, start = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(k)), pa.array(item, item_type), pa.array(cover, pa.float64()),
                     pa.array(answer, pa.float64()), pa.array(start, pa.int32())], [p.split()[0] for p in parts])

    return shared_table(coded.mapInArrow(run, schema), "decontam-found")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, columns unchanged.  Rows without an id
    can't be named and stay."""
    gone = shared_table(contaminated(docs, benchmark, id_col, text_col)
                        .select(F.col(id_col).alias("__gone")).distinct(), "decontam-gone")
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
