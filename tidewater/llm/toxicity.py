"""Toxicity by a subsequence string kernel and a support vector machine on Nystrom landmarks.

A sentence is scored by its most toxic window: a token, or a run of single-character tokens read
as one.  The kernel of two strings compares their gapped letter triples: a triple that spans s
positions counts DECAY ** s, and inserted characters only widen the span, so "i-d-i-o-t" and
"iddiot" stay close to the plain word.  Landmarks are strings from the training sentences; a
window is mapped to its kernel values with them, whitened by the landmarks' own kernel matrix
(Nystrom), and a linear machine with weighted hinge loss is trained on windows of labelled
sentences.  A document's margin is the largest of its sentences' margins, turned into a
probability by a logistic fit on the training documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_slices
from tidewater.llm.sampling import labelled_texts

SEED = 31
#: Labelled documents a label value that the machine is trained on.
MAX_ROWS = 2500
#: Landmarks, training windows with the strongest tie to toxic sentences, and windows drawn from the rest.
LANDMARKS = 384
STRONG = 1500
DRAWN = 6000
DECAY = 0.7
#: A triple spans at most SPAN characters, and its last letter is at most REACH letters after its first.
SPAN = 7
REACH = 4
WIDTH = 24
#: Distinct windows whose margin a worker remembers; emptied when full, which changes no result.
MEMORY = 300_000
SLICE_BYTES = 2 << 20
#: Weight of a clean sentence against a toxic one: a window that is as common in both is clean.
PRIOR = 4.0
FLOOR = -1.0
CLASSES = 48
START, END = "\x02", "\x03"
#: Look-alike characters read as letters.
_ALIKE = str.maketrans("013457@$!|", "oieastasil")
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")


# ------------------------------------------------------------------ windows
def plain(token: str) -> str:
    """Lower case without marks at the ends; look-alikes inside become letters."""
    token = token.lower()
    if token.isalpha():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    return token[a:b].translate(_ALIKE)


def _spelled(tokens: list[str]) -> Iterator[tuple[int, str]]:
    """(start, string) of each run of three or more single characters, read as one string."""
    single = "".join(["x" if len(t) == 1 or len(t) == 2 and not t[1].isalnum() else " " for t in tokens])
    for run in re.finditer("xxx+", single):
        yield run.start(), "".join(t[0] for t in tokens[run.start():run.end()])


def windows(text: str) -> set[str]:
    """Distinct raw tokens, and each run of three or more single characters as one string."""
    tokens = text.split()
    return set(tokens).union(w for _, w in _spelled(tokens))


def examples(sentence: str) -> set[tuple[str, str]]:
    """(token before, window) of a sentence's windows, plain and in stretches, with more than two letters and marks.

    A window counts once for each token before it: the copies of a passage are one example."""
    tokens = sentence.split()
    flat = [plain(t) for t in tokens]
    found = [*enumerate(flat), *((i, plain(w)) for i, w in _spelled(tokens))]
    return {(flat[i - 1] if i else "", p) for i, w in found for p in _pieces(w) if len(p) > 4}


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


# ------------------------------------------------------------------ kernel
def _pieces(word: str) -> list[str]:
    """The string between a start and an end mark, or overlapping stretches that cover a long one."""
    word = f"{START}{word}{END}"
    if len(word) <= WIDTH:
        return [word]
    return [word[i:i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def _classes(code: np.ndarray) -> np.ndarray:
    """1 to 26 for a to z, 27 and 28 for the marks, 29 to 47 for other letters by code point; 0 is skipped."""
    out = np.where((code >= 97) & (code <= 122), code - 96, np.where(code >= 170, 29 + code % 19, 0))
    return np.where((code == ord(START)) | (code == ord(END)), code + 25, out).astype(np.int64)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, triple, weight), sorted by row and triple, of the gapped letter triples of each word."""
    n = len(words)
    flat = np.frombuffer("".join(w.ljust(WIDTH, "\0") for w in words).encode("utf-32-le", "surrogatepass"),
                         dtype=np.uint32).reshape(n, WIDTH)
    letter = _classes(flat)
    # letters first, in order, with the positions they had
    at = np.argsort(letter == 0, axis=1, kind="stable")
    code = np.take_along_axis(letter, at, axis=1)
    used = int((code > 0).sum(axis=1).max(initial=0))
    rows, grams, spans = [], [], []
    for d in range(1, REACH):
        for e in range(d + 1, REACH + 1):
            m = used - e
            if m <= 0:
                continue
            span = at[:, e:e + m] - at[:, :m] + 1
            r, c = np.nonzero((code[:, e:e + m] > 0) & (span <= SPAN))
            rows.append(r)
            grams.append((code[r, c] * CLASSES + code[r, c + d]) * CLASSES + code[r, c + e])
            spans.append(span[r, c])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key = np.concatenate(rows) * CLASSES ** 3 + np.concatenate(grams)
    weight = DECAY ** np.concatenate(spans)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    total = np.add.reduceat(weight, new) if len(new) else weight
    return key[new] // CLASSES ** 3, key[new] % CLASSES ** 3, total


def project(words: list[str], place: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """Kernel values against the columns of ``onto``, whose row ``place[t]`` belongs to triple t: the
    triple vector of each word, scaled to length one, times the column; zero without a triple."""
    out = np.zeros((len(words), onto.shape[1]), dtype=np.float32)
    step = 4096 if onto.shape[1] == 1 else 512
    for a in range(0, len(words), step):
        row, gram, weight = triples(words[a:a + step])
        if not len(row):
            continue
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        dot = np.add.reduceat(onto[place[gram]] * weight[:, None].astype(np.float32), first, axis=0)
        norm = np.sqrt(np.add.reduceat(weight * weight, first))
        out[a + row[first]] = dot / norm[:, None]
    return out


class Landmarks:
    """Normalised kernel values of words with a fixed list of landmark strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        row, gram, weight = triples(strings)
        known, at = np.unique(gram, return_inverse=True)
        self.place = np.zeros(CLASSES ** 3, dtype=np.int32)  # row 0: triples that no landmark has
        self.place[known] = np.arange(1, len(known) + 1)
        table = np.zeros((len(known) + 1, len(strings)), dtype=np.float32)
        table[at + 1, row] = weight
        self.table = table / np.maximum(np.linalg.norm(table, axis=0), 1e-12)

    def values(self, words: list[str]) -> np.ndarray:
        """(words, landmarks): the cosine of the triple vectors."""
        return project(words, self.place, self.table)


# ------------------------------------------------------------------ machine
def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 100.0, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weighted linear support vector machine with squared hinge loss, by Newton steps in the primal;
    the last column of the augmented rows is the (unpenalised) intercept."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    sign = np.where(y > 0, 1.0, -1.0)
    ridge = np.diag([*np.full(x.shape[1], 1.0), 1e-6])
    w, inside = np.zeros(z.shape[1]), None
    for _ in range(steps):
        now = sign * (z @ w) < 1  # the rows that the loss touches
        if inside is not None and (now == inside).all():
            break
        inside = now
        a, cost = z[inside], c * weight[inside]
        best = np.linalg.solve(ridge + a.T @ (a * cost[:, None]), a.T @ (cost * sign[inside]))
        w = w + (best - w) * (1.0 if _ < 20 else 0.5)
    return w[:-1], float(w[-1])


class ToxicityModel:
    """Landmarks, the weights on their kernel values, and the logistic that reads a margin."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        # the weighted sum of the landmarks' triple vectors: kernel values are linear in it
        self.landmarks, self.place, self.bias = landmarks.strings, landmarks.place, bias
        self.direction = (landmarks.table @ weights.astype(np.float32))[:, None]
        self.slope, self.shift = slope, shift
        self.known: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each window; a long one takes the largest of the stretches that cover it."""
        cut = [_pieces(plain(w)) for w in words]
        flat = [p for ps in cut for p in ps]
        if not flat:
            return np.empty(0)
        once = list(dict.fromkeys(flat))
        found = dict(zip(once, (project(once, self.place, self.direction)[:, 0] + self.bias).tolist()))
        value = np.fromiter(map(found.__getitem__, flat), dtype=float, count=len(flat))
        first = np.cumsum([0, *map(len, cut[:-1])])
        return np.maximum(np.maximum.reduceat(value, first), FLOOR)

    def learn(self, words: set[str]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list(words.difference(self.known))
        self.known.update(zip(new, self.margins(new).tolist()))

    def margin(self, found: set[str]) -> tuple[float, str | None]:
        worst = max(found, key=self.known.__getitem__, default=None)
        return (FLOOR, None) if worst is None else (self.known[worst], worst)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted maximum-likelihood logistic, by Newton steps."""
    z = np.stack([margin, np.ones_like(margin)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-3 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def tie(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """How strongly windows are tied to toxic sentences: signed log-likelihood ratio of their shares
    of toxic (``pos``) and clean (``neg``) sentences, smoothed by the least share seen."""
    least = np.min(np.concatenate([pos[pos > 0], neg[neg > 0], [1.0]])) / 2
    return (pos + least) * np.log((pos + least) / (neg + least))


def train(table: list[tuple[str, float, float]], landmarks: int = LANDMARKS, prior: float = PRIOR) -> ToxicityModel:
    """From windows with the shares of toxic and of clean sentences that have them.  Landmarks are the
    windows most tied to toxic sentences and, for the other half, evenly drawn ones."""
    words = [w for w, _, _ in table]
    pos, neg = np.array([[p, n] for _, p, n in table]).T
    order = np.argsort(-tie(pos, neg), kind="stable")
    half = landmarks // 2
    rest = order[half:]
    drawn = rest[np.linspace(0, len(rest) - 1, min(len(rest), half)).astype(int)] if len(rest) else rest
    marks = Landmarks([words[k] for k in dict.fromkeys([*order[:half], *drawn])])
    gram = marks.values(marks.strings).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    white = vector / np.sqrt(np.maximum(value, 1e-3))
    x = marks.values(words) @ white
    # each window is an example of either label, weighted by the sentences that have it
    scale = np.min((pos + neg)[pos + neg > 0])
    both = np.concatenate([pos / scale, prior * neg / scale + 0.5])
    w, b = svm(np.vstack([x, x]), np.repeat([1, 0], len(words)), both)
    return ToxicityModel(marks, white @ w, b)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", max_rows: int = MAX_ROWS, seed: int = SEED) -> ToxicityModel | None:
    """Learn from labelled rows whose id satisfies ``allowed``, about ``max_rows`` of each label value; each
    sentence carries its document's label.  Spark counts the sentences that have each window; the driver
    gets a bounded number of windows (the most tied to toxic sentences and a seeded draw) and trains.
    Shares are relative to the most frequent window of either label.
    None when no label is known."""
    some, share = labelled_texts(docs, labels, label, allowed, max_rows, seed, id_col, text_col)
    if not share:
        return None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {(w, before, y) for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                   for s in sentences(t) for before, w in examples(s)}
            if out:
                w, before, y = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(before), pa.array(y, pa.int32())],
                                                 ["word", "before", "label"])

    once = some.select("label", "text").mapInArrow(cut, "word string, before string, label int").distinct()
    seen = (once.groupBy("word")
            .agg(F.sum((F.col("label") > 0).cast("double")).alias("pos"), F.sum((F.col("label") <= 0).cast("double")).alias("neg")))
    size = seen.agg(F.max("pos"), F.max("neg")).first()
    toxic, clean = (max(1.0, n or 0.0) for n in size)
    seen = seen.select("word", (F.col("pos") / toxic).alias("pos"), (F.col("neg") / clean).alias("neg"))
    smooth = F.lit(0.5 / max(toxic, clean))
    strength = (F.col("pos") + smooth) * F.log((F.col("pos") + smooth) / (F.col("neg") + smooth))
    strong = seen.orderBy(F.desc(strength), "word").limit(STRONG)
    drawn = seen.orderBy(F.xxhash64(F.lit(seed), F.col("word")), "word").limit(DRAWN)
    table = sorted({(r["word"], r["pos"], r["neg"]) for r in strong.collect() + drawn.collect()})
    if not table:
        return None
    model = train(table)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    seen = _margins(some.select("id", "text", "label"), shared, ["label"]).toArrow()
    y = (seen["label"].to_numpy() > 0).astype(float)
    weight = np.array([1 / share[v] for v in seen["label"].to_pylist()])
    model.slope, model.shift = logistic(seen["margin"].to_numpy(), y, weight / weight.mean())
    model.known = {}
    return model


def _margins(rows: DataFrame, shared, extra: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                found = [windows(t) if t else set() for t in part.column(1).to_pylist()]
                model.learn(set().union(*found))
                margin, worst = zip(*map(model.margin, found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(margin, pa.float64()), pa.array(worst, pa.string()), *part.columns[2:]],
                    ["id", "margin", "worst", *extra])

    kind = dict(rows.dtypes)
    schema = ", ".join([f"id {kind['id']}", "margin double", "worst string", *(f"{c} {kind[c]}" for c in extra)])
    return rows.select("id", "text", *extra).mapInArrow(run, schema)


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, ``worst`` window) of every row, from the whole text.  Null and empty texts have the
    least margin and no window.  Without a model (no labels) every score is 0.  Other columns are
    ignored; repeated rows give repeated results; an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("worst"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    margin = F.lit(model.slope) * F.col("margin") + F.lit(model.shift)
    return _margins(rows, shared, []).select(
        F.col("id").alias(id_col), (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias("score"), "worst")
