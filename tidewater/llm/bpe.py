"""Byte-level BPE encoding and decoding on length-bucketed numpy matrices.

Each pre-token is a row of token ids, padded to its bucket's width; a parallel matrix holds the rank
of every adjacent pair.  In a round every row merges its leftmost pair of minimum rank: the merged id
replaces the left part, the row closes up by one column, and only the two pairs around the merge are
looked up again, in an open-addressing hash table.  Rows without a mergeable pair leave the matrix.
Pre-tokens wider than the largest bucket go through the same merge order with a heap.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_slices

BUCKETS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
SLICE_BYTES = 2 << 20
#: Distinct chunks of text whose ids a worker remembers; emptied when full, which changes no result.
MEMORY = 400_000
_NONE = np.int32(2**31 - 1)
_RUN = regex.compile(r"[\s\x1c-\x1f] ")
#: Bucket by length; 0 beyond the last.
_WIDTH = [next((w for w in BUCKETS if n <= w), 0) for n in range(BUCKETS[-1] + 2)]


class PairTable:
    """Rank of the token that two adjacent tokens make, by hashed lookup."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), dtype=np.uint64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        self.bits = max(4, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        empty, slot = self.keys[0], self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # linear probing, all keys at once: one of those at a free slot takes it
            free = todo[self.keys[slot[todo]] == empty]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        # the values of slots that two keys wrote in one round belong to the key that stayed
        at = self._find(keys)
        self.values[at] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        todo = np.flatnonzero((self.keys[slot] != keys) & (self.values[slot] != _NONE))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            here = slot[todo]
            todo = todo[(self.keys[here] != keys[todo]) & (self.values[here] != _NONE)]
        return slot

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; ``_NONE`` where there is no such token or either side is padding (-1)."""
        keys = left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        slot = self._find(keys.ravel())
        found = np.where(self.keys[slot] == keys.ravel(), self.values[slot], _NONE).reshape(left.shape)
        return np.where((left < 0) | (right < 0), _NONE, found)


class ByteBpe:
    """Encoder and decoder for a vocabulary of ranks, given as the text of a .tiktoken file."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.packed = {r: r.to_bytes(4, "little") for r in self.tokens}
        #: packed ids of chunks that start a text, and of chunks that follow a space
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}

    # -- merging
    def _matrix(self, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merged ids of each row, padded, and how many there are."""
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        rank = self.pairs(ids[:, :-1], ids[:, 1:])
        out = np.empty_like(ids)
        who = np.arange(len(rows))
        column = np.arange(width - 1)
        while len(who):
            at = rank.argmin(axis=1)
            row = np.arange(len(who))
            best = rank[row, at]
            over = best == _NONE
            if over.any():
                out[who[over]] = ids[over]
                stay = ~over
                ids, rank, who, at, best = ids[stay], rank[stay], who[stay], at[stay], best[stay]
                row = row[:len(who)]
                if not len(who):
                    break
            ids[row, at] = best
            # close the gap after the merge
            source = column + (column > at[:, None])
            ids = np.concatenate([np.take_along_axis(ids, source, axis=1), np.full((len(who), 1), -1, np.int32)], axis=1)
            rank = np.take_along_axis(rank, np.minimum(column + (column >= at[:, None]), width - 2), axis=1)
            rank[:, -1] = _NONE
            sizes[who] -= 1
            rank[row, at] = self.pairs(ids[row, at], ids[row, at + 1])
            left = at > 0
            rank[row[left], at[left] - 1] = self.pairs(ids[row[left], at[left] - 1], ids[row[left], at[left]])
        return out, sizes

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merge order for one long row: a heap of (rank, position) over linked parts."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        ends = list(range(1, n + 1))
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.ranks.get

        def rank(i: int) -> int | None:
            j = nxt[i]
            return get(piece[i:ends[j]]) if j < n else None

        heap = [(r, i, ends[i], ends[nxt[i]]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, mid, end = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or ends[i] != mid or j >= n or ends[j] != end:
                continue
            ids[i], ends[i], alive[j] = r, end, False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and (s := rank(k)) is not None:
                    heapq.heappush(heap, (s, k, ends[k], ends[nxt[k]]))
        return np.array([t for t, a in zip(ids, alive) if a], dtype=np.int32)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each non-empty pre-token as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, whole in enumerate(map(self.ranks.get, pieces)):
            if whole is not None:
                out[k] = self.packed[whole]
            else:
                groups.setdefault(_WIDTH[min(len(pieces[k]), BUCKETS[-1] + 1)], []).append(k)
        for width, members in groups.items():
            if width:
                ids, sizes = self._matrix([pieces[k] for k in members], width)
                flat, step = ids.astype("<u4").tobytes(), 4 * width
                for j, (k, n) in enumerate(zip(members, sizes.tolist())):
                    out[k] = flat[j * step:j * step + 4 * n]
            else:
                for k in members:
                    out[k] = self._long(pieces[k]).astype("<u4").tobytes()
        return out

    # -- texts
    def _learn(self, parts: set[str], known: dict[str, bytes], lead: str) -> None:
        """Adds to ``known`` the packed ids of ``lead`` + part, for parts that it lacks.

        Chunks that start with a space and end in a non-space can stand next to each other without
        changing a match, so these are split by one run of the pattern over all of them."""
        new = [lead + p for p in parts.difference(known)]
        joined = [c for c in new if lead and c[-1] != " " and not c[-1].isspace()]
        alone = [c for c in new if not lead or c[-1] == " " or c[-1].isspace()]
        found = self.pattern.findall("".join(joined))
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        cuts = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)))) + 1
        split = [self.pattern.findall(c) for c in alone]
        pieces = list(set(found).union(*split))
        ids = dict(zip(pieces, self.merge([p.encode("utf-8") for p in pieces])))
        at, packed, skip = 0, list(map(ids.__getitem__, found)), len(lead)
        for c, cut in zip(joined, cuts.tolist()):
            known[c[skip:]] = packed[at] if cut == at + 1 else b"".join(packed[at:cut])
            at = cut
        known.update((c[skip:], b"".join([ids[p] for p in ps])) for c, ps in zip(alone, split))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed; every match of the pattern is encoded on its own.

        A text is cut before each space that follows a non-space: no match of a byte-level pattern
        spans such a place.  Chunks repeat, so each distinct one is encoded once."""
        if len(self.after) > MEMORY:
            self.after.clear()
        if len(self.first) > MEMORY:
            self.first.clear()
        cut = []
        for text in texts:
            if text[:1].isspace() or _RUN.search(text):
                parts: list[str] = []
                for part in text.split(" "):
                    # glue on a part that follows white space
                    if parts and (not parts[-1] or parts[-1][-1].isspace()):
                        parts[-1] += " " + part
                    else:
                        parts.append(part)
                cut.append(parts)
            else:
                cut.append(text.split(" "))
        self._learn({parts[0] for parts in cut if parts[0]}, self.first, "")
        self._learn(set().union(*[parts[1:] for parts in cut]), self.after, " ")
        get = self.after.__getitem__
        return [(self.first[parts[0]] if parts[0] else b"") + b"".join(map(get, parts[1:])) for parts in cut]

    def decode(self, packed: list[bytes]) -> list[bytes]:
        get = self.tokens.__getitem__
        return [b"".join(map(get, np.frombuffer(p, dtype="<u4").tolist())) for p in packed]


_CODERS: dict[tuple[int, str], ByteBpe] = {}


def _coder(vocabulary: bytes, pattern: str) -> ByteBpe:
    key = (hash(vocabulary), pattern)
    if key not in _CODERS:
        _CODERS[key] = ByteBpe(vocabulary, pattern)
    return _CODERS[key]


def transcode(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``ids`` (binary: little-endian unsigned 32-bit token ids of the whole
    text) and ``decoded`` (binary: the bytes that the ids stand for, equal to the text's UTF-8).

    A null text counts as empty: no ids, empty bytes.  Special tokens are ordinary text.  Repeated
    rows give repeated results; an empty table gives an empty result; other columns are ignored.
    The vocabulary file is read on the driver and broadcast: its size is that of the file.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, "rb") as fh:
        shared = spark.sparkContext.broadcast(fh.read())
    kept = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                ids = coder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(coder.decode(ids), pa.binary())],
                    ["id", "ids", "decoded"])

    out = kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, ids binary, decoded binary")
    return out.withColumnRenamed("id", id_col)


def digests(coded: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of a ``transcode`` result, and the columns ``keep``."""
    return coded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *keep)
