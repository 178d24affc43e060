"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect binary Golay code [23, 12, 7].  Every word lies within 3 bits of exactly one codeword (its
*home*); a word at distance 3 from home has five more codewords at distance 4.  Two words that
differ in at most one bit therefore meet when one gives its home index and the other its home
and, at distance 3, those five neighbours (one or six keys).

Three differing bits fall on three segments in one of two ways (pigeonhole):

* some segment is equal, and of the other two one has at most one error: keys (equal segment,
  codeword index of another segment), six ordered pairs of segments;
* each segment has exactly one error: key (three codeword indices, three parities), where the
  first segment is expanded on the index side and the two others on the probe side; one error
  flips a parity, so the probe side asks for the opposite ones.

Every pair within three bits meets in at least one 33- to 39-bit key; candidates are verified by the
bit distance inside the join.  Links join distinct fingerprints only: documents with the same
fingerprint are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import shared_table, text_slices, unsent
from tidewater.llm.components import component_labels

SEED = 42
WIDTHS = (22, 21, 21)
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
SLICE_BYTES = 4 << 20
_LOW = np.uint64(0x0101010101010101)


# ------------------------------------------------------------------ fingerprints
def shingle_hashes(text: bytes, shingle: int = 3) -> list[int]:
    """XXH64 of each word shingle of the ASCII-lower-cased text; [] when there is no word."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    first, last = (end - size)[:len(words) - shingle + 1].tolist(), end[shingle - 1:].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(first, last)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint of each consecutive group of ``counts[i] > 0`` hashes: the bits set in over half.

    Eight masked additions count all 64 bits: a byte lane holds up to 255 hashes, so groups are
    summed in blocks of 255 and the blocks afterwards.
    """
    start = np.cumsum(counts) - counts
    blocks = (counts + 254) // 255
    first = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + 255 * within
    lanes = np.empty((len(at), 64), dtype=np.int64)
    for k in range(8):
        lanes[:, k::8] = np.add.reduceat((hashes >> np.uint64(k)) & _LOW, at).view(np.uint8).reshape(-1, 8)
    ones = np.add.reduceat(lanes, first, axis=0)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    hashes = [shingle_hashes(t or b"", shingle) for t in texts]
    counts = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
    out = np.zeros(len(texts), dtype=np.uint64)
    full = counts > 0
    if full.any():
        flat = np.fromiter((h for hs in hashes for h in hs), dtype=np.uint64, count=int(counts.sum()))
        out[full] = majority_bits(flat, counts[full])
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every row's whole text as a signed long."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                fp = fingerprints(part.column(1).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["id", "fp"])

    return kept.mapInArrow(run, f"id {kept.schema['id'].dataType.simpleString()}, fp long")


# ------------------------------------------------------------------ Golay code
def _encode(message: int) -> int:
    """Systematic codeword: 12 message bits above 11 check bits."""
    rest = message << 11
    for i in range(22, 10, -1):
        if rest >> i & 1:
            rest ^= GENERATOR << (i - 11)
    return message << 11 | rest


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error to the home codeword; the codeword indices to add for all keys
    (home first); and how many keys there are (1, or 6 for errors of weight 3)."""
    error = np.zeros(2048, dtype=np.int64)
    shift = np.zeros((2048, 6), dtype=np.int64)
    count = np.ones(2048, dtype=np.int64)
    sevens = [c for c in map(_encode, range(4096)) if c.bit_count() == 7]
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(_syndrome(np.array([e]))[0])
            error[s] = e
            if weight == 3:
                shift[s, 1:] = [c >> 11 for c in sevens if c & e == e]
                count[s] = 6
    return error, shift, count


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for i in range(22, 10, -1):
        rest = rest ^ np.where(rest >> i & 1, GENERATOR << (i - 11), 0)
    return rest


_TABLES: list = []


def _segment_keys(segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home index, the six key indices, and how many of them count, for each segment value."""
    if not _TABLES:
        _TABLES.extend(golay_tables())
    error, shift, count = _TABLES
    s = _syndrome(segment)
    home = (segment ^ error[s]) >> 11
    return home, home[:, None] ^ shift[s], count[s]


def _segments(fp: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for width in WIDTHS:
        out.append((fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    return out


def bucket_keys(fp: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``fp``, key) rows of the index side or of the probe side."""
    seg = _segments(fp)
    homes, alls, counts = zip(*map(_segment_keys, seg))
    six = np.arange(6)
    rows, keys = [], []
    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        base = (tag << 48) | (seg[i] << 12)
        if probe:
            r, c = np.nonzero(six < counts[j][:, None])
            rows.append(r)
            keys.append(base[r] | alls[j][r, c])
        else:
            rows.append(np.arange(len(fp)))
            keys.append(base | homes[j])
    parity = sum((np.bitwise_count(s.astype(np.uint64)).astype(np.int64) & 1) << k for k, s in enumerate(seg))
    if probe:
        r, c, d = np.nonzero((six[:, None] < counts[1][:, None, None]) & (six < counts[2][:, None, None]))
        key = (7 - parity[r]) << 36 | homes[0][r] << 24 | alls[1][r, c] << 12 | alls[2][r, d]
    else:
        r, c = np.nonzero(six < counts[0][:, None])
        key = parity[r] << 36 | alls[0][r, c] << 24 | homes[1][r] << 12 | homes[2][r]
    rows.append(r)
    keys.append(key | 6 << 48)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame, probe: bool, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                fp = batch.column(0).slice(a, 20_000).to_numpy()
                rows, keys = bucket_keys(fp.view(np.uint64), probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["key", name])

    return nodes.select("fp").mapInArrow(run, f"key long, {name} long")


def links(nodes: DataFrame, max_bits: int = 3) -> DataFrame:
    """Distinct pairs (a < b) of the fingerprints in ``nodes.fp`` at 1 to ``max_bits`` (<= 3) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the key construction covers at most 3 differing bits")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits
    pairs = unsent(_keyed(nodes, False, "u")).join(unsent(_keyed(nodes, True, "v")), "key").where((F.col("u") != F.col("v")) & near)
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


# ------------------------------------------------------------------ operator
def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id
    reachable over links of at most ``max_bits`` differing bits), ``links`` (distinct other
    fingerprints within ``max_bits``).

    Null, empty and blank texts have fingerprint zero and are linked like any other.  A text of
    fewer words than ``shingle`` is one shingle.  Repeated rows and equal texts share a
    fingerprint.  A row with a null id gets the component of its fingerprint (null when no
    row of the component has an id).  An empty table gives an empty result; other columns are ignored.
    """
    table = shared_table(fingerprint_table(docs, id_col, text_col, shingle), "simhash")
    nodes = shared_table(table.groupBy("fp").agg(F.min("id").alias("first")), "simhash-nodes")
    found = shared_table(links(nodes, max_bits), "simhash-links")
    label = component_labels(found)
    ends = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("links"))
    node = (nodes.join(unsent(label.withColumnRenamed("node", "fp")), "fp", "left").join(unsent(ends), "fp", "left")
            .select("fp", "first", F.coalesce("label", "fp").alias("label"),
                    F.coalesce("links", F.lit(0).cast("long")).alias("links")))
    least = node.groupBy("label").agg(F.min("first").alias("component_id"))
    node = node.join(least, "label").select("fp", "component_id", "links")
    return (unsent(table).join(unsent(node), "fp")
            .select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id", "links"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate group, columns unchanged.

    The decision holds for an id: repeated rows of one id stay or go together.  Rows without an
    id can't be named as a duplicate and stay.
    """
    gone = shared_table(near_duplicates(docs, id_col, text_col, shingle, max_bits).where(F.col(id_col) != F.col("component_id"))
                        .select(F.col(id_col).alias("__gone")).distinct(), "simhash-gone")
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
