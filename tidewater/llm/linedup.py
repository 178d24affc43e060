"""Near-duplicate lines by segment partition, and documents without their repeated lines.

Exact copies are a class at any length.  Lines that differ may have one edit for each ``CHARS_PER_EDIT`` characters of the
shorter one, ``max_edits`` at most.  Two lines within e edits share a segment when one is cut into e + 1 segments:
at most e can be touched.  Every distinct line indexes its own segments under (length, segment
number, text) and probes, for each shorter length in reach, the substrings that can still equal a
segment when the edits left and right of it are counted (multi-match-aware selection).  Pairs that meet
must also agree in a parity sketch, which every true pair does; the rest are
verified on their text by a banded bit-parallel edit distance; verified links give classes of lines,
and of each class the first line by (document id, line number) stays.

Links name a line by 64 bits of its hash: two different lines with the same 64 bits (one pair is likely
among four billion distinct lines) count as one line in the links; copies are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, shared_table, text_slices, unsent
from tidewater.llm.components import component_labels

MAX_EDITS = 2
#: A pair may differ by one edit for so many characters of its shorter line: below 12 characters only exact copies
#: are repeats, below 24 one edit counts.
CHARS_PER_EDIT = 12
SLICE_BYTES = 4 << 20
FILTER_BITS = 25
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
_POWER = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def normal(line: str) -> str:
    """White space at the ends dropped, runs of it one space, lower case."""
    return " ".join(line.split()).lower()


def line_hashes(lines: list[str]) -> np.ndarray:
    """128 bits of each normalised line as two signed longs, (lines x 2)."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(x.encode("utf-8", "surrogatepass")) for x in lines]), dtype=np.int64).reshape(-1, 2)


def _segment(n: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the i-th of ``parts`` even segments of strings of n characters, longer ones last."""
    short, plain = n // parts, parts - n % parts
    return i * short + np.maximum(0, i - plain), short + (i >= plain)


def allowed(n, max_edits: int):
    """Edits within which lines count as repeats, by the characters of the shorter one."""
    return np.minimum(max_edits, n // CHARS_PER_EDIT)


def slots(edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings that may equal a segment of a shorter or equally long line:
    a shift is no more than the edits that fit left of the segment, nor right of it.  A line's own segments
    (no difference, no shift) are not among them."""
    return [(less, i, shift) for less in range(edits + 1) for i in range(edits + 1)
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1) if less or shift]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the hash's base and of its inverse, modulo 2 ** 64."""
    while len(_POWER[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            top = np.uint64(pow(base, len(_POWER[k]), 1 << 64))
            _POWER[k] = np.concatenate([_POWER[k], _POWER[k] * top])
    return _POWER[0], _POWER[1]


def line_keys(lines: list[str], max_edits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the keys of its own segments (``max_edits + 1`` columns), then those of the other substrings it probes
    for (0 where there is none), and a parity sketch.

    A key hashes (length, segment number, text) from running polynomial sums; the length also tells into how many
    segments a line is cut.  The sketch holds the parity of 64 classes of character pairs: an edit touches at most two
    pairs and makes at most two."""
    n = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(n) - n
    power, inverse = _powers(int(n.max(initial=0)) + 1)
    local = np.arange(len(code)) - np.repeat(start, n)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(code * power[local])])

    def key(length: np.ndarray, i: int, at: np.ndarray, size: np.ndarray, some: np.ndarray) -> np.ndarray:
        at, size = np.where(some, at, 0), np.where(some, size, 0)
        h = (sums[start + at + size] - sums[start + at]) * inverse[at]
        h = (h ^ (length.astype(np.uint64) * np.uint64(64) + np.uint64(i + 1))) * MIX
        return np.where(some, np.maximum((h ^ h >> np.uint64(29)) * MIX, np.uint64(1)), np.uint64(0))

    own = [np.zeros(len(lines), dtype=np.uint64) for _ in range(max_edits + 1)]
    probes = []
    for edits in range(1, max_edits + 1):
        mine = allowed(n, max_edits) == edits
        for i in range(edits + 1):
            own[i] |= key(n, i, *_segment(n, i, edits + 1), mine)
        for less, i, shift in slots(edits):
            shorter = np.maximum(n - less, 0)
            at, size = _segment(shorter, i, edits + 1)
            at = at + shift
            probes.append(key(shorter, i, at, size, (allowed(shorter, max_edits) == edits) & (at >= 0) & (at + size <= n)))
    pair = np.append((code[:-1] * MIX + code[1:]) * MIX, np.uint64(0)) >> np.uint64(58)
    last = start + n - 1
    bit = np.uint64(1) << pair
    bit[last] = 0  # no pair across two lines
    return np.stack(own + probes, axis=1), np.bitwise_xor.reduceat(bit, start)


def within(a: str, b: str, k: int) -> bool:
    """Edit distance of at most ``k``.  Common ends are dropped; the rest runs through a bit-parallel
    recurrence over a diagonal band of 2k + 1 cells, kept as vertical differences."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    while a and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    if not a:
        return len(b) <= k
    # equal characters in front of both change no distance and fill the first band
    a, b = "\0" * k + a, "\0" * k + b
    width = 2 * k + 2
    full = (1 << width) - 1
    where: dict[str, int] = {}
    for r, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << r
    # the band of a column is ``width`` rows of a, its last one k + 1 below the diagonal's start; a set
    # bit of up (down) says that a row's cost is one more (less) than the row's above
    up, down = full & ~((1 << k + 1) - 1), 0
    cost, edge = k, 1 << width - 2
    for j, c in enumerate(b):
        first = j + k + 1 - width
        mask = where.get(c, 0)
        match = (mask >> first if first >= 0 else mask << -first) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        right_up = (down | ~(same | up)) & full
        right_down = same & up
        if j < len(a) - k:  # follow the band's last row along the diagonal, to the last row of a
            cost += not same >> width - 1
        else:               # and then that row to its end
            cost += bool(right_up & edge) - bool(right_down & edge)
            edge >>= 1
        up = (right_down | ~(same >> 1 | right_up)) & full
        down = same >> 1 & right_up
    return cost <= k


# ------------------------------------------------------------------ tables
def _lines(text: str) -> Iterator[tuple[int, str]]:
    for number, line in enumerate(text.split("\n")):
        line = normal(line)
        if line:
            yield number, line


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, h1, h2) of every line that is not blank."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where(F.col("body").isNotNull())
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_BYTES):
                out = [(k, n, line) for k, t in enumerate(part.column(1).to_pylist()) for n, line in _lines(t)]
                if out:
                    k, n, line = zip(*out)
                    h = line_hashes(line)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(k)), pa.array(n, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                        ["id", "line", "h1", "h2"])

    return kept.mapInArrow(run, f"id {kind}, line int, h1 long, h2 long")


def _distinct_lines(docs: DataFrame, text_col: str, made, schema: str, wanted=None) -> DataFrame:
    """Rows of ``made(h1, lines)`` for the distinct lines of each slice of documents that may have an edit."""
    kept = docs.select(F.col(text_col).alias("body")).where(F.col("body").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if wanted is None else np.frombuffer(wanted.value, dtype=np.uint64)
        for batch in batches:
            for part in text_slices(batch, 0, SLICE_BYTES):
                lines = list({line for t in part.column(0).to_pylist() for _, line in _lines(t) if len(line) >= CHARS_PER_EDIT})
                h = line_hashes(lines)[:, 0]
                if bits is not None:
                    some = np.flatnonzero(_member(bits, h))
                    h, lines = h[some], [lines[i] for i in some]
                if lines:
                    yield made(h, lines)

    return kept.mapInArrow(run, schema)


def _places(h: np.ndarray) -> list[np.ndarray]:
    u = h.view(np.uint64)
    return [(u >> np.uint64(s)) & np.uint64((1 << FILTER_BITS) - 1) for s in (0, 32)]


def _member(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    for place in _places(h):
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)) > 0
    return out


def _bit_filter(ids: DataFrame) -> bytes:
    """Bloom filter of a column of hashes: 2 ** FILTER_BITS bits (4 MB) whatever the number of rows.
    When it fills up it lets more lines through; the join behind it keeps the result exact."""
    low = (1 << FILTER_BITS) - 1
    place = F.explode(F.array(F.col("h1").bitwiseAND(low), F.shiftrightunsigned("h1", 32).bitwiseAND(low)))
    words = (ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow())
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return bits.tobytes()


def line_links(docs: DataFrame, text_col: str = "text", max_edits: int = MAX_EDITS) -> DataFrame:
    """(a, b): verified pairs of different normalised lines within their allowed edits, by hash, a < b."""
    spark = docs.sparkSession
    n_index = max_edits + 1

    def signed(h: np.ndarray, lines: list[str]) -> pa.RecordBatch:
        keys, sketch = line_keys(lines, max_edits)
        rows = np.hstack([sketch[:, None], keys])
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * rows.shape[1]), len(rows), [None, pa.py_buffer(rows.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(h), packed.cast(pa.binary())], ["h1", "keys"])

    marked = shared_table(_distinct_lines(docs, text_col, signed, "h1 long, keys binary")
                          .groupBy("h1").agg(F.max("keys").alias("keys")), "line-keys")

    def side(columns: slice) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, 1, SLICE_BYTES):
                    rows = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.int64).reshape(part.num_rows, -1)
                    keys = rows[:, columns]
                    at, slot = np.nonzero(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at, slot]), pa.array(part.column(0).to_numpy()[at]), pa.array(rows[at, 0])], ["key", "h", "sketch"])
        return marked.mapInArrow(run, "key long, h long, sketch long")

    # lines of one length meet in their own segments: that side is shuffled once and read by both joins
    own, probes = side(slice(1, 1 + n_index)), side(slice(1 + n_index, None))
    # each edit flips at most four parities
    near = F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= 4 * max_edits
    met = [unsent(own).alias("x").join(other.alias("y"), F.col("x.key") == F.col("y.key"))
           .where((F.col("x.h") < F.col("y.h") if other is own else F.col("x.h") != F.col("y.h")) & near)
           .select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b")) for other in (own, probes)]
    pairs = shared_table(met[0].union(met[1]).distinct(), "line-candidates")
    discard(marked)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h1"))
    wanted = spark.sparkContext.broadcast(_bit_filter(ends))

    def bodies(h: np.ndarray, lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(lines, pa.string())], ["h1", "body"])

    texts = shared_table(_distinct_lines(docs, text_col, bodies, "h1 long, body string", wanted)
                         .join(ends.distinct(), "h1", "left_semi").dropDuplicates(["h1"]), "line-texts")
    both = (unsent(pairs).join(texts.select(F.col("h1").alias("a"), F.col("body").alias("x")), "a")
            .join(unsent(texts.select(F.col("h1").alias("b"), F.col("body").alias("y"))), "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = pa.array([within(s, t, int(allowed(min(len(s), len(t)), max_edits))) for s, t in zip(x, y)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    links = shared_table(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "line-links")
    wanted.destroy()
    discard(pairs, texts)
    return links


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS) -> DataFrame:
    """One row per line that is not blank: id, ``line`` (number from 0, at
    the newline characters), ``first_id`` and ``first_line`` (the line of its class that stays) and
    ``links`` (other distinct lines within the edits that its length allows).

    Null, empty and blank texts have no lines.  Ids sort before null.  Rows that repeat an id are one
    document: their lines have the same (id, number) and stay together.  An empty table gives an
    empty result; other columns are ignored."""
    lines = shared_table(line_table(docs, id_col, text_col), "lines")
    found = line_links(docs, text_col, max_edits)
    label = component_labels(found)
    ends = found.select(F.explode(F.array("a", "b")).alias("h1")).groupBy("h1").agg(F.count(F.lit(1)).alias("links"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "line")
    first = lines.groupBy("h1", "h2").agg(F.min(place).alias("place"))
    first = (first.join(unsent(label.withColumnRenamed("node", "h1")), "h1", "left").join(unsent(ends), "h1", "left")
             # exact copies alone share both hashes; linked lines share the label of the first hash
             .withColumn("c1", F.coalesce("label", "h1")).withColumn("c2", F.when(F.col("label").isNull(), F.col("h2")).otherwise(0)))
    least = first.groupBy("c1", "c2").agg(F.min("place").alias("least"))
    first = first.join(least, ["c1", "c2"]).select("h1", "h2", "least", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return unsent(lines).join(first, ["h1", "h2"]).select(
        F.col("id").alias(id_col), "line", F.col("least.id").alias("first_id"), F.col("least.line").alias("first_line"), "links")


def dropped_lines(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, drop): the sorted numbers of the lines that go, for documents with any."""
    gone = ~(F.col(id_col).eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line")))
    return lines.where(gone).groupBy(id_col).agg(F.sort_array(F.collect_set("line")).alias("drop"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS) -> DataFrame:
    """``docs`` with the repeated lines cut out of the text; all rows stay, a text may become empty, and
    other columns are unchanged."""
    names = docs.columns
    drop = shared_table(dropped_lines(repeated_lines(docs, id_col, text_col, max_edits), id_col)
                        .select(F.col(id_col).alias("__id"), F.col("drop").alias("__drop")), "line-drops")
    line = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(line, lambda _, i: ~F.array_contains(F.col("__drop"), i))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    # the list of drops has no size bound, so it is not broadcast
    return (docs.join(unsent(drop), F.col(id_col).eqNullSafe(F.col("__id")), "left")
            .withColumn(text_col, text).select(*names))
