"""SimHash, exact and line dedup against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import exact, linedup, queries, simhash
from tidewater.llm.common import shared_table
from tidewater.llm.components import component_labels

SF = "/root/testdata/sf0.001"


def components(nodes, linked):
    """Smallest reachable node by breadth-first search over ``linked(a, b)``."""
    left, out = sorted(nodes), {}
    while left:
        group, todo = set(), [left[0]]
        while todo:
            a = todo.pop()
            if a not in group:
                group.add(a)
                todo += [b for b in left if b not in group and linked(a, b)]
        out.update(dict.fromkeys(group, left[0]))
        left = [n for n in left if n not in group]
    return out


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(rows):
    fp = {i: plain_fingerprint(t) for i, t in rows}
    group = components(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in fp.items():
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    return {(i, f"{f:016x}", least.get(group[f])) for i, f in fp.items()}


def test_simhash_query_is_the_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op1_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert len(got) == len(docs)
    assert {tuple(r) for r in got} == plain_simhash(docs)


def test_simhash_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == plain_simhash(rows)
    zero = {r.doc_id for r in got if r.fingerprint == "0" * 16}
    assert {0, 1, 2, 3} <= zero and {r.component_id for r in got if r.doc_id in zero} == {0}
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).columns == empty.columns


def test_keep_first_drops_all_but_the_smallest_id(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert 0 in ids and not {1, 2, 3, 9} & set(ids) and None in ids


def test_majority_bits_counts_long_groups():
    rng = np.random.default_rng(1)
    counts = np.array([1, 254, 255, 256, 1000, 2])
    h = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    want, at = [], 0
    for n in counts.tolist():
        part = h[at:at + n].tolist()
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > n))
        at += n
    assert simhash.majority_bits(h, counts).tolist() == want


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_golay_keys_meet_for_every_pair_within_three_bits(bits):
    rng = random.Random(bits)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = [x ^ sum(1 << k for k in rng.sample(range(64), bits)) for x in a]
    ra, ka = simhash.bucket_keys(np.array(a, dtype=np.uint64), False)
    rb, kb = simhash.bucket_keys(np.array(b, dtype=np.uint64), True)
    met = {r for r, _ in set(zip(ra.tolist(), ka.tolist())) & set(zip(rb.tolist(), kb.tolist()))}
    assert len(met) == len(a)


def test_links_are_all_pairs_within_the_distance(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fp = {(x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5)))) for x in base for _ in range(6)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fp]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_components_of_paths_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 200), (5, 5)]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + k: 100 for k in range(30)}, 200: 200, 300: 200}
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- exact
def plain_exact(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_exact_groups_across_partitions(spark, make):
    rng = random.Random(2)
    texts = ["one large\tgroup" if rng.random() < 0.4 else f"text  {rng.randrange(150)}" for _ in range(800)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact.duplicate_groups(make(texts, 5)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(map(tuple, got), key=str) == plain_exact(list(enumerate(texts)))


def test_exact_groups_are_texts_even_where_digests_are_equal(spark, make):
    """All digests forced equal, all texts with one start: only the comparison of whole texts tells them apart."""
    rng = random.Random(8)
    texts = ["the same start of every text, longer than its key " + rng.choice("abcde") for _ in range(300)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact.duplicate_groups(make(texts, 5), digest=lambda body: F.lit("0" * 64)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    first, size = {}, {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
        size[t] = size.get(t, 0) + 1
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, first[t], size[t]) for i, t in enumerate(texts)}


def test_exact_odd_rows(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(tuple, exact.duplicate_groups(odd).collect()), key=str) == plain_exact(rows)
    assert exact.duplicate_groups(empty).count() == 0


# ---------------------------------------------------------------- lines
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n, alphabet):
    out = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0:
            out.insert(p, rng.choice(alphabet))
        elif out and p < len(out):
            out[p:p + 1] = [] if kind == 1 else [rng.choice(alphabet)]
    return "".join(out)


def test_banded_distance_is_the_full_one():
    rng = random.Random(3)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(15)))
        b = edited(rng, a, rng.randrange(5), "ab")
        for k in (1, 2, 3):
            assert linedup.within(a, b, k) == (edits(a, b) <= k), (a, b, k)


def test_segment_keys_meet_and_sketches_agree_within_the_edits():
    rng = random.Random(4)
    for edits_ in (1, 2, 3):
        pairs = []
        while len(pairs) < 1200:
            a = "".join(rng.choice("abc") for _ in range(rng.randrange(8, 60)))
            pair = sorted((a, edited(rng, a, rng.randrange(edits_ + 1), "abc")), key=len)
            if pair[0] != pair[1] and edits(*pair) <= linedup.allowed(len(pair[0]), edits_):
                pairs.append(pair)
        short, sketch = linedup.line_keys([x for x, _ in pairs], edits_)
        long, other = linedup.line_keys([x for _, x in pairs], edits_)
        for k, pair in enumerate(pairs):
            assert set(short[k, :edits_ + 1].tolist()) & set(long[k].tolist()) - {0}, pair
            assert (int(sketch[k]) ^ int(other[k])).bit_count() <= 4 * edits_


def test_keys_depend_on_length_segment_and_text_only():
    keys, _ = linedup.line_keys(["a" * 30, "b" * 40, "a" * 30, "a" * 31], 2)
    assert keys[0].tolist() == keys[2].tolist() and len(set(keys[0, :3].tolist())) == 3
    assert not set(keys[0, :3].tolist()) & set(keys[3, :3].tolist())
    none, _ = linedup.line_keys(["short line", "a line of 15 ch"], 2)
    assert not none[0].any() and np.count_nonzero(none[1, :3]) == 2  # one edit: two segments
    assert set(keys[0, :3].tolist()) < set(keys[3, 3:].tolist())  # the longer line probes for the shorter one


def plain_lines(rows):
    """(id, line, first id, first line) by comparing all pairs of distinct lines."""
    at = [(i, n, linedup.normal(x)) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    at = [x for x in at if x[2]]
    limit = lambda a, b: min(2, min(len(a), len(b)) // 12)
    near = lambda a, b: a == b or abs(len(a) - len(b)) <= limit(a, b) and linedup.within(a, b, limit(a, b))
    group = components({x for *_, x in at}, near)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    first = {}
    for i, n, x in sorted(at, key=order):
        first.setdefault(group[x], (i, n))
    return {(i, n, *first[group[x]]) for i, n, x in at}


def test_line_classes_are_the_plain_ones(make):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 70))) for _ in range(35)]
    texts = ["\n".join(edited(rng, rng.choice(base), rng.randrange(4), "abc") for _ in range(rng.randrange(6))) for _ in range(60)]
    got = linedup.repeated_lines(make(texts)).collect()
    assert {tuple(r)[:4] for r in got} == plain_lines(list(enumerate(texts)))


def test_lines_odd_rows(odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = linedup.repeated_lines(odd).collect()
    assert {tuple(r)[:4] for r in got} == plain_lines(rows)
    assert linedup.repeated_lines(empty).count() == 0 and linedup.without_repeats(empty).count() == 0


def test_without_repeats_keeps_the_first_line(make):
    line = "This line is long enough to count"
    docs = make([f"{line}\nshort\n\nother", f"head\n  {line.upper()}!\ntail", None, line])
    out = {r.doc_id: r.text for r in linedup.without_repeats(docs).collect()}
    assert out == {0: f"{line}\nshort\n\nother", 1: "head\ntail", 2: None, 3: ""}
    assert linedup.without_repeats(docs).columns == docs.columns


def test_line_query_on_a_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    plain = plain_lines(docs)
    gone = {(i, n, a, b) for i, n, a, b in plain if (i, n) != (a, b)}
    got = queries.op9_line_dedup(spark, SF).collect()
    assert len(got) == len(docs)
    assert {(r.doc_id, *x) for r in got for x in zip(r.dropped_lines, r.class_doc_ids, r.class_lines)} == gone
    assert spark.read.parquet(f"{SF}/documents.parquet").where(F.col("text").isNull()).count() == 0


def test_line_query_reports_the_document_without_an_id(spark, make, tmp_path):
    line = "This line is long enough to count"
    make([line, (None, f"{line}\nAnother line that is long enough\n{line}"), (2, "short")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert {i: r.lines for i, r in got.items()} == {0: 1, None: 3, 2: 1}
    assert (got[None].dropped_lines, got[None].class_doc_ids, got[None].class_lines) == ([0, 2], [0, 0], [0, 0])


def test_simhash_keys_are_not_broadcast(spark):
    """A fingerprint makes up to 48 keys, which Spark's estimate leaves out: a table of any size is shuffled."""
    fps = [(x, x) for x in (7, 6, 31 << 40, (31 << 40) + 3)]
    nodes = shared_table(spark.createDataFrame(fps, "fp long, first long"), "test-nodes")
    pairs = simhash.links(nodes)
    assert "Broadcast" not in pairs._jdf.queryExecution().toString()
    assert {tuple(r) for r in pairs.collect()} == {(6, 7), (31 << 40, (31 << 40) + 3)}
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (None, "x")], "doc_id long, text string")
    assert sorted(r["component_id"] or 0 for r in simhash.near_duplicates(docs).collect()) == [0, 1, 1]


def test_line_tables_are_not_broadcast(spark, monkeypatch):
    """Each line makes up to 19 rows of segments and repeated lines pack well, so estimates say little of the size."""
    plans = {}

    def written(df, tag, *more):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return shared_table(df, tag, *more)

    monkeypatch.setattr(linedup, "shared_table", written)
    docs = spark.createDataFrame([(1, "The same long line of text here\nanother one, quite different"),
                                  (2, "The same long line of test here\nsomething else"), (3, None)], "doc_id long, text string")
    rows = shared_table(linedup.repeated_lines(shared_table(docs, "test-docs")), "test-lines")
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, 1, 0, 1), (1, 1, 1, 1, 0), (2, 0, 1, 0, 1), (2, 1, 2, 1, 0)]
    assert {t for t, plan in plans.items() if "Broadcast" in plan} <= {"line-texts"}
    assert plans["line-candidates"].count("SortMergeJoin") >= 2 and plans["line-links"].count("SortMergeJoin") >= 2
