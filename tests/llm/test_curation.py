"""Importance resampling, source mixing and conversation repair, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewater.llm import dialogue, importance, mixing

ROWS = "conv_id long, turn long, role string, text string, conv string, digest string, n long"


# ---------------------------------------------------------------- conversation repair
def plain_repair(rows):
    """All edit strings of a conversation, cheapest first, by exhaustive search over (row, state)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {(0, ""): (0, "", [])}  # (rows read, state) -> cost, audit, lines; every relaxation is tried until none helps
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for state in ("", "s", "u", "a"):
                if (i, state) in best:
                    cost, audit, lines = best[i, state]
                    to = after[state]
                    new = (cost + 5, audit + "I", [*lines, ("user:" if to == "u" else "assistant:")])
                    best[i, to] = min(best.get((i, to), new), new, key=lambda v: v[:2])
        if i == len(rows):
            break
        _, role, text = rows[i]
        for state in ("", "s", "u", "a"):
            if (i, state) not in best:
                continue
            cost, audit, lines = best[i, state]
            ways = [(state, (cost + 2, audit + "D", lines))]
            if faults[i] in ("", "truncated"):
                more, to = 5 * (faults[i] == "truncated"), after[state]
                name = "user" if to == "u" else "assistant"
                ways.append((to, (cost + 1 + more, audit + "R", [*lines, f"{name}:{text}"])))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    ways.append((role[:1], (cost + more, audit + "K", [*lines, f"{role}:{text}"])))
            for to, new in ways:
                best[i + 1, to] = min(best.get((i + 1, to), new), new, key=lambda v: v[:2])
    cost, audit, lines = min((best[len(rows), s] for s in ("", "a") if (len(rows), s) in best), key=lambda v: v[:2])
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(seed, n, most):
    r, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.randint(0, most)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "student", ""])
            text = r.choice(["Yes.", "No!", "cut off", "  ", "", "Why?\n", "same.", f"line {turn}.", "é ü."])
            out.append((conv, None if r.random() < 0.05 else turn + r.choice([0, 0, 0, 3]), role, text))
            if r.random() < 0.1:
                out.append(out[-1])
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], ROWS).repartition(parts)


def results(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("block_rows", [2, 1000])
def test_repair_equals_exhaustive_search(spark, block_rows):
    """Also with blocks of two rows: joined blocks give the audits of whole conversations."""
    rows = conversations(1, 150, 7) + [(900, t, r, f"{t} a.") for t, r in enumerate(random.Random(2).choices(["user", "assistant", "bot"], k=60))]
    got = results(dialogue.repair(frame(spark, rows), block_rows=block_rows))
    by = defaultdict(list)
    for conv, *row in rows:
        by[conv].append(tuple(row))
    assert got.keys() == by.keys()
    for conv, own in by.items():
        assert got[conv] == plain_repair(own), conv


def test_repair_odd_rows(spark):
    long = "word " * 50_000 + "end."
    rows = [(None, 0, "user", "No id."), (None, 1, "assistant", "Here."), (1, None, None, None), (1, None, "user", "Hm."), (1, 1, "assistant", "So."),
            (2, 0, "user", long), (2, 1, "assistant", long), *[(3, 0, "user", "Copy.")] * 50, (4, 0, "assistant", "")]
    got = results(dialogue.repair(frame(spark, rows), block_rows=8))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[None][4:7] == (0, 0, "KK")
    assert got[1] == plain_repair([(None, " ", " "), (None, "user", "Hm."), (1, "assistant", "So.")])
    assert got[2][5:] == (0, "KK", hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest())
    assert got[3] == plain_repair([(0, "user", "Copy.")] * 50)
    assert got[4] == (0, 1, 0, 0, 0, 2, "D", empty)
    assert dialogue.repair(frame(spark, rows).limit(0)).collect() == []


def test_repair_keeps_conversations_whose_rows_all_go(spark):
    rows = frame(spark, [(5, 0, "user", "Gone."), (6, 0, "user", "Hi."), (6, 1, "assistant", "Hi.")])
    got = results(dialogue.repair(rows, copies=(rows.conv_id != 5).cast("int")))
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()), 6: plain_repair([(0, "user", "Hi."), (1, "assistant", "Hi.")])}


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No!") for c in range(40) for t in range(5)]
    damaged, copies = dialogue.damage(frame(spark, rows))
    got = {(r.conv_id, r.turn): (r.role, r.text, r.copies) for r in damaged.select("conv_id", "turn", "role", "text", copies).collect()}
    for c, t, role, text in rows:
        code = zlib.crc32(f"{c}:{t}".encode()) % 20
        want = ("user" if code == 4 else role, {1: "", 2: "Yes No"}.get(code, text), {0: 0, 3: 2}.get(code, 1))
        assert got[c, t] == want


def test_audits_compare_like_strings_even_where_hashes_collide():
    r = random.Random(3)
    for modulus in (3, 7, dialogue.MODULUS):
        audits, nodes = dialogue.Audits(modulus), {0: ""}
        for _ in range(300):
            parent = r.choice(list(nodes))
            letter = r.choice(["D", "I", "K", "R"])
            nodes[audits.extend(parent, letter)] = nodes[parent] + letter
        for _ in range(2_000):
            a, b = r.choices(list(nodes), k=2)
            assert audits.before(a, b) == (nodes[a] < nodes[b]), (modulus, nodes[a], nodes[b])
            assert "".join(audits.pieces(a)) == nodes[a]


# ---------------------------------------------------------------- importance resampling
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n, buckets):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    grams = [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % buckets for g in grams)


def plain_resample(docs, target, n, buckets, percent, least):
    each = [(i, *plain_features(t, n, buckets)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in each:
        s.update(f)
    for text in target:
        t.update(plain_features(text, n, buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, words, f in each:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        rows.append((i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(able) // 100
    return Counter([(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < least])


TEXTS = ["The cat sat.\nOn the mat\n\nthe cat", "ÀB the; cat_sat 3x", "the\ncat\nsat\non", "same line here\nsame line here\nother", None, "",
         "\n\n", "one", "α β\nγ δ the cat", "w " * 5_000, "same line here\n" * 300]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resample_equals_plain_features(spark, make, n):
    r = random.Random(n)
    texts = TEXTS + ["\n".join(" ".join(r.choices(["the", "cat", "Sat", "on", "mat", "déjà", "7"], k=r.randint(0, 6))) for _ in range(r.randint(1, 5)))
                     for _ in range(60)]
    docs = [*enumerate(texts), (3, "the cat sat on the mat"), (None, "no id at all here")]
    target = ["the cat sat on\nthe mat", "déjà vu", None]
    got = importance.resample(make(docs), make(target).drop("doc_id"), n=n, buckets=97, percent=30, min_words=4)
    rows = Counter(tuple(x) for x in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert rows == plain_resample(docs, target, n, 97, 30, 4)


def test_resampling_query_weighs_by_the_floored_mean(spark, tmp_path):
    from tidewater.llm import queries
    r = random.Random(8)
    vocabulary = ["the", "cat", "Sat", "on", "mat", "déjà", "7", "Z"]
    texts = [*TEXTS, *(" ".join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(80))]
    docs, target = [*enumerate(texts), (3, "the cat sat " * 9), (None, "no id at all here")], ["the cat sat on\nthe mat", "déjà vu", None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    each = [(i, *plain_features(t, 1, 10_000)) for i, t in docs]
    s, t = sum((f for *_, f in each), Counter()), sum((plain_features(x, 1, 10_000)[1] for x in target), Counter())
    big_s, big_t = s.total() + 10_000, t.total() + 10_000
    rows = []
    for i, n, f in each:
        gains = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) * c for b, c in f.items())
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = gains // n if n else 0
        rows.append((i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in rows if x[1] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    want = Counter([(*x, k + 1 if k < len(able) // 10 else None) for k, x in enumerate(able)] + [(*x, None) for x in rows if x[1] < 20])
    got = queries.op11_resampling(spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank")
    assert {kind for _, kind in got.dtypes} == {"bigint"}
    assert any(x[2] < 0 for x in rows) and Counter(tuple(x) for x in got.collect()) == want


def test_resample_empty_tables(spark, make, empty):
    assert importance.resample(empty, make(["a b"])).collect() == []
    only = importance.resample(make(["a b", "c"]), empty, min_words=1, percent=50).collect()
    assert sorted((r.n_features, r.rank) for r in only) == [(1, None), (2, 1)] or sorted((r.n_features, r.rank or 0) for r in only) == [(1, 1), (2, 0)]


# ---------------------------------------------------------------- mixing
def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = float(most * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


def sources_of(spark, seed=5, n=400):
    r = random.Random(seed)
    rows = [(i, "w " * r.choice([0, 1, 3, 10, 40]), "en", r.choice(["hot"] * 6 + ["a", "ä", "z", "日", None]), None, 1, "x", "y", 2) for i in range(n)]
    rows += [(None, "no id", "en", "a", None, 1, "x", "y", 2), (7, None, "en", "a", None, 1, "x", "y", 2), (8, "", "en", "void", None, 1, "x", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, shard string, target string, size long"), rows


def test_mix_meets_targets_with_exact_quotas(spark):
    docs, rows = sources_of(spark)
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len((row[1] or "").split())
    want = plain_targets(sizes)
    out = mixing.mix(docs, n_shards=5, blocks=64, rows_per_bucket=20).collect()
    assert len({r.row for r in out}) == len(rows)
    taken, most = Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        if r.shard is not None:
            taken[r.source] += r.size
            most[r.row] += 1
    assert max(most.values()) <= 3
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 20.5, s  # half of the largest text
    # a block of a source is in one shard, and shards have the same number of blocks but for rounding
    at = defaultdict(set)
    for r in out:
        if r.shard is not None:
            at[r.source, r.block].add(r.shard)
    assert all(len(s) == 1 for s in at.values())
    for shard in range(5):
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own))) and own


def test_mix_reruns_agree_and_use_no_python(spark):
    docs, _ = sources_of(spark, 6)
    first = mixing.mix(docs, rows_per_bucket=20)
    again = mixing.mix(docs.repartition(7), rows_per_bucket=20)
    cols = ["doc_id", "source", "size", "pass", "block", "shard", "slot"]
    assert Counter(tuple(r) for r in first.select(cols).collect()) == Counter(tuple(r) for r in again.select(cols).collect())
    assert not re.search("Python|Arrow|Pandas", first._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_split_tree_quotas_are_balanced(spark, shards):
    tickets = spark.createDataFrame([(False, s, b) for s, q in (("a", 300), ("b", 45), ("c", 2)) for b in range(q)], "none boolean, source string, block int")
    got = Counter(r.shard for r in mixing.split_tree(tickets, shards, 1).collect())
    assert sum(got.values()) == 347 and set(got) == set(range(shards)) and max(got.values()) - min(got.values()) <= 3


def test_mix_odd_tables(spark, odd, empty):
    assert mixing.mix(empty).collect() == []
    out = mixing.mix(odd, n_shards=3).collect()
    taken = sum(r.size for r in out if r.shard is not None)
    assert abs(taken - out[0].target) <= 15_000 and out[0].target == out[0].source_size
    assert {r.doc_id for r in out} >= {None, 0, 1}
