"""Byte-level BPE, decontamination, licences, sharding and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidewater.llm import bpe, decontam, licenses, linedup, queries, sharding

SF = "/root/testdata/sf0.001"
VOCABULARY = P.path(queries.VOCABULARY)


@pytest.fixture(scope="module")
def coder():
    with open(VOCABULARY, "rb") as fh:
        return bpe.ByteBpe(fh.read(), P.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_random_texts_encode_like_the_library(coder, reference):
    rng = random.Random(1)
    alphabet = "ab eé\n\t   ñ1 .!'s日本\x0b\x1c　 x\r\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(300))) for _ in range(800)]
    texts += ["a" * 3000, " " * 700, "x\n \n y", "<|endoftext|>", "don't I'll", "ab" * 700 + "\n" * 300, "", " ", "ababab" * 40 + " cd"]
    for a in range(0, len(texts), 100):
        for t, got in zip(texts[a:a + 100], coder.encode(texts[a:a + 100])):
            assert ids(got) == reference.encode_ordinary(t), t[:60]


def test_long_rows_merge_like_short_ones(coder):
    rng = random.Random(2)
    rows = ["".join(rng.choice("abcdest") for _ in range(rng.randrange(2, 250))).encode() for _ in range(60)]
    assert [coder._long(r).astype("<u4").tobytes() if r not in coder.ranks else None for r in rows] == [
        x if r not in coder.ranks else None for r, x in zip(rows, coder.merge(rows))]


def test_pair_table_finds_every_pair(coder):
    left = np.array([coder.ranks[b"t"], 5, -1, coder.ranks[b"t"]])
    right = np.array([coder.ranks[b"h"], -1, 5, coder.ranks[b"\xff"]])
    got = coder.pairs(left, right)
    assert got[0] == coder.ranks[b"th"] and (got[1:] == 2**31 - 1).all()


def test_bpe_query_is_the_library(spark, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        want = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_odd_rows(odd, empty):
    texts = odd.select("doc_id", "text").collect()
    got = bpe.transcode(odd, VOCABULARY, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in got) == Counter((r.doc_id, r.text or "") for r in texts)
    assert bpe.digests(bpe.transcode(empty, VOCABULARY, P.PATTERN)).count() == 0


# ---------------------------------------------------------------- decontamination
def item(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n)) + ". " + " ".join(rng.choice(pool) for _ in range(6)) + "."


@pytest.fixture(scope="module")
def planted(spark, make):
    rng = random.Random(9)
    pool = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    items = [item(rng, rng.randrange(12, 40), pool) for _ in range(60)] + [item(rng, 150, pool)]
    noise = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    texts, want = [], set()
    for k, t in enumerate(items):
        texts.append(f"{noise(rng.randrange(200))} {t} {noise(40)}")
        words = t.split()
        for p in rng.sample(range(len(words)), len(words) // 5):  # one word in five replaced
            words[p] = rng.choice(pool)
        texts.append(f"{noise(30)}\n{' '.join(words).upper()}\n{noise(90)}")
        want |= {(2 * k, k), (2 * k + 1, k)}
    texts += [noise(300) for _ in range(40)] + [" ".join(rng.sample(items[0].split(), len(items[0].split())))]
    bench = spark.createDataFrame([(k, t, 1) for k, t in enumerate(items)], "item_id long, text string, item long")
    return make(texts), bench, want


def test_copies_and_edited_copies_are_found_and_no_others(planted):
    docs, bench, want = planted
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect()}
    assert len(want & got) >= 0.97 * len(want) and not got - want
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in got})


def test_edited_copies_of_an_item_in_a_third_of_the_passages_are_found(spark, make):
    rng = random.Random(12)
    pool = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(3000)]
    items = [item(rng, 24, pool) for _ in range(40)]
    rare = [x for t in items[1:] for x in decontam.words(t)]
    noise = lambda n, of=pool: " ".join(rng.choice(of) for _ in range(n))
    texts = []
    for k in range(1200):
        words = items[0].split()
        for p in rng.sample(range(len(words)), 9 if k < 60 else 0):  # three words in ten replaced
            words[p] = rng.choice(pool)
        # the rest of the window is other items' words
        texts.append(f"{noise(30, rare)} {' '.join(words)} {noise(4, rare)}" if k < 400 else noise(64))
    bench = decontam.Benchmark(list(enumerate(items)))

    def found(text):
        w = np.array([bench.unigrams.get(x, -1) for x in decontam.words(text)], dtype=np.int64)
        return {k for k, p, tail in bench.pieces for s in range(0, len(w) + decontam.WINDOW, decontam.STRIDE) if decontam.verify(p, tail, w, s)}

    want = {(i, k) for i, t in enumerate(texts) for k in found(t)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert sum(i < 60 for i, _ in want) >= 50 and got == want


def test_decontamination_query_finds_every_verbatim_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontamination(spark, SF).collect()}
    assert want and want <= got
    for d, i in got - want:  # the rest: every word of the item in order
        text = next(x.text for x in docs if x.doc_id == d)
        words = iter(decontam.words(text))
        assert sum(w in words for w in decontam.words(next(b.text for b in bench if b.item_id == i))) >= 5


def test_decontamination_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text here"), (1, "same text here"), (2, None), (3, ""), (4, "..."), (None, "text without an id")],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, bench).collect()}
    assert got == {(8, 1), (9, 1)}
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0


def test_sums_go_through_a_tree(spark):
    parts = spark.createDataFrame([(k, np.array([1.0, k]).tobytes()) for k in range(100)], "part int, sum binary")
    assert decontam.total(parts).tolist() == [100.0, 4950.0]
    assert len(decontam.total(parts.limit(0))) == 0


def test_windows_hold_words_of_one_text_only():
    texts = [np.arange(n, dtype=np.int32) % 26 for n in (1, 63, 64, 65, 200, 0, 31, 33)]
    for stride in (decontam.STRIDE, decontam.WINDOW):
        (ids, starts, first), = decontam.joined([t.tobytes() for t in texts], stride)
        assert first == 0 and all(s % stride == 0 for s in starts)
        for t, s in zip(texts, starts.tolist()):
            for w in range(0, len(t), stride):
                own = ids[s + w:s + w + decontam.WINDOW]
                assert own[own >= 0].tolist() == t[w:w + decontam.WINDOW].tolist()


def test_nothing_is_found_without_the_latent_search(planted):
    docs, bench, want = planted
    assert decontam.contaminated(docs, bench, near=1e9).count() == 0
    assert len({(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, near=0.9).collect()} & want) < 0.9 * len(want)


def test_latent_recall_on_many_pieces_against_checking_all(spark, make):
    """1,200 pieces; copies with three words in ten replaced, one item in a third of the texts."""
    rng = random.Random(14)
    pool = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(4000)]
    common = pool[:150]  # words that every text and item uses
    word = lambda: rng.choice(common if rng.random() < 0.4 else pool)
    items = [" ".join(word() for _ in range(rng.randrange(14, 46))) + "." for _ in range(1200)]
    texts = []
    for k in range(600):
        words = items[0 if k % 3 == 0 else k].split()
        for p in rng.sample(range(len(words)), 3 * len(words) // 10):
            words[p] = word()
        texts.append(" ".join([word() for _ in range(rng.randrange(80))] + words + [word() for _ in range(40)]))
    bench = decontam.Benchmark(list(enumerate(items)))
    want = set()
    for i, t in enumerate(texts):
        w = np.array([bench.unigrams.get(x, -1) for x in decontam.words(t)], dtype=np.int64)
        for k in {0, i}:  # other items share no passage with the text
            own = [(p, tail) for item, p, tail in bench.pieces if item == k]
            if any(decontam.verify(p, tail, w, s) for p, tail in own for s in range(0, len(w), decontam.STRIDE)):
                want.add((i, k))
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(make(texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    hot = {x for x in want if x[1] == 0}
    assert len(want) > 450 and len(hot) > 150
    assert len(got & want) >= 0.95 * len(want) and len(got & hot) >= 0.95 * len(hot)


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert decontam.lcs(np.array(a), np.array(b)) == row[-1]


# ---------------------------------------------------------------- licences
def test_licence_rules(make, empty, odd):
    s = licenses.SENTENCES
    docs = make([f"Intro.\n{s[13]}\n{s[14]}. Noise. {s[15]}.\n", f"{s[14]}\n{s[13]}\n{s[15]}", "x. Released under the MIT License. y",
                 f"{s[40]}\n{s[41]}.\n{s[42]}.\n{s[43]}.", "unlicensed text", None, "Licensed under the Apache License,\nversion 2.0.\nLicensed under CC BY-NC 4.0."])
    got = {(r.doc_id, r.license, r.rule, r.sentences) for r in licenses.license_matches(docs).collect()}
    assert got == {(0, "MIT", "mit-text", 3), (2, "MIT", "mit-release", 1), (3, "BSD-2-Clause", "bsd2-text", 3), (3, "BSD-3-Clause", "bsd3-text", 4),
                   (6, "Apache-2.0", "apache-notice", 1), (6, "CC-BY-NC-4.0", "cc-by-nc-notice", 1)}
    assert licenses.license_matches(empty).count() == 0 and licenses.license_matches(odd).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """The MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from this
   software without specific prior written permission."""


def test_published_layouts_of_licences(make):
    texts = [APACHE, MIT, GPL, BSD]
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: " ".join(t.split("\n\n\n")) + "\ncode = 1",
             *[lambda t, c=c: "\n".join(f"{c} {x}".rstrip() for x in t.split("\n")) for c in ("#", "//", " *", ";;")],
             lambda t: "/*\n" + "\n".join(f" * {x}" for x in t.split("\n")) + "\n */\nint x;"]
    docs = make([f(t) for f in forms for t in texts])
    got = {(r.doc_id, r.rule) for r in licenses.license_matches(docs).collect()}
    rules = ["apache-header", "mit-titled", "gpl3-header", "bsd2-text", "bsd3-text"]
    assert got == {(4 * k + min(i, 3), r) for k in range(len(forms)) for i, r in enumerate(rules)}


def test_a_known_sentence_is_whole_and_between_cuts():
    known = licenses.known_sentences
    assert known("a. Licensed under the Apache License, Version 2.0\n# (the License); you may not use this file\n# except in compliance\n# with the License. b") == [(1, 2)]
    assert known("Licensed under the Apache License,\n# Version 2.0\n# and more") == [(0, 1)]
    assert known("See\n# The MIT License. Licensed under the MIT License") == [(1, 12), (2, 11)]
    for text in ("not Licensed under the MIT License.", "Licensed under the MIT License or so.", "Licensed under the MIT Licenses.", "unlicensed under the mit license", "\n\n"):
        assert known(text) == []


# ---------------------------------------------------------------- sharding
def check_shards(rows, shards, tolerance):
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == min(shards, len(rows))
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    whole = Counter(r.stratum for r in rows)
    mixed = Counter((r.shard, r.stratum) for r in rows)
    for s in sizes:
        for x, n in whole.items():
            assert abs(mixed[s, x] - n * sizes[s] / len(rows)) <= tolerance, (s, x)


def test_shards_match_the_mixture_with_a_hot_source(spark):
    rng = random.Random(3)
    rows = [(i, f"t{i}" if i % 7 else None, "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, ""]), 5) for i in range(3001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket long")
    got = sharding.stratified_shards(docs, 8, rows_per_bucket=100).collect()
    assert len(got) == len(rows)
    check_shards(got, 8, 2)
    by = {i: t for i, t, *_ in rows}
    assert all(r.size == len((by[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((by[r.doc_id] or "").encode()) for r in got)
    again = sharding.stratified_shards(docs.repartition(7), 8, rows_per_bucket=100).collect()
    assert sorted(got) == sorted(again)
    one = sharding.stratified_shards(docs, 8, rows_per_bucket=10**6).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in one} == {(r.doc_id, r.shard, r.slot) for r in got}


def test_shards_of_odd_rows(odd, empty):
    got = sharding.stratified_shards(odd).collect()
    assert len(got) == odd.count()
    check_shards(got, 8, 2)
    assert sharding.stratified_shards(empty).count() == 0


def test_sharding_query(spark):
    got = queries.op10_sharding(spark, SF).collect()
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) <= 1


def test_sharding_runs_no_python(spark):
    plan = queries.op10_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---------------------------------------------------------------- pipeline
def test_pipeline_is_the_plain_version(spark, reference):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from test_dedup import plain_lines, plain_simhash
    from tidewater.llm import langid
    from tidewater.llm.common import remainder

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table, remainder("doc_id", 5) != 0)
    docs = {r.doc_id: r.text for r in table.collect()}
    docs = {i: t for i, t in docs.items() if (x := model.infer(t))[0] != "und" and x[1] >= 0.5}
    gone = {(i, n) for i, n, a, b in plain_lines(docs.items()) if (i, n) != (a, b)}
    docs = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs.items()}
    docs = {i: docs[i] for i, _, c in plain_simhash(list(docs.items())) if i == c}
    bench = decontam.Benchmark([(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()])

    def leaks(text):
        w = np.array([bench.unigrams.get(x, -1) for x in decontam.words(text)], dtype=np.int64)
        return any(decontam.verify(p, tail, w, int(s)) for _, p, tail in bench.pieces for s in range(0, len(w), decontam.STRIDE)) if len(w) else False

    docs = {i: t for i, t in docs.items() if not leaks(t)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert ids(got[i].ids) == reference.encode_ordinary(t)


def test_stages_return_the_columns_of_documents(spark, odd):
    import corpus_pipeline
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert [linedup.CHARS_PER_EDIT, len(corpus_pipeline.STAGES)] == [12, 5]
