"""Language, toxicity and quality: held-out accuracy, and defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import langid, quality, queries, toxicity
from tidewater.llm.common import remainder

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_language_held_out_accuracy(spark):
    got = queries.op2_language(spark, SF).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 250
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


@pytest.fixture(scope="module")
def languages(spark):
    return langid.fit(table(spark, "documents"), F.lit(True))


def test_language_odd_rows(languages, odd, empty):
    got = {r.doc_id: r for r in langid.predict(odd, languages).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 3, 10))
    assert got[4].lang_pred in languages.languages
    out = langid.predict(odd, languages)
    assert out.columns == [*odd.columns, "lang_pred", "score", "lang_shares"] and out.count() == odd.count()
    assert langid.predict(empty, languages).count() == 0
    assert langid.keep_identified(odd, languages).columns == odd.columns


def test_mixture_shares(spark, languages):
    rows = {r.lang: r.text for r in table(spark, "documents").where("length(text) between 3000 and 4000").orderBy("doc_id").collect()}
    mixed = rows["fr"][:3000] + " " + rows["de"][:1000]
    top, share, shares = languages.infer(mixed)
    assert top == "fr" and set(shares) == {"fr", "de"} and 0.6 < share < 0.9
    assert set(languages.infer(rows["fr"])[2]) == {"fr"}


def test_no_language_is_known(make):
    model = langid.fit(make(["abc"]), F.lit(False))
    assert langid.predict(make(["abc", None]), model).where("lang_pred = 'und'").count() == 2


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = y.sum()
    return (rank[y].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("query,label,least", [("op3_toxicity", "toxic", 0.9), ("op4_quality", "quality", 0.95)])
def test_held_out_scores(spark, query, label, least):
    # the small table has some 50 toxic rows; the large one has 450
    folder, n = ("/root/testdata/sf0.1", 10_000) if label == "toxic" else (SF, 1000)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.QUERIES[query](spark, folder).join(labels, "doc_id", "left").collect()
    assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    cut = 0.3 if label == "toxic" else 0.7
    assert all(r.predicted == (r.score >= cut) for r in got)
    held = [r for r in got if r.held_out and r[label] is not None]
    assert len(held) > 50
    assert auc(np.array([r.score for r in held]), np.array([r[label] == 1 for r in held])) > least


@pytest.fixture(scope="module")
def insults():
    """A machine trained on two insults among common words."""
    rng = np.random.default_rng(0)
    common = ["".join(rng.choice(list("aeiounrstlh"), rng.integers(3, 9))) for _ in range(400)]
    rows = [("idiot", 0.05, 0.0), ("moron", 0.05, 0.0), *((w, 0.01, 0.01) for w in dict.fromkeys(common))]
    rows = [(s, p, n) for w, p, n in rows for s in toxicity._pieces(w)]
    return toxicity.train(sorted(rows))


def test_gaps_and_inserted_characters_are_tolerated(insults):
    margin = dict(zip(["idiot", "i-d-i-o-t", "IDIOT!!", "id1ot", "idiiot", "tisane", "relation", "horn"],
                      insults.margins(["idiot", "i-d-i-o-t", "IDIOT!!", "id1ot", "idiiot", "tisane", "relation", "horn"])))
    assert margin["idiot"] == margin["IDIOT!!"] == margin["id1ot"]
    assert min(margin[w] for w in ("idiot", "i-d-i-o-t", "idiiot")) > 0.2 + max(margin[w] for w in ("tisane", "relation", "horn"))
    assert "moron" in toxicity.windows("you m o r o n there")


def test_kernel_is_the_plain_one():
    words = ["idiot", "i-d_iot", "moron"]

    def plain(word):
        text = toxicity._pieces(word)[0]
        used = [(p, c) for p, c in enumerate(text) if c.isalpha() or c in (toxicity.START, toxicity.END)]
        out = {}
        for i in range(len(used)):
            for j in range(i + 1, len(used)):
                for k in range(j + 1, min(len(used), i + toxicity.REACH + 1)):
                    span = used[k][0] - used[i][0] + 1
                    if span <= toxicity.SPAN:
                        t = used[i][1] + used[j][1] + used[k][1]
                        out[t] = out.get(t, 0) + toxicity.DECAY ** span
        return out

    vectors = [plain(w) for w in words]
    norm = [np.sqrt(sum(x * x for x in v.values())) for v in vectors]
    want = [[sum(x * b.get(t, 0) for t, x in a.items()) / (m * n) for b, n in zip(vectors, norm)] for a, m in zip(vectors, norm)]
    pieces = [toxicity._pieces(w)[0] for w in words]
    assert np.allclose(toxicity.Landmarks(pieces).values(pieces), want, atol=1e-6)


def test_scores_of_odd_rows(spark, odd, empty, insults):
    got = {r.doc_id: r for r in toxicity.score(odd, insults).collect()}
    assert got[0].worst is None and got[0].score == got[1].score and 0 <= got[11].score <= 1
    assert toxicity.score(odd, insults).count() == odd.count() and toxicity.score(empty, insults).count() == 0
    assert {r.score for r in toxicity.score(odd, None).collect()} == {0.0}
    model = quality.QualityModel(np.linspace(-1, 1, 1 << quality.BITS), 0.5)
    got = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert got[0] == got[1] == pytest.approx(1 / (1 + np.exp(-0.5))) and all(0 <= s <= 1 for s in got.values())
    assert quality.score(empty, model).count() == 0


def test_labels_missing_repeated_or_null(spark, make):
    docs = make([f"text number {i}" for i in range(20)])
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (2, 0, None), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    assert 0 <= quality.score(docs, quality.fit(docs, labels, F.lit(True))).first().score <= 1
    none = labels.limit(0)
    assert quality.fit(docs, none, F.lit(True)).score("x") == 0.5 and toxicity.fit(docs, none, F.lit(True)) is None


def test_word_features_do_not_depend_on_the_place():
    a, b = quality.feature_ids("alpha beta"), quality.feature_ids("  alpha\tbeta")
    words = lambda f: {x for x in f}
    assert len(words(a) & words(b)) >= 3
    repeat = quality.feature_ids("q q q q")
    assert np.bincount(repeat).max() >= 3


def test_remainder_is_crc32(spark):
    import zlib
    got = spark.range(50).select("id", remainder("id", 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 5 for r in got)
