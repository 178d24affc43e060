import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, body string, label string, key long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts (ids 0, 1, ... or pairs), with extra columns named like the operators' own."""
    def build(texts, partitions=3):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", None, 7, "clash", "clash", 1) for i, t in rows], SCHEMA).repartition(partitions)
    return build


ODD = [None, "", "   ", "\n\n", "x", "a b", "é ñ ß", "日本語 テキスト", "same text here", "same text here", "1234 5678",
       "word " * 30_000, "z" * 50_000, "line one of some length here\n" * 3]


@pytest.fixture(scope="session")
def odd(make):
    """Null, empty, blank, short, very long and equal texts; a null id and a repeated row."""
    return make([*ODD, (None, "text without an id"), (8, "same text here")])


@pytest.fixture(scope="session")
def empty(make):
    return make(["x"]).limit(0)
