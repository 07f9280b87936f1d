import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp string, n_words string, own string, key string, __x string, __text string, __v0 string, row string, _salt string"


def row(doc_id, text, n_chars=0):
    return (doc_id, text, "en", "src0", n_chars, None, "a", "b", "c", "d", "x", "t", "v", "r", "s")


@pytest.fixture(scope="session")
def prose():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 7))) for _ in range(3000)]

    def make(n, seed):
        return " ".join(random.Random(seed).choices(words, k=n))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the names of outputs and of helpers."""
    long = prose(60_000, 1)
    shared = prose(120, 2)
    rows = [
        row(None, "a row without an id"),
        row(None, shared),
        row(1, None),
        row(2, ""),
        row(3, " \t\n\x0b "),
        row(4, long),
        row(5, shared + " " + prose(30, 3)),
        row(6, prose(30, 4) + " " + shared),
        row(6, prose(30, 4) + " " + shared),
        row(6, shared + " other text under the same id"),
        row(7, shared),
        row(8, shared),
        row(9, "one"),
        row(10, "One"),
        row(11, "two words"),
        row(12, "é ü ñ 文字 \U0001f600 naïve"),
        row(13, prose(400, 6)),
        row(14, prose(399, 6) + " changed"),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
