import random

import pytest

DOCS = "doc_id bigint, text string, lang string, n_words string, spans int, key string, row string"


def frame(spark, texts, first=0):
    """Documents from texts, with more columns whose names the operators use themselves."""
    rows = [(first + i, t, "en", "mine", 7, "k", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed, size=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(size)}x" for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, ties, repeated, long, odd characters."""
    return [None, "", " \n\t ", "one", "one", "one two", "\n\n\n", "é ü 日本語 😀 ▁ \x00 \x7f", "A" * 30_000, "word " * 4000,
            words(300, 1), words(300, 1), words(6000, 2)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts, a null id, and a row that stands twice."""
    docs = frame(spark, odd_texts)
    more = spark.createDataFrame([(None, "no id here", "en", "mine", 7, "k", "r"), (3, "one", "en", "mine", 7, "k", "r")], DOCS)
    return docs.unionByName(more)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
