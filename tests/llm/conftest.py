import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, template string, word string, key long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns that clash with inner names."""
    long = " ".join(f"word{k % 977} and" for k in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"), (1, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, " \n\t ", "fr", "b"), (None, "a row without an id but with a text of several words", "en", "a"), (None, None, None, None),
        (5, long, "en", "a"), (6, long + " tail", "en", "a"), (7, "one", "de", "c"), (8, "one", "de", "c"), (9, "naïve\u00a0café \u2003 ſtrange İstanbul 日本語", "fr", "b"), (10, "x" * 50_000, "en", "a"),
    ]
    return spark.createDataFrame([(*r, 0, "t", "w", 1) for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """A few hundred small real-shaped documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(corpus):
    return {r.doc_id: r.text or "" for r in corpus.collect()}
