import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    word = "thimble orchard lantern meadow copper willow harbor basket violin marble"
    long_text = " ".join(f"{w}{i}" for i in range(6000) for w in ("alpha", "beta", "gamma")) + "."
    rows = [(1, word, "en", "a", 5, 7, "x"), (2, word, "en", "a", 5, 7, "x"), (2, word, "en", "a", 5, 7, "x"),
            (None, word, None, None, None, None, None), (3, None, "de", "b", 0, 1, "y"), (4, "", None, "b", 0, 1, "y"),
            (5, long_text, "fr", "c", 9, 1, "z"), (6, " \n\t ", "es", "c", 3, 1, "z"), (None, None, None, None, None, None, None),
            (7, "One sentence only", "en", "a", 1, 1, "w")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars int, score int, `n tokens.x` string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
