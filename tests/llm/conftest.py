import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and ids."""
    passage = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 9973}x{i}" for i in range(60_000))
    rows = [
        (1, passage, "en", "a", 5), (2, passage, "en", "a", 5), (2, passage, "en", "a", 5), (3, None, "en", None, None), (4, "", None, "a", 0), (5, " \n\t ", "en", "b", 4),
        (6, "one", "en", "b", 3), (7, "one", None, None, 3), (8, f"{passage} more\n\n{passage}", "de", "b", 9), (9, long, "en", "c", 1), (10, f"{long} end", "en", "c", 1),
        (11, "é ü ñ 😀 ▁ \x00 x", "fr", "c", 9), (12, "ONE", "en", "a", 3), (None, passage, "en", "a", 1), (None, None, None, None, None),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with further columns, named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = ["size", "key", "slot", "shard", "n_words", "spans", "items", "removed", "kept", "score", "block", "h", "task", "bucket", "root", "term", "__task", "rest", "limit", "toxic", "row"]
    return odd.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id = -5")
