import random

import pytest
from conftest_rows import documents


@pytest.fixture(scope="session")
def words():
    rnd = random.Random(3)
    return [f"{rnd.choice(['ba', 'ko', 'li'])}{i}" for i in range(2000)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a very long text."""
    long_text = " ".join(f"long{i % 977}" for i in range(60_000))
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "one two", "de", "b"), (4, "one two", "de", "b"),
        (5, "One  two", None, "b"), (None, "no id at all", "en", None), (6, long_text, "en", "a"), (7, "<|endoftext|> x <|endoftext|>", "fr", "b"),
        (8, "é漢  'll  don't\r\n", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return documents(spark, odd_rows, ("id", "tie", "size", "label", "h", "row", "pattern", "_id", "part", "kind", "n_words", "stratum", "sig"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return documents(spark, [])
