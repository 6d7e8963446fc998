import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "sa", "ri", "po") for b in ("ra", "den", "fo", "gu", "hil", "mek", "sto", "vin", "x", "zor")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, equal texts, and extra columns with clashing names."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "xx", "s", 1, 7, "b"),
        (2, None, None, None, None, None, None),
        (3, "", "xx", "s", 0, 8, "c"),
        (4, prose(2, 120), "xx", "s", 1, 9, "d"),
        (5, long, "yy", "s", 1, 10, "e"),
        (5, long, "yy", "s", 1, 10, "e"),
        (6, "one", "yy", "s", 1, 11, "f"),
        (7, " \n\t", "yy", "s", 1, 12, "g"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, node string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
