import random

import pytest

WORDS = ["the", "of", "and", "river", "stone", "cloud", "garden", "silver", "walks", "under", "bright", "morning", "seven", "ships", "carry", "amber", "glass", "north"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice(WORDS) if r.random() < 0.5 else "") for _ in range(n)) + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, white space, repeats, ties and a very long text."""
    long = prose(99, 30_000)
    return [
        (1, prose(1, 120)), (2, None), (3, ""), (4, " \t\n "), (5, "one"), (6, prose(1, 120)), (7, prose(1, 120) + " more"), (8, long), (8, long),
        (None, "no id here"), (None, None), (9, "é ü ñ ß"), (10, "!!! 123 ???"), (11, "one"), (12, prose(2, 90).upper()), (13, "x" * 5000),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with columns whose names operators might use themselves."""
    extra = "lang string, source string, n_chars long, key long, rep long, n long, w string, spans string, score double, `a b` string"
    rows = [(d, t, "en" if n % 2 else None, None, None, n, None, 7, "w", "s", None, "c") for n, (d, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < 0 and doc_id > 0")
