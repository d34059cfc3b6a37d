import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

LONG = " ".join(f"word{i % 97} thing{i % 89}" for i in range(6000))


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def shipped(spark):
    from weekgrain.llm.queries import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(shipped):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names
    operators use inside."""
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "s", 30, 1.0, "x"),
        (1, "alpha beta gamma delta epsilon", "en", "s", 30, 1.0, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "s", 0, 2.0, "y"),
        (4, LONG, "en", "s", len(LONG), 3.0, "z"),
        (None, "null id text with some more words in it", "en", "s", 39, 4.0, "w"),
        (5, "   \n\t ", "en", "s", 6, 5.0, "v"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, found string"
    return shipped.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")

