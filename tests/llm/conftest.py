import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from wayfold.session import local_session  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, app="wayfold-llm-tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows and odd characters."""
    long = " ".join(f"w{k % 97} x{k % 31}" for k in range(30_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3),
        (5, long, "en", "b", len(long)), (6, long, "en", None, len(long)), (7, "Straße  ½\x1c\xa0\n\nx <|endoftext|> y", "de", "b", 9),
        (7, "Straße  ½\x1c\xa0\n\nx <|endoftext|> y", "de", "b", 9), (None, "no id here", "en", "b", 10), (8, "▁ \x00 é é ΑΣ, it's.", "el", "c", 5),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
