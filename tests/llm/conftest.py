import pytest
from samples import prose

from hodos.llm.queries import ready
from hodos.session import local_session


@pytest.fixture(scope="session")
def spark():
    return ready(local_session(4, shuffle_partitions=4, memory="4g"))


@pytest.fixture
def folder(spark):
    from hodos.session import scratch

    return scratch(spark, "test")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, blank and long texts, ties, repeated rows, clashing column names."""
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 120), "en", "a"), (1, prose(2, 120), "en", "a"), (2, prose(2, 120), "en", "b"), (3, None, None, None),
        (None, prose(3, 80), "de", "a"), (None, prose(3, 80), "de", "a"), (4, "", "en", "a"), (5, " \n\t ", None, "b"), (6, "one two", "en", None),
        (7, long, "en", "c"), (8, long + " tail", "en", "c"), (9, "ünï cödé \n text " * 30, "fr", "c"), (10, "same line here\n" * 60, "en", "b"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("score", "size", "taken", "copy", "g", "places", "n_lines", "words", "range", "key", "window", "node")}
    return frame.withColumns(extra)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
