import pytest

from tests.conftest import DATA
from tradewright.llm.common import table


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, DATA, "documents").cache()


LONG = " ".join(f"long{i % 977}" for i in range(30_000))
COPY = "the quick brown fox jumps over the lazy dog and then rests under a tall old tree until the evening comes again " * 2
ROWS = [
    (1, COPY + "\nA shared line of text here", "en", "b"), (2, COPY.upper() + "\n  a SHARED line of text here\t", "en", "b"), (3, None, None, None), (4, "", "de", "a"),
    (5, " \t\n\x0b ", "fr", "a"), (6, LONG, "en", "c"), (7, "one two", "en", None), (8, "ONE two", "en", "c"), (8, "ONE two", "en", "c"), (None, COPY, "en", "b"),
    (9, "\x85 \u3000x\u00a0y # $ %\nshort\nshort\n日本語 テキスト", None, "é"), (10, COPY + " more", "en", "Z"), (11, "A shared line of text here\nown", "es", "b")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with the names of results and working columns."""
    rows = [(*r, "mine", 1, "x") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept_text string, size int, version string").cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
