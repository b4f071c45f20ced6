import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns with clashing names."""
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    long = " ".join(words[(i * i) % 12] + str(i % 97) for i in range(200_000))
    some = " ".join(words[(i * 7) % 12] + "x" * (i % 5) for i in range(300))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", None, 0), (None, some, "en", "a", 5), (3, some, None, "a", 5), (3, some, None, "a", 5), (4, long, "de", "b", 9),
        (5, "12345 !!! ...", "de", "b", 3), (6, " \t\n\x0b\f\r ", "fr", "b", 6), (7, "one", "fr", "c", 3), (8, "ONE", "fr", "c", 3), (9, "été ñ ß 中文 😀 a\x00b", "fr", "c", 9), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOC)
    extra = {c: F.lit(7) for c in ("fp", "_fp", "id", "n", "component", "host", "path", "length", "_row", "row", "piece", "k", "label", "_language")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOC)
