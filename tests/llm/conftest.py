import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def words(n, seed=0, base="w"):
    import random
    rng = random.Random(seed)
    return " ".join(f"{base}{rng.randrange(400)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, shared passages."""
    passage = words(60, 5, "shared")
    long = words(30_000, 6)
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", "s", 3),
        (4, "short text", "en", "s", 10), (5, words(80, 1) + " " + passage, "en", "s", 1),
        (6, passage + "  " + words(80, 2), "en", "s", 1), (7, words(120, 3), "fr", "s", 1),
        (8, words(120, 3), "fr", "s", 1), (9, words(120, 3) + " tail", "fr", None, 1),
        (10, long, "en", "s", 1), (11, "x" * 5000, "en", "s", 1),
        (12, "Ünïcödé ▁ 日本語 😀 " + words(50, 4), None, "s", 1),
        (13, "Short\ttext", "en", "s", 1), (14, words(120, 3), "fr", "s", 1),
        (14, words(120, 3), "fr", "s", 1), (None, words(90, 9), "en", "s", 1),
        (None, words(90, 9), "en", "s", 1), (15, "12 34 !!", "en", "s", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
