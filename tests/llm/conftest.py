import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, one very long text, clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven.", "en", "s1", 34),
        (1, "One two three four five six seven.", "en", "s1", 34),
        (1, "The same id with another text.", "en", "s2", 30),
        (2, None, None, None, None),
        (3, "", "en", "s1", 0),
        (4, " \t\n", None, "s2", 3),
        (None, "A null id.", "de", None, 10),
        (None, None, None, None, None),
        (5, long, "fr", "s1", len(long)),
        (6, "1234 5678 !!!", "en", "s3", 13),
        (7, "é ñ ü 漢字 \U0001f600 emoji words", "es", "s3", 20),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    extra = ("n_words", "kept", "k", "size", "h", "bucket", "fp", "row_key", "_row", "_text", "component_id", "source_size", "ps", "rk", "grp")
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def few_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
