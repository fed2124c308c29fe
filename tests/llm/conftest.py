import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A line of over 40 characters.
SHARED = "This very line is long enough to be shared by many documents."


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, words + "\n" + SHARED, "en", "a", 400),
        (2, words + "\n" + SHARED, "en", "a", 400),
        (3, f"  {SHARED.upper()}\t\nother", "en", None, 70),
        (4, SHARED, None, "b", 61),
        (5, "\n".join([SHARED, "x", SHARED, ""]), "fr", "b", None),
        (5, "\n".join([SHARED, "x", SHARED, ""]), "fr", "b", None),
        (6, None, "en", "a", 0),
        (7, "", "en", "a", 0),
        (8, "12345 !!! 678", "de", "b", 13),
        (9, ("lorem ipsum dolor " * 20 + "\n") * 500, "en", "a", 180500),
        (9, "another text under the same id\n" + SHARED, "en", "a", 90),
        (None, "no id at all\n" + SHARED, "en", "a", 70),
        (10, " \t\n", None, None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    clash = {n: F.lit("x") for n in ("line_report", "fingerprint", "verdict", "quality", "language", "secrets", "pii", "copies", "Rules", "label", "hash", "id", "key", "score")}
    return docs.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
