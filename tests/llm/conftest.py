import pytest

#: Documents with every awkward case: nulls in any column, empty and very long texts, repeated rows, repeated and null ids.
LONG = " ".join(f"wörd{i % 977} the" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and the dog sleeps on the warm stones near the old river bank today.", "en", "a", 10),
    (2, "", "en", "b", 0), (3, None, None, None, None), (4, " \t\n\x0b\r ", "de", "a", 5), (5, LONG, "fr", "a", len(LONG)),
    (6, "one", None, "b", 3), (6, "one", None, "b", 3), (None, "no id here but several words all the same to be read", "en", "c", 1),
    (7, "Größe ñandú 漢字 🙂🙂 ½² ſecret=Kelvin1234567 ' s's t'll    x\u0085y\x1cz", "xx", "c", 1), (8, "a b a b a b a b a b " * 8, "EN", None, 1),
    (9, "x" * 3000 + "=" * 500, "en", "a", 1), (10, "line one here\nline one here\n\n \nother | $ #", "es", "b", 1),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators return or use."""
    from pyspark.sql import functions as F
    return odd.select("*", *[F.lit("x").alias(c) for c in ("size", "n_words", "kept", "ids", "secrets", "_bytes", "target", "score", "_set", "component_id", "_row", "toxicity", "entropy")])
