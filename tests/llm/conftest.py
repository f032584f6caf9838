import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names."""
    words = " ".join(f"word{i % 97} then, other{i % 31}." for i in range(30_000))
    rows = [(1, None), (2, ""), (3, words), (4, "a b c d"), (4, "a b c d"), (None, "no id here"), (5, " \n\t "), (6, "x" * 200_000), (7, "é漢字 \U0001F600 A b"), (8, "a b c d")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = ["score", "row", "n", "group", "fp", "node", "component_id", "i", "t", "held_out", "open", "kept", "lang", "source"]
    return d.select("*", *[F.lit(None).cast("string").alias(c) for c in clash], F.length("text").cast("long").alias("n_chars")).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd):
    return odd.limit(0)
