import pytest


@pytest.fixture(scope="session")
def texts():
    """Rows that operators must take: nulls, empty and odd texts, repeats, a long text."""
    base = " ".join(f"word{i}" for i in range(80))
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, base), (6, base), (7, base + " more"), (8, "x" * 50_000), (None, base), (5, base), (9, "é ß 中文 \x00 end"), (10, "12 34 .. !!")]


@pytest.fixture
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id bigint, text string")


@pytest.fixture
def clashing(docs):
    """Extra columns that bear the names of results."""
    from pyspark.sql import functions as F

    names = ["kept", "score", "predicted", "lang_pred", "ids", "decoded", "n", "id", "token", "rep", "n_shingles", "component_id", "base", "found", "length", "sequence_id", "offset", "piece", "rules_met", "text_hash", "at", "block"]
    return docs.select("*", *(F.lit(1).alias(c) for c in names))
