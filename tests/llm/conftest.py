import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
        T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("node", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source), with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", None, "k", "n") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a long text, repeated rows and ids, ties."""
    words = [f"w{i * 7919 % 613}x{i}" for i in range(9000)]
    base = " ".join(words[:90])
    return [
        (1, base, "a"), (2, base, "b"), (2, base, "b"), (None, base, None), (None, None, None), (3, None, "a"), (4, "", "a"), (5, " \t\n ", None),
        (6, "two words", "b"), (7, "two words", "b"), (8, " ".join(words), "c"), (9, base.upper(), "c"), (10, " ".join([*words[:85], "changed", *words[86:90]]), "a"),
        (10, " ".join(words[200:290]), "a"), (11, "é日本 😀 " * 30, "é"), (12, "the " * 400, "a"), (13, "x" * 700, "b"),
    ]
