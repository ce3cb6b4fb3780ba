import pytest
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) tuples."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest given tables, whole."""
    folder = "/root/testdata/sf0.001"
    return lambda name: spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def awkward(make_docs):
    """Nulls, empties, spaces, ties and repeated rows."""
    prose = " ".join(f"word{i} other{i % 7}" for i in range(60))
    return make_docs([
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, prose), (5, prose), (6, prose), (7, "é" * 3000),
        (None, prose), (None, None), (8, "x" * 20000), (9, "a b " * 3000), (10, "\x00\x1f ok", None, None),
    ])
