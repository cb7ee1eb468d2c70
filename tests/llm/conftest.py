import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def documents(spark):
    """Makes a documents table from (doc_id, text) or whole rows."""

    def make(rows, extra=""):
        full = [tuple(r) + ("en", "a", len(r[1] or ""))[: 5 - len(r)] if len(r) == 2 else tuple(r) for r in rows]
        frame = spark.createDataFrame(full, DOCUMENTS)
        return frame.selectExpr("*", *extra.split(";")) if extra else frame

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
