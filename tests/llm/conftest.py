import pytest
from samples import CLASHING, SCHEMA, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with more columns whose names clash."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    return docs.select("*", *(F.lit("x").alias(name) for name in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}
