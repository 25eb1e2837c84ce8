import pytest
from text_rows import EDGE_SCHEMA, edge_rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
