import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame in several partitions, so that work on parts shows."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
