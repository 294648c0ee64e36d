import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyframe import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[8]",
        shuffle_partitions=8,
        extra={
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a Column function to Python values and collect the results in order."""

    def run(function, rows, schema="v string"):
        from pyspark.sql import functions as F

        data = [(i, *(row if isinstance(row, tuple) else (row,))) for i, row in enumerate(rows)]
        df = spark.createDataFrame(data, f"i int, {schema}")
        columns = [F.col(name) for name in df.columns[1:]]
        result = df.select("i", function(*columns).alias("o")).orderBy("i").collect()
        return [row["o"] for row in result]

    return run
