"""Stores in buckets: look-ups that leave the stored side where it lies."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import predictions
from tallyframe.sources.buckets import BucketedStore

KIND = "dataset_name string, model string, example_id string, status string, row_ordinal bigint"


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def runs(spark, lo, hi):
    k = F.col("id")
    status = F.when(k % 5 == 0, "error").otherwise("success")
    return spark.range(lo, hi).select(
        F.concat(F.lit("d"), k % 2).alias("dataset_name"), F.concat(F.lit("m"), k % 3).alias("model"), k.cast("string").alias("example_id"), status.alias("status"), k.alias("row_ordinal")
    )


def exchanges_above_scans(df, path):
    """For each scan of the path, the shuffles between it and the root of the plan's stages."""
    depth, found, stack = 0, [], []
    text = df._jdf.queryExecution().executedPlan().toString()
    for line in text.splitlines():
        name = line.lstrip(" :+-*()0123456789")
        depth = len(line) - len(name)
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, name))
        if name.startswith("FileScan") and path in name:
            found.append([n for _, n in stack if n.startswith(("Exchange", "ShuffleQueryStage"))])
    return found


def test_resume_reads_the_log_in_its_buckets(spark, tmp_path, no_broadcast):
    store = BucketedStore(spark, str(tmp_path / "log"), KIND, buckets=8)
    assert store.read().count() == 0
    store.add(runs(spark, 0, 500))
    store.add(runs(spark, 400, 800))
    assert store.read().count() == 900
    planned = runs(spark, 300, 1000).select(*predictions.PAIR_KEYS)
    for retry, left in ((False, 200), (True, 200 + 100)):
        todo = predictions.pending(planned, predictions.recorded_keys(store.read(), retry_errors=retry))
        assert todo.count() == left
        scans = exchanges_above_scans(todo, "log")
        assert scans and not any(scans), todo._jdf.queryExecution().executedPlan().toString()


def test_cache_reads_its_buckets_and_gives_the_last_response(spark, tmp_path, no_broadcast):
    kind = "cache_key string, response string, row_ordinal bigint"
    store = BucketedStore(spark, str(tmp_path / "cache"), kind, ("cache_key",), buckets=4)
    answer = lambda lo, hi, text: spark.range(lo, hi).select(F.col("id").cast("string").alias("cache_key"), F.lit(text).alias("response"), (F.col("id") + len(text)).alias("row_ordinal"))
    store.add(answer(0, 100, "longer"))
    store.add(answer(50, 150, "new"))
    asked = spark.range(0, 300, 3).select(F.col("id").cast("string").alias("cache_key"))
    hits = predictions.cached_responses(asked, store.read())
    got = {int(r["cache_key"]): r["response"] for r in hits.collect()}
    assert got == {k: "longer" if k < 100 else "new" if k < 150 else None for k in range(0, 300, 3)}
    scans = exchanges_above_scans(hits, "cache")
    assert scans and not any(scans), hits._jdf.queryExecution().executedPlan().toString()


def test_another_session_opens_a_store_by_its_path(spark, tmp_path):
    path = str(tmp_path / "log")
    store = BucketedStore(spark, path, KIND, buckets=4)
    assert not store.exists()
    store.add(runs(spark, 0, 10))
    # What the session's catalog knows is gone; the files are not.
    spark.sql(f"DROP TABLE {store.name}")
    again = BucketedStore(spark, path, KIND, buckets=4)
    assert again.exists() and again.read().count() == 10
    again.add(runs(spark, 10, 30).withColumn("extra", F.lit(1)))
    assert again.read().count() == 30 and again.read().columns == ["dataset_name", "model", "example_id", "status", "row_ordinal"]
