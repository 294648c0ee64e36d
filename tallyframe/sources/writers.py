"""Writers. Growing outputs are rebalanced before they are written, so that a dataset holding
most rows is spread over many files and a small one does not leave many tiny ones."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import slug
from tallyframe.sources.commits import CommittedTable


def _rebalanced(df: DataFrame, *names: str) -> DataFrame:
    return df.hint("rebalance", *[F.col(name) for name in names])


def write_mixed(df: DataFrame, path: str) -> None:
    """Mixed dataset, one partition per split; the whole folder is the full dataset."""
    _rebalanced(df, "split").write.mode("overwrite").partitionBy("split").parquet(path)


def append_predictions(df: DataFrame, path: str, reset: bool = False) -> None:
    """Append predictions under their dataset and model, or put them in the place of all earlier ones
    with ``reset``. Either is one commit: readers see all of its rows or none.

    Only the folders have file-name-safe names; the rows keep the real ones.
    """
    pair = ("dataset_slug", "model_slug")
    named = df.withColumns(
        {"dataset_slug": slug(F.col("dataset_name")), "model_slug": slug(F.col("model"))}
    )
    table = CommittedTable(df.sparkSession, path)
    write = table.replace if reset else table.append
    write(lambda folder: _rebalanced(named, *pair).write.partitionBy(*pair).json(folder))


def append_scores(df: DataFrame, path: str, reset: bool = False) -> None:
    """Append score records under their dataset and model."""
    append_predictions(df, path, reset)


def write_voting_log(df: DataFrame, path: str) -> None:
    """Voting details of each sample, one partition per dataset."""
    _rebalanced(df, "dataset").write.mode("overwrite").partitionBy("dataset").json(path)


def write_payloads(df: DataFrame, path: str, column: str = "payload") -> None:
    """Request bodies, one JSON text per line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_small_json(df: DataFrame, path: str) -> None:
    """Summaries and manifests: an aggregate of a few rows in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def manifest(
    datasets: DataFrame,
    run_id: str,
    config: dict | None = None,
    counters: DataFrame | None = None,
    phase_status: dict[str, str] | None = None,
) -> DataFrame:
    """One manifest row: run configuration, example count per dataset and result counters."""
    per_dataset = datasets.groupBy("dataset_name").agg(F.count("*").alias("example_count"))
    inventory = per_dataset.agg(
        F.array_sort(F.collect_list(F.struct("dataset_name", "example_count"))).alias("datasets")
    )
    row = inventory.select(
        F.lit(run_id).alias("run_id"),
        F.lit(json.dumps(config or {}, sort_keys=True, default=str)).alias("config"),
        "datasets",
        F.lit(json.dumps(phase_status or {}, sort_keys=True)).alias("phase_status"),
    )
    if counters is None:
        return row
    # Both sides are keyless aggregates, that is one row each.
    summary = counters.agg(F.max(F.struct("*")).alias("summary"))
    return row.join(summary.withColumn("run_id", F.lit(run_id)), "run_id")
