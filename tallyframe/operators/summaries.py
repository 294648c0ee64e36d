"""Roll-ups of scores and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.functions.metrics import primary_metric
from tallyframe.functions.text import lookup

PAIR = ("dataset_name", "model")


def mean_metrics(scores: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Mean of each metric over the rows that carry it, in long form.

    The outer explode matters: from an inner one Catalyst infers a filter on the map and pushes
    it below the scoring projections, which then are evaluated twice.
    """
    return (
        scores.select(*keys, F.explode_outer("metrics").alias("metric", "value"))
        .groupBy(*keys, "metric")
        .agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
        .filter(F.col("n") > 0)
    )


def pair_summaries(scores: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """Counts and mean metrics per dataset and model in one pass over the scores.

    Rows are exploded by metric; the first entry of each row also carries the row counters. Map
    tasks reduce that to one row per pair and metric name.
    """
    scored = F.col("status") == "scored"
    entries = scores.select(
        *keys,
        scored.alias("_scored"),
        F.posexplode_outer(F.when(scored, F.map_entries("metrics"))).alias("_pos", "_entry"),
    )
    leads = F.coalesce(F.col("_pos") == 0, F.lit(True))
    by_metric = entries.groupBy(*keys, F.col("_entry.key").alias("_metric")).agg(
        F.count_if(leads).alias("_rows"),
        F.count_if(leads & F.col("_scored")).alias("_scored_rows"),
        F.avg("_entry.value").alias("_mean"),
    )
    named = F.when(
        F.col("_metric").isNotNull() & F.col("_mean").isNotNull(), F.struct("_metric", "_mean")
    )
    summed = by_metric.groupBy(*keys).agg(
        F.sum("_rows").alias("total_examples"),
        F.sum("_scored_rows").alias("scored_examples"),
        F.map_from_entries(F.array_sort(F.collect_list(named))).alias("aggregated_metrics"),
    )
    failed = F.col("total_examples") - F.col("scored_examples")
    return summed.select(
        *keys,
        primary_metric(F.col("dataset_name")).alias("metric_name"),
        "total_examples",
        "scored_examples",
        failed.alias("failed_examples"),
        F.lit(0).cast("bigint").alias("skipped_examples"),
        "aggregated_metrics",
    )


def suite_rows(summaries: DataFrame, suite_id: str = "suite") -> DataFrame:
    """Flat suite rows with the value of each pair's primary metric."""
    return summaries.select(
        F.lit(suite_id).alias("suite_id"),
        *PAIR,
        F.col("metric_name").alias("primary_metric"),
        F.try_element_at("aggregated_metrics", F.col("metric_name")).alias(
            "primary_metric_value"
        ),
        "aggregated_metrics",
        "scored_examples",
        "failed_examples",
        "total_examples",
    )


def suite_counters(summaries: DataFrame) -> DataFrame:
    """Totals of a suite from its pair summaries (one row per pair)."""
    return summaries.agg(
        F.count("*").alias("total_pairs"),
        F.coalesce(F.sum("total_examples"), F.lit(0)).alias("total_examples"),
        F.coalesce(F.sum("scored_examples"), F.lit(0)).alias("scored_examples"),
        F.coalesce(F.sum("failed_examples"), F.lit(0)).alias("failed_examples"),
    )


def _average(total: str, scale: float = 1.0) -> Column:
    count = F.col("successful_rows")
    return F.try_divide(F.col(total).cast("double"), count) / scale


def council_state(scores: DataFrame, predictions: DataFrame) -> DataFrame:
    """Accumulated totals per source dataset and overall (``source_dataset`` null).

    ``predictions`` may be ``completed_rows`` alone. Both inputs shrink to one row per dataset before
    they meet; the overall row is a rollup of those few rows.
    """
    scored = F.col("status") == "scored"
    quality = scores.groupBy("source_dataset").agg(
        F.count("*").alias("total_examples"),
        F.count_if(scored).alias("scored_examples"),
        F.count_if(~scored).alias("failed_examples"),
        F.sum(F.when(scored, F.coalesce("primary_value", F.lit(0.0)))).alias(
            "primary_metric_sum"
        ),
    )
    cost = (
        predictions.filter("status = 'success'")
        .groupBy("source_dataset")
        .agg(
            F.count("*").alias("successful_rows"),
            F.sum(F.coalesce("latency_ms", F.lit(0.0))).alias("total_latency_ms"),
            F.sum(F.coalesce("usage.input_tokens", F.lit(0))).alias("total_input_tokens"),
            F.sum(F.coalesce("usage.output_tokens", F.lit(0))).alias("total_output_tokens"),
            F.sum(F.coalesce("usage.total_tokens", F.lit(0))).alias("total_tokens"),
        )
    )
    totals = [name for df in (quality, cost) for name in df.columns if name != "source_dataset"]
    merged = quality.join(cost, "source_dataset", "full")
    return merged.rollup("source_dataset").agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in totals],
        F.grouping("source_dataset").cast("int").alias("is_overall"),
    )


def dataset_order(spark) -> DataFrame:
    rows = [(name, index) for index, name in enumerate(fv.DATASETS)]
    return spark.createDataFrame(rows, "source_dataset string, order_idx int")


def dataset_scores(state: DataFrame) -> DataFrame:
    """Mean primary metric per dataset in fixed order, 0 for a dataset without scored rows."""
    per_dataset = state.filter("is_overall = 0").select(
        "source_dataset",
        F.try_divide("primary_metric_sum", F.col("scored_examples")).alias("_mean"),
    )
    ordered = dataset_order(state.sparkSession).join(per_dataset, "source_dataset", "left")
    return ordered.select(
        "source_dataset",
        "order_idx",
        F.coalesce("_mean", F.lit(0.0)).alias("score"),
        F.col("_mean").isNotNull().alias("has_scores"),
    )


def macro_mean(scores: DataFrame) -> DataFrame:
    """Mean over the datasets that have scored rows; null when none has."""
    return scores.agg(F.avg(F.when(F.col("has_scores"), F.col("score"))).alias("combined_metric"))


def council_summaries(
    state: DataFrame,
    dataset_name: str = "router_dataset",
    run_id: str = "council",
    model: str = fv.COUNCIL_MODEL,
) -> DataFrame:
    """Summary row per non-empty dataset in fixed order, then the overall row."""
    known = lookup({n: str(i) for i, n in enumerate(fv.DATASETS)}, F.col("source_dataset"))
    overall = F.col("is_overall") == 1
    score = F.try_divide("primary_metric_sum", F.col("scored_examples"))
    per_row = state.filter(overall | (F.col("total_examples") > 0)).withColumn(
        "_score", F.when(~overall, F.coalesce(score, F.lit(0.0)))
    )
    counted = ~overall & (F.col("scored_examples") > 0)
    # One row per dataset is left, so a single window frame is enough.
    combined = F.avg(F.when(counted, score)).over(W.partitionBy(F.lit(0)))
    value = F.when(overall, combined).otherwise(F.col("_score"))
    return (
        per_row.select(
            F.lit(run_id).alias("suite_id"),
            F.when(overall, dataset_name).otherwise(F.col("source_dataset")).alias("dataset_name"),
            F.lit(model).alias("model"),
            F.when(overall, "combined_metric")
            .otherwise(primary_metric(F.col("source_dataset")))
            .alias("primary_metric"),
            value.alias("primary_metric_value"),
            "total_examples",
            "scored_examples",
            "failed_examples",
            _average("total_latency_ms", 1000.0).alias("avg_latency_s"),
            _average("total_latency_ms").alias("avg_latency_ms"),
            "total_input_tokens",
            "total_output_tokens",
            "total_tokens",
            _average("total_input_tokens").alias("avg_input_tokens"),
            _average("total_output_tokens").alias("avg_output_tokens"),
            _average("total_tokens").alias("avg_total_tokens"),
            F.when(overall, F.lit(len(fv.DATASETS))).otherwise(known.cast("int")).alias("order_idx"),
        )
        .orderBy("order_idx")
    )
