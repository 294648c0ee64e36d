"""Batch statistics, rankings and council selection.

Everything after ``batch_statistics`` and ``results_matrix`` works on one row per model and
dataset, so its windows run over models and datasets, never over scored rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.operators.ranking import exact_median
from tallyframe.operators.records import join_null_safe
from tallyframe.session import saved_table


def batch_statistics(
    scores: DataFrame, keys: Sequence[str] = ("model", "dataset"), value: str = "score"
) -> DataFrame:
    """Count, mean, population deviation, extremes and exact median per group.

    The values are written once, as the median reads them three times.
    """
    scores = saved_table(scores.select(*keys, value), "batch-scores")
    number = F.col(value).cast("double")
    basic = scores.groupBy(*keys).agg(
        F.count(number).alias("n"),
        F.avg(number).alias("mean"),
        F.stddev_pop(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    )
    return join_null_safe(basic, exact_median(scores, keys, value, "median"), keys, "left")


def results_matrix(
    scores: DataFrame, value: str = "score", keys: Sequence[str] = ("model", "dataset")
) -> DataFrame:
    """Mean primary score and sample count per model and dataset."""
    return scores.groupBy(*keys).agg(
        F.avg(value).alias("avg_score"), F.count("*").alias("num_samples")
    )


def _best_first() -> list[Column]:
    return [F.col("avg_score").desc(), F.col("model")]


def dataset_rankings(matrix: DataFrame) -> DataFrame:
    """Ordinal rank of each model inside its dataset, ties by model name."""
    rank = F.row_number().over(W.partitionBy("dataset").orderBy(*_best_first()))
    return matrix.select(
        "dataset",
        "model",
        rank.cast("bigint").alias("rank"),
        F.round("avg_score", 4).alias("score"),
        "avg_score",
    )


def best_per_dataset(matrix: DataFrame) -> DataFrame:
    """Best model and score of each dataset."""
    return matrix.groupBy("dataset").agg(
        F.min_by("model", _rank_key()).alias("best_model"),
        F.round(F.max("avg_score"), 4).alias("best_score"),
    )


def _rank_key() -> Column:
    return F.struct((-F.col("avg_score")).alias("s"), F.col("model").alias("m"))


def mean_ranks(rankings: DataFrame) -> DataFrame:
    """Models by mean rank over all their datasets."""
    return rankings.groupBy("model").agg(F.round(F.avg("rank"), 2).alias("avg_rank")).orderBy("avg_rank", "model")


def leaderboard(rankings: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Models by mean rank with their rank in every dataset.

    Without names every ranked dataset gets a column: the rankings, a row per model and dataset, are
    written once, and names and ranks read from there. With names only those are averaged.
    """
    if datasets is None:
        rankings = saved_table(rankings, "rankings")
        found = rankings.select("dataset").distinct().orderBy("dataset").collect()
        datasets = [row[0] for row in found]
    else:
        rankings = rankings.filter(F.col("dataset").isin(*datasets))
    ranks = [
        F.max(F.when(F.col("dataset") == d, F.col("rank"))).alias(f"rank_{d}") for d in datasets
    ]
    return (
        rankings.groupBy("model")
        .agg(F.round(F.avg("rank"), 2).alias("avg_rank"), *ranks)
        .orderBy("avg_rank", "model")
    )


def best_overall(rankings: DataFrame) -> DataFrame:
    """The model of the best mean rank."""
    return mean_ranks(rankings).limit(1).select(F.col("model").alias("best_overall_model"), "avg_rank")


def specialist_map(matrix: DataFrame) -> DataFrame:
    """Best and second-best model per dataset; a lone model is its own runner-up."""
    rank = F.row_number().over(W.partitionBy("dataset").orderBy(*_best_first()))
    ranked = matrix.withColumn("_rank", rank).filter(F.col("_rank") <= 2)

    def at(place: int, column: str) -> Column:
        return F.max(F.when(F.col("_rank") == place, F.col(column)))

    return ranked.groupBy("dataset").agg(
        at(1, "model").alias("best_model"),
        at(1, "avg_score").alias("best_score"),
        F.coalesce(at(2, "model"), at(1, "model")).alias("runner_up_model"),
        F.coalesce(at(2, "avg_score"), at(1, "avg_score")).alias("runner_up_score"),
    )


def average_ranks(matrix: DataFrame) -> DataFrame:
    """Mean of tie-averaged ranks per model, best first."""
    place = F.rank().over(W.partitionBy("dataset").orderBy(F.col("avg_score").desc()))
    ties = F.count("*").over(W.partitionBy("dataset", "avg_score"))
    ranked = matrix.withColumn("_rank", place + (ties - 1) / F.lit(2.0))
    return ranked.groupBy("model").agg(F.avg("_rank").alias("avg_rank")).orderBy(
        "avg_rank", "model"
    )


def select_council(matrix: DataFrame, strategy: str = "top5", size: int = 5) -> DataFrame:
    """Council members: the best mean ranks, or every dataset's best model first."""
    ranks = average_ranks(matrix)
    if strategy == "top5":
        return ranks.limit(size)
    if strategy != "diverse":
        raise ValueError(f"Unknown council strategy: {strategy}")
    winners = specialist_map(matrix).select(F.col("best_model").alias("model")).distinct()
    flagged = ranks.join(winners.withColumn("_wins", F.lit(True)), "model", "left")
    return (
        flagged.select(
            "model", "avg_rank", F.coalesce("_wins", F.lit(False)).alias("is_specialist")
        )
        .orderBy(F.col("is_specialist").desc(), "avg_rank", "model")
        .limit(size)
    )


def cost_summary(calls: DataFrame) -> DataFrame:
    """Requests, token totals and mean latency of a call log."""
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    return calls.agg(
        F.count("*").alias("total_requests"),
        total("total_tokens").alias("total_tokens"),
        total("input_tokens").alias("total_prompt_tokens"),
        total("output_tokens").alias("total_completion_tokens"),
        F.coalesce(
            F.try_divide(F.sum(F.coalesce("latency_ms", F.lit(0.0))), F.count("*")), F.lit(0.0)
        ).alias("avg_latency"),
    )


def metric_statistics(
    scores: DataFrame, keys: Sequence[str] = ("model", "dataset"), costs: Sequence[str] = ()
) -> DataFrame:
    """Statistics of every metric of a ``metrics`` map per group, and the group's mean costs.

    ``costs`` are columns such as tokens and latency, averaged over all rows of the group.
    """
    long = scores.select(*keys, F.explode("metrics").alias("metric", "score"))
    stats = batch_statistics(long, (*keys, "metric"))
    if not costs:
        return stats
    means = scores.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in costs])
    return join_null_safe(stats, means, keys, "left")


def report(statistics: DataFrame, primary_metrics: dict[str, str] | None = None) -> DataFrame:
    """The whole report as one row: its sections, and all of them as JSON.

    ``statistics`` is ``batch_statistics`` by model and dataset; ``primary_metrics`` names the
    metric of each dataset, ``score`` by default. Lists are over models and datasets.
    """
    statistics = saved_table(statistics, "report-cells")
    matrix = statistics.select("model", "dataset", F.col("mean").alias("avg_score"))
    rankings = saved_table(dataset_rankings(matrix), "report-ranks")
    metric = F.lit("score")
    for name, value in (primary_metrics or {}).items():
        metric = F.when(F.col("dataset") == name, value).otherwise(metric)

    def section(rows: DataFrame, name: str, *columns: Column | str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(*columns)))
        return rows.agg(listed.alias(name), F.lit(1).alias("_one"))

    rounded = [F.round(name, 4).alias(name) for name in ("mean", "std", "min", "max", "median")]
    cells = section(
        statistics, "results", "model", "dataset", metric.alias("primary_metric"),
        F.round("mean", 4).alias("primary_score"), F.col("n").alias("count"), *rounded,
    )
    ranks = section(rankings, "rankings", "dataset", "rank", "model", "score")
    best = section(best_per_dataset(matrix), "best_per_dataset", "dataset", "best_model", "best_score")
    by_model = rankings.groupBy("model").agg(
        F.round(F.avg("rank"), 2).alias("avg_rank"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dataset", "rank")))).alias("ranks"),
    )
    # Maps have no order, so the board is sorted by what stands before them.
    entry = F.struct("avg_rank", "model", "ranks")
    order = lambda a, b: F.when((a.avg_rank < b.avg_rank) | ((a.avg_rank == b.avg_rank) & (a.model < b.model)), -1).otherwise(1)
    board = by_model.agg(F.array_sort(F.collect_list(entry), order).alias("leaderboard"), F.lit(1).alias("_one"))
    special = section(
        specialist_map(matrix), "specialists", "dataset", "best_model",
        F.round("best_score", 4).alias("best_score"), "runner_up_model",
        F.round("runner_up_score", 4).alias("runner_up_score"),
    )
    whole = cells
    for part in (ranks, best, board, special):
        whole = whole.join(part, "_one")
    whole = whole.drop("_one").withColumn("best_overall_model", F.get("leaderboard", F.lit(0))["model"])
    return whole.withColumn("report", F.to_json(F.struct(*whole.columns)))
