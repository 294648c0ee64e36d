"""Comparison of policies over their prediction logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.text import text_or_empty
from tallyframe.session import saved_table
from tallyframe.operators.records import last_by


def _number(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(0.0))


def _text(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def _metric(name: str) -> Column:
    return F.try_element_at(F.col("metrics"), F.lit(name))


def pick_primary(dataset: Column) -> Column:
    """Primary value out of a metric map; the named metrics of a dataset skip zeros."""

    def first_nonzero(*names: str) -> Column:
        return F.coalesce(*[F.nullif(_metric(n), F.lit(0.0)) for n in names], F.lit(0.0))

    fallback = (
        "token_f1",
        "label_accuracy",
        "accuracy",
        "math_exact_match",
        "pass_at_1",
        "exact_match",
    )
    return (
        F.when(dataset.isin("musique", "quality"), first_nonzero("token_f1", "exact_match"))
        .when(dataset == "fever", first_nonzero("label_accuracy", "accuracy", "exact_match"))
        .when(
            dataset == "hardmath", first_nonzero("math_exact_match", "accuracy", "mathexactmatch")
        )
        .when(dataset == "humaneval", first_nonzero("pass_at_1", "pass@1"))
        .otherwise(F.coalesce(*[_metric(n) for n in fallback], F.lit(0.0)))
    )


def normalize_log(log: DataFrame, policy: Column | None = None, legacy: bool = False) -> DataFrame:
    """Both log dialects in one shape (``schemas.POLICY_LOG`` in).

    Rows that already have a status and an ``input_tokens`` key are the first dialect. With
    ``legacy`` they pass through as they are, without dataset and primary metric, and error rows
    of the other dialect count as successes unless flagged as failed. By default they are filled
    in and an existing status is kept.
    """
    usage_key = F.coalesce(
        F.map_contains_key(F.col("usage"), "input_tokens"), F.lit(False)
    )
    ready = F.col("status").isNotNull() & usage_key
    given = F.lit("UNKNOWN") if policy is None else policy

    def tokens(*names: str) -> Column:
        counts = [F.try_element_at("usage", F.lit(n)).try_cast("bigint") for n in names]
        return F.coalesce(*[F.nullif(c, F.lit(0)) for c in counts], F.lit(0))

    read_in = tokens("prompt_tokens", "prompttokens", "input_tokens")
    read_out = tokens("completion_tokens", "completiontokens", "output_tokens")
    read_total = tokens("total_tokens", "totaltokens")
    any_latency = F.coalesce(
        _number("wall_latency_ms"), _number("latency_ms"), _number("latencyms"), F.lit(0.0)
    )
    kept_latency = F.coalesce("wall_latency_ms", "latency_ms", F.lit(0.0))
    dataset = F.coalesce(_text("dataset"), _text("dataset_name"), _text("task_tag"), F.lit(""))
    task = F.coalesce(_text("task_tag"), _text("tasktype"), F.col("task_type"))
    routed = F.coalesce(_text("predicted_tag"), _text("routedrole"), F.col("routed_role"))
    flagged = F.when(F.coalesce("failed", F.lit(False)), "error").otherwise("success")
    some = F.nullif(F.col("gold_answers"), F.array().cast("array<string>"))
    ref_answers = F.nullif(F.col("reference.answers"), F.array().cast("array<string>"))
    ref_answer = F.when(F.col("reference.answer").isNotNull(), F.array("reference.answer"))
    gold = F.coalesce(some, ref_answers, ref_answer, F.array().cast("array<string>"))
    final = F.coalesce(
        _text("final_answer"), _text("response_text"), _text("responsetext"), F.lit("")
    )
    staged = log.withColumn("_ready", ready & F.lit(legacy)).withColumn("_ds", dataset)
    passes = F.col("_ready")
    correct = F.coalesce(
        F.col("routed_correctly"), F.when(task.isNotNull() & routed.isNotNull(), task == routed)
    )
    status = flagged if legacy else F.coalesce("status", flagged)
    if "broken_line" in log.columns:
        # A line that is no JSON has no fields; it is a failed call, never a success.
        status = F.when(F.col("broken_line").isNotNull(), "error").otherwise(status)

    def pick(kept: Column, built: Column) -> Column:
        return F.when(passes, kept).otherwise(built)

    def kept_tokens(name: str) -> Column:
        return F.try_element_at("usage", F.lit(name)).try_cast("bigint")

    ids = {
        "query_id": F.coalesce(_text("query_id"), _text("example_id"), F.lit("")),
        "example_id": F.coalesce(_text("example_id"), _text("query_id"), F.lit("")),
    }
    return staged.select(
        F.when(passes | F.lit(policy is None), F.coalesce("policy", given))
        .otherwise(given)
        .alias("policy"),
        pick(F.col("query_id"), ids["query_id"]).alias("query_id"),
        pick(F.col("example_id"), ids["example_id"]).alias("example_id"),
        pick(F.col("dataset"), F.col("_ds")).alias("dataset"),
        pick(F.col("status"), status).alias("status"),
        pick(
            F.col("primary_metric"), F.coalesce("primary_metric", pick_primary(F.col("_ds")))
        ).alias("primary_metric"),
        pick(kept_latency, any_latency).alias("wall_latency_ms"),
        pick(F.col("task_tag"), task).alias("task_tag"),
        pick(F.col("predicted_tag"), routed).alias("predicted_tag"),
        pick(F.col("routed_correctly"), correct).alias("routed_correctly"),
        pick(F.col("gold_answers"), gold).alias("gold_answers"),
        pick(F.col("final_answer"), final).alias("final_answer"),
        pick(kept_tokens("input_tokens"), read_in).alias("input_tokens"),
        pick(kept_tokens("output_tokens"), read_out).alias("output_tokens"),
        pick(
            kept_tokens("total_tokens"),
            F.coalesce(F.nullif(read_total, F.lit(0)), read_in + read_out),
        ).alias("total_tokens"),
        "row_ordinal",
        *[name for name in ("line_order",) if name in log.columns],
    )


def _success() -> Column:
    return F.coalesce(F.col("status") == "success", F.lit(False))


def _row_tokens() -> Column:
    parts = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return F.coalesce("total_tokens", parts)


def calls_per_example(log: DataFrame, keys: Sequence[str] = ("policy",)) -> DataFrame:
    """Successful calls and their tokens per example."""
    named = text_or_empty(F.col("example_id")) != ""
    return (
        log.filter(_success() & named)
        .groupBy(*keys, "example_id")
        .agg(F.count("*").alias("calls"), F.sum(_row_tokens()).alias("tokens"))
    )


def efficiency_report(log: DataFrame, keys: Sequence[str] = ("policy",)) -> DataFrame:
    """Examples, mean tokens and calls per question and mean latency, per policy or file.

    One aggregation per example, then one over the examples: latency sums ride along, so the
    log is scanned once.
    """
    timed = _success() & (F.col("wall_latency_ms") > 0)
    named = _success() & (text_or_empty(F.col("example_id")) != "")
    per_example = log.groupBy(*keys, "example_id").agg(
        F.count_if(named).alias("_calls"),
        F.sum(F.when(named, _row_tokens())).alias("_tokens"),
        F.sum(F.when(timed, F.col("wall_latency_ms"))).alias("_latency"),
        F.count_if(timed).alias("_timed"),
    )
    has_calls = F.col("_calls") > 0

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    return per_example.groupBy(*keys).agg(
        F.count_if(has_calls).alias("examples"),
        or_zero(F.avg(F.when(has_calls, F.col("_tokens")))).alias("avg_tokens_per_question"),
        or_zero(F.avg(F.when(has_calls, F.col("_calls")))).alias("avg_calls_per_question"),
        or_zero(F.try_divide(F.sum("_latency"), F.sum("_timed"))).alias(
            "avg_latency_per_question"
        ),
    )


def accuracy_table(log: DataFrame) -> DataFrame:
    """Mean primary metric of successes per policy and dataset, to 4 digits."""
    return (
        log.filter(_success() & (text_or_empty(F.col("dataset")) != ""))
        .groupBy("policy", "dataset")
        .agg(F.round(F.avg(F.coalesce("primary_metric", F.lit(0.0))), 4).alias("value"))
    )


def latency_table(log: DataFrame) -> DataFrame:
    """Mean positive latency of successes per policy and dataset, to 1 digit."""
    rows = _success() & (text_or_empty(F.col("dataset")) != "") & (F.col("wall_latency_ms") > 0)
    return (
        log.filter(rows)
        .groupBy("policy", "dataset")
        .agg(F.round(F.avg("wall_latency_ms"), 1).alias("value"))
    )


def wide_table(table: DataFrame, datasets: Sequence[str] | None = None) -> DataFrame:
    """Policies × datasets with the mean of each row's cells; missing cells stay null.

    Without names every dataset of the table gets a column; the small table is written once, and its
    names and its cells read from there. With names the mean, too, is that of the named ones.
    """
    if datasets is None:
        table = saved_table(table, "wide-table")
        datasets = [r[0] for r in table.select("dataset").distinct().orderBy("dataset").collect()]
    else:
        table = table.filter(F.col("dataset").isin(*datasets))
    cells = [F.max(F.when(F.col("dataset") == d, F.col("value"))).alias(d) for d in datasets]
    return table.groupBy("policy").agg(*cells, F.avg("value").alias("avg")).orderBy("policy")


def routing_accuracy(log: DataFrame, keys: Sequence[str] = ("policy", "dataset")) -> DataFrame:
    """Share of correctly routed rows where that is known, to 4 digits."""
    return (
        log.filter(F.col("routed_correctly").isNotNull())
        .groupBy(*keys)
        .agg(F.round(F.avg(F.col("routed_correctly").cast("double")), 4).alias("accuracy"))
    )


def disagreements(log: DataFrame, oracle: str = "P3", learned: str = "P4") -> DataFrame:
    """Queries whose predicted tag differs between two policies; null equals null.

    Both sides are conditional aggregates of one pass: the last row of each policy and query
    counts and no join is needed. Rows of files without an ordinal count in the order of their lines.
    """
    lines = [F.col("line_order")] if "line_order" in log.columns else []
    order = F.struct("row_ordinal", *lines)

    def last(column: str, policy: str) -> Column:
        return last_by(F.col(column), order, F.col("policy") == policy)

    def seen(policy: str) -> Column:
        return F.count_if(F.col("policy") == policy) > 0

    wide = (
        log.filter(F.col("policy").isin(oracle, learned))
        .groupBy("query_id")
        .agg(
            seen(oracle).alias("_in_oracle"),
            seen(learned).alias("_in_learned"),
            last("task_tag", learned).alias("oracle_tag"),
            last("predicted_tag", oracle).alias("p3_tag"),
            last("predicted_tag", learned).alias("p4_tag"),
        )
    )
    differs = ~F.col("p3_tag").eqNullSafe(F.col("p4_tag"))
    return wide.filter("_in_oracle and _in_learned").filter(differs).select(
        "query_id",
        "oracle_tag",
        "p3_tag",
        "p4_tag",
        F.col("p4_tag").eqNullSafe(F.col("oracle_tag")).alias("p4_correct"),
    )


def disagreement_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_disagreements"),
        F.count_if("p4_correct").alias("p4_wins"),
        F.count_if(~F.col("p4_correct")).alias("p4_loses"),
    )


def disagreement_sample(rows: DataFrame, n: int = 20) -> DataFrame:
    """First disagreements by query id."""
    return rows.orderBy("query_id").limit(n)


def routing_comparison(log: DataFrame, oracle: str = "P3", learned: str = "P4") -> DataFrame:
    """Routing accuracy of two policies side by side for every dataset either one has."""
    both = routing_accuracy(log.filter(F.col("policy").isin(oracle, learned)))
    return both.groupBy("dataset").agg(
        F.max(F.when(F.col("policy") == oracle, F.col("accuracy"))).alias("p3_accuracy"),
        F.max(F.when(F.col("policy") == learned, F.col("accuracy"))).alias("p4_accuracy"),
    )


def pareto_points(log: DataFrame) -> DataFrame:
    """Accuracy, tokens and latency per policy, lowest accuracy first."""
    timed = F.when(F.col("wall_latency_ms") > 0, F.col("wall_latency_ms"))
    return (
        log.filter(_success())
        .groupBy("policy")
        .agg(
            F.round(F.avg(F.coalesce("primary_metric", F.lit(0.0))), 4).alias("avg_accuracy"),
            F.round(F.avg(F.coalesce("total_tokens", F.lit(0))), 1).alias("avg_total_tokens"),
            F.round(F.coalesce(F.avg(timed), F.lit(0.0)), 1).alias("avg_latency_ms"),
        )
        .orderBy("avg_accuracy", "policy")
    )


def single_best_vs_council(
    matrix: DataFrame, council: DataFrame, best_model: str, datasets: DataFrame
) -> DataFrame:
    """Best single model against the council per dataset; a missing score counts as 0.

    ``matrix``: ``model, dataset, avg_score``; ``council``: ``dataset, score`` with one row per
    dataset; ``datasets``: ``dataset, metric``.
    """
    single = matrix.filter(F.col("model") == best_model).select(
        "dataset", F.col("avg_score").alias("_p1")
    )
    joined = datasets.join(single, "dataset", "left").join(
        council.select("dataset", F.col("score").alias("_p2")), "dataset", "left"
    )
    p1 = F.coalesce("_p1", F.lit(0.0))
    p2 = F.coalesce("_p2", F.lit(0.0))
    return joined.select(
        "dataset",
        "metric",
        F.round(p1, 4).alias("p1_single_best"),
        F.round(p2, 4).alias("p2_flat_council"),
        F.round(p2 - p1, 4).alias("delta"),
        (p2 > p1).alias("council_wins"),
    )
