"""Queries that summarise suites, compare policies and rank models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.operators import comparison, leaderboard, scoring, summaries
from tallyframe.operators.running import RunningStatistics
from tallyframe.plans.fixtures import table, view
from tallyframe.plans.registry import query
from tallyframe.plans.texts import METRIC_COLUMNS, SCORED, matched_responses
from tallyframe.session import saved_table, work_path

_SUITE = f"""{SCORED},
ok AS (SELECT *, prediction_status = 'success' AS good FROM metric)"""
_MEANS = ", ".join(
    f"round(avg(CASE WHEN good THEN {m} END), 6) AS {m}" for m in METRIC_COLUMNS
)
_PRIMARY = "coalesce(token_f1, label_accuracy, math_exact_match, pass_at_1)"
_PRIMARY_NAME = """CASE dataset WHEN 'musique' THEN 'token_f1' WHEN 'quality' THEN 'token_f1'
 WHEN 'fever' THEN 'label_accuracy' WHEN 'hardmath' THEN 'math_exact_match' ELSE 'pass_at_1' END"""


def suite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_predictions(matched_responses(spark, sf_dir))


@query(
    f"""WITH {_SUITE} SELECT dataset AS dataset_name, model, {_PRIMARY_NAME} AS primary_metric,
    round(avg(CASE WHEN good THEN {_PRIMARY} END), 6) AS primary_metric_value, {_MEANS},
    CAST(count_if(good) AS BIGINT) AS scored_examples, CAST(count_if(NOT good) AS BIGINT) AS failed_examples, count(*) AS total_examples
    FROM ok GROUP BY dataset, model"""
)
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: extract, score, roll up per dataset and model, look up the primary metric."""
    rows = summaries.suite_rows(summaries.pair_summaries(suite_scores(spark, sf_dir)))
    means = [
        F.round(F.try_element_at("aggregated_metrics", F.lit(m)), 6).alias(m)
        for m in METRIC_COLUMNS
    ]
    return rows.select(
        "dataset_name",
        "model",
        "primary_metric",
        F.round("primary_metric_value", 6).alias("primary_metric_value"),
        *means,
        "scored_examples",
        "failed_examples",
        "total_examples",
    )


_LONG = " UNION ALL ".join(
    f"SELECT dataset AS dataset_name, model, '{m}' AS metric, round(avg({m}), 6) AS mean, count({m}) AS n "
    f"FROM ok WHERE good GROUP BY dataset, model HAVING count({m}) > 0"
    for m in (*METRIC_COLUMNS,)
)


@query(
    f"""WITH {_SUITE} SELECT * FROM ({_LONG} UNION ALL SELECT dataset, model, 'answerable',
    round(avg(CAST(answerable AS DOUBLE)), 6), count(*) FROM ok WHERE good AND dataset = 'musique'
    GROUP BY dataset, model)"""
)
def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = summaries.mean_metrics(suite_scores(spark, sf_dir))
    return means.withColumn("mean", F.round("mean", 6))


@query(
    """SELECT count(DISTINCT dataset || model) AS total_pairs, count(*) AS total_examples,
    CAST(count_if(prediction_status = 'success') AS BIGINT) AS scored_examples,
    CAST(count_if(prediction_status <> 'success') AS BIGINT) AS failed_examples FROM fx_responses"""
)
def suite_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.suite_counters(summaries.pair_summaries(suite_scores(spark, sf_dir)))


@query(
    """SELECT user_id AS example_id, CASE WHEN event_type = 'error' THEN 'prediction_error'
    WHEN value < 1 THEN 'metric_error' ELSE 'scored' END AS status,
    CASE WHEN event_type = 'error' THEN 'PredictionError' WHEN value < 1 THEN 'ValueError' END AS error_type,
    CASE WHEN event_type = 'error' THEN 'prediction failed' WHEN value < 1 THEN 'too small' END AS error_message,
    CASE WHEN event_type <> 'error' AND value >= 1 THEN CAST(length(event_type) AS DOUBLE) END AS text_length
    FROM events"""
)
def custom_metric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    def length_unless_small(text: str, value: str) -> dict[str, float]:
        if float(value) < 1:
            raise ValueError("too small")
        return {"text_length": float(len(text))}

    matched = table(spark, sf_dir, "events").select(
        F.lit("events").alias("dataset_name"),
        F.lit("model-a").alias("model"),
        F.col("user_id").alias("example_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.col("event_type").alias("response_text"),
        F.col("value").cast("string").alias("value"),
    )
    scores = scoring.score_with_metric(
        matched, scoring.custom_metric(length_unless_small), F.col("value")
    )
    return scores.select(
        "example_id",
        "status",
        "error_type",
        "error_message",
        F.try_element_at("metrics", F.lit("text_length")).alias("text_length"),
    )


# Two log dialects over the flat log: policy P1 in the first, the others in the second.
_RAW_SQL = """raw AS (SELECT *, policy = 'P1' AS first_dialect, coalesce(output_tokens, 0) AS tout FROM fx_log),
log AS (SELECT row_ordinal, policy, query_id, query_id AS example_id, dataset,
  CASE WHEN first_dialect THEN status WHEN status = 'error' THEN 'error' ELSE 'success' END AS status,
  primary_metric, coalesce(latency_ms, 0) AS wall_latency_ms, task_tag, predicted_tag,
  CASE WHEN predicted_tag IS NOT NULL THEN task_tag = predicted_tag END AS routed_correctly,
  input_tokens, tout AS output_tokens, input_tokens + tout AS total_tokens FROM raw)"""


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat log written the way the two kinds of runs write theirs."""
    log = view(spark, sf_dir, "fx_log")
    first = F.col("policy") == "P1"
    inputs = F.col("input_tokens").cast("string")
    outputs = F.col("output_tokens").cast("string")
    metric = F.create_map(
        F.when(F.col("dataset") == "fever", "label_accuracy")
        .when(F.col("dataset") == "hardmath", "math_exact_match")
        .when(F.col("dataset") == "humaneval_plus", "pass_at_1")
        .otherwise("token_f1"),
        F.col("primary_metric"),
    )
    none = F.lit(None)
    texts = F.array().cast("array<string>")
    return log.select(
        "policy",
        F.when(~first, F.col("query_id")).alias("query_id"),
        F.when(first, F.col("query_id")).alias("example_id"),
        F.when(~first, F.col("dataset")).alias("dataset"),
        F.when(first, F.col("dataset")).alias("dataset_name"),
        "model",
        F.when(first, F.col("status")).alias("status"),
        F.when(~first, F.col("status") == "error").alias("failed"),
        F.when(first, F.create_map(F.lit("input_tokens"), inputs, F.lit("output_tokens"), outputs))
        .otherwise(
            F.create_map(F.lit("prompttokens"), inputs, F.lit("completion_tokens"), outputs)
        )
        .alias("usage"),
        none.cast("double").alias("wall_latency_ms"),
        F.when(first, F.col("latency_ms")).alias("latency_ms"),
        F.when(~first, F.col("latency_ms")).alias("latencyms"),
        metric.alias("metrics"),
        F.when(first, F.col("primary_metric")).alias("primary_metric"),
        F.when(first, F.col("task_tag")).alias("task_tag"),
        F.when(~first, F.col("task_tag")).alias("tasktype"),
        none.cast("string").alias("task_type"),
        none.cast("string").alias("predicted_tag"),
        F.col("predicted_tag").alias("routedrole"),
        none.cast("string").alias("routed_role"),
        none.cast("boolean").alias("routed_correctly"),
        texts.alias("gold_answers"),
        F.struct(texts.alias("answers"), F.col("task_tag").alias("answer")).alias("reference"),
        F.lit("").alias("final_answer"),
        F.col("model").alias("response_text"),
        none.cast("string").alias("responsetext"),
        "row_ordinal",
    )


def normalized_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.normalize_log(raw_log(spark, sf_dir))


@query(
    f"""WITH {_RAW_SQL} SELECT row_ordinal, policy, query_id, example_id, dataset, status, primary_metric,
    wall_latency_ms, task_tag, predicted_tag, routed_correctly, input_tokens, output_tokens, total_tokens,
    task_tag AS gold, (SELECT model FROM fx_log f WHERE f.row_ordinal = log.row_ordinal) AS final_answer
    FROM log"""
)
def unified_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = normalized_log(spark, sf_dir)
    return log.withColumn("gold", F.array_join("gold_answers", "|")).drop("gold_answers")


@query(
    """SELECT row_ordinal, CASE WHEN policy <> 'P1' THEN dataset END AS dataset,
    CASE WHEN policy = 'P1' THEN status WHEN status = 'error' THEN 'error' ELSE 'success' END AS status,
    CASE WHEN policy = 'P1' THEN query_id ELSE query_id END AS example_id,
    CASE WHEN policy = 'P1' THEN output_tokens ELSE coalesce(output_tokens, 0) END AS output_tokens
    FROM fx_log"""
)
def unified_log_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = comparison.normalize_log(raw_log(spark, sf_dir), legacy=True)
    return log.select("row_ordinal", "dataset", "status", "example_id", "output_tokens")


@query(
    f"""WITH {_RAW_SQL} SELECT policy, example_id, count(*) AS calls,
    CAST(sum(total_tokens) AS BIGINT) AS tokens FROM log WHERE status = 'success' GROUP BY ALL"""
)
def calls_per_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.calls_per_example(normalized_log(spark, sf_dir))


@query(
    f"""WITH {_RAW_SQL}, per AS (SELECT policy, example_id, count(*) AS calls, sum(total_tokens) AS tokens
      FROM log WHERE status = 'success' GROUP BY ALL)
    SELECT policy, count(*) AS examples, round(avg(tokens), 6) AS avg_tokens_per_question,
    round(avg(calls), 6) AS avg_calls_per_question,
    (SELECT round(avg(wall_latency_ms), 6) FROM log WHERE log.policy = per.policy AND status = 'success'
      AND wall_latency_ms > 0) AS avg_latency_per_question FROM per GROUP BY policy"""
)
def efficiency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = comparison.efficiency_report(normalized_log(spark, sf_dir))
    rounded = ("avg_tokens_per_question", "avg_calls_per_question", "avg_latency_per_question")
    return report.withColumns({name: F.round(name, 6) for name in rounded})


_ACCURACY = """acc AS (SELECT policy, dataset, round(avg(primary_metric), 4) AS value FROM log
 WHERE status = 'success' AND dataset <> '' GROUP BY ALL)"""


@query(f"WITH {_RAW_SQL}, {_ACCURACY} SELECT * FROM acc")
def accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.accuracy_table(normalized_log(spark, sf_dir))


@query(
    f"""WITH {_RAW_SQL} SELECT policy, dataset, round(avg(wall_latency_ms), 1) AS value FROM log
    WHERE status = 'success' AND wall_latency_ms > 0 GROUP BY ALL"""
)
def latency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.latency_table(normalized_log(spark, sf_dir))


_CELLS = ", ".join(f"max(CASE WHEN dataset = '{d}' THEN value END) AS {d}" for d in fv.DATASETS)


@query(
    f"""WITH {_RAW_SQL}, {_ACCURACY} SELECT policy, {_CELLS}, round(avg(value), 6) AS avg
    FROM acc GROUP BY policy"""
)
def wide_accuracy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracy = comparison.accuracy_table(normalized_log(spark, sf_dir))
    return comparison.wide_table(accuracy).withColumn("avg", F.round("avg", 6))


_ROUTED = "round(avg(CAST(routed_correctly AS DOUBLE)), 4)"


@query(
    f"""WITH {_RAW_SQL} SELECT policy, dataset, {_ROUTED} AS accuracy FROM log
    WHERE routed_correctly IS NOT NULL GROUP BY ALL"""
)
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.routing_accuracy(normalized_log(spark, sf_dir))


@query(
    f"""WITH {_RAW_SQL}, acc AS (SELECT policy, dataset, {_ROUTED} AS accuracy FROM log
      WHERE routed_correctly IS NOT NULL GROUP BY ALL)
    SELECT coalesce(a.dataset, b.dataset) AS dataset, a.accuracy AS p3_accuracy, b.accuracy AS p4_accuracy
    FROM (SELECT * FROM acc WHERE policy = 'P3') a FULL JOIN (SELECT * FROM acc WHERE policy = 'P4') b
    ON a.dataset = b.dataset"""
)
def routing_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.routing_comparison(normalized_log(spark, sf_dir))


_DISAGREE = """diff AS (SELECT a.query_id, b.task_tag AS oracle_tag, a.predicted_tag AS p3_tag,
  b.predicted_tag AS p4_tag, b.predicted_tag IS NOT DISTINCT FROM b.task_tag AS p4_correct
  FROM (SELECT * FROM log WHERE policy = 'P3') a JOIN (SELECT * FROM log WHERE policy = 'P4') b USING (query_id)
  WHERE a.predicted_tag IS DISTINCT FROM b.predicted_tag)"""


@query(f"WITH {_RAW_SQL}, {_DISAGREE} SELECT * FROM diff")
def policy_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.disagreements(normalized_log(spark, sf_dir))


@query(
    f"""WITH {_RAW_SQL}, {_DISAGREE} SELECT count(*) AS n_disagreements, CAST(count_if(p4_correct) AS BIGINT) AS p4_wins,
    CAST(count_if(NOT p4_correct) AS BIGINT) AS p4_loses FROM diff"""
)
def disagreement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = normalized_log(spark, sf_dir)
    return comparison.disagreement_counts(comparison.disagreements(log))


@query(f"WITH {_RAW_SQL}, {_DISAGREE} SELECT * FROM diff ORDER BY query_id LIMIT 20")
def disagreement_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = normalized_log(spark, sf_dir)
    return comparison.disagreement_sample(comparison.disagreements(log))


@query(
    f"""WITH {_RAW_SQL} SELECT policy, round(avg(primary_metric), 4) AS avg_accuracy,
    round(avg(total_tokens), 1) AS avg_total_tokens,
    round(avg(CASE WHEN wall_latency_ms > 0 THEN wall_latency_ms END), 1) AS avg_latency_ms
    FROM log WHERE status = 'success' GROUP BY policy"""
)
def pareto_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.pareto_points(normalized_log(spark, sf_dir))


# Scores of many models over many datasets: discount by priority or flag, and year.
_GRADES = """SELECT o_orderpriority AS model, CAST(year(o_orderdate) AS VARCHAR) AS dataset,
 l_discount * l_quantity AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_MATRIX = f"""grades AS ({_GRADES}), matrix AS (SELECT model, dataset, avg(score) AS avg_score,
 count(*) AS num_samples FROM grades GROUP BY ALL)"""


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        F.col("o_orderpriority").alias("model"),
        F.year("o_orderdate").cast("string").alias("dataset"),
        (F.col("l_discount") * F.col("l_quantity")).alias("score"),
    )


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.results_matrix(grades(spark, sf_dir))


@query(
    f"""WITH grades AS ({_GRADES}) SELECT model, dataset, count(*) AS n, round(avg(score), 6) AS mean,
    round(stddev_pop(score), 6) AS std, round(min(score), 6) AS min, round(max(score), 6) AS max,
    round(median(score), 6) AS median FROM grades GROUP BY ALL"""
)
def batch_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = leaderboard.batch_statistics(grades(spark, sf_dir))
    rounded = ("mean", "std", "min", "max", "median")
    return stats.withColumns({name: F.round(name, 6) for name in rounded})


@query(
    f"""WITH grades AS ({_GRADES}), halved AS (SELECT * FROM grades UNION ALL SELECT model, dataset, -score FROM grades WHERE score > 2)
    SELECT model, dataset, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
    round(min(score), 6) AS min, round(max(score), 6) AS max, round(median(score), 6) AS median, false AS repeated FROM halved GROUP BY ALL"""
)
def statistics_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of three batches, merged; the third has scores below zero, and a batch that comes
    again is not counted again. No batch reads the scores of another."""
    scores = saved_table(grades(spark, sf_dir), "grades")
    running = RunningStatistics(spark, work_path(spark, "running"))
    half = F.pmod(F.xxhash64("model", "score"), F.lit(2))
    running.add(scores.filter(half == 0), 0)
    running.add(scores.filter(half == 1), 1)
    running.add(scores.filter("score > 2").withColumn("score", -F.col("score")), 2)
    repeated = running.add(scores, 1)
    stats = running.statistics().withColumn("repeated", F.lit(repeated))
    return stats.withColumns({name: F.round(name, 6) for name in ("mean", "std", "min", "max", "median")})


@query(
    f"""WITH {_MATRIX} SELECT model, dataset, round(avg_score, 6) AS avg_score, num_samples FROM matrix"""
)
def results_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).withColumn("avg_score", F.round("avg_score", 6))


_RANKED = f"""{_MATRIX}, ranked AS (SELECT dataset, model, row_number() OVER
 (PARTITION BY dataset ORDER BY avg_score DESC, model) AS rank, avg_score FROM matrix)"""


@query(f"WITH {_RANKED} SELECT dataset, model, rank, round(avg_score, 4) AS score FROM ranked")
def dataset_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.dataset_rankings(_matrix(spark, sf_dir)).drop("avg_score")


@query(
    f"""WITH {_RANKED} SELECT dataset, model AS best_model, round(avg_score, 4) AS best_score
    FROM ranked WHERE rank = 1"""
)
def best_per_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.best_per_dataset(_matrix(spark, sf_dir))


@query(
    f"""WITH {_RANKED} SELECT r.model, b.avg_rank, r.dataset, r.rank FROM ranked r
    JOIN (SELECT model, round(avg(rank), 2) AS avg_rank FROM ranked GROUP BY model) b USING (model)"""
)
def model_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board with its column of ranks per dataset, whichever years there are, as rows."""
    board = leaderboard.leaderboard(leaderboard.dataset_rankings(_matrix(spark, sf_dir)))
    ranks = [F.col(name) for name in board.columns if name.startswith("rank_")]
    long = board.unpivot(["model", "avg_rank"], ranks, "dataset", "rank").filter("rank IS NOT NULL")
    return long.withColumn("dataset", F.substring_index("dataset", "rank_", -1))


@query(
    f"""WITH {_RANKED} SELECT model AS best_overall_model, round(avg(rank), 2) AS avg_rank FROM ranked
    GROUP BY model ORDER BY avg_rank, model LIMIT 1"""
)
def best_overall_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = leaderboard.dataset_rankings(_matrix(spark, sf_dir))
    return leaderboard.best_overall(rankings)


@query(
    f"""WITH {_RANKED} SELECT dataset, max(CASE WHEN rank = 1 THEN model END) AS best_model,
    round(max(CASE WHEN rank = 1 THEN avg_score END), 6) AS best_score,
    max(CASE WHEN rank = 2 THEN model END) AS runner_up_model,
    round(max(CASE WHEN rank = 2 THEN avg_score END), 6) AS runner_up_score FROM ranked GROUP BY dataset"""
)
def specialist_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = leaderboard.specialist_map(_matrix(spark, sf_dir))
    return best.withColumns(
        {name: F.round(name, 6) for name in ("best_score", "runner_up_score")}
    )


# Rounded means, so that ties exist.
_TIED = f"""{_MATRIX.replace('avg(score) AS avg_score', 'round(avg(score), 1) AS avg_score')},
placed AS (SELECT model, rank() OVER (PARTITION BY dataset ORDER BY avg_score DESC)
  + (count(*) OVER (PARTITION BY dataset, avg_score) - 1) / 2 AS place FROM matrix)"""


def _tied_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir).withColumn("avg_score", F.round("avg_score", 1))


@query(f"WITH {_TIED} SELECT model, round(avg(place), 6) AS avg_rank FROM placed GROUP BY model")
def average_tied_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = leaderboard.average_ranks(_tied_matrix(spark, sf_dir))
    return ranks.withColumn("avg_rank", F.round("avg_rank", 6))


@query(
    f"""WITH {_TIED} SELECT model, round(avg(place), 6) AS avg_rank FROM placed GROUP BY model
    ORDER BY avg(place), model LIMIT 3"""
)
def council_of_top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = leaderboard.select_council(_tied_matrix(spark, sf_dir), "top5", 3)
    return chosen.withColumn("avg_rank", F.round("avg_rank", 6))


@query(
    f"""WITH {_TIED}, won AS (SELECT DISTINCT model FROM (SELECT model, row_number() OVER
      (PARTITION BY dataset ORDER BY avg_score DESC, model) AS r FROM matrix) WHERE r = 1)
    SELECT model, round(avg(place), 6) AS avg_rank, model IN (SELECT model FROM won) AS is_specialist
    FROM placed GROUP BY model ORDER BY is_specialist DESC, avg(place), model LIMIT 3"""
)
def council_of_specialists(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = leaderboard.select_council(_tied_matrix(spark, sf_dir), "diverse", 3)
    return chosen.withColumn("avg_rank", F.round("avg_rank", 6))


@query(
    """SELECT count(*) AS total_requests, CAST(sum(input_tokens + coalesce(output_tokens, 0)) AS BIGINT) AS total_tokens,
    CAST(sum(input_tokens) AS BIGINT) AS total_prompt_tokens,
    CAST(sum(output_tokens) AS BIGINT) AS total_completion_tokens,
    round(sum(coalesce(latency_ms, 0)) / count(*), 6) AS avg_latency FROM fx_log"""
)
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    total = F.col("input_tokens") + F.coalesce("output_tokens", F.lit(0))
    summary = leaderboard.cost_summary(log.withColumn("total_tokens", total))
    return summary.withColumn("avg_latency", F.round("avg_latency", 6))


@query(
    f"""WITH {_RANKED}, cells AS (SELECT model, dataset, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS std,
      min(score) AS low, max(score) AS high, median(score) AS mid FROM grades GROUP BY ALL),
    board AS (SELECT model, round(avg(rank), 2) AS avg_rank FROM ranked GROUP BY model)
    SELECT 'result' AS section, model AS a, dataset AS b, field, value FROM (SELECT model, dataset,
      unnest(['primary_score', 'count', 'mean', 'std', 'min', 'max', 'median']) AS field,
      unnest([round(mean, 4), CAST(n AS DOUBLE), round(mean, 4), round(std, 4), round(low, 4), round(high, 4), round(mid, 4)]) AS value FROM cells)
    UNION ALL SELECT 'ranking', dataset, model, CAST(rank AS VARCHAR), round(avg_score, 4) FROM ranked
    UNION ALL SELECT 'best', dataset, model, 'score', round(avg_score, 4) FROM ranked WHERE rank = 1
    UNION ALL SELECT 'board', model, 'all', 'avg_rank', avg_rank FROM board
    UNION ALL SELECT 'board', model, dataset, 'rank', CAST(rank AS DOUBLE) FROM ranked
    UNION ALL SELECT 'specialist', dataset, model, CASE rank WHEN 1 THEN 'best' ELSE 'runner_up' END, round(avg_score, 4)
      FROM ranked WHERE rank <= 2
    UNION ALL (SELECT 'overall', model, 'all', 'avg_rank', avg_rank FROM board ORDER BY avg_rank, model LIMIT 1)"""
)
def nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the report, read back from its JSON."""
    made = leaderboard.report(leaderboard.batch_statistics(grades(spark, sf_dir)))
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in made.drop("report").schema)
    whole = made.select(F.from_json("report", f"struct<{kinds}>").alias("r")).select("r.*")

    def rows(section: str, name: str, a: str, b: str | None, *values: tuple) -> DataFrame:
        items = whole.select(F.explode(section).alias("x"))
        pairs = F.array(
            *[F.struct(F.lit(f).alias("field"), F.col(f"x.{v}").cast("double").alias("value")) for f, v in values]
        )
        second = F.lit("all") if b is None else F.col(f"x.{b}")
        listed = items.select(F.lit(name).alias("section"), F.col(f"x.{a}").alias("a"), second.alias("b"), F.explode(pairs).alias("p"))
        return listed.select("section", "a", "b", "p.field", "p.value")

    fields = ("primary_score", "count", "mean", "std", "min", "max", "median")
    results = rows("results", "result", "model", "dataset", *[(f, f) for f in fields])
    ranking = whole.select(F.explode("rankings").alias("x")).select(
        F.lit("ranking").alias("section"), "x.dataset", "x.model", F.col("x.rank").cast("string"), "x.score"
    )
    best = rows("best_per_dataset", "best", "dataset", "best_model", ("score", "best_score"))
    board = rows("leaderboard", "board", "model", None, ("avg_rank", "avg_rank"))
    ranks = whole.select(F.explode("leaderboard").alias("x")).select("x.model", F.explode("x.ranks").alias("dataset", "rank"))
    ranks = ranks.select(F.lit("board"), "model", "dataset", F.lit("rank"), F.col("rank").cast("double"))
    first = rows("specialists", "specialist", "dataset", "best_model", ("best", "best_score"))
    second = rows("specialists", "specialist", "dataset", "runner_up_model", ("runner_up", "runner_up_score"))
    top = F.get("leaderboard", F.lit(0))
    overall = whole.select(F.lit("overall"), "best_overall_model", F.lit("all"), F.lit("avg_rank"), top["avg_rank"])
    out = results
    for part in (ranking, best, board, ranks, first, second, overall):
        out = out.union(part)
    return out


@query(
    """WITH long AS (SELECT model, dataset, unnest(['primary', 'reversed']) AS metric,
      unnest([primary_metric, 1 - primary_metric]) AS score FROM fx_log),
    costs AS (SELECT model, dataset, avg(output_tokens) AS tokens, avg(latency_ms) AS latency FROM fx_log GROUP BY ALL)
    SELECT model, dataset, metric, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
    min(score) AS min, max(score) AS max, median(score) AS median, round(any_value(tokens), 6) AS mean_output_tokens,
    round(any_value(latency), 6) AS mean_latency_ms FROM long JOIN costs USING (model, dataset) GROUP BY model, dataset, metric"""
)
def metric_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    pair = F.create_map(
        F.lit("primary"), F.col("primary_metric"), F.lit("reversed"), 1 - F.col("primary_metric")
    )
    stats = leaderboard.metric_statistics(log.withColumn("metrics", pair), costs=("output_tokens", "latency_ms"))
    rounded = ("mean", "std", "mean_output_tokens", "mean_latency_ms")
    return stats.withColumns({name: F.round(name, 6) for name in rounded})


@query(
    f"""WITH {_RAW_SQL}, matrix AS (SELECT model, dataset, avg(primary_metric) AS s FROM fx_log GROUP BY ALL),
    council AS (SELECT dataset, avg(primary_metric) AS s FROM log WHERE policy = 'P4' GROUP BY ALL)
    SELECT m.dataset, CASE m.dataset WHEN 'musique' THEN 'token_f1' WHEN 'quality' THEN 'token_f1' WHEN 'fever'
      THEN 'label_accuracy' WHEN 'hardmath' THEN 'math_exact_match' ELSE 'pass_at_1' END AS metric,
    round(m.s, 4) AS p1_single_best, round(coalesce(c.s, 0), 4) AS p2_flat_council,
    round(coalesce(c.s, 0) - m.s, 4) AS delta, coalesce(c.s, 0) > m.s AS council_wins
    FROM matrix m LEFT JOIN (SELECT CASE dataset WHEN 'quality' THEN 'other' ELSE dataset END AS dataset, s FROM council) c
    USING (dataset) WHERE m.model = 'model-a'"""
)
def single_best_vs_council(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    matrix = leaderboard.results_matrix(log, "primary_metric")
    # The council has scores of another dataset instead of one of the five.
    named = F.when(F.col("dataset") == "quality", "other").otherwise(F.col("dataset"))
    council = (
        log.filter("policy = 'P4'")
        .groupBy(named.alias("dataset"))
        .agg(F.avg("primary_metric").alias("score"))
    )
    names = spark.createDataFrame(
        [(d, fv.PRIMARY_METRIC[d]) for d in fv.DATASETS], "dataset string, metric string"
    )
    return comparison.single_best_vs_council(matrix, council, "model-a", names)
