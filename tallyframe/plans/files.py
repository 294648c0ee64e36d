"""Queries that write a table in the shared folder and read it back."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions import fixed_values as fv
from tallyframe.functions import metrics
from tallyframe.functions.extract import multihop_answer
from tallyframe.operators import cases, comparison, council, leaderboard, predictions, sampling, summaries
from tallyframe.plans import sql_text as q
from tallyframe.plans.fixtures import view
from tallyframe.plans.registry import query
from tallyframe.plans.reports import (
    _MEANS,
    _SUITE,
    METRIC_COLUMNS,
    raw_log,
    suite_scores,
)
from tallyframe.session import work_path
from tallyframe.sources import readers, writers


@query(
    f"""SELECT source_dataset, split, count(*) AS n FROM (SELECT source_dataset,
    CASE WHEN row_number() OVER (PARTITION BY source_dataset ORDER BY {q.shuffle_key('row_ordinal')})
      <= floor(count(*) OVER (PARTITION BY source_dataset) * CAST(0.6 AS DOUBLE)) THEN 'dev' ELSE 'mini-test' END
      AS split FROM fx_raw) WHERE split = 'mini-test' GROUP BY ALL"""
)
def written_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw")
    parts = [
        sampling.unified_rows(
            raw.filter(F.col("source_dataset") == name),
            name,
            F.col("original_id"),
            F.col("question"),
            F.col("context"),
            keep=("row_ordinal",),
        )
        for name in fv.SOURCE_NAMES
    ]
    rows = sampling.split_dev_test(sampling.union_sources(parts), "row_ordinal")
    path = work_path(spark, "mixed")
    writers.write_mixed(rows.drop("row_ordinal"), path)
    test = readers.read_mixed(spark, path, "test")
    return test.groupBy("source_dataset", "split").agg(F.count("*").alias("n"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    none = F.lit(None).cast("string")
    return log.select(
        F.lit("run-1").alias("run_id"),
        F.col("dataset").alias("dataset_name"),
        "model",
        F.col("query_id").alias("example_id"),
        "status",
        F.lit("v1").alias("prompt_version"),
        F.concat(F.lit("said "), F.col("task_tag")).alias("response_text"),
        "latency_ms",
        none.alias("request_id"),
        F.lit("stop").alias("finish_reason"),
        F.lit("local").alias("provider"),
        F.struct(
            "input_tokens",
            "output_tokens",
            (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
            F.lit(None).cast("double").alias("cost"),
            none.alias("currency"),
        ).alias("usage"),
        F.when(F.col("status") == "error", "LLMTransportError").alias("error_type"),
        none.alias("error_message"),
        F.col("completed_at").cast("timestamp").alias("completed_at"),
        "row_ordinal",
    )


@query(
    """SELECT dataset AS dataset_name, model, row_ordinal, query_id AS example_id, status, latency_ms,
    input_tokens, output_tokens, CASE WHEN status = 'error' THEN 'LLMTransportError' END AS error_type
    FROM fx_log"""
)
def appended_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _predictions(spark, sf_dir)
    path = work_path(spark, "predictions")
    early = F.col("completed_at") < "2024-01-15"
    writers.append_predictions(rows.filter(early), path, reset=True)
    writers.append_predictions(rows.filter(~early), path)
    return readers.read_predictions(spark, path).select(
        "dataset_name",
        "model",
        "row_ordinal",
        "example_id",
        "status",
        "latency_ms",
        "usage.input_tokens",
        "usage.output_tokens",
        "error_type",
    )


def _stopped(rows: DataFrame) -> DataFrame:
    """Rows whose writing fails at the last of them, when most files are written."""
    last = F.col("row_ordinal") == rows.agg(F.max("row_ordinal")).first()[0]
    return rows.withColumn("response_text", F.when(last, F.raise_error(F.lit("stopped"))).otherwise(F.col("response_text")))


@query(
    """SELECT dataset AS dataset_name, model, count(*) AS n, CAST(count_if(completed_at < TIMESTAMP '2024-01-15') AS BIGINT) AS first_run,
    CAST(max(row_ordinal) AS BIGINT) AS last_ordinal, true AS failed
    FROM fx_log WHERE completed_at < TIMESTAMP '2024-01-15' OR completed_at >= TIMESTAMP '2024-01-22' GROUP BY ALL"""
)
def failed_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs append to one table; the second fails when most of its files are written. Readers
    see the first and the third."""
    rows = _predictions(spark, sf_dir)
    path, at = work_path(spark, "failed-append"), F.col("completed_at")
    writers.append_predictions(rows.filter(at < "2024-01-15"), path)
    try:
        writers.append_predictions(_stopped(rows.filter((at >= "2024-01-15") & (at < "2024-01-22"))), path)
        failed = False
    except PySparkException:
        failed = True
    writers.append_predictions(rows.filter(at >= "2024-01-22"), path)
    recorded = readers.read_predictions(spark, path)
    return recorded.groupBy("dataset_name", "model").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("completed_at") < "2024-01-15").alias("first_run"),
        F.max("row_ordinal").alias("last_ordinal"),
        F.lit(failed).alias("failed"),
    )


@query(
    """SELECT 'before' AS seen, dataset AS dataset_name, model, count(*) AS n, round(avg(latency_ms), 6) AS avg_latency_ms
    FROM fx_log WHERE completed_at < TIMESTAMP '2024-01-15' GROUP BY ALL
    UNION ALL SELECT 'failed reset', dataset, model, count(*), round(avg(latency_ms), 6)
    FROM fx_log WHERE completed_at < TIMESTAMP '2024-01-15' GROUP BY ALL
    UNION ALL SELECT 'after', dataset, model, count(*), round(avg(latency_ms), 6)
    FROM fx_log WHERE completed_at >= TIMESTAMP '2024-01-15' GROUP BY ALL"""
)
def swapped_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset puts one run in the place of another at once: a reader from before goes on with the old
    rows, a failed reset changes nothing, a new reader has the new rows alone."""
    rows = _predictions(spark, sf_dir)
    path, early = work_path(spark, "swapped-run"), F.col("completed_at") < "2024-01-15"
    writers.append_predictions(rows.filter(early), path)
    before = readers.read_predictions(spark, path)
    try:
        writers.append_predictions(_stopped(rows.filter(~early)), path, reset=True)
    except PySparkException:
        failed = readers.read_predictions(spark, path)
    writers.append_predictions(rows.filter(~early), path, reset=True)
    seen = {"before": before, "failed reset": failed, "after": readers.read_predictions(spark, path)}
    views = [
        df.groupBy(F.lit(name).alias("seen"), "dataset_name", "model").agg(
            F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms")
        )
        for name, df in seen.items()
    ]
    return views[0].unionByName(views[1]).unionByName(views[2])


@query(
    """SELECT DISTINCT query_id AS example_id FROM fx_log"""
)
def recorded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "recorded")
    writers.append_predictions(_predictions(spark, sf_dir), path, reset=True)
    return readers.read_recorded_ids(spark, path)


@query(
    """SELECT dataset AS file_dataset, model AS file_model, count(*) AS n, count(latency_ms) AS timed
    FROM fx_log GROUP BY ALL"""
)
def suite_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files named by pair, found by glob and told apart by their names."""
    suite = work_path(spark, "suite")
    rows = _predictions(spark, sf_dir).withColumn(
        "pair", F.concat_ws("__", "dataset_name", "model")
    )
    rows.hint("rebalance", F.col("pair")).write.partitionBy("pair").json(f"{suite}/predictions")
    found = readers.read_suite(spark, suite)
    return found.groupBy("file_dataset", "file_model").agg(
        F.count("*").alias("n"), F.count("latency_ms").alias("timed")
    )


@query(
    f"""WITH {_SUITE} SELECT dataset AS dataset_name, model, CAST(count(*) AS BIGINT) AS total_examples,
    {_MEANS} FROM ok GROUP BY dataset, model"""
)
def written_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores appended, read back, summarised, and the summaries written as small JSON."""
    scores_path = work_path(spark, "scores")
    writers.append_scores(suite_scores(spark, sf_dir), scores_path, reset=True)
    scores = readers.read_predictions(spark, scores_path, schemas.SCORE)
    summary_path = work_path(spark, "summaries")
    summary = summaries.pair_summaries(scores)
    writers.write_small_json(summary, summary_path)
    back = spark.read.schema(summary.schema).json(summary_path)
    means = [
        F.round(F.try_element_at("aggregated_metrics", F.lit(m)), 6).alias(m)
        for m in METRIC_COLUMNS
    ]
    return back.select("dataset_name", "model", "total_examples", *means)


@query(
    """SELECT 'run-1' AS run_id, dataset AS dataset_name, count(*) AS example_count,
    (SELECT count(*) FROM fx_responses) AS total_examples,
    (SELECT CAST(count_if(prediction_status = 'success') AS BIGINT) FROM fx_responses) AS completed_examples
    FROM fx_responses GROUP BY dataset"""
)
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_responses").withColumnRenamed("dataset", "dataset_name")
    counters = rows.agg(
        F.count("*").alias("total_examples"),
        F.count_if(F.col("prediction_status") == "success").alias("completed_examples"),
    )
    made = writers.manifest(rows, "run-1", {"models": ["model-a"]}, counters)
    path = work_path(spark, "manifest")
    writers.write_small_json(made, path)
    back = spark.read.schema(made.schema).json(path)
    return back.select("run_id", F.explode("datasets").alias("d"), "summary.*").select(
        "run_id", "d.dataset_name", "d.example_count", "total_examples", "completed_examples"
    )


@query(
    """WITH said AS (SELECT CASE example_id % 5 WHEN 0 THEN 'musique' WHEN 1 THEN 'quality' WHEN 2 THEN 'fever'
      WHEN 3 THEN 'hardmath' ELSE 'humaneval_plus' END AS dataset, CAST(example_id AS VARCHAR) AS sample_id, role,
      row_ordinal, answer_text, replace(answer_text, 'answer ', '') AS extracted FROM fx_votes),
    counted AS (SELECT dataset, sample_id, extracted, count(*) AS n, min(row_ordinal) AS first FROM said GROUP BY ALL),
    won AS (SELECT dataset, sample_id, arg_max(extracted, struct_pack(n := n, f := -first)) AS council_answer
      FROM counted GROUP BY ALL)
    SELECT s.dataset, s.sample_id, s.role AS model, s.answer_text AS answer, s.extracted, w.council_answer,
    'click' AS reference, CAST(w.council_answer = 'click' AS DOUBLE) AS exact_match
    FROM said s JOIN won w USING (dataset, sample_id)"""
)
def voting_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample voting log, written and read back; one row per member here."""
    votes = view(spark, sf_dir, "fx_votes")
    names = F.array(*[F.lit(d) for d in fv.DATASETS])
    members = votes.select(
        F.element_at(names, (F.col("example_id") % 5 + 1).cast("int")).alias("dataset"),
        F.col("example_id").cast("string").alias("sample_id"),
        F.col("role").alias("model"),
        F.col("answer_text").alias("answer"),
        F.replace("answer_text", F.lit("answer "), F.lit("")).alias("extracted_answer"),
        F.col("row_ordinal").alias("position"),
    )
    chosen = council.majority_of_answers(members, ("dataset", "sample_id"))
    right = metrics.exact_match(F.col("council_answer"), F.lit("click"))
    judged = chosen.withColumns(
        {"reference": F.lit("click"), "scores": F.create_map(F.lit("exact_match"), right)}
    )
    log = council.voting_log(members, judged)
    path = work_path(spark, "voting")
    writers.write_voting_log(log, path)
    back = spark.read.schema(log.schema).json(path)
    return back.select(
        "dataset", "sample_id", F.explode("individual_answers").alias("one"), "council_answer", "reference",
        F.element_at("scores", F.lit("exact_match")).alias("exact_match"),
    ).select("dataset", "sample_id", "one.*", "council_answer", "reference", "exact_match")


@query(
    """SELECT CAST(row_ordinal AS VARCHAR) AS example_id, question AS user_text, 'model-a' AS model
    FROM fx_raw"""
)
def exported_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw")
    examples = raw.select(
        F.col("source_dataset").alias("dataset_name"),
        F.col("row_ordinal").cast("string").alias("example_id"),
        F.lit("model-a").alias("model"),
        "question",
        F.lit(None).cast("string").alias("context"),
    )
    requests = cases.with_resolved_messages(cases.build_requests(examples))
    tagged = requests.withColumn(
        "provider_params",
        F.create_map(F.lit("user"), F.to_json(F.array("example_id"))),
    )
    path = work_path(spark, "payloads")
    writers.write_payloads(predictions.request_payload(tagged), path)
    text = spark.read.text(path)
    body = F.from_json(
        "value",
        "model string, user array<string>, messages array<struct<role:string,content:string>>",
    )
    return text.select(body.alias("body")).select(
        F.get("body.user", F.lit(0)).alias("example_id"),
        F.get("body.messages", F.lit(0))["content"].alias("user_text"),
        "body.model",
    )


@query(
    """SELECT model, count(*) AS calls, CAST(count_if(status = 'error') AS BIGINT) AS errors,
    round(avg(latency_ms), 6) AS avg_latency_ms, CAST(min(day(completed_at)) AS BIGINT) AS first_day
    FROM fx_log GROUP BY model"""
)
def model_call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    lines = log.select(
        F.col("query_id").alias("event_id"),
        F.date_format("completed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("started_at"),
        "model",
        "latency_ms",
        F.when(F.col("status") == "error", "LLMTransportError").alias("error_type"),
    )
    path = work_path(spark, "calls")
    lines.write.json(path)
    calls = readers.read_calls(spark, path)
    return calls.groupBy("model").agg(
        F.count("*").alias("calls"),
        F.count("error_type").alias("errors"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.min(F.dayofmonth(F.to_utc_timestamp("started_at", F.current_timezone())))
        .cast("bigint")
        .alias("first_day"),
    )


@query(
    """SELECT policy, dataset, round(avg(primary_metric), 4) AS value FROM fx_log
    WHERE status = 'success' GROUP BY ALL"""
)
def policy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log file set per policy, read together; a missing file gives no rows."""
    log = raw_log(spark, sf_dir)
    inputs = []
    for policy in ("P1", "P3", "P4"):
        path = work_path(spark, f"log-{policy}")
        log.filter(F.col("policy") == policy).write.json(path)
        inputs.append((policy.lower(), path))
    inputs.append(("p9", work_path(spark, "nowhere")))
    return comparison.accuracy_table(readers.read_policies(spark, inputs))


@query(
    """SELECT CAST(total_tokens AS BIGINT) AS total_tokens, total_requests FROM
    (SELECT sum(input_tokens + coalesce(output_tokens, 0)) AS total_tokens, count(*) AS total_requests FROM fx_log)"""
)
def logged_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "cost-log")
    raw_log(spark, sf_dir).write.json(path)
    log = readers.read_policy_log(spark, path, "ALL")
    summary = leaderboard.cost_summary(log.withColumnRenamed("wall_latency_ms", "latency_ms"))
    return summary.select("total_tokens", "total_requests")


@query(
    """SELECT CAST(example_id AS VARCHAR) AS example_id, extracted FROM fx_extracted
    WHERE dataset = 'musique'"""
)
def extraction_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_responses").filter("dataset = 'musique'")
    lines = rows.select(F.col("example_id").cast("string").alias("example_id"), "response_text")
    path = work_path(spark, "responses")
    lines.write.json(path)
    back = readers.read_json(spark, path, "example_id string, response_text string")
    return back.select("example_id", multihop_answer(F.col("response_text")).alias("extracted"))
