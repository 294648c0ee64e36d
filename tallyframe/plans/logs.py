"""Queries on the rough sides of real logs: no ordinals, torn lines, repeated ids, odd names, restarts,
and on profiles and metrics that a caller brings along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.text import strip, text_or_empty
from tallyframe.operators import comparison, predictions, scoring
from tallyframe.plans.councils import _FLOW_SQL, council_flow
from tallyframe.plans.fixtures import table, view
from tallyframe.plans.registry import query
from tallyframe.plans.reports import _DISAGREE, _RAW_SQL, raw_log
from tallyframe.plans.streams import _log_stream
from tallyframe.plans.texts import matched_responses
from tallyframe.session import work_path
from tallyframe.sources import readers, writers
from tallyframe.streaming import incremental


@query(f"WITH {_RAW_SQL}, {_DISAGREE} SELECT * FROM diff")
def file_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disagreements of logs whose lines have no ordinal. Every query is logged twice; the later
    file counts."""
    log = raw_log(spark, sf_dir).drop("row_ordinal")
    stale = log.withColumn("routedrole", F.concat(F.lit("stale "), F.col("policy")))
    policies = None
    for policy in ("P1", "P3", "P4"):
        path = work_path(spark, f"lines-{policy}")
        mine = F.col("policy") == policy
        stale.filter(mine).write.json(f"{path}/1")
        log.filter(mine).write.json(f"{path}/2")
        part = readers.read_policy_log(spark, [f"{path}/1", f"{path}/2"], policy)
        policies = part if policies is None else policies.unionByName(part)
    return comparison.disagreements(policies)


@query(
    """SELECT policy, count(*) AS n, CAST(count_if(row_ordinal % 10 = 0 OR status = 'error') AS BIGINT) AS errors,
    round(avg(CASE WHEN row_ordinal % 10 <> 0 AND status = 'success' THEN primary_metric END), 6) AS accuracy
    FROM fx_log GROUP BY policy"""
)
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth line is torn. It counts as an error and not as a success of 0."""
    log = view(spark, sf_dir, "fx_log")
    fields = F.struct("query_id", "dataset", "status", "primary_metric", "row_ordinal")
    line = F.to_json(fields)
    torn = F.when(F.col("row_ordinal") % 10 == 0, F.substring(line, F.lit(1), F.length(line) - 9))
    parts = []
    for policy in ("P1", "P3", "P4"):
        path = work_path(spark, f"torn-{policy}")
        mine = log.filter(F.col("policy") == policy)
        mine.select(F.coalesce(torn, line).alias("value")).write.text(path)
        parts.append(readers.read_policy_log(spark, path, policy))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    good = F.col("status") == "success"
    return whole.groupBy("policy").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.round(F.avg(F.when(good, F.col("primary_metric"))), 6).alias("accuracy"),
    )


@query(
    """SELECT p.row_ordinal, p.row_ordinal % 50 AS example_id, c.label AS reference FROM fx_raw p
    JOIN (SELECT row_ordinal % 50 AS id, arg_max(label, row_ordinal) AS label FROM fx_raw GROUP BY 1) c
    ON c.id = p.row_ordinal % 50"""
)
def repeated_case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many cases of one id: each prediction meets the last one, once."""
    raw = view(spark, sf_dir, "fx_raw")
    example = F.col("row_ordinal") % 50
    made = raw.select("row_ordinal", example.alias("example_id"))
    cases = raw.select(
        example.alias("example_id"), F.col("label").alias("reference"), F.col("row_ordinal").alias("case_order")
    )
    return predictions.match_cases(made, cases, ["example_id"], order="case_order")


@query(
    f"""WITH {_FLOW_SQL}, rows AS (SELECT CAST(CAST(floor(event_id / 2) AS BIGINT) AS VARCHAR) AS example_id,
      count(*) AS n FROM events GROUP BY 1)
    SELECT example_id, n AS score_rows, phase_status FROM judged JOIN rows USING (example_id)
    WHERE phase_status <> 'missing_synth_record'"""
)
def repeated_council_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Council rows that share an id: a score row each, no more."""
    specialist, synth, scores = council_flow(spark, sf_dir, repeated=True)
    counted = scores.groupBy("example_id").agg(
        F.count("*").alias("score_rows"), F.max("status").alias("status"), F.max("error_type").alias("error_type")
    )
    phase = (
        F.when(F.col("status") == "scored", "completed")
        .when(F.col("error_type") == "MissingDecision", "specialist_failed")
        .otherwise("synthesizer_failed")
    )
    return counted.select("example_id", "score_rows", phase.alias("phase_status"))


_NAMES = ("Org/Model 7B", "Org/Model_7B", "Org Model 7B")


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS model, count(*) AS recorded, CAST(count_if(row_ordinal % 2 = 1) AS BIGINT) AS resumed, "
        "CAST(0 AS BIGINT) AS left_over FROM fx_raw"
        for name in _NAMES
    )
    + ")"
)
def resumed_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that goes on from its files. The model names share one slug and stay apart."""
    examples = view(spark, sf_dir, "fx_raw").select(
        F.col("source_dataset").alias("dataset_name"),
        F.col("row_ordinal").cast("string").alias("example_id"),
        "row_ordinal",
    )
    planned = predictions.fan_out(examples, _NAMES).withColumn("status", F.lit("success"))
    path = work_path(spark, "resumed")
    writers.append_predictions(planned.filter("row_ordinal % 2 = 0"), path, reset=True)

    def missing() -> DataFrame:
        return predictions.pending(planned, predictions.recorded_keys(readers.read_predictions(spark, path)))

    todo = missing()
    folder = work_path(spark, "second-run")
    todo.write.parquet(folder)
    second = spark.read.schema(todo.schema).parquet(folder)
    writers.append_predictions(second, path)
    recorded = readers.read_predictions(spark, path).select("model", F.lit("recorded").alias("kind"))
    counted = recorded.union(second.select("model", F.lit("resumed"))).union(missing().select("model", F.lit("left")))
    return counted.groupBy("model").agg(
        F.count_if(F.col("kind") == "recorded").alias("recorded"),
        F.count_if(F.col("kind") == "resumed").alias("resumed"),
        F.count_if(F.col("kind") == "left").alias("left_over"),
    )


@query(
    """SELECT policy, dataset, round(avg(primary_metric), 4) AS value FROM fx_log WHERE status = 'success'
    AND policy = 'P3' GROUP BY ALL UNION ALL SELECT 'P1', dataset, 0.0 FROM fx_log WHERE status = 'success'
    AND policy = 'P1' GROUP BY ALL"""
)
def suite_beside_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite folder as the input of one policy, beside the flat log of another."""
    log = view(spark, sf_dir, "fx_log")
    suite = work_path(spark, "suite-input")
    rows = log.filter("policy = 'P1'").select(
        F.col("dataset").alias("dataset_name"), "model", F.col("query_id").alias("example_id"), "status", "latency_ms",
        F.struct("input_tokens", "output_tokens").alias("usage"), F.concat_ws("__", "dataset", "model").alias("pair"),
    )
    rows.write.partitionBy("pair").json(f"{suite}/predictions")
    flat = work_path(spark, "flat-input")
    raw_log(spark, sf_dir).filter("policy = 'P3'").write.json(flat)
    return comparison.accuracy_table(readers.read_policies(spark, [("p1", suite), ("p3", flat)]))


@query(
    """SELECT DISTINCT 'events' AS dataset_name, event_type AS model, CAST(user_id AS VARCHAR) AS example_id,
    strftime(ts, '%Y-%m-%d') AS day FROM events"""
)
def restarted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First predictions per key and day over two landings; the second run goes on from the state
    of the first, and what came out before does not come out again."""
    events = table(spark, sf_dir, "events")
    landing, place = work_path(spark, "landing"), work_path(spark, "restarted")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    for number, part in enumerate((early, ~early)):
        events.filter(part).write.parquet(f"{landing}/part={number}")
        stream = spark.readStream.schema(events.schema).parquet(f"{landing}/part=*")
        rows = _log_stream(stream)
        keys = (*predictions.PAIR_KEYS, "day")
        firsts = incremental.first_per_example(rows, keys, delay="2 days")
        done = incremental.drain(firsts.select(*keys), "restarted", place=place)
    return done


@query(
    """SELECT CAST(example_id AS VARCHAR) AS example_id, CASE dataset WHEN 'fever' THEN 'sixth' ELSE dataset END AS dataset_name,
    CASE WHEN prediction_status = 'success' THEN 'scored' ELSE 'prediction_error' END AS status,
    CASE dataset WHEN 'fever' THEN 'chars' WHEN 'hardmath' THEN 'math_exact_match' WHEN 'humaneval_plus' THEN 'pass_at_1'
      ELSE 'token_f1' END AS metric_name,
    CASE WHEN prediction_status = 'success' AND dataset = 'fever' THEN CAST(length(response_text) AS DOUBLE) END AS chars,
    CASE WHEN prediction_status = 'success' AND dataset = 'fever' THEN CAST(contains(response_text, gold_label) AS DOUBLE) END AS hit
    FROM fx_responses"""
)
def added_profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixth dataset whose profile the caller brings, scored beside the built-in ones."""
    sixth = scoring.Profile(
        "sixth",
        ("chars", "hit"),
        "chars",
        cases=lambda df: df,
        extract=lambda text: strip(text_or_empty(text)),
        metrics=lambda answer, reference: {
            "chars": F.length(answer),
            "hit": F.contains(answer, reference["label"]),
        },
    )
    matched = matched_responses(spark, sf_dir)
    renamed = F.when(F.col("dataset_name") == "fever", "sixth").otherwise(F.col("dataset_name"))
    scores = scoring.score_predictions(matched.withColumn("dataset_name", renamed), profiles=[sixth])
    values = [F.try_element_at("metrics", F.lit(m)).alias(m) for m in ("chars", "hit")]
    return scores.select("example_id", "dataset_name", "status", "metric_name", *values)


@query(
    """SELECT CAST(example_id AS VARCHAR) AS example_id, CASE WHEN prediction_status = 'success' THEN 'scored'
    ELSE 'prediction_error' END AS status, CASE WHEN prediction_status = 'success' THEN CAST(0 AS BIGINT) END AS n_metrics FROM fx_responses"""
)
def null_metric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite run without a metric."""
    scores = scoring.score_suite(matched_responses(spark, sf_dir), metric=scoring.null_metric)
    known = F.when(F.col("metrics").isNotNull(), F.size("metrics").cast("bigint"))
    return scores.select("example_id", "status", known.alias("n_metrics"))


@query(
    """SELECT dataset AS dataset_name, CAST(CASE dataset WHEN 'fever' THEN 1 WHEN 'hardmath' THEN 1 WHEN 'humaneval_plus' THEN 1
    ELSE 2 END AS BIGINT) AS n_metrics, count(*) AS cases FROM fx_responses GROUP BY dataset"""
)
def listed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered profiles as an in-memory source, with the cases that each of them has."""
    rows = [(name, len(scoring.get_profile(f" {name.upper()} ").metric_names)) for name in scoring.list_profiles()]
    known = readers.from_rows(spark, rows, "dataset_name string, n_metrics long")
    matched = matched_responses(spark, sf_dir).groupBy("dataset_name").agg(F.count("*").alias("cases"))
    return known.join(matched, "dataset_name")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS example_id, 'events' AS dataset_name, event_type || ' by ' || CAST(user_id AS VARCHAR) AS question
    FROM events"""
)
def row_mapped_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by a caller's row mapping, which is a function of DataFrames."""

    def as_cases(df: DataFrame) -> DataFrame:
        question = F.concat_ws(" by ", "event_type", F.col("user_id").cast("string"))
        return df.select(
            F.col("event_id").cast("string").alias("example_id"), F.lit("events").alias("dataset_name"), question.alias("question")
        )

    return table(spark, sf_dir, "events").transform(as_cases)
