"""Queries over council answers, ballots, synthesis and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.operators import council, scoring, summaries
from tallyframe.operators.records import add_known
from tallyframe.plans.fixtures import table, view
from tallyframe.plans.registry import query
from tallyframe.plans.requests import council_calls
from tallyframe.session import saved_table, spread

_VOTE = """CASE vote_text WHEN 'The answer is B.' THEN 'B' WHEN 'I choose B because...' THEN 'B'
 WHEN '  c  ' THEN 'C' ELSE 'A' END"""


def _of(role: str, column: str) -> str:
    return f"max(CASE WHEN role = '{role}' THEN {column} END)"


# Decision per example of the votes view.
DECIDED = f"""tallied AS (SELECT CAST(example_id AS VARCHAR) AS example_id,
  coalesce({_of('qa', 'answer_text')}, '') AS answer_a,
  coalesce({_of('reasoning', 'answer_text')}, '') AS answer_b,
  coalesce({_of('general', 'answer_text')}, '') AS answer_c,
  coalesce({_of('qa', _VOTE)}, 'A') AS vote_qa, coalesce({_of('reasoning', _VOTE)}, 'A') AS vote_reasoning,
  coalesce({_of('general', _VOTE)}, 'A') AS vote_general,
  {_of('qa', 'role')} AS has_a, {_of('reasoning', 'role')} AS has_b, {_of('general', 'role')} AS has_c,
  CAST(sum(total_tokens) AS BIGINT) AS tokens_in, count(*) AS calls, sum(latency_ms) AS latency
  FROM VOTES GROUP BY 1),
counted AS (SELECT *, list_aggregate([vote_qa, vote_reasoning, vote_general], 'histogram') AS h FROM tallied),
decided AS (SELECT *, CASE WHEN na >= nb AND na >= nc THEN 'A' WHEN nb >= nc THEN 'B' ELSE 'C' END AS winning_label
  FROM (SELECT *, coalesce(h['A'], 0) AS na, coalesce(h['B'], 0) AS nb, coalesce(h['C'], 0) AS nc FROM counted))"""
_DECIDED = DECIDED.replace("VOTES", "fx_votes")


@query("SELECT row_ordinal, " + _VOTE + " AS vote FROM fx_votes")
def parsed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = view(spark, sf_dir, "fx_votes")
    return votes.select("row_ordinal", council.parse_vote(F.col("vote_text")).alias("vote"))


@query(
    f"""WITH {_DECIDED} SELECT example_id, answer_a, answer_b, answer_c, vote_qa, vote_reasoning,
    vote_general, winning_label,
    CASE winning_label WHEN 'A' THEN 'qa' WHEN 'B' THEN 'reasoning' ELSE 'general' END AS winning_role,
    CASE winning_label WHEN 'A' THEN 'model-' || has_a WHEN 'B' THEN 'model-' || has_b
      ELSE 'model-' || has_c END AS winning_model,
    CASE winning_label WHEN 'A' THEN answer_a WHEN 'B' THEN answer_b ELSE answer_c END AS winning_answer,
    tokens_in AS answer_input_tokens, tokens_in + calls AS vote_total_tokens,
    2 * tokens_in AS input_tokens, 2 * calls AS output_tokens, 2 * tokens_in + 2 * calls AS total_tokens,
    round(latency, 4) AS answer_latency_ms, round(2 * latency, 4) AS specialist_latency_ms
    FROM decided"""
)
def council_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = council.decide(council_calls(spark, sf_dir))
    return decided.select(
        "example_id",
        "answer_a",
        "answer_b",
        "answer_c",
        *[F.element_at("votes", F.lit(role)).alias(f"vote_{role}") for role in fv.ROLES],
        "winning_label",
        "winning_role",
        "winning_model",
        "winning_answer",
        F.col("answer_usage.input_tokens").alias("answer_input_tokens"),
        F.col("vote_usage.total_tokens").alias("vote_total_tokens"),
        "specialist_usage.input_tokens",
        "specialist_usage.output_tokens",
        "specialist_usage.total_tokens",
        F.round("answer_latency_ms_total", 4).alias("answer_latency_ms"),
        F.round("specialist_latency_ms_total", 4).alias("specialist_latency_ms"),
    )


@query(
    f"""WITH {_DECIDED} SELECT example_id, 'router_dataset' AS dataset_name, 'p2_council' AS model,
    'success' AS status, 'v1' AS prompt_version,
    CASE winning_label WHEN 'A' THEN answer_a WHEN 'B' THEN answer_b ELSE answer_c END AS response_text,
    winning_label FROM decided"""
)
def council_batch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = council.decide(council_calls(spark, sf_dir), cleaned=False)
    results = council.batch_results(decided, "router_dataset")
    made = council.results_as_predictions(results, "run-1")
    return made.select(
        "example_id",
        "dataset_name",
        "model",
        "status",
        "prompt_version",
        "response_text",
        "response_metadata.winning_label",
    )


@query(
    f"""WITH {_DECIDED} SELECT example_id, array_to_string(list_filter([
      CASE WHEN winning_label <> 'A' THEN nullif(answer_a, '') END,
      CASE WHEN winning_label <> 'B' THEN nullif(answer_b, '') END,
      CASE WHEN winning_label <> 'C' THEN nullif(answer_c, '') END], lambda x: x IS NOT NULL), '|') AS others
    FROM decided"""
)
def losing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = council.decide(council_calls(spark, sf_dir))
    return decided.select(
        "example_id", F.array_join(council.other_answers(decided), "|").alias("others")
    )


@query(
    f"""WITH {_DECIDED} SELECT example_id, winning_label, tokens_in * 2 + calls * 2 AS total_tokens,
    has_b IS NOT NULL AS has_reasoning, CASE WHEN has_b IS NOT NULL AND answer_b = '' THEN 'error'
      WHEN has_b IS NOT NULL THEN 'success' END AS reasoning_status FROM decided"""
)
def serialized_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = council.serialized_decisions(council.decide(council_calls(spark, sf_dir)))
    text = rows.select("example_id", F.to_json(F.struct(*rows.columns)).alias("line"))

    def field(path: str):
        return F.get_json_object("line", path)

    status = field("$.role_results.reasoning.status")
    return text.select(
        "example_id",
        field("$.winning_label").alias("winning_label"),
        field("$.aggregated_usage.total_tokens").cast("bigint").alias("total_tokens"),
        status.isNotNull().alias("has_reasoning"),
        status.alias("reasoning_status"),
    )


@query(
    """SELECT count(*) AS examples_completed, round(avg(latency / 1000), 6) AS avg_latency_s,
    CAST(sum(tokens_in) AS BIGINT) AS total_input_tokens, CAST(sum(calls) AS BIGINT) AS total_output_tokens,
    CAST(sum(tokens_in) + sum(calls) AS BIGINT) AS total_tokens
    FROM (SELECT example_id, 2 * sum(latency_ms) AS latency, 2 * sum(total_tokens) AS tokens_in,
          2 * count(*) AS calls FROM fx_votes GROUP BY 1)"""
)
def council_client_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = council.decide(council_calls(spark, sf_dir))
    stats = council.client_stats(decided, "specialist_latency_ms_total")
    return stats.withColumn("avg_latency_s", F.round("avg_latency_s", 6))


@query(
    """SELECT row_ordinal, input_tokens + coalesce(output_tokens, 0) AS added,
    CASE WHEN output_tokens IS NULL AND latency_ms IS NULL THEN NULL
      ELSE coalesce(output_tokens, 0) + coalesce(CAST(floor(latency_ms) AS BIGINT), 0) END AS maybe
    FROM fx_log"""
)
def null_aware_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    whole = F.floor("latency_ms").cast("bigint")
    return log.select(
        "row_ordinal",
        add_known(F.col("input_tokens"), F.col("output_tokens")).alias("added"),
        add_known(F.col("output_tokens"), whole).alias("maybe"),
    )


@query(
    """SELECT user_id AS example_id, arg_max(event_type, struct_pack(n := n, f := -first)) AS council_answer,
    max(n) AS council_votes FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first
      FROM events GROUP BY ALL) GROUP BY 1"""
)
def majority_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("example_id"),
        F.col("event_type").alias("extracted_answer"),
        F.col("event_id").alias("position"),
    )
    return council.majority_of_answers(events)


@query(
    """SELECT user_id AS example_id,
    arg_min(extracted, struct_pack(failed := exit_code <> 0, at := example_id)) AS council_answer,
    bool_or(exit_code = 0) AS any_passed FROM fx_extracted WHERE dataset = 'humaneval_plus' GROUP BY 1"""
)
def best_of_n_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyframe.functions.extract import code_answer

    rows = view(spark, sf_dir, "fx_responses").filter("dataset = 'humaneval_plus'")
    members = rows.select(
        F.col("user_id").alias("example_id"),
        code_answer(F.col("response_text")).alias("code"),
        "exit_code",
        F.col("example_id").alias("position"),
    )
    return council.best_of_n_code(members)


# Council rows with all four outcomes. Requests, calls and synthesiser responses are numbered at
# different rates, so that the last requests have no calls and the last called ones no response.
_FLOW_SQL = f"""{_DECIDED},
asked AS (SELECT DISTINCT CAST(floor(event_id / 2) AS BIGINT) AS id FROM events),
wrote AS (SELECT CAST(floor(event_id / 4) AS BIGINT) AS id, arg_max(event_type, event_id) AS kind,
  arg_max(value, event_id) AS synth_latency, arg_max(user_id % 3, event_id) AS pick,
  arg_max(user_id, event_id) AS who, arg_max(CAST(floor(value) AS BIGINT) % 2, event_id) AS exit_code
  FROM events GROUP BY 1),
flow AS (SELECT CAST(id AS VARCHAR) AS example_id,
  CASE id % 5 WHEN 0 THEN 'musique' WHEN 1 THEN 'quality' WHEN 2 THEN 'fever' WHEN 3 THEN 'hardmath'
    ELSE 'humaneval_plus' END AS source_dataset,
  CASE WHEN d.example_id IS NULL THEN 'specialist_failed' WHEN w.kind IS NULL THEN 'missing_synth_record'
    WHEN w.kind <> 'error' THEN 'completed' ELSE 'synthesizer_failed' END AS phase_status,
  CASE pick WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' ELSE 'user ' || CAST(who AS VARCHAR) END AS said,
  d.latency * 2 AS latency_ms, d.tokens_in * 2 AS input_tokens, d.calls * 2 AS output_tokens, exit_code,
  synth_latency
  FROM asked LEFT JOIN decided d ON d.example_id = CAST(id AS VARCHAR) LEFT JOIN wrote w USING (id)),
judged AS (SELECT *, CASE WHEN phase_status <> 'completed' THEN NULL
  WHEN source_dataset IN ('musique', 'quality') THEN
    CASE WHEN said = 'user 7' THEN 1.0 WHEN said LIKE 'user%' THEN 0.5 ELSE 0.0 END
  WHEN source_dataset = 'fever' THEN CAST(said = 'SUPPORTS' AS DOUBLE)
  WHEN source_dataset = 'hardmath' THEN CAST(said = 'user 7' AS DOUBLE)
  ELSE CAST(exit_code = 0 AS DOUBLE) END AS primary_value FROM flow)"""


def council_flow(
    spark: SparkSession, sf_dir: str, repeated: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Specialist records, synthesis records and score records of one council run.

    With ``repeated`` two council rows share each id.
    """
    events = table(spark, sf_dir, "events")
    asked = F.floor(F.col("event_id") / 2).cast("bigint")
    answered = F.floor(F.col("event_id") / 4).cast("bigint")
    names = F.array(*[F.lit(n) for n in ("MuSiQue", "QuALITY", "FEVER", "HARDMATH", "Human")])
    rows = events.select(asked.alias("id"))
    requests = (rows if repeated else rows.distinct()).select(
        F.col("id").cast("string").alias("example_id"),
        F.lit("some context").alias("context"),
        F.struct(
            F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("source_dataset"),
            F.lit("user 7").alias("gold_answer"),
            F.lit("SUPPORTS").alias("gold_label"),
            F.lit(True).alias("answerable"),
            F.concat(F.lit("q"), F.col("id").cast("string")).alias("question"),
        ).alias("row_metadata"),
    )
    calls = council_calls(spark, sf_dir)
    # The phases are tables of their own, as they would be with inference in between.
    specialist = saved_table(
        council.specialist_records(requests, council.decide(calls)), "specialist"
    )
    said = (
        F.when(F.col("user_id") % 3 == 0, "SUPPORTS")
        .when(F.col("user_id") % 3 == 1, "REFUTES")
        .otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string")))
    )
    none = F.lit(None)
    responses = events.select(
        answered.cast("string").alias("example_id"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
        F.concat(F.lit("<think>so</think>\nFinal Answer: "), said).alias("text"),
        F.lit("synth").alias("model"),
        F.col("value").alias("latency_ms"),
        F.lit(900).cast("bigint").alias("input_tokens"),
        F.lit(90).cast("bigint").alias("output_tokens"),
        F.lit(990).cast("bigint").alias("total_tokens"),
        F.when(F.col("event_type") == "error", "LLMTransportError").alias("error_type"),
        none.cast("string").alias("error_message"),
        F.col("event_id").alias("row_ordinal"),
        (F.floor("value") % 2).cast("bigint").alias("exit_code"),
    )
    synth = saved_table(council.synthesis_records(specialist, responses), "synthesized")
    tests = responses.select("example_id", "exit_code", "row_ordinal")
    tested = scoring.with_test_outcomes(spread(synth, "example_id"), tests, keys=("example_id",))
    return specialist, synth, council.council_scores(scoring.score_council_texts(tested), specialist)


@query(
    f"""WITH {_FLOW_SQL} SELECT example_id, source_dataset, phase_status,
    CASE WHEN phase_status = 'completed' THEN 'success' ELSE 'error' END AS status,
    CASE WHEN phase_status = 'completed' THEN '<think>so</think>' || chr(10) || 'Final Answer: ' || said
      END AS response_text,
    round(latency_ms, 4) AS latency_ms, input_tokens + output_tokens AS total_tokens, primary_value,
    CASE phase_status WHEN 'specialist_failed' THEN 'MissingDecision' WHEN 'missing_synth_record' THEN
      'MissingSynthRecord' WHEN 'synthesizer_failed' THEN 'LLMTransportError' END AS error_type,
    CASE WHEN phase_status = 'completed' THEN synth_latency END AS synth_latency_ms
    FROM judged"""
)
def council_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = council.council_predictions(*council_flow(spark, sf_dir))
    return made.select(
        "example_id",
        "source_dataset",
        "phase_status",
        "status",
        "response_text",
        F.round("latency_ms", 4).alias("latency_ms"),
        "usage.total_tokens",
        "primary_value",
        "error_type",
        F.col("system_metrics.synthesizer_latency_ms").alias("synth_latency_ms"),
    )


@query(
    f"""WITH {_FLOW_SQL} SELECT example_id, source_dataset,
    CASE WHEN phase_status = 'completed' THEN 'scored' ELSE 'error' END AS status,
    CASE source_dataset WHEN 'musique' THEN 'musique_token_f1' WHEN 'quality' THEN 'token_f1' WHEN 'fever'
      THEN 'label_accuracy' WHEN 'hardmath' THEN 'math_exact_match' ELSE 'pass_at_1' END AS metric_name,
    primary_value FROM judged WHERE phase_status <> 'missing_synth_record'"""
)
def council_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, scores = council_flow(spark, sf_dir)
    return scores.select("example_id", "source_dataset", "status", "metric_name", "primary_value")


_PER_DATASET = f"""{_FLOW_SQL},
quality AS (SELECT source_dataset, count(*) AS total_examples, count(primary_value) AS scored_examples,
  count(*) - count(primary_value) AS failed_examples, sum(primary_value) AS psum
  FROM judged WHERE phase_status <> 'missing_synth_record' GROUP BY GROUPING SETS ((source_dataset), ())),
cost AS (SELECT source_dataset, count(*) AS n, sum(latency_ms) AS lat, CAST(sum(input_tokens) AS BIGINT) AS tin,
  CAST(sum(output_tokens) AS BIGINT) AS tout FROM judged WHERE phase_status = 'completed'
  GROUP BY GROUPING SETS ((source_dataset), ()))"""


@query(
    f"""WITH {_PER_DATASET}, means AS (SELECT avg(psum / scored_examples) AS combined FROM quality
      WHERE source_dataset IS NOT NULL AND scored_examples > 0)
    SELECT coalesce(q.source_dataset, 'router_dataset') AS dataset_name, total_examples, scored_examples,
    failed_examples, round(CASE WHEN q.source_dataset IS NULL THEN (SELECT combined FROM means)
      ELSE coalesce(psum / nullif(scored_examples, 0), 0) END, 6) AS primary_metric_value,
    round(lat / n / 1000, 9) AS avg_latency_s, tin AS total_input_tokens, tout AS total_output_tokens,
    tin + tout AS total_tokens, round((tin + tout) / n, 6) AS avg_total_tokens
    FROM quality q LEFT JOIN cost c ON c.source_dataset IS NOT DISTINCT FROM q.source_dataset"""
)
def council_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    specialist, synth, scores = council_flow(spark, sf_dir)
    rows = summaries.council_summaries(summaries.council_state(scores, council.completed_rows(specialist, synth)))
    return rows.select(
        "dataset_name",
        "total_examples",
        "scored_examples",
        "failed_examples",
        F.round("primary_metric_value", 6).alias("primary_metric_value"),
        F.round("avg_latency_s", 9).alias("avg_latency_s"),
        "total_input_tokens",
        "total_output_tokens",
        "total_tokens",
        F.round("avg_total_tokens", 6).alias("avg_total_tokens"),
    )


@query(
    f"""WITH {_PER_DATASET}, named AS (SELECT unnest(['musique', 'quality', 'fever', 'hardmath', 'humaneval_plus'])
      AS source_dataset)
    SELECT source_dataset, round(coalesce(psum / nullif(scored_examples, 0), 0), 6) AS score,
    coalesce(scored_examples, 0) > 0 AS has_scores,
    round((SELECT avg(psum / scored_examples) FROM quality WHERE source_dataset IS NOT NULL
      AND scored_examples > 0), 6) AS combined_metric
    FROM named LEFT JOIN quality USING (source_dataset)"""
)
def council_dataset_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    specialist, synth, scores = council_flow(spark, sf_dir)
    per_dataset = summaries.dataset_scores(summaries.council_state(scores, council.completed_rows(specialist, synth)))
    mean = summaries.macro_mean(per_dataset).withColumn("_one", F.lit(1))
    joined = per_dataset.withColumn("_one", F.lit(1)).join(mean, "_one")
    return joined.select(
        "source_dataset",
        F.round("score", 6).alias("score"),
        "has_scores",
        F.round("combined_metric", 6).alias("combined_metric"),
    )


@query(
    """SELECT CAST(example_id AS VARCHAR) AS example_id, role AS member,
    CAST(lower(answer_text) = 'answer click' AS DOUBLE) AS exact_match,
    CAST(CASE WHEN answer_text = 'answer click' THEN 1.0 WHEN answer_text = '' THEN 0.0 ELSE 0.5 END AS DOUBLE)
    AS token_f1
    FROM fx_votes"""
)
def member_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = view(spark, sf_dir, "fx_votes")
    members = votes.select(
        F.lit("quality").alias("dataset_name"),
        F.col("role").alias("model"),
        F.col("example_id").cast("string").alias("example_id"),
        F.lit("success").alias("status"),
        F.col("answer_text").alias("response_text"),
        F.struct(
            F.array(F.lit("answer click")).alias("answers"),
            F.lit("").alias("label"),
            F.lit("").alias("answer"),
        ).alias("reference"),
        F.lit(True).alias("answerable"),
    )
    scores = scoring.score_predictions(members)
    return scores.select(
        "example_id",
        F.col("model").alias("member"),
        F.element_at("metrics", F.lit("exact_match")).alias("exact_match"),
        F.element_at("metrics", F.lit("token_f1")).alias("token_f1"),
    )
