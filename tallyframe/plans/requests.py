"""Queries that turn rows into cases, prompts and requests, and responses into predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.functions import prompts
from tallyframe.operators import cases, council, predictions
from tallyframe.plans import sql_text as q
from tallyframe.plans.fixtures import table, view
from tallyframe.plans.registry import query
from tallyframe.session import work_path
from tallyframe.sources.buckets import BucketedStore
from tallyframe.session import spread

MODELS = ("model-a", "model-b", "model-c")
BREAK = "chr(10)"
_LINES = "string_split(context, chr(10))"
_SUPPORT = f"""list_filter(list_transform(list_filter({_LINES}, lambda x, i: i % 3 = 2),
 lambda x: {q.strip('x')}), lambda x: x <> '')"""
_LEAD = f"list_filter(list_transform({_LINES}, lambda x: {q.strip('x')}), lambda x: x <> '')"
_ORACLE = f"""array_to_string(CASE WHEN len({_SUPPORT}) > 0 THEN {_SUPPORT} ELSE {_LEAD} END,
 chr(10) || chr(10))"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_raw")


def _paragraphs():
    return F.transform(
        F.split("context", "\n"),
        lambda text, i: F.struct(
            text.alias("paragraph_text"), (i % 3 == 1).alias("is_supporting")
        ),
    )


@query(
    f"""SELECT CAST(row_ordinal AS VARCHAR) AS example_id, 'musique' AS dataset_name,
    {q.filled(fv.MUSIQUE_PROMPT, context=_ORACLE, question='question')} AS question,
    answer || '|' || source AS answers, answerable FROM fx_raw"""
)
def multihop_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select(
        "row_ordinal",
        "question",
        _paragraphs().alias("paragraphs"),
        F.array("answer", "source").alias("answers"),
        "answerable",
    )
    built = cases.multihop_cases(raw)
    return built.select(
        "example_id",
        "dataset_name",
        "question",
        F.array_join("reference.answers", "|").alias("answers"),
        "answerable",
    )


@query(
    f"""SELECT CAST(original_id AS VARCHAR) AS example_id,
    question || {q.text(fv.QA_PROMPT.replace('{question}', ''))} AS question,
    CASE WHEN answerable THEN source ELSE context END AS context,
    answer || '|' || lang AS answers, lang AS options FROM fx_raw"""
)
def narrative_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = F.when(F.col("answerable"), F.col("source"))
    raw = _raw(spark, sf_dir).select(
        F.col("original_id").alias("id"),
        "question",
        F.struct(
            F.struct(summary.alias("text")).alias("summary"), F.col("context").alias("text")
        ).alias("document"),
        F.array(
            F.struct(F.col("answer").alias("text")), F.struct(F.col("lang").alias("text"))
        ).alias("answers"),
        F.col("lang").alias("options"),
    )
    built = cases.narrative_cases(raw)
    return built.select(
        "example_id",
        "question",
        "context",
        F.array_join("reference.answers", "|").alias("answers"),
        F.array_join("options", "|").alias("options"),
    )


@query(
    f"""SELECT CAST(original_id AS VARCHAR) AS example_id,
    {q.filled(fv.FEVER_PROMPT, question='question')} AS question,
    {q.strip("lang || ' 7 ' || context || ' ' || source")} AS context, label FROM fx_raw"""
)
def fact_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select(
        F.col("original_id").alias("id"),
        F.col("question").alias("claim"),
        F.array(F.array("lang", F.lit("7"), "context"), F.array("source")).alias("evidence"),
        "label",
    )
    built = cases.fact_cases(raw)
    return built.select(
        "example_id", "question", "context", F.col("reference.label").alias("label")
    )


@query(
    f"""SELECT CAST(original_id AS VARCHAR) AS example_id,
    question || {q.text(fv.MATH_PROMPT.replace('{question}', ''))} AS question,
    CASE WHEN answerable THEN lang ELSE source END AS answer FROM fx_raw"""
)
def math_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select(
        F.col("original_id").alias("id"),
        F.col("question").alias("problem"),
        F.when(F.col("answerable"), F.col("lang")).alias("answer"),
        F.col("source").alias("solution"),
    )
    built = cases.math_cases(raw)
    return built.select("example_id", "question", F.col("reference.answer").alias("answer"))


@query(
    """SELECT 'task/' || CAST(original_id AS VARCHAR) AS example_id, question,
    context AS test_code, lang AS entry_point FROM fx_raw"""
)
def code_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir).select(
        F.concat(F.lit("task/"), F.col("original_id").cast("string")).alias("task_id"),
        F.col("question").alias("prompt"),
        F.col("context").alias("test"),
        F.col("lang").alias("entry_point"),
    )
    built = cases.code_cases(raw)
    return built.select(
        "example_id", "question", "reference.test_code", "reference.entry_point"
    )


_TAG = """CASE WHEN level = 1 THEN 'retrieval' WHEN level = 2 THEN 'fact-verification'
 WHEN level = 3 THEN 'math' WHEN level = 4 THEN 'code' ELSE 'long-context' END"""
_SPECIALIST = f"""CASE WHEN name LIKE '%musique%'
 THEN {q.filled(fv.MUSIQUE_PROMPT, context='context', question='question')}
 WHEN name LIKE '%fever%' OR tag = 'fact-verification' THEN {q.filled(fv.FEVER_PROMPT, question='question')}
 WHEN name LIKE '%math%' OR tag = 'math' THEN {q.filled(fv.MATH_PROMPT, question='question')}
 WHEN name LIKE '%humaneval%' OR tag = 'code' THEN question
 ELSE {q.filled(fv.QA_PROMPT, question='question')} END"""


@query(
    f"""SELECT row_ordinal, {_SPECIALIST} AS prompt,
    CASE WHEN name NOT LIKE '%musique%' THEN context END AS context
    FROM (SELECT *, lower(CASE WHEN answerable THEN source_dataset ELSE 'other' END) AS name,
          {_TAG} AS tag FROM fx_raw)"""
)
def specialist_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    tags = F.array(
        F.element_at(
            F.array(
                *[
                    F.lit(t)
                    for t in ("retrieval", "fact-verification", "math", "code", "long-context")
                ]
            ),
            F.col("level").cast("int"),
        )
    )
    source = F.when(F.col("answerable"), F.col("source_dataset")).otherwise("other")
    made = raw.withColumn(
        "made", prompts.specialist_prompt(source, F.col("question"), F.col("context"), tags)
    )
    return made.select("row_ordinal", "made.prompt", "made.context")


def _wide_votes(column: str) -> str:
    return ", ".join(
        f"coalesce(max(CASE WHEN role = '{r}' THEN {column} END), '') AS {x.lower()}"
        for r, x in fv.ROLE_TO_LABEL.items()
    )


def council_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The votes view as one row per phase and role."""
    votes = view(spark, sf_dir, "fx_votes")
    phases = F.explode(
        F.array(
            F.struct(F.lit("answer").alias("phase"), F.col("answer_text").alias("text")),
            F.struct(F.lit("vote").alias("phase"), F.col("vote_text").alias("text")),
        )
    )
    calls = votes.withColumn("_call", phases)
    failed = (F.col("_call.phase") == "answer") & (F.col("_call.text") == "")
    none = F.lit(None).cast("string")
    rows = calls.select(
        F.col("example_id").cast("string").alias("example_id"),
        F.col("_call.phase").alias("phase"),
        "role",
        F.concat(F.lit("model-"), F.col("role")).alias("model"),
        F.when(failed, "error").otherwise("success").alias("status"),
        F.col("_call.text").alias("text"),
        "latency_ms",
        F.col("total_tokens").alias("input_tokens"),
        F.lit(1).cast("bigint").alias("output_tokens"),
        (F.col("total_tokens") + 1).alias("total_tokens"),
        none.alias("error_type"),
        none.alias("error_message"),
        "row_ordinal",
    )
    return spread(rows, "example_id")


_ANSWERS = " || chr(10) || chr(10) || ".join(
    f"'Answer {x}:' || chr(10) || {x.lower()}" for x in fv.LABELS
)


@query(
    f"""SELECT CAST(example_id AS VARCHAR) AS example_id,
    {q.filled(fv.VOTE_PROMPT, question="'q' || CAST(example_id AS VARCHAR)", answers=f'({_ANSWERS})')}
    AS vote_prompt
    FROM (SELECT example_id, {_wide_votes('answer_text')} FROM fx_votes GROUP BY 1)"""
)
def vote_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = council.labelled_answers(council.calls_by_role(council_calls(spark, sf_dir)))
    asked = wide.withColumn("question", F.concat(F.lit("q"), F.col("example_id")))
    return council.with_ballot(asked).select("example_id", "vote_prompt")


def _synthesis_sql(kind: str) -> str:
    block = "CASE WHEN context <> '' THEN 'Context:' || chr(10) || context || chr(10) || chr(10) ELSE '' END"
    return q.filled(
        fv.SYNTHESIS_PROMPTS[kind],
        question="question",
        context_block=block,
        winner="lang",
        others="('- ' || source || chr(10) || chr(10) || '- ' || label)",
    )


@query(
    f"""SELECT row_ordinal, CASE source_dataset WHEN 'MuSiQue' THEN {_synthesis_sql('musique')}
    WHEN 'FEVER' THEN {_synthesis_sql('fever')} WHEN 'HARDMATH' THEN {_synthesis_sql('math')}
    WHEN 'HumanEvalPlus' THEN {_synthesis_sql('code')} ELSE {_synthesis_sql('qa')} END AS prompt
    FROM (SELECT * REPLACE (CASE WHEN answerable THEN context ELSE '' END AS context) FROM fx_raw)"""
)
def synthesis_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    prompt = prompts.synthesis_prompt(
        F.col("source_dataset"),
        F.col("question"),
        F.when(F.col("answerable"), F.col("context")),
        F.col("lang"),
        F.array("source", "label"),
    )
    return raw.select("row_ordinal", prompt.alias("prompt"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with explicit messages, with prompt parts, or with nothing to ask."""
    raw = _raw(spark, sf_dir)
    explicit = F.col("level") == 1
    blank = F.col("level") == 2
    return raw.select(
        F.col("source_dataset").alias("dataset_name"),
        F.col("row_ordinal").cast("string").alias("example_id"),
        F.lit("model-a").alias("model"),
        F.when(
            explicit,
            F.array(
                prompts.message("system", F.col("lang")), prompts.message("user", F.col("question"))
            ),
        ).alias("messages"),
        F.when(F.col("answerable"), F.col("source")).alias("system_prompt"),
        F.when(blank, "").otherwise(F.col("question")).alias("question"),
        F.when(F.col("level") == 3, F.col("label")).alias("context"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("example_id"), F.lit("x")).alias(
            "metadata"
        ),
    )


@query(
    """SELECT CAST(row_ordinal AS VARCHAR) AS example_id,
    CASE WHEN level = 2 THEN 'error' ELSE 'ready' END AS request_status,
    CASE WHEN level = 2 THEN 'ValueError' END AS error_type,
    CASE WHEN level = 2 THEN 'benchmark example ' || CAST(row_ordinal AS VARCHAR)
      || ' must include messages or prompt content' END AS error_message,
    CASE WHEN level = 1 THEN 'system=' || lang || '&user=' || question
         ELSE concat_ws('&', CASE WHEN answerable THEN 'system=' || source END,
              CASE WHEN level = 3 THEN 'user=' || label || chr(10) || chr(10) || question
                   WHEN level = 2 THEN NULL ELSE 'user=' || question END) END AS chat,
    'dataset_name=' || source_dataset || ',example_id=' || CAST(row_ordinal AS VARCHAR)
      || ',lang=' || lang || ',prompt_version=v2' AS metadata
    FROM fx_raw"""
)
def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = cases.build_requests(_examples(spark, sf_dir), prompt_version="v2")
    chats = cases.with_resolved_messages(built)
    chat = F.array_join(
        F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "&"
    )
    pairs = F.array_sort(F.map_entries("metadata"))
    return chats.select(
        "example_id",
        "request_status",
        "error_type",
        "error_message",
        chat.alias("chat"),
        F.array_join(
            F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias("metadata"),
    )


@query(
    """SELECT CAST(row_ordinal AS VARCHAR) AS example_id,
    '{"max_tokens":64,"messages":[{"role":"user","content":' || CAST(to_json(question) AS VARCHAR)
    || '}],"model":"model-a","seed":7,"stop":["END"],"temperature":0.5,"top_p":0.9}' AS payload
    FROM fx_raw"""
)
def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    examples = raw.select(
        F.col("source_dataset").alias("dataset_name"),
        F.col("row_ordinal").cast("string").alias("example_id"),
        F.lit("model-a").alias("model"),
        "question",
        F.lit(None).cast("string").alias("context"),
    )
    built = cases.build_requests(
        examples,
        temperature=0.5,
        max_tokens=64,
        stop_sequences=["END"],
        provider_params={"top_p": "0.9"},
    )
    payloads = predictions.request_payload(
        cases.with_resolved_messages(built), {"seed": "7", "top_p": "0.1", "temperature": "1.0"}
    )
    return payloads.select("example_id", "payload")


@query(
    """SELECT row_ordinal, alias, role,
    CASE WHEN role IS NULL THEN 'KeyError' END AS error_type,
    CASE WHEN role IS NULL THEN 'Unknown orchestrator target: ' || target END AS error_message,
    CASE WHEN answerable THEN 'model-x' WHEN role IS NOT NULL THEN 'default-' || role END AS model,
    CAST(CASE role WHEN 'qa' THEN 0.1 WHEN 'reasoning' THEN 0.2 WHEN 'general' THEN 0.3 END AS DOUBLE)
      AS temperature,
    CASE WHEN role IS NULL THEN 'team=row' ELSE 'role=' || role || ',team=row' END AS metadata
    FROM (SELECT r.*, trim(lower(target)) AS alias, CASE trim(lower(target)) WHEN 'qa' THEN 'qa'
      WHEN 'math' THEN 'reasoning' WHEN 'code' THEN 'reasoning' WHEN 'fever' THEN 'general' END AS role
      FROM (SELECT *, CASE level WHEN 1 THEN ' QA ' WHEN 2 THEN 'math' WHEN 3 THEN 'code'
            WHEN 4 THEN 'Fever' ELSE 'oracle' END AS target FROM fx_raw) r)"""
)
def role_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    targets = F.array(*[F.lit(t) for t in (" QA ", "math", "code", "Fever", "oracle")])
    requests = raw.select(
        "row_ordinal",
        F.element_at(targets, F.col("level").cast("int")).alias("target"),
        F.when(F.col("answerable"), "model-x").alias("model"),
        F.lit(None).cast("double").alias("temperature"),
        F.lit(None).cast("int").alias("max_tokens"),
        F.lit(None).cast("string").alias("system_prompt"),
        F.col("question").alias("user_prompt"),
        F.lit(None).cast("string").alias("context"),
        F.array().cast("array<string>").alias("stop_sequences"),
        F.create_map(F.lit("team"), F.lit("row")).alias("metadata"),
        F.create_map().cast("map<string,string>").alias("provider_params"),
    )
    defaults = spark.createDataFrame(
        [
            (role, f"default-{role}", heat, 256, None, None, None, ["END"],
             {"role": role, "team": "default"}, {"top_p": "1.0"})
            for role, heat in (("qa", 0.1), ("reasoning", 0.2), ("general", 0.3))
        ],
        cases.schemas.ROLE_DEFAULTS,
    )
    resolved = cases.resolve_roles(requests, "target", cases.role_aliases(spark))
    merged = cases.apply_role_defaults(resolved, defaults)
    pairs = F.array_sort(F.map_entries("metadata"))
    return merged.select(
        "row_ordinal",
        F.lower(F.trim("target")).alias("alias"),
        "role",
        "error_type",
        "error_message",
        "model",
        "temperature",
        F.array_join(
            F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
        ).alias("metadata"),
    )


_FIRST_PARTS = f"""array_to_string(list_filter(list_transform(string_split(context, chr(10) || chr(10)),
 lambda x: {q.strip('x')}), lambda x: x <> ''), chr(10) || chr(10))"""


@query(
    f"""SELECT CAST(row_ordinal AS VARCHAR) AS example_id, dataset, context, entry_point, answerable
    FROM (SELECT row_ordinal, CASE source_dataset WHEN 'MuSiQue' THEN 'musique' WHEN 'QuALITY'
      THEN 'quality' WHEN 'FEVER' THEN 'fever' WHEN 'HARDMATH' THEN 'hardmath' ELSE 'humaneval_plus' END AS dataset,
      CASE WHEN source_dataset = 'MuSiQue' THEN {_FIRST_PARTS} ELSE context END AS context,
      CASE WHEN source_dataset = 'HumanEvalPlus' THEN lang END AS entry_point,
      CASE WHEN source_dataset = 'MuSiQue' THEN answerable END AS answerable FROM fx_raw)"""
)
def council_row_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    source = F.col("source_dataset")
    rows = raw.select(
        F.col("row_ordinal").cast("string").alias("id"),
        "source_dataset",
        "question",
        "context",
        F.array(F.lit("tag")).alias("skill_tags"),
        F.col("answer").alias("gold_answer"),
        F.col("label").alias("gold_label"),
        F.lit("").alias("unit_tests"),
        "original_id",
        F.to_json(
            F.struct(
                F.when(source == "MuSiQue", F.col("answerable")).alias("answerable"),
                F.when(source == "HumanEvalPlus", F.col("lang")).alias("entry_point"),
            )
        ).alias("metadata"),
    )
    built = cases.council_requests(rows)
    return built.select(
        "example_id",
        F.col("row_metadata.source_dataset").alias("dataset"),
        F.col("row_metadata.context").alias("context"),
        F.col("row_metadata.entry_point").alias("entry_point"),
        F.col("row_metadata.answerable").alias("answerable"),
    )


def _member(role: str) -> str:
    return f"max(CASE WHEN role = '{role}' THEN answer_text END)"


@query(
    f"""SELECT CAST(example_id AS VARCHAR) AS example_id, first_prompt,
    {q.filled(fv.FOUR_ANSWER_PROMPT, question='question', model1="coalesce(m1, '')",
              model2="coalesce(m2, '')", model3="coalesce(m3, '')", router_response="coalesce(m1, '')")}
    AS synth_prompt
    FROM (SELECT *, {q.filled(fv.SHORT_ANSWER_PROMPT, question='question', context="'about ' || question")}
          AS first_prompt
          FROM (SELECT example_id, 'q' || CAST(example_id AS VARCHAR) AS question,
                {_member('qa')} AS m1, {_member('reasoning')} AS m2, {_member('general')} AS m3
                FROM fx_votes GROUP BY example_id))"""
)
def four_answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = view(spark, sf_dir, "fx_votes").withColumn(
        "example_id", F.col("example_id").cast("string")
    )
    answers = votes.select("example_id", "role", F.col("answer_text").alias("text"), "row_ordinal")
    routed = answers.filter("role = 'qa'").withColumn("role", F.lit("router"))
    rows = votes.select("example_id").distinct().withColumn(
        "question", F.concat(F.lit("q"), F.col("example_id"))
    )
    wide = council.four_answer_rows(rows, answers.unionByName(routed))
    about = F.concat(F.lit("about "), F.col("question"))
    return wide.select(
        "example_id",
        prompts.short_answer_prompt(F.col("question"), about).alias("first_prompt"),
        "synth_prompt",
    )


_PLANNED = """planned AS (SELECT dataset AS dataset_name, m.model, query_id AS example_id
 FROM (SELECT DISTINCT dataset, query_id FROM fx_log) e
 CROSS JOIN (SELECT unnest(['model-a', 'model-b', 'model-c']) AS model) m),
done AS (SELECT DISTINCT dataset AS dataset_name, model, query_id AS example_id FROM fx_log
 WHERE completed_at < TIMESTAMP '2024-01-15 00:00:00'),
later AS (SELECT dataset AS dataset_name, model, query_id AS example_id, arg_max(status, row_ordinal) AS status
 FROM fx_log WHERE completed_at >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL)"""


def _log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    return log.withColumnsRenamed({"dataset": "dataset_name", "query_id": "example_id"})


def _planned(log: DataFrame) -> DataFrame:
    return predictions.fan_out(log.select("dataset_name", "example_id").distinct(), MODELS)


def _before(log: DataFrame) -> DataFrame:
    return log.filter("completed_at < TIMESTAMP_NTZ '2024-01-15 00:00:00'")


def _after(log: DataFrame) -> DataFrame:
    return log.filter("completed_at >= TIMESTAMP_NTZ '2024-01-15 00:00:00'")


@query(f"WITH {_PLANNED} SELECT * FROM planned")
def planned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(_log_keys(spark, sf_dir)).select("dataset_name", "model", "example_id")


@query(
    f"""WITH {_PLANNED} SELECT * FROM planned p WHERE NOT EXISTS (SELECT 1 FROM done d
    WHERE d.dataset_name = p.dataset_name AND d.model = p.model AND d.example_id = p.example_id)"""
)
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log_keys(spark, sf_dir)
    recorded = predictions.recorded_keys(_before(log))
    return predictions.pending(_planned(log), recorded).select(
        "dataset_name", "model", "example_id"
    )


@query(
    f"""WITH {_PLANNED}, marked AS (SELECT d.example_id IS NOT NULL AS skipped, l.status
      FROM planned p LEFT JOIN done d USING (dataset_name, model, example_id)
      LEFT JOIN later l USING (dataset_name, model, example_id))
    SELECT count(*) AS total_examples, CAST(count_if(skipped) AS BIGINT) AS skipped_existing,
    CAST(count_if(NOT skipped AND status IS NOT NULL) AS BIGINT) AS attempted_examples,
    CAST(count_if(NOT skipped AND status = 'success') AS BIGINT) AS completed_examples,
    CAST(count_if(NOT skipped AND status = 'error') AS BIGINT) AS failed_examples FROM marked"""
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log_keys(spark, sf_dir)
    keys = list(predictions.PAIR_KEYS)
    results = predictions.latest(
        _after(log).select(*keys, "status", "row_ordinal"), keys, "row_ordinal"
    )
    return predictions.run_counters(
        _planned(log), predictions.recorded_keys(_before(log)), results
    )


@query(
    """SELECT row_ordinal, query_id FROM fx_log WHERE query_id IN
    (SELECT query_id FROM fx_log WHERE completed_at < TIMESTAMP '2024-01-15 00:00:00')"""
)
def batch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    kept = predictions.restrict_to_batch(log, _before(log), ["query_id"])
    return kept.select("row_ordinal", "query_id")


@query(
    """SELECT e.event_id, c.o_orderkey IS NULL AS is_orphan, c.o_orderpriority AS reference
    FROM events e LEFT JOIN orders c ON c.o_orderkey = e.event_id * 2"""
)
def predictions_with_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") * 2).alias("example_id")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("example_id"),
        F.col("o_orderpriority").alias("reference"),
        F.col("o_orderdate").alias("row_ordinal"),
    )
    keys = ["example_id"]
    matched = predictions.match_cases(events, orders, keys, order="row_ordinal").withColumn("is_orphan", F.lit(False))
    lost = predictions.orphans(events, orders, keys).withColumns(
        {"reference": F.lit(None).cast("string"), "is_orphan": F.lit(True)}
    )
    return matched.unionByName(lost).select("event_id", "is_orphan", "reference")


def chat_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chat-completion texts, some without choices and some broken."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    role = F.when(k % 2 == 0, "assistant")
    good = F.to_json(
        F.struct(
            F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"),
            F.lit("model-a").alias("model"),
            F.array(
                F.struct(
                    F.struct(role.alias("role"), F.col("event_type").alias("content")).alias(
                        "message"
                    ),
                    F.lit("stop").alias("finish_reason"),
                )
            ).alias("choices"),
            F.struct(
                k.alias("prompt_tokens"),
                F.col("user_id").alias("completion_tokens"),
                (k + F.col("user_id")).alias("total_tokens"),
            ).alias("usage"),
        )
    )
    raw = (
        F.when(F.col("event_type") == "signup", '{"id":"x","choices":[]}')
        .when(F.col("event_type") == "error", "<html>busy</html>")
        .otherwise(good)
    )
    return events.select("event_id", raw.alias("raw_response"))


@query(
    """SELECT event_id, CASE WHEN ok THEN 'success' ELSE 'error' END AS status,
    CASE WHEN ok THEN event_type END AS text, CASE WHEN ok THEN 'assistant' END AS role,
    CASE WHEN ok THEN 'stop' END AS finish_reason, CASE WHEN ok THEN k END AS input_tokens,
    CASE WHEN ok THEN user_id END AS output_tokens, CASE WHEN ok THEN k + user_id END AS total_tokens,
    CASE WHEN NOT ok THEN 'LLMResponseError' END AS error_type,
    CASE event_type WHEN 'signup' THEN 'provider response did not include choices'
      WHEN 'error' THEN 'provider returned non-JSON response' END AS error_message
    FROM (SELECT *, event_type NOT IN ('signup', 'error') AS ok,
      CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events)"""
)
def parsed_chat_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = predictions.parse_chat_response(chat_responses(spark, sf_dir), "raw_response")
    return parsed.select(
        "event_id",
        F.col("response_status").alias("status"),
        F.col("response_text").alias("text"),
        F.col("response_role").alias("role"),
        "finish_reason",
        "usage.input_tokens",
        "usage.output_tokens",
        "usage.total_tokens",
        "error_type",
        "error_message",
    )


@query(
    """SELECT CAST(d.doc_id AS VARCHAR) AS example_id,
    CASE WHEN ok THEN 'success' ELSE 'error' END AS status, CASE WHEN ok THEN event_type END AS response_text,
    CASE WHEN ok THEN value END AS latency_ms,
    CASE WHEN event_type IS NULL THEN 'MissingResponse' WHEN NOT ok THEN 'LLMResponseError' END AS error_type
    FROM documents d LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type,
      arg_max(value, event_id) AS value,
      arg_max(event_type, event_id) NOT IN ('signup', 'error') AS ok FROM events GROUP BY user_id) e
    ON e.user_id = d.doc_id"""
)
def predictions_from_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    examples = raw.select(
        F.lit("mixed").alias("dataset_name"),
        F.col("row_ordinal").cast("string").alias("example_id"),
        F.lit("model-a").alias("model"),
        "question",
        F.lit(None).cast("string").alias("context"),
    )
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    parsed = predictions.parse_chat_response(chat_responses(spark, sf_dir), "raw_response")
    responses = parsed.join(events, "event_id").select(
        F.lit("mixed").alias("dataset_name"),
        F.lit("model-a").alias("model"),
        F.col("user_id").cast("string").alias("example_id"),
        "response_status",
        "response_text",
        F.col("value").alias("latency_ms"),
        "usage",
        "error_type",
        "error_message",
        F.col("event_id").alias("row_ordinal"),
    )
    made = predictions.predictions_from_responses(
        cases.build_requests(examples), responses, "run-1"
    )
    return made.select("example_id", "status", "response_text", "latency_ms", "error_type")


_CACHE_KEY = """sha256('{"dataset":"' || dataset || '","model":"' || model || '","query_id":"' || query_id || '"}')"""


@query(
    f"""WITH keyed AS (SELECT *, {_CACHE_KEY} AS cache_key FROM fx_log),
    cache AS (SELECT cache_key, arg_max(status, row_ordinal) AS cached_status FROM keyed
      WHERE completed_at < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1)
    SELECT row_ordinal, cache_key, cached_status, cached_status IS NULL AS is_miss
    FROM keyed LEFT JOIN cache USING (cache_key)"""
)
def request_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    keyed = log.withColumn("cache_key", predictions.request_key("model", "dataset", "query_id"))
    cache = _before(keyed).select(
        "cache_key", F.col("status").alias("cached_status"), "row_ordinal"
    )
    looked_up = predictions.cached_responses(keyed.select("row_ordinal", "cache_key"), cache)
    return looked_up.withColumn("is_miss", F.col("cached_status").isNull())


@query(
    f"""WITH keyed AS (SELECT *, {_CACHE_KEY} AS cache_key FROM fx_log)
    SELECT DISTINCT cache_key, dataset, query_id FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM keyed
      WHERE completed_at < TIMESTAMP '2024-01-15 00:00:00')"""
)
def request_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = view(spark, sf_dir, "fx_log")
    keyed = log.withColumn("cache_key", predictions.request_key("model", "dataset", "query_id"))
    missing = predictions.cache_misses(keyed, _before(keyed))
    return missing.select("cache_key", "dataset", "query_id")


_STORED = "dataset_name string, model string, example_id string, status string, row_ordinal bigint"


@query(
    f"""WITH {_PLANNED}, fate AS (SELECT dataset_name, model, example_id, bool_or(status = 'success') AS fine FROM
      (SELECT dataset AS dataset_name, model, query_id AS example_id, status FROM fx_log WHERE completed_at < TIMESTAMP '2024-01-22 00:00:00')
      GROUP BY ALL)
    SELECT p.*, f.fine IS NOT NULL AS is_retry FROM planned p LEFT JOIN fate f USING (dataset_name, model, example_id)
    WHERE NOT coalesce(f.fine, false)"""
)
def pending_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs to do against a log that two runs have stored in buckets: new ones and those that have only
    failed. The log is read in its buckets."""
    log = _log_keys(spark, sf_dir)
    store = BucketedStore(spark, work_path(spark, "run-store"), _STORED, buckets=8)
    store.add(_before(log))
    store.add(_after(log).filter("completed_at < TIMESTAMP_NTZ '2024-01-22 00:00:00'"))
    recorded = store.read()
    todo = predictions.pending(_planned(log), predictions.recorded_keys(recorded, retry_errors=True))
    tried = predictions.recorded_keys(recorded).withColumn("is_retry", F.lit(True))
    keys = list(predictions.PAIR_KEYS)
    return todo.join(tried, keys, "left").select(*keys, F.coalesce("is_retry", F.lit(False)).alias("is_retry"))


@query(
    f"""WITH keyed AS (SELECT *, {_CACHE_KEY} AS cache_key FROM fx_log),
    cache AS (SELECT cache_key, arg_max(status, row_ordinal) AS cached_status, max(row_ordinal) AS cached_at FROM keyed
      WHERE completed_at < TIMESTAMP '2024-01-22 00:00:00' GROUP BY 1)
    SELECT row_ordinal, cache_key, cached_status, cached_at FROM keyed LEFT JOIN cache USING (cache_key)
    WHERE completed_at >= TIMESTAMP '2024-01-15 00:00:00'"""
)
def cache_in_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of the later weeks against a response cache in buckets, which a second run has added to;
    the last response of a key counts."""
    log = view(spark, sf_dir, "fx_log")
    keyed = log.withColumn("cache_key", predictions.request_key("model", "dataset", "query_id"))
    answers = keyed.withColumns({"cached_status": F.col("status"), "cached_at": F.col("row_ordinal")})
    kind = "cache_key string, cached_status string, cached_at bigint, row_ordinal bigint"
    store = BucketedStore(spark, work_path(spark, "cache-store"), kind, ("cache_key",), buckets=8)
    store.add(_before(answers))
    store.add(_after(answers).filter("completed_at < TIMESTAMP_NTZ '2024-01-22 00:00:00'"))
    return predictions.cached_responses(_after(keyed).select("row_ordinal", "cache_key"), store.read())
