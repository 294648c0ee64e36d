"""Queries over answers: normalising, extracting, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import extract, json_fields, metrics, normalize
from tallyframe.functions import fixed_values as fv
from tallyframe.functions.text import let, strip
from tallyframe.operators import scoring
from tallyframe.plans import sql_text as q
from tallyframe.plans.fixtures import table, view
from tallyframe.plans.registry import query
from tallyframe.session import spread

OVERLAP = """
l AS (SELECT {keys}, w, count(*) AS n FROM (SELECT {keys}, unnest(lw) AS w FROM base) GROUP BY ALL),
r AS (SELECT {keys}, w, count(*) AS n FROM (SELECT {keys}, unnest(rw) AS w FROM base) GROUP BY ALL),
o AS (SELECT {keys}, sum(least(l.n, r.n)) AS shared FROM l JOIN r USING ({keys}, w) GROUP BY ALL)
"""


@query(
    f"""SELECT doc_id, {q.normalized('text')} AS normalized,
    CAST(len({q.words('text')}) AS BIGINT) AS n_tokens FROM documents"""
)
def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    staged = docs.withColumn("words", normalize.tokenize(F.col("text")))
    return staged.select(
        "doc_id",
        F.array_join("words", " ").alias("normalized"),
        F.size("words").cast("bigint").alias("n_tokens"),
    )


@query(
    f"""WITH base AS (SELECT conv_id, turn, {q.words('prediction')} AS lw,
    {q.words('reference')} AS rw FROM fx_qa), {OVERLAP.format(keys='conv_id, turn')}
    SELECT conv_id, turn, CAST(lw = rw AS DOUBLE) AS exact_match,
    {q.f1('coalesce(shared, 0)', 'len(lw)', 'len(rw)')} AS token_f1
    FROM base LEFT JOIN o USING (conv_id, turn)"""
)
def answer_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "fx_qa")
    return pairs.select(
        "conv_id",
        "turn",
        metrics.exact_match(F.col("prediction"), F.col("reference")).alias("exact_match"),
        F.round(metrics.token_f1(F.col("prediction"), F.col("reference")), 6).alias("token_f1"),
    )


@query(
    f"""WITH refs AS (SELECT conv_id, turn, 1 AS k, prediction, reference AS ref FROM fx_qa
    UNION ALL SELECT conv_id, turn, 2, prediction, text FROM fx_qa
    JOIN benchmark ON item_id = conv_id
    UNION ALL SELECT conv_id, turn, 3, prediction, 'The ' || prediction FROM fx_qa
    WHERE turn > 2),
    base AS (SELECT conv_id, turn, k, {q.words('prediction')} AS lw, {q.words('ref')} AS rw
    FROM refs), {OVERLAP.format(keys='conv_id, turn, k')},
    each AS (SELECT conv_id, turn, CAST(lw = rw AS DOUBLE) AS em,
    {q.f1('coalesce(shared, 0)', 'len(lw)', 'len(rw)')} AS f1
    FROM base LEFT JOIN o USING (conv_id, turn, k))
    SELECT conv_id, turn, max(em) AS exact_match, max(f1) AS token_f1 FROM each GROUP BY ALL"""
)
def best_reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = view(spark, sf_dir, "fx_qa")
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item_text")
    joined = pairs.join(items, pairs["conv_id"] == items["item_id"], "left")
    echo = F.when(F.col("turn") > 2, F.concat(F.lit("The "), F.col("prediction")))
    references = F.array_compact(F.array("reference", "item_text", echo))
    return joined.select(
        "conv_id",
        "turn",
        metrics.exact_match_multi(F.col("prediction"), references).alias("exact_match"),
        F.round(metrics.token_f1_multi(F.col("prediction"), references), 6).alias("token_f1"),
    )


@query(
    f"""WITH items AS (SELECT count(*) AS n FROM benchmark),
    base AS MATERIALIZED (SELECT d.doc_id, {q.words('d.text')} AS lw, {q.words('b.text')} AS rw
    FROM (SELECT doc_id, text, doc_id % n AS item FROM documents, items) d JOIN benchmark b ON b.item_id = d.item),
    {OVERLAP.format(keys='doc_id')}
    SELECT doc_id, CAST(len(lw) AS BIGINT) AS n_tokens,
    {q.f1('coalesce(shared, 0)', 'len(lw)', 'len(rw)')} AS token_f1
    FROM base LEFT JOIN o USING (doc_id)"""
)
def document_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item_text")
    size = items.agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    numbered_docs = docs.withColumn("one", F.lit(1)).join(size, "one")
    paired = numbered_docs.join(items, F.col("item_id") == F.col("doc_id") % F.col("n"))

    def numbered(name: str):
        return let(normalize.tokenize(F.col(name)), metrics.numbered_tokens)

    staged = paired.select(
        "doc_id", numbered("text").alias("left_words"), numbered("item_text").alias("right_words")
    )
    score = metrics.f1_of_numbered(F.col("left_words"), F.col("right_words"))
    return staged.select(
        "doc_id",
        F.size("left_words").cast("bigint").alias("n_tokens"),
        F.round(score, 6).alias("token_f1"),
    )


@query(
    f"""SELECT example_id, extracted, {q.label('extracted')} AS label,
    CAST(({q.label('extracted')}) = ({q.label('gold_label')}) AS DOUBLE) AS label_accuracy
    FROM fx_extracted WHERE dataset = 'fever'"""
)
def fact_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_responses").filter("dataset = 'fever'")
    staged = rows.withColumn("extracted", extract.fact_label(F.col("response_text")))
    return staged.select(
        "example_id",
        "extracted",
        normalize.normalize_label(F.col("extracted")).alias("label"),
        metrics.label_accuracy(F.col("extracted"), F.col("gold_label")).alias("label_accuracy"),
    )


@query(
    """SELECT example_id, extracted,
    CASE example_id % 4 WHEN 0 THEN round(CAST(user_id AS DOUBLE), 6) WHEN 3 THEN NULL
         ELSE CAST(user_id AS DOUBLE) END AS number,
    CAST(example_id % 4 NOT IN (0, 3) AND user_id = user_id % 50 AS DOUBLE) AS math_exact_match,
    CAST(CASE WHEN example_id % 4 = 3 THEN FALSE
         ELSE abs(user_id - user_id % 50) <= greatest(0.01 * greatest(user_id, user_id % 50), 0.000001)
         END AS DOUBLE) AS numeric_accuracy
    FROM fx_extracted WHERE dataset = 'hardmath'"""
)
def math_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_responses").filter("dataset = 'hardmath'")
    staged = rows.withColumn("extracted", extract.math_answer(F.col("response_text")))
    gold = F.regexp_replace("reference", "user ", "")
    return staged.select(
        "example_id",
        "extracted",
        metrics.parse_number(F.col("extracted")).alias("number"),
        metrics.math_exact_match(F.col("extracted"), gold).alias("math_exact_match"),
        metrics.numeric_accuracy(F.col("extracted"), gold).alias("numeric_accuracy"),
    )


@query(
    f"""SELECT example_id, extracted,
    {q.text(chr(10) + fv.TEST_PROGRAM_IMPORTS + chr(10) * 2)} || extracted || chr(10) || chr(10)
    || 'def check(f): pass' || chr(10) || chr(10) || 'if __name__ == "__main__":' || chr(10)
    || '    check(' || substr(extracted, 5, 1) || ')' || chr(10) AS program
    FROM fx_extracted WHERE dataset = 'humaneval_plus'"""
)
def code_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_responses").filter("dataset = 'humaneval_plus'")
    staged = rows.withColumn("extracted", extract.code_answer(F.col("response_text")))
    entry = F.substring("extracted", 5, 1)
    program = scoring.answer_program(F.col("extracted"), F.lit("def check(f): pass"), entry)
    return staged.select("example_id", "extracted", program.alias("program"))


@query("SELECT example_id, dataset, extracted FROM fx_extracted")
def extracted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(view(spark, sf_dir, "fx_responses"), "example_id")
    answer = extract.extract_answer(F.col("response_text"), F.col("dataset"))
    return rows.select("example_id", "dataset", answer.alias("extracted"))


@query(
    """SELECT example_id, extracted FROM fx_extracted WHERE dataset = 'musique'"""
)
def multihop_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_responses").filter("dataset = 'musique'")
    return rows.select(
        "example_id", extract.multihop_answer(F.col("response_text")).alias("extracted")
    )


@query(
    r"""SELECT conv_id, turn,
    CASE WHEN conv_id % 3 = 0 THEN chr(66)
         WHEN conv_id % 3 = 1 THEN upper(substr('abcd', CAST(turn % 4 + 1 AS INTEGER), 1))
         ELSE coalesce(nullif(upper(regexp_extract(text, '^\(?([A-Da-d])\)?[\s.,:]', 1)), ''),
              nullif(upper(regexp_extract(text, '(?i)(?:answer is|answer:)\s*\(?([A-D])', 1)), ''),
              nullif(regexp_extract(text, '\b([A-D])\b', 1), ''),
              upper(substr(text, 1, 1))) END AS letter
    FROM conversations"""
)
def choice_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    letter = F.substring(F.lit("abcd"), (F.col("turn") % 4 + 1).cast("int"), F.lit(1))
    response = (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("the answer is (b). "), F.col("text")))
        .when(F.col("conv_id") % 3 == 1, F.concat(F.lit("("), letter, F.lit(") "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return turns.select("conv_id", "turn", extract.choice_letter(response).alias("letter"))


@query(
    f"""SELECT doc_id, {q.strip('text')} AS final_text,
    {q.strip('text')} AS shown_text FROM documents"""
)
def reasoning_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = docs.withColumn(
        "response",
        F.concat(F.lit("<think>first</think><scratchpad>then</scratchpad>"), F.col("text")),
    )
    return marked.select(
        "doc_id",
        extract.strip_reasoning(F.col("response")).alias("final_text"),
        extract.clean_answer(F.col("response")).alias("shown_text"),
    )


@query(
    """SELECT doc_id,
    CASE doc_id % 4 WHEN 0 THEN source || '|' || lang WHEN 1 THEN source || '|' || lang
         WHEN 2 THEN lang ELSE '[]' END AS answers,
    CAST(CASE WHEN doc_id % 4 < 2 THEN 2 ELSE 1 END AS BIGINT) AS n_answers
    FROM documents"""
)
def gold_answer_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    printed = F.format_string(
        "[{'text': '%s', 'tokens': ['x', None]}, {'text': \"%s\", 'tokens': []}]", "source", "lang"
    )
    raw = (
        F.when(F.col("doc_id") % 4 == 0, printed)
        .when(F.col("doc_id") % 4 == 1, F.to_json(F.array("source", "lang")))
        .when(F.col("doc_id") % 4 == 2, F.col("lang"))
        .otherwise("[]")
    )
    answers = json_fields.gold_answers(raw, F.lit("quality"))
    return docs.withColumn("_answers", answers).select(
        "doc_id",
        F.array_join("_answers", "|").alias("answers"),
        F.size("_answers").cast("bigint").alias("n_answers"),
    )


@query(
    """SELECT event_id,
    CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 2 = 0 AS answerable,
    CASE WHEN CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 3 = 0 THEN event_type END
        AS entry_point
    FROM events"""
)
def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    entry = F.when(k % 3 == 0, F.col("event_type"))
    metadata = F.to_json(F.struct((k % 2 == 0).alias("answerable"), entry.alias("entry_point")))
    parsed = json_fields.parse_metadata(metadata)
    return events.select(
        "event_id",
        parsed["answerable"].alias("answerable"),
        parsed["entry_point"].alias("entry_point"),
    )


# Metric values that RESPONSES must get, by template.
SCORED = """
scored AS (SELECT *,
  CASE WHEN dataset = 'musique' AND NOT answerable THEN 'not present in context'
       ELSE reference END AS ref_normal,
  CASE WHEN extracted = 'NOT PRESENT IN CONTEXT' THEN 'not present in context'
       ELSE replace(extracted, 'The ', '') END AS pred_normal
  FROM fx_extracted),
metric AS (SELECT *,
  CASE WHEN dataset IN ('musique', 'quality') THEN CAST(pred_normal = ref_normal AS DOUBLE) END AS exact_match,
  CASE WHEN dataset IN ('musique', 'quality') THEN
       CAST(CASE WHEN pred_normal = ref_normal THEN 1.0
            WHEN pred_normal LIKE 'user%' AND ref_normal LIKE 'user%' THEN 0.5 ELSE 0.0 END AS DOUBLE) END AS token_f1,
  CASE WHEN dataset = 'musique' THEN
       CAST(answerable AND extracted = 'NOT PRESENT IN CONTEXT' AS DOUBLE) END AS false_negative,
  CASE WHEN dataset = 'fever' THEN CAST((LABEL) = (GOLD) AS DOUBLE) END AS label_accuracy,
  CASE WHEN dataset = 'hardmath' THEN
       CAST(extracted = CAST(user_id % 50 AS VARCHAR) AS DOUBLE) END AS math_exact_match,
  CASE WHEN dataset = 'humaneval_plus' THEN CAST(exit_code = 0 AS DOUBLE) END AS pass_at_1
  FROM scored)
""".replace("LABEL", q.label("extracted")).replace("GOLD", q.label("gold_label"))
METRIC_COLUMNS = (
    "exact_match",
    "token_f1",
    "false_negative",
    "label_accuracy",
    "math_exact_match",
    "pass_at_1",
)
_IF_OK = ", ".join(
    f"CASE WHEN prediction_status = 'success' THEN {m} END AS {m}" for m in METRIC_COLUMNS
)


def matched_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with their case, as the scoring operators take them."""
    rows = spread(view(spark, sf_dir, "fx_responses"), "example_id")
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("dataset").alias("dataset_name"),
        "model",
        F.col("example_id").cast("string").alias("example_id"),
        F.col("prediction_status").alias("status"),
        "response_text",
        F.struct(
            F.array("reference").alias("answers"),
            F.col("gold_label").alias("label"),
            F.regexp_replace("reference", "user ", "").alias("answer"),
            none.alias("test_code"),
            none.alias("entry_point"),
        ).alias("reference"),
        "answerable",
        "exit_code",
        F.col("example_id").alias("row_ordinal"),
    )


def _metric_columns(scores: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return scores.select(
        "example_id",
        "dataset_name",
        "status",
        "extracted_answer",
        *[F.try_element_at("metrics", F.lit(name)).alias(name) for name in names],
    )


@query(
    f"""WITH {SCORED} SELECT CAST(example_id AS VARCHAR) AS example_id, dataset AS dataset_name,
    CASE WHEN prediction_status = 'success' THEN 'scored' ELSE 'prediction_error' END AS status,
    CASE WHEN prediction_status = 'success' THEN extracted END AS extracted_answer, {_IF_OK}
    FROM metric"""
)
def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scoring.score_predictions(matched_responses(spark, sf_dir))
    return _metric_columns(scores, METRIC_COLUMNS)


@query(
    f"""SELECT CAST(example_id AS VARCHAR) AS example_id, dataset AS dataset_name,
    CASE WHEN prediction_status = 'success' THEN 'scored' ELSE 'prediction_error' END AS status,
    CASE WHEN prediction_status <> 'success' THEN NULL
         WHEN dataset = 'musique' THEN extracted
         WHEN dataset = 'quality' THEN CASE example_id % 2 WHEN 0 THEN 'T' ELSE 'L' END
         WHEN dataset = 'humaneval_plus' THEN extracted
         WHEN dataset = 'fever' THEN CASE example_id % 5 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED'
              WHEN 2 THEN 'NOT' WHEN 3 THEN 'NEI' ELSE 'SUPPORTED' END
         ELSE CASE example_id % 4 WHEN 0 THEN '1' WHEN 3 THEN '' ELSE CAST(user_id AS VARCHAR) END
         END AS extracted_answer,
    CASE WHEN prediction_status <> 'success' OR dataset <> 'fever' THEN NULL
         ELSE CAST(CASE example_id % 5 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED'
              WHEN 2 THEN 'NOT' WHEN 3 THEN 'NEI' ELSE 'SUPPORTED' END
              = CASE example_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'REFUTED'
              ELSE 'NOT ENOUGH INFO' END AS DOUBLE) END AS label_accuracy,
    CASE WHEN prediction_status <> 'success' OR dataset <> 'hardmath' THEN NULL
         WHEN example_id % 4 = 3 THEN 0.0
         ELSE CAST(abs(x - user_id % 50) <= greatest(0.01 * greatest(x, user_id % 50), 0.000001)
              AS DOUBLE) END AS numeric_accuracy
    FROM (SELECT *, CASE WHEN example_id % 4 = 0 THEN 1 ELSE user_id END AS x FROM fx_extracted)"""
)
def documented_variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scoring.score_predictions(matched_responses(spark, sf_dir), ruleset="doc")
    return _metric_columns(scores, ("label_accuracy", "numeric_accuracy"))


@query(
    f"""WITH {SCORED} SELECT CAST(example_id AS VARCHAR) AS example_id,
    CASE dataset WHEN 'musique' THEN 'musique_token_f1' WHEN 'quality' THEN 'token_f1'
         WHEN 'fever' THEN 'label_accuracy' WHEN 'hardmath' THEN 'math_exact_match'
         ELSE 'pass_at_1' END AS metric_name,
    coalesce(token_f1, label_accuracy, math_exact_match, pass_at_1) AS primary_value,
    extracted AS extracted_answer FROM metric"""
)
def council_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(view(spark, sf_dir, "fx_responses"), "example_id")
    math_gold = F.regexp_replace("reference", "user ", "")
    gold = F.when(F.col("dataset") == "hardmath", math_gold).otherwise(F.col("reference"))
    staged = rows.select(
        F.col("example_id").cast("string").alias("example_id"),
        F.concat(F.lit("<think>hm</think>"), F.col("response_text")).alias("synthesized_text"),
        "exit_code",
        F.struct(
            F.col("dataset").alias("source_dataset"),
            gold.alias("gold_answer"),
            F.col("gold_label").alias("gold_label"),
            F.col("answerable").alias("answerable"),
        ).alias("row_metadata"),
    )
    scored = scoring.score_council_texts(staged)
    return scored.select(
        "example_id",
        "metric_name",
        F.try_element_at("metrics", F.col("primary_metric")).alias("primary_value"),
        "extracted_answer",
    )


@query(
    """SELECT user_id AS example_id, count(*) AS n_samples,
    CAST(sum(CASE WHEN exit_code = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_passed,
    round(CASE WHEN count(*) - sum(CASE WHEN exit_code = 0 THEN 1 ELSE 0 END) < 3 THEN 1.0
      ELSE 1.0 - (c / n) * ((c - 1) / (n - 1)) * ((c - 2) / (n - 2)) END, 6) AS pass_at_k
    FROM (SELECT *, CAST(count(*) OVER w AS DOUBLE) AS n,
          CAST(sum(CASE WHEN exit_code = 0 THEN 0 ELSE 1 END) OVER w AS DOUBLE) AS c
          FROM fx_responses WINDOW w AS (PARTITION BY user_id)) GROUP BY user_id, n, c"""
)
def pass_at_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = view(spark, sf_dir, "fx_responses").withColumnsRenamed(
        {"example_id": "sample_id", "user_id": "example_id"}
    )
    result = scoring.pass_at_k_by_example(outcomes, 3)
    return result.withColumn("pass_at_k", F.round("pass_at_k", 6))


@query(
    """SELECT e.event_id, CAST(coalesce(o.exit_code = 0, FALSE) AS DOUBLE) AS pass_at_1
    FROM events e LEFT JOIN (SELECT 2 * example_id AS example_id, exit_code FROM fx_responses) o
    ON o.example_id = e.event_id"""
)
def tested_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_responses")
    # Every second answer was tested.
    outcomes = rows.select(
        (2 * F.col("example_id")).alias("example_id"), "exit_code", F.col("example_id").alias("row_ordinal")
    )
    answers = rows.select("example_id", "response_text")
    tested = scoring.with_test_outcomes(answers, outcomes, keys=("example_id",))
    return tested.select(
        F.col("example_id").alias("event_id"),
        scoring.passed(strip(F.col("response_text")), F.col("exit_code")).alias("pass_at_1"),
    )
