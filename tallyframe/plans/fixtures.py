"""Input views over the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# One row per policy, model and query: the flat evaluation log.
LOG = """
SELECT event_id AS row_ordinal,
       'q' || CAST(CAST(floor(event_id / 3) AS BIGINT) AS VARCHAR(20)) AS query_id,
       CASE event_id % 3 WHEN 0 THEN 'P1' WHEN 1 THEN 'P3' ELSE 'P4' END AS policy,
       CASE CAST(floor(event_id / 3) AS BIGINT) % 5 WHEN 0 THEN 'musique' WHEN 1 THEN 'quality'
            WHEN 2 THEN 'fever' WHEN 3 THEN 'hardmath' ELSE 'humaneval_plus' END AS dataset,
       CASE user_id % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-c' END AS model,
       CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'success' END AS status,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS latency_ms,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS input_tokens,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS output_tokens,
       (CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) % 5) / CAST(4 AS DOUBLE) AS primary_metric,
       CASE CAST(floor(event_id / 3) AS BIGINT) % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'reasoning' ELSE 'general' END AS task_tag,
       CASE WHEN event_id % 17 = 0 THEN NULL
            WHEN event_type IN ('click', 'view') THEN 'qa'
            WHEN event_type = 'error' THEN 'reasoning' ELSE 'general' END AS predicted_tag,
       ts AS completed_at
FROM events
"""

# Three role answers and ballots per example.
VOTES = """
SELECT event_id AS row_ordinal,
       CAST(floor(event_id / 3) AS BIGINT) AS example_id,
       CASE event_id % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'reasoning' ELSE 'general' END AS role,
       CASE WHEN event_id % 19 = 0 THEN '' ELSE 'answer ' || event_type END AS answer_text,
       CASE user_id % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'The answer is B.' WHEN 2 THEN '  c  '
            WHEN 3 THEN 'I choose B because...' WHEN 4 THEN 'nonsense' ELSE '' END AS vote_text,
       value AS latency_ms,
       CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS total_tokens
FROM events
"""

# Assistant turns against the turn before them, paired by number rather than by a window over
# the conversation, which may be of any length.
QA = """
SELECT a.conv_id, a.turn, a.text AS prediction, b.text AS reference
FROM conversations a JOIN (SELECT conv_id, turn + 1 AS turn, text FROM conversations) b
ON a.conv_id = b.conv_id AND a.turn = b.turn
WHERE a.role = 'assistant' AND b.text IS NOT NULL
"""

# Model output covering every extractor.
RESPONSES = """
SELECT event_id AS example_id, event_type, value, user_id,
       CASE event_type WHEN 'click' THEN 'musique' WHEN 'view' THEN 'quality' WHEN 'purchase' THEN 'fever'
            WHEN 'signup' THEN 'hardmath' ELSE 'humaneval_plus' END AS dataset,
       CASE user_id % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE 'model-c' END AS model,
       CASE event_type
         WHEN 'click' THEN CASE event_id % 3
              WHEN 0 THEN '<scratchpad>step one</scratchpad>' || chr(10) || 'Final Answer: user ' || CAST(user_id AS VARCHAR(20))
              WHEN 1 THEN 'Based on the text' || chr(10) || 'user ' || CAST(user_id AS VARCHAR(20)) || '.'
              ELSE 'Final Answer: NOT PRESENT IN CONTEXT' END
         WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'The answer is user ' || CAST(user_id AS VARCHAR(20)) || '.'
              ELSE 'Let me think' || chr(10) || 'The user ' || CAST(user_id AS VARCHAR(20)) END
         WHEN 'purchase' THEN CASE event_id % 5 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'This is refuted.'
              WHEN 2 THEN 'not enough info' WHEN 3 THEN 'Not enough information.' ELSE 'not true' END
         WHEN 'signup' THEN CASE event_id % 4
              WHEN 0 THEN 'so ' || chr(92) || 'boxed{1} then ' || chr(92) || 'boxed{' || chr(92) || 'frac{1}{' || CAST(user_id AS VARCHAR(20)) || '}}'
              WHEN 1 THEN 'Answer: ' || CAST(user_id AS VARCHAR(20)) || '.'
              WHEN 2 THEN 'steps 10 then 20 and ' || CAST(user_id AS VARCHAR(20)) || ' done'
              ELSE 'no number' END
         ELSE CASE event_id % 3
              WHEN 0 THEN 'Here:' || chr(10) || '```python' || chr(10) || 'def f(x):' || chr(10) || '    return x' || chr(10) || '```' || chr(10) || 'bye'
              WHEN 1 THEN '```' || chr(10) || 'def g(x):' || chr(10) || '    return x' || chr(10) || 'print(g(1))'
              ELSE 'import os' || chr(10) || 'def h(y):' || chr(10) || '    return y' || chr(10) || 'if __name__ == 1:' || chr(10) || '    h(1)' END
       END AS response_text,
       'user ' || CAST(user_id % 50 AS VARCHAR(20)) AS reference,
       CASE event_id % 3 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' ELSE 'NOT ENOUGH INFO' END AS gold_label,
       (event_id % 4 <> 0) AS answerable,
       CASE WHEN event_id % 23 = 0 THEN 'error' ELSE 'success' END AS prediction_status,
       CAST(floor(value) AS BIGINT) % 2 AS exit_code
FROM events
"""

# Raw benchmark rows of five sources.
RAW = """
SELECT doc_id AS row_ordinal, doc_id AS original_id,
       CASE doc_id % 5 WHEN 0 THEN 'MuSiQue' WHEN 1 THEN 'QuALITY' WHEN 2 THEN 'FEVER'
            WHEN 3 THEN 'HARDMATH' ELSE 'HumanEvalPlus' END AS source_dataset,
       text AS question, text AS context, source AS answer, n_chars,
       CASE doc_id % 7 WHEN 0 THEN 'REFUTES' WHEN 1 THEN 'NOT ENOUGH INFO' ELSE 'SUPPORTS' END AS label,
       doc_id % 5 + 1 AS level, (doc_id % 3 <> 0) AS answerable, lang, source
FROM documents
"""

# What the extractors must give for RESPONSES, fixed by the template of each row.
EXTRACTED = """
SELECT *, CASE event_type
         WHEN 'click' THEN CASE example_id % 3 WHEN 2 THEN 'NOT PRESENT IN CONTEXT'
              ELSE 'user ' || CAST(user_id AS VARCHAR(20)) END
         WHEN 'view' THEN CASE example_id % 2 WHEN 0 THEN 'user ' || CAST(user_id AS VARCHAR(20))
              ELSE 'The user ' || CAST(user_id AS VARCHAR(20)) END
         WHEN 'purchase' THEN CASE example_id % 5 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES'
              WHEN 2 THEN 'NOT ENOUGH INFO' WHEN 3 THEN 'not enough information.' ELSE 'SUPPORTS' END
         WHEN 'signup' THEN CASE example_id % 4
              WHEN 0 THEN chr(92) || 'frac{1}{' || CAST(user_id AS VARCHAR(20)) || '}'
              WHEN 3 THEN 'no number' ELSE CAST(user_id AS VARCHAR(20)) END
         ELSE CASE example_id % 3
              WHEN 0 THEN 'def f(x):' || chr(10) || '    return x'
              WHEN 1 THEN 'def g(x):' || chr(10) || '    return x'
              ELSE 'def h(y):' || chr(10) || '    return y' END
       END AS extracted
FROM fx_responses
"""

VIEWS = {
    "fx_log": LOG,
    "fx_votes": VOTES,
    "fx_qa": QA,
    "fx_responses": RESPONSES,
    "fx_raw": RAW,
    "fx_extracted": EXTRACTED,
}
_NEEDS = {"fx_extracted": ("fx_responses",)}

_TABLE_REF = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


def on_files(sql: str, sf_dir: str) -> str:
    """The statement with table names replaced by their Parquet files."""
    return _TABLE_REF.sub(rf"\1 parquet.`{sf_dir}/\2.parquet`", sql)


def with_views(sql: str) -> str:
    """The statement with the views it names put in front of it."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    for name in list(used):
        used.extend(extra for extra in _NEEDS.get(name, ()) if extra not in used)
    ordered = [name for name in VIEWS if name in used]
    if not ordered:
        return sql
    definitions = ", ".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {definitions}, {body[5:]}"
    return f"WITH {definitions} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(on_files(with_views(f"SELECT * FROM {name}"), sf_dir))
