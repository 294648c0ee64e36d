"""Queries that build the mixed dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.functions.text import canonical_source, pair_name, stable_id
from tallyframe.operators import ranking, sampling
from tallyframe.operators.records import latest
from tallyframe.plans import sql_text as q
from tallyframe.plans.fixtures import table, view
from tallyframe.plans.registry import query
from tallyframe.sources import readers

def raw_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Rows of the five benchmarks in the nested shapes of their own files."""
    raw = view(spark, sf_dir, "fx_raw")
    original = F.col("original_id")
    shapes = {
        "MuSiQue": (
            original.alias("id"),
            "question",
            F.col("context").alias("paragraphs"),
            "answer",
            "answerable",
        ),
        "QuALITY": (
            F.struct(
                original.alias("id"), F.struct(F.col("context").alias("text")).alias("summary")
            ).alias("document"),
            F.struct(F.col("question").alias("text")).alias("question"),
            F.array(F.struct(F.col("answer").alias("text"))).alias("answers"),
        ),
        "FEVER": (
            original.alias("id"),
            F.col("question").alias("claim"),
            F.array(F.array(F.lit("page"), F.lit("0"), F.col("context"))).alias("evidence"),
            "label",
        ),
        "HARDMATH": (
            original.alias("unique_id"),
            F.col("question").alias("problem"),
            F.col("answer").alias("solution"),
            F.col("source").alias("answer"),
            "level",
        ),
        "HumanEvalPlus": (
            original.alias("task_id"),
            F.col("question").alias("prompt"),
            F.col("answer").alias("canonical_solution"),
            F.col("label").alias("test"),
            F.col("lang").alias("entry_point"),
        ),
    }
    return {
        name: raw.filter(F.col("source_dataset") == name).select("row_ordinal", *columns)
        for name, columns in shapes.items()
    }


_CANONICAL = """CASE WHEN lower(source_dataset) LIKE '%musique%' THEN 'musique'
 WHEN lower(source_dataset) LIKE '%quality%' THEN 'quality'
 WHEN lower(source_dataset) LIKE '%fever%' THEN 'fever'
 WHEN lower(source_dataset) LIKE '%math%' THEN 'hardmath' ELSE 'humaneval_plus' END"""
_KEY = q.shuffle_key("row_ordinal")


@query(
    f"""SELECT row_ordinal, substr(md5(source_dataset || '_' || CAST(original_id AS VARCHAR)), 1, 12) AS id,
    {_CANONICAL} AS dataset,
    regexp_replace(source_dataset || ' ' || source, '[^A-Za-z0-9._-]+', '_', 'g') || '__' || lang
      AS file_name FROM fx_raw"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw")
    name = pair_name(F.concat_ws(" ", "source_dataset", "source"), F.col("lang"))
    return raw.select(
        "row_ordinal",
        stable_id(F.col("source_dataset"), F.col("original_id")).alias("id"),
        canonical_source(F.col("source_dataset")).alias("dataset"),
        name.alias("file_name"),
    )


@query(
    f"""SELECT substr(md5(source_dataset || '_' || CAST(original_id AS VARCHAR)), 1, 12) AS id,
    source_dataset, question,
    CASE WHEN source_dataset IN ('MuSiQue', 'QuALITY', 'FEVER') THEN context ELSE '' END AS context,
    CASE source_dataset WHEN 'FEVER' THEN label
      WHEN 'QuALITY' THEN '[{{"text":"' || answer || '"}}]' ELSE answer END AS gold_answer,
    CASE source_dataset WHEN 'FEVER' THEN label ELSE '' END AS gold_label,
    CASE source_dataset WHEN 'MuSiQue' THEN 'retrieval,multi-hop' WHEN 'QuALITY' THEN 'long-context'
      WHEN 'FEVER' THEN 'fact-check' WHEN 'HARDMATH' THEN 'math' ELSE 'code' END AS skill_tags,
    CAST(original_id AS VARCHAR) AS original_id,
    CASE source_dataset WHEN 'MuSiQue' THEN '{{"answerable":' || CAST(answerable AS VARCHAR) || '}}'
      WHEN 'HumanEvalPlus' THEN '{{"entry_point":"' || lang || '"}}' ELSE '{{}}' END AS metadata,
    CASE source_dataset WHEN 'HumanEvalPlus' THEN label ELSE '' END AS unit_tests
    FROM fx_raw"""
)
def unified_source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        sampling.source_rows(rows, name) for name, rows in raw_sources(spark, sf_dir).items()
    ]
    whole = sampling.union_sources(parts)
    return whole.drop("hallucination_subset", "split").withColumn(
        "skill_tags", F.array_join("skill_tags", ",")
    )


@query(f"SELECT row_ordinal, source_dataset FROM fx_raw ORDER BY {_KEY} LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal", "source_dataset")
    return sampling.seeded_sample(raw, "row_ordinal", 100)


@query(
    """SELECT row_ordinal, length(question) > 20 AS long_claim, length(question) > 30 AS long_question,
    level IN (4, 5) AS hard, coalesce(context, '') <> '' AS has_context FROM fx_raw"""
)
def source_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw")
    return raw.select(
        "row_ordinal",
        sampling.longer_than(F.col("question"), fv.MIN_CLAIM_LENGTH).alias("long_claim"),
        sampling.longer_than(F.col("question"), fv.MIN_QUESTION_LENGTH).alias("long_question"),
        sampling.hard_levels(F.col("level")).alias("hard"),
        sampling.has_text(F.col("context")).alias("has_context"),
    )


_BALANCED = f"""SELECT row_ordinal, label FROM (SELECT row_ordinal, label,
 row_number() OVER (PARTITION BY label ORDER BY {_KEY}) AS rn FROM fx_raw
 WHERE length(question) > 20) WHERE rn <= 34 ORDER BY {_KEY} LIMIT 100"""


@query(_BALANCED)
def label_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").filter(
        sampling.longer_than(F.col("question"), fv.MIN_CLAIM_LENGTH)
    )
    sample = sampling.label_balanced_sample(raw, "label", "row_ordinal", 100)
    return sample.select("row_ordinal", "label")


@query(
    f"""SELECT row_ordinal, answerable FROM (SELECT row_ordinal, answerable,
    row_number() OVER (PARTITION BY answerable ORDER BY {_KEY}) AS rn FROM fx_raw
    WHERE length(question) > 30) WHERE rn <= CASE WHEN answerable THEN 90 ELSE 10 END"""
)
def answerability_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").filter(
        sampling.longer_than(F.col("question"), fv.MIN_QUESTION_LENGTH)
    )
    sample = sampling.answerability_sample(raw, "answerable", "row_ordinal", 100)
    return sample.select("row_ordinal", "answerable")


@query(
    """SELECT row_ordinal, context || chr(10) || '["' || lang || '","' || source || '"]' AS evidence
    FROM fx_raw"""
)
def flattened_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw")
    evidence = F.array(F.array("lang", "source", "context"), F.array("lang", "source"))
    return raw.select("row_ordinal", sampling.flatten_evidence(evidence).alias("evidence"))


def _split_sql(rows: str, key: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY {q.shuffle_key(key)})
    <= floor(count(*) OVER (PARTITION BY source_dataset) * CAST(0.6 AS DOUBLE)) AS dev FROM {rows}"""


@query(
    f"""SELECT row_ordinal, source_dataset, CASE WHEN dev THEN 'dev' ELSE 'mini-test' END AS split
    FROM ({_split_sql('fx_raw', 'row_ordinal')})"""
)
def dev_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal", "source_dataset")
    return sampling.split_dev_test(raw, "row_ordinal").select(
        "row_ordinal", "source_dataset", "split"
    )


def _sampled(source: str, condition: str, rank: str = "TRUE") -> str:
    return f"""SELECT row_ordinal, source_dataset FROM fx_raw
    WHERE source_dataset = '{source}' AND {condition} ORDER BY {_KEY} LIMIT 100"""


@query(
    f"""WITH m AS (SELECT row_ordinal, source_dataset FROM (SELECT *, row_number() OVER
      (PARTITION BY answerable ORDER BY {_KEY}) AS rn FROM fx_raw
      WHERE source_dataset = 'MuSiQue' AND length(question) > 30)
      WHERE rn <= CASE WHEN answerable THEN 90 ELSE 10 END),
    f AS (SELECT row_ordinal, source_dataset FROM (SELECT *, row_number() OVER
      (PARTITION BY label ORDER BY {_KEY}) AS rn FROM fx_raw
      WHERE source_dataset = 'FEVER' AND length(question) > 20)
      WHERE rn <= 34 ORDER BY {_KEY} LIMIT 100),
    n AS ({_sampled('QuALITY', "coalesce(context, '') <> ''")}),
    h AS ({_sampled('HARDMATH', 'level IN (4, 5)')}),
    c AS ({_sampled('HumanEvalPlus', 'TRUE')}),
    mixed AS (SELECT *, {_KEY} AS sample_order FROM (FROM m UNION ALL FROM f UNION ALL FROM n
      UNION ALL FROM h UNION ALL FROM c)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY source_dataset ORDER BY sample_order) AS place
      FROM ({_split_sql('mixed', 'sample_order')}))
    SELECT substr(md5(source_dataset || '_' || CAST(row_ordinal AS VARCHAR)), 1, 12) AS id,
      source_dataset, CAST(row_ordinal AS VARCHAR) AS original_id,
      place <= CASE source_dataset WHEN 'FEVER' THEN 15 WHEN 'MuSiQue' THEN 8 WHEN 'QuALITY' THEN 7
        ELSE 0 END AS hallucination_subset,
      CASE WHEN dev THEN 'dev' ELSE 'mini-test' END AS split FROM placed"""
)
def mixed_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = sampling.build_mixed_dataset(raw_sources(spark, sf_dir))
    return built.select("id", "source_dataset", "original_id", "hallucination_subset", "split")


@query(
    f"""WITH firsts AS (SELECT row_ordinal % 40 AS id, source_dataset FROM (SELECT *, row_number() OVER
      (PARTITION BY source_dataset ORDER BY {_KEY}) AS place FROM fx_raw) WHERE place <= CASE source_dataset
      WHEN 'FEVER' THEN 3 WHEN 'MuSiQue' THEN 5 ELSE 0 END)
    SELECT row_ordinal, source_dataset, row_ordinal % 40 IN (SELECT id FROM firsts) AS hallucination_subset FROM fx_raw"""
)
def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by quotas per source; all rows of a flagged id have the flag."""
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal", "source_dataset")
    order = ranking.shuffle_key(F.col("row_ordinal"), 42)
    keyed = raw.withColumns({"sample_order": order, "id": F.col("row_ordinal") % 40})
    flagged = sampling.flag_subset(keyed, "sample_order", {"FEVER": 3, "MuSiQue": 5})
    return flagged.select("row_ordinal", "source_dataset", "hallucination_subset")


@query(
    """SELECT row_ordinal, CASE WHEN row_ordinal = (SELECT max(row_ordinal) FROM fx_raw)
    THEN 'code,fact-verification' ELSE 'code' END AS skill_tags FROM fx_raw"""
)
def tag_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal").withColumn(
        "skill_tags", F.array(F.lit("code"))
    )
    newest = raw.agg(F.max("row_ordinal").alias("newest"), F.lit(1).alias("one"))
    joined = raw.withColumn("one", F.lit(1)).join(newest, "one")
    tagged = sampling.add_tag(joined, "row_ordinal", F.col("newest"), "fact-verification")
    return tagged.select("row_ordinal", F.array_join("skill_tags", ",").alias("skill_tags"))


_TURNS = """SELECT row_ordinal, source_dataset,
 row_number() OVER (PARTITION BY source_dataset ORDER BY row_ordinal) AS turn,
 min(row_ordinal) OVER (PARTITION BY source_dataset) AS first_seen FROM fx_raw"""


@query(
    f"""SELECT row_ordinal, source_dataset, CAST(turn AS BIGINT) AS turn FROM ({_TURNS})
    ORDER BY turn, first_seen LIMIT 203"""
)
def round_robin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal", "source_dataset")
    rows = sampling.round_robin(raw, "source_dataset", "row_ordinal", 203)
    return rows.select("row_ordinal", "source_dataset", F.col("turn").cast("bigint").alias("turn"))


@query(f"SELECT row_ordinal, source_dataset, CAST(turn AS BIGINT) AS turn FROM ({_TURNS})")
def round_robin_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal", "source_dataset")
    rows = sampling.round_robin(raw, "source_dataset", "row_ordinal")
    return rows.select("row_ordinal", "source_dataset", F.col("turn").cast("bigint").alias("turn"))


@query(
    f"""SELECT source_dataset, CAST(floor((turn - 1) / 32) AS BIGINT) AS batch_id,
    count(*) AS cases, min(row_ordinal) AS first_row, max(row_ordinal) AS last_row
    FROM ({_TURNS}) GROUP BY 1, 2"""
)
def chunked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal", "source_dataset")
    chunks = sampling.chunk_rows(raw, ["source_dataset"], "row_ordinal", 32)
    return chunks.groupBy("source_dataset", "batch_id").agg(
        F.count("*").alias("cases"),
        F.min("row_ordinal").alias("first_row"),
        F.max("row_ordinal").alias("last_row"),
    )


@query(
    f"""SELECT row_ordinal, CAST(floor((turn - 1) / 32) AS BIGINT) AS batch_id
    FROM ({_TURNS}) WHERE turn <= 160"""
)
def chunked_cases_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal", "source_dataset")
    chunks = sampling.chunk_rows(raw, ["source_dataset"], "row_ordinal", 32, max_rows=160)
    return chunks.select("row_ordinal", "batch_id")


@query(
    """SELECT row_ordinal, source_dataset FROM fx_raw
    WHERE lower(source_dataset) IN ('fever', 'musique')"""
)
def dataset_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal", "source_dataset")
    return sampling.dataset_subset(raw, [" FEVER", "MuSiQue "])


@query("SELECT row_ordinal FROM fx_raw ORDER BY row_ordinal DESC LIMIT 2")
def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = view(spark, sf_dir, "fx_raw").select("row_ordinal")
    return sampling.tail_rows(raw, "row_ordinal")


@query(
    """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_ordinal
    FROM orders"""
)
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_numbered(spark, f"{sf_dir}/orders.parquet", "o_orderkey")
    return rows.select("o_orderkey", "row_ordinal")


@query(
    """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS BIGINT) AS turn
    FROM orders"""
)
def numbered_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the order of a key whose values are sparse."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    keyed = orders.withColumn("place", F.md5(F.col("o_orderkey").cast("string")))
    numbered = ranking.number_rows(keyed, [], "place", "turn")
    return numbered.select("o_orderkey", F.col("turn").cast("bigint").alias("turn"))


@query(
    """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type
    FROM events GROUP BY user_id"""
)
def last_record_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return latest(events, ["user_id"], "event_id")


@query("SELECT l_returnflag, median(l_extendedprice) AS median_price FROM lineitem GROUP BY ALL")
def exact_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return ranking.exact_median(rows, ["l_returnflag"], "l_extendedprice", "median_price")
