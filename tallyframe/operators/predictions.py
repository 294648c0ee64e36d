"""Runs of models over examples: fan-out, resume, responses, counters, request cache."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions.text import let, text_or_empty
from tallyframe.operators.records import latest, merge_maps

PAIR_KEYS = ("dataset_name", "model", "example_id")


def fan_out(examples: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every example once per configured model, expanded in place."""
    return examples.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))


def recorded_keys(
    predictions: DataFrame,
    keys: Sequence[str] = PAIR_KEYS,
    retry_errors: bool = False,
) -> DataFrame:
    """Distinct keys already recorded; failed ones count as done unless they are retried."""
    done = predictions.filter("status = 'success'") if retry_errors else predictions
    return done.filter(F.col("example_id").isNotNull()).select(*keys).distinct()


def pending(planned: DataFrame, recorded: DataFrame, keys: Sequence[str] = PAIR_KEYS) -> DataFrame:
    """Planned rows not recorded yet."""
    return planned.join(recorded, list(keys), "left_anti")


def restrict_to_batch(
    predictions: DataFrame, batch: DataFrame, keys: Sequence[str] = ("example_id",)
) -> DataFrame:
    """Predictions of the examples in a batch."""
    return predictions.join(batch.select(*keys).distinct(), list(keys), "left_semi")


def match_cases(
    predictions: DataFrame,
    cases: DataFrame,
    keys: Sequence[str] = ("dataset_name", "example_id"),
    *,
    order: str,
) -> DataFrame:
    """Predictions with their case; cases of one id resolve to the last by ``order``."""
    kept = [name for name in cases.columns if name != order]
    unique = latest(cases, keys, order, kept)
    return predictions.join(unique, list(keys), "inner")


def orphans(
    predictions: DataFrame,
    cases: DataFrame,
    keys: Sequence[str] = ("dataset_name", "example_id"),
) -> DataFrame:
    """Predictions without a case."""
    return predictions.join(cases.select(*keys).distinct(), list(keys), "left_anti")


def parse_chat_response(df: DataFrame, raw: str, default_model: str = "unknown") -> DataFrame:
    """Columns of a chat-completion JSON; bad JSON or no choices give an error row."""
    parsed = df.withColumn("_r", F.from_json(raw, schemas.CHAT_RESPONSE))
    text = text_or_empty(F.col(raw))
    is_json = F.try_parse_json(text).isNotNull()
    has_choices = F.coalesce(F.size("_r.choices") > 0, F.lit(False))
    first = F.get(F.col("_r.choices"), F.lit(0))
    problem = F.when(~is_json, "provider returned non-JSON response").when(
        ~has_choices, "provider response did not include choices"
    )

    def if_ok(value: Column) -> Column:
        return F.when(has_choices, value)

    return parsed.withColumns(
        {
            "response_status": F.when(has_choices, "success").otherwise("error"),
            "response_model": if_ok(F.coalesce("_r.model", F.lit(default_model))),
            "response_role": if_ok(F.coalesce(first["message"]["role"], F.lit("assistant"))),
            "response_text": if_ok(F.coalesce(first["message"]["content"], F.lit(""))),
            "finish_reason": if_ok(first["finish_reason"]),
            "request_id": if_ok(F.col("_r.id")),
            "usage": F.struct(
                if_ok(F.col("_r.usage.prompt_tokens")).alias("input_tokens"),
                if_ok(F.col("_r.usage.completion_tokens")).alias("output_tokens"),
                if_ok(F.col("_r.usage.total_tokens")).alias("total_tokens"),
                F.lit(None).cast("double").alias("cost"),
                F.lit(None).cast("string").alias("currency"),
            ),
            "error_type": F.when(problem.isNotNull(), "LLMResponseError"),
            "error_message": problem,
        }
    ).drop("_r")


def predictions_from_responses(
    requests: DataFrame,
    responses: DataFrame,
    run_id: str,
    prompt_version: str = "v1",
    keep_raw: bool = False,
    order: str = "row_ordinal",
) -> DataFrame:
    """Prediction per request. A request without a usable response becomes an error row.

    ``responses`` has the pair keys, ``order``, ``response_status``, ``response_text``,
    ``latency_ms``, ``usage`` and the error columns; the last response of a key counts.
    """
    keys = list(PAIR_KEYS)
    last = latest(responses, keys, order).withColumnsRenamed(
        {"error_type": "_error_type", "error_message": "_error_message"}
    )
    return as_predictions(requests.join(last, keys, "left"), run_id, prompt_version, keep_raw)


def as_predictions(
    joined: DataFrame,
    run_id: str,
    prompt_version: str = "v1",
    keep_raw: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Predictions from requests with the columns of their response beside them, whose error columns
    begin with an underscore; without a response these are null."""
    invalid = F.col("request_status") == "error"
    missing = F.col("response_status").isNull()
    success = ~invalid & F.coalesce(F.col("response_status") == "success", F.lit(False))

    def if_ok(name: str) -> Column:
        return F.when(success, F.col(name)).alias(name)

    raw = [F.when(success, F.col("raw_response")).alias("raw_response")] if keep_raw else []
    return joined.select(
        F.lit(run_id).alias("run_id"),
        *PAIR_KEYS,
        *carry,
        F.when(success, "success").otherwise("error").alias("status"),
        F.lit(prompt_version).alias("prompt_version"),
        if_ok("response_text"),
        if_ok("latency_ms"),
        if_ok("usage"),
        F.when(invalid, F.col("error_type"))
        .when(missing, "MissingResponse")
        .when(~success, F.col("_error_type"))
        .alias("error_type"),
        F.when(invalid, F.col("error_message"))
        .when(missing, "no response recorded")
        .when(~success, F.col("_error_message"))
        .alias("error_message"),
        *raw,
    )


def run_counters(
    planned: DataFrame, recorded: DataFrame, results: DataFrame, keys: Sequence[str] = PAIR_KEYS
) -> DataFrame:
    """Totals of a run: planned, skipped as recorded, attempted, completed and failed."""
    done = recorded.withColumn("_done", F.lit(True))
    outcome = results.select(*keys, F.col("status").alias("_status"))
    marked = planned.join(done, list(keys), "left").join(outcome, list(keys), "left")
    attempted = F.col("_done").isNull() & F.col("_status").isNotNull()
    return marked.agg(
        F.count("*").alias("total_examples"),
        F.count_if(F.col("_done")).alias("skipped_existing"),
        F.count_if(attempted).alias("attempted_examples"),
        F.count_if(attempted & (F.col("_status") == "success")).alias("completed_examples"),
        F.count_if(attempted & (F.col("_status") == "error")).alias("failed_examples"),
    )


def request_key(*columns: str) -> Column:
    """Cache key of a request: digest of its canonical JSON."""
    ordered = sorted(columns)
    return F.sha2(F.to_json(F.struct(*[F.col(name) for name in ordered])), 256)


def cached_responses(
    requests: DataFrame, cache: DataFrame, key: str = "cache_key", order: str = "row_ordinal"
) -> DataFrame:
    """Requests with the stored response of their key, null on a miss."""
    kept = [name for name in cache.columns if name != order]
    return requests.join(latest(cache, [key], order, kept), key, "left")


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Distinct requests whose key the cache lacks."""
    return requests.join(cache.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def request_payload(
    requests: DataFrame, default_params: dict[str, str] | None = None, name: str = "payload"
) -> DataFrame:
    """Request body as JSON text with keys in order.

    Later parts win: model and messages, default parameters, set request fields, provider
    parameters. Parameter values are JSON texts. Needs resolved ``messages``.
    """
    fields = [F.lit(item) for pair in sorted((default_params or {}).items()) for item in pair]
    defaults = F.create_map(*fields).cast("map<string,string>")
    quoted_model = F.to_json(F.array(F.col("model")))
    base = F.create_map(
        F.lit("model"),
        F.substring(quoted_model, F.lit(2), F.length(quoted_model) - 2),
        F.lit("messages"),
        F.to_json(F.col("messages")),
    )
    explicit = F.map_filter(
        F.create_map(
            F.lit("temperature"),
            F.col("temperature").cast("string"),
            F.lit("max_tokens"),
            F.col("max_tokens").cast("string"),
            F.lit("stop"),
            F.when(F.size("stop_sequences") > 0, F.to_json("stop_sequences")),
        ),
        lambda _, value: value.isNotNull(),
    )
    merged = merge_maps(
        merge_maps(merge_maps(base, defaults), explicit), F.col("provider_params")
    )

    def as_object(entries: Column) -> Column:
        pairs = F.transform(
            entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])
        )
        return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))

    return requests.withColumn(name, let(F.array_sort(F.map_entries(merged)), as_object))
