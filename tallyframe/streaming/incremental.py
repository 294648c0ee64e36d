"""The growing-log operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.operators.predictions import PAIR_KEYS, as_predictions, match_cases
from tallyframe.operators.scoring import score_predictions
from tallyframe.session import work_path
from tallyframe.sources.commits import CommittedTable
from tallyframe.streaming.stateful import keyed_state


def score_stream(
    predictions: DataFrame, cases: DataFrame, order: str, suite_id: str = "suite"
) -> DataFrame:
    """Score predictions as their files land, against a static table of cases."""
    return score_predictions(match_cases(predictions, cases, order=order), suite_id)


def first_per_example(
    predictions: DataFrame,
    keys: Sequence[str] = PAIR_KEYS,
    event_time: str | None = "completed_at",
    delay: str = "1 day",
) -> DataFrame:
    """At most one row per key.

    With an event time the state of a key is dropped once it is older than the delay; without
    one every key is remembered for good.
    """
    if event_time is None:
        return predictions.dropDuplicates(list(keys))
    marked = predictions.withWatermark(event_time, delay)
    return marked.dropDuplicatesWithinWatermark(list(keys))


def answered_requests(
    requests: DataFrame,
    responses: DataFrame,
    run_id: str,
    requested_at: str = "requested_at",
    responded_at: str = "responded_at",
    timeout: str = "1 hour",
    delay: str = "1 day",
    prompt_version: str = "v1",
) -> DataFrame:
    """Prediction per request as requests and responses land, in any order of the two.

    A response counts if it came within ``timeout`` of its request; of several that of the first
    landing does. A request without one becomes an error row ``MissingResponse`` once the watermark,
    ``delay`` behind both streams, says that none can land any more; until then it waits in the state.
    Responses that land after that are dropped here and found by ``late_responses``. The columns are
    those of ``predictions_from_responses`` and the time of the request.
    """
    asked = requests.withWatermark(requested_at, delay)
    answered = first_per_example(responses, PAIR_KEYS, responded_at, delay)
    renamed = answered.withColumnsRenamed(
        {**{key: f"_{key}" for key in PAIR_KEYS}, "error_type": "_error_type", "error_message": "_error_message"}
    )
    same = [F.col(key) == F.col(f"_{key}") for key in PAIR_KEYS]
    in_time = F.col(responded_at).between(F.col(requested_at), F.col(requested_at) + F.expr(f"INTERVAL '{timeout}'"))
    joined = asked.join(renamed, [*same, in_time], "left_outer")
    return as_predictions(joined, run_id, prompt_version, carry=[requested_at])


def late_responses(responses: DataFrame, predictions: DataFrame) -> DataFrame:
    """Landed responses whose requests have been given up, for a second look at them."""
    lost = predictions.filter(F.col("error_type") == "MissingResponse").select(*PAIR_KEYS).distinct()
    return responses.join(lost, list(PAIR_KEYS), "left_semi")


def waiting_requests(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Landed requests that have neither an answer nor been given up."""
    return requests.join(predictions.select(*PAIR_KEYS), list(PAIR_KEYS), "left_anti")


def progress(predictions: DataFrame, keys: Sequence[str] = ("dataset_name", "model")) -> DataFrame:
    """Running counters per dataset and model."""
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("status") == "success").alias("completed"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def call_windows(
    calls: DataFrame,
    event_time: str = "started_at",
    width: str = "5 minutes",
    delay: str = "10 minutes",
    keys: Sequence[str] = ("model",),
) -> DataFrame:
    """Calls, errors and latency per tumbling window.

    Appended, a window comes out once the watermark has passed it, so the last ones of a log that
    has ended stay open; as running totals (see ``drain``) they are all there.
    """
    failed = F.col("error_type").isNotNull()
    return (
        calls.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width), *keys)
        .agg(
            F.count("*").alias("calls"),
            F.count_if(failed).alias("errors"),
            F.avg("latency_ms").alias("avg_latency_ms"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            *keys,
            "calls",
            "errors",
            (F.col("errors") / F.col("calls")).alias("error_rate"),
            "avg_latency_ms",
        )
    )


def append_to(
    stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Append the stream's final rows to a Parquet folder until the input is used up."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    return writer.partitionBy(*partition_by).start() if partition_by else writer.start()


def publish(batch: DataFrame, number: int, table: CommittedTable) -> bool:
    """Make a batch the table's only content, unless a batch of this number is committed already: a
    batch that is run again changes nothing. Readers see the one before until it is whole."""
    return table.commit(number, lambda folder: batch.write.parquet(folder), replace=True)


def replace_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a committed table at the latest state of a small running aggregate."""
    table = CommittedTable(stream.sparkSession, path)

    def write(batch: DataFrame, number: int) -> None:
        publish(batch, number, table)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def drain(
    stream: DataFrame,
    label: str,
    running_totals: bool = False,
    place: str | None = None,
    partition_by: Sequence[str] = (),
    machine: bool = False,
    state_partitions: int | None = None,
) -> DataFrame:
    """Run a stream over the input present now and read its result table.

    With ``running_totals`` the table is replaced by the latest state, which also holds windows
    that the watermark has not closed. A later run with the same ``place`` goes on where this one
    ended; without it the run stands alone. The state is in ``state`` below the place. ``machine``
    is for the streams of ``stateful``, see ``keyed_state``.
    """
    spark = stream.sparkSession
    root = work_path(spark, label) if place is None else place
    path, checkpoint = f"{root}/table", f"{root}/state"
    if running_totals:
        replace_table(stream, path, checkpoint).awaitTermination()
        return CommittedTable(spark, path).read(columns_of(stream))
    with keyed_state(spark, state_partitions, machine):
        query = append_to(stream, path, checkpoint, partition_by)
    query.awaitTermination()
    return spark.read.schema(columns_of(stream)).parquet(path)


def columns_of(df: DataFrame) -> str:
    """Names and types as the text of a schema, without marks of a watermark."""
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
