"""The streaming operators run over the events table to the end of their input."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import predictions
from tallyframe.plans.fixtures import table
from tallyframe.plans.registry import query
from tallyframe.plans.texts import _IF_OK, METRIC_COLUMNS, SCORED, matched_responses
from tallyframe.session import work_path
from tallyframe.sources.commits import CommittedTable
from tallyframe.streaming import incremental, stateful


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of their files."""
    return (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )


def _log_stream(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        *more,
        F.lit("events").alias("dataset_name"),
        F.col("event_type").alias("model"),
        F.col("user_id").cast("string").alias("example_id"),
        F.when(F.col("value") < 5, "error").otherwise("success").alias("status"),
        F.col("ts").cast("timestamp").alias("completed_at"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.when(F.col("value") < 5, "LLMTransportError").alias("error_type"),
        F.col("value").alias("latency_ms"),
    )


@query(
    f"""WITH {SCORED} SELECT CAST(example_id AS VARCHAR) AS example_id, dataset AS dataset_name,
    CASE WHEN prediction_status = 'success' THEN 'scored' ELSE 'prediction_error' END AS status, {_IF_OK}
    FROM metric"""
)
def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = matched_responses(spark, sf_dir)
    keys = ("dataset_name", "example_id")
    cases = matched.select(*keys, "reference", "answerable", "row_ordinal")
    lines = work_path(spark, "landing")
    landed = matched.drop("reference", "answerable", "row_ordinal")
    landed.write.json(lines)
    stream = spark.readStream.schema(landed.schema).json(lines)
    scores = incremental.drain(incremental.score_stream(stream, cases, "row_ordinal"), "streamed-scores")
    return scores.select(
        "example_id",
        "dataset_name",
        "status",
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in METRIC_COLUMNS],
    )


@query(
    """SELECT DISTINCT 'events' AS dataset_name, event_type AS model, CAST(user_id AS VARCHAR) AS example_id,
    strftime(ts, '%Y-%m-%d') AS day FROM events"""
)
def streamed_first_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key repeats within its day, so that two days of state are enough to keep it once."""
    keys = (*predictions.PAIR_KEYS, "day")
    stream = _log_stream(event_stream(spark, sf_dir))
    first = incremental.first_per_example(stream, keys, delay="2 days")
    return incremental.drain(first.select(*keys), "first-predictions")


@query(
    """SELECT 'events' AS dataset_name, event_type AS model, count(*) AS attempted,
    CAST(count_if(value >= 5) AS BIGINT) AS completed, CAST(count_if(value < 5) AS BIGINT) AS failed
    FROM events GROUP BY ALL"""
)
def streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = incremental.progress(_log_stream(event_stream(spark, sf_dir)))
    return incremental.drain(counters, "progress", running_totals=True)


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type AS model, value FROM events)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, model, count(*) AS calls,
    CAST(count_if(value < 5) AS BIGINT) AS errors, round(count_if(value < 5) / count(*), 6) AS error_rate,
    round(avg(value), 6) AS avg_latency_ms
    FROM w GROUP BY window_start, model"""
)
def streamed_call_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = incremental.call_windows(_log_stream(event_stream(spark, sf_dir)), "completed_at")
    rows = incremental.drain(windows, "call-windows", running_totals=True)
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "model",
        "calls",
        "errors",
        F.round("error_rate", 6).alias("error_rate"),
        F.round("avg_latency_ms", 6).alias("avg_latency_ms"),
    )




# Enough for the state of the given tables, whose keys are some thousands.
_STATE_PARTITIONS = 16

# Landings of the events in thirds of the month. Of each third some rows land with a later one.
_THIRD = """CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 1 WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 2 ELSE 3 END"""


def _third(at: Column) -> Column:
    return F.when(at < "2024-01-11", 1).when(at < "2024-01-21", 2).otherwise(3)


def _landings(spark: SparkSession, rows: DataFrame, number: Column, label: str) -> Iterator[tuple[int, DataFrame]]:
    """Land the rows in three runs. Each gives the number of the landing and a stream of all files so
    far, for a query that goes on from its last run."""
    folder = work_path(spark, label)
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    for landing in (1, 2, 3):
        rows.filter(number == landing).write.parquet(f"{folder}/landing={landing}")
        stream = spark.readStream.schema(kinds).option("basePath", folder).parquet(f"{folder}/landing=*")
        yield landing, stream.select(*rows.columns)


@query(
    f"""WITH rows AS (SELECT event_type AS model, user_id AS example_id, ts, event_id, value FROM events),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY model, example_id ORDER BY ts, event_id) AS k FROM rows)
    SELECT model, CAST(example_id AS VARCHAR) AS example_id, event_id AS row_ordinal,
    CASE WHEN value < 5 THEN 'error' ELSE 'success' END AS status, value AS latency_ms,
    CASE WHEN epoch_ms(ts) < (SELECT epoch_ms(max(ts)) FROM events) - 12 * 86400000 THEN 'out' ELSE 'held' END AS place
    FROM firsts WHERE k = 1"""
)
def first_predictions_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prediction of each model and example by time and ordinal. Every tenth row lands with
    the next third of the month, so that the first to land is often not the first by time; the query
    is started anew for each landing. Rows that may still be preceded are held back in the state."""
    rows = _log_stream(table(spark, sf_dir, "events"), "event_id").select(
        "model", "example_id", F.col("event_id").alias("row_ordinal"), "status", "latency_ms", "completed_at"
    )
    number = F.least(F.lit(3), _third(F.col("completed_at")) + F.when(F.col("row_ordinal") % 10 == 0, 1).otherwise(0))
    place = work_path(spark, "first-rows")
    # Two full rounds of tasks: 16 on 12 cores would leave most of them idle in the second.
    partitions = max(_STATE_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)
    for _, stream in _landings(spark, rows, number, "out-of-order"):
        firsts = stateful.first_rows(stream, "completed_at", "row_ordinal", ("model", "example_id"), delay="12 days")
        out = incremental.drain(firsts, "first-rows", place=place, machine=True, state_partitions=partitions)
    held = stateful.held_rows(spark, f"{place}/state", rows)
    both = out.withColumn("place", F.lit("out")).unionByName(held.withColumn("place", F.lit("held")))
    return both.drop("completed_at")


@query(
    f"""WITH rows AS (SELECT event_id, event_type AS model, value, ts, epoch_ms(ts) AS ms,
      least(3, {_THIRD} + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS landing,
      time_bucket(INTERVAL '5 minutes', ts) AS window_start FROM events),
    marks AS (SELECT landing, max(max(ms)) OVER (ORDER BY landing) - 9 * 86400000 AS mark FROM rows GROUP BY landing),
    seen AS (SELECT r.*, epoch_ms(window_start) + 300000 - 8 * 86400000 AS closing, coalesce(m.mark, 0) AS mark
      FROM rows r LEFT JOIN marks m ON m.landing = r.landing - 1),
    told AS (SELECT *, CASE WHEN mark < closing THEN CASE WHEN closing <= (SELECT max(mark) FROM marks) THEN 'closed' ELSE 'open' END
      WHEN ms > mark THEN 'late' END AS kind FROM seen)
    SELECT kind, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, model, count(*) AS calls,
    CAST(count_if(value < 5) AS BIGINT) AS errors, round(avg(value), 6) AS avg_latency_ms, CAST(NULL AS BIGINT) AS event_id
    FROM told WHERE kind IN ('closed', 'open') GROUP BY kind, window_start, model
    UNION ALL SELECT kind, strftime(window_start, '%Y-%m-%d %H:%M:%S'), model, 1, CAST(value < 5 AS BIGINT), round(value, 6), event_id
    FROM told WHERE kind = 'late'"""
)
def call_windows_that_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call windows over three landings: the closed ones, those still open, and the calls that landed
    after their window had closed."""
    calls = _log_stream(table(spark, sf_dir, "events"), "event_id").select(
        "event_id", "model", "error_type", "latency_ms", "completed_at"
    )
    number = F.least(F.lit(3), _third(F.col("completed_at")) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    place = work_path(spark, "closing")
    for _, stream in _landings(spark, calls, number, "late-calls"):
        windows = stateful.closing_windows(stream, "completed_at", delay="1 day", grace="8 days")
        out = incremental.drain(
            windows, "closing", place=place, partition_by=("kind",), machine=True, state_partitions=_STATE_PARTITIONS
        )
    minute = lambda at: F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("window_start")

    def told(rows: DataFrame, kind: str) -> DataFrame:
        return stateful.window_rows(rows, calls).select(
            F.lit(kind).alias("kind"), minute("window_start"), "model", "calls", "errors",
            F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.lit(None).cast("bigint").alias("event_id"),
        )

    late = stateful.late_rows(out, calls).select(
        F.lit("late").alias("kind"), minute(F.window("completed_at", "5 minutes")["start"]), "model", F.lit(1).cast("bigint").alias("calls"),
        F.col("error_type").isNotNull().cast("bigint").alias("errors"), F.round("latency_ms", 6).alias("avg_latency_ms"), "event_id",
    )
    closed = told(out.filter("kind = 'closed'"), "closed")
    return closed.unionByName(told(stateful.open_windows(spark, f"{place}/state"), "open")).unionByName(late)


@query(
    f"""SELECT 'events' AS dataset_name, event_type AS model, count(*) AS attempted,
    CAST(count_if(value >= 5) AS BIGINT) AS completed, CAST(count_if(value < 5) AS BIGINT) AS failed,
    CAST(count_if({_THIRD} < 3) AS BIGINT) AS attempted_before, false AS replay_written
    FROM events GROUP BY event_type"""
)
def replayed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A progress table over three landings. A batch that comes again, here with other rows, is known
    by its number and changes nothing; a reader from before the last landing keeps its version."""
    rows = _log_stream(table(spark, sf_dir, "events")).select("dataset_name", "model", "status", "completed_at")
    place = work_path(spark, "replayed")
    states = [
        incremental.drain(incremental.progress(stream), "replayed", running_totals=True, place=place)
        for _, stream in _landings(spark, rows, _third(F.col("completed_at")), "progress")
    ]
    published = CommittedTable(spark, f"{place}/table")
    again = incremental.publish(states[0], published.numbers()[-1], published)
    latest_state = published.read(incremental.columns_of(states[0]))
    before = states[1].select("model", F.col("attempted").alias("attempted_before"))
    return latest_state.join(before, "model", "left").select(
        "dataset_name", "model", "attempted", "completed", "failed",
        F.coalesce("attempted_before", F.lit(0)).alias("attempted_before"), F.lit(again).alias("replay_written"),
    )


# Requests of every event; a response within 50 minutes but for every seventh. Every eleventh response
# lands with the last landing.
_EXCHANGE = f"""asked AS (SELECT event_id, ts, epoch_ms(ts) AS ms, {_THIRD} AS landing FROM events),
    answered AS (SELECT event_id, event_type, value, epoch_ms(ts) + CAST(floor(value % 50) AS BIGINT) * 60000 AS ms,
      CASE WHEN event_id % 11 = 0 THEN 3 ELSE {_THIRD} END AS landing FROM events WHERE event_id % 7 <> 0),
    numbers AS (SELECT unnest([1, 2, 3]) AS landing),
    marks AS (SELECT landing, least((SELECT max(ms) FROM asked a WHERE a.landing <= n.landing),
      (SELECT max(ms) FROM answered a WHERE a.landing <= n.landing)) - 86400000 AS mark FROM numbers n),
    settled AS (SELECT a.event_id, a.ms, r.event_type, r.value, a.landing, r.landing AS responded,
      r.event_id IS NOT NULL AND r.ms > coalesce(m.mark, 0) AS matched, a.ms + 3600000 < (SELECT max(mark) FROM marks) AS given_up
      FROM asked a LEFT JOIN answered r USING (event_id) LEFT JOIN marks m ON m.landing = r.landing - 1)"""


@query(
    f"""WITH {_EXCHANGE}
    SELECT CAST(event_id AS VARCHAR) AS example_id,
    CASE WHEN matched THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END WHEN given_up THEN 'error' ELSE 'waiting' END AS status,
    CASE WHEN matched AND event_type <> 'error' THEN event_type END AS response_text,
    CASE WHEN matched AND event_type <> 'error' THEN value END AS latency_ms,
    CASE WHEN matched THEN CASE WHEN event_type = 'error' THEN 'LLMTransportError' END WHEN given_up THEN 'MissingResponse' END AS error_type,
    NOT matched AND given_up AND event_type IS NOT NULL AS late_response
    FROM settled"""
)
def responses_as_they_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and responses joined as both land, over three landings: answers, requests given up,
    requests that still wait, and responses that landed too late."""
    events = table(spark, sf_dir, "events")
    at, failed = F.col("ts").cast("timestamp"), F.col("event_type") == "error"
    names = [F.lit("events").alias("dataset_name"), F.lit("model-a").alias("model"), F.col("event_id").cast("string").alias("example_id")]
    none = F.lit(None).cast("string")
    requests = events.select(
        *names, at.alias("requested_at"), F.lit("ready").alias("request_status"), none.alias("error_type"), none.alias("error_message"),
        F.col("event_id").alias("number"),
    )
    responses = events.filter("event_id % 7 <> 0").select(
        *names,
        (at + F.make_dt_interval(mins=F.floor(F.col("value") % 50).cast("int"))).alias("responded_at"),
        F.when(failed, "error").otherwise("success").alias("response_status"),
        F.col("event_type").alias("response_text"),
        F.col("value").alias("latency_ms"),
        F.lit(None).cast("struct<total_tokens:bigint>").alias("usage"),
        F.when(failed, "LLMTransportError").alias("error_type"),
        none.alias("error_message"),
        F.when(F.col("event_id") % 11 == 0, 3).otherwise(_third(F.col("ts"))).alias("landing"),
    )
    place = work_path(spark, "answered")
    asked = _landings(spark, requests, _third(F.col("requested_at")), "requests")
    for (_, request_stream), (_, response_stream) in zip(asked, _landings(spark, responses, F.col("landing"), "responses")):
        answers = incremental.answered_requests(request_stream.drop("number"), response_stream.drop("landing"), "run-1")
        out = incremental.drain(answers, "answered", place=place, state_partitions=_STATE_PARTITIONS)
    late = incremental.late_responses(responses, out).select("example_id", F.lit(True).alias("late_response"))
    waiting = incremental.waiting_requests(requests, out).select(
        "example_id", F.lit("waiting").alias("status"), none.alias("response_text"), F.lit(None).cast("double").alias("latency_ms"), "error_type"
    )
    columns = ("example_id", "status", "response_text", "latency_ms", "error_type")
    told = out.select(*columns).unionByName(waiting).join(late, "example_id", "left")
    return told.withColumn("late_response", F.coalesce("late_response", F.lit(False)))


@query(
    f"""WITH {SCORED} SELECT CAST(example_id AS VARCHAR) AS example_id, dataset AS dataset_name,
    CASE WHEN prediction_status = 'success' THEN 'scored' ELSE 'prediction_error' END AS status, {_IF_OK}
    FROM metric"""
)
def scores_over_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses and their cases land in three parts. Every run goes on from the last one and reads the
    cases that are committed by then; what is scored is not scored again."""
    matched = matched_responses(spark, sf_dir)
    keys = ("dataset_name", "example_id")
    number = F.pmod(F.xxhash64("example_id"), F.lit(3)) + 1
    cases = CommittedTable(spark, work_path(spark, "cases"))
    parts = matched.select(*keys, "reference", "answerable", "row_ordinal")
    landed = matched.drop("reference", "answerable", "row_ordinal")
    place = work_path(spark, "landed-scores")
    for landing, stream in _landings(spark, landed, number, "landed"):
        cases.append(lambda folder: parts.filter(number == landing).write.parquet(folder))
        known = cases.read(incremental.columns_of(parts))
        scores = incremental.drain(incremental.score_stream(stream, known, "row_ordinal"), "landed-scores", place=place)
    return scores.select(
        "example_id",
        "dataset_name",
        "status",
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in METRIC_COLUMNS],
    )
