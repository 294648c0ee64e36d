"""Three-model councils: answers, ballots, majority, synthesis, roll-up rows.

Calls arrive as one long table (``schemas.COUNCIL_CALL``): one row per example, phase (answer or
vote) and role. Everything per example is one aggregation whose buffers hold the last call of
each role, so repeated calls shrink on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.functions.extract import clean_answer
from tallyframe.functions.metrics import council_metric_name
from tallyframe.functions.prompts import four_answer_prompt, synthesis_prompt, vote_prompt
from tallyframe.functions.text import canonical_source, matched, strip, text_or_empty
from tallyframe.operators.records import add_known, last_by, latest, sum_known

CALL_FIELDS = (
    "model",
    "status",
    "text",
    "latency_ms",
    "input_tokens",
    "output_tokens",
    "total_tokens",
    "error_type",
    "error_message",
)
USAGE_FIELDS = ("input_tokens", "output_tokens", "total_tokens")


def parse_vote(text: Column) -> Column:
    """First standalone A, B or C of a ballot in upper case; A when there is none."""
    upper = F.upper(strip(text_or_empty(text)))
    return F.coalesce(matched(upper, rf"(?<![{fv.WORD}])([ABC])(?![{fv.WORD}])"), F.lit("A"))


def majority(votes: Column) -> Column:
    """Most frequent label of an array of votes; ties go to the lowest label."""
    tally = F.transform(
        F.array_distinct(votes),
        lambda label: F.struct(
            (-F.size(F.filter(votes, lambda v: v == label))).alias("n"), label.alias("label")
        ),
    )
    return F.array_min(tally)["label"]


def calls_by_role(calls: DataFrame, phases: Sequence[str] = ("answer", "vote")) -> DataFrame:
    """One row per example with the last call of each phase and role as a struct column."""
    call = F.struct(*[F.col(name) for name in CALL_FIELDS])
    columns = []
    for phase in phases:
        for role in fv.ROLES:
            mine = (F.col("phase") == phase) & (F.col("role") == role)
            columns.append(last_by(call, F.col("row_ordinal"), mine).alias(f"{phase}_{role}"))
    return calls.groupBy("example_id").agg(*columns)


def _succeeded(call: str) -> Column:
    return F.coalesce(F.col(f"{call}.status") == "success", F.lit(False))


def labelled_answers(wide: DataFrame, cleaned: bool = True) -> DataFrame:
    """Answers under their neutral labels; a failed or missing call gives an empty answer."""
    shape = clean_answer if cleaned else (lambda text: strip(text_or_empty(text)))
    columns = {}
    for role, label in fv.ROLE_TO_LABEL.items():
        text = F.when(_succeeded(f"answer_{role}"), F.col(f"answer_{role}.text"))
        columns[f"answer_{label.lower()}"] = shape(text)
    return wide.withColumns(columns)


def label_map() -> Column:
    """Label → answer map from the labelled columns."""
    return F.create_map(
        *[item for label in fv.LABELS for item in (F.lit(label), F.col(f"answer_{label.lower()}"))]
    )


def with_ballot(df: DataFrame, question: str = "question") -> DataFrame:
    return df.withColumn("vote_prompt", vote_prompt(F.col(question), label_map()))


def by_label(label: Column, values: dict[str, Column]) -> Column:
    result = None
    for name, value in values.items():
        hit = label == name
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result


def _usage(calls: Sequence[str]) -> Column:
    return F.struct(
        *[add_known(*[F.col(f"{c}.{f}") for c in calls]).cast("bigint").alias(f) for f in USAGE_FIELDS]
    )


def _latency(calls: Sequence[str]) -> Column:
    return sum_known(F.array(*[F.col(f"{c}.latency_ms") for c in calls]))


def decide(calls: DataFrame, cleaned: bool = True) -> DataFrame:
    """Council decision per example: labelled answers, votes, winner, usage and latency sums."""
    wide = labelled_answers(calls_by_role(calls), cleaned)
    votes = {
        role: F.when(_succeeded(f"vote_{role}"), parse_vote(F.col(f"vote_{role}.text"))).otherwise(
            "A"
        )
        for role in fv.ROLES
    }
    voted = wide.withColumns({f"voted_{role}": vote for role, vote in votes.items()})
    won = voted.withColumn(
        "winning_label", majority(F.array(*[F.col(f"voted_{role}") for role in fv.ROLES]))
    )
    label = F.col("winning_label")
    label_to_role = {label: role for role, label in fv.ROLE_TO_LABEL.items()}
    answer_calls = [f"answer_{role}" for role in fv.ROLES]
    vote_calls = [f"vote_{role}" for role in fv.ROLES]
    return won.withColumns(
        {
            "winning_role": by_label(label, {x: F.lit(r) for x, r in label_to_role.items()}),
            "winning_model": by_label(
                label, {x: F.col(f"answer_{r}.model") for x, r in label_to_role.items()}
            ),
            "winning_answer": by_label(
                label, {x: F.col(f"answer_{x.lower()}") for x in fv.LABELS}
            ),
            "votes": F.create_map(
                *[v for role in fv.ROLES for v in (F.lit(role), F.col(f"voted_{role}"))]
            ),
            "candidate_answers": label_map(),
            "answer_usage": _usage(answer_calls),
            "vote_usage": _usage(vote_calls),
            "specialist_usage": _usage(answer_calls + vote_calls),
            "answer_latency_ms_total": _latency(answer_calls),
            "vote_latency_ms_total": _latency(vote_calls),
            "specialist_latency_ms_total": _latency(answer_calls + vote_calls),
        }
    )


def other_answers(df: DataFrame) -> Column:
    """Non-empty answers that did not win, in role order."""
    candidates = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.col(f"answer_{label.lower()}").alias("text"))
            for role, label in fv.ROLE_TO_LABEL.items()
        ]
    )
    kept = F.filter(
        candidates, lambda c: (c["role"] != F.col("winning_role")) & (c["text"] != "")
    )
    return F.transform(kept, lambda c: c["text"])


def batch_results(decisions: DataFrame, dataset_name: str) -> DataFrame:
    """Outcome rows of the two-phase council without a synthesiser."""
    return decisions.select(
        "example_id",
        F.lit(dataset_name).alias("dataset_name"),
        F.col("winning_answer").alias("output"),
        F.lit("success").alias("status"),
        "answer_a",
        "answer_b",
        "answer_c",
        "votes",
        "winning_label",
        "candidate_answers",
    )


def results_as_predictions(
    results: DataFrame, run_id: str, model: str = fv.COUNCIL_MODEL, prompt_version: str = "v1"
) -> DataFrame:
    """Council outcomes in prediction shape; the text is kept on success only."""

    def given(name: str, kind: str) -> Column:
        column = F.col(name) if name in results.columns else F.lit(None)
        return column.cast(kind).alias(name)

    return results.select(
        F.lit(run_id).alias("run_id"),
        "dataset_name",
        F.lit(model).alias("model"),
        "example_id",
        "status",
        F.lit(prompt_version).alias("prompt_version"),
        F.when(F.col("status") == "success", F.col("output")).alias("response_text"),
        given("latency_ms", "double"),
        F.struct(
            *[F.col(name) for name in ("votes", "winning_label", "candidate_answers")]
        ).alias("response_metadata"),
        given("error_type", "string"),
        given("error_message", "string"),
    )


def synthesis_requests(specialist: DataFrame) -> DataFrame:
    """Prompt of the synthesiser for each successful decision with ``row_metadata``."""
    return specialist.withColumn(
        "synthesis_prompt",
        synthesis_prompt(
            F.col("row_metadata.source_dataset"),
            F.col("row_metadata.question"),
            F.col("request_context"),
            F.col("winning_answer"),
            other_answers(specialist),
        ),
    )


def synthesis_records(
    specialist: DataFrame, responses: DataFrame, order: str = "row_ordinal"
) -> DataFrame:
    """Synthesiser record per successful decision that was answered, success or error.

    ``responses`` has ``example_id, status, text, latency_ms``, token columns, errors and
    ``order``; the last one per example counts.
    """
    last = latest(responses, ["example_id"], order).withColumnsRenamed(
        {
            "status": "_status",
            "text": "_text",
            "model": "synth_model",
            "error_type": "_error_type",
            "error_message": "_error_message",
        }
    )
    ok = F.col("_status") == "success"
    joined = specialist.filter("status = 'success'").join(last, "example_id", "inner")
    return joined.select(
        "example_id",
        "dataset_name",
        canonical_source(F.col("row_metadata.source_dataset")).alias("source_dataset"),
        F.when(ok, "success").otherwise("error").alias("status"),
        council_metric_name(F.col("row_metadata.source_dataset")).alias("metric_name"),
        F.when(ok, strip(text_or_empty(F.col("_text")))).alias("synthesized_text"),
        "row_metadata",
        "winning_answer",
        "winning_role",
        "winning_model",
        F.when(ok, F.col("latency_ms")).alias("latency_ms"),
        F.struct(*[F.when(ok, F.col(f)).alias(f) for f in USAGE_FIELDS]).alias("usage"),
        F.when(~ok, F.coalesce("_error_type", F.lit("Error"))).alias("error_type"),
        F.when(~ok, F.col("_error_message")).alias("error_message"),
        F.col("synth_model").alias("model"),
        order,
    )


def specialist_records(
    requests: DataFrame, decisions: DataFrame, dataset_name: str = "router_dataset"
) -> DataFrame:
    """Decision per requested row; a row without any council call is a specialist error."""
    joined = requests.select(
        "example_id", F.col("context").alias("request_context"), "row_metadata"
    ).join(decisions, "example_id", "left")
    missing = F.col("winning_label").isNull()
    return joined.withColumns(
        {
            "dataset_name": F.lit(dataset_name),
            "status": F.when(missing, "error").otherwise("success"),
            "error_type": F.when(missing, "MissingDecision"),
            "error_message": F.when(missing, "no council call recorded"),
        }
    )


def serialized_decisions(decisions: DataFrame) -> DataFrame:
    """Decision rows with nested structs per role, ready for a JSON sink."""
    roles = F.struct(*[F.col(f"answer_{role}").alias(role) for role in fv.ROLES])
    return decisions.select(
        "example_id",
        "winning_label",
        "winning_role",
        "winning_model",
        "winning_answer",
        "votes",
        F.col("specialist_usage").alias("aggregated_usage"),
        F.struct(
            "answer_usage",
            "vote_usage",
            "specialist_usage",
            "answer_latency_ms_total",
            "vote_latency_ms_total",
            "specialist_latency_ms_total",
        ).alias("system_metrics"),
        F.struct("answer_a", "answer_b", "answer_c", "candidate_answers").alias("metadata"),
        roles.alias("role_results"),
    )


def row_system_metrics(synth_latency: Column, synth_usage: Column) -> Column:
    """Usage and latency of one council row; the final totals leave the synthesiser out."""
    per_role = []
    for role in fv.ROLES:
        call = F.col(f"answer_{role}")
        per_role.append(F.struct(*[call[f].alias(f) for f in USAGE_FIELDS]).alias(f"{role}_usage"))
        per_role.append(call["latency_ms"].alias(f"{role}_latency_ms"))
    return F.struct(
        *per_role,
        F.col("answer_usage").alias("answer_usage_total"),
        F.col("vote_usage").alias("vote_usage_total"),
        F.col("specialist_usage").alias("specialist_usage_total"),
        synth_usage.alias("synthesizer_usage"),
        F.col("specialist_usage").alias("final_row_usage"),
        F.col("answer_latency_ms_total").alias("answer_latency_ms_total"),
        F.col("vote_latency_ms_total").alias("vote_latency_ms_total"),
        F.col("specialist_latency_ms_total").alias("specialist_latency_ms_total"),
        synth_latency.alias("synthesizer_latency_ms"),
        F.col("specialist_latency_ms_total").alias("final_row_latency_ms"),
    )


def _no_synthesis() -> tuple[Column, Column]:
    """Latency and usage of a synthesiser that has not run."""
    usage = "struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>"
    return F.lit(None).cast("double"), F.lit(None).cast(usage)


def _reference(metadata: Column) -> Column:
    """What a council row was scored against."""
    return F.struct(
        metadata["gold_answer"].alias("gold_answer"),
        metadata["gold_label"].alias("gold_label"),
        F.coalesce(metadata["answerable"], F.lit(False)).alias("answerable"),
    )


def council_scores(
    scored_synth: DataFrame,
    specialist: DataFrame,
    run_id: str = "council",
    model: str = fv.COUNCIL_MODEL,
    order: str = "row_ordinal",
) -> DataFrame:
    """Score row per synthesised record plus an error row per failed specialist row.

    ``scored_synth`` are synthesis records with the columns of ``score_council_texts``; usage,
    latency and system metrics come from the specialist side. Ids may repeat: all specialist rows
    of an id share one decision, so its cost is joined once per score row.
    """
    ok = F.col("status") == "success"
    cost = specialist.select(
        "example_id",
        F.col("specialist_usage").alias("usage"),
        F.col("specialist_latency_ms_total").alias("latency_ms"),
        row_system_metrics(*_no_synthesis()).alias("system_metrics"),
    ).dropDuplicates(["example_id"])
    own = scored_synth.withColumn("_synth", F.struct(F.col("latency_ms"), F.col("usage")))
    synth = own.drop("usage", "latency_ms", "model").join(cost, "example_id", "left")
    synth = synth.withColumn(
        "system_metrics",
        F.col("system_metrics")
        .withField("synthesizer_latency_ms", F.col("_synth.latency_ms"))
        .withField("synthesizer_usage", F.col("_synth.usage")),
    )
    primary = F.coalesce(F.try_element_at("metrics", F.col("primary_metric")), F.lit(0.0))

    def row(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select(
            F.lit(run_id).alias("suite_id"),
            "dataset_name",
            F.lit(model).alias("model"),
            "example_id",
            canonical_source(F.col("row_metadata.source_dataset")).alias("source_dataset"),
            *[value.alias(name) for name, value in columns.items()],
            _reference(F.col("row_metadata")).alias("reference"),
            "usage",
            "latency_ms",
            "system_metrics",
            "error_type",
            "error_message",
            order,
        )

    from_synth = row(
        synth,
        status=F.when(ok, "scored").otherwise("error"),
        metric_name=F.col("metric_name"),
        metrics=F.when(ok, F.col("metrics")),
        primary_value=F.when(ok, primary),
        prediction=F.struct(
            F.col("synthesized_text").alias("text"),
            F.col("extracted_answer"),
            F.col("winning_role"),
            F.col("winning_model"),
        ),
    )
    failed = specialist.filter("status <> 'success'").withColumns(
        {
            "usage": F.col("specialist_usage"),
            "latency_ms": F.col("specialist_latency_ms_total"),
            "system_metrics": row_system_metrics(*_no_synthesis()),
            order: F.lit(-1).cast("bigint"),
        }
    )
    from_failed = row(
        failed,
        status=F.lit("error"),
        metric_name=council_metric_name(F.col("row_metadata.source_dataset")),
        metrics=F.lit(None).cast("map<string,double>"),
        primary_value=F.lit(None).cast("double"),
        prediction=F.lit(None).cast(from_synth.schema["prediction"].dataType),
    )
    return from_synth.unionByName(from_failed)


def completed_rows(specialist: DataFrame, synth: DataFrame, order: str = "row_ordinal") -> DataFrame:
    """Cost of each council row that came to its end: the successes of ``council_predictions`` with the
    few columns that totals need."""
    last = latest(synth.select("example_id", order, F.col("status").alias("_status")), ["example_id"], order)
    done = specialist.filter("status = 'success'").join(last.filter("_status = 'success'"), "example_id")
    return done.select(
        canonical_source(F.col("row_metadata.source_dataset")).alias("source_dataset"),
        F.lit("success").alias("status"),
        F.col("specialist_latency_ms_total").alias("latency_ms"),
        F.col("specialist_usage").alias("usage"),
    )


def council_predictions(
    specialist: DataFrame,
    synth: DataFrame,
    scores: DataFrame,
    run_id: str = "council",
    model: str = fv.COUNCIL_MODEL,
    order: str = "row_ordinal",
) -> DataFrame:
    """Final prediction per specialist row with one of four phase outcomes."""
    named = synth.withColumnsRenamed(
        {
            "status": "synth_status",
            "latency_ms": "synth_latency_ms",
            "usage": "synth_usage",
            "error_type": "synth_error_type",
            "error_message": "synth_error_message",
        }
    )
    outcome = (
        "synth_status",
        "synthesized_text",
        "synth_latency_ms",
        "synth_usage",
        "synth_error_type",
        "synth_error_message",
    )
    last_synth = latest(named, ["example_id"], order, outcome)
    last_score = latest(scores, ["example_id"], order, ["primary_value"])
    joined = specialist.join(last_synth, "example_id", "left").join(
        last_score, "example_id", "left"
    )
    failed = F.col("status") != "success"
    missing = ~failed & F.col("synth_status").isNull()
    completed = ~failed & ~missing & (F.col("synth_status") == "success")
    phase = (
        F.when(failed, "specialist_failed")
        .when(missing, "missing_synth_record")
        .when(completed, "completed")
        .otherwise("synthesizer_failed")
    )
    return joined.select(
        F.lit(run_id).alias("run_id"),
        "dataset_name",
        F.lit(model).alias("model"),
        "example_id",
        canonical_source(F.col("row_metadata.source_dataset")).alias("source_dataset"),
        F.when(completed, "success").otherwise("error").alias("status"),
        phase.alias("phase_status"),
        F.when(~failed & ~missing, F.col("synthesized_text")).alias("response_text"),
        F.col("specialist_latency_ms_total").alias("latency_ms"),
        F.col("specialist_usage").alias("usage"),
        "primary_value",
        F.when(failed, F.col("error_type"))
        .when(missing, "MissingSynthRecord")
        .otherwise(F.col("synth_error_type"))
        .alias("error_type"),
        F.when(failed, F.col("error_message"))
        .when(missing, "No synthesizer record produced for successful specialist decision.")
        .otherwise(F.col("synth_error_message"))
        .alias("error_message"),
        row_system_metrics(F.col("synth_latency_ms"), F.col("synth_usage")).alias(
            "system_metrics"
        ),
    )


def client_stats(decisions: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Completed examples, average latency in seconds and token totals of a council client."""
    tokens_in = F.coalesce(F.sum("specialist_usage.input_tokens"), F.lit(0))
    tokens_out = F.coalesce(F.sum("specialist_usage.output_tokens"), F.lit(0))
    return decisions.agg(
        F.count("*").alias("examples_completed"),
        F.coalesce(F.avg(F.col(latency) / 1000), F.lit(0.0)).alias("avg_latency_s"),
        tokens_in.alias("total_input_tokens"),
        tokens_out.alias("total_output_tokens"),
        (tokens_in + tokens_out).alias("total_tokens"),
    )


def four_answer_rows(
    rows: DataFrame, answers: DataFrame, order: str = "row_ordinal"
) -> DataFrame:
    """Rows with the router's and three specialists' answers side by side and the final prompt.

    ``answers`` is long: ``example_id, role`` (router or a council role), ``text`` and ``order``.
    """
    names = {
        "router": "router_response",
        "qa": "model1",
        "reasoning": "model2",
        "general": "model3",
    }
    wide = answers.groupBy("example_id").agg(
        *[
            last_by(F.col("text"), F.col(order), F.col("role") == role).alias(name)
            for role, name in names.items()
        ]
    )
    joined = rows.join(wide, "example_id", "left")
    return joined.withColumn(
        "synth_prompt",
        four_answer_prompt(
            F.col("question"),
            F.col("model1"),
            F.col("model2"),
            F.col("model3"),
            F.col("router_response"),
        ),
    )


def majority_of_answers(
    members: DataFrame,
    keys: Sequence[str] = ("example_id",),
    answer: str = "extracted_answer",
    position: str = "position",
) -> DataFrame:
    """Most frequent extracted answer per example; ties go to the one seen first."""
    counted = members.groupBy(*keys, answer).agg(
        F.count("*").alias("_n"), F.min(position).alias("_first")
    )
    return counted.groupBy(*keys).agg(
        F.max_by(answer, F.struct("_n", (-F.col("_first")).alias("_f"))).alias("council_answer"),
        F.max("_n").alias("council_votes"),
    )


def voting_log(
    members: DataFrame, council: DataFrame, keys: Sequence[str] = ("dataset", "sample_id")
) -> DataFrame:
    """Log entry per sample: the members' answers, raw and extracted, the council's answer, the
    reference and the scores.

    ``members`` has ``keys, model, answer, extracted_answer``, a row per council member, so that a
    sample's list is bounded. ``council`` has ``keys, council_answer, reference, scores``.
    """
    listed = members.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("model", "answer", F.col("extracted_answer").alias("extracted")))
        ).alias("individual_answers")
    )
    return listed.join(council, list(keys)).select(
        *keys, "individual_answers", "council_answer", "reference", "scores"
    )


def best_of_n_code(
    members: DataFrame,
    keys: Sequence[str] = ("example_id",),
    code: str = "code",
    position: str = "position",
) -> DataFrame:
    """First passing program per example, else the first one."""
    passing = F.coalesce(F.col("exit_code") == 0, F.lit(False))
    rank = F.struct((~passing).alias("failed"), F.col(position).alias("at"))
    return members.groupBy(*keys).agg(
        F.min_by(code, rank).alias("council_answer"),
        F.coalesce(F.bool_or(passing), F.lit(False)).alias("any_passed"),
    )
