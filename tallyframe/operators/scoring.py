"""Scoring of predictions by dataset profile."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import extract, metrics
from tallyframe.functions import fixed_values as fv
from tallyframe.functions.json_fields import gold_answers
from tallyframe.functions.normalize import tokenize
from tallyframe.functions.text import canonical_source, let, lookup, strip, text_or_empty
from tallyframe.operators.cases import CASE_BUILDERS
from tallyframe.operators.records import latest

METRIC_MAP = "map<string,double>"


@dataclass(frozen=True)
class Profile:
    """How one dataset builds cases, reads answers and scores them.

    ``metrics`` takes the extracted answer and the reference struct and gives a Column per metric
    name. The built-in profiles leave it out, as theirs are computed together.
    """

    name: str
    metric_names: tuple[str, ...]
    primary_metric: str
    cases: Callable[..., DataFrame]
    extract: Callable[[Column], Column]
    metrics: Callable[[Column, Column], dict[str, Column]] | None = None


PROFILES = {
    name: Profile(
        name,
        fv.METRIC_NAMES[name],
        fv.PRIMARY_METRIC[name],
        CASE_BUILDERS[name],
        extract.PROFILE_EXTRACTORS[name],
    )
    for name in fv.DATASETS
}


def get_profile(name: str) -> Profile:
    key = name.strip().lower()
    if key not in PROFILES:
        raise ValueError(
            f"Unsupported dataset profile '{name}'. Expected one of: {', '.join(sorted(PROFILES))}"
        )
    return PROFILES[key]


def list_profiles() -> tuple[str, ...]:
    return tuple(sorted(PROFILES))


def with_test_outcomes(
    predictions: DataFrame,
    outcomes: DataFrame,
    keys: Sequence[str] = ("example_id", "model"),
    order: str = "row_ordinal",
) -> DataFrame:
    """Add ``exit_code`` of the last test run of each answer; null when it was never run."""
    last = latest(outcomes, keys, order, ["exit_code"])
    return predictions.join(last, list(keys), "left")


def passed(code: Column, exit_code: Column) -> Column:
    """1 when the answer's tests ended with exit code 0; blank code or no run scores 0."""
    ran_clean = F.coalesce(exit_code == 0, F.lit(False))
    return ((strip(text_or_empty(code)) != "") & ran_clean).cast("double")


def answer_program(code: Column, test_code: Column, entry_point: Column) -> Column:
    """Program text that runs an answer against its tests."""
    return F.concat(
        F.lit("\n" + fv.TEST_PROGRAM_IMPORTS + "\n\n"),
        code,
        F.lit("\n\n"),
        test_code,
        F.lit('\n\nif __name__ == "__main__":\n    check('),
        entry_point,
        F.lit(")\n"),
    )


def _with_answer_scores(df: DataFrame, applies: Column) -> DataFrame:
    """Add ``_em`` and ``_f1`` of ``extracted_answer`` against ``_references``.

    Each normalisation is its own projection step, so that it is computed once per row.
    """
    none = F.array().cast("array<string>")
    word_lists = F.transform(F.coalesce("_references", none), tokenize)
    answer = F.col("_words")
    return (
        df.withColumn("_words", F.when(applies, tokenize(F.col("extracted_answer"))))
        .withColumn("_word_lists", F.when(applies, word_lists))
        .withColumn("_numbered", metrics.numbered_tokens(answer))
        .withColumn(
            "_em",
            F.coalesce(F.array_contains("_word_lists", answer), F.lit(False)).cast("double"),
        )
        .withColumn(
            "_f1",
            F.coalesce(
                F.array_max(
                    F.transform(
                        "_word_lists",
                        lambda ref: let(
                            metrics.numbered_tokens(ref),
                            lambda numbered: metrics.f1_of_numbered(
                                F.col("_numbered"), numbered
                            ),
                        ),
                    )
                ),
                F.lit(0.0),
            ),
        )
        .drop("_words", "_word_lists", "_numbered")
    )


def _metric_map(**values: Column) -> Column:
    return F.create_map(
        *[item for name, value in values.items() for item in (F.lit(name), value.cast("double"))]
    )


def score_suite(
    matched: DataFrame,
    suite_id: str = "suite",
    metric: Callable[[DataFrame, str], DataFrame] | None = None,
) -> DataFrame:
    """Score records of a suite by any scorer of (matched, suite_id), the profiles by default."""
    return (metric or score_predictions)(matched, suite_id)


def score_predictions(
    matched: DataFrame,
    suite_id: str = "suite",
    ruleset: str = "profile",
    profiles: Sequence[Profile] = (),
) -> DataFrame:
    """Score record per prediction. ``profiles`` adds datasets or replaces built-in ones.

    ``matched`` holds predictions with their case: ``dataset_name, model, example_id, status,
    response_text, reference, answerable`` and, for code, ``exit_code``. ``ruleset='doc'``
    selects the documented scorer variant (substring labels, choice letters, numeric math).
    """
    loose = ruleset == "doc"
    ok = F.col("status") == "success"
    dataset = F.col("dataset_name")
    rules = extract.LOOSE_EXTRACTORS if loose else extract.PROFILE_EXTRACTORS
    rules = rules | {p.name: p.extract for p in profiles}
    exit_code = F.col("exit_code") if "exit_code" in matched.columns else F.lit(None)
    extracted = extract.extract_answer(
        text_or_empty(F.col("response_text")), F.when(ok, dataset), rules, unknown="null"
    )
    answerable = F.coalesce(F.col("answerable"), F.lit(False))
    references = F.col("reference.answers")
    if not loose:
        unanswerable = (dataset == "musique") & ~answerable
        references = F.when(unanswerable, F.array(F.lit(fv.NOT_PRESENT))).otherwise(references)
    staged = matched.withColumn("extracted_answer", extracted).withColumn(
        "_references", references
    )
    staged = _with_answer_scores(staged, dataset.isin("musique", "quality"))
    answer = F.col("extracted_answer")
    qa = {"exact_match": F.col("_em"), "token_f1": F.col("_f1")}
    multihop = dict(qa)
    if not loose:
        multihop["false_negative"] = answerable & (answer == fv.NOT_PRESENT)
        multihop["answerable"] = answerable
    if loose:
        math = _metric_map(
            numeric_accuracy=metrics.numeric_accuracy(answer, F.col("reference.answer"))
        )
    else:
        math = _metric_map(
            math_exact_match=metrics.math_exact_match(answer, F.col("reference.answer"))
        )
    scored = F.when(F.lit(False), F.lit(None).cast(METRIC_MAP))
    for profile in profiles:
        own = _metric_map(**profile.metrics(answer, F.col("reference")))
        scored = scored.when(dataset == profile.name, own)
    scored = (
        scored.when(dataset == "musique", _metric_map(**multihop))
        .when(dataset == "quality", _metric_map(**qa))
        .when(
            dataset == "fever",
            _metric_map(label_accuracy=metrics.label_accuracy(answer, F.col("reference.label"))),
        )
        .when(dataset == "hardmath", math)
        .when(dataset == "humaneval_plus", _metric_map(pass_at_1=passed(answer, exit_code)))
    )
    known = (*fv.DATASETS, *[p.name for p in profiles])
    unknown = ~F.coalesce(dataset.isin(*known), F.lit(False))
    named = {p.name: p.primary_metric for p in profiles}
    return score_records(staged.withColumn("metrics", F.when(ok, scored)), suite_id, unknown, named)


def score_records(
    df: DataFrame,
    suite_id: str,
    metric_failed: Column | None = None,
    metric_names: dict[str, str] | None = None,
) -> DataFrame:
    """Three-way status from a prediction status and a metric map that may be null.

    ``metric_failed`` replaces the null test where it is known from cheaper columns, so that a
    filter on the status reaches the scan without dragging the scoring along.
    """
    ok = F.col("status") == "success"
    failed_metric = F.col("metrics").isNull() if metric_failed is None else metric_failed
    status = (
        F.when(~F.coalesce(ok, F.lit(False)), "prediction_error")
        .when(failed_metric, "metric_error")
        .otherwise("scored")
    )

    def given(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    failed = F.nullif(given("error_type"), F.lit(""))
    reason = F.nullif(given("error_message"), F.lit(""))
    unknown = F.concat(F.lit("Unknown dataset: "), F.col("dataset_name"))
    metric_name = metrics.primary_metric(F.col("dataset_name"))
    if metric_names:
        metric_name = F.coalesce(lookup(metric_names, F.col("dataset_name")), metric_name)
    staged = df.withColumn("_status", status)
    is_prediction_error = F.col("_status") == "prediction_error"
    is_metric_error = F.col("_status") == "metric_error"
    return staged.select(
        F.lit(suite_id).alias("suite_id"),
        "dataset_name",
        "model",
        "example_id",
        F.col("_status").alias("status"),
        F.coalesce("status", F.lit("unknown")).alias("prediction_status"),
        F.when(F.col("_status") == "scored", F.col("metrics")).alias("metrics"),
        metric_name.alias("metric_name"),
        given("extracted_answer").alias("extracted_answer"),
        F.when(is_prediction_error, F.coalesce(failed, F.lit("PredictionError")))
        .when(is_metric_error, F.coalesce(failed, F.lit("ValueError")))
        .alias("error_type"),
        F.when(is_prediction_error, F.coalesce(reason, F.lit("prediction failed")))
        .when(is_metric_error, F.coalesce(reason, unknown))
        .alias("error_message"),
    )


def null_metric(matched: DataFrame, suite_id: str = "suite") -> DataFrame:
    """Score records with an empty metric map, for runs without a metric."""
    empty = F.create_map().cast(METRIC_MAP)
    return score_records(matched.withColumn("metrics", empty), suite_id)


def custom_metric(score: Callable[[str, str], dict[str, float]]):
    """A metric Spark has no expression for, as an Arrow-batched UDF.

    ``score`` takes prediction and reference text. What it raises becomes the row's error.
    """

    @F.pandas_udf(f"metrics {METRIC_MAP}, error_type string, error_message string")
    def run(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gold in zip(prediction, reference):
            try:
                rows.append((dict(score(text, gold)), None, None))
            except Exception as error:  # noqa: BLE001 - a failing metric is data
                rows.append((None, type(error).__name__, str(error)))
        return pd.DataFrame(rows, columns=["metrics", "error_type", "error_message"])

    return run


def score_with_metric(
    matched: DataFrame, metric, reference: Column, suite_id: str = "suite"
) -> DataFrame:
    """Score records from a ``custom_metric``; only successful predictions reach it."""
    ok = F.col("status") == "success"
    result = metric(F.when(ok, F.col("response_text")), F.when(ok, reference))
    staged = matched.withColumn("_result", result).withColumn(
        "metrics", F.when(ok, F.col("_result.metrics"))
    )
    for name in ("error_type", "error_message"):
        before = F.col(name) if name in matched.columns else F.lit(None).cast("string")
        staged = staged.withColumn(name, F.when(ok, F.col(f"_result.{name}")).otherwise(before))
    return score_records(staged, suite_id)


def score_council_texts(df: DataFrame) -> DataFrame:
    """Scores of synthesised texts against council row metadata.

    Needs ``synthesized_text`` and ``row_metadata`` and, for code, ``exit_code``. Adds
    ``metric_name, primary_metric, metrics, extracted_answer``.
    """
    source = canonical_source(F.col("row_metadata.source_dataset"))
    exit_code = F.col("exit_code") if "exit_code" in df.columns else F.lit(None)
    answerable = F.coalesce(F.col("row_metadata.answerable"), F.lit(False))
    gold = gold_answers(F.col("row_metadata.gold_answer"), F.col("_source"))
    references = F.when(
        (F.col("_source") == "musique") & ~answerable, F.array(F.lit(fv.NOT_PRESENT))
    ).otherwise(gold)
    staged = (
        df.withColumn("_source", source)
        .withColumn("_clean", extract.strip_reasoning(F.col("synthesized_text")))
        .withColumn(
            "extracted_answer",
            extract.extract_answer(
                F.col("_clean"), F.col("_source"), extract.PROFILE_EXTRACTORS, unknown="null"
            ),
        )
        .withColumn("_references", references)
    )
    staged = _with_answer_scores(staged, F.col("_source").isin("musique", "quality"))
    answer = F.col("extracted_answer")
    label = text_or_empty(F.col("row_metadata.gold_label"))
    math_gold = text_or_empty(F.col("row_metadata.gold_answer"))
    values = (
        F.when(
            F.col("_source").isin("musique", "quality"),
            _metric_map(exact_match=F.col("_em"), token_f1=F.col("_f1")),
        )
        .when(
            F.col("_source") == "fever",
            _metric_map(label_accuracy=metrics.label_accuracy(answer, label)),
        )
        .when(
            F.col("_source") == "hardmath",
            _metric_map(math_exact_match=metrics.math_exact_match(answer, math_gold)),
        )
        .otherwise(_metric_map(pass_at_1=passed(answer, exit_code)))
    )
    return (
        staged.withColumn("metric_name", metrics.council_metric_name(F.col("_source")))
        .withColumn("primary_metric", metrics.primary_metric(F.col("_source")))
        .withColumn("metrics", values)
        .drop("_source", "_clean", "_references", "_em", "_f1")
    )


def pass_at_k_by_example(
    outcomes: DataFrame, k: int, keys: Sequence[str] = ("example_id",)
) -> DataFrame:
    """Samples, passes and pass@k per example from a table of test outcomes."""
    counted = outcomes.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("exit_code") == 0).alias("n_passed"),
    )
    return counted.withColumn(
        "pass_at_k", metrics.pass_at_k(F.col("n_samples"), F.col("n_passed"), k)
    )
