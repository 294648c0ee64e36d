"""Scores of one prediction against its references, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.functions.extract import last_number
from tallyframe.functions.normalize import (
    normalize_answer,
    normalize_label,
    normalize_latex,
    tokenize,
)
from tallyframe.functions.text import canonical_source, let, lookup, strip, text_or_empty


def numbered_tokens(tokens: Column) -> Column:
    """Tokens made distinct by their occurrence number, in n log n steps.

    The multiset overlap of two token lists then is a plain set intersection, which Spark
    hashes. That keeps whole documents affordable where counting each token in the other list
    would be quadratic.
    """

    def number(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1)),
        )
        return let(starts, lambda firsts: spread(ordered, firsts))

    def spread(ordered: Column, firsts: Column) -> Column:
        def copies(first: Column, run: Column) -> Column:
            length = F.coalesce(F.get(firsts, run + 1), F.size(ordered)) - first
            token = F.get(ordered, first)
            numbered = F.transform(
                F.sequence(F.lit(1), length),
                lambda n: F.concat(token, F.lit(" "), n.cast("string")),
            )
            return F.when(length == 1, F.array(F.concat(token, F.lit(" 1")))).otherwise(numbered)

        return F.flatten(F.transform(firsts, copies))

    empty = F.array().cast("array<string>")
    return F.when(F.size(tokens) == 0, empty).otherwise(let(F.sort_array(tokens), number))


def f1_of_numbered(predicted: Column, reference: Column) -> Column:
    """Token F1 from two ``numbered_tokens`` columns."""
    n_predicted = F.size(predicted)
    n_reference = F.size(reference)

    def score(overlap: Column) -> Column:
        precision = overlap / n_predicted
        recall = overlap / n_reference
        return F.when(overlap == 0, 0.0).otherwise(
            F.lit(2.0) * precision * recall / (precision + recall)
        )

    return (
        F.when((n_predicted == 0) & (n_reference == 0), 1.0)
        .when((n_predicted == 0) | (n_reference == 0), 0.0)
        .otherwise(let(F.size(F.array_intersect(predicted, reference)).cast("double"), score))
    )


def _numbered_words(value: Column) -> Column:
    return let(tokenize(value), numbered_tokens)


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalize_answer(prediction) == normalize_answer(reference)).cast("double")


def exact_match_multi(prediction: Column, references: Column) -> Column:
    """Best exact match over an array of references; 0 without references."""
    return let(
        normalize_answer(prediction),
        lambda wanted: F.coalesce(
            F.exists(references, lambda ref: normalize_answer(ref) == wanted), F.lit(False)
        ).cast("double"),
    )


def token_f1(prediction: Column, reference: Column) -> Column:
    return let(
        _numbered_words(prediction),
        lambda words: let(_numbered_words(reference), lambda ref: f1_of_numbered(words, ref)),
    )


def token_f1_multi(prediction: Column, references: Column) -> Column:
    """Best token F1 over an array of references; 0 without references."""
    return let(
        _numbered_words(prediction),
        lambda words: F.coalesce(
            F.array_max(
                F.transform(
                    references,
                    lambda ref: let(_numbered_words(ref), lambda r: f1_of_numbered(words, r)),
                )
            ),
            F.lit(0.0),
        ),
    )


def label_accuracy(prediction: Column, reference: Column) -> Column:
    return (normalize_label(prediction) == normalize_label(reference)).cast("double")


def math_exact_match(prediction: Column, reference: Column) -> Column:
    predicted = normalize_latex(prediction)
    return ((predicted != "") & (predicted == normalize_latex(reference))).cast("double")


def parse_number(value: Column) -> Column:
    """A fraction, a plain number, or the last number in the text; null when none."""
    text = F.replace(strip(text_or_empty(value)), F.lit(","), F.lit(""))
    space = f"[{fv.SPACE}]*"
    fraction = rf"\A([-+]?\d+){space}/{space}(\d+)\z"
    plain = (
        r"\A[-+]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)"
        r"(?:[eE][-+]?\d+(?:_\d+)*)?\z"
    )
    named = r"(?i)\A[-+]?(?:inf|infinity|nan)\z"

    def number(candidate: Column) -> Column:
        top = F.regexp_extract(candidate, fraction, 1).try_cast("double")
        bottom = F.regexp_extract(candidate, fraction, 2).try_cast("double")
        signless = F.regexp_replace(candidate, r"\A[-+]", "")
        return (
            F.when(candidate.rlike(fraction), F.try_divide(top, bottom))
            .when(
                candidate.rlike(plain),
                F.replace(candidate, F.lit("_"), F.lit("")).try_cast("double"),
            )
            .when(
                candidate.rlike(named),
                F.when(F.lower(signless) == "nan", F.lit(float("nan"))).otherwise(
                    candidate.try_cast("double")
                ),
            )
            .otherwise(last_number(candidate).try_cast("double"))
        )

    return let(text, number)


def numeric_accuracy(
    prediction: Column, reference: Column, rel_tol: float = 0.01, abs_tol: float = 1e-6
) -> Column:
    """1 when both texts hold numbers within the relative or absolute tolerance."""

    def close(pair: Column) -> Column:
        left, right = pair["p"], pair["r"]
        infinite = F.abs(left).isin(float("inf")) | F.abs(right).isin(float("inf"))
        gap = F.abs(left - right)
        bound = F.greatest(
            F.lit(rel_tol) * F.abs(left), F.lit(rel_tol) * F.abs(right), F.lit(abs_tol)
        )
        return (
            F.when(left.isNull() | right.isNull() | F.isnan(left) | F.isnan(right), 0.0)
            .when(left == right, 1.0)
            .when(infinite, 0.0)
            .otherwise((gap <= bound).cast("double"))
        )

    return let(
        F.struct(parse_number(prediction).alias("p"), parse_number(reference).alias("r")), close
    )


def pass_at_k(n: Column, passed: Column, k: int) -> Column:
    """Unbiased chance that one of k drawn samples passes, from n samples with ``passed`` good."""
    missed = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, i: acc * F.try_divide((n - passed - i).cast("double"), n - i),
    )
    return F.when(n - passed < k, 1.0).otherwise(F.lit(1.0) - missed)


def primary_metric(dataset: Column) -> Column:
    """Name of the metric a dataset is ranked by."""
    return lookup(fv.PRIMARY_METRIC, canonical_source(dataset))


def council_metric_name(dataset: Column) -> Column:
    return lookup(fv.COUNCIL_METRIC_NAME, canonical_source(dataset))
