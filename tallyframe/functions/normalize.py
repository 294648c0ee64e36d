"""Normalised forms that answers are compared in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.functions.text import let, lookup, strip, text_or_empty

_ARTICLE = rf"(?<![{fv.WORD}])(?:{'|'.join(fv.ARTICLES)})(?![{fv.WORD}])"


def tokenize(value: Column) -> Column:
    """Words of an answer: lower case, no ASCII punctuation, no articles.

    In plain letters, digits and blanks an article is a word of its own and drops out with the
    words. Only other texts need the pattern that looks at what surrounds an article.
    """

    def without_articles(bare: Column) -> Column:
        return F.when(
            bare.rlike(r"[^ -~\p{L}\p{N}]"), F.regexp_replace(bare, _ARTICLE, " ")
        ).otherwise(bare)

    # One pass: white space becomes a blank, punctuation has no counterpart and goes.
    bare = F.translate(
        F.lower(text_or_empty(value)),
        fv.SPACE_CHARS + fv.ASCII_PUNCTUATION,
        " " * len(fv.SPACE_CHARS),
    )
    words = F.split(let(bare, without_articles), " ")
    return F.filter(words, lambda word: ~word.isin("", *fv.ARTICLES))


def normalize_answer(value: Column) -> Column:
    """The words of an answer with single blanks between them."""
    return F.array_join(tokenize(value), " ")


def normalize_label(value: Column) -> Column:
    """Fact-check label through the alias table, other texts in upper case."""
    key = F.lower(strip(text_or_empty(value)))
    return F.coalesce(lookup(fv.LABEL_ALIASES, key), F.upper(key))


def normalize_latex(value: Column) -> Column:
    r"""No white space, no ``\left``/``\right``, one outer pair of braces removed."""
    bare = F.regexp_replace(
        text_or_empty(value), rf"[{fv.SPACE}]+", ""
    )
    bare = F.replace(F.replace(bare, F.lit("\\left"), F.lit("")), F.lit("\\right"), F.lit(""))
    return F.regexp_replace(bare, r"(?s)\A\{(.*)\}\z", "$1")
