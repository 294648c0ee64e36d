"""Text building blocks as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Plain composition would paste the expression at each use; a one-element ``transform``
    binds it to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(value: Column) -> Column:
    """Null-safe text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    """Cut Unicode white space at both ends (plain ``trim`` only knows the blank)."""
    return F.btrim(value, F.lit(fv.SPACE_CHARS))


def unify_line_breaks(value: Column) -> Column:
    r"""Turn every line break Python's ``splitlines`` knows into ``\n``."""
    return F.regexp_replace(value, fv.OTHER_LINE_BREAK, "\n")


def matched(value: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern whose group is never empty on a match; null when none."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def fill(template: str, **columns: Column) -> Column:
    """Put columns into the named slots of a fixed text."""
    parts = re.split(r"\{(" + "|".join(columns) + r")\}", template)
    pieces = [
        columns[part] if index % 2 else F.lit(part)
        for index, part in enumerate(parts)
        if index % 2 or part
    ]
    return F.concat(*pieces)


def slug(value: Column) -> Column:
    """File-name-safe form of a name."""
    cleaned = F.regexp_replace(strip(value), r"[^A-Za-z0-9._-]+", "_")
    trimmed = F.regexp_replace(cleaned, r"\A_+|_+\z", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("value"))


def pair_name(dataset: Column, model: Column) -> Column:
    """Name shared by the files of one dataset and model."""
    return F.concat_ws("__", slug(dataset), slug(model))


def stable_id(source: Column, original_id: Column) -> Column:
    """Twelve hex digits derived from source and original id."""
    return F.substring(F.md5(F.concat_ws("_", source, original_id.cast("string"))), 1, 12)


def canonical_source(value: Column) -> Column:
    """Dataset key from a free-form source name; anything unknown is the code task."""
    name = F.lower(strip(text_or_empty(value)))
    return (
        F.when(name.contains("musique"), "musique")
        .when(name.contains("quality") | name.contains("narrativeqa"), "quality")
        .when(name.contains("fever"), "fever")
        .when(name.contains("math"), "hardmath")
        .otherwise("humaneval_plus")
    )


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, null for unknown keys."""
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), key)
