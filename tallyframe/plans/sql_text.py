"""DuckDB spellings used by several check statements."""

from __future__ import annotations

SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def words(text: str) -> str:
    """Normalised words of an answer."""
    bare = rf"regexp_replace(lower({text}), '[!-/:-@\[-`{{-~]', '', 'g')"
    return (
        f"list_filter(regexp_split_to_array({bare}, '{SPACES}+'), "
        f"lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"
    )


def normalized(text: str) -> str:
    return f"array_to_string({words(text)}, ' ')"


def shuffle_key(key: str, seed: int = 42) -> str:
    return f"(md5('{seed}_' || CAST({key} AS VARCHAR)) || '_' || CAST({key} AS VARCHAR))"


def f1(overlap: str, n_left: str, n_right: str) -> str:
    precision = f"(CAST({overlap} AS DOUBLE) / {n_left})"
    recall = f"(CAST({overlap} AS DOUBLE) / {n_right})"
    return (
        f"CASE WHEN {n_left} = 0 AND {n_right} = 0 THEN CAST(1 AS DOUBLE) "
        f"WHEN {overlap} = 0 THEN CAST(0 AS DOUBLE) "
        f"ELSE round(CAST(2 AS DOUBLE) * {precision} * {recall} / ({precision} + {recall}), 6) END"
    )


def text(value: str) -> str:
    """A Python text as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, **slots: str) -> str:
    """A fixed prompt text with SQL expressions in its slots."""
    import re

    parts = re.split(r"\{(" + "|".join(slots) + r")\}", template)
    pieces = [
        slots[part] if index % 2 else text(part)
        for index, part in enumerate(parts)
        if index % 2 or part
    ]
    return "(" + " || ".join(pieces) + ")"


def label(value: str) -> str:
    """Alias table of fact-check labels."""
    from tallyframe.functions.fixed_values import LABEL_ALIASES

    branches = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_ALIASES.items())
    key = f"lower({strip(value)})"
    return f"CASE {key} {branches} ELSE upper({key}) END"
