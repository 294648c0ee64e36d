"""JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import let

METADATA = "struct<answerable:boolean,entry_point:string>"
# A list of dicts printed by Python reads as JSON once stray escapes are allowed.
_LENIENT = {"allowBackslashEscapingAnyCharacter": "true"}


def parse_metadata(value: Column) -> Column:
    """Known metadata fields of a JSON object; null fields for anything else."""
    return let(
        F.from_json(value, METADATA),
        lambda parsed: F.struct(
            parsed["answerable"].alias("answerable"), parsed["entry_point"].alias("entry_point")
        ),
    )


def _python_list_as_json(raw: Column) -> Column:
    r"""Spell Python's ``\xNN`` escapes and bare constants the way JSON does."""
    text = F.regexp_replace(raw, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, rf"(?<=[\[{{,:]\s?){python}(?=\s*[,\]}}])", json)
    return text


def gold_answers(raw: Column, source: Column) -> Column:
    """Reference answers: narrative answers may be a printed list of texts or dicts."""
    listed = _python_list_as_json(raw)
    dicts = F.from_json(listed, "array<struct<text:string>>", _LENIENT)
    texts = F.filter(F.transform(dicts, lambda d: d["text"]), lambda t: t.isNotNull())
    strings = F.from_json(listed, "array<string>", _LENIENT)
    is_list = raw.rlike(r"^\s*\[")
    found = F.when(is_list & (F.size(texts) > 0), texts).when(
        is_list & (F.size(strings) > 0), strings
    )
    return (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when((source == "quality") & found.isNotNull(), found)
        .otherwise(F.array(raw))
    )
