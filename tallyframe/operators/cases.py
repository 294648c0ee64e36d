"""Evaluation cases and model requests as projections over raw rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import schemas
from tallyframe.functions import fixed_values as fv
from tallyframe.functions.json_fields import parse_metadata
from tallyframe.functions.prompts import resolved_messages, specialist_prompt
from tallyframe.functions.text import canonical_source, fill, strip, text_or_empty
from tallyframe.operators.records import merge_maps


def first_present(df: DataFrame, *names: str, default: object = None) -> Column:
    """First non-null of the columns that exist, else the default."""
    found = [F.col(name) for name in names if name in df.columns]
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(*found, fallback)


def as_list(df: DataFrame, name: str) -> Column:
    """A column as an array: null → empty, scalar → one entry."""
    if name not in df.columns:
        return F.array().cast("array<string>")
    kind = df.schema[name].dataType
    column = F.col(name)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(column, F.array().cast(kind))
    return F.when(column.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(column))


def _text_list(df: DataFrame, name: str) -> Column:
    """Answers as texts; structs give their ``text`` field."""
    kind = df.schema[name].dataType if name in df.columns else T.StringType()
    values = as_list(df, name)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(values, lambda v: v["text"].cast("string"))
    return values.cast("array<string>")


def _first_given(
    df: DataFrame, names: Sequence[str], read: Callable[[DataFrame, str], Column]
) -> Column:
    """What ``read`` makes of the first column that is present and not null in the row."""
    given = [F.when(F.col(n).isNotNull(), read(df, n)) for n in names if n in df.columns]
    return F.coalesce(*given) if given else F.lit(None)


def oracle_context(
    df: DataFrame, name: str, fallback: Column | None = None, leading: int | None = None
) -> Column:
    """Supporting paragraphs joined by blank lines.

    Without supporting ones all paragraphs count, or the first ``leading``. A plain text is cut at
    blank lines.
    """
    kind = df.schema[name].dataType
    column = F.col(name)

    def nonblank(texts: Column) -> Column:
        return F.filter(F.transform(texts, strip), lambda t: t != "")

    if isinstance(kind, T.ArrayType):
        fields = [f for f in ("paragraph_text", "text") if f in kind.elementType.names]

        def chunk(paragraph: Column) -> Column:
            return F.coalesce(*[paragraph[f] for f in fields], F.lit(""))

        if "is_supporting" in kind.elementType.names:
            marked = F.filter(column, lambda p: F.coalesce(p["is_supporting"], F.lit(False)))
        else:
            marked = F.slice(column, 1, 0)
        supporting = nonblank(F.transform(marked, chunk))
        first = column if leading is None else F.slice(column, 1, leading)
        others = nonblank(F.transform(first, chunk))
        texts = F.when(F.size(supporting) > 0, supporting).otherwise(others)
    else:
        texts = nonblank(F.split(column, "\n\n"))
        texts = texts if leading is None else F.slice(texts, 1, leading)
    joined = F.array_join(texts, "\n\n")
    if fallback is None:
        return F.coalesce(joined, F.lit(""))
    return F.coalesce(F.nullif(joined, F.lit("")), fallback)


def _reference(**given: Column) -> Column:
    """Reference struct; fields a dataset does not have are null."""
    fields = {
        "answers": "array<string>",
        "label": "string",
        "answer": "string",
        "test_code": "string",
        "entry_point": "string",
    }
    return F.struct(
        *[given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()]
    )


def _case(
    df: DataFrame,
    dataset: str,
    example_id: Column,
    question: Column,
    reference: Column,
    context: Column | None = None,
    options: Column | None = None,
    answerable: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    def or_null(value: Column | None, kind: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind)

    return df.select(
        example_id.cast("string").alias("example_id"),
        F.lit(dataset).alias("dataset_name"),
        question.alias("question"),
        F.nullif(or_null(context, "string"), F.lit("")).alias("context"),
        or_null(options, "array<string>").alias("options"),
        reference.alias("reference"),
        or_null(answerable, "boolean").alias("answerable"),
        *keep,
    )


def _case_id(df: DataFrame, *names: str) -> Column:
    """Row id under any of its names; the row ordinal stands in when all are null."""
    found = [F.col(name).cast("string") for name in names if name in df.columns]
    ordinal = F.col("row_ordinal") if "row_ordinal" in df.columns else F.lit(None)
    return F.coalesce(*found, ordinal.cast("string"))


def multihop_cases(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    context = _first_given(df, ("paragraphs", "context"), oracle_context)
    answers = _first_given(df, ("answers", "answer", "gold_answers"), _text_list)
    answerable = F.col("answerable") if "answerable" in df.columns else F.lit(False)
    prompt = fill(
        fv.MUSIQUE_PROMPT,
        context=text_or_empty(context),
        question=text_or_empty(first_present(df, "question", "query", "prompt", default="")),
    )
    return _case(
        df,
        "musique",
        _case_id(df, "id", "example_id"),
        prompt,
        _reference(answers=F.coalesce(answers, F.array().cast("array<string>"))),
        answerable=F.coalesce(answerable, F.lit(False)),
        keep=keep,
    )


def narrative_cases(
    df: DataFrame, keep: Sequence[str] = (), max_chars: int | None = None
) -> DataFrame:
    """Question over a summary, or without one over the document, whole unless ``max_chars``."""
    summary = text_or_empty(F.col("document.summary.text"))
    body = text_or_empty(F.col("document.text"))
    if max_chars is not None:
        body = F.substring(body, 1, max_chars)
    options = _first_given(df, ("options", "choices"), _text_list)
    return _case(
        df,
        "quality",
        _case_id(df, "id", "example_id"),
        fill(
            fv.QA_PROMPT,
            question=text_or_empty(first_present(df, "question", "query", default="")),
        ),
        _reference(answers=_text_list(df, "answers")),
        context=F.coalesce(F.nullif(summary, F.lit("")), body),
        options=options,
        keep=keep,
    )


def evidence_text(df: DataFrame, name: str) -> Column:
    """Evidence given as a text, texts, lists of texts or structs, as one trimmed text."""
    kind = df.schema[name].dataType
    column = F.col(name)
    if not isinstance(kind, T.ArrayType):
        return strip(text_or_empty(column))
    entry = kind.elementType
    if isinstance(entry, T.ArrayType):
        texts = F.transform(column, lambda e: F.array_join(e.cast("array<string>"), " "))
    elif isinstance(entry, T.StructType):
        texts = F.transform(column, lambda e: text_or_empty(e["text"]))
    else:
        texts = column.cast("array<string>")
    return strip(F.coalesce(F.array_join(texts, " "), F.lit("")))


def fact_cases(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    evidence = _first_given(df, ("evidence", "context", "passage"), evidence_text)
    claim = text_or_empty(first_present(df, "claim", "question", "query", default=""))
    label = text_or_empty(first_present(df, "label", "answer", "gold_label", default=""))
    return _case(
        df,
        "fever",
        _case_id(df, "id", "example_id"),
        fill(fv.FEVER_PROMPT, question=claim),
        _reference(label=label),
        context=evidence,
        keep=keep,
    )


def math_cases(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    question = text_or_empty(first_present(df, "question", "problem", "prompt", default=""))
    answer = text_or_empty(first_present(df, "answer", "solution", "gold", default=""))
    return _case(
        df,
        "hardmath",
        _case_id(df, "id", "example_id"),
        fill(fv.MATH_PROMPT, question=question),
        _reference(answer=answer),
        keep=keep,
    )


def code_cases(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return _case(
        df,
        "humaneval_plus",
        _case_id(df, "task_id", "id", "example_id"),
        text_or_empty(first_present(df, "prompt", "question", default="")),
        _reference(
            test_code=text_or_empty(first_present(df, "test", "test_code", default="")),
            entry_point=text_or_empty(first_present(df, "entry_point", default="")),
        ),
        keep=keep,
    )


CASE_BUILDERS = {
    "musique": multihop_cases,
    "quality": narrative_cases,
    "fever": fact_cases,
    "hardmath": math_cases,
    "humaneval_plus": code_cases,
}


def build_requests(
    examples: DataFrame,
    prompt_version: str = "v1",
    temperature: float | None = None,
    max_tokens: int | None = None,
    stop_sequences: Sequence[str] = (),
    provider_params: dict[str, str] | None = None,
) -> DataFrame:
    """One request per example and model; explicit messages win over prompt parts.

    ``examples`` has ``model`` and may have ``messages``, ``system_prompt`` and ``metadata``.
    Rows without any content become errors. ``provider_params`` values are JSON texts.
    """

    def column(name: str, kind: str) -> Column:
        value = F.col(name) if name in examples.columns else F.lit(None)
        return value.cast(kind)

    messages = column("messages", f"array<{schemas.MESSAGE}>")
    explicit = F.coalesce(F.size(messages) > 0, F.lit(False))
    no_content = (text_or_empty(F.col("question")) == "") & (text_or_empty(F.col("context")) == "")
    invalid = ~explicit & no_content
    trace = F.create_map(
        F.lit("dataset_name"),
        F.col("dataset_name"),
        F.lit("example_id"),
        F.col("example_id"),
        F.lit("prompt_version"),
        F.lit(prompt_version),
    )
    params = [F.lit(item) for pair in sorted((provider_params or {}).items()) for item in pair]

    def prompt_part(value: Column) -> Column:
        return F.when(~explicit, value)

    return examples.select(
        "dataset_name",
        "example_id",
        "model",
        F.when(explicit, messages).alias("messages"),
        prompt_part(column("system_prompt", "string")).alias("system_prompt"),
        prompt_part(F.col("question")).alias("user_prompt"),
        prompt_part(F.col("context")).alias("context"),
        F.lit(temperature).cast("double").alias("temperature"),
        F.lit(max_tokens).cast("int").alias("max_tokens"),
        F.array(*[F.lit(s) for s in stop_sequences]).cast("array<string>").alias("stop_sequences"),
        merge_maps(column("metadata", "map<string,string>"), trace).alias("metadata"),
        F.create_map(*params).cast("map<string,string>").alias("provider_params"),
        F.when(invalid, "error").otherwise("ready").alias("request_status"),
        F.when(invalid, "ValueError").alias("error_type"),
        F.when(
            invalid,
            F.concat(
                F.lit("benchmark example "),
                F.col("example_id"),
                F.lit(" must include messages or prompt content"),
            ),
        ).alias("error_message"),
    )


def with_resolved_messages(requests: DataFrame, history: str | None = None) -> DataFrame:
    """Chat messages of each request."""
    past = F.col(history) if history else F.lit(None).cast(f"array<{schemas.MESSAGE}>")
    return requests.withColumn(
        "messages",
        resolved_messages(
            F.col("messages"), F.col("system_prompt"), past, F.col("context"), F.col("user_prompt")
        ),
    )


def role_aliases(spark, aliases: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Alias table of the council roles. A role is its own alias; a repeated alias is an error."""
    aliases = fv.ROLE_ALIASES if aliases is None else aliases
    rows: dict[str, str] = {}
    for role, names in aliases.items():
        role = role.strip().lower()
        for alias in {role, *(name.strip().lower() for name in names)}:
            if alias in rows:
                raise ValueError(f"Duplicate alias configured: {alias}")
            rows[alias] = role
    data = [(alias, role, fv.ROLE_TO_LABEL.get(role)) for alias, role in sorted(rows.items())]
    return spark.createDataFrame(data, "alias string, role string, label string")


def resolve_roles(df: DataFrame, target: str, aliases: DataFrame) -> DataFrame:
    """Role behind each target alias; an unknown alias becomes an error row."""
    keyed = df.withColumn("_alias", F.lower(strip(text_or_empty(F.col(target)))))
    joined = keyed.join(aliases.withColumnRenamed("alias", "_alias"), "_alias", "left")
    unknown = F.col("role").isNull()
    return joined.withColumn("error_type", F.when(unknown, "KeyError")).withColumn(
        "error_message",
        F.when(
            unknown, F.concat(F.lit("Unknown orchestrator target: "), text_or_empty(F.col(target)))
        ),
    ).drop("_alias")


def apply_role_defaults(requests: DataFrame, defaults: DataFrame) -> DataFrame:
    """Fill gaps of each request from its role; values set on the request win."""
    scalar = ("temperature", "max_tokens", "system_prompt", "user_prompt", "context")
    base = defaults.withColumnsRenamed(
        {name: f"_d_{name}" for name in defaults.columns if name != "role"}
    )
    joined = requests.join(base, "role", "left")
    stops = F.when(F.size("stop_sequences") > 0, F.col("stop_sequences")).otherwise(
        F.coalesce(F.col("_d_stop_sequences"), F.array().cast("array<string>"))
    )
    filled = {name: F.coalesce(F.col(name), F.col(f"_d_{name}")) for name in scalar}
    filled["model"] = F.coalesce(F.nullif(F.col("model"), F.lit("")), F.col("_d_model"))
    filled["stop_sequences"] = stops
    for name in ("metadata", "provider_params"):
        filled[name] = merge_maps(F.col(f"_d_{name}"), F.col(name))
    return joined.withColumns(filled).drop(*[c for c in joined.columns if c.startswith("_d_")])


def council_requests(df: DataFrame, dataset_alias: str = "router_dataset") -> DataFrame:
    """Specialist request and row metadata for each row of the mixed dataset."""
    source = canonical_source(F.col("source_dataset"))
    tags = F.coalesce(F.col("skill_tags"), F.array().cast("array<string>"))
    context = F.nullif(F.col("context"), F.lit(""))
    paragraphs = "paragraphs" if "paragraphs" in df.columns else "context"
    oracle = oracle_context(df, paragraphs, context)
    staged = (
        df.withColumn("_source", source)
        .withColumn("_context", F.when(source == "musique", oracle).otherwise(context))
        .withColumn("_parsed", parse_metadata(F.col("metadata")))
        .withColumn("_question", text_or_empty(F.col("question")))
        .withColumn(
            "_specialist",
            specialist_prompt(F.col("_source"), F.col("_question"), F.col("_context"), tags),
        )
    )
    entry_point = first_present(df, "entry_point", default=F.col("_parsed.entry_point"))
    return staged.select(
        F.col("id").alias("example_id"),
        F.lit(dataset_alias).alias("dataset_name"),
        F.col("_specialist.prompt").alias("user_prompt"),
        F.col("_specialist.context").alias("context"),
        F.struct(
            F.col("_source").alias("source_dataset"),
            tags.alias("skill_tags"),
            F.col("gold_answer").alias("gold_answer"),
            F.col("gold_label").alias("gold_label"),
            F.col("unit_tests").alias("unit_tests"),
            F.nullif(entry_point, F.lit("")).alias("entry_point"),
            F.col("_parsed.answerable").alias("answerable"),
            F.col("original_id").alias("original_id"),
            F.col("_question").alias("question"),
            F.col("_context").alias("context"),
            F.col("_specialist.prompt").alias("specialist_prompt"),
        ).alias("row_metadata"),
    )
