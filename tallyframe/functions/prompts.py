"""Prompt texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.functions.text import fill, strip, text_or_empty

MESSAGE = "struct<role:string,content:string,name:string>"


def message(role: str, content: Column) -> Column:
    return F.struct(
        F.lit(role).alias("role"),
        content.alias("content"),
        F.lit(None).cast("string").alias("name"),
    )


def specialist_prompt(
    source: Column, question: Column, context: Column, skill_tags: Column
) -> Column:
    """``struct<prompt, context>`` for a specialist; the multi-hop prompt embeds its context."""
    name = F.lower(strip(text_or_empty(source)))
    question = text_or_empty(question)

    def tagged(tag: str) -> Column:
        return F.coalesce(F.array_contains(skill_tags, tag), F.lit(False))

    multihop = name.contains("musique")
    prompt = (
        F.when(multihop, fill(fv.MUSIQUE_PROMPT, context=text_or_empty(context), question=question))
        .when(
            name.contains("fever") | tagged("fact-verification"),
            fill(fv.FEVER_PROMPT, question=question),
        )
        .when(name.contains("math") | tagged("math"), fill(fv.MATH_PROMPT, question=question))
        .when(name.contains("humaneval") | tagged("code"), question)
        .otherwise(fill(fv.QA_PROMPT, question=question))
    )
    return F.struct(
        prompt.alias("prompt"),
        F.when(~multihop, context).alias("context"),
    )


def vote_prompt(question: Column, label_to_answer: Column) -> Column:
    """Ballot listing the answers of a label → answer map in label order."""
    entries = F.array_sort(F.map_entries(label_to_answer))
    block = F.array_join(
        F.transform(
            entries,
            lambda e: F.concat(F.lit("Answer "), e["key"], F.lit(":\n"), text_or_empty(e["value"])),
        ),
        "\n\n",
    )
    return fill(fv.VOTE_PROMPT, question=text_or_empty(question), answers=block)


def synthesis_prompt(
    source: Column, question: Column, context: Column, winner: Column, others: Column
) -> Column:
    """Final-answer prompt of a dataset; math and code leave the context out."""
    name = F.lower(strip(text_or_empty(source)))
    slots = {
        "question": text_or_empty(question),
        "context_block": F.when(
            F.coalesce(context, F.lit("")) != "",
            F.concat(F.lit("Context:\n"), context, F.lit("\n\n")),
        ).otherwise(""),
        "winner": text_or_empty(winner),
        "others": F.array_join(
            F.transform(others, lambda a: F.concat(F.lit("- "), a)), "\n\n"
        ),
    }

    def text(kind: str) -> Column:
        return fill(fv.SYNTHESIS_PROMPTS[kind], **slots)

    return (
        F.when(name.contains("musique"), text("musique"))
        .when(name.contains("fever"), text("fever"))
        .when(name.contains("math"), text("math"))
        .when(name.contains("humaneval") | name.contains("code"), text("code"))
        .otherwise(text("qa"))
    )


def short_answer_prompt(question: Column, context: Column) -> Column:
    return fill(
        fv.SHORT_ANSWER_PROMPT, question=text_or_empty(question), context=text_or_empty(context)
    )


def four_answer_prompt(
    question: Column, model1: Column, model2: Column, model3: Column, router: Column
) -> Column:
    return fill(
        fv.FOUR_ANSWER_PROMPT,
        question=text_or_empty(question),
        model1=text_or_empty(model1),
        model2=text_or_empty(model2),
        model3=text_or_empty(model3),
        router_response=text_or_empty(router),
    )


def resolved_messages(
    messages: Column,
    system_prompt: Column,
    history: Column,
    context: Column,
    user_prompt: Column,
) -> Column:
    """Chat messages: the explicit ones, else system, history and one user message."""
    nothing = F.array().cast(f"array<{MESSAGE}>")
    messages = F.coalesce(messages, nothing)
    system = F.when(text_or_empty(system_prompt) != "", F.array(message("system", system_prompt)))
    user_text = F.concat_ws(
        "\n\n", F.nullif(context, F.lit("")), F.nullif(user_prompt, F.lit(""))
    )
    user = F.when(user_text != "", F.array(message("user", user_text)))
    assembled = F.concat(
        F.coalesce(system, nothing), F.coalesce(history, nothing), F.coalesce(user, nothing)
    )
    return F.when(F.size(messages) > 0, messages).otherwise(assembled)
