"""Final answers out of free-form model output, as Column expressions.

Flags used in the patterns: ``d`` makes ``.`` and ``$`` treat only a line feed as a line end,
``iu`` ignores case beyond ASCII, ``m`` lets ``^`` match at each line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import fixed_values as fv
from tallyframe.functions.text import let, matched, strip, text_or_empty, unify_line_breaks

_SPACE = f"[{fv.SPACE}]"
_INLINE = f"[{fv.INLINE_SPACE}]"
_NOT_SPACE = f"[^{fv.SPACE}]"
_FENCE = rf"(?diu)```(?:python|py|python3)?{_SPACE}*\n"
_DEFINITION = rf"(?:def|class){_SPACE}+[{fv.WORD}]"


def _bound_text(value: Column, read) -> Column:
    """Evaluate the stripped text once for a reader that uses it several times."""
    return let(strip(text_or_empty(value)), read)


def _first_content_line(text: Column) -> Column:
    """First line that is no preamble, without its final dots when short; else the first line."""
    opening = "|".join(fv.PREAMBLE)
    pattern = rf"(?dim)^{_INLINE}*+(?!{opening})({_NOT_SPACE}.*)$"

    def shortened(line: Column) -> Column:
        short = F.size(F.split(line, f"{_SPACE}+")) <= 10
        return F.when(short, F.rtrim(line, F.lit("."))).otherwise(line)

    def pick(lines: Column) -> Column:
        chosen = let(strip(matched(lines, pattern)), shortened)
        return F.coalesce(chosen, strip(F.substring_index(lines, "\n", 1)))

    return let(unify_line_breaks(text), pick)


def qa_answer(value: Column) -> Column:
    """Text after an answer marker up to a dot or the end, else the first content line."""
    pattern = rf"(?diu){fv.ANSWER_MARKER}{_SPACE}*(.+?)(?:\.|$)"
    return _bound_text(
        value, lambda text: F.coalesce(strip(matched(text, pattern)), _first_content_line(text))
    )


def multihop_answer(value: Column) -> Column:
    """As ``qa_answer`` but the marked text runs to the line end and loses scratchpad tags."""
    pattern = rf"(?diu){fv.ANSWER_MARKER}{_SPACE}*(.+?)(?:\n|$)"

    def read(text: Column) -> Column:
        untagged = F.regexp_replace(strip(matched(text, pattern)), r"(?iu)</?scratchpad>", "")
        return F.coalesce(strip(untagged), _first_content_line(text))

    return _bound_text(value, read)


def choice_letter(value: Column) -> Column:
    """Letter of a multiple-choice answer, else the first character."""

    def read(text: Column) -> Column:
        leading = matched(text, rf"\A\(?([A-Da-d])\)?[{fv.SPACE}.,:]")
        alone = matched(text, r"\A([A-Da-d])\z")
        marked = matched(text, rf"(?iu)(?:answer is|answer:){_SPACE}*\(?([A-Da-d])\)?")
        word = matched(text, rf"(?<![{fv.WORD}])([A-D])(?![{fv.WORD}])")
        first = F.substring(text, 1, 1)
        return F.coalesce(F.upper(leading), F.upper(alone), F.upper(marked), word, F.upper(first))

    return _bound_text(value, read)


def _has_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(rf"(?<![{fv.WORD}])(?:{'|'.join(words)})(?![{fv.WORD}])")


def fact_label(value: Column) -> Column:
    """Fact-check label named in the text; missing-evidence words win, then support words."""

    def read(text: Column) -> Column:
        return (
            F.when(_has_word(text, fv.NEI_WORDS), "NOT ENOUGH INFO")
            .when(_has_word(text, fv.SUPPORT_WORDS), "SUPPORTS")
            .when(_has_word(text, fv.REFUTE_WORDS), "REFUTES")
            .otherwise(strip(text))
        )

    return let(F.lower(text_or_empty(value)), read)


def loose_fact_label(value: Column) -> Column:
    """Documented variant: plain substrings, else the first word in upper case."""
    text = F.lower(strip(text_or_empty(value)))
    result = None
    for label, words in fv.LOOSE_LABEL_RULES:
        hit = text.rlike("|".join(words))
        result = F.when(hit, label) if result is None else result.when(hit, label)
    return result.otherwise(F.upper(F.get(F.split(text, f"{_SPACE}+"), F.lit(0))))


def _last_boxed(text: Column) -> Column:
    r"""Content of the last ``\boxed{...}`` with its braces balanced; null when open or absent.

    The tail is cut at each closing brace. The box ends at the first piece by which as many
    braces were opened as closed before it.
    """

    def opened(piece: Column) -> Column:
        return F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))

    def end_of_box(pieces: Column) -> Column:
        closing = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        start = F.struct(
            F.lit(0).alias("opened"), F.lit(0).alias("seen"), F.lit(0).alias("end")
        )

        def step(state: Column, piece: Column) -> Column:
            total = state["opened"] + opened(piece)
            done = (state["end"] == 0) & (total == state["seen"])
            return F.struct(
                total.alias("opened"),
                (state["seen"] + 1).alias("seen"),
                F.when(done, state["seen"] + 1).otherwise(state["end"]).alias("end"),
            )

        return F.aggregate(closing, start, step)["end"]

    def content(pieces: Column) -> Column:
        return let(
            end_of_box(pieces),
            lambda end: F.when(
                end > 0, strip(F.array_join(F.slice(pieces, F.lit(1), end), "}"))
            ),
        )

    tail = F.substring_index(text, fv.BOXED, -1)
    return F.when(text.contains(fv.BOXED), let(F.split(tail, r"\}", -1), content))


def math_answer(value: Column) -> Column:
    """Last boxed content, else the text after a result marker, else the last number."""

    def read(text: Column) -> Column:
        explicit = matched(text, rf"(?diu){fv.MATH_MARKERS[0]}{_SPACE}*[:=]{_SPACE}*(.+)$")
        phrased = matched(text, rf"(?diu){fv.MATH_MARKERS[1]}{_SPACE}*(.+)$")
        marked = F.rtrim(strip(F.coalesce(explicit, phrased)), F.lit("."))
        return F.coalesce(_last_boxed(text), marked, last_number(text), text)

    return _bound_text(value, read)


def loose_math_answer(value: Column) -> Column:
    """Documented variant: explicit number, simple box, phrased number, last number, empty."""
    text = strip(text_or_empty(value))
    explicit = matched(
        text, rf"(?iu){fv.MATH_MARKERS[0]}{_SPACE}*[:=]{_SPACE}*({fv.NUMBER})"
    )
    boxed = strip(matched(text, r"\\boxed\{([^}]+)\}"))
    phrased = matched(text, rf"(?iu){fv.MATH_MARKERS[1]}{_SPACE}*({fv.NUMBER})")
    return F.coalesce(explicit, boxed, phrased, last_number(text), F.lit(""))


def last_number(text: Column) -> Column:
    """Last number in a text, null when it has none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(fv.NUMBER), F.lit(0)), F.lit(-1))


def clean_code(code: Column) -> Column:
    """Drop print and example-comment lines and everything from the main guard on."""
    text = unify_line_breaks(code)
    text = F.regexp_replace(text, rf"(?dm)^{_INLINE}*if __name__[\s\S]*", "")
    text = F.regexp_replace(
        text, rf"(?dm)^{_INLINE}*(?:print\(|(?i:# example)).*(?:\n|\z)", ""
    )
    return strip(text)


def _code_from_definition(text: Column) -> Column:
    """Text from the first definition at a line start; null when there is none.

    When a comment or ``from ... import`` line comes first, the last definition counts.
    """
    first = matched(text, rf"(?m)^{_SPACE}*({_DEFINITION}[\s\S]*)")
    last = matched(text, rf"\A[\s\S]*\n{_SPACE}*({_DEFINITION}[\s\S]*)")
    head = F.regexp_replace(text, rf"(?dm)^{_SPACE}*{_DEFINITION}[\s\S]*", "")
    led_by_comment = head.rlike(
        rf"(?dm)^{_SPACE}*(?:#|from{_SPACE}+{_NOT_SPACE}+{_SPACE}+import{_SPACE})"
    )
    return F.when(led_by_comment, F.coalesce(last, first)).otherwise(first)


def code_answer(value: Column) -> Column:
    """Code of a closed fence, an open fence, from a definition on, or the bare text."""
    closed = rf"{_FENCE}([\s\S]*?)\n```"
    opened = rf"{_FENCE}([\s\S]*)"

    def read(text: Column) -> Column:
        bare = F.regexp_replace(text, rf"(?d)\A{_SPACE}*```[{fv.WORD}]*{_SPACE}*\n?", "")
        bare = F.regexp_replace(bare, rf"(?d)\n?{_SPACE}*```{_SPACE}*\z", "")
        fenced = F.when(text.rlike(closed), F.regexp_extract(text, closed, 1)).when(
            text.rlike(opened), F.regexp_extract(text, opened, 1)
        )
        fenced = F.when(text.contains("```"), fenced)
        return clean_code(strip(F.coalesce(fenced, _code_from_definition(text), bare)))

    return _bound_text(value, read)


EXTRACTORS = {
    "musique": qa_answer,
    "quality": qa_answer,
    "fever": fact_label,
    "hardmath": math_answer,
    "humaneval_plus": code_answer,
}
PROFILE_EXTRACTORS = {**EXTRACTORS, "musique": multihop_answer}
LOOSE_EXTRACTORS = {
    "musique": qa_answer,
    "quality": choice_letter,
    "fever": loose_fact_label,
    "hardmath": loose_math_answer,
    "humaneval_plus": code_answer,
}


def extract_answer(
    value: Column, dataset: Column, extractors=None, unknown: str = "raise"
) -> Column:
    """Extractor chosen by dataset. An unknown dataset raises, or gives null if asked."""
    extractors = extractors or EXTRACTORS
    result = None
    for name, extractor in extractors.items():
        hit = dataset == name
        branch = extractor(value)
        result = F.when(hit, branch) if result is None else result.when(hit, branch)
    if unknown == "raise":
        message = F.concat(F.lit("Unknown dataset: "), F.coalesce(dataset, F.lit("null")))
        return result.otherwise(F.raise_error(message).cast("string"))
    return result


def strip_reasoning(value: Column) -> Column:
    """Text after the last closing think tag, then after the last closing scratchpad tag."""
    text = F.substring_index(text_or_empty(value), "</think>", -1)
    return strip(F.substring_index(text, "</scratchpad>", -1))


def clean_answer(value: Column, max_chars: int | None = None) -> Column:
    """Answer without reasoning blocks. Only with ``max_chars`` longer ones end in an ellipsis."""
    text = text_or_empty(value)
    for tag in fv.REASONING_TAGS:
        text = F.regexp_replace(text, rf"(?s)<{tag}>.*?</{tag}>", "")
    text = strip(text)
    if max_chars is None:
        return text
    return let(
        text,
        lambda whole: F.when(
            F.length(whole) > max_chars, F.concat(F.left(whole, F.lit(max_chars)), F.lit("..."))
        ).otherwise(whole),
    )
