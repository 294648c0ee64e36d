"""Chat formatting by relational expressions: turn structs are collected and sorted, neighbours of one
role merged by an array aggregation, and the pieces concatenated.

A conversation is cut into parts by turn number, ``PART_TURNS`` numbers each, so that no group grows
with the length of a conversation; parts only need to know the roles beside them, which a small table
of edges tells. A range of numbers that holds far more rows than numbers is cut again by number and
by hash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyframe.llm.grouped import fresh
from tallyframe.session import saved_table

# Turn numbers of one part, as a power of two, and the rows from which a part is cut again.
PART_BITS = 9
CROWDED_ROWS = 4096
# Rows without a turn number come first, in a part of their own, below every shifted number.
_NO_NUMBER = -(1 << 60)


@dataclass(frozen=True)
class Template:
    """The marks of a format. Every mark starts with ``<`` or ``[`` and has neither of them again, nor
    a backslash, so that marks cannot overlap. Inside texts and names a mark gets a backslash after
    its first character, and one more for each that it has already: ``</s>`` is written ``<\\/s>`` and
    ``<\\/s>`` is written ``<\\\\/s>``, which can be undone."""

    begin: str = "<s>"
    end: str = "</s>"
    again: str = "[+]"
    openers: dict[str, str] = field(default_factory=lambda: {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"})
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    trained: str = "assistant"

    def __post_init__(self):
        if self.trained not in self.openers:
            raise ValueError(f"the trained role needs an opener: {self.trained}")
        if len(set(self.marks)) < len(self.marks):
            raise ValueError("marks must differ")
        for mark in self.marks:
            if not re.fullmatch(r"[<\[][^<\[\\]+", mark):
                raise ValueError(f"not a mark: {mark}")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.begin, self.end, self.again, *self.openers.values(), *self.other)

    def _tails(self) -> str:
        return "|".join(_quoted(mark[1:]) for mark in sorted(self.marks))

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._tails()})", r"$1$2\\$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)\\({self._tails()})", "$1$2$3")

    def opener(self, role: Column) -> Column:
        """What stands in front of the first text of a turn."""
        opened = F.concat(F.lit(self.other[0]), self.escape(role), F.lit(self.other[1]))
        for name, mark in self.openers.items():
            opened = F.when(role == name, F.lit(mark)).otherwise(opened)
        return opened


def _quoted(text: str) -> str:
    """The text as a literal of a pattern."""
    return re.sub(r"([][\\+*?.(){}|^$])", r"\\\1", text)


def format_parts(
    turns: DataFrame,
    template: Template = Template(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Formatted conversations in parts: the conversation, ``part`` (sorts in order), ``alone`` (the
    conversation's only part), ``opening_role``, ``formatted`` and ``spans``.

    The concatenated ``formatted`` of a conversation is its text. ``spans`` has start, from 0, and
    length of what is trained on, in code points of the part's text: every text of the trained role,
    without marks. Turns come by number, nulls first, equal numbers by a hash of role and text.
    Neighbouring turns of one role become one turn with a mark between their texts. Null roles and
    texts are empty; rows without a conversation id are one conversation; other columns are not
    carried. Equal rows of one turn number stay in one part.
    """
    rows = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),
        F.col(turn_col).isNotNull().alias("numbered"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("number"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    stretch = F.when(F.col("numbered"), F.shiftright("number", PART_BITS)).otherwise(F.lit(_NO_NUMBER))
    rows = rows.withColumn("stretch", stretch).withColumn("tie", F.xxhash64("role", "text"))
    counts = rows.groupBy("conv", "stretch").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED_ROWS)
    crowded = saved_table(counts.select("conv", "stretch", F.ceil(F.col("n") / CROWDED_ROWS).alias("shares")), "crowded")
    share = F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * F.col("shares"))
    part = F.struct(
        "stretch",
        F.when(F.col("shares").isNotNull(), F.col("number")).otherwise(F.lit(0)).alias("number"),
        F.coalesce(share, F.lit(0)).alias("share"),
    )
    placed = rows.join(crowded, ["conv", "stretch"], "left").withColumn("place", F.struct("conv", part.alias("part")))

    first = F.struct("numbered", "number", "tie", "role")
    edges = placed.groupBy("place").agg(F.min(first)["role"].alias("first_role"), F.max(first)["role"].alias("last_role"))
    by_part = W.partitionBy("place.conv").orderBy("place.part")
    edges = edges.select(
        "place",
        F.lag("last_role").over(by_part).alias("role_before"),
        F.lead("first_role").over(by_part).alias("role_after"),
    )
    turn = F.struct("numbered", "number", "tie", "role", "text")
    collected = placed.groupBy("place").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = (
        collected.join(edges, "place")
        .withColumn("runs", _merged(F.col("turns")))
        .withColumn("pieces", _pieces(template))
        .withColumn("formatted", F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), ""))
    )
    return formatted.select(
        F.col("place.conv.id").alias(conv_col),
        F.col("place.part").alias("part"),
        (F.col("role_before").isNull() & F.col("role_after").isNull()).alias("alone"),
        F.get("runs", F.lit(0))["role"].alias("opening_role"),
        "formatted",
        _spans(F.col("pieces")).alias("spans"),
    )


def _merged(turns: Column) -> Column:
    """Runs of turns of one role: role and texts."""
    none = F.expr("CAST(array() AS array<struct<role:string,texts:array<string>>>)")

    def add(runs: Column, turn: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = F.coalesce(last["role"] == turn["role"], F.lit(False))
        return F.when(same, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(grown))).otherwise(
            F.concat(runs, F.array(new))
        )

    return F.aggregate(turns, none, add)


def _pieces(template: Template) -> Column:
    """Marks and escaped bodies in order. A run goes on from the part before or into the next one if
    their roles meet: it then has no opener, or no end."""

    def piece(mark: Column, body: Column, trained: Column) -> Column:
        return F.struct(mark.alias("mark"), body.alias("body"), trained.alias("trained"))

    def of_run(run: Column, place: Column) -> Column:
        trained = run["role"] == template.trained
        goes_on = (place == 0) & F.coalesce(F.col("role_before") == run["role"], F.lit(False))
        stays_open = (place == F.size("runs") - 1) & F.coalesce(F.col("role_after") == run["role"], F.lit(False))
        opened = F.when(goes_on, F.lit(template.again)).otherwise(template.opener(run["role"]))
        texts = F.transform(
            run["texts"],
            lambda text, k: piece(F.when(k == 0, opened).otherwise(F.lit(template.again)), template.escape(text), trained),
        )
        closing = F.array(piece(F.lit(template.end), F.lit(""), F.lit(False)))
        return F.when(trained & ~stays_open, F.concat(texts, closing)).otherwise(texts)

    begin = F.array(piece(F.lit(template.begin), F.lit(""), F.lit(False)))
    inner = F.flatten(F.transform("runs", of_run))
    return F.when(F.col("role_before").isNull(), F.concat(begin, inner)).otherwise(inner)


def _spans(pieces: Column) -> Column:
    start = F.expr("named_struct('at', 0, 'spans', CAST(array() AS array<struct<start:int,length:int>>))")

    def add(state: Column, piece: Column) -> Column:
        body = state["at"] + F.length(piece["mark"])
        span = F.struct(body.alias("start"), F.length(piece["body"]).alias("length"))
        spans = F.when(piece["trained"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((body + F.length(piece["body"])).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, start, add)["spans"]


def join_parts(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation: the conversation, ``formatted`` and its ``spans``.

    A formatted conversation must fit a string (2 GB); longer ones stay in parts.
    """
    piece = F.struct("part", "formatted", "spans")
    whole = parts.groupBy(conv_col).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

    def shifted(state: Column, p: Column) -> Column:
        spans = F.transform(
            p["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), s["length"].alias("length"))
        )
        return F.struct(
            (state["at"] + F.length(p["formatted"])).alias("at"), F.concat(state["spans"], spans).alias("spans")
        )

    start = F.expr("named_struct('at', 0, 'spans', CAST(array() AS array<struct<start:int,length:int>>))")
    return whole.select(
        conv_col,
        F.array_join(F.col("pieces.formatted"), "").alias("formatted"),
        F.aggregate("pieces", start, shifted)["spans"].alias("spans"),
    )


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """``parts`` with what their texts say: ``turns`` (role and text of every turn before merging) and
    ``trained`` (the texts under the spans, unescaped). Columns of these names give way."""
    opened = {mark: role for role, mark in template.openers.items()}
    ahead = "|".join(_quoted(m) for m in (template.begin, template.end, template.other[0], *opened))
    pieces = F.filter(
        F.split("formatted", f"(?={ahead})"), lambda p: (p != "") & ~p.isin(template.begin, template.end)
    )
    other, closed = template.other

    def of_piece(piece: Column) -> Column:
        named = F.split(F.substring(piece, len(other) + 1, 2**31 - 1), _quoted(closed), 2)
        # A piece without an opener goes on from the part before.
        role, body = F.col("opening_role"), F.substring(piece, len(template.again) + 1, 2**31 - 1)
        is_other = F.startswith(piece, F.lit(other))
        role = F.when(is_other, template.unescape(F.get(named, F.lit(0)))).otherwise(role)
        body = F.when(is_other, F.get(named, F.lit(1))).otherwise(body)
        for mark, name in opened.items():
            this = F.startswith(piece, F.lit(mark))
            role = F.when(this, F.lit(name)).otherwise(role)
            body = F.when(this, F.substring(piece, len(mark) + 1, 2**31 - 1)).otherwise(body)
        texts = F.split(body, _quoted(template.again))
        return F.transform(texts, lambda text: F.struct(role.alias("role"), template.unescape(text).alias("text")))

    under = F.transform(
        "spans", lambda s: template.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    )
    staged = fresh(parts, "split_pieces")
    split_up = parts.withColumn(staged, pieces)
    return split_up.withColumns(
        {"turns": F.flatten(F.transform(F.col(staged), of_piece)), "trained": under}
    ).drop(staged)
