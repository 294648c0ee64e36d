"""Conversation structure repair: the cheapest edits that bring every conversation into a legal order
of roles, ``(system? (user assistant)+)?``.

Rows are dealt by conversation and sorted by turn, and Python sees them as a stream, whatever the
length of a conversation. Two passes share one shuffle:

* backwards, the cost of the best ending from each of four states is carried from batch to batch, and
  every row gets its back-pointers: two bits a state, one byte in all;
* Spark's own sorter turns the rows round, spilling rows and back-pointers of giant conversations;
* forwards, one state is carried along and the byte of each row says what to do with it.

A task holds one batch and a few numbers. A conversation is worked on by one task at a time, as each
step needs the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# White space of the format: 0x20 and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"

FINE, BLANK, DUPLICATE, TRUNCATED, ABSENT = range(5)
FAULTS = ("fine", "blank", "duplicate", "truncated", "absent")

# Edits in the order of their letters, which is also the order of preference among equal costs.
_DELETE, _INSERT, _KEEP, _REROLE = range(4)
LETTERS = "DIKR"

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER_INSERT = (_USER, _USER, _ASSISTANT, _USER)
_ADDED = ("user", "user", "assistant", "user")
_NEVER = 1 << 40

_CARRIED = "conv string, has_turn boolean, turn_no long, role string, text string, fault int"


@dataclass(frozen=True)
class Costs:
    """What each edit costs; ``unended`` is added for a truncated turn that stays."""

    delete: int = 4
    insert: int = 3
    rerole: int = 3
    unended: int = 3


def after_keep(state: int, initial: str) -> int | None:
    """The state after a turn of a role with this initial, None where it is out of place."""
    if initial == "a":
        return _ASSISTANT if state == _USER else None
    if initial == "u":
        return _USER if state != _USER else None
    return _SYSTEM if initial == "s" and state == _NONE else None


def after_last(costs: Costs) -> list[int]:
    """Cost of the ending from each state once no turn is left."""
    return [0, 2 * costs.insert, costs.insert, 0]


def step_back(later: list[int], initial: str, fault: int, costs: Costs) -> tuple[list[int], int]:
    """Costs from each state in front of a turn, given those behind it, and the turn's back-pointers."""
    extra = costs.unended if fault == TRUNCATED else 0
    options = []
    for state in range(4):
        of_state = [costs.delete + later[state], _NEVER, _NEVER, _NEVER]
        if fault not in (BLANK, DUPLICATE):
            kept = after_keep(state, initial)
            if kept is not None:
                of_state[_KEEP] = extra + later[kept]
            of_state[_REROLE] = costs.rerole + extra + later[_AFTER_INSERT[state]]
        options.append(of_state)
    # An insertion stays in front of the turn. After two of them the state repeats, at a higher cost.
    bare = [min(of_state) for of_state in options]
    inserted = [costs.insert + min(bare[s], costs.insert + bare[_AFTER_INSERT[s]]) for s in _AFTER_INSERT]
    best, pointers = [], 0
    for state, of_state in enumerate(options):
        of_state[_INSERT] = inserted[state]
        least = min(of_state)
        best.append(least)
        pointers |= of_state.index(least) << (2 * state)
    return best, pointers


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    absent: str | None = None,
    costs: Costs = Costs(),
) -> DataFrame:
    """The edited conversations, one row an edit, each conversation's rows together and in order.

    Columns: the conversation, ``turn`` (null for an inserted one), ``edit`` (a letter of ``LETTERS``),
    ``fault`` (of ``FAULTS``), ``old_role``, ``role`` and ``text``, ``cost`` of the edit.

    Turns come by number, nulls first, equal numbers by role and text. Null roles and texts count as
    one space; an empty role fits nowhere. A turn is blank without a visible character, a duplicate
    if its role and text came earlier in the conversation, truncated if its last visible character is
    none of ``.!?``; the first that holds counts. Blank and duplicate turns are deleted. Among the
    cheapest edits those whose letters come first in ASCII are made. Rows without a conversation id
    are one conversation.
    Rows whose column ``absent`` is true are no turns; they come back as ``absent`` with no edit, so
    that their conversation is not lost. Other columns are not carried.
    """
    gone = F.coalesce(F.col(absent).cast("boolean"), F.lit(False)) if absent else F.lit(False)
    rows = turns.select(
        F.col(conv_col).cast("string").alias("conv"),
        F.col(turn_col).isNotNull().alias("has_turn"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn_no"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
        gone.alias("gone"),
    ).repartition("conv")
    place = ["has_turn", "turn_no", "role", "text"]
    # The window needs no further shuffle: it sorts inside the conversation's partition.
    same = W.partitionBy("conv", "gone", "role", "text").orderBy("has_turn", "turn_no")
    visible = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(F.col("gone"), ABSENT)
        .when(visible == "", BLANK)
        .when(F.col("seen") > 1, DUPLICATE)
        .when(~F.right(visible, F.lit(1)).isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    judged = rows.withColumn("seen", F.row_number().over(same)).withColumn("fault", fault)
    order = [F.col(c) for c in (*place, "seen")]
    backwards = judged.drop("gone").sortWithinPartitions("conv", *[c.desc() for c in order])

    def pointed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, later = None, None
        for batch in batches:
            pointers = []
            for key, role, kind in zip(batch["conv"], batch["role"], batch["fault"]):
                if later is None or key != conv:
                    conv, later = key, after_last(costs)
                byte = 0
                if kind != ABSENT:
                    later, byte = step_back(later, role[:1], kind, costs)
                pointers.append(byte)
            yield batch.assign(pointers=pointers)

    marked = backwards.mapInPandas(pointed, f"{_CARRIED}, seen int, pointers int")
    forwards = marked.sortWithinPartitions("conv", *order)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, state = None, None
        for batch in batches:
            out = []
            columns = ("conv", "has_turn", "turn_no", "role", "text", "fault", "pointers")
            for key, has_turn, turn, role, text, kind, byte in zip(*[batch[c] for c in columns]):
                if state is None or key != conv:
                    if state is not None:
                        out += _ending(conv, state, costs)
                    conv, state = key, _NONE
                number = turn if has_turn else None
                if kind == ABSENT:
                    out.append((key, number, None, FAULTS[kind], role, role, text, 0))
                    continue
                edit = (byte >> (2 * state)) & 3
                while edit == _INSERT:
                    out.append(_inserted(key, state, costs))
                    state = _AFTER_INSERT[state]
                    edit = (byte >> (2 * state)) & 3
                new, cost = role, costs.unended if kind == TRUNCATED else 0
                if edit == _DELETE:
                    cost = costs.delete
                elif edit == _KEEP:
                    state = after_keep(state, role[:1])
                else:
                    new, cost = _ADDED[state], cost + costs.rerole
                    state = _AFTER_INSERT[state]
                out.append((key, number, LETTERS[edit], FAULTS[kind], role, new, text, cost))
            yield _frame(out)
        if state is not None:
            yield _frame(_ending(conv, state, costs))

    edited = forwards.drop("seen").mapInPandas(
        walked, "conv string, turn long, edit string, fault string, old_role string, role string, text string, cost long"
    )
    kind = turns.schema[conv_col].dataType
    return edited.select(F.col("conv").cast(kind).alias(conv_col), "turn", "edit", "fault", "old_role", "role", "text", "cost")


def _inserted(conv: str | None, state: int, costs: Costs) -> tuple:
    return (conv, None, "I", None, None, _ADDED[state], "", costs.insert)


def _ending(conv: str | None, state: int, costs: Costs) -> list[tuple]:
    added = []
    while state in (_SYSTEM, _USER):
        added.append(_inserted(conv, state, costs))
        state = _AFTER_INSERT[state]
    return added


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ("conv", "turn", "edit", "fault", "old_role", "role", "text", "cost")
    frame = pd.DataFrame(rows, columns=names, dtype=object)
    # Turn numbers may be null; a nullable integer keeps all their digits.
    return frame.astype({"turn": "Int64", "cost": "int64"})
