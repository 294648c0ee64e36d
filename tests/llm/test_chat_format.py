"""Chat formats: exact round trips, spans, and parts of long conversations."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import chat_format, queries

TURNS = "conv_id long, turn long, role string, text string"
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[ROLE]", "[/ROLE]", "[+]"]


def nasty(draw):
    """Marks, marks with backslashes, halves of marks."""
    some = [*MARKS, *[m[0] + "\\" * draw.randrange(1, 4) + m[1:] for m in MARKS]]
    some += ["<", "[", "\\", "/s>", "INST]", " ", "é", "\U0001f600", "\n", "$1", ""]
    return "".join(draw.choice(some) for _ in range(draw.randrange(0, 8)))


def ordered(rows):
    """Turns by number, nulls first; equal numbers keep an order of their own and are compared as sets."""
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0))


def written(rows):
    """The default format by a plain loop."""
    out, before = "<s>", None

    def escape(text):
        import re

        return re.sub(r"([<\[])(\\*)(s>|/s>|\+\]|SYS\]|INST\]|/INST\]|ROLE\]|/ROLE\])", r"\1\2\\\3", text)

    openers = {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"}
    for _, _, role, text in rows:
        role, text = role or "", text or ""
        if role == before:
            out += "[+]"
        else:
            out += "</s>" if before == "assistant" else ""
            out += openers.get(role, f"[ROLE]{escape(role)}[/ROLE]")
        out += escape(text)
        before = role
    return out + ("</s>" if before == "assistant" else "")


def by_conversation(rows):
    convs = {}
    for row in rows:
        convs.setdefault(row[0], []).append(row)
    return {conv: ordered(some) for conv, some in convs.items()}


def read(df):
    """Turns and trained texts of each conversation, joined from its parts in order."""
    back = {}
    rows = chat_format.read_back(df).select("conv_id", "part", "turns", "trained").collect()
    for r in sorted(rows, key=lambda r: tuple(r["part"])):
        turns, trained = back.setdefault(r["conv_id"], ([], []))
        turns += [(t["role"], t["text"]) for t in r["turns"]]
        trained += r["trained"]
    return back


def test_round_trip_of_marks_inside_texts(frame):
    draw = random.Random(11)
    roles = ["user", "assistant", "assistant", "system", "tool", "[/ROLE]", "</s>", "", None]
    rows = []
    for conv in [None, *range(150)]:
        for turn in range(draw.randrange(1, 9)):
            number = None if turn == 0 and conv is not None and conv % 3 == 0 else turn
            rows.append((conv, number, draw.choice(roles), draw.choice([nasty(draw), nasty(draw), None])))
    convs = by_conversation(rows)
    for parts in (1, 4):
        formatted = chat_format.format_parts(frame([(*r, "x") for r in rows], TURNS + ", formatted string", parts))
        texts = {r["conv_id"]: r["formatted"] for r in chat_format.join_parts(formatted).collect()}
        assert texts == {conv: written(some) for conv, some in convs.items()}
        back = read(formatted)
        for conv, some in convs.items():
            turns = [(role or "", text or "") for _, _, role, text in some]
            assert back[conv] == (turns, [text for role, text in turns if role == "assistant"])


def test_long_conversations_in_parts(frame, monkeypatch):
    monkeypatch.setattr(chat_format, "PART_BITS", 2)
    draw = random.Random(3)
    rows = [(1, k * 3 - 50, draw.choice(["user", "assistant"]), nasty(draw)) for k in range(300)]
    rows += [(2, 0, "user", "one part")]
    convs = by_conversation(rows)
    parts = chat_format.format_parts(frame(rows, TURNS))
    assert parts.where("conv_id = 1").count() > 100 and [r["alone"] for r in parts.where("conv_id = 2").collect()] == [True]
    whole = {r["conv_id"]: r for r in chat_format.join_parts(parts).collect()}
    for conv, some in convs.items():
        assert whole[conv]["formatted"] == written(some)
        spans = [whole[conv]["formatted"][s["start"] : s["start"] + s["length"]] for s in whole[conv]["spans"]]
        plain = [text for _, _, role, text in some if role == "assistant"]
        assert len(spans) == len(plain)
    assert read(parts)[1][0] == [(role, text) for _, _, role, text in convs[1]]
    digests = {r["conv_id"]: r for r in queries.format_report(chat_format.read_back(parts)).collect()}
    assert digests[1]["n_turns"] == 300 and digests[1]["formatted_chars"] == len(written(convs[1]))
    assert digests[1]["loss_chars"] == sum(len(t) for _, _, role, t in rows if role == "assistant")


def test_crowded_numbers_are_cut_again(frame, monkeypatch):
    monkeypatch.setattr(chat_format, "CROWDED_ROWS", 20)
    rows = [(1, None, "user", f"text {k}") for k in range(500)] + [(1, 7, "assistant", f"text {k}") for k in range(300)]
    rows += [(1, 8, "user", "last")] + [(1, 9, "user", "same")] * 50
    parts = chat_format.format_parts(frame(rows, TURNS))
    most = parts.select(F.size(F.split("formatted", r"\[\+\]")).alias("n")).agg(F.max("n")).first()[0]
    assert parts.count() > 30 and most <= 60
    turns, trained = read(parts)[1]
    assert sorted(turns[:500]) == sorted(("user", f"text {k}") for k in range(500))
    assert sorted(trained) == sorted(f"text {k}" for k in range(300))
    assert turns[800:] == [("user", "last")] + [("user", "same")] * 50
    again = read(chat_format.format_parts(frame(rows, TURNS, 7)))[1]
    assert again == (turns, trained)


def test_other_templates_and_empty_tables(frame):
    chatml = chat_format.Template(
        begin="<|begin|>", end="<|end|>", again="<|and|>",
        openers={"user": "<|user|>", "assistant": "<|model|>"}, other=("<|as|>", "<|says|>"),
    )
    rows = [(1, 0, "user", "<|model|>?"), (1, 1, "assistant", "a*b+c"), (1, 2, "critic", "")]
    parts = chat_format.format_parts(frame(rows, TURNS), chatml)
    text = "<|begin|><|user|><\\|model|>?<|model|>a*b+c<|end|><|as|>critic<|says|>"
    assert parts.first()["formatted"] == text
    back = chat_format.read_back(parts, chatml).first()
    assert [tuple(t) for t in back["turns"]] == [r[2:] for r in rows] and back["trained"] == ["a*b+c"]
    assert chat_format.read_back(chat_format.format_parts(frame([], TURNS))).count() == 0
    for wrong in ("s>", "<a<b>", "[\\]", "<"):
        with pytest.raises(ValueError):
            chat_format.Template(again=wrong)


def test_very_long_text(frame):
    rows = [(1, 0, "user", "[INST] " * 100_000), (1, 1, "assistant", "é" * 1_000_000)]
    parts = chat_format.format_parts(frame(rows, TURNS))
    assert read(parts)[1] == ([(r[2], r[3]) for r in rows], [rows[1][3]])
