"""Conversation repair against an exhaustive search, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib

from tallyframe.llm import queries, turn_repair

TURNS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def fault_of(role, text, seen):
    visible = (text or " ").rstrip(" \t\n\x0b\x0c\r")
    if text is not None and not text.strip(" \t\n\x0b\x0c\r") or text is None:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    return "truncated" if visible[-1] not in ".!?" else "fine"


def cheapest(rows):
    """Least (cost, audit) and its lines by a uniform-cost search over all edits; no dynamic programme."""
    seen, faults = set(), []
    for role, text in rows:
        faults.append(fault_of(role, text, seen))
        seen.add((role, text))
    queue = [(0, "", 0, "", ())]
    while queue:
        cost, audit, at, roles, lines = heapq.heappop(queue)
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, faults, lines
        if len(roles) > 2 * len(rows) + 2 or not LEGAL.fullmatch(roles + "a") and not LEGAL.fullmatch(roles + "ua"):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, audit + "I", at, roles + role[0], (*lines, f"{role}:")))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(queue, (cost + 4, audit + "D", at + 1, roles, lines))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 if faults[at] == "truncated" else 0
                heapq.heappush(queue, (cost + extra, audit + "K", at + 1, roles + (role[:1] or "-"), (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 3 + extra, audit + "R", at + 1, roles + new[0], (*lines, f"{new}:{text}")))


def report(frame, rows, parts=3, schema=TURNS, **columns):
    edited = turn_repair.repair(frame(rows, schema, parts), **columns)
    return {r["conv_id"]: r for r in queries.repair_report(edited).collect()}


def test_edits_are_the_cheapest_and_first_in_order(frame):
    draw = random.Random(4)
    roles = ["system", "user", "assistant", "tool", "", "user", "assistant"]
    texts = ["yes.", "no!", "cut", "", " \n", "why? ", "x.y"]
    rows = [
        (conv, turn, draw.choice(roles), draw.choice(texts))
        for conv in range(120)
        for turn in range(draw.randrange(1, 7))
    ]
    got = report(frame, rows)
    assert len(got) == 120
    for conv in range(120):
        turns = [(role, text) for c, _, role, text in rows if c == conv]
        cost, audit, faults, lines = cheapest(turns)
        found = got[conv]
        assert (found["cost"], found["audit"]) == (cost, audit), turns
        assert found["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert [found[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(turns, turns[1:])]
        assert found["illegal"] == sum(pair not in ("su", "ua", "au") for pair in pairs)


def test_odd_rows(frame):
    rows = [
        (1, None, "user", "q?", 1),
        (1, 5, "assistant", "a.", 2),
        (1, 5, "assistant", "a.", 3),
        (1, 9, "user", "é" * 300_000, 4),
        (2, 3, None, None, 5),
        (None, 1, "user", "who?", 6),
        (None, 2, "assistant", "me.", 7),
        (3, 2**53 + 1, "user", "b?", 8),
        (3, 2**53 + 3, "assistant", "c.", 9),
    ]
    columns = TURNS + ", edit int"
    for parts in (1, 4):
        got = report(frame, rows, parts, columns)
        assert set(got) == {1, 2, 3, None}
        assert (got[1]["gaps"], got[1]["duplicate"], got[1]["truncated"], got[1]["audit"]) == (3, 1, 1, "KKDD")
        assert (got[2]["audit"], got[2]["blank"], got[2]["repaired_sha256"]) == ("D", 1, hashlib.sha256(b"").hexdigest())
        assert got[None]["repaired_sha256"] == hashlib.sha256(b"user:who?\nassistant:me.").hexdigest()
        assert (got[3]["gaps"], got[3]["audit"]) == (1, "KK")
    assert report(frame, []) == {}


def test_dropped_turns_keep_their_conversation(frame):
    rows = [(7, 0, "user", "x.", True), (8, 0, "user", "x.", False), (8, 1, "user", "y.", True)]
    got = report(frame, rows, schema=TURNS + ", gone boolean", absent="gone")
    assert (got[7]["cost"], got[7]["audit"], got[7]["gaps"]) == (0, "", 0)
    assert got[7]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert (got[8]["cost"], got[8]["audit"]) == (3, "KI")


def test_giant_conversation_passes_in_batches(spark, frame):
    """60,000 turns of one conversation, far more than a batch; every third answer is missing."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(60_000) if k % 6 != 5]
    rows += [(2, 0, "user", "a?"), (2, 1, "assistant", "b.")]
    got = report(frame, rows)
    assert got[1]["cost"] == 3 * 10_000 and got[1]["audit"] == "KKKKKI" * 10_000
    assert got[1]["gaps"] == 10_000 - 1 and got[2]["audit"] == "KK"


def test_damage_follows_the_checksum(frame):
    rows = [(c, t, "assistant", "a. b! c?") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    out = queries.damaged_turns(frame(rows, TURNS)).collect()
    by_key = {}
    for r in out:
        by_key.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["gone"]))
    seen = set()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        seen.add(fate)
        role, text = role or " ", text or " "
        one = {1: (role, "", False), 2: (role, text.translate({46: None, 33: None, 63: None}), False), 4: ("user", text, False)}.get(fate, (role, text, fate == 0))
        assert by_key[c, t] == [one] * (2 if fate == 3 else 1)
    assert seen >= {0, 1, 2, 3, 4}
