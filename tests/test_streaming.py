"""State machines and joins of streams: rows out of order, late rows, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.streaming import incremental, stateful

DAY = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def at(minutes):
    return DAY + dt.timedelta(minutes=minutes)


@pytest.fixture
def lands(spark, tmp_path):
    """Land rows as a further part and get the stream of all parts."""
    parts = {}

    def land(name, rows, schema):
        folder = tmp_path / name
        parts[name] = parts.get(name, 0) + 1
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/part={parts[name]}")
        return spark.readStream.schema(schema).parquet(f"{folder}/part=*")

    return land


CALL = "model string, example_id string, row_ordinal long, status string, at timestamp, more map<string,double>"


def test_first_row_by_time_whatever_lands_first(spark, lands, tmp_path):
    keys, place = ("model", "example_id"), str(tmp_path / "q")
    first = [
        ("m", "a", 5, "second", at(9), {"x": 0.1}),
        ("m", "b", 2, "tie", at(3), None),
        ("m", None, 1, "null key", at(1), None),
        ("m", "c", 1, "no time", None, None),
        ("m", "z", 9, "clock", at(30), None),
    ]
    second = [
        ("m", "a", 7, "first", at(8).replace(microsecond=123456), {"x": 1 / 3, "y": None}),
        ("m", "b", 1, "first", at(3), None),
        ("m", "b", None, "null order", at(3), None),
        ("m", "z", 10, "clock", at(200), None),
    ]
    third = [("m", "a", 1, "too late", at(7), None), ("m", "a", 2, "repeat", at(250), None), ("m", "z", 11, "clock", at(400), None)]
    seen = []
    for rows in (first, second, third):
        stream = lands("rows", rows, CALL)
        out = incremental.drain(stateful.first_rows(stream, "at", "row_ordinal", keys, "60 minutes"), "q", place=place, machine=True)
        seen.append({(r["example_id"], r["status"], r["row_ordinal"]) for r in out.collect()})
    assert seen[0] == set()
    assert seen[1] == {("a", "first", 7), ("b", "null order", None), (None, "null key", 1), ("z", "clock", 9)}
    assert seen[2] == seen[1]
    row = out.where("example_id = 'a'").first()
    assert row["more"] == {"x": 1 / 3, "y": None}
    assert out.where("example_id = 'a'").select(F.unix_micros("at")).first()[0] == int(at(8).timestamp()) * 10**6 + 123456
    assert stateful.held_rows(spark, f"{place}/state", out).count() == 0


def test_keys_are_forgotten_after_their_time(spark, lands, tmp_path):
    place = str(tmp_path / "q")
    for k, rows in enumerate(([("m", "a", 1, "x", at(0), None)], [("m", "a", 2, "repeat", at(100), None)], [("m", "a", 3, "again", at(5000), None)], [("m", "b", 4, "clock", at(9000), None)])):
        stream = lands("rows", rows, CALL)
        firsts = stateful.first_rows(stream, "at", "row_ordinal", ("model", "example_id"), "10 minutes", keep="1000 minutes")
        out = incremental.drain(firsts, "q", place=place, machine=True, state_partitions=3)
    assert sorted(r["row_ordinal"] for r in out.collect()) == [1, 3]
    assert [r["row_ordinal"] for r in stateful.held_rows(spark, f"{place}/state", out).collect()] == [4]


def _row_of_key(row):
    assert row["status"] == f"row\n{row['row_ordinal']}"
    return (row["model"], row["example_id"]), row["row_ordinal"]


def _by_text(pairs):
    return sorted(pairs, key=str)


def test_keys_of_a_bucket_are_held_together(spark, lands, tmp_path):
    """Buckets of many keys give what a plain loop over the rows gives, from one entry of state each."""
    rng, place, delay, keep, buckets = random.Random(5), str(tmp_path / "q"), 600, 900, 8
    names = [None, "", "null", 'a "quoted"\nline', *map(str, range(200))]
    held, gone, out, mark, ordinal = {}, {}, [], 0, 0
    for landing in range(4):
        rows = []
        for ordinal in range(ordinal + 1, ordinal + 601):
            key = (rng.choice(["m", None]), rng.choice(names))
            minute = rng.randrange(max(0, 700 * landing - 500), 700 * landing + 700)
            rows.append((*key, ordinal, f"row\n{ordinal}", at(minute), None))
            ms = int(at(minute).timestamp() * 1000)
            if ms > mark and (key not in gone or ms >= gone[key] + 1 + keep * 60000):
                held[key] = min(held.get(key, (ms, ordinal)), (ms, ordinal))
        gone = {key: ms for key, ms in gone.items() if key not in held}
        mark = max(mark, max(int(r[4].timestamp() * 1000) for r in rows) - delay * 60000)
        told = {key: first for key, first in held.items() if first[0] + 1 <= mark}
        held = {key: first for key, first in held.items() if key not in told}
        out += [(key, n) for key, (_, n) in told.items()]
        gone = {key: ms for key, ms in (gone | {key: ms for key, (ms, _) in told.items()}).items() if ms + 1 + keep * 60000 > mark}
        stream = lands("rows", rows, CALL)
        firsts = stateful.first_rows(
            stream, "at", "row_ordinal", ("model", "example_id"), f"{delay} minutes", f"{keep} minutes", buckets=buckets
        )
        got = incremental.drain(firsts, "q", place=place, machine=True, state_partitions=2)
        still = stateful.held_rows(spark, f"{place}/state", got)
        assert _by_text(_row_of_key(r) for r in got.collect()) == _by_text(out)
        assert _by_text(_row_of_key(r) for r in still.collect()) == _by_text((key, n) for key, (_, n) in held.items())
    assert len(out) > len({key for key, _ in out}) and len(held) > 10 * buckets
    entries = [stateful._state(spark, f"{place}/state", name).count() for name in ("held", "gone")]
    assert 0 < max(entries) <= buckets


LOG = "model string, error_type string, latency_ms double, at timestamp"


def test_windows_close_once_and_late_calls_come_out(spark, lands, tmp_path):
    place = str(tmp_path / "q")
    batches = [
        [("m", None, 10.0, at(1)), ("m", "E", None, at(4)), ("n", None, 4.0, at(12)), ("m", None, 1.0, at(40)), ("m", None, 1.0, None)],
        [("m", None, 99.0, at(2)), ("n", "E", 6.0, at(31)), ("m", None, 3.0, at(80))],
        [("m", None, 98.0, at(3)), ("k", None, None, at(41)), ("m", None, 5.0, at(200))],
    ]
    for rows in batches:
        stream = lands("calls", rows, LOG)
        windows = stateful.closing_windows(stream, "at", "5 minutes", "10 minutes", "60 minutes")
        out = incremental.drain(windows, "w", place=place, partition_by=("kind",), machine=True)
    like = spark.createDataFrame([], LOG)

    def told(rows):
        found = stateful.window_rows(rows, like).collect()
        return {(r["model"], int((r["window_start"].timestamp() - DAY.timestamp()) // 60)): (r["calls"], r["errors"], r["avg_latency_ms"]) for r in found}

    # After the first landing the clock is at 40 - 10, so that the window of minute 0 is closed; the
    # calls of minutes 2 and 3 are late, that of minute 41 is in a window that closed at 80 - 10.
    assert told(out.where("kind = 'closed'")) == {("m", 0): (2, 1, 10.0), ("n", 10): (1, 0, 4.0), ("n", 30): (1, 1, 6.0), ("m", 40): (1, 0, 1.0), ("m", 80): (1, 0, 3.0)}
    assert sorted((r["model"], r["latency_ms"]) for r in stateful.late_rows(out, like).collect()) == [("k", None), ("m", 99.0)]
    assert told(stateful.open_windows(spark, f"{place}/state")) == {("m", 200): (1, 0, 5.0)}


KEYS = "dataset_name string, model string, example_id string"
ASKED = f"{KEYS}, requested_at timestamp, request_status string, error_type string, error_message string"
ANSWERED = (
    f"{KEYS}, responded_at timestamp, response_status string, response_text string, latency_ms double, usage struct<total_tokens:bigint>, "
    "error_type string, error_message string"
)


def test_requests_and_responses_meet_or_are_given_up(spark, lands, tmp_path):
    place = str(tmp_path / "q")
    ask = lambda k, m: ("d", "m", k, at(m), "ready", None, None)
    say = lambda k, m, text, status="success": ("d", "m", k, at(m), status, text, 1.0, (7,), None if status == "success" else "Bad", None)
    landings = [
        ([ask("a", 0), ask("b", 1), ask("c", 2), ask("late", 3), ask("x", 300)], [say("a", 5, "one"), say("a", 5, "one"), say("b", 6, None, "error"), say("early", 290, "response first")]),
        ([ask("early", 289), ask("y", 700)], [say("c", 200, "past its time"), say("x", 310, "two"), say("y", 701, "three")]),
        ([ask("z", 1000)], [say("late", 10, "landed too late"), say("z", 1001, "four")]),
    ]
    for asked, answered in landings:
        requests, responses = lands("requests", asked, ASKED), lands("responses", answered, ANSWERED)
        answers = incremental.answered_requests(requests, responses, "run", timeout="60 minutes", delay="120 minutes")
        out = incremental.drain(answers, "q", place=place)
    got = sorted((r["example_id"], r["status"], r["response_text"], r["error_type"]) for r in out.collect())
    assert got == [
        ("a", "success", "one", None), ("b", "error", None, "Bad"), ("c", "error", None, "MissingResponse"),
        ("early", "success", "response first", None), ("late", "error", None, "MissingResponse"), ("x", "success", "two", None),
        ("y", "success", "three", None), ("z", "success", "four", None),
    ]
    landed = spark.read.schema(ANSWERED).parquet(str(tmp_path / "responses"))
    assert sorted(r["example_id"] for r in incremental.late_responses(landed, out).collect()) == ["c", "late"]
    assert incremental.waiting_requests(spark.createDataFrame([ask("w", 999), ask("a", 0)], ASKED), out).first()["example_id"] == "w"


def test_a_replayed_batch_changes_nothing(spark, lands, tmp_path):
    place = str(tmp_path / "q")
    kind = "dataset_name string, model string, status string"
    for rows in ([("d", "m", "success")], [("d", "m", "error"), ("d", "n", "success")]):
        out = incremental.drain(incremental.progress(lands("rows", rows, kind)), "q", running_totals=True, place=place)
    expected = {("m", 2, 1, 1), ("n", 1, 1, 0)}
    read = lambda df: {(r["model"], r["attempted"], r["completed"], r["failed"]) for r in df.collect()}
    assert read(out) == expected
    table = incremental.CommittedTable(spark, f"{place}/table")
    number = table.numbers()[-1]
    assert not incremental.publish(out.limit(1), number, table)
    assert read(table.read(incremental.columns_of(out))) == expected and table.numbers()[-1] == number
