"""Keyed state machines over growing logs: value states that timers of the event time close.

All state is in the state store of the query's checkpoint, so that a restarted query goes on where it
ended. What a machine still holds can be read from there as a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyframe.operators.predictions import PAIR_KEYS

_STORE = "spark.sql.streaming.stateStore"
_MACHINES = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch saves what it changed instead of whole files.
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
}
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


@contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None, machine: bool = True):
    """Settings that a stream with state is started with: for a ``machine`` a store on disk, and the
    number of partitions of the state, by default that of shuffles, which stays for the life of the
    checkpoint. Every partition costs files in each batch, so that small logs want few."""
    wanted = (_MACHINES if machine else {}) | ({} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _packed(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), _TIMES)


def _unpacked(df: DataFrame, column: str, like: DataFrame) -> DataFrame:
    # A stream's schema says where its watermark is; the text of the types does not.
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in like.dtypes)
    return df.select(F.from_json(column, kinds, _TIMES).alias("_row")).select("_row.*")


class _FirstRows(StatefulProcessor):
    """Holds the first row of each key of a bucket until no earlier one can come, lets it out once, and
    remembers that it did for ``keep_ms`` more of event time, or for good.

    A call to the state takes far longer than a row, so that a bucket's keys are read and saved
    together and share one timer, at the next time that one of them has something to do."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "keys array<string>, micros array<long>, places array<long>, rows array<string>")
        self.gone = handle.getValueState("gone", "keys array<string>, micros array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, gone = self._load()
        found = {}
        for _, _, line in rows:
            micros, place, name, row = line.split("\n")
            micros, place = int(micros), int(place)
            if name in gone and not self._forgotten(gone[name], micros // 1000):
                continue
            best = found.get(name) or held.get(name)
            if best is None or (micros, place) < best[:2]:
                found[name] = (micros, place, row)
        if not found:
            return iter([])
        due = self._due(held, gone)
        again = gone.keys() & found.keys()
        held |= found
        gone = {name: micros for name, micros in gone.items() if name not in again}
        self._save_held(held)
        if again:
            self._save_gone(gone)
        next_due = self._due(held, gone)
        if next_due != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(next_due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, gone = self._load()
        now = timerValues.getCurrentWatermarkInMs()
        out = {name: first for name, first in held.items() if _after(first[0]) <= now}
        if out:
            held = {name: first for name, first in held.items() if name not in out}
            self._save_held(held)
        told = gone | {name: micros for name, (micros, _, _) in out.items()}
        kept = {name: micros for name, micros in told.items() if not self._forgotten(micros, now)}
        if kept != gone:
            self._save_gone(kept)
        due = self._due(held, kept)
        if due is not None:
            self.handle.registerTimer(due)
        for _, _, row in out.values():
            yield Row(row=row)

    def close(self) -> None:
        pass

    def _forgotten(self, micros: int, now: int) -> bool:
        """Whether a key whose row of that time came out is no longer remembered."""
        return self.keep_ms is not None and now >= _after(micros) + self.keep_ms

    def _due(self, held: dict, gone: dict) -> int | None:
        """When the next row can come out or the next key is forgotten."""
        times = [_after(min(first[0] for first in held.values()))] if held else []
        if self.keep_ms is not None and gone:
            times.append(_after(min(gone.values())) + self.keep_ms)
        return min(times, default=None)

    def _load(self) -> tuple[dict, dict]:
        keys, *firsts = self.held.get() or ((), (), (), ())
        return dict(zip(keys, zip(*firsts))), dict(zip(*(self.gone.get() or ((), ()))))

    def _save_held(self, held: dict) -> None:
        if held:
            self.held.update((list(held), *map(list, zip(*held.values()))))
        else:
            self.held.clear()

    def _save_gone(self, gone: dict) -> None:
        if gone:
            self.gone.update((list(gone), list(gone.values())))
        else:
            self.gone.clear()


def _after(micros: int) -> int:
    """The first whole millisecond after a time: once the watermark is there, no such time can come."""
    return micros // 1000 + 1


def first_rows(
    rows: DataFrame,
    event_time: str,
    order: str,
    keys: Sequence[str] = PAIR_KEYS,
    delay: str = "1 day",
    keep: str | None = None,
    buckets: int = 4096,
) -> DataFrame:
    """The first row of each key by event time and a whole-number ``order``, once, whatever the order
    in which rows land.

    A row comes out when the watermark, ``delay`` behind the latest event time, has passed it, as only
    then no earlier one can land; rows behind the watermark are dropped. A key that came out is
    remembered for good, or for ``keep`` of event time. A null order comes first; rows without an event
    time are dropped. ``held_rows`` reads the rows that still wait.

    The state is kept by ``buckets`` of keys, whose number stays for the life of the checkpoint. A batch
    reads and saves each bucket that it touches whole, so that a bucket should hold some thousand keys
    at most.
    """
    machine = _FirstRows(None if keep is None else _milliseconds(rows.sparkSession, keep))
    place = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    at = F.col(event_time).cast("timestamp")
    # Python gets rows value by value, and takes the columns by place. JSON has no bare line breaks.
    line = F.concat_ws("\n", F.unix_micros(at), place, F.to_json(F.struct(*keys), _TIMES), _packed(rows))
    packed = rows.where(F.col(event_time).isNotNull()).select(
        F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), at.alias("_at"), line.alias("_line")
    )
    out = (
        packed.withWatermark("_at", delay)
        .groupBy("_bucket")
        .transformWithState(machine, "row string", "Append", "EventTime")
    )
    return _unpacked(out, "row", rows)


def held_rows(spark: SparkSession, checkpoint: str, like: DataFrame) -> DataFrame:
    """Rows that ``first_rows`` still holds back, from the state of its last run."""
    state = _state(spark, checkpoint, "held").select(F.explode("value.rows").alias("row"))
    return _unpacked(state, "row", like)


# Places of the columns: the machine gets them by place, not by name.
_CALLS = ("_start", "_keys", "_at", "_failed", "_latency", "_row")
_FAILED, _LATENCY, _ROW = 3, 4, 5


class _CallWindow(StatefulProcessor):
    """Sums a window's calls until it closes; calls of closed windows are passed on one by one."""

    def __init__(self, width_ms: int, grace_ms: int):
        self.width_ms, self.grace_ms = width_ms, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "calls long, errors long, timed long, latency double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start = int(key[0])
        closing = start + self.width_ms - self.grace_ms
        if timerValues.getCurrentWatermarkInMs() >= closing:
            for batch in rows:
                yield _window_rows("late", start, row=batch.iloc[:, _ROW].tolist())
            return
        if self.sums.exists():
            calls, errors, timed, latency = self.sums.get()
        else:
            calls, errors, timed, latency = 0, 0, 0, 0.0
            self.handle.registerTimer(closing)
        for batch in rows:
            failed, known = batch.iloc[:, _FAILED], batch.iloc[:, _LATENCY].dropna()
            calls, errors = calls + len(batch), errors + int(failed.sum())
            timed, latency = timed + len(known), latency + float(known.sum())
        self.sums.update((calls, errors, timed, latency))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        calls, errors, timed, latency = self.sums.get()
        self.sums.clear()
        yield _window_rows("closed", int(key[0]), [key[1]], [calls], [errors], [timed], [latency])

    def close(self) -> None:
        pass


_WINDOW = "kind string, start long, keys string, calls long, errors long, timed long, latency double, row string"


def _window_rows(kind: str, start: int, keys=None, calls=None, errors=None, timed=None, latency=None, row=None) -> pd.DataFrame:
    n = len(row if row is not None else calls)
    columns = {"kind": [kind] * n, "start": [start] * n, "keys": keys, "calls": calls, "errors": errors, "timed": timed,
               "latency": latency, "row": row}
    return pd.DataFrame({name: [None] * n if values is None else values for name, values in columns.items()})


def closing_windows(
    calls: DataFrame,
    event_time: str = "started_at",
    width: str = "5 minutes",
    delay: str = "10 minutes",
    grace: str = "1 day",
    keys: Sequence[str] = ("model",),
) -> DataFrame:
    """Tumbling windows that close, and the calls that came too late for theirs.

    A window closes once the latest event time is ``delay`` past its end: its sums come out once, with
    ``kind`` ``closed``, and its state is dropped. Later calls of it come out as they are, in ``row``,
    with ``kind`` ``late``; those more than ``grace`` later still are dropped by the watermark and only
    counted in the query's progress. Calls without a time are dropped. Written with ``partitionBy``
    kind, the two are tables of their own; ``window_rows`` and ``late_rows`` read them and
    ``open_windows`` reads the windows that have not closed.
    """
    spark = calls.sparkSession
    width_ms, grace_ms = _milliseconds(spark, width), _milliseconds(spark, grace)
    delay_ms = _milliseconds(spark, delay)
    at = F.unix_micros(F.col(event_time).cast("timestamp"))
    slim = calls.where(F.col(event_time).isNotNull()).select(
        (F.floor(at / (width_ms * 1000)) * width_ms).cast("long").alias("_start"),
        F.to_json(F.struct(*keys)).alias("_keys"),
        F.col(event_time).cast("timestamp").alias("_at"),
        F.col("error_type").isNotNull().alias("_failed"),
        F.col("latency_ms").cast("double").alias("_latency"),
        _packed(calls).alias("_row"),
    )
    return (
        slim.select(*_CALLS)
        .withWatermark("_at", f"{delay_ms + grace_ms} milliseconds")
        .groupBy("_start", "_keys")
        .transformWithStateInPandas(_CallWindow(width_ms, grace_ms), _WINDOW, "Append", "EventTime")
    )


def window_rows(windows: DataFrame, like: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Closed windows, or open ones, with their figures."""
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in like.select(*keys).dtypes)
    return windows.select(
        F.timestamp_millis("start").alias("window_start"),
        F.from_json("keys", kinds).alias("_keys"),
        "calls",
        "errors",
        (F.col("errors") / F.col("calls")).alias("error_rate"),
        F.try_divide("latency", "timed").alias("avg_latency_ms"),
    ).select("window_start", "_keys.*", "calls", "errors", "error_rate", "avg_latency_ms")


def late_rows(windows: DataFrame, like: DataFrame) -> DataFrame:
    """The calls that came after their window had closed, as they came."""
    return _unpacked(windows.where("kind = 'late'"), "row", like)


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Windows that have not closed, from the state of the query's last run."""
    state = _state(spark, checkpoint, "sums")
    return state.select(F.col("key._start").alias("start"), F.col("key._keys").alias("keys"), "value.*")


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    with keyed_state(spark):
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


def _milliseconds(spark: SparkSession, interval: str) -> int:
    """Length of an interval text of days or less."""
    seconds = F.unix_micros(F.expr(f"timestamp_seconds(0) + INTERVAL '{interval}'"))
    return spark.range(1).select(seconds).first()[0] // 1000
