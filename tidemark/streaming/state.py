"""Keyed state of streams: first receipts, log tails by offset, session days.

State lives in the state store (RocksDB) under each key, so a batch reads no
earlier output and a key costs the same however long the stream has run.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Session days close at this market time.
CLOSES_AT = (17, 30)
DAY_MS = 86_400_000


def fields_of(df: DataFrame, names: Sequence[str]) -> str:
    """The DDL of some columns."""
    return ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in names)


def plain(value: Any) -> Any:
    """A pandas cell as a Python value; missing as None."""
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


# -- first receipt ------------------------------------------------------------------


class FirstSeen(StatefulProcessor):
    """Emits a key with its least receipt in the first batch that has it, and forgets it after ``ttl_ms``."""

    def __init__(self, keys: Sequence[str], received: str, kind: str, ttl_ms: int):
        self.keys, self.received, self.kind, self.ttl_ms = list(keys), received, kind, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("first", f"first {self.kind}", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [part[self.received].dropna() for part in rows]
        if self.seen.exists():
            return
        lows = [part.min() for part in found if len(part)]
        first = plain(min(lows)) if lows else None
        self.seen.update((first,))
        yield pd.DataFrame({**{name: [value] for name, value in zip(self.keys, key, strict=True)}, "first_seen_at": [first]})

    def close(self) -> None:
        pass


def least_received(rows: DataFrame, keys: Sequence[str], received: str) -> DataFrame:
    """One row (keys, ``first_seen_at``) for each key that a task has, with its least receipt; no state.

    A task holds its distinct keys of one micro-batch.
    """
    names = [*keys, "first_seen_at"]
    schema = rows.select(*keys, F.col(received).alias("first_seen_at")).schema

    def least(table: pa.Table) -> pa.Table:
        return table.group_by(names[:-1]).aggregate([("first_seen_at", "min")]).rename_columns({"first_seen_at_min": "first_seen_at"}).select(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for record in batches:
            held.append(least(pa.Table.from_batches([record.rename_columns(names)])))
            waiting += len(held[-1])
            if len(held) > 1 and waiting > 2 * len(held[0]) + 100_000:  # the first holds what was joined so far
                held = [least(pa.concat_tables(held))]
                waiting = len(held[0])
        if held:
            yield from least(pa.concat_tables(held)).to_batches(max_chunksize=10_000)

    return rows.select(*keys, received).mapInArrow(run, schema)


def first_seen(stream: DataFrame, keys: Sequence[str], received: str, ttl_ms: int | None = None) -> DataFrame:
    """Each key once, with ``first_seen_at``, however long ago it came and however often it comes again.

    A micro-batch's keys are reduced to their least receipts first, inside tasks
    before and after one exchange; Spark's own deduplication then keeps the keys
    that no earlier batch had. With ``ttl_ms`` a key is forgotten that long (by
    the wall clock) after it was recorded, which takes a Python call a key.
    """
    if ttl_ms is None:
        once = least_received(least_received(stream, keys, received).repartition(*keys), keys, "first_seen_at")
        return once.dropDuplicates(list(keys))
    kind = stream.schema[received].dataType.simpleString()
    processor = FirstSeen(keys, received, kind, ttl_ms)
    return stream.select(*keys, received).groupBy(*keys).transformWithStateInPandas(
        processor, f"{fields_of(stream, keys)}, first_seen_at {kind}", "Update", "ProcessingTime")


# -- log tails -----------------------------------------------------------------------


#: Offsets that one key of the state covers, so that a hot log is many keys.
OFFSETS_A_BLOCK = 100_000


def add_offsets(held: list[tuple[int, int]], offsets: Sequence[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Ranges [start, end) of offsets read so far with further ones, and those that were new."""
    fresh = set()
    for n in offsets:
        at = bisect_right(held, (n, float("inf"))) - 1
        if at < 0 or n >= held[at][1]:
            fresh.add(n)
    merged: list[tuple[int, int]] = []
    for a, b in sorted([*held, *((n, n + 1) for n in fresh)]):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, fresh


class TailCounter(StatefulProcessor):
    """Counts the lines of a block of a log by type; a line that comes twice (by offset) counts once."""

    def __init__(self, log: str, kind: str, offset: str):
        self.log, self.kind, self.offset = log, kind, offset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "starts array<bigint>, ends array<bigint>, kinds array<string>, counts array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ranges, counts = [], {}
        if self.state.exists():
            starts, ends, kinds, held = self.state.get()
            ranges, counts = list(zip(starts, ends, strict=True)), dict(zip(kinds, held, strict=True))
        changed = set()
        for part in rows:
            part = part.drop_duplicates(self.offset)
            ranges, fresh = add_offsets(ranges, [int(n) for n in part[self.offset]])
            for kind, n in part[part[self.offset].isin(fresh)][self.kind].value_counts().items():
                counts[kind] = counts.get(kind, 0) + int(n)
                changed.add(kind)
        self.state.update(([a for a, _ in ranges], [b for _, b in ranges], list(counts), list(counts.values())))
        if changed:
            names = sorted(changed)
            yield pd.DataFrame({self.log: [key[0]] * len(names), "block": [key[1]] * len(names), self.kind: names, "events": [counts[k] for k in names]})

    def close(self) -> None:
        pass


def tail_counts(stream: DataFrame, log: str = "run_id", kind: str = "event_type", offset: str = "seq") -> DataFrame:
    """Running counts of the types a batch touched, by block of offsets. A log appended in order keeps one range a block."""
    blocks = stream.select(log, kind, F.col(offset).cast("long").alias(offset), F.floor(F.col(offset) / OFFSETS_A_BLOCK).cast("long").alias("block"))
    return blocks.groupBy(log, "block").transformWithStateInPandas(
        TailCounter(log, kind, offset), f"{fields_of(stream, [log])}, block bigint, {fields_of(stream, [kind])}, events bigint", "Update", "None")


# -- session days ----------------------------------------------------------------------


def closes_ms(day: str) -> int:
    """The instant (UTC as market time) a session day YYYYMMDD or YYYY-MM-DD closes, in milliseconds."""
    return int(datetime.strptime(day.replace("-", ""), "%Y%m%d").replace(hour=CLOSES_AT[0], minute=CLOSES_AT[1], tzinfo=timezone.utc).timestamp() * 1000)


class SessionDay(StatefulProcessor):
    """Holds a name's bars of a day, emits them when the day closes, and again when a late bar comes.

    A day is kept for late bars until ``keep_days`` after its close; a bar later
    than that is emitted alone as stale.
    """

    def __init__(self, day: list[str], columns: list[str], state: str, keep_days: int | None):
        self.day, self.columns, self.schema, self.keep_days = day, columns, state, keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", self.schema)
        self.phase = handle.getValueState("phase", "phase int")

    def _rows(self, key, rows: Sequence[tuple], status: str) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[*self.columns, "received_at"])
        # Of one label's bars the last received counts.
        frame = frame.sort_values("received_at", kind="stable").drop_duplicates("trade_time", keep="last")
        for name, value in zip(self.day, key, strict=True):
            frame[name] = value
        return frame[[*self.day, *self.columns]].assign(status=status)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(plain(v) for v in row) for part in rows for row in part[[*self.columns, "received_at"]].itertuples(index=False, name=None)]
        phase = self.phase.get()[0] if self.phase.exists() else 0
        if phase == 2:
            yield self._rows(key, new, "stale")
            return
        self.bars.appendList(new)
        closes = closes_ms(key[1])
        if timerValues.getCurrentWatermarkInMs() >= closes:
            if phase == 0:
                self._closed(closes)
            yield self._rows(key, list(self.bars.get()), "day")
        elif phase == 0 and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(closes)

    def _closed(self, closes: int) -> None:
        self.phase.update((1,))
        if self.keep_days is not None:
            self.handle.registerTimer(closes + self.keep_days * DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        phase, closes = self.phase.get()[0] if self.phase.exists() else 0, closes_ms(key[1])
        if phase == 0:
            self._closed(closes)
            yield self._rows(key, list(self.bars.get()), "day")
        elif phase == 1 and expiredTimerInfo.getExpiryTimeInMs() > closes:  # a late bar may have closed the day before its timer
            self.bars.clear()
            self.phase.update((2,))

    def close(self) -> None:
        pass


def closed_days(stream: DataFrame, columns: Sequence[str], received: str = "received_at", delay: str = "0 seconds", keep_days: int | None = None) -> DataFrame:
    """The bars of session days that closed, or changed after they closed: ``ts_code, trade_date``, columns, ``status``.

    The clock is the watermark over ``received``: a bar is late by when it came,
    never lost by when it traded.
    """
    day = ["ts_code", "trade_date"]
    columns = [c for c in columns if c not in day]
    clocked = stream.select(*day, *columns, F.col(received).cast("timestamp").alias("received_at")).withWatermark("received_at", delay)
    state = f"{fields_of(stream, columns)}, received_at timestamp"
    out = StructType([*(stream.schema[c] for c in (*day, *columns))]).add("status", "string")
    return clocked.groupBy(*day).transformWithStateInPandas(SessionDay(day, columns, state, keep_days), out, "Update", "EventTime")
