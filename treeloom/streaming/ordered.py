"""Streams out of order: rows wait in state until the watermark has passed them, and are then taken in the order of their
times, so shuffled micro-batches give what the batch forms of `live` give. Needs the RocksDB state store (use_state_store()).

Every stream here has `ts` (a timestamp with a watermark) and `seq` (long, the order of equal times). A row that comes after
the watermark has passed it is dropped by Spark, and nothing else is. What waits is what came within the watermark's delay; what
an operator itself holds goes when the watermark shows that it is not needed any more: the end of a pass, no tokens left, or, where
only silence can tell (sessions), after idle_ms without a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Emit = Callable[[tuple], None]


def use_state_store(spark: SparkSession) -> None:
    """The state store that map states and timers need. To be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Keeps rows back until the watermark has passed them. rows: the columns that wait, `at` (microseconds) and `seq` first;
    holds: what a key holds besides; out: the columns of what comes out.

    take() is called for every row in order with what is held (None: nothing) and says what is held from then on; settle() is
    called when all rows up to the watermark are taken, and wake() tells at which millisecond it wants to be called next."""

    rows = "at long, seq long"
    holds = "nothing boolean"
    out = ""

    def take(self, key: tuple, row: tuple, now: tuple | None, emit: Emit) -> tuple | None:
        raise NotImplementedError("an operator says what a row does")

    def settle(self, key: tuple, now: tuple | None, watermark: int, emit: Emit) -> tuple | None:
        return now

    def wake(self, now: tuple) -> int | None:
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.rows.split(", ")]
        self.told = [c.split()[0] for c in self.out.split(", ")]
        # Rows that are alike in all columns wait as one, with their number.
        self.waiting = handle.getMapState("waiting", self.rows, "n long")
        self.held = handle.getValueState("held", self.holds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[self.names].astype(object)
            for row in part.where(part.notna(), None).itertuples(index=False, name=None):
                many = self.waiting.getValue(row)
                self.waiting.updateValue(row, ((many[0] if many else 0) + 1,))
                first = row[0] if first is None else min(first, row[0])
        if first is not None and all(first <= (t - 1) * 1000 for t in self.handle.listTimers()):
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due, later, told = [], None, []
        for row, many in self.waiting.iterator():
            if row[0] <= watermark * 1000:
                due.append((tuple(row), many[0]))
            else:
                later = row[0] if later is None else min(later, row[0])
        now = tuple(self.held.get()) if self.held.exists() else None
        for row, many in sorted(due, key=lambda r: (r[0][0], r[0][1], repr(r[0]))):
            for _ in range(many):
                now = self.take(key, row, now, told.append)
            self.waiting.removeKey(row)
        now = self.settle(key, now, watermark, told.append)
        if now is None:
            self.held.clear()
        else:
            self.held.update(now)
        calls = [-(-later // 1000)] if later is not None else []
        calls += [c for c in [self.wake(now) if now is not None else None] if c is not None]
        if calls:
            # Whatever else is listed may be the timer that is going off now.
            self.handle.registerTimer(max(min(calls), watermark + 1))
        if told:
            yield pd.DataFrame(told, columns=self.told)

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: list[str], operator: InOrder) -> DataFrame:
    timed = rows.withColumn("at", F.unix_micros("ts")).where("at IS NOT NULL")
    names = [c.split()[0] for c in operator.rows.split(", ")]
    return timed.select("ts", *dict.fromkeys(key + names)).groupBy(*key).transformWithStateInPandas(operator, operator.out, "append", "EventTime")


class _Coalesced(InOrder):
    holds = "started long, n long"
    out = "vault_id long, started long, fires long, events long"

    def __init__(self, span_ms: int):
        self.span = span_ms

    def take(self, key, row, now, emit):
        ms = row[0] // 1000
        now = self.settle(key, now, ms, emit)
        return (now[0], now[1] + 1) if now else (ms, 1)

    def settle(self, key, now, watermark, emit):
        if now and now[0] + self.span < watermark:
            emit((key[0], now[0], now[0] + self.span, now[1]))
            return None
        return now

    def wake(self, now):
        return now[0] + self.span + 1


def coalesced_leading(events: DataFrame, span_ms: int) -> DataFrame:
    """events (vault_id, ts, seq) -> the passes of live.coalesced_leading(), each when the watermark reaches its end; then nothing of
    it is held."""
    return _run(events, ["vault_id"], _Coalesced(span_ms))


class _Reassembled(InOrder):
    rows = "at long, seq long, bytes long, is_last boolean"
    holds = "batch long, frames long, bytes long, last long"
    out = "session_id long, batch long, frames long, bytes long"

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def take(self, key, row, now, emit):
        batch, frames, size, _ = now or (0, 0, 0, 0)
        frames, size = frames + 1, size + (row[2] or 0)
        if row[3]:
            emit((key[0], batch, frames, size))
            batch, frames, size = batch + 1, 0, 0
        return batch, frames, size, row[0] // 1000

    def settle(self, key, now, watermark, emit):
        return None if now and now[3] + self.idle <= watermark else now

    def wake(self, now):
        return now[3] + self.idle


def reassembled(frames: DataFrame, idle_ms: int) -> DataFrame:
    """frames (session_id, ts: when sent, rising with seq, seq, bytes, is_last) -> the batches of live.reassembled(). A session
    without a frame for idle_ms is over, and what it left open is dropped."""
    return _run(frames, ["session_id"], _Reassembled(idle_ms))


class _Gated(InOrder):
    rows = "at long, seq long, path string, kind string"
    holds = "opened boolean"
    out = "vault_id long, path string, seq long, published timestamp"

    def init(self, handle):
        super().init(handle)
        self.paths = handle.getMapState("paths", "path string", "seq long")

    def take(self, key, row, now, emit):
        at, seq, path, kind = row
        when = pd.Timestamp(at, unit="us")
        if kind == "ready":
            if not now:
                for held, last in list(self.paths.iterator()):
                    emit((key[0], held[0], last[0], when))
                self.paths.clear()
            return (True,)
        if now:
            emit((key[0], path, seq, when))
            return now
        self.paths.updateValue((path,), (seq,))
        return None


def gated(edits: DataFrame) -> DataFrame:
    """edits (vault_id, ts, seq, path, kind) -> what live.gated() publishes, at the times that the watermark allows. Until a replica
    is ready its held paths are a map in state, one entry touched per edit; after that it holds that it is open, and no more."""
    return _run(edits, ["vault_id"], _Gated())


class _Unsuppressed(InOrder):
    rows = "at long, seq long, own boolean"
    holds = "tokens long"
    out = "room long, path string, seq long"

    def take(self, key, row, now, emit):
        tokens = now[0] if now else 0
        if row[2]:
            return (tokens + 1,)
        if not tokens:
            emit((key[0], key[1], row[1]))
        return (tokens - 1,) if tokens > 1 else None


def unsuppressed(events: DataFrame) -> DataFrame:
    """events (room, path, ts, seq, own) -> the rows of live.unsuppressed(). A path holds its tokens at hand, or nothing."""
    return _run(events, ["room", "path"], _Unsuppressed())


class _TimedOut(InOrder):
    rows = "at long, seq long, established boolean"
    holds = "began long, last long, closed boolean"
    out = "session string, began long, timed_out boolean"

    def __init__(self, budget_seconds: int, idle_ms: int):
        self.budget, self.idle = budget_seconds, max(idle_ms, budget_seconds * 1000 + 1000)

    def take(self, key, row, now, emit):
        second = row[0] // 1_000_000
        began, _, closed = now or (second, 0, False)
        if not closed and (row[2] or second > began + self.budget):
            emit((key[0], began, second > began + self.budget))
            closed = True
        return began, row[0] // 1000, closed

    def settle(self, key, now, watermark, emit):
        if now is None:
            return None
        began, last, closed = now
        if not closed and (began + self.budget + 1) * 1000 <= watermark:
            emit((key[0], began, True))
            closed = True
        return None if closed and last + self.idle <= watermark else (began, last, closed)

    def wake(self, now):
        return now[1] + self.idle if now[2] else (now[0] + self.budget + 1) * 1000


def timed_out(steps: DataFrame, budget_seconds: int, idle_ms: int) -> DataFrame:
    """steps (session, ts, seq, established) -> (session, began, timed_out) of live.timed_out(), as soon as the watermark tells. A
    session is kept until it has been silent for idle_ms, so that what comes late in it does not begin another one."""
    return _run(steps, ["session"], _TimedOut(budget_seconds, idle_ms))
