"""Calls under watch and contexts of sessions as stateful operators of a stream, with timers.

Both need a state store that keeps many variables a key: ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Provider that the stateful operators here need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CallWatch(StatefulProcessor):
    """One call: its first start, speech and end. A timer stands at each moment that may end it, and tells the outcome when the watermark has passed it, so events that come late, but within
    the watermark's delay, still count, and a call ends without any further event. An ended call is remembered for ``remember`` seconds, so what follows it tells nothing."""

    def __init__(self, silence: float, cap: float, remember: float):
        self.silence, self.cap, self.remember = silence, cap, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "start double, speech double, hangup double, done boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        start, speech, hangup, done = self.seen.get() if self.seen.exists() else (None, None, None, False)
        least = lambda a, b: b if a is None else min(a, b)
        for r in rows:
            if r["kind"] == "start":
                start = least(start, r["at"])
            elif r["kind"] == "speech":
                speech = least(speech, r["at"])
            elif r["kind"] == "end":
                hangup = least(hangup, r["at"])
        if not done:
            moments = [hangup] if start is None else [start + self.silence, start + self.cap, hangup]
            for at in moments:
                if at is not None:
                    self.handle.registerTimer(int(at * 1000))
        if start is None and speech is not None and hangup is None:
            self.handle.registerTimer(int((speech + self.remember) * 1000))
        self.seen.update((start, speech, hangup, done))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N802, N803
        if not self.seen.exists():
            return
        now = expiredTimerInfo.getExpiryTimeInMs()
        start, speech, hangup, done = self.seen.get()
        if done or start is None:
            if done or now >= 1000 * ((speech or hangup or 0) + self.remember):
                self.seen.clear()
            elif hangup is not None:
                self.handle.registerTimer(int((max(speech or 0, hangup) + self.remember) * 1000))
            return
        quiet = None if speech is not None and speech <= start + self.silence else start + self.silence
        ends = [(at, rank, why) for rank, (at, why) in enumerate(((quiet, "initial_silence_timeout"), (start + self.cap, "max_duration_cap"), (hangup, "hangup"))) if at is not None and int(at * 1000) <= now]
        if ends:
            at, _, why = min(ends)
            self.seen.update((start, speech, hangup, True))
            self.handle.registerTimer(int(now + 1000 * self.remember))
            yield Row(call=key[0], ended_at=at, reason=why)

    def close(self) -> None:
        pass


def watched_calls_stream(events: DataFrame, call: str, ts: str, kind: str, minutes: float = 10, silence: float = 15, delay: str = "30 seconds", remember: float = 86_400.0) -> DataFrame:
    """call, ended_at (seconds since the epoch), reason, one row for each call when it ends: what the batch form gives when every timer up to the watermark has run."""
    rows = events.select(F.col(call).alias("call"), F.col(ts).cast("timestamp").alias("ts"), F.col(kind).alias("kind"), F.col(ts).cast("timestamp").cast("double").alias("at")).withWatermark("ts", delay)
    out = f"call {rows.schema['call'].dataType.simpleString()}, ended_at double, reason string"
    return rows.groupBy("call").transformWithState(CallWatch(silence, 60 * minutes, remember), out, "Append", "EventTime").withColumnRenamed("call", call)


class Context(StatefulProcessor):
    """One session: when it was last updated, how many updates its present life has, and the last value of each field. State that has not been touched for ``keep_ms`` of running time is dropped by the store itself."""

    def __init__(self, fields: list[str], tie: str, idle: float, keep_ms: int):
        self.fields, self.tie, self.idle, self.keep_ms = fields, tie, idle, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "at double, n long, " + ", ".join(f"`{f}` string" for f in self.fields), self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        at, n, *values = self.held.get() if self.held.exists() else (None, 0, *([None] * len(self.fields)))
        for r in sorted(rows, key=lambda r: (r["__at"], r[self.tie])):
            if at is not None and r["__at"] - at > self.idle:
                n, values = 0, [None] * len(self.fields)
            at, n = r["__at"], n + 1
            values = [v if r[f] is None else r[f] for f, v in zip(self.fields, values, strict=True)]
            yield Row(**{"__key": key[0], self.tie: r[self.tie], "turn_count": n, **dict(zip(self.fields, values, strict=True))})
        self.held.update((at, n, *values))

    def close(self) -> None:
        pass


def session_context_stream(updates: DataFrame, session: str, ts: str, tie: str, fields: list[str], idle: float = 1800.0, keep: float = 86_400.0) -> DataFrame:
    """session, tie, turn_count and the fields (strings) after each update: on updates that come in order, the rows of the batch form. A life ends when more than ``idle`` seconds pass between updates."""
    rows = updates.select(F.col(session).alias("__key"), tie, F.col(ts).cast("timestamp").cast("double").alias("__at"), *(F.col(f).cast("string").alias(f) for f in fields))
    kind = lambda c: rows.schema[c].dataType.simpleString()
    out = f"__key {kind('__key')}, `{tie}` {kind(tie)}, turn_count long, " + ", ".join(f"`{f}` string" for f in fields)
    return rows.groupBy("__key").transformWithState(Context(fields, tie, idle, int(keep * 1000)), out, "Append", "ProcessingTime").withColumnRenamed("__key", session)
