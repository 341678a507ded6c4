"""Session rules over event streams: accepted-only rate limits, fixed windows, the daily breaker, change data.

The state functions run on a stream (applyInPandasWithState) and, with the same code, over one batch (a grouped replay).
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding(times: list[float], accepted: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Which events a log of accepted ones lets pass; refused events leave no trace. Bounded by ``limit`` entries."""
    out, log = [], sorted(accepted)
    for t in times:
        del log[: bisect_right(log, t - window)]
        out.append(len(log) < limit)
        if out[-1]:
            insort(log, t)
    return out, log


def fixed(times: list[float], state: tuple[int, float], limit: int, window: float) -> tuple[list[bool], tuple[int, float]]:
    """Windows that begin with their first event; refused events count."""
    count, until = state
    out = []
    for t in times:
        if t >= until:
            count, until = 0, t + window
        count += 1
        out.append(count <= limit)
    return out, (count, until)


def rate_limited(events: DataFrame, key: str, ts: str, tie: str, limit: int = 15, window: float = 60.0, rule: str = "sliding") -> DataFrame:
    """Batch replay: adds ``allowed``. ``rule`` is sliding (refused events leave no trace) or fixed (windows begin with their first event, refused events count). A key's events come to one task in order, as the rule is sequential, and stream through it in batches: what a task holds is the log of one key,
    ``limit`` times at most. Only key, time and tie travel; rows without a key are one key.
    """
    rows = events.select(key, tie, F.col(ts).cast("timestamp").cast("double").alias("__t"))
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, {tie} {rows.schema[tie].dataType.simpleString()}, allowed boolean"

    step, empty = {"sliding": (sliding, []), "fixed": (fixed, (0, float("-inf")))}[rule]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, who, log = False, None, empty
        for batch in batches:
            allowed, times = [], zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for k, run in groupby(times, key=lambda x: x[0]):
                if not started or k != who:
                    started, who, log = True, k, empty
                passed, log = step([t for _, t in run], log, limit, window)
                allowed += passed
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], names=[key, tie, "allowed"])

    return rows.repartition(key).sortWithinPartitions(key, "__t", tie).mapInArrow(replay, kind)


def turn_capped(turns: DataFrame, session: str, order: str, most: int = 30) -> DataFrame:
    """Adds current_turn (it stops at ``most``) and allowed. Sessions are named without regard to case and outer blanks; turns without a session are all allowed and count as first ones."""
    name = F.lower(F.trim(F.coalesce(F.col(session).cast("string"), F.lit(""))))
    named = turns.withColumn("__s", name)
    rank = F.row_number().over(Window.partitionBy("__s").orderBy(order))
    capped = named.where("__s <> ''").withColumn("__n", rank)
    capped = capped.withColumn("current_turn", F.least(F.col("__n"), F.lit(most))).withColumn("allowed", F.col("__n") <= most).drop("__n")
    free = named.where("__s = ''").withColumn("current_turn", F.lit(1)).withColumn("allowed", F.lit(True))
    return capped.unionByName(free).drop("__s")


def rate_limited_stream(events: DataFrame, key: str, ts: str, tie: str, limit: int = 15, window: float = 60.0, idle: str = "2 hours") -> DataFrame:
    """The same rule on a stream: the state is the log of accepted times, dropped when a session has been idle."""
    rows = events.select(key, tie, F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", idle)
    kind = f"{key} {rows.schema[key].dataType.simpleString()}, {tie} {rows.schema[tie].dataType.simpleString()}, allowed boolean"

    def update(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["ts", tie])
        allowed, log = sliding([t.timestamp() for t in frame["ts"]], log, limit, window)
        state.update((log,))
        state.setTimeoutTimestamp(int(frame["ts"].max().timestamp() * 1000) + 7_200_000)
        yield pd.DataFrame({key: who[0], tie: frame[tie], "allowed": allowed})

    return rows.groupBy(key).applyInPandasWithState(update, kind, "log array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, key: str, ts: str, idle: str = "2 hours") -> DataFrame:
    """One row a session: bounds and number of events; the same on streams with a watermark."""
    return events.groupBy(key, F.session_window(ts, idle).alias("s")).agg(F.count("*").alias("events")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def watched_calls(events: DataFrame, call: str, ts: str, kind: str, minutes: float = 10, silence: float = 15, until: Column | None = None) -> DataFrame:
    """call, ended_at (seconds since the epoch), reason of each call with a start: hung up (an ``end``), initial_silence_timeout (no ``speech`` within ``silence`` seconds of the start) or
    max_duration_cap; null where the call is still open at its last event, or at ``until`` (seconds since the epoch) where that is given. Speech disarms the silence watchdog for good.

    Times count from the start, as events need not come in order; of several starts the first counts. One aggregation with partial steps.
    """
    at = F.col(ts).cast("timestamp").cast("double")
    when = lambda name: F.min(F.when(F.col(kind) == name, at))
    calls = events.groupBy(call).agg(when("start").alias("start"), when("speech").alias("speech"), when("end").alias("end"), (F.max(at) if until is None else F.max(until)).alias("seen")).where("start is not null")
    quiet = F.when(F.coalesce(F.col("speech") > F.col("start") + silence, F.lit(True)), F.col("start") + silence)
    cap = F.col("start") + minutes * 60
    due = lambda t: F.when(t <= F.col("seen"), t)
    first = F.least(due(quiet), due(cap), F.col("end"))
    reason = F.when(first == due(quiet), "initial_silence_timeout").when(first == due(cap), "max_duration_cap").when(first == F.col("end"), "hangup")
    return calls.select(call, first.alias("ended_at"), reason.alias("reason"))


def last_write(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(value, order).alias(value))


def apply_changes(target: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the latest change of each key replaces its row, deletes take it out; each batch writes a new version of the table.

    A batch that is run again writes its version again, so the result is the same.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        fresh = last.where("not deleted").drop("deleted")
        if number > 0:
            old = spark.read.parquet(f"{target}/v={number - 1}")
            fresh = old.join(last.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)
        fresh.write.mode("overwrite").parquet(f"{target}/v={number}")

    return write
