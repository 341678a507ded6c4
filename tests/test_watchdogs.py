"""Stateful stream operators: timers that fire by themselves, late events, and the batch forms' rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomwright.operators import references
from loomwright.streaming import sessions, watchdogs


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watchdogs.PROVIDER)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", was)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, batches, schema, make, name, timed):
    """Runs a stream that takes one batch a trigger, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{n}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
    run = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/check")
    if timed:
        run = run.trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    else:  # with state that lives by running time a stream has no end of its own
        run, end = run.start(), time.monotonic() + 90
        while spark.table(name).count() < sum(map(len, batches)) and time.monotonic() < end:
            time.sleep(1)
        run.stop()
    assert run.exception() is None
    return spark.table(name).collect()


def test_calls_end_by_timers(rocks, tmp_path):
    events = "call string, ts long, kind string"
    batches = [
        [("quiet", 100, "start"), ("talks", 100, "start"), ("late", 100, "start"), ("hangs", 100, "start"), ("hangs", 105, "speech")],
        [("talks", 110, "speech"), ("hangs", 130, "end"), ("other", 120, "speech")],
        [("late", 109, "speech"), ("hangs", 131, "speech"), ("early end", 125, "end")],  # behind what came before, within the delay
        [("clock", 400, "start")],  # nothing more of the others: their timers fire all the same
        [("clock", 1500, "speech"), ("quiet", 1500, "start")],
        [("clock", 1501, "speech")],
    ]
    make = lambda s: watchdogs.watched_calls_stream(s.withColumn("ts", F.timestamp_seconds("ts")), "call", "ts", "kind", minutes=10, silence=15, delay="30 seconds")
    got = {(r.call, r.ended_at, r.reason) for r in streamed(rocks, tmp_path, batches, events, make, "calls", True)}
    want = {("quiet", 115.0, "initial_silence_timeout"), ("talks", 700.0, "max_duration_cap"), ("late", 700.0, "max_duration_cap"), ("hangs", 130.0, "hangup"), ("clock", 415.0, "initial_silence_timeout"), ("clock", 415.0, "initial_silence_timeout")}
    assert got == want
    # The batch form with its timers run up to the same moment tells the same.
    flat = rocks.createDataFrame([r for b in batches for r in b], events).withColumn("ts", F.timestamp_seconds("ts"))
    same = sessions.watched_calls(flat, "call", "ts", "kind", 10, 15, until=F.lit(1471.0)).where("reason is not null")
    assert {(r.call, r.ended_at, r.reason) for r in same.collect()} == want


def test_contexts(rocks, tmp_path):
    rng = random.Random(3)
    schema, at, batches = "user string, n long, ts long, kind string, page string", 0, []
    for b in range(3):
        rows = []
        for n in range(40):
            at += rng.choice([5, 50, 4000])
            rows.append((rng.choice("abc"), b * 40 + n, at, rng.choice(["x", "y", None]), rng.choice([None, None, f"p{n}"])))
        batches.append(rows)
    make = lambda s: watchdogs.session_context_stream(s.withColumn("ts", F.timestamp_seconds("ts")), "user", "ts", "n", ["kind", "page"], 7200.0)
    got = {(r.user, r.n, r.turn_count, r.kind, r.page) for r in streamed(rocks, tmp_path, batches, schema, make, "contexts", False)}
    flat = rocks.createDataFrame([r for b in batches for r in b], schema).withColumn("ts", F.timestamp_seconds("ts"))
    same = references.session_context(flat, "user", "ts", "n", ["kind", "page"], 7200.0)
    assert got == {(r.user, r.n, r.turn_count, r.kind, r.page) for r in same.collect()} and len(got) == 120
