"""Sites that are connected, messages, scans over older tables."""

from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import changes, inventory


def test_connected_sites(spark):
    sites = spark.createDataFrame([(1, "u", ["A.b", "a.b"], "p1", "daily", 5), (2, "u", ["a.b"], "p2", "daily", 5), (3, "v", None, "p3", "off", 1), (4, "u", ["c.d"], "p4", None, None)], "id int, user string, domains array<string>, platform string, frequency string, created int")
    asked = [(10, "u", " a.B ", " x ", "unknown", "off"), (11, "u", "c.d", "y", "new", "hourly"), (12, "v", "a.b", "z", "unknown", "off"), (13, "v", "A.B", "z", None, None), (14, None, "a.b", None, None, None), (15, None, "a.b", None, None, None), (16, "u", None, "w", "q", "off")]
    got = {r.request: tuple(r)[1:] for r in changes.connected_sites(spark.createDataFrame(asked, "request int, user string, domain string, name string, platform string, frequency string"), sites).collect()}
    assert got == {
        10: ("reuse", 2, None, "x", "p2", "daily"), 11: ("reuse", 4, None, "y", "new", "hourly"), 12: ("insert", None, 12, "z", "unknown", "off"), 13: ("reuse", None, 12, "z", None, None),
        14: ("insert", None, 14, None, None, None), 15: ("insert", None, 15, None, None, None), 16: ("insert", None, 16, "w", "q", "off"),
    }


def test_message_and_projection(spark):
    df = spark.createDataFrame([(" \t a b\n",), ("",), (None,), ("   ",), ("x" * 1001,), (" " + "x" * 1000,)], "m string")
    assert [(r.x.valid, r.x.error, r.x.sanitized) for r in df.select(text.message(F.col("m")).alias("x")).collect()] == [(True, None, "a b"), (False, "empty", None), (False, "empty", None), (False, "empty", None), (False, "too_long", None), (True, None, "x" * 1000)]
    got = inventory.projected(df.limit(1), {"gone": "int", "m": "string"})
    assert got.columns == ["gone", "m"] and got.first().gone is None
