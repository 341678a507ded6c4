"""Places of rows within keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.scratch import materialise

#: Rows that one range is meant to hold.
RANGE = 100_000


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Rows dealt evenly, or by keys, over as many tasks as a shuffle has, ``least`` at least: small rows that lead to much work each would else be the task of the one file, or of the one merged partition, that holds them."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def numbered(df: DataFrame, key: str, order: str, name: str = "place", rows: int | None = None, range_: int = RANGE) -> DataFrame:
    """Adds ``name``: a row's place (from 0) among its key's rows by ``order``; written to the shared folder.

    Rows are sorted into ranges of (key, order), so a key that most rows share is spread over tasks; a place is the row's number in its range, less that of the key's first row there, plus
    the key's rows in the ranges before. df should be a table that was written, as it is read twice.
    """
    ranges = max(1, -(-(df.count() if rows is None else rows) // range_))
    sorted_ = df.repartitionByRange(ranges, key, order).sortWithinPartitions(key, order)
    # The range stands in the upper bits, the row's number in it in the lower 33.
    at = materialise(sorted_.withColumn("__at", F.monotonically_increasing_id()).withColumn("__range", F.shiftright("__at", 33)))
    held = at.groupBy("__range", key).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select("__range", key, (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return materialise(at.join(starts, ["__range", key]).withColumn(name, F.col("__at") + F.col("__shift")).select(*df.columns, name))
