"""Running sums within keys of any size, without one task for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

#: Rows that one share of a key is meant to hold, and the least number of shares.
SHARE, LEAST = 20_000, 64


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, rows: int, deal: Column | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys that come before.

    A key's rows are dealt by a hash of their order columns (or by the whole number ``deal``) into as many shares as the table's number of rows asks for; shares come one after
    another, and within a share rows come by the order columns, which should tell rows apart. What each share adds up to is a small table, one
    row a key and share, whose running sums are the shares' starts. df is read twice.
    """
    shares = max(LEAST, -(-rows // SHARE))
    share, total, start = unused(df, "__share", "__sum", "__start")
    dealt = df.withColumn(share, F.pmod(F.xxhash64(*order) if deal is None else deal, F.lit(shares)))
    by = [*keys, share]
    sums = dealt.groupBy(*by).agg(F.sum(value).alias(total))
    before = F.sum(total).over(Window.partitionBy(*keys).orderBy(share).rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*by, F.coalesce(before, F.lit(0)).alias(start))
    own = F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn(name, F.coalesce(own, F.lit(0))).join(starts, by).withColumn(name, F.col(name) + F.col(start)).drop(share, start)
