"""A filter of fixed size that lets most rows without a partner fall before they are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 4 MB, whatever the number of keys. A full filter passes all rows, and the join behind it stays exact.
BITS = 1 << 25
PAGE = 32768


def passing(df: DataFrame, col: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose col may be among keys; none that is gets lost. What reaches the driver and is broadcast is BITS / 8 bytes at most."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    pages = keys.select(spot(F.col(key)).alias("p")).groupBy(F.floor(F.col("p") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("p") % PAGE).alias("bits"))
    bits = np.zeros(BITS // 8, dtype=np.uint8)
    for row in pages.toLocalIterator():
        bits[row.page * (PAGE // 8) : (row.page + 1) * (PAGE // 8)] = np.frombuffer(row.bits, dtype=np.uint8)
    held = df.sparkSession.sparkContext.broadcast(bits)

    def may_hold(spots: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = held.value
        for s in spots:
            p = s.to_numpy(np.int64)
            yield pd.Series((table[p >> 3] >> (p & 7)) & 1 == 1)

    test: Column = F.pandas_udf(may_hold, "boolean")(spot(F.col(col)))
    return df.where(F.col(col).isNotNull()).where(test)
