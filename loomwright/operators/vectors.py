"""Vector search."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def top_k(df: DataFrame, query: list[float], k: int, vector: str, id_col: str, least: float = -1.0) -> DataFrame:
    """The k rows most like the query and above ``least``; ties by id. A top-k keeps k rows a task, so nothing is shuffled but those.

    One pass over each vector gives its product with the query and its square; the query's own length is worked out once. Rows without a length, or of another width, have no similarity.
    """
    # Products are added up in order, as in the SQL form.
    own = math.sqrt(functools.reduce(lambda s, x: s + x * x, map(float, query), 0.0))
    q = F.array(*(F.lit(float(x)) for x in query))
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"))
    both = F.aggregate(F.zip_with(F.col(vector), q, lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y"))), start, lambda s, p: F.struct((s["d"] + p["x"] * p["y"]).alias("d"), (s["n"] + p["x"] * p["x"]).alias("n")))
    found = df.withColumn("__s", both)
    similarity = F.when(F.col("__s.n") > 0, F.col("__s.d") / (F.sqrt("__s.n") * own)) if own > 0 else F.lit(None).cast("double")
    found = found.withColumn("similarity", similarity).drop("__s")
    # The filter stands behind the limit, where it sees k rows.
    return found.orderBy(F.desc("similarity"), id_col).limit(k).where(F.col("similarity") > least)


def fallback_vector(text: Column, width: int) -> Column:
    """A fixed vector out of a text's code points, for rows that no provider embedded."""
    total = F.aggregate(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.sin((total + i).cast("double")) * 0.1)
