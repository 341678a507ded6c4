"""Joins and windows over keys: latest rows, identity cascades, orphans, first occurrences, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, by: list[Column]) -> DataFrame:
    """One row a key, the first in the given order: one aggregation with partial steps, so a hot key costs one row a task."""
    # max_by over a struct keeps only the best row while it aggregates.
    order = F.struct(*(F.col(f"__o{i}") for i in range(len(by))))
    marked = df.select("*", *(c.alias(f"__o{i}") for i, c in enumerate(by)))
    return marked.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def orphans(df: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return df.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def referenced(df: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return df.join(children.select(F.col(child_key).alias(key)), key, "left_semi")


def identified(incoming: DataFrame, existing: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Adds ``matched``: the id of the existing row under the first key that finds one; of several the smallest id.

    Each key's existing rows are one row a value before they are joined.
    """
    out = incoming
    for i, key in enumerate(keys):
        side = existing.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.min(id_col).alias(f"__m{i}"))
        out = out.join(side, key, "left")
    names = [f"__m{i}" for i in range(len(keys))]
    return out.withColumn("matched", F.coalesce(*names)).drop(*names).select(*incoming.columns, "matched")


def first_of(df: DataFrame, key: Column, by: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def runs(df: DataFrame, session: str, order: str, value: Column, ts: Column, gap: float) -> DataFrame:
    """Adds ``run_length``: how many rows in a row, up to this one, held the same value, each within ``gap`` seconds of the one before."""
    w = Window.partitionBy(session).orderBy(order)
    marked = df.withColumn("__v", value).withColumn("__t", ts.cast("double"))
    same = F.coalesce((F.col("__v") == F.lag("__v").over(w)) & (F.col("__t") - F.lag("__t").over(w) < gap), F.lit(False))
    marked = marked.withColumn("__new", F.when(same, 0).otherwise(1))
    marked = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("run_length", F.row_number().over(Window.partitionBy(session, "__run").orderBy(order))).drop("__v", "__t", "__new", "__run")


def nth(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n-th row of each key in the given order (from 1; -1 is the last), for what "the second one" or "the last one" means. order tells a key's rows apart."""
    w = Window.partitionBy(key).orderBy(F.col(order).asc() if n > 0 else F.col(order).desc())
    # A limit on the rank inside the window lets each task drop all but the first rows before the shuffle.
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= abs(n)).where(F.col("__rn") == abs(n)).drop("__rn")
