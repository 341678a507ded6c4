"""Coverage counts, audits, quality scores, usage counters and comparison matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key)


def audit(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each test."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(t).alias(name) for name, t in tests.items()))


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(column) == "")


def quality_score(blocked: Column, failed: Column, missing: Column, thin: Column) -> Column:
    """100, less 40 if nothing got through, 35 if anything failed, 5 for each missing section up to 25, 30 if content is thin; never below 0."""
    cost = F.when(blocked, 40).otherwise(0) + F.when(failed, 35).otherwise(0) + F.least(5 * missing, F.lit(25)) + F.when(thin, 30).otherwise(0)
    return F.greatest(F.lit(0), 100 - cost)


def grade(score: Column) -> Column:
    return F.when(score >= 80, "COMPLETE").when(score >= 40, "PARTIAL").otherwise("FAILED")


def daily_usage(events: DataFrame, tenant: str, ts: str, kinds: dict[str, Column]) -> DataFrame:
    """Counters a tenant and UTC day."""
    return events.groupBy(tenant, F.to_date(ts).alias("day")).agg(*(F.count_if(test).alias(name) for name, test in kinds.items()))


def breaker(usage: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Adds tripped: any counter has gone beyond its limit; one that does blocks all kinds for the day."""
    tripped = F.lit(False)
    for name, limit in limits.items():
        tripped = tripped | (F.col(name) > limit)
    return usage.withColumn("tripped", tripped)


def compare_matrix(df: DataFrame, id_col: str, ids: list, attributes: list[str]) -> DataFrame:
    """One row an attribute, one column an entity; two to four entities."""
    if not 2 <= len(ids) <= 4:
        raise ValueError("compare two to four entities")
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes)))
    long = df.where(F.col(id_col).isin(*ids)).select(id_col, pairs.alias("p")).select(id_col, "p.attribute", "p.value")
    return long.groupBy("attribute").agg(*(F.max(F.when(F.col(id_col) == i, F.col("value"))).alias(f"entity_{n}") for n, i in enumerate(ids, 1)))
