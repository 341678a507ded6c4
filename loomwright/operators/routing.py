"""Which table answers a query: vehicles by their columns, or retrieval, with vehicles where retrieval of a broad query finds nothing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators import inventory, rerank, retrieval

BROAD = ("catalog", "general")


def vehicles(rows: DataFrame, tenants: list, asked: Mapping[str, object]) -> DataFrame:
    """Listed vehicles of the tenants that meet what is asked: condition, make, model, body_style, and bounds min_/max_ of year and price and max_mileage.

    Missing values meet nothing. A body style may also stand as the category.
    """
    has = {k: v for k, v in asked.items() if v is not None}
    found = inventory.scoped(rows, tenants).where("still_listed")
    ranges = {c: (has.get(f"min_{c}"), has.get(f"max_{c}")) for c in ("year", "price", "mileage") if f"min_{c}" in has or f"max_{c}" in has}
    found = inventory.filtered(found, {"condition": has["condition"]} if "condition" in has else {}, {c: has[c] for c in ("make", "model") if c in has}, ranges)
    if "body_style" in has:
        holds = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(has["body_style"].lower())), F.lit(False))
        found = found.where(holds("body_style") | holds("category"))
    return found


def named(rows: DataFrame, limit: int) -> DataFrame:
    """The newest rows as results: id, title (from year, make, model and trim where it has none of its own), source."""
    parts = F.nullif(F.concat_ws(" ", F.col("year").cast("string"), "make", "model", "trim"), F.lit(""))
    own = F.when(~F.col("title").isin("", "Untitled", "Vehicle"), F.col("title"))
    newest = rows.orderBy(F.col("created_at").desc_nulls_last(), "id").limit(limit)
    return newest.select("id", F.coalesce(own, parts, F.lit("Vehicle")).alias("title"), F.lit("vehicles").alias("source"))


def routed(rows: DataFrame, stock: DataFrame, tenants: list, intent: rerank.Intent, asked: Mapping[str, object], as_of: Column, query_vector: list[float] | None = None, limit: int = 5, informational: bool = False) -> DataFrame:
    """id, title, source of the results.

    A query for vehicles that asks for anything of their columns is answered by ``stock`` alone: no row there means no row, never something similar.
    Any other query goes to retrieval; where that finds nothing and the query is broad, the newest vehicles stand in.
    """
    if intent.entity_type == "vehicle" and any(v is not None for v in asked.values()):
        return named(vehicles(stock, tenants, asked), limit)
    found = retrieval.retrieve(rows, tenants, intent, as_of, query_vector, limit).select("id", "title", F.lit("retrieval").alias("source"))
    if intent.kind not in BROAD or informational:
        return found
    # Both sides are a few rows; the one flag row tells whether retrieval found any.
    some = found.limit(1).select(F.lit(1).alias("__k"))
    return found.unionByName(named(vehicles(stock, tenants, {}), limit).withColumn("__k", F.lit(1)).join(some, "__k", "left_anti").drop("__k"))
