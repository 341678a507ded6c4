"""Merging crawled and delivered versions of one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources whose values a crawl never replaces.
CONNECTORS = ("shopify", "woocommerce", "feed", "manual")


def merged_map(old: Column, new: Column, overwrite: bool) -> Column:
    """Maps joined: new values win where overwrite is set, else they only fill what is missing or empty."""
    empty = lambda v: v.isNull() | (v == "")
    pick = (lambda k, a, b: F.when(empty(b), a).otherwise(b)) if overwrite else (lambda k, a, b: F.when(empty(a), b).otherwise(a))
    none = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, none), F.coalesce(new, none), pick)


def merged(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """pairs: structs old and new with the fields, source and metadata. A delivered row is filled by a crawl, never replaced; otherwise new values win."""
    old, new = F.col("old"), F.col("new")
    keep = old["source"].isin(*CONNECTORS) & ~new["source"].isin(*CONNECTORS)
    value = lambda f: F.when(keep, F.coalesce(old[f], new[f])).otherwise(F.coalesce(new[f], old[f]))
    meta = F.when(keep, merged_map(old["metadata"], new["metadata"], False)).otherwise(merged_map(old["metadata"], new["metadata"], True))
    return pairs.select(*(value(f).alias(f) for f in fields), F.when(keep, old["source"]).otherwise(new["source"]).alias("source"), meta.alias("metadata"))


def by_tier(entities: DataFrame, title: Column, tier: str, tie: str) -> DataFrame:
    """One entity a title: the fields of its best tier, images of all tiers, each once."""
    w = Window.partitionBy(title).orderBy(tier, tie)
    ranked = entities.withColumn("__key", title).withColumn("__rn", F.row_number().over(w))
    images = ranked.groupBy("__key").agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("__rn", "images"))), lambda x: F.coalesce(x["images"], F.array().cast("array<string>"))))).alias("images"))
    return ranked.where("__rn = 1").drop("images").join(images, "__key").select(*entities.columns)
