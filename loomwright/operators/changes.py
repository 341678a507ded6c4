"""Upserts, incremental crawls and reconciliation as actions computed by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def actions(existing: DataFrame, observed: DataFrame, key: str, hash_col: str) -> DataFrame:
    """key, action: insert, update, touch (same hash) or unlist (not observed). One full outer join on the key."""
    old = existing.select(F.col(key), F.col(hash_col).alias("__old"), F.lit(True).alias("__was"))
    new = observed.select(F.col(key), F.col(hash_col).alias("__new"), F.lit(True).alias("__is"))
    both = old.join(new, key, "full_outer")
    kind = F.when(F.col("__was").isNull(), "insert").when(F.col("__is").isNull(), "unlist").when(F.col("__old").eqNullSafe(F.col("__new")), "touch").otherwise("update")
    return both.select(key, kind.alias("action"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The table after the upsert: incoming rows replace existing ones of the same key, columns missing on one side are null."""
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def reconcile(existing: DataFrame, observed: DataFrame, keys: list[str], protected: Column | None = None) -> DataFrame:
    """Rows that none of the keys finds among observed ones lose still_listed and become out_of_stock; protected rows stay."""
    seen = F.lit(False)
    out = existing
    for i, key in enumerate(keys):
        side = observed.where(F.col(key).isNotNull()).select(F.col(key)).distinct().withColumn(f"__s{i}", F.lit(True))
        out = out.join(side, key, "left")
        seen = seen | F.coalesce(F.col(f"__s{i}"), F.lit(False))
    gone = F.col("still_listed") & ~seen & ~(protected if protected is not None else F.lit(False))
    out = out.withColumn("__gone", gone).withColumn("availability", F.when(F.col("__gone"), "out_of_stock").otherwise(F.col("availability"))).withColumn("still_listed", F.col("still_listed") & ~F.col("__gone"))
    return out.select(*existing.columns)


def filled(existing: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Incoming values where there are any, else the existing ones (a profile upsert)."""
    new = incoming.select(key, *(F.col(c).alias(f"__n_{c}") for c in columns))
    joined = existing.join(new, key, "full_outer")
    return joined.select(key, *(F.coalesce(f"__n_{c}", c).alias(c) for c in columns))


def without_member(rows: DataFrame, tenant: str, tenants: list, metadata: str, path: str, value: str) -> DataFrame:
    """The table after a delete of the tenants' rows whose metadata (a Variant) hold the value at the path. Rows of other tenants, and rows that hold none, stay."""
    gone = F.col(tenant).isin(*tenants) & (F.try_variant_get(metadata, path, "string") == value)
    return rows.where(~F.coalesce(gone, F.lit(False)))


def cascaded(table: DataFrame, gone: DataFrame, key: str, gone_key: str) -> DataFrame:
    """The rows of a table that refer to none of the deleted ones; rows that refer to nothing stay. Deleted rows come in any number: a join on the key."""
    return table.join(gone.where(F.col(gone_key).isNotNull()).select(F.col(gone_key).alias(key)).distinct(), key, "left_anti").select(*table.columns)


def job_outcome(blocked: Column, pages: Column, found: Column, errors: Column, url: Column) -> Column:
    """status and error_message of a crawl job that has come back: blocked, failed (nothing reached) or completed; the first three errors are told."""
    told = F.when(F.size(F.coalesce(errors, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(errors, 1, 3), "; "))
    nothing = (F.coalesce(pages, F.lit(0)) == 0) & (F.coalesce(found, F.lit(0)) == 0)
    unreached = F.concat(F.lit("Crawl failed to reach "), F.coalesce(url, F.lit("")), F.lit(": 0 pages analyzed and 0 knowledge records extracted. Verify site accessibility."))
    shut = F.coalesce(blocked, F.lit(False))
    status = F.when(shut, "blocked").when(nothing, "failed").otherwise("completed")
    message = F.when(shut, "Crawl blocked by anti-bot firewall (WAF challenge detected).").when(nothing, F.coalesce(told, unreached)).otherwise(told)
    return F.struct(status.alias("status"), message.alias("error_message"))


def backfilled(rows: DataFrame, owners: DataFrame, orphan: str) -> DataFrame:
    """Rows (widget_id, short_description, content, image_urls, data_type, metadata as a Variant) with what older versions left out.

    widget_id becomes the id of its owner (owners: website_id, id; one a website) or ``orphan``; an empty description comes from the metadata, else from the first 200 characters;
    no images come from the metadata's list, else from its single one; no data_type is a crawl.
    """
    ids = owners.groupBy(F.col("website_id").alias("widget_id")).agg(F.min("id").alias("__owner"))
    known = owners.select(F.col("id").alias("widget_id")).distinct().withColumn("__known", F.lit(True))
    get = lambda path, kind="string": F.try_variant_get("metadata", path, kind)
    none = F.array().cast("array<string>")
    images = F.coalesce(get("$.images", "array<string>"), F.when(get("$.image") != "", F.array(get("$.image"))), none)
    joined = rows.join(ids, "widget_id", "left").join(known, "widget_id", "left")
    out = {
        "widget_id": F.coalesce("__owner", F.when(F.col("__known"), F.col("widget_id")), F.lit(orphan)),
        "short_description": F.coalesce("short_description", get("$.description"), F.substring("content", 1, 200)),
        "image_urls": F.when(F.size(F.coalesce("image_urls", none)) > 0, F.col("image_urls")).otherwise(images),
        "data_type": F.coalesce(F.nullif("data_type", F.lit("")), F.lit("crawl")),
    }
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in rows.columns))


def connected_sites(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """requests: request, user, domain, name, platform, frequency. sites: id, user, domains (an array), platform, frequency, created. Returns request, action, site_id, made_by, name, platform, frequency: each request's site as it is to be written.

    A request reuses the newest site (of equal ones the greatest id) of its user whose domains hold its domain, in any case; an ``unknown`` platform and the frequency ``off`` leave what the site has. Where there is none, the least request
    of a user and domain inserts one and the others reuse what it makes (made_by). Domains are exploded, so both sides meet by equal keys; requests without a user or domain insert each its own.
    """
    owned = sites.select("user", F.explode(F.array_distinct(F.transform("domains", F.lower))).alias("__d"), F.struct("created", "id", "platform", "frequency").alias("__s"))
    newest = owned.groupBy("user", "__d").agg(F.max("__s").alias("__s"))
    asked = requests.withColumn("__d", F.lower(F.trim("domain")))
    first = asked.where("user is not null and __d is not null").groupBy("user", "__d").agg(F.min("request").alias("__first"))
    both = asked.join(newest, ["user", "__d"], "left").join(first, ["user", "__d"], "left")
    maker = F.when(F.col("__s").isNull(), F.coalesce("__first", "request"))
    action = F.when(maker == F.col("request"), "insert").otherwise("reuse")
    kept = lambda c, nothing: F.when((F.coalesce(c, F.lit(nothing)) == nothing) & F.col("__s").isNotNull(), F.col(f"__s.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("request", action.alias("action"), F.col("__s.id").alias("site_id"), maker.alias("made_by"), F.trim("name").alias("name"), kept("platform", "unknown"), kept("frequency", "off"))
