"""What kind of thing a catalog row is, and the facets of a catalog view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of knowledge and of plain pages, texts of firewalls, words of vehicles, and type names that a facet takes together.
KNOWLEDGE = ("product", "service", "inventory", "article", "faq", "custom")
PLAIN = ("page", "text", "html")
FIREWALL_TITLE = "request rejected"
FIREWALL_TEXTS = ("d2c media's firewall", "cf-browser-verification")
VEHICLE_WORDS = ("car", "truck", "suv", "vehicle", "wrangler", "cherokee", "ram", "dodge", "durango", "chrysler", "ford", "toyota", "honda")
VEHICLE_FIELDS = ("vin", "make", "model", "year", "stockNumber", "stock_number")
FACET_TYPES = {"article": ("article", "blog", "post"), "page": ("page", "content", "info")}


def lowered(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def is_artifact(title: str, content: str) -> Column:
    """A page of a firewall instead of the site's own."""
    out = lowered(title).contains(FIREWALL_TITLE)
    for mark in FIREWALL_TEXTS:
        out = out | F.contains(lowered(content), F.lit(mark))
    return out


def is_knowledge(entity_type: str) -> Column:
    """A typed entity rather than a plain page; a row without a type is a page."""
    kind = lowered(entity_type)
    return kind.isin(*KNOWLEDGE) | (~kind.isin(*PLAIN) & (kind != ""))


def is_vehicle(data_type: str, entity_type: str, title: str, metadata: str) -> Column:
    """Said by a type, by a field that only vehicles have in the metadata (a Variant), or by a word in the title."""
    named = F.coalesce(F.col(data_type) == "vehicle", F.lit(False)) | F.coalesce(F.col(entity_type) == "vehicle", F.lit(False))
    for f in VEHICLE_FIELDS:
        named = named | ~F.coalesce(F.try_variant_get(metadata, f"$.{f}", "string"), F.lit("")).isin("", "0", "false")
    return named | lowered(title).rlike("|".join(VEHICLE_WORDS))


def counts(rows: DataFrame, site: str, entity_type: str) -> DataFrame:
    """Entities and pages of each site."""
    return rows.groupBy(site).agg(F.count_if(is_knowledge(entity_type)).alias("entities"), F.count_if(~is_knowledge(entity_type)).alias("pages"))


def viewed(rows: DataFrame, tab: str = "all", source: str = "all", kind: str = "all", tier: str = "all", search: str = "") -> DataFrame:
    """Rows (entity_type, source, tier, title, content) that fit all facets; "all" and an empty search take every row."""
    test = {"entities": is_knowledge("entity_type"), "pages": ~is_knowledge("entity_type")}.get(tab, F.lit(True))
    for column, wanted in (("source", source.lower()), ("tier", tier.lower())):
        test = test if wanted == "all" else test & F.contains(lowered(column), F.lit(wanted))
    kind = kind.lower()
    if kind != "all":
        test = test & (F.startswith(lowered("entity_type"), F.lit(kind)) | lowered("entity_type").isin(kind, *FACET_TYPES.get(kind, ())))
    sought = search.lower().strip()
    return rows.where(test & (F.contains(F.concat_ws(" ", lowered("title"), lowered("content")), F.lit(sought)) if sought else F.lit(True)))
