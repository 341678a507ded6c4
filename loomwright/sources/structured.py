"""Entities that pages state as data: structured-data objects of all families, and lists inside embedded application state.

Both are values of unknown shape and depth. A short helper walks each page's values and unrolls what lists hold; what an object means is then read off it by column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from loomwright.sources import network
from loomwright.sources.pages import ld_blocks

# Types that only hold others, of which dealers are entities as well; where the held ones stand.
HOLDERS, DEALERS = ("itemlist", "offercatalog", "collectionpage", "autodealer", "automotivedealer", "carrepair"), ("autodealer", "automotivedealer")
HELD = ("itemListElement", "itemList", "offers", "hasOfferCatalog.itemListElement", "makesOffer", "itemOffered")
# Members that make a product a vehicle.
VEHICLE_SIGNS = ("vehicleIdentificationNumber", "vin", "modelDate", "vehicleModelDate", "vehicleEngine", "mileageFromOdometer", "bodyType")
# Families by parts of the type, the first that fits; their kind of row, and the title of what has no name.
FAMILIES = (
    ("vehicle", "product", "Vehicle", ("vehicle", "car", "motorcycle", "truck", "bus")),
    ("course", "service", "Course", ("course", "learningresource", "educational")),
    ("property", "product", "Property", ("realestatelisting", "residence", "apartment", "house", "accommodation")),
    ("health", "contact", "Healthcare Provider", ("physician", "medical", "doctor", "clinic")),
    ("menu", "product", "Menu Item", ("menuitem", "menu", "dish")),
    ("person", "service", "Profile", ("person", "profilepage")),
    ("service", "service", "", ("service", "offer")),
    ("business", "contact", "", ("localbusiness", *DEALERS, "carrepair", "organization", "restaurant", "store")),
    ("faq", "faq", "", ("faqpage", "question")),
    ("product", "product", "", ()),
)
# What a family says beside the common columns; of several places the first that says something.
DETAILS = {
    "product": {"brand": ("brand.name", "brand"), "sku": ("sku",), "category": ("category",)},
    "vehicle": {
        "vin": ("vehicleIdentificationNumber", "vin"), "stock_number": ("sku", "stockNumber", "stock_number"), "mileage": ("mileageFromOdometer.value", "mileageFromOdometer"), "year": ("vehicleModelDate", "modelDate"), "make": ("brand.name", "brand"), "model": ("model",),
        "trim": ("vehicleConfiguration", "trim"), "category": ("category", "bodyType", "vehicleConfiguration"), "body_style": ("bodyType", "vehicleConfiguration", "category"), "drivetrain": ("driveWheelConfiguration", "driveType", "drivetrain"),
        "towing_capacity": ("towingCapacity", "towingCapacityKg", "trailerWeightRating"), "city_fuel_efficiency": ("fuelEfficiencyCity", "fuelCity", "cityFuelEfficiency"), "highway_fuel_efficiency": ("fuelEfficiencyHighway", "fuelHighway", "highwayFuelEfficiency"),
        "exterior_color": ("color", "exteriorColor"), "interior_color": ("interiorColor",), "engine": ("vehicleEngine.name", "engine.name", "engine"), "fuel": ("fuelType",), "transmission": ("vehicleTransmission",), "msrp": ("msrp", "offers.priceSpecification.price", "offers.highPrice"),
    },
    "course": {"instructor": ("instructor.name", "instructor", "provider.name", "provider", "author.name", "author"), "level": ("educationalLevel", "courseCode"), "duration": ("timeRequired", "duration"), "category": ("about", "category")},
    "property": {"bedrooms": ("numberOfBedrooms", "numberOfRooms"), "bathrooms": ("numberOfBathroomsTotal", "numberOfFullBathrooms"), "sqft": ("floorSize.value", "floorSize")},
    "health": {"specialty": ("medicalSpecialty", "department"), "phone": ("telephone",), "email": ("email",)},
    "menu": {"nutrition": ("nutrition",)},
    "person": {"job_title": ("jobTitle",), "skills": ("knowsAbout",)},
    "service": {"category": ("category",)},
    "business": {"phone": ("telephone", "phone"), "email": ("email",), "city": ("address.addressLocality",), "region": ("address.addressRegion",), "postal_code": ("address.postalCode",), "hours": ("openingHours", "openingHoursSpecification")},
    "faq": {},
}
# Words of availability and how they are shown.
AVAILABILITY = (("In Stock", "instock", "in_stock"), ("Out of Stock", "outofstock", "out_of_stock"), ("Pre-Order", "preorder", "pre_order"), ("Discontinued", "discontinued"), ("Limited Availability", "limited"))
# Names that hold a page's state, members that hold lists of entities, and how deep these are looked for.
STATES = ("__vdpJSON", "vdpJSON", "vehicleData", "inventoryData", "digitalData", "dealerInspireInventory", "__DEALERON_INVENTORY__", "vehicles", "inventory", "DDC.dataLayer", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__", "__APP_STATE__")
LISTS = (
    "products", "items", "listings", "vehicles", "vehiclesList", "vehicleList", "inventory", "allVehicles", "usedVehicles", "newVehicles", "vdp", "cars", "trucks", "searchResults", "inventoryItems", "services", "gigs", "courses", "allCourses", "freelancers", "doctors", "properties",
    "results", "records", "data", "hits", "nodes",
)
DEPTH = 5
OBJECTS = ArrayType(StructType().add("family", "string").add("object", "string"))


def family_of(kind: str, thing: dict) -> str | None:
    if "product" in kind:
        return "vehicle" if any(thing.get(s) for s in VEHICLE_SIGNS) else "product"
    return next((name for name, _, _, parts in FAMILIES if any(p in kind for p in parts)), None)


def held_by(thing: dict) -> list:
    """The things a holder lists: the first place that says something, if it is a list."""
    for place in HELD:
        value: Any = thing
        for step in place.split("."):
            value = value.get(step) if isinstance(value, dict) else None
        if value:
            return [x.get("item") or x for x in value if isinstance(x, dict)] if isinstance(value, list) else []
    return []


def unrolled(value: Any) -> Iterator[tuple[str, dict]]:
    """Family and object of everything a block states, in order; holders and graphs give what they hold, at any depth."""
    stack = [(value, False)]
    while stack:
        thing, opened = stack.pop()
        if isinstance(thing, list):
            stack += [(x, False) for x in reversed(thing)]
        if not isinstance(thing, dict):
            continue
        kinds = thing.get("@type") or thing.get("@Type") or ""
        kind = (",".join(map(str, kinds)) if isinstance(kinds, list) else str(kinds)).lower()
        if not opened and any(h in kind for h in HOLDERS):
            if any(d in kind for d in DEALERS):
                stack.append((thing, True))
            stack.append((held_by(thing), False))
        elif isinstance(thing.get("@graph"), list) and not kind:
            stack.append((thing["@graph"], False))
        elif family := family_of(kind, thing):
            asked = (thing.get("mainEntity") or (thing if "question" in kind else [])) if family == "faq" else thing
            yield from ((family, x) for x in (asked if isinstance(asked, list) else [asked]) if isinstance(x, dict))


def parsed(text: str) -> Any:
    """A JSON value; None for what is none, or is nested deeper than the parser goes."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(OBJECTS)
def _unrolled(blocks: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else [{"family": f, "object": json.dumps(o)} for x in b for f, o in unrolled(parsed(x))] for b in blocks], dtype=object)


def entities(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """One row a page and entity of its structured data: id, place, family, data_type, title, content, description, images, price, currency, availability, rating, reviews, details (map of texts).

    Types are told by parts of their names, so a part counts inside another word (a LocalBusiness counts as a vehicle, by ``bus``). Prices stay as the page writes them; of several offers the first counts. Where several places
    could say a thing, empty, zero and false ones say nothing. Blocks that do not parse, pages without any and null pages give no row; entities without title and content are passed over.
    """
    found = pages.select(F.col(id_col), F.coalesce(F.col(url), F.lit("")).alias("__url"), F.posexplode(_unrolled(ld_blocks(F.col(html)))).alias("place", "__e"))
    found = found.select(id_col, "__url", "place", F.col("__e.family").alias("family"), F.parse_json("__e.object").alias("__o"))
    text = lambda path: F.try_variant_get("__o", f"$.{path}", "string")

    def first(*paths: str) -> Column:
        if len(paths) == 1:
            return text(paths[0])
        return F.coalesce(*(F.when(~text(p).isin("", "0", "false"), text(p)) for p in paths))

    def listed(path: str) -> Column:
        return F.transform(F.try_variant_get("__o", f"$.{path}", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$.url", "string"), F.try_variant_get(v, "$", "string")))

    def of_family(values: dict[str, Column], other: Column | None = None) -> Column:
        out = other
        for name, value in values.items():
            out = F.when(F.col("family") == name, value) if out is None else F.when(F.col("family") == name, value).otherwise(out)
        return out

    offer = lambda member: first(f"offers.{member}", f"offers[0].{member}", f"offer.{member}")
    offered = lambda member: F.coalesce(text(f"offers.{member}"), text(f"offers[0].{member}"), text(f"offer.{member}"))
    street = F.concat(F.coalesce(text("address.streetAddress"), F.lit("")), F.lit(", "), F.coalesce(text("address.addressLocality"), F.lit("")))
    whole = F.trim(F.concat_ws(" ", street, F.coalesce(text("address.addressRegion"), F.lit("")), F.coalesce(text("address.postalCode"), F.lit(""))))
    in_parts = F.try_variant_get("__o", "$.address", "map<string,variant>").isNotNull()
    address = F.when(in_parts, F.when(F.col("family") == "business", whole).otherwise(street)).otherwise(text("address"))
    called = lambda *paths: F.concat(F.coalesce(first("name", "__none"), F.lit("")), F.lit(" — "), F.coalesce(first(*paths), F.lit("")))
    car = F.nullif(F.trim(F.concat_ws(" ", *(F.coalesce(first(*p), F.lit("")) for p in (("vehicleModelDate", "modelDate"), ("brand.name", "brand"), ("model", "__none"))))), F.lit(""))
    name = F.when(F.col("family").isin("product", "course", "property"), first("name", "headline")).otherwise(first("name", "__none"))
    title = F.coalesce(name, F.when(F.col("family") == "vehicle", car), of_family({f: F.lit(t) for f, _, t, _ in FAMILIES}))
    found = found.withColumn("title", title)
    answer = first("acceptedAnswer.text", "suggestedAnswer.text")
    said = of_family({"faq": answer}, first("description", "__none"))
    instead = of_family({"vehicle": F.col("title"), "health": F.trim(called("medicalSpecialty", "department")), "person": F.trim(called("jobTitle", "roleName")), "business": F.trim(called("address.streetAddress", "__none"))}, first("name", "__none"))
    condition = F.lower(F.coalesce(first("itemCondition", "offers.itemCondition"), F.lit("")))
    condition = F.when(condition.contains("new") | F.col("__url").rlike("/new-vehicles|/new-inventory"), "new").when(condition.rlike("cpo|certified"), "cpo").otherwise("used")
    extra = {
        "vehicle": {"condition": condition, "features": F.array_join(F.coalesce(listed("amenityFeature"), listed("features")), ", ")}, "property": {"address": address}, "health": {"address": address}, "business": {"address": address},
        "menu": {"ingredients": F.coalesce(F.array_join(listed("ingredients"), ", "), text("ingredients"))},
    }

    def details(family: str, places: dict[str, tuple[str, ...]]) -> Column:
        every = {k: first(*p) for k, p in places.items()} | extra.get(family, {})
        pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in every.items()]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast("map<string,string>")

    currency = F.coalesce(offer("priceCurrency"), F.when(F.col("family") == "vehicle", F.when(F.col("__url").contains(".ca"), "CAD").otherwise("USD")))
    images = F.filter(F.coalesce(listed("image"), F.array(F.coalesce(text("image.url"), text("image")))), lambda x: x.isNotNull() & (x != ""))
    out = found.select(
        id_col, "place", "family", of_family({f: F.lit(k) for f, k, _, _ in FAMILIES}).alias("data_type"), "title", F.coalesce(said, instead, F.lit("")).alias("content"), said.alias("description"), images.alias("images"),
        offered("price").alias("price"), currency.alias("currency"), availability(offered("availability")).alias("availability"), text("aggregateRating.ratingValue").try_cast("double").alias("rating"), text("aggregateRating.reviewCount").try_cast("int").alias("reviews"),
        of_family({f: details(f, p) for f, p in DETAILS.items()}).alias("details"),
    )
    return out.where("title <> '' or content <> ''")


def availability(said: Column) -> Column:
    """How availability is shown; other words stand without the vocabulary's address."""
    out = F.regexp_replace(said, "(?i)^https?://schema[.]org/", "")
    for shown, *words in reversed(AVAILABILITY):
        out = F.when(F.lower(said).rlike("|".join(words)), shown).otherwise(out)
    return out


def listed_in(value: Any, depth: int = 0) -> Iterator[dict]:
    """Objects in lists of entities inside a value; objects within objects are looked into to DEPTH."""
    if not isinstance(value, dict) or depth > DEPTH:
        return
    for name in LISTS:
        if isinstance(some := value.get(name), list) and some and isinstance(some[0], (dict, list)):
            yield from (x for x in some if isinstance(x, dict))
    for inner in value.values():
        yield from listed_in(inner, depth + 1)


def states(html: str) -> Iterator[dict]:
    """Objects of a page's embedded state: streamed chunks, the page's properties, variables of the window, other blocks of JSON. A value is read to where it ends by its own grammar."""
    reader = json.JSONDecoder()

    def value_at(text: str, at: int) -> tuple[Any, int]:
        try:
            return reader.raw_decode(text, at)
        except (ValueError, RecursionError):
            return None, at + 1

    for m in re.finditer(r"self\.__next_f\.push\(\[1,\s*(?=\")", html):
        chunk, _ = value_at(html, m.end())
        at = 0
        while isinstance(chunk, str) and (start := re.compile(r"\[(?=\s*\{)").search(chunk, at)):
            some, at = value_at(chunk, start.start())
            yield from (x for x in some or () if isinstance(x, dict))
    scripts = [(a, parsed(b)) for a, b in re.findall(r"(?is)<script\b([^>]*)>(.*?)</script", html) if "__NEXT_DATA__" in a or "application/json" in a.lower()]
    for value in (v for a, v in scripts if "__NEXT_DATA__" in a):
        yield from listed_in((value.get("props") or value) if isinstance(value, dict) else None)
    for name in STATES:
        if m := re.search(rf"(?i)window\.{re.escape(name)}\s*=\s*(?=[\[{{])", html):
            value, _ = value_at(html, m.end())
            own = [value] if isinstance(value, dict) else [x for x in value or () if isinstance(x, dict)]
            yield from own
            yield from listed_in(value)
    for value in (v for a, v in scripts if "__NEXT_DATA__" not in a):
        yield from (x for x in value if isinstance(x, dict)) if isinstance(value, list) else listed_in(value)


@F.pandas_udf(ArrayType(StringType()))
def _states(html: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else [json.dumps(x) for x in states(h)] for h in html], dtype=object)


def app_state(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """One row a page and title found in embedded state: page, title, raw (map of texts). Of equal titles (in any case) of a page the first stays; what has no title or no mark of an entity is passed over, and so are null pages."""
    each = pages.select(F.col(id_col).alias("page"), F.lit(0).alias("__o"), F.posexplode(_states(F.col(html))).alias("__p", "__v"))
    return network.shaped(each.select("page", "__o", "__p", F.from_json("__v", "map<string,string>").alias("raw")))
