"""Responses that pages fetch, and signed change messages of shops."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of urls that only measure visitors; envelopes of lists; names of titles and of what an item has beside one.
TRACKERS = (
    "google-analytics", "analytics.google", "googletagmanager", "/gtag/", "/collect?", "sentry.io", "datadoghq", "mixpanel.com", "segment.io", "segment.com", "hotjar.com", "clarity.ms", "facebook.com/tr", "connect.facebook.net", "tiktok.com", "criteo.com", "doubleclick.net",
    "/telemetry", "/metrics", "/beacon", "/csp-report", "/ping", "/log", "fullstory.com", "intercom.io", "drift.com",
)
ENVELOPES = ("data", "results", "items", "products", "vehicles", "inventory", "listings", "records", "courses", "allCourses", "hits", "nodes", "cars", "properties")
TITLES = ("title", "name", "fullName", "full_name", "courseName", "course_name", "gigTitle", "gig_title", "serviceTitle", "service_name", "productName", "product_name", "vehicleTitle", "propertyTitle", "propertyName", "doctorName", "physicianName", "menuItem", "dishName", "appName", "softwareName", "listingTitle", "listing_title", "headline")
NOISE = ("button", "close", "submit", "menu", "nav", "header", "footer", "modal", "card", "loading", "default", "root", "page", "app")
MARKS = (
    "price", "cost", "msrp", "sellingPrice", "amount", "rate", "hourlyRate", "fee", "image", "images", "imageUrl", "image_url", "photos", "photoList", "thumbnail", "profilePicture", "avatar", "description", "desc", "shortDescription", "short_description", "summary", "details", "bio", "about",
    "vin", "sku", "id", "_id", "stockNumber", "stock_number", "modelCode", "username", "handle", "rating", "stars", "averageRating", "reviews", "totalReviews", "recentReviews", "reviewCount", "mileage", "year", "make", "model", "specs", "attributes", "category", "tags", "level", "skills", "subcategories", "specialty", "bedrooms", "ingredients",
)


def is_tracker(url: Column) -> Column:
    out = F.lit(False)
    for part in TRACKERS:
        out = out | F.contains(F.lower(url), F.lit(part))
    return out


def title_of(raw: Column) -> Column:
    """An item's title, else year, make and model; null where there is none, or only a name of a page's furniture."""
    value = lambda k: F.nullif(F.trim(F.element_at(raw, k)), F.lit(""))
    car = F.when(value("year").isNotNull() & value("make").isNotNull() & value("model").isNotNull(), F.concat_ws(" ", value("year"), value("make"), value("model")))
    title = F.coalesce(*map(value, TITLES), car)
    return F.when((F.length(title) >= 2) & ~F.lower(title).isin(*NOISE), title)


def items(responses: DataFrame, page: str, url: str, status: str, body: str, order: str) -> DataFrame:
    """One row a page and title: page, title, raw (map of texts). Of equal titles of a page the first by ``order`` and place stays.

    Refused responses, trackers and bodies that are no JSON are passed over.
    """
    good = responses.where(F.col(url).isNotNull() & (F.col(status).isNull() | F.col(status).between(200, 399)) & ~is_tracker(F.col(url)) & F.ltrim(F.col(body)).rlike(r"^[\[{]"))
    v = F.try_parse_json(F.col(body))
    none = F.array().cast("array<variant>")
    lists = F.concat(*(F.coalesce(F.try_variant_get(v, p, "array<variant>"), none) for p in ("$", *(f"$.{e}" for e in ENVELOPES))), F.array(v))
    each = good.where(v.isNotNull()).select(F.col(page).alias("page"), F.col(order).alias("__o"), F.posexplode(lists).alias("__p", "__v"))
    return shaped(each.select("page", "__o", "__p", F.from_json(F.to_json("__v"), "map<string,string>").alias("raw")))


def shaped(raw: DataFrame) -> DataFrame:
    """raw: page, __o, __p (order and place), raw. Those with a title and a mark of an entity; of equal titles of a page the first."""
    titled = raw.withColumn("title", title_of(F.col("raw"))).where(F.col("title").isNotNull() & F.arrays_overlap(F.map_keys("raw"), F.array(*map(F.lit, MARKS))))
    w = Window.partitionBy("page", F.lower("title")).orderBy("__o", "__p")
    return titled.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("page", "title", "raw")


def hmac_sha256(body: Column, key: bytes) -> Column:
    """The keyed hash of a body in base64, composed of two plain ones."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in block).hex())) for x in (0x36, 0x5C))
    return F.base64(F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)))


def verified(messages: DataFrame, body: str, signature: str, key: bytes) -> DataFrame:
    """Messages whose signature is right; works on streams as well."""
    return messages.where(F.coalesce(hmac_sha256(F.col(body), key) == F.col(signature), F.lit(False)))


def shop_products(bodies: DataFrame, id_col: str, body: str) -> DataFrame:
    """Products of a shop's pages: lowest price above 0, available if any variant is."""
    kind = "struct<products:array<struct<id:bigint,title:string,vendor:string,product_type:string,handle:string,variants:array<struct<price:string,available:boolean,sku:string>>>>>"
    p = bodies.select(id_col, F.explode(F.from_json(body, kind)["products"]).alias("p"))
    prices = F.filter(F.transform("p.variants", lambda x: x["price"].try_cast("double")), lambda x: x > 0)
    return p.select(id_col, "p.id", "p.title", "p.vendor", "p.product_type", "p.handle", F.array_min(prices).alias("price"), F.exists("p.variants", lambda x: F.coalesce(x["available"], F.lit(False))).alias("available"))
