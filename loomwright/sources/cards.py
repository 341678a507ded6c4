"""Cards of pages without structured data: elements that show one thing each, with a title and something beside it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from loomwright.functions import urls
from loomwright.sources.extraction import Node, Tree
from loomwright.sources.pages import resolved
from loomwright.sources.vehicle_pages import stated

# Elements and parts of their names that make cards; parts of names of titles and prices; titles that are furniture; how long a card and its title are; words and paths of vehicles; parts of images that are none.
TAGS, NAMED_BY = ("article", "div", "li"), ("class", "id", "data-type", "data-vehicle")
CARDS = ("card", "item", "gig", "course", "product", "listing", "service", "box", "profile", "vehicle", "inventory", "srp-vehicle", "vdp")
TITLE_TAGS, TITLE_NAMES, HEADINGS = ("h1", "h2", "h3", "h4", "h5", "span", "div", "a"), ("title", "name", "heading"), ("h2", "h3", "h4")
PRICE_NAMES = ("price", "cost", "rate", "fee", "amount", "msrp")
NOISE = ("button", "dialog", "modal", "card", "loading", "default", "root", "page", "home", "courses", "about", "faq", "contact", "services", "freelancers")
SIZE, TITLE_SIZE = (50, 8000), (3, 120)
VEHICLE_WORDS, VEHICLE_PATHS = ("wrangler", "cherokee", "ram 1500", "f-150", "silverado", "camry", "corolla", "rav4", "tahoe", "explorer", "civic", "accord", "vehicle", "truck", "suv", "sedan"), ("/new-vehicles", "/used-vehicles", "/inventory")
NO_IMAGES = ("data:image", "placeholder", "favicon")
CARD = StructType()
for _name in ("title", "price", "image", "link", "description", "text", "html"):
    CARD = CARD.add(_name, "string")


def named(node: Node, parts: tuple[str, ...], by: tuple[str, ...] = ("class",)) -> bool:
    return any(p in node.attributes.get(a, "").lower() for a in by for p in parts)


def title_of(card: Node) -> str:
    inside = list(card.below())
    node = next((n for n in inside if n.tag in TITLE_TAGS and named(n, TITLE_NAMES) and any(isinstance(c, str) and c.strip() for c in n.children)), None)
    node = node or next((n for n in inside if n.tag in HEADINGS), None)
    return node.text() if node else ""


def cards_of(page: str) -> list[dict]:
    """The innermost elements named as cards that have a size and a title of cards, in the order of the page."""
    found: list[dict] = []
    holding: set[int] = set()
    for node in reversed(list(Tree(page).root.below())):
        if node.tag not in TAGS or id(node) in holding or not named(node, CARDS, NAMED_BY):
            continue
        title = title_of(node)
        if not TITLE_SIZE[0] <= len(title) <= TITLE_SIZE[1] or title.lower() in NOISE:
            continue
        try:
            html = node.outer()
        except RecursionError:
            continue
        if not SIZE[0] <= len(html) <= SIZE[1]:
            continue
        first = lambda test, of: next((of(n) for n in node.below() if test(n)), None)  # noqa: B023, E731
        image = first(lambda n: n.tag == "img", lambda n: next((n.attributes[a] for a in ("src", "data-src", "data-lazy", "data-original") if n.attributes.get(a)), None))
        link = first(lambda n: n.tag == "a" and n.attributes.get("href", "#")[:1] not in ("", "#"), lambda n: n.attributes["href"])
        found.append({"title": title, "price": first(lambda n: named(n, PRICE_NAMES), Node.text), "image": image, "link": link, "description": first(lambda n: n.tag == "p", Node.text), "text": node.text(), "html": html})
        holding.update(id(n) for n in above(node))
    return found[::-1]


def above(node: Node) -> Iterator[Node]:
    while node := node.parent:
        yield node


@F.pandas_udf(ArrayType(CARD))
def _cards(html: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else cards_of(h) for h in html], dtype=object)


def cards(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """One row a page and card: id, place, title, url, data_type, price (as written), image, description, vin, stock_number, mileage, condition (of vehicles).

    A card without price, image, description, vehicle number and address of its own is passed over; of equal titles (in any case) of a page the first stays. A card's address counts if it is of the page's site. All cards of a page count. Null pages give no row.
    """
    page = F.coalesce(F.col(url), F.lit(""))
    site = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    each = pages.select(F.col(id_col), page.alias("__url"), F.concat(site, F.lit("/")).alias("__site"), F.posexplode(_cards(F.col(html))).alias("place", "__c")).select(id_col, "__url", "__site", "place", "__c.*")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    money = F.regexp_extract("text", r"([$€£₹]\s*[0-9](?:[0-9.,]*[0-9])?|\b[0-9](?:[0-9.,]*[0-9])?\s*(?:USD|EUR|GBP|CAD)\b)", 1)
    own = resolved(F.trim("link"), F.col("__site"))
    image = F.when(~F.col("image").rlike("|".join(NO_IMAGES)), resolved(F.trim("image"), F.col("__site")))
    each = each.withColumn("__said", stated(F.col("html")))
    said = lambda f: F.get(F.filter("__said", lambda s: s["field"] == f), 0)["value"]
    miles = F.regexp_extract("text", r"(?i)([0-9][0-9,]*)\s*(?:miles|mi|km|odometer)\b", 1)
    mileage = F.regexp_replace(F.coalesce(blank(miles), F.regexp_extract("html", r"data-mileage=[\"'](\d+)", 1)), ",", "").try_cast("long")
    each = each.select(
        id_col, "place", "title", "__url", "html", F.when(urls.host(own) == urls.host(F.col("__site")), own).otherwise(F.col("__url")).alias("url"), F.coalesce(blank(money), blank(F.col("price"))).alias("price"), image.alias("image"), blank(F.col("description")).alias("description"),
        F.upper(said("vin")).alias("vin"), said("stock_number").alias("stock_number"), mileage.alias("mileage"),
    )
    shown = F.coalesce("price", "image", "description", "vin").isNotNull() | (F.col("url") != F.col("__url"))
    first = each.where(shown).groupBy(id_col, F.lower("title").alias("__t")).agg(F.min_by(F.struct(*(c for c in each.columns if c != id_col)), "place").alias("__r")).select(id_col, "__r.*")
    vehicle = F.coalesce("vin", "stock_number", F.col("mileage").cast("string")).isNotNull() | F.lower(F.regexp_replace("title", r"\s+", " ")).rlike("|".join(VEHICLE_WORDS)) | F.col("__url").rlike("|".join(VEHICLE_PATHS))
    return first.select(
        id_col, "place", "title", "url", F.when(vehicle | F.col("price").isNotNull(), "product").otherwise("service").alias("data_type"), "price", "image", "description", "vin", "stock_number", "mileage", F.when(vehicle, condition(F.concat_ws(" ", "html", "__url", "url"))).alias("condition")
    )


def condition(said: Column) -> Column:
    return F.when(F.lower(said).rlike("cpo|certified"), "cpo").when(F.lower(said).rlike(r"new-vehicles|/new-inventory|\bnew\b"), "new").otherwise("used")
