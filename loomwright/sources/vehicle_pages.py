"""What a page about one vehicle says of it: labels and values in its text, members of its scripts, its title and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.sources.pages import resolved

# Labels by what they name, first match first; members and attributes of scripts and tags that say the same; what a value must look like; classes of prices.
LABELS = {
    "vin": ("vin", "vehicle identification number"), "stock_number": ("stock #", "stock number", "stock no", "stock#", "stock"), "mileage": ("kilometers", "kilometres", "kilometer", "kilometre", "mileage", "odometer"), "model": ("model",), "trim": ("trim level", "trim"),
    "body_style": ("category", "body style", "body"), "exterior_color": ("exterior colour", "exterior color", "couleur extérieure", "paint", "colour", "color"), "interior_color": ("interior colour", "interior color", "upholstery", "interior", "couleur intérieure", "seating", "cabin"),
    "drivetrain": ("drive train", "drivetrain", "rouage"), "transmission": ("transmission",), "engine": ("engine", "moteur", "motor"), "fuel": ("fuel type", "fuel", "carburant"), "passengers": ("passengers", "passenger", "seating capacity", "seating", "places", "place"), "doors": ("doors", "door", "portes", "porte"),
    "towing_capacity": ("towing capacity up to", "towing capacity", "capacité de remorquage jusqu'à", "capacité de remorquage", "towing"), "city_fuel": ("city", "city fuel", "city fuel efficiency"), "highway_fuel": ("highway", "highway fuel", "highway fuel efficiency"),
    "msrp": ("msrp", "retail price", "original price", "regular price", "prix de détail"), "price": ("selling price", "sale price", "cash price", "our price", "prix de vente", "price"),
}
MEMBERS = {
    "data-vin": "vin", "vin": "vin", "data-stock": "stock_number", "stockNumber": "stock_number", "data-mileage": "mileage", "mileage": "mileage", "model": "model", "trim": "trim", "exteriorColor": "exterior_color", "interiorColor": "interior_color", "drivetrain": "drivetrain", "transmission": "transmission",
    "engine": "engine", "fuelType": "fuel", "seatingCapacity": "passengers", "numberOfDoors": "doors", "towingCapacity": "towing_capacity", "msrp": "msrp", "sellingPrice": "price", "price": "price",
}
SHAPES = {"vin": "^[A-HJ-NPR-Za-hj-npr-z0-9]{17}$", **{k: "[0-9]" for k in ("mileage", "passengers", "doors", "city_fuel", "highway_fuel", "msrp", "price")}}
PRICE_CLASSES = {"msrp": ("msrp", "original-price", "regular-price"), "price": ("selling-price", "sale-price", "price-value", "dealer-price")}
#: What makes a page one about a vehicle.
TELLING = ("vin", "stock_number", "mileage", "drivetrain", "transmission", "towing_capacity", "exterior_color")
# Makes, first match first; parts of images that are none of the vehicle.
MAKES = ("Ford", "Jeep", "Ram", "Dodge", "Chrysler", "BMW", "Mercedes-Benz", "Audi", "Toyota", "Honda", "Hyundai", "Kia", "Nissan", "Chevrolet", "GMC", "Cadillac", "Buick", "Volkswagen", "Subaru", "Mazda", "Lexus", "Acura", "Infiniti", "Volvo", "Lincoln", "Genesis", "Porsche", "Land Rover", "Jaguar", "Fiat", "Alfa Romeo", "Tesla")
NO_IMAGES = ("data:image", "placeholder", "icon", "logo")


def is_vehicle_url(url: Column) -> Column:
    """An address of one vehicle in a shop's inventory."""
    steps = F.split(F.lower(F.regexp_replace(url, "[?#].*$", "")), "/")
    after = lambda i: F.coalesce(F.get(steps, i + 1), F.lit(""))
    numbered = lambda s, i: s.isin("used", "new", "cpo", "certified", "inventory", "vehicle", "vehicles") & after(i).rlike(r"[^/]-id[0-9]+[.]html")
    listed = lambda s, i: (s == "inventory") & after(i).isin("used", "new", "cpo") & (after(i + 1) != "")
    by_number = lambda s, i: (s == "vehicle") & after(i).rlike("^[0-9]")
    return F.coalesce(F.exists(F.transform(steps, lambda s, i: numbered(s, i) | listed(s, i) | by_number(s, i)), lambda x: x), F.lit(False))


def stated(html: Column) -> Column:
    """field, rank, value of everything a page states under a known name, in order of the page. A label has its value behind a colon, or in the next run of text; names of members rank behind labels, classes of prices behind these."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"(?s)<!--.*?-->", " ")
    runs = F.filter(F.transform(F.split(bare, r"(?s)<[^>]*>|\n"), lambda r: F.trim(F.regexp_replace(text.decode_entities(r), r"\s+", " "))), lambda r: r.rlike("[^: ]"))
    names = {label: (field, rank) for field, labels in reversed(LABELS.items()) for rank, label in enumerate(labels)}
    doubled = {label: [f for f, labels in LABELS.items() if label in labels] for label in names}
    known = F.create_map(*(x for label in names for x in (F.lit(label), F.array(*(F.struct(F.lit(f).alias("field"), F.lit(LABELS[f].index(label)).alias("rank")) for f in doubled[label])))))
    label = lambda r: F.lower(F.trim(F.substring_index(r, ":", 1)))
    behind = lambda r: F.trim(F.substring(r, F.instr(r, ":") + 1, F.length(r)))
    value = lambda r, i: F.when(r.contains(":") & (behind(r) != ""), behind(r)).otherwise(F.get(runs, i + 1))
    none = F.array().cast("array<struct<field:string,rank:int,value:string>>")
    labelled = F.flatten(F.transform(runs, lambda r, i: F.coalesce(F.transform(F.try_element_at(known, label(r)), lambda k: F.struct(k["field"].alias("field"), k["rank"].alias("rank"), value(r, i).alias("value"))), none)))
    member = lambda i: F.regexp_extract_all(html, F.lit(r"([A-Za-z][A-Za-z-]*)[\"']?\s*[:=]\s*[\"']?([^\"'<>,}]+)"), F.lit(i))
    fields = F.create_map(*(F.lit(x) for pair in MEMBERS.items() for x in pair))
    members = F.filter(F.transform(F.arrays_zip(member(1).alias("n"), member(2).alias("v")), lambda p: F.struct(F.try_element_at(fields, p["n"]).alias("field"), F.lit(100).alias("rank"), F.trim(p["v"]).alias("value"))), lambda m: m["field"].isNotNull())
    classed = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(200).alias("rank"), F.trim(F.regexp_extract(html, rf"(?is)<span[^>]*class=[\"'][^\"']*(?:{'|'.join(c)})[^\"']*[\"'][^>]*>([^<]*)<", 1)).alias("value")) for f, c in PRICE_CLASSES.items()))
    shapes = F.create_map(*(F.lit(x) for pair in SHAPES.items() for x in pair))
    fits = lambda s: (F.coalesce(s["value"], F.lit("")) != "") & F.coalesce(F.regexp_like(s["value"], F.try_element_at(shapes, s["field"])), F.lit(True))
    return F.filter(F.concat(labelled, members, classed), fits)


def vehicles(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """One row a page about one vehicle: id, title, condition, year, make, model and what else it states; what it does not state is null.

    A page is one if its address says so or it states a value that only vehicles have, and it has a title, a vehicle number or a stock number. Labels are whole runs of text; of several values the first label's first counts, and
    numbers must hold a digit. Null pages give no row. Nothing leaves a page's row, so there is no shuffle.
    """
    site = F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    found = pages.where(F.col(html).isNotNull()).select(F.col(id_col), F.coalesce(F.col(url), F.lit("")).alias("__url"), site.alias("__site"), F.col(html).alias("__html"), stated(F.col(html)).alias("__said"))
    found = found.where(is_vehicle_url(F.col("__url")) | F.exists("__said", lambda s: s["field"].isin(*TELLING)))
    title = F.coalesce(text.tag_text(F.col("__html"), "h1"), F.nullif(F.trim(F.regexp_extract(F.coalesce(text.tag_text(F.col("__html"), "title"), F.lit("")), "^([^|—]*)", 1)), F.lit("")))

    def said(field: str) -> Column:
        own = F.transform(F.filter("__said", lambda s: s["field"] == field), lambda s, i: F.struct(s["rank"].alias("rank"), i.alias("i"), s["value"].alias("value")))
        return F.array_min(own)["value"]

    digits = lambda f: F.regexp_replace(said(f), "[^0-9]", "").try_cast("long")
    number = lambda f: F.regexp_extract(said(f), "([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")
    money = lambda f: F.regexp_replace(said(f), "[^0-9.]", "").try_cast("double")
    found = found.select("*", F.coalesce(title, F.lit("")).alias("title"))
    named = F.concat_ws(" ", "title", "__url")
    make = F.coalesce(*(F.when(named.rlike(rf"(?i)\b{m}\b"), m) for m in MAKES))
    every = F.lower(F.concat_ws(" ", "__url", "title", "__html"))
    condition = F.when(every.rlike("cpo|certified"), "cpo").when(every.rlike(r"/new-vehicles|/new-inventory|\bnew\b"), "new").otherwise("used")
    year = F.regexp_extract(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("__url")), r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")
    tags = F.regexp_extract_all("__html", F.lit(r"(?is)(<img\b[^>]*>)"), F.lit(1))
    source = lambda t: F.trim(F.element_at(F.array_append(F.regexp_extract_all(t, F.lit(r"(?i)(?:src|data-lazy|data-highres|data-large)\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)), F.regexp_extract(t, r"(?i)\ssrc\s*=\s*[\"']([^\"']+)", 1)), 1))
    good = F.filter(F.transform(tags, source), lambda s: (s != "") & ~s.rlike("|".join(NO_IMAGES)))
    images = F.array_distinct(F.filter(F.transform(good, lambda s: F.replace(resolved(s, F.concat(F.col("__site"), F.lit("/"))), F.lit(" "), F.lit("%20"))), lambda u: u.startswith("http")))
    texts = ("model", "trim", "stock_number", "body_style", "exterior_color", "interior_color", "drivetrain", "transmission", "engine", "fuel", "towing_capacity")
    unit = F.when(F.col("__url").contains(".ca"), "L/100km").otherwise("MPG")
    out = found.select(
        id_col, "title", condition.alias("condition"), year.alias("year"), make.alias("make"), F.upper(said("vin")).alias("vin"), *(said(f).alias(f) for f in texts), digits("mileage").alias("mileage"), *(number(f).cast("int").alias(f) for f in ("passengers", "doors")),
        number("city_fuel").alias("city_fuel"), number("highway_fuel").alias("highway_fuel"), unit.alias("fuel_unit"), money("price").alias("price"), money("msrp").alias("msrp"), images.alias("images"),
    )
    return out.where("title <> '' OR vin IS NOT NULL OR stock_number IS NOT NULL")
