"""What web pages hold: links, metadata, main text, structured data, platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text, urls
from loomwright.operators.scratch import materialise

#: Marks by which shop platforms show in a page, first match first.
PLATFORMS = (("shopify", "cdn.shopify.com|shopify.theme"), ("woocommerce", "woocommerce|wp-content/plugins/woo"), ("d2cmedia", "d2cmedia"), ("dealer_dot_com", "dealer.com|ddc-"), ("dealer_inspire", "dealerinspire"))
# Signs of refusal in an error message, and in a short body; below which length a body is short.
REFUSED = (
    "blocked", "access denied", "bot detected", "cloudflare", "attention required! | cloudflare", "just a moment...", "datadome", "perimeterx", "incapsula", "imperva", "akamai", "verify you are human", "security check", "enable javascript and cookies to continue", "pardon our interruption", "request rejected",
    "rejected by d2c media", "d2c media's firewall", "browsing from outside north america", "site-firewall",
)
BLOCKED = ("cloudflare", "datadome", "access denied", "verify you are human", "pardon our interruption", "please complete the security check", "request rejected", "rejected by d2c media", "d2c media's firewall", "browsing from outside north america")
SHORT = 2500
# Words that name a section of a site.
SECTION_WORDS = (
    "services", "freelancers", "courses", "classes", "shop", "products", "inventory", "vehicles", "pricing", "plans", "about", "contact", "faq", "faqs", "blog", "team", "careers", "properties", "listings", "doctors", "menu", "search-gigs", "gigs", "curriculum", "features",
)


# Attributes whose values are links, calls and assignments of scripts that go to one, and how values begin that are no pages.
LINK_ATTRIBUTES = ("href", "data-url", "data-link", "data-path", "action", "to")
LINK_CALLS = ("router.push", "history.push", "history.pushstate", "navigate", "location.href", "location.assign", "location.replace")
NO_LINKS = ("javascript:", "mailto:", "tel:", "data:")
#: Attributes and calls that take names of anything; of theirs only values count that can be a path.
LOOSE = ("to", *LINK_CALLS)
#: A name and the quoted value it is given or called with.
GIVEN = r"([A-Za-z_$][A-Za-z0-9_$.:-]*)\s*[=(]\s*(?:\"([^\"]*)\"|'([^']*)')"


def given_links(html: Column) -> Column:
    """Values of the names that lead somewhere. A page is read once into names and values, then names are told apart; a call may stand behind the object it belongs to."""
    every = lambda i: F.regexp_extract_all(html, F.lit(GIVEN), F.lit(i))
    pairs = F.arrays_zip(every(1).alias("name"), every(2).alias("double"), every(3).alias("single"))

    def leads(p: Column) -> Column:
        name, value = F.lower(p["name"]), F.trim(F.concat(p["double"], p["single"]))
        own = lambda call: (name == call) | F.endswith(name, F.lit("." + call))
        called = F.lit(False)
        for call in LINK_CALLS:
            called = called | own(call)
        loose = called | name.isin(*LOOSE)
        kept = (called | name.isin(*LINK_ATTRIBUTES)) & (value != "") & ~F.startswith(value, F.lit("#")) & (~loose | value.rlike("^[/?A-Za-z0-9_-]"))
        return F.when(kept, value)

    return F.array_compact(F.transform(pairs, leads))


def resolved(raw: Column, page: Column) -> Column:
    """A link as an absolute url: with a scheme as it stands, else from the page's scheme, host or folder; dots in paths are followed."""
    scheme, host = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1), urls.host(page)
    site = F.concat(scheme, F.lit("://"), host)
    path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    local = F.when(raw.startswith("/"), raw).when(raw.startswith("?"), F.concat(F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), raw)).otherwise(F.concat(F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/")), raw))
    bare, rest = F.regexp_extract(local, r"^([^?#]*)", 1), F.regexp_extract(local, r"^[^?#]*(.*)$", 1)
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    walked = F.array_join(F.aggregate(F.split(bare, "/"), F.array().cast("array<string>"), step), "/")
    walked = F.when(bare.rlike(r"(^|/)\.+(/|$)"), walked).otherwise(bare)
    return F.when(raw.rlike("(?i)^https?://"), raw).when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw)).when(~raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(site, walked, rest))


def links(pages: DataFrame, id_col: str, url: str, html: str, own: bool = False) -> DataFrame:
    """One row a page and distinct link target, resolved against the page's url; only pages of its own host, and the page itself where ``own`` says so."""
    raw = given_links(F.coalesce(F.col(html), F.lit("")))
    kept = F.filter(F.array_distinct(raw), lambda x: (x != "") & ~F.lower(x).rlike("^(?:" + "|".join(NO_LINKS) + ")"))
    out = pages.select(id_col, F.col(url).alias("__page"), F.explode(F.array_append(kept, F.col(url)) if own else kept).alias("__raw"))
    out = out.select(id_col, urls.host(F.col("__page")).alias("__host"), urls.without_tracking(resolved(F.col("__raw"), F.col("__page"))).alias("link"))
    return out.where((urls.host(F.col("link")) == F.col("__host")) & urls.is_page(F.col("link"))).select(id_col, "link").distinct()


def srcset(x: Column) -> Column:
    """Urls of a srcset, the largest first (a pixel density counts a thousand of width, no descriptor as density one); equal ones stay in order."""
    parts = F.filter(F.transform(F.split(F.trim(x), r",\s+"), F.trim), lambda p: p != "")
    value = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"\s(\d+(?:\.\d+)?)[wxWX]$", 1), F.lit("")).cast("double"), F.lit(1.0))
    sized = F.transform(parts, lambda p, i: F.struct((-value(p) * F.when(F.lower(p).rlike(r"\s[0-9.]+w$"), 1).otherwise(1000)).alias("size"), i.alias("place"), F.regexp_extract(p, r"^(\S+)", 1).alias("url")))
    return F.transform(F.sort_array(sized), lambda s: s["url"])


def page_text(html: Column, most: int | None = None) -> Column:
    """Text of the main or article part, or of the whole body; cut at ``most`` characters where given."""
    main = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<(?:main|article)\b[^>]*>(.*?)</(?:main|article)>", 1), F.lit("")), html)
    plain = F.regexp_replace(main, r"(?is)<(nav|header|footer|aside|form)\b[^>]*>.*?</\1>", " ")
    whole = text.strip_tags(plain)
    return whole if most is None else F.substring(whole, 1, most)


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by name or property."""
    return F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]+(?:name|property)=["\']{name}["\'][^>]*content=["\']([^"\']*)["\']', 1), F.lit(""))


def ld_blocks(html: Column) -> Column:
    """Texts of a page's structured-data blocks."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))


def json_ld(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """One row a page and structured-data object (graphs and lists unfolded), as a Variant; what does not parse is passed over."""
    parsed = pages.select(id_col, F.explode(ld_blocks(F.col(html))).alias("__b")).select(id_col, F.try_parse_json("__b").alias("v")).where("v is not null")
    graph = parsed.select(id_col, F.coalesce(F.try_variant_get("v", "$.@graph", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v")).alias("items"))
    return graph.select(id_col, F.explode("items").alias("item")).withColumn("kind", F.try_variant_get("item", "$.@type", "string"))


def vehicles(items: DataFrame) -> DataFrame:
    """Vehicle objects of structured data as typed columns; what a page does not say is null."""
    get = lambda path, kind="string": F.try_variant_get("item", path, kind)
    some = items.where(F.col("kind").isin("Vehicle", "Car", "Motorcycle", "Product"))
    return some.select("*", get("$.name").alias("title"), get("$.vehicleIdentificationNumber").alias("vin"), get("$.sku").alias("stock_number"), F.coalesce(get("$.brand.name"), get("$.brand")).alias("make"), F.coalesce(get("$.model.name"), get("$.model")).alias("model"), get("$.vehicleModelDate").cast("int").alias("year"), F.coalesce(get("$.offers.price", "double"), get("$.offers[0].price", "double")).alias("price"), get("$.mileageFromOdometer.value", "double").alias("mileage"))


def platform(html: Column) -> Column:
    out = F.lit("unknown")
    for name, marks in reversed(PLATFORMS):
        out = F.when(F.lower(html).rlike(marks), name).otherwise(out)
    return out


def is_blocked(status: Column, body: Column, message: Column | None = None) -> Column:
    """Refused by status, by a sign in the error message, or by a sign in a short body; nulls refuse nothing."""

    def signed(text_: Column, signs: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for s in signs:
            out = out | F.contains(F.lower(text_), F.lit(s))
        return F.coalesce(out, F.lit(False))

    said = signed(message, REFUSED) if message is not None else F.lit(False)
    return F.coalesce(status.isin(403, 429), F.lit(False)) | said | (F.coalesce(F.length(body) < SHORT, F.lit(False)) & signed(body, BLOCKED))


def sections(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """One row a page and section that its navigation names: id, place, label, href. Of equal labels (in any case) the first counts.

    Links are taken from elements whose class or name says that they navigate, or from the whole page where none does. A link is a section if its text of 2 to 30 characters holds a word of sections, or it leads to a short path of the site. Null pages give nothing.
    """
    tag = r"(?is)<(nav|header|div)\b[^>]*\b(?:class|id)\s*=\s*[\"'][^\"']*(?:nav|menu|header)[^\"']*[\"'][^>]*>(.*?)</(?:nav|header|div)>"
    parts = F.regexp_extract_all(F.col(html), F.lit(tag), F.lit(2))
    text_ = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.col(html))
    anchors = F.regexp_extract_all(text_, F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1))
    read = F.transform(anchors, lambda a: F.struct(F.trim(F.regexp_replace(a, "<[^>]*>", "")).alias("label"), F.trim(F.regexp_extract(a, r"(?is)^<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)", 1)).alias("href")))

    def is_section(x: Column) -> Column:
        word = F.lit(False)
        for w in SECTION_WORDS:
            word = word | F.contains(F.lower(x["label"]), F.lit(w))
        path = x["href"].startswith("/") & ~x["href"].startswith("/_") & (F.length(x["href"]) < 40)
        return (x["href"] != "") & ~x["href"].startswith("#") & F.length(x["label"]).between(2, 30) & (word | path)

    kept = pages.select(id_col, F.filter(read, is_section).alias("__s")).withColumn("__l", F.transform("__s", lambda x: F.lower(x["label"])))
    return kept.select(id_col, F.posexplode(F.filter("__s", lambda x, i: F.array_position("__l", F.lower(x["label"])) == i + 1)).alias("place", "__x")).select(id_col, "place", "__x.label", "__x.href")


def is_thin(plain: Column) -> Column:
    return (F.length(plain) < 150) | F.lower(plain).contains("loading...")


def sitemap_urls(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), text.decode_entities)


def sitemap_pages(documents: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """documents: url, body. roots: site, url, the sitemaps to begin with. Returns site, url, depth: the pages that sitemaps name, and how many steps below a root the nearest such sitemap is.

    Sitemaps that name sitemaps are followed ``depth`` steps, each once a site (so cycles end), at its least depth. Only urls of the root's host count. One join a level, each level written.
    """
    named = documents.select(F.col("url").alias("map"), F.explode(F.array_distinct(sitemap_urls(F.col("body")))).alias("url"))
    named = materialise(named.where(F.col("url").rlike("^http")).select("map", "url", F.regexp_extract("url", r"(?i)\.xml$", 0).alias("x")))
    level = materialise(roots.select("site", F.col("url").alias("map"), urls.host(F.col("url")).alias("host")).distinct())
    seen = found = None
    for d in range(depth + 1):
        seen = level if seen is None else seen.unionByName(level)
        below = materialise(level.join(named, "map").where(urls.host(F.col("url")) == F.col("host")))
        here = below.where((F.col("x") == "") & urls.is_page(F.col("url"))).select("site", urls.without_tracking(F.col("url")).alias("url"), F.lit(d).alias("depth"))
        found = here if found is None else found.unionByName(here)
        next_ = below.where("x <> ''").select("site", F.col("url").alias("map"), "host").distinct()
        level = materialise(next_.join(seen.select("site", "map"), ["site", "map"], "left_anti"))
    return found.groupBy("site", "url").agg(F.min("depth").alias("depth"))


def robots_rules(body: Column) -> Column:
    """Disallowed paths for all agents."""
    group = F.regexp_extract(body, r"(?is)user-agent:\s*\*\s*(.*?)(?:user-agent:|\z)", 1)
    return F.regexp_extract_all(group, F.lit(r"(?im)^disallow:\s*(\S+)"), F.lit(1))
