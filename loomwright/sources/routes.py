"""Where the scripts of pages lead: routes of an application and endpoints of its data.

A second table holds scripts (url, body). What a script names is read off it once, before scripts and pages meet; a page asks for its few best scripts only, and its text is left behind before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import urls
from loomwright.operators.ordered import spread
from loomwright.operators.scratch import materialise
from loomwright.sources import network
from loomwright.sources.pages import GIVEN, resolved

# What marks a script that names routes or endpoints, with its weight, and how many scripts a page has looked at; how routes do not begin, members and folders that give them.
ROUTE_SCRIPTS, ROUTE_MOST = (("/app/", 10), ("layout", 5), ("page", 5), ("router", 4), ("main", 3)), 12
API_SCRIPTS, API_MOST = (("/app/", 10), ("page", 6), ("search", 5), ("gig", 5), ("course", 5), ("main", 3)), 10
API_BUNDLES = ("chunk", "main", "app", "page", "index")
NO_ROUTES = ("/_", "/static", "/node_modules", "/api")
ROUTE_MEMBERS = ("href", "url", "path", "route", "link")
CHUNKS, BUILDS = "/_next/static/chunks/pages/", "/_next/static/"
# Folders, attributes and calls that give endpoints; hosts of backends; how endpoints in scripts begin, names that are one, and those a backend usually has; how many of a page count.
API_FOLDERS = ("/api", "/en/ajax", "/ajax", "/inventory/api", "/search/api", "/services/api")
API_ATTRIBUTES, API_CALLS = ("data-api", "data-endpoint", "data-inventory-url", "data-url"), ("fetch", "$.ajax", "$.getjson", "$.get", "axios", "axios.get")
BACKENDS = ("onrender.com", "railway.app", "herokuapp.com", "vercel.app", "fly.dev")
API_STARTS = ("/api/", "/users/", "/gigs", "/courses", "/products", "/services", "/inventory", "/listings", "/properties", "/doctors", "/menu")
API_NAMES = ("get-courses", "get-all-courses", "all-courses", "courses", "catalog", "inventory", "get-products", "search-freelancers", "freelancers", "gigs")
USUAL = ("users/search/freelancers", "freelancers", "gigs", "services", "courses", "products", "inventory", "categories", "listings")
ENDPOINTS = 10


def any_of(test, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | test(p)
    return out


def literals(code: Column) -> Column:
    """What stands between two quotes of either kind, in order."""
    pieces = F.split(code, "[\"']")
    return F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def sources(html: Column) -> Column:
    """Addresses of a page's scripts, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<script\b[^>]*>)"), F.lit(1))
    return F.filter(F.transform(tags, lambda t: F.trim(F.regexp_extract(t, r"(?is)\ssrc\s*=\s*[\"']([^\"']*)", 1))), lambda s: s != "")


def best(found: Column, marks: tuple[tuple[str, int], ...], most: int) -> Column:
    """The ``most`` addresses of greatest weight, in their order where equal, with their rank."""

    def weight(s: Column) -> Column:
        out = F.lit(0)
        for part, points in marks:
            out = out + F.when(s.contains(part), points).otherwise(0)
        return out

    ordered = F.slice(F.sort_array(F.transform(found, lambda s, i: F.struct((-weight(s)).alias("w"), i.alias("i"), s.alias("src")))), 1, most)
    return F.transform(ordered, lambda s, i: F.struct(i.alias("rank"), s["src"].alias("src")))


def is_route(p: Column) -> Column:
    """A plain path that can be a page of the application."""
    plain = p.startswith("/") & ~p.rlike("[^A-Za-z0-9_/-]") & ~p.contains("//") & ~p.endswith("/") & F.length(p).between(2, 60)
    return plain & ~any_of(p.startswith, NO_ROUTES) & ~p.contains("webpack") & ~p.rlike("[A-Z0-9]{16}")


def own_routes(html: Column) -> Column:
    """Routes that a page states itself: its own and linked ones in its properties, and names of its chunks."""
    data = F.try_parse_json(F.regexp_extract(html, r"(?is)<script\b[^>]*__NEXT_DATA__[^>]*>(.*?)</script", 1))
    page = F.try_variant_get(data, "$.page", "string")
    props = F.to_json(F.try_variant_get(data, "$.props", "variant"))
    pair = lambda i: F.regexp_extract_all(props, F.lit(r'"([^"]*)"\s*:\s*"([^"]*)"'), F.lit(i))
    linked = F.filter(F.arrays_zip(pair(1).alias("name"), pair(2).alias("value")), lambda p: F.lower(p["name"]).isin(*ROUTE_MEMBERS) & p["value"].startswith("/") & F.length(p["value"]).between(2, 201))
    linked = F.transform(linked, lambda p: F.substring_index(p["value"], "?", 1))
    chunk = lambda s: F.regexp_replace(F.regexp_replace(F.substring_index(F.substring_index(F.replace(s, F.lit(CHUNKS), F.lit("")), "?", 1), "#", 1), "[.]js$", ""), r"\[[^\]]*\]", ":param")
    chunks = F.filter(F.transform(F.filter(sources(html), lambda s: s.startswith(CHUNKS)), chunk), lambda c: (c != "") & (c != "index") & ~c.startswith("_"))
    none = F.array().cast("array<string>")
    return F.concat(F.when(page.startswith("/") & ~page.isin("/_error", "/404"), F.array(page)).otherwise(none), F.coalesce(linked, none), F.transform(chunks, lambda c: F.concat(F.lit("/"), c)))


#: Paths of one script, and pages of one site that ask for it, that one row of the join carries: a script that every page loads is dealt over as many tasks as it has pieces.
PIECE, GROUP = 500, 1000
#: A piece meets the sites in bands: each gives about so many distinct routes, and has at least so many pages, as each takes a copy of the piece.
BAND, BAND_PAGES = 4000, 500
#: Distinct routes and rows that a task is meant to give, where it has more than one band.
TASK, TASK_ROWS = 3 * BAND, 100_000


def routes(pages: DataFrame, scripts: DataFrame, id_col: str, url: str, html: str, piece: int = PIECE, group: int = GROUP, band: int = BAND, band_pages: int = BAND_PAGES) -> DataFrame:
    """scripts: url, body. One row a page and distinct route: id, route (an absolute url), of the page itself and of its ROUTE_MOST best scripts and its build's manifest, as far as they are in ``scripts``.

    Null pages, urls without a scheme and scripts without a body give nothing; a script listed twice counts once. A path that one script alone names, and no page itself, can reach a page only once: such paths, usually nearly all, are
    not made distinct again after the join, so the rows of the result are not shuffled. What is shuffled are pieces of paths and groups of pages of one site, from which the rows are made where they meet: route by route, each with all
    pages of a group. A task has few distinct routes (Parquet's writer holds 1 MB of them once each before it writes all out), each many times on end, so that in columnar files a row takes a fraction of a byte.
    """
    site, text = origin(F.col(url)), F.coalesce(F.col(html), F.lit(""))
    base = pages.where(site != "").select(F.col(id_col), site.alias("__site"), text.alias("__html"))
    own = base.select(id_col, "__site", F.explode(own_routes(F.col("__html"))).alias("__path")).withColumn("__tail", tail(F.col("__path")))
    bundles = F.filter(sources(F.col("__html")), lambda s: s.rlike(r"(?i)[.]m?js(\?|$)"))
    build = F.regexp_extract("__html", r'"/_next/static/([^/"]+)/_buildManifest\.js"', 1)
    asked = F.transform(best(bundles, ROUTE_SCRIPTS, ROUTE_MOST), lambda s: F.struct(resolved(s["src"], F.concat(F.col("__site"), F.lit("/"))).alias("url"), F.lit("script").alias("kind")))
    manifest = F.when(build != "", F.array(F.struct(F.concat(F.col("__site"), F.lit(BUILDS), build, F.lit("/_ssgManifest.js")).alias("url"), F.lit("manifest").alias("kind")))).otherwise(F.array().cast("array<struct<url:string,kind:string>>"))
    wanted = base.select(id_col, "__site", F.explode(F.concat(asked, manifest)).alias("__s")).groupBy(id_col, "__site", F.col("__s.url").alias("__url"))
    wanted = wanted.agg(F.when(F.min("__s.kind") == F.max("__s.kind"), F.min("__s.kind")).otherwise("either").alias("__kind"))
    # Where a site ends like this, what stands before a path changes the path's normal form.
    wanted = materialise(wanted.withColumn("__odd", F.col("__site").rlike("[&]|[:/]$")))
    in_manifest = lambda p: p.startswith("/") & ~p.contains("/_") & F.length(p).between(2, 201)
    said = scripts.where("body is not null").select(F.col("url").alias("__url"), F.explode(F.array_distinct(literals(F.col("body")))).alias("__path")).distinct().withColumn("__s", is_route(F.col("__path"))).withColumn("__m", in_manifest(F.col("__path")))
    said = materialise(said.where((F.col("__s") | F.col("__m")) & urls.is_page(F.col("__path"))).withColumn("__tail", tail(F.col("__path"))))
    alone = said.groupBy("__tail").agg(F.count("*").alias("__n")).where("__n = 1").join(own.select("__tail"), "__tail", "left_anti").select("__tail", F.lit(True).alias("__alone"))
    kinds = F.explode(F.array_compact(F.array(F.lit("either"), F.when(F.col("__s"), "script"), F.when(F.col("__m"), "manifest")))).alias("__kind")
    said = said.join(alone, "__tail", "left").select("__url", "__path", "__tail", F.coalesce("__alone", F.lit(False)).alias("__alone"), kinds)
    said = materialise(said.join(wanted.select("__url", "__kind").distinct(), ["__url", "__kind"], "left_semi"))
    counted = said.groupBy("__url", "__kind", "__alone").agg(F.count("*").alias("__n"))
    asks = ["__site", "__odd", "__url", "__kind"]
    askers = materialise(wanted.join(counted.select("__url", "__kind").distinct(), ["__url", "__kind"], "left_semi").groupBy(asks).agg(F.count("*").alias("__asked")))
    sizes = counted.join(askers.groupBy("__url", "__kind").agg(F.count("*").alias("__sites"), F.sum("__asked").alias("__asked")), ["__url", "__kind"]).withColumn("__pieces", F.ceil(F.col("__n") / piece).cast("int"))
    bands = F.least(F.ceil(F.col("__sites") * F.col("__n") / F.col("__pieces") / band), F.floor(F.col("__asked") / band_pages))
    sizes = materialise(sizes.withColumn("__bands", F.greatest(bands, F.lit(1)).cast("int")))
    packed = said.join(sizes, ["__url", "__kind", "__alone"]).groupBy("__url", "__kind", "__alone", "__bands", F.pmod(F.xxhash64("__path"), "__pieces").cast("int").alias("__piece"))
    packed = materialise(packed.agg(*(F.sort_array(F.collect_list(x)).alias(x + "s") for x in ("__path", "__tail"))))
    # Pages of one site that ask for one script, in groups; null ids, which a list leaves out, count as others.
    ids, none = F.sort_array(F.collect_list(id_col)), F.array(F.lit(None).cast(wanted.schema[id_col].dataType))
    share = F.pmod(F.xxhash64(id_col), F.ceil(F.col("__asked") / group)).alias("__share")
    groups = materialise(wanted.join(askers, asks).groupBy(*asks, share).agg(F.when(F.count(id_col) < F.count("*"), F.concat(ids, none)).otherwise(ids).alias("__ids")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked_pieces = groups.join(sizes.select("__url", "__kind", "__alone", "__pieces", "__bands"), ["__url", "__kind"]).select("__url", "__kind", "__alone", F.pmod(F.xxhash64("__site"), "__bands").cast("int").alias("__band"), "__site", "__odd", "__ids", each("__pieces").alias("__piece"))
    dealt = packed.select("*", each("__bands").alias("__band")).drop("__bands")
    keys, of = ["__url", "__kind", "__alone", "__piece", "__band"], sizes.agg(F.sum(F.col("__sites") * F.col("__n")).alias("routes"), F.sum(F.col("__asked") * F.col("__n")).alias("rows")).first()
    tasks = int(min((of["routes"] or 0) // TASK, (of["rows"] or 0) // TASK_ROWS))
    met = spread(asked_pieces, *keys, least=tasks).join(spread(dealt, *keys, least=tasks), keys)
    at_site = F.transform("__tails", lambda t: F.concat("__site", t))
    once = met.where("__alone and not __odd").select("__ids", F.explode(at_site).alias("route")).select(F.explode("__ids").alias(id_col), "route")
    shared = met.where("not __alone or __odd").select("__ids", "__site", F.explode("__paths").alias("__path")).select(F.explode("__ids").alias(id_col), "__site", "__path")
    others = own.select(id_col, "__site", "__path").unionByName(shared)
    return others.select(id_col, urls.without_tracking(F.concat("__site", "__path")).alias("route")).distinct().unionByName(once)


def tail(path: Column) -> Column:
    """What follows the site in a route without tracking."""
    return F.substring(urls.without_tracking(F.concat(F.lit("http://h"), path)), 9, 1 << 30)


def own_endpoints(html: Column) -> Column:
    """Endpoints a page names itself: paths of data folders, then attributes, then calls; none that only measure visitors."""
    spaced = lambda p: p.rlike(r"[\s<>]")
    folders = F.filter(literals(html), lambda p: ~spaced(p) & any_of(lambda f: F.lower(p).startswith(f) & (F.length(p) > len(f)), API_FOLDERS))
    part = lambda i: F.regexp_extract_all(html, F.lit(GIVEN), F.lit(i))
    given = F.arrays_zip(part(1).alias("name"), part(2).alias("double"), part(3).alias("single"))
    given = F.filter(F.transform(given, lambda p: F.struct(F.lower(p["name"]).alias("name"), F.concat(p["double"], p["single"]).alias("value"))), lambda p: (p["value"] != "") & ~spaced(p["value"]))
    calls = lambda n: any_of(lambda c: (n == c) | n.endswith("." + c), API_CALLS)
    values = lambda test: F.transform(F.filter(given, lambda p: test(p["name"])), lambda p: p["value"])
    return F.filter(F.concat(folders, values(lambda n: n.isin(*API_ATTRIBUTES)), values(calls)), lambda p: ~network.is_tracker(p))


def backend(code: Column) -> Column:
    """The first address of a hosted backend in a script, with its api folder and version; null if none."""
    found = F.regexp_extract_all(code, F.lit(r"(https?://[A-Za-z0-9.-]+[A-Za-z0-9./_-]*)"), F.lit(1))
    hosted = F.get(F.filter(found, lambda u: any_of(lambda b: urls.host(u).endswith("." + b), BACKENDS)), 0)
    return F.concat(origin(hosted), F.regexp_extract(F.regexp_replace(hosted, r"^[a-z]+://[^/]*", ""), r"^(/api(?:/v[0-9]+)?)", 1))


def script_endpoints(code: Column) -> Column:
    """Endpoints a script names: values of members called url, paths of data, names of usual endpoints; each once, in order."""
    pieces = F.split(code, "[\"']")
    inner = F.transform(pieces, lambda p, i: F.struct(i.alias("i"), F.trim(p).alias("value"), F.get(pieces, i - 1).alias("before")))
    inside = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    named = lambda p: any_of(lambda s: p.startswith(s), API_STARTS) & ~p.rlike("[^A-Za-z0-9/_-]")
    kept = F.filter(inside, lambda x: (F.length(x["value"]) > 2) & (x["before"].rlike(r"(?i)url\s*:\s*$") | named(x["value"]) | x["value"].isin(*API_NAMES)) & ~x["value"].rlike("webpack|[.]js|[.]css"))
    return F.array_distinct(F.transform(kept, lambda x: x["value"]))


def endpoints(pages: DataFrame, scripts: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """scripts: url, body. One row a page and endpoint to ask for data: id, place, endpoint; the first ENDPOINTS of a page, its own before those of its API_MOST best scripts, then what a backend usually has.

    A script's endpoints count at the backend that it or, of those before it, the last with one names, and at the page's own site. Null pages, urls without a scheme and scripts without a body give nothing; a script listed twice counts once.
    """
    site, text = origin(F.col(url)), F.coalesce(F.col(html), F.lit(""))
    base = pages.where(site != "").select(F.col(id_col), site.alias("__site"), text.alias("__html"))
    at_home = lambda p: resolved(p, F.concat(F.col("__site"), F.lit("/")))
    own = base.select(id_col, "__site", F.lit(-1).alias("rank"), F.lit(None).cast("string").alias("base"), F.array_distinct(own_endpoints(F.col("__html"))).alias("found"))
    bundles = F.array_distinct(F.transform(F.filter(sources(F.col("__html")), lambda s: any_of(s.contains, API_BUNDLES)), at_home))
    wanted = base.select(id_col, "__site", F.inline(best(bundles, API_SCRIPTS, API_MOST))).withColumnRenamed("src", "__url")
    known = scripts.where("body is not null").select(F.col("url").alias("__url"), backend(F.col("body")).alias("base"), script_endpoints(F.col("body")).alias("found")).dropDuplicates(["__url"])
    led = wanted.join(known, "__url").select(id_col, "__site", "rank", "base", "found")
    steps = own.unionByName(led).groupBy(id_col, "__site").agg(F.sort_array(F.collect_list(F.struct("rank", "base", "found"))).alias("__steps"))

    def step(state: Column, s: Column) -> Column:
        """Endpoints so far and the backend known so far."""
        at = F.coalesce(s["base"], state["base"])

        def places(p: Column) -> Column:
            whole = p.rlike("(?i)^https?://")
            here = F.when(whole, p).otherwise(at_home(F.when((s["rank"] < 0) | p.startswith("/"), p).otherwise(F.concat(F.lit("/api/"), p))))
            there = F.when((s["rank"] >= 0) & ~whole, F.concat(at, F.lit("/"), F.regexp_replace(p, "^/+", "")))
            return F.array_compact(F.array(there, here))

        return F.struct(at.alias("base"), F.concat(state["found"], F.flatten(F.transform(s["found"], places))).alias("found"))

    start = F.struct(F.lit(None).cast("string").alias("base"), F.array().cast("array<string>").alias("found"))
    usual = lambda b: F.when(b.isNotNull(), F.array(*(F.concat(b, F.lit("/" + u)) for u in USUAL))).otherwise(F.array().cast("array<string>"))
    whole = steps.select(id_col, F.aggregate("__steps", start, step).alias("__all"))
    whole = whole.select(id_col, F.slice(F.array_distinct(F.concat(F.col("__all.found"), usual(F.col("__all.base")))), 1, ENDPOINTS).alias("__found"))
    return whole.select(id_col, F.posexplode("__found").alias("place", "endpoint"))
