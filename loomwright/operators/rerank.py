"""Rule-based ranking of candidates for one query, as a sum of Column expressions.

The query comes as an intent: plain values that a caller fills in. Each rule adds to the score or takes from it; rules that look at
earlier ones use their flags. Candidates have the columns of ``COLUMNS``; those missing are null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import numbers, text
from loomwright.functions.freshness import STALE

COLUMNS = {"id": "string", "title": "string", "content": "string", "category": "string", "tags": "string", "entity_type": "string", "price": "double", "rating": "double", "on_sale": "boolean", "in_stock": "boolean", "condition": "string", "mileage": "double", "year": "int", "similarity": "double", "image": "string", "still_listed": "boolean", "freshness": "string", "connector": "boolean", "created_at": "timestamp", "source_url": "string"}

# Clusters of meaning, each with the words of a query that call it, the words of a row that answer, and its points.
CLUSTERS = {
    "algorithms": (("coding", "code", "programmer", "programming", "algorithm", "algorithms", "algorithmic", "interview", "interviews", "dsa", "data structure", "data structures", "problem solving", "competitive programming", "neetcode"), ("leetcode", "algorithm", "algorithms", "coding", "code", "programmer", "programming", "dsa", "data structure", "data structures", "problem solving", "interview", "interviews"), 240),
    "web": (("fullstack", "full stack", "web development", "web dev", "frontend", "backend", "mern", "mean", "react", "reactjs", "node", "nodejs", "express", "mongodb", "javascript", "typescript", "nextjs", "html", "css"), ("fullstack", "full stack", "web development", "web dev", "frontend", "backend", "mern", "mean", "react", "node", "javascript", "typescript", "nextjs", "developer"), 240),
    "drivetrain": (("four wheel drive", "four-wheel drive", "4x4", "4wd", "all-wheel drive", "all wheel drive", "awd", "offroad", "off-road", "trail rated"), ("4x4", "4wd", "awd", "all-wheel drive", "four wheel drive", "four-wheel", "rubicon", "4xe", "trail rated", "offroad"), 240),
    "talent": (("freelancer", "freelancers", "freelance", "talent", "contractor", "contractors", "consultant", "consultants", "people who build", "builder", "builders", "specialist", "specialists"), ("talent", "freelance", "freelancer", "freelancers", "contractor", "contractors", "consultant", "consultants", "service", "services", "agency", "hire", "developer", "builder", "builders"), 240),
    "services": (("website development", "web service", "web services", "development service", "development services", "design service", "design services", "solution", "solutions"), ("service", "services", "solution", "solutions", "development", "consulting", "agency", "web", "course", "courses", "mastery", "talent"), 220),
}
# Ends of urls and words of titles that mark pages of information, by what they inform about, and pages that list others.
PAGE_ENDS = ("about", "privacy", "terms", "cookie", "policy", "faq", "faqs", "help", "contact")
PAGE_WORDS = ("terms", "privacy", "policy", "cookie", "disclaimer", "faq", "frequently asked")
PAGE_TYPES = ("faq", "policy", "info")
TOPICS = {
    "faq": (("/faq",), ("faq", "frequently asked", "questions")),
    "about": (("/about",), ("about", "who we are", "our story", "empowering learners", "connecting talent", "mission")),
    "policy": (("/policy", "/privacy", "/terms", "/cookie"), ("policy", "policies", "terms", "privacy", "cookie", "legal")),
    "contact": (("/contact",), ("contact", "support")),
}
LIST_ENDS = ("courses", "products", "services", "catalog", "inventory", "shop", "all")
LIST_WORDS = (("courses", "catalog"), ("all", "courses"), ("vehicle", "inventory"), ("all", "inventory"))
VEHICLE_MARKS = ("jeep", "dodge", "ram", "chrysler", "truck", "suv", "sedan", "dealer", "dealership", "coupe", "hatchback", "convertible")
COURSE_MARKS = ("course", "courses", "tutorial", "tutorials", "mastery", "curriculum", "bootcamp", "lesson", "lessons")
TALENT_ASKED, TALENT_TITLES, TALENT_TEXTS = ("freelancer", "talent"), ("talent", "freelance", "service"), ("talent", "freelance")
OFFERS = ("course", "product", "vehicle", "service")


def any_word(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words or phrases as a whole, with any white space inside."""
    return r"\b(?:" + "|".join(r"\s+".join(map(re.escape, w.split(" "))) for w in words) + r")\b"


def any_part(words: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, words))


@dataclass
class Intent:
    """What a query asks for; None where it says nothing."""

    query: str
    kind: str = "general"
    keywords: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    entity_type: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_rating: float | None = None
    on_sale: bool | None = None
    in_stock: bool | None = None
    condition: str | None = None
    max_mileage: float | None = None
    min_year: int | None = None
    max_year: int | None = None
    sort: str = "relevance"
    quantity: int | None = None
    informational: bool = False

    def informs(self) -> bool:
        """Asks for a page of information, said so or by its kind."""
        return self.informational or self.kind in TOPICS

    def clusters(self) -> list[str]:
        """The clusters of meaning that the query calls."""
        return [name for name, (asked, _, _) in CLUSTERS.items() if re.search(any_word(asked), self.query.lower())]

    def specific(self) -> bool:
        return self.kind == "specific_entity" or bool(self.keywords)

    def lists(self) -> bool:
        return self.kind == "catalog" or bool(self.entity_type)


def _title_flags(df: DataFrame, intent: Intent) -> DataFrame:
    q = text.normalize(F.lit(intent.query))
    t = F.col("__t")
    words = F.col("__qt")
    hit = lambda w: F.exists("__tt", lambda x: F.contains(x, w) | F.contains(w, x))
    close = lambda w: (F.length(w) >= 4) & F.exists("__tt", lambda x: (F.length(x) >= 4) & (F.levenshtein(x, w) <= F.when(F.length(w) >= 6, 2).otherwise(1)))
    df = df.withColumn("__t", text.normalize(F.coalesce("title", F.lit("")))).withColumn("__tt", text.tokens(F.coalesce("title", F.lit("")))).withColumn("__qt", text.tokens(F.lit(intent.query)))
    df = df.withColumn("__exact", (t == q) & (q != "")).withColumn("__partial", ~F.col("__exact") & (F.length(t) >= 4) & (F.length(q) >= 4) & (F.contains(q, t) | F.contains(t, q)))
    df = df.withColumn("__fuzzy", F.size(F.filter(words, lambda w: ~hit(w) & close(w)))).withColumn("__overlap", F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: hit(w) | close(w))) / F.size(words)).otherwise(F.lit(0.0)))
    typo = (F.length(t) >= 5) & (F.length(q) >= 5) & (F.levenshtein(t, q) <= 2)
    df = df.withColumn("__typo", typo).withColumn("__partly", F.col("__partial") | (F.col("__overlap") >= 0.5) | (F.col("__fuzzy") > 0) | F.col("__typo"))
    title = F.lower(F.coalesce("title", F.lit("")))
    corpus = F.lower(F.concat_ws(" ", "title", "category", "tags", "content"))
    df = df.withColumn("__title", title).withColumn("__corpus", corpus)
    url = F.lower(F.coalesce("source_url", F.lit("")))
    informs = url.rlike("/(" + "|".join(PAGE_ENDS) + ")/?$") | title.rlike(any_part(PAGE_WORDS)) | F.coalesce(F.col("entity_type").isin(*PAGE_TYPES), F.lit(False))
    lists = url.rlike("/(" + "|".join(LIST_ENDS) + ")/?$") | (~informs & title.rlike("|".join(rf"{one}\s*{two}" for one, two in LIST_WORDS)))
    kind = F.lower(F.coalesce("entity_type", F.lit("product")))
    vehicle = (kind == "vehicle") | title.rlike(any_word(VEHICLE_MARKS))
    course = ((kind == "course") | F.concat_ws(" ", title, F.lower(F.coalesce("content", F.lit("")))).rlike(any_word(COURSE_MARKS))) & ~vehicle
    df = df.withColumn("__informs", informs).withColumn("__lists", lists).withColumn("__detail", ~informs & ~lists & ((F.coalesce("price", F.lit(0.0)) != 0) | vehicle | course | F.col("__exact")))
    df = df.withColumn("__clusters", F.array_compact(F.array(*(F.when(F.col("__corpus").rlike(any_word(CLUSTERS[name][1])), F.lit(name)) for name in intent.clusters()))).cast("array<string>"))
    urls, words = TOPICS.get(intent.kind, ((), ()))
    topic = url.rlike(any_part(urls)) | title.rlike(any_part(words)) if words else F.lit(False)
    topic = topic | (kind == "faq") if intent.kind == "faq" else topic
    talent = (title.rlike(any_part(TALENT_TITLES)) | F.lower(F.coalesce("content", F.lit(""))).rlike(any_part(TALENT_TEXTS))) if any(w in intent.query.lower() for w in TALENT_ASKED) else F.lit(False)
    df = df.withColumn("__topic", topic).withColumn("__talent", talent)
    found = lambda k, where: F.col(where).rlike(any_word((k.lower(),)))
    more = 2 * (F.size("__clusters") + F.col("__topic").cast("int") + F.col("__talent").cast("int"))
    hits = sum((found(k, "__corpus").cast("int") for k in intent.keywords), F.lit(0))
    title_hits = sum((found(k, "__title").cast("int") for k in intent.keywords), F.lit(0))
    return df.withColumn("__hits", hits + more).withColumn("__title_hits", title_hits + F.col("__topic").cast("int") + F.col("__talent").cast("int"))


def _rules(intent: Intent) -> dict[str, Column]:
    c = F.col
    when = lambda test, yes, no=0: F.when(test, yes).otherwise(no)
    q, catalog = text.normalize(F.lit(intent.query)), F.lit(intent.lists())
    vector = F.coalesce((c("similarity") >= 0.28) | (c("similarity").isNotNull() & (c("__exact") | c("__partly") | catalog)), F.lit(False))
    known = lambda column, test, yes, no: F.when(c(column).isNull(), 0).when(test, yes).otherwise(no)
    out = {
        "title": F.when(c("__exact"), 1000).when(c("__partial") & F.contains(q, c("__t")), 550).when(c("__partial"), 500).otherwise(0),
        "overlap": F.when(c("__overlap") >= 0.75, numbers.half_up(400 * c("__overlap"))).when(c("__overlap") >= 0.5, numbers.half_up(250 * c("__overlap"))).otherwise(0),
        "fuzzy": 150 * c("__fuzzy"),
        "typo": when(c("__typo"), 150),
        "vector": when(vector, numbers.half_up(450 * F.coalesce("similarity", F.lit(0.0)))),
        "keywords": sum((F.when(c("__title").rlike(k), 60).when(F.lower(F.concat_ws(" ", "tags", "category")).rlike(k), 45).when(c("__corpus").rlike(k), 20).otherwise(0) for k in (any_word((x.lower(),)) for x in intent.keywords)), F.lit(0)),
        "clusters": sum((when(F.array_contains("__clusters", name), CLUSTERS[name][2]) for name in intent.clusters()), F.lit(0)),
        "topic": when(c("__topic"), 150),
        "talent": when(c("__talent"), 120),
        "broad": when(F.lit(intent.lists() and not intent.keywords) & ((F.coalesce("price", F.lit(0.0)) != 0) | c("image").isNotNull() | F.coalesce(c("entity_type").isin(*OFFERS), F.lit(False))), 80),
        "page": F.when(c("__detail"), 150).when(c("__lists"), -250 if intent.specific() else 0).when(c("__informs"), 350 if intent.informs() else -500 if intent.specific() else 0).otherwise(0),
        "synergy": (lambda n: when(n >= 2, 50 * (n - 1)))(c("__exact").cast("int") + c("__partly").cast("int") + vector.cast("int") + (c("__hits") > 0).cast("int")),
        "attributes": sum((when(F.contains(c("__corpus"), F.lit(a.lower())), 60) for a in intent.attributes), F.lit(0)),
        "negative": sum((when(F.contains(c("__corpus"), F.lit(n.lower())), -600) for n in intent.negative), F.lit(0)),
        "listed": when(F.coalesce("still_listed", F.lit(True)), 40, -400),
        "connector": when(F.coalesce("connector", F.lit(False)), 60),
        "fresh": F.when(c("freshness") == "fresh", 40).when(c("freshness") == "recent", 10).when(c("freshness") == STALE, -60).otherwise(0),
        "richness": when(c("price").isNotNull(), 30) + when(c("image").isNotNull(), 30) + when(F.coalesce("rating", F.lit(0.0)) > 0, 20),
    }
    if intent.keywords:
        informed = F.lit(intent.informs()) & c("__informs") & (c("__hits") > 0)
        protected = c("__exact") | c("__partly") | (F.coalesce("similarity", F.lit(0.0)) >= 0.28) | (F.size("__clusters") > 0) | informed
        out["missed"] = when(~protected & ((c("__hits") == 0) | (F.lit(len(intent.keywords) >= 2) & (c("__hits") < 2) & (c("__title_hits") == 0))), -800)
    if intent.entity_type:
        out["type"] = known("entity_type", c("entity_type") == intent.entity_type, 80, -500)
    if intent.max_price is not None:
        out["max_price"] = known("price", c("price") <= intent.max_price, 80, -500)
    if intent.min_price is not None:
        out["min_price"] = known("price", c("price") >= intent.min_price, 80, -500)
    if intent.on_sale is not None:
        out["sale"] = when(F.coalesce("on_sale", F.lit(False)) == intent.on_sale, 100 if intent.on_sale else 60, -400)
    if intent.min_rating is not None:
        out["rating"] = F.when(F.coalesce("rating", F.lit(0.0)) == 0, 0).when(c("rating") >= intent.min_rating, 80).otherwise(-400)
    if intent.in_stock is not None:
        out["stock"] = known("in_stock", c("in_stock") == intent.in_stock, 80, -600)
    if intent.condition:
        good = c("condition").isin("used", "cpo") if intent.condition == "used" else c("condition") == intent.condition
        out["condition"] = known("condition", good, 100 if intent.condition == "cpo" else 90, -400)
    if intent.max_mileage is not None:
        out["mileage"] = known("mileage", c("mileage") <= intent.max_mileage, 80, -500)
    for name, value, test in (("min_year", intent.min_year, c("year") >= intent.min_year), ("max_year", intent.max_year, c("year") <= intent.max_year)) if intent.min_year or intent.max_year else ():
        if value is not None:
            out[name] = known("year", test, 70, -400)
    return out


def rerank(candidates: DataFrame, intent: Intent, limit: int = 5, min_score: float = 0) -> DataFrame:
    """The best candidates with their score and, in ``reasons``, what each rule added.

    Scoring is one projection. Rows whose title has no normal form are left out; of titles with the same one the best stays, then a top-k; both use the score (or the asked order) and then the id.
    Where the best row's title is what was asked for, that row alone is given.
    """
    missing = {n: F.lit(None).cast(t) for n, t in COLUMNS.items() if n not in candidates.columns}
    df = _title_flags(candidates.withColumns(missing), intent)
    rules = _rules(intent)
    df = df.withColumn("reasons", F.struct(*(v.cast("long").alias(k) for k, v in rules.items())))
    df = df.withColumn("score", sum((F.coalesce(F.col("reasons")[k], F.lit(0)) for k in rules), F.lit(0).cast("long")))
    if not intent.lists():
        relevant = F.col("__exact") | F.col("__partly") | (F.col("__hits") > 0) | (F.coalesce("similarity", F.lit(0.0)) >= 0.28) | (F.lit(intent.informs()) & F.col("__informs"))
        df = df.withColumn("score", F.when(relevant, F.col("score")).otherwise(F.lit(-9999)))
    df = df.drop("__corpus", "__title", "__tt", "__qt").where(F.col("__t") != "")
    keys = {"price_asc": [F.coalesce("price", F.lit(999999.0)).asc()], "price_desc": [F.coalesce("price", F.lit(0.0)).desc()], "rating_desc": [F.coalesce("rating", F.lit(0.0)).desc()], "newest": [F.col("created_at").desc_nulls_last()]}.get(intent.sort, [])
    order = [*keys, F.col("score").desc(), F.col("id").asc()]
    # A filter on the score would be pushed below the projections and work all rules out once more, so rows beneath it have no order here instead.
    # The best row of a title is kept while rows are still where they were read, so a title of many rows costs one row a task.
    first = {"price_asc": F.coalesce("price", F.lit(999999.0)), "price_desc": -F.coalesce("price", F.lit(0.0)), "rating_desc": -F.coalesce("rating", F.lit(0.0)), "newest": F.coalesce(-F.unix_micros("created_at"), F.lit(2**63 - 1))}.get(intent.sort, F.lit(0))
    best = df.groupBy("__t").agg(F.min_by(F.struct(*df.columns), F.when(F.col("score") > min_score, F.struct(first.alias("first"), (-F.col("score")).alias("score"), "id"))).alias("__row")).where("__row is not null").select("__row.*")
    k = min(limit, intent.quantity) if intent.quantity else limit
    few = Window.orderBy(*order)  # over k rows at most
    top = best.orderBy(*order).limit(k).withColumn("__place", F.row_number().over(few)).withColumn("__alone", F.first("__exact").over(few))
    return top.where("__place = 1 or not __alone").select(*candidates.columns, "score", "reasons")
