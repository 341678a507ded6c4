"""Where a spoken request leads on a site: scoring of a site's destinations for each query, over an inverted index.

Words of destinations are posted under their site; what a query's words mean there (the same word, a part of it, or the same but for typing) is found between the distinct words of both sides: parts by their rarest
piece of six letters (as they stand, if shorter), typing by what is left of a word when up to two letters are dropped. A destination is scored only if it can reach the least score at all: with so many of the query's
words that it meets one of the rarest, by a word typed wrongly, by the concept of its page or as the home page. No pair of a query and a destination is made otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import concepts, urls
from loomwright.operators.scratch import materialise

# How requests begin and end, names of whole catalogs and of the home page, slugs and types of plain pages, concepts of information, and what stands between a title and the site's name.
SEEING = ("learn", "read", "see", "find")
FINDING = ("find", "see", "read", "learn about", "learn", "view")
BEGIN = (*(f"take me to where i can {w}" for w in SEEING), "take me to", *(f"where {a} {b}" for a in ("can i", "to", "i can") for b in FINDING), "navigate me to", "navigate to", "go to", "open up", "open", "view", "show me", "visit", "redirect me to", "redirect to", "bring me to", "lead me to", *(f"can you {a} me to" for a in ("take", "navigate", "redirect")))
OWNERS = ("course", "vehicle", "product", "service", "freelancer", "profile", "details")
END = (*(f"{w} page" for w in OWNERS), "page", "paje", "paige", "section", "tab", "screen", "details", "offering", "item", "product", "course", "corse", "vehicle", "listing", "link")
PAGE_WORDS = ("page", "section", "tab", "screen", "site", "url", "website")
ENTITY_WORDS = ("course", "product", "item", "vehicle", "car", "offering", "program")
WHOLE = ("course", "courses", "course catalog", "all courses", "classes", "catalog", "catalogue", "inventory", "vehicle", "vehicles", "all vehicles", "car", "cars", "all cars", "product", "products", "all products", "service", "services", "all services", "offerings", "shop", "store")
HOME = ("home", "homepage", "root", "start", "index", "main", "landing", "main page", "home page", "landing page", "website")
SLUGS = ("about", "about-us", "contact", "contact-us", "policy", "policies", "privacy", "privacy-policy", "terms", "terms-condition", "terms-of-use", "terms-of-service", "faq", "faqs", "pricing", "courses", "catalog", "inventory", "shop", "store", "services", "team", "blog", "careers", "docs", "help")
PLAIN_TYPES = ("text", "faq", "page", "info", "policy", "article", "blog")
ENTITY_TYPES = ("product", "service", "course", "vehicle")
INFORMING = ("about", "policy", "privacy", "terms", "faq", "contact", "careers", "docs")
SEPARATORS = "—–|•:-"
DANGEROUS = ("javascript", "data", "blob", "vbscript", "file")
LEAST, MARGIN = 450, 120


def words_of(x: Column, least: int = 2) -> Column:
    return F.filter(F.split(concepts.plain(x), " "), lambda w: F.length(w) >= least)


def target_of(query: Column | str) -> Column:
    """What a request names, without how it begins and ends."""
    spaced = lambda words: "|".join(r"\s+".join(map(re.escape, w.split(" "))) for w in words)
    ends = lambda x: F.trim(F.regexp_replace(x, r"[?.!,:;]+$", ""))
    bare = F.regexp_replace(ends(F.trim(query)), rf"(?i)^(?:please\s+)?(?:{spaced(BEGIN)})\s+(?:the\s+)?(?:page\s+(?:for|of)\s+)?", "")
    return ends(F.regexp_replace(bare, rf"(?i)\s+(?:{spaced(END)})$", ""))


def any_of(x: Column, words: tuple[str, ...]) -> Column:
    return F.lower(x).rlike(r"\b(?:" + "|".join(words) + r")\b")


def guarded(query: Column) -> Column:
    """False for requests that are urls no one may follow: dangerous schemes, urls without a scheme, credentials, private addresses. Other texts are fine."""
    q = F.trim(query)
    absolute = q.rlike("(?i)^https?://")
    return ~(q.rlike("(?i)^(?:" + "|".join(DANGEROUS) + "):") | F.startswith(q, F.lit("//")) | (absolute & ~urls.is_safe(q)))


def described(destinations: DataFrame) -> DataFrame:
    """destinations: site, id, url, title, entity_type, priced (boolean), facts (text of further fields). One row a url of a site, the least id; rows without a web url are left out."""
    web = destinations.where(F.col("url").rlike("^http")).withColumn("key", F.lower(F.regexp_replace(F.trim("url"), "/+$", "")))
    one = web.groupBy("site", "key").agg(F.min_by(F.struct("id", "url", "title", "entity_type", "priced", "facts"), F.col("id")).alias("r")).select("site", "key", "r.*")
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    df = one.withColumn("path", F.when(path == "", "/").otherwise(path)).withColumn("parts", F.filter(F.split("path", "/"), lambda s: s != ""))
    df = df.withColumn("slug", F.coalesce(F.get("parts", F.size("parts") - 1), F.lit("")))
    df = df.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.nullif("slug", F.lit("")), F.lit("Page")))
    df = df.withColumn("clean", F.trim(F.regexp_replace("title", rf"\s*[{SEPARATORS}]\s*[^{SEPARATORS}]+$", "")))
    kind, standard, top = F.lower(F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("text"))), F.lower("slug").isin(*SLUGS), F.size("parts") <= 1
    deep = ~standard & ((F.size("parts") >= 2) | F.coalesce("priced", F.lit(False)) | kind.isin(*ENTITY_TYPES))
    is_page = top | standard | kind.isin(*PLAIN_TYPES) | ~deep
    return df.withColumn("is_page", is_page).withColumn("is_entity", deep | ~is_page).withColumn("raw_slug", F.lower("slug"))


def typing_keys(word: Column) -> Column:
    """What is left of a word of 4 letters or more with up to one letter dropped, two from 6 letters on: words alike but for typing share one of these."""
    n = F.length(word)
    without = lambda w, i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))
    places = lambda w: F.sequence(F.lit(1), F.length(w))
    once = F.transform(places(word), lambda i: without(word, i))
    twice = F.flatten(F.transform(once, lambda w: F.transform(places(w), lambda i: without(w, i))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.array(word), F.when(n >= 4, once).otherwise(none), F.when(n >= 6, twice).otherwise(none)))


#: Letters of the longest pieces under which words are posted; a piece of three is shared by ever more of a site's numbers.
PIECE = 6


def pieces(word: Column, least: Column) -> Column:
    """All parts of ``least`` to PIECE letters of a word that has as many as ``least``."""
    sizes = F.sequence(least, F.least(F.length(word), F.lit(PIECE)))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n)))))


def bits(word: Column) -> Column:
    """All parts of one or two letters."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.array(F.substring(word, i, 1), F.substring(word, i, 2)))))


def meanings(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked: site, token. known: site, word (both distinct). Returns site, token, word, kind: same, part (the token stands within the word) or typo.

    A number is never taken for another one: page 7198 is not page 7197 typed wrongly.
    """
    same = asked.join(known.withColumn("token", F.col("word")), ["site", "token"]).select("site", "token", "word", F.lit("same").alias("kind"))
    posted = known.where(F.length("word") > 3).select("site", "word", F.explode(pieces(F.col("word"), F.lit(3))).alias("piece"))
    often = posted.groupBy("site", "piece").agg(F.count("*").alias("n"))
    rare = asked.where(F.length("token") >= 3).select("site", "token", F.explode(pieces(F.col("token"), F.least(F.length("token"), F.lit(PIECE)))).alias("piece")).join(often, ["site", "piece"]).groupBy("site", "token").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    part = rare.join(posted, ["site", "piece"]).where(F.contains("word", "token") & (F.col("word") != F.col("token")))
    short = asked.where(F.length("token") < 3)
    small = known.join(short.select("site").distinct(), "site", "left_semi").select("site", "word", F.explode(bits(F.col("word"))).alias("token")).join(short, ["site", "token"]).where(F.col("word") != F.col("token"))
    keyed = lambda df, c: df.where(F.length(c) >= 4).select("site", c, F.explode(typing_keys(F.col(c))).alias("left"))
    spelt = asked.where(~F.col("token").rlike("^[0-9]+$") & (F.length("token") >= 4))
    typed = keyed(spelt, "token").join(keyed(known.join(spelt.select("site").distinct(), "site", "left_semi"), "word"), ["site", "left"]).select("site", "token", "word").distinct().where((F.col("token") != F.col("word")) & concepts.typo(F.col("word"), F.col("token")))
    out = same.unionByName(part.select("site", "token", "word", F.lit("part").alias("kind"))).unionByName(small.select("site", "token", "word", F.lit("part").alias("kind")))
    return out.unionByName(typed.withColumn("kind", F.lit("typo")))


def near_concepts(term: Column) -> Column:
    """All concepts that have the whole term, or nearly it, as a name."""
    table = concepts.table_of((concepts.plain_name(a), c) for c, aliases in concepts.ALIASES.items() for a in aliases)
    return F.array_distinct(F.transform(F.filter(table, lambda n: concepts.typo(concepts.plain(term), n["name"])), lambda n: n["concept"]))


def resolved(queries: DataFrame, destinations: DataFrame, least: int = LEAST, margin: int = MARGIN) -> DataFrame:
    """queries: site, query_id, query. Returns query_id, status (exact, partial, ambiguous, not_found, invalid_url), score, id and url of the best destination, and options, up to four urls to choose from where it is ambiguous.

    Of equal scores the least id is best; exact matches come before others. A request that is a url itself is followed if its host is one of the site's or below it.
    """
    asked = queries.withColumn("query", F.trim(F.coalesce("query", F.lit("")))).withColumn("fine", guarded(F.col("query")) & (F.col("query") != ""))
    asked = materialise(asked.withColumn("direct", F.col("query").rlike("(?i)^https?://")).withColumn("target", target_of(F.col("query"))).withColumn("plain", concepts.plain(F.col("target"))))
    places = materialise(described(destinations))
    spoken = asked.where("fine and not direct").select("site", "query_id", "query", "target", "plain").withColumn("tokens", words_of(F.col("target")))
    spoken = spoken.withColumn("whole", F.lower(F.regexp_replace("target", r"\s+", " ")).isin(*WHOLE)).withColumn("home", F.col("plain").isin(*HOME))
    spoken = spoken.withColumn("to_page", any_of(F.col("query"), PAGE_WORDS)).withColumn("to_entity", any_of(F.col("query"), ENTITY_WORDS)).withColumn("concept", concepts.concept_of(F.col("target")))
    spoken = materialise(spoken.withColumn("by_concept", F.col("whole") | F.coalesce(F.col("concept").isin(*INFORMING), F.lit(False))))

    # Words under which a destination is found, with where they stand: title (with further facts), slug, the slug as one word, or the url.
    clean_words, slug_words = words_of(F.col("clean"), 1), words_of(F.col("slug"))
    marked = lambda words, where: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(where).alias("where")))
    url_words = F.filter(F.split(F.lower(F.regexp_replace("key", "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    # A whole target may also be the url's end with its accents, or the title with the site's name.
    other_words = F.array_except(F.concat(words_of(F.col("key"), 1), words_of(F.col("title"), 1)), F.concat(clean_words, url_words))
    all_words = F.concat(marked(clean_words, "title"), marked(words_of(F.coalesce("facts", F.lit(""))), "fact"), marked(slug_words, "slug"), marked(F.array("raw_slug"), "raw"), marked(url_words, "url"), marked(other_words, "url"))
    postings = materialise(places.select("site", F.col("id").alias("place"), F.explode(F.array_distinct(all_words)).alias("w")).select("site", "place", "w.word", "w.where").where("word <> ''"))
    # A target without a word of two letters is looked for under its single letters, or as it stands.
    probes = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.filter(F.split("plain", " "), lambda w: w != ""))
    extra = F.when(F.col("whole"), 350).otherwise(F.col("to_page").cast("int") * 200 + F.col("to_entity").cast("int") * 200)
    probed = spoken.select("site", "query_id", (F.size("tokens") > 0).alias("worded"), extra.alias("extra"), probes.alias("probes")).select("*", F.explode(F.array_distinct("probes")).alias("token"))
    probed = probed.withColumn("n", F.size("probes")).withColumn("times", F.size(F.filter("probes", lambda w: w == F.col("token"))))
    probed = materialise(probed.select("site", "query_id", "token", "n", "times", F.when(F.col("worded"), needed(F.col("n"), F.col("extra"), least)).otherwise(F.col("n")).alias("needed")))
    found = materialise(meanings(probed.select("site", "token").distinct(), postings.select("site", "word").distinct()))
    hits = found.join(postings, ["site", "word"]).where("kind <> 'part' or where <> 'fact'").where("kind = 'typo' or where <> 'raw' or kind = 'part'")
    often = materialise(found.where("kind <> 'typo'").join(postings.groupBy("site", "word").agg(F.count("*").alias("n_places")), ["site", "word"]).groupBy("site", "token").agg(F.sum("n_places").alias("often")))
    # A destination that meets none of the rarest n - needed + 1 words meets too few.
    before = Window.partitionBy("query_id").orderBy(F.coalesce("often", F.lit(0)), "token").rowsBetween(Window.unboundedPreceding, -1)
    rare = probed.join(often, ["site", "token"], "left").withColumn("before", F.coalesce(F.sum("times").over(before), F.lit(0))).where(F.col("before") <= F.col("n") - F.col("needed"))
    by_word = rare.select("site", "query_id", "token").join(hits.where("kind <> 'typo'").select("site", "token", "place").distinct(), ["site", "token"]).select("site", "query_id", "place")
    by_typing = probed.select("site", "query_id", "token").join(hits.where("kind = 'typo' and where <> 'url'").select("site", "token", "place").distinct(), ["site", "token"]).select("site", "query_id", "place")
    at_home = F.col("path").isin("/", "") | F.col("slug").isin("", "index.html")
    by_home = spoken.where("home").select("site", "query_id").join(places.where(at_home).select("site", F.col("id").alias("place")), "site")
    # Concepts of pages, only at sites where one is asked for.
    asking = spoken.where("by_concept").select("site", "query_id", F.col("plain").alias("q_plain"), F.col("concept").alias("q_concept"), near_concepts(F.col("target")).alias("q_near"))
    terms = places.where("is_page").join(asking.select("site").distinct(), "site", "left_semi").select("site", F.col("id").alias("place"), F.explode(F.array_distinct(F.array("slug", "clean", F.regexp_replace("path", "^/", "")))).alias("term")).where(concepts.plain(F.col("term")) != "")
    named = materialise(terms.select("term").distinct().select("term", concepts.plain(F.col("term")).alias("d_plain"), concepts.concept_of(F.col("term")).alias("d_concept"), near_concepts(F.col("term")).alias("d_near")))
    keys = lambda plain, own, near: F.array_distinct(F.concat(F.array(F.concat(F.lit("="), plain)), F.coalesce(F.array_compact(F.array(own)), F.array().cast("array<string>")), near))
    left = asking.withColumn("k", F.explode(keys(F.col("q_plain"), F.col("q_concept"), F.col("q_near"))))
    right = terms.join(named, "term").withColumn("k", F.explode(keys(F.col("d_plain"), F.col("d_concept"), F.col("d_near"))))
    holds = lambda near, one: F.coalesce(F.array_contains(near, one), F.lit(False))
    kin = (F.col("q_plain") == F.col("d_plain")) | F.coalesce(F.col("q_concept") == F.col("d_concept"), F.lit(False)) | holds(F.col("d_near"), F.col("q_concept")) | holds(F.col("q_near"), F.col("d_concept"))
    by_concept = materialise(left.join(right, ["site", "k"]).where(kin).select("site", "query_id", "place").distinct())
    pairs = materialise(by_word.unionByName(by_typing).unionByName(by_home).unionByName(by_concept).distinct())

    # What the words of a query met in each candidate.
    met = pairs.join(spoken.select("query_id", F.explode("tokens").alias("token")), "query_id").join(hits, ["site", "token", "place"])
    in_title = F.max((F.col("where").isin("title", "fact") | ((F.col("where") == "slug") & (F.col("kind") != "part"))).cast("int"))
    in_slug = F.max((F.col("where").isin("slug", "raw")).cast("int"))
    fuzzy = F.max(((F.col("kind") == "typo") & F.col("where").isin("title", "fact", "slug")).cast("int"))
    counted = pairs.join(spoken.select("query_id", F.posexplode("tokens").alias("at", "token")), "query_id")
    per_token = met.groupBy("query_id", "place", "token").agg(in_title.alias("t"), in_slug.alias("s"), fuzzy.alias("f"))
    overlap = counted.join(per_token, ["query_id", "place", "token"], "left").groupBy("query_id", "place").agg(F.sum(F.coalesce("t", F.lit(0))).alias("t"), F.sum(F.coalesce("s", F.lit(0))).alias("s"), F.sum(F.coalesce("f", F.lit(0))).alias("f"))
    both = pairs.join(spoken, ["site", "query_id"]).join(places.withColumnRenamed("id", "place"), ["site", "place"]).join(overlap, ["query_id", "place"], "left")
    both = both.join(by_concept.select("query_id", "place", F.lit(True).alias("kin")), ["query_id", "place"], "left")
    scored = scores(both)
    ranked = scored.where(F.col("score") >= least).withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("is_exact"), F.desc("score"), "place"))).where("rn <= 4")
    best = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rn", "score", "is_exact", "place", "url"))).alias("top"))  # four rows a query
    first, second = F.col("top")[0], F.get("top", F.lit(1))
    unsure = F.coalesce(~first["is_exact"] & (first["score"] - second["score"] < margin) & (first["url"] != second["url"]), F.lit(False))
    said = F.when(unsure, "ambiguous").when(first["is_exact"] | (first["score"] >= 800), "exact").when(first["score"] >= 500, "partial").otherwise("not_found")
    best = best.select("query_id", said.alias("status"), first["score"].alias("score"), first["place"].alias("id"), first["url"].alias("url"), F.when(unsure, F.array_distinct(F.transform("top", lambda r: r["url"]))).alias("options"))
    # A url is followed within the site's hosts.
    hosts = places.select("site", urls.host(F.col("url")).alias("host")).distinct()
    ends = F.col("direct") & F.col("fine")
    suffixes = asked.where(ends).select("site", "query_id", F.explode(host_suffixes(urls.host(F.col("query")))).alias("host"))
    allowed = suffixes.join(hosts, ["site", "host"]).select("query_id").distinct().withColumn("allowed", F.lit(True))
    known = hosts.select("site").distinct().withColumn("has_hosts", F.lit(True))
    out = asked.join(best, "query_id", "left").join(allowed, "query_id", "left").join(known, "site", "left")
    follow = ends & (F.coalesce("allowed", F.lit(False)) | F.col("has_hosts").isNull())
    empty = F.col("query") == ""
    status = F.when(follow, "exact").when(empty, "not_found").when(~F.col("fine") | F.col("direct"), "invalid_url").otherwise(F.coalesce("status", F.lit("not_found")))
    return out.select("query_id", status.alias("status"), "score", "id", F.when(follow, F.col("query")).otherwise(F.col("url")).alias("url"), "options")


def host_suffixes(host: Column) -> Column:
    """A host and the domains above it."""
    labels = F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def word_points(t: Column, s: Column) -> Column:
    """For the shares of a query's words that are met in the title and in the slug."""
    half_up = lambda x: F.floor(x + 0.5)
    return F.when(t >= 1, 850).when(t >= 0.6, half_up(t * 550)).otherwise(0) + F.when(s >= 1, 700).when(s >= 0.5, half_up(s * 400)).otherwise(0)


def needed(n: Column, extra: Column, least: int) -> Column:
    """How many of a query's n words a destination must meet, other than by typing, to reach the least score with at most ``extra`` points for its kind: all, where only the whole target can do it (a target that is
    the title, the slug, the path or the url's end, or stands within the title, is met with all its words)."""
    most = lambda m: word_points(m / n, m / n)
    return F.coalesce(F.get(F.filter(F.sequence(F.lit(1), n), lambda m: most(m) + F.when(most(m) >= 700, 200).otherwise(0) + extra >= least), F.lit(0)), n)


def scores(both: DataFrame) -> DataFrame:
    """Adds score and is_exact to pairs of a query and a destination with their counts of met words."""
    c, n = F.col, F.size("tokens")
    points = lambda test, x: F.when(test, x).otherwise(0)
    p, clean, whole_title, slug = c("plain"), concepts.plain(F.col("clean")), concepts.plain(F.col("title")), concepts.plain(F.col("slug"))
    spoken_url = F.lower(F.regexp_replace("target", "/+$", ""))
    home = c("home") & (F.col("path").isin("/", "") | c("slug").isin("", "index.html"))
    by_url = (spoken_url != "") & F.endswith("key", spoken_url)
    path = F.lower("path")
    by_path = ~by_url & ((path == F.concat(F.lit("/"), p)) | ((path == F.concat(F.lit("/"), c("raw_slug"))) & (p == slug)))
    titled = (clean != "") & (p != "") & ((clean == p) | (whole_title == p))
    within = ~titled & (clean != "") & (p != "") & F.contains(clean, p)
    slugged = (slug != "") & (p != "") & ((slug == p) | (c("raw_slug") == F.replace(p, F.lit(" "), F.lit("-"))))
    kin = F.coalesce("kin", F.lit(False))
    t, s, f = (F.when(n > 0, F.coalesce(x, F.lit(0)) / n).otherwise(0.0) for x in ("t", "s", "f"))
    fuzzy = F.coalesce("f", F.lit(0))
    matched = points(home, 1000) + points(by_url, 1000) + points(by_path, 950) + points(titled, 1000) + points(within, 950) + points(slugged, 900) + points(kin, 900)
    matched = matched + word_points(t, s) + 250 * fuzzy
    exact = home | by_url | by_path | titled | within | slugged | kin | ((t >= 1) & c("is_entity"))
    out = both.withColumn("matched", matched.cast("long")).withColumn("exact_so_far", exact)
    entity, page, asked_page, asked_entity = c("is_entity"), c("is_page"), c("to_page"), c("to_entity")
    strong = entity & (c("matched") >= 700)
    other = F.when(strong, 200).when(page & ~asked_page & (n >= 1), -200).otherwise(0) + points(asked_page, F.when(page, 200).when(entity, -400).otherwise(0)) + points(asked_entity, F.when(entity, 200).when(page, -300).otherwise(0))
    out = out.withColumn("score", c("matched") + F.when(c("whole"), F.when(page, 350).when(entity, -500).otherwise(0)).otherwise(other))
    return out.withColumn("is_exact", c("exact_so_far") | (c("whole") & page) | (~c("whole") & strong))
