"""Crawl frontiers, coverage reports and one-to-one matching of crawled entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.scratch import materialise

# Marks of inventory routes in urls, and how much of a crawl may be blocked.
ROUTES = {"new": r"\b(?:new-vehicles|new-inventory|new-cars|searchnew)\b|/new/", "used": r"\b(?:used-vehicles|used-inventory|used-cars|pre-owned|searchused)\b|/used/", "cpo": r"\b(?:cpo|certified-pre-owned|certified)\b"}
BLOCKED_SHARE = 0.5
DYNAMIC = ("nextjs_route", "frontier_bfs", "crawl4ai_seed", "recrawl_escalation")


def frontier(seeds: DataFrame, links: DataFrame, depth: int = 2, cap: int = 15) -> DataFrame:
    """seeds: site, url. links: url, link. Returns site, url, depth: what is reached in up to ``depth`` steps, each url once, the ``cap`` first of a site by depth and url.

    Each level is written, and a site goes on only while it has fewer than ``cap`` urls: what comes deeper stands behind. So a level's plan holds only the level before.
    """
    level = materialise(seeds.select("site", "url").distinct().withColumn("depth", F.lit(0)))
    found = level
    for d in range(1, depth + 1):
        going = found.groupBy("site").count().where(F.col("count") < cap).select("site")
        reached = level.join(going, "site", "left_semi").join(links.select("url", "link"), "url").select("site", F.col("link").alias("url")).distinct()
        level = materialise(reached.join(found.select("site", "url"), ["site", "url"], "left_anti").withColumn("depth", F.lit(d)))
        found = found.unionByName(level)
    w = Window.partitionBy("site").orderBy("depth", "url")
    return found.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cap).drop("__rn")


def coverage(urls: DataFrame, site: str, url: str) -> DataFrame:
    """Inventory routes of each kind found a site."""
    return urls.groupBy(site).agg(F.count("*").alias("urls"), *(F.count_if(F.lower(F.col(url)).rlike(p)).alias(f"{kind}_routes") for kind, p in ROUTES.items()))


def breakdown(diagnostics: DataFrame, site: str) -> DataFrame:
    """One row a site: pages, dynamic and failed ones, and counts by depth as a map."""
    by_depth = diagnostics.groupBy(site, "depth").agg(F.count("*").alias("n"), F.count_if(F.col("discovery_source").isin(*DYNAMIC)).alias("dynamic"), F.count_if(F.col("crawl_status").isin("error", "blocked")).alias("failed"))
    return by_depth.groupBy(site).agg(F.sum("n").alias("pages"), F.sum("dynamic").alias("dynamic"), F.sum("failed").alias("failed"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("depth", "n")))).alias("by_depth"))


def too_blocked(blocked: Column, visited: Column) -> Column:
    return F.coalesce(blocked / F.nullif(visited + blocked, F.lit(0)) >= BLOCKED_SHARE, F.lit(False))


def missing_sections(sections: DataFrame, urls: DataFrame) -> DataFrame:
    """sections: site, label, href. urls: site, url. Sections that no url of the site holds by label or target.

    Urls of a site meet its few sections by an equal join on the site; what fits is one flag a section.
    """
    fits = F.contains(F.lower("url"), F.lower("label")) | ((F.coalesce("href", F.lit("")) != "") & F.contains(F.lower("url"), F.lower("href")))
    covered = sections.join(urls.select("site", "url"), "site").where(fits).select("site", "label").distinct()
    return sections.join(covered, ["site", "label"], "left_anti")


def escalated(sections: DataFrame, urls: DataFrame, cap: int = 5) -> DataFrame:
    """sections: site, place, label, start (a url of the site). urls: site, place, url. Returns site, place, url: what to fetch again for sections that are missing, the ``cap`` first a site.

    A section stands for the first url of its site that holds its label (letters and digits alone); where none does, or an earlier section has it already, for a path made of the label. Nothing stands twice. A site's sections come
    to its urls as one array, and only urls that fit one go on.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    asked = sections.select("site", "place", "label", "start").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("place", "label", "start"))).alias("__asked"))
    fits = F.filter("__asked", lambda s: F.contains(plain(F.col("url")), plain(s["label"])))
    hits = urls.select("site", F.col("place").alias("__at"), "url").join(asked, "site").select("site", "__at", "url", F.explode(fits).alias("__s"))
    first = hits.groupBy("site", F.col("__s.place").alias("place"), F.col("__s.label").alias("label")).agg(F.min_by("url", F.struct("__at", "url")).alias("__hit"))
    known = sections.join(first, ["site", "place", "label"], "left").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("place", "label", "start", "__hit"))).alias("__all"))

    def step(done: Column, s: Column) -> Column:
        made = F.concat(F.regexp_extract(s["start"], r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"), F.regexp_replace(F.lower(s["label"]), r"\s+", "-"))
        free = s["__hit"].isNotNull() & ~F.coalesce(F.array_contains(done, s["__hit"]), F.lit(False))
        return F.array_distinct(F.concat(done, F.array(F.when(free, s["__hit"]).otherwise(made))))

    return known.select("site", F.posexplode(F.slice(F.aggregate("__all", F.array().cast("array<string>"), step), 1, cap)).alias("place", "url"))


def paired(incoming: DataFrame, existing: DataFrame, keys: list[Column], in_id: str, ex_id: str) -> DataFrame:
    """in_id, ex_id, rule: one-to-one matches. Each key (an expression over either table) is tried in turn on what is still free; equal key values pair off in order of ids.

    The k-th incoming row of a value goes to its k-th existing row, so a value that many rows share makes no pairs beyond its rows.
    """
    free_in, free_ex, out = incoming, existing, None
    for rule, key in enumerate(keys):
        side = lambda df, name: df.select(F.col(name), key.alias("__k")).where("__k is not null and __k <> ''").withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(name)))  # noqa: B023, E731
        found = side(free_in, in_id).join(side(free_ex, ex_id), ["__k", "__n"]).select(in_id, ex_id, F.lit(rule).alias("rule"))
        out = found if out is None else out.unionByName(found)
        free_in, free_ex = free_in.join(found, in_id, "left_anti"), free_ex.join(found, ex_id, "left_anti")
    return out
